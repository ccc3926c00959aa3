"""Importing this module registers every query."""

from checks import baseline, evidence, feeds, incidents, joins, overview, scalars, streams  # noqa: F401

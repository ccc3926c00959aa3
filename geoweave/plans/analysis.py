"""Baseline to incidents as one analysis: the tables users read, built from each other once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geoweave.fixed_values import EXPLANATIONS
from geoweave.operators import baseline as bl
from geoweave.operators import incidents as inc
from geoweave.operators.components import cell_components
from geoweave.session import cut_lineage


@dataclass
class Analysis:
    """Lazily built tables of one analysis window. Counts, scores and components are written to the checkpoint folder, because
    every later table reads them (the counts twice: once for the cells, once for the values); the rest stays a plan."""

    window: bl.BinWindow
    events: DataFrame
    points: DataFrame
    hotspots: DataFrame
    track_span: tuple[float, float] | None = None
    explanations: tuple = EXPLANATIONS

    @cached_property
    def keys(self) -> DataFrame:
        return bl.stream_keys(self.window, self.events, self.points, self.hotspots)

    @cached_property
    def counts(self) -> DataFrame:
        return cut_lineage(bl.stream_counts(self.keys))

    @cached_property
    def series(self) -> DataFrame:
        return cut_lineage(bl.dense_series(self.counts, self.window, self.track_span, with_ring=True))

    @cached_property
    def scores(self) -> DataFrame:
        return cut_lineage(bl.robust_scores(self.series, self.window))

    @cached_property
    def departed_cells(self) -> DataFrame:
        return bl.departed_cells(self.scores)

    @cached_property
    def components(self) -> DataFrame:
        return cut_lineage(cell_components(self.departed_cells))

    @cached_property
    def states(self) -> DataFrame:
        return cut_lineage(inc.stream_states(self.components, self.scores))

    @cached_property
    def predictions(self) -> DataFrame:
        return inc.evaluate_predictions(self.components, self.states, self.scores, self.series, self.events, self.window, self.explanations)

    @cached_property
    def ranked(self) -> DataFrame:
        return inc.rank_explanations(self.predictions)

    @cached_property
    def next_checks(self) -> DataFrame:
        return inc.next_checks(self.predictions, self.ranked)

    @cached_property
    def rows(self) -> DataFrame:
        return cut_lineage(inc.component_rows(self.components, self.states, self.ranked))

    @cached_property
    def incidents(self) -> DataFrame:
        return cut_lineage(inc.incident_rows(inc.track_incidents(self.rows, self.window), self.rows, self.window))

    @cached_property
    def revisions(self) -> DataFrame:
        return inc.revisions(self.incidents)

    @cached_property
    def evidence(self) -> DataFrame:
        return inc.evidence_rollup(self.components, self.states, self.events, self.window)

    @cached_property
    def places(self) -> DataFrame:
        return inc.most_reported_place(self.components, self.events, self.window)

    @cached_property
    def assessments(self) -> DataFrame:
        return inc.assessments(self.rows, self.states, self.ranked, self.predictions, self.next_checks, self.places)

    def snapshot(self, t: float) -> DataFrame:
        """Incidents of the last completed bin in display order, with assessment and next check."""
        now = inc.incidents_at(self.incidents, self.window, t)
        told = self.assessments.select("component", "established", "headline", "question", "adequately_supported")
        return inc.display_order(now.join(told, "component", "left"))

    def durable(self, t: float, stored: DataFrame) -> DataFrame:
        """The store of durable incidents after the rebuild at `t`, from the store before it; the last 24 revisions of each stay."""
        now = inc.with_revisions(inc.incidents_at(self.incidents, self.window, t), inc.revisions(self.incidents, t))
        return inc.durable_ids(now, stored, t, most_revisions=24)

    def departures(self, t: float) -> DataFrame:
        observed = self.series.filter(F.exists("vals", lambda v: v > 0) | F.exists("cov", lambda v: v > 0)).select("row", "col").distinct()
        return bl.departures_at(self.scores.join(observed, ["row", "col"], "left_semi"), self.window, t)

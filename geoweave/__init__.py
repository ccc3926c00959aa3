"""Geo-event analytics on Spark: proximity, baselines, incidents and evidence tables as DataFrame operators."""

"""Fit and transform of node tables: the features of one table, applied to others."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from nodeloom.operators import reshape
from nodeloom.sources.tables import NODE, SUBJECT, TRACT


class FeatureMapper:
    """Learns the features of a node table; ``transform`` gives any table those features, in that order.

    Features that a table lacks are null, those it has beyond are left out. With ``bundles``, features
    are aggregates of each (metric, tract).
    """

    def __init__(self, metrics: Sequence[str] | None = None, concat_sessions: bool = False, method: str = "linear", bundles: str | None = None):
        self.metrics, self.concat_sessions, self.method, self.bundles = metrics, concat_sessions, method, bundles

    def _cells(self, nodes: DataFrame) -> DataFrame:
        return reshape.collapse(reshape.melt(reshape.with_sessions(nodes, self.concat_sessions), self.metrics))

    def fit(self, nodes: DataFrame) -> FeatureMapper:
        if self.bundles:
            metrics = list(self.metrics or reshape.metrics_of(nodes))
            self.features_ = reshape.bundle_dim(reshape.bundle_aggregate(nodes, self.bundles, metrics, self.concat_sessions), metrics)
        else:
            self.features_ = reshape.feature_dim(self._cells(nodes))
        return self

    def transform(self, nodes: DataFrame) -> DataFrame:
        """(subjectID, feature_idx, ..., value)"""
        if self.bundles:
            long = reshape.bundle_aggregate(nodes, self.bundles, self.metrics, self.concat_sessions)
            return long.select(SUBJECT).distinct().join(self.features_).join(long, [SUBJECT, "metric", TRACT], "left")
        cells = self._cells(nodes)
        full = cells.select(SUBJECT).distinct().join(self.features_).join(cells, [SUBJECT, "metric", TRACT, NODE], "left")
        return reshape.interpolate(full, self.method)

    def fit_transform(self, nodes: DataFrame) -> DataFrame:
        return self.fit(nodes).transform(nodes)

    def feature_names(self) -> list[tuple]:
        columns = [c for c in ("metric", TRACT, NODE) if c in self.features_.columns]
        return [tuple(r) for r in self.features_.orderBy(F.col("feature_idx")).select(*columns).collect()]

"""A table of profiles with its subjects, targets and classes: immutable, lazy, long."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from nodeloom.operators import reshape
from nodeloom.operators.features import group_names
from nodeloom.operators.targets import check_targets, drop_missing, encode, join_targets
from nodeloom.sources.tables import SESSION, SUBJECT, read_nodes, read_subjects


@dataclass(frozen=True)
class ProfileDataset:
    """features: (subjectID, metric, tractID, nodeID, pos, group_idx, feature_idx, value); subjects: (subjectID, row_idx)."""

    features: DataFrame
    subjects: DataFrame
    targets: DataFrame | None = None
    classes: dict[str, DataFrame] | None = None
    target_cols: tuple[str, ...] = ()
    sessions: DataFrame | None = None

    @classmethod
    def build(
        cls,
        nodes: DataFrame,
        attributes: DataFrame | None = None,
        target_cols: Sequence[str] | None = None,
        encode_cols: Sequence[str] | None = None,
        *,
        metrics: Sequence[str] | None = None,
        index_col: str = SUBJECT,
        concat_sessions: bool = False,
        bundle_means: bool = False,
        prefix: bool = False,
    ) -> ProfileDataset:
        """From a node table and, unless unsupervised, a table of attributes."""
        wanted = list(encode_cols or ())
        check_targets(target_cols, wanted, attributes is None)
        sessions = nodes.select(SUBJECT, SESSION).distinct() if SESSION in nodes.columns else None
        if bundle_means:
            metrics = list(metrics or reshape.metrics_of(nodes))
            long = reshape.bundle_aggregate(nodes, "mean", metrics, concat_sessions)
            dims = reshape.bundle_dim(long, metrics).withColumn("group_idx", F.col("feature_idx"))
            features = long.select(SUBJECT).distinct().join(dims).join(long, [SUBJECT, "metric", "tractID"], "left")
        else:
            features = reshape.features_long(nodes, metrics, concat_sessions)
        if prefix:
            features = features.withColumn(SUBJECT, reshape.standard_id(F.col(SUBJECT)))
            sessions = sessions.withColumn(SUBJECT, reshape.standard_id(F.col(SUBJECT))) if sessions is not None else None
            attributes = attributes.withColumn(index_col, reshape.standard_id(F.col(index_col).cast("string"))) if attributes is not None else None
        subjects = features.select(SUBJECT).distinct().withColumn("row_idx", F.row_number().over(Window.orderBy(SUBJECT)) - 1)
        if attributes is None:
            return cls(features, subjects, sessions=sessions)
        targets = join_targets(subjects, attributes, list(target_cols), index_col)
        targets, classes = encode(targets, wanted)
        return cls(features, subjects, targets, classes, tuple(target_cols), sessions)

    @classmethod
    def from_files(cls, spark: SparkSession, fn_nodes: str, fn_subjects: str | None = None, *, target_cols=None, label_encode_cols=None, index_col: str = SUBJECT, dwi_metrics=None, unsupervised: bool = False, concat_subject_session: bool = False, return_bundle_means: bool = False, enforce_sub_prefix: bool = True) -> ProfileDataset:
        """From text files; see ``build``."""
        check_targets(target_cols, label_encode_cols, unsupervised)
        nodes = read_nodes(spark, fn_nodes, dwi_metrics)
        attributes = None if unsupervised else read_subjects(spark, fn_subjects, index_col)
        return cls.build(nodes, attributes, target_cols, label_encode_cols, metrics=dwi_metrics, index_col=index_col, concat_sessions=concat_subject_session, bundle_means=return_bundle_means, prefix=enforce_sub_prefix)

    def __len__(self) -> int:
        return self.subjects.count()

    @property
    def shape(self) -> tuple[tuple[int, int], tuple[int, int] | None]:
        """((subjects, features), (subjects, targets) or None)"""
        n = len(self)
        width = self.features.select("feature_idx").distinct().count()
        return (n, width), (n, len(self.target_cols)) if self.targets is not None else None

    def describe(self) -> str:
        (n, width), y = self.shape
        groups = self.group_names.count()
        return f"ProfileDataset(n_subjects={n}, n_features={width}, n_groups={groups}, targets={list(self.target_cols) if y else None})"

    @property
    def group_names(self) -> DataFrame:
        return group_names(self.features)

    def _only(self, kept: DataFrame, renumber: bool) -> ProfileDataset:
        ids = kept.select(SUBJECT)
        subjects = kept.select(SUBJECT, "row_idx")
        if renumber:
            subjects = subjects.withColumn("row_idx", F.row_number().over(Window.orderBy("row_idx")) - 1)
        only = lambda df: None if df is None else df.join(ids, SUBJECT, "left_semi")
        return replace(self, features=only(self.features), subjects=subjects, targets=only(self.targets), sessions=only(self.sessions))

    def persist(self) -> ProfileDataset:
        """The same with its tables kept in memory and on disk once they are computed, for work that reads them often."""
        return replace(self, features=self.features.persist(), subjects=self.subjects.persist(), targets=None if self.targets is None else self.targets.persist())

    def only(self, kept: DataFrame) -> ProfileDataset:
        """With the subjects of ``kept`` (subjectID, row_idx); positions stay as they were."""
        return self._only(kept, False)

    def __getitem__(self, rows) -> ProfileDataset:
        """Subjects by position: a slice, an index, a list of them, or a list of booleans. Positions stay as they were."""
        i = F.col("row_idx")
        if isinstance(rows, (int, slice)):
            n = len(self)
            span = range(n)[rows] if isinstance(rows, slice) else [range(n)[rows]]
            if isinstance(span, range) and span.step == 1:
                return self._only(self.subjects.where((i >= span.start) & (i < span.stop)), False)
            rows = list(span)
        if rows and isinstance(rows[0], bool):
            rows = [k for k, keep in enumerate(rows) if keep]
        wanted = self.subjects.sparkSession.createDataFrame([(int(k),) for k in rows], "row_idx int")
        return self._only(self.subjects.join(wanted.distinct(), "row_idx", "left_semi"), False)

    def drop_target_na(self) -> ProfileDataset:
        """Without subjects that lack a target; encoded labels that stand for missing count as lacking."""
        if self.targets is None:
            return self
        whole = drop_missing(self.targets, self.target_cols)
        return self._only(self.subjects.join(whole.select(SUBJECT), SUBJECT, "left_semi"), True)

    def bundle_means(self) -> ProfileDataset:
        """Features replaced by the mean of each group, missing values skipped."""
        means = reshape.bundle_means(self.features)
        return replace(self, features=means.withColumn("feature_idx", F.col("group_idx")))

    def matrix(self) -> DataFrame:
        """(subjectID, x, targets): one array per subject."""
        m = reshape.matrix(self.features)
        return m if self.targets is None else m.join(self.targets, SUBJECT)

    def tensors(self, channels_last: bool = True, bundles_as_channels: bool = True) -> DataFrame:
        """(subjectID, x, targets) with x nested as steps and channels, or flat."""
        if not bundles_as_channels:
            return self.matrix()
        row = self.features.agg(F.countDistinct("group_idx"), F.countDistinct("feature_idx")).first()
        x = reshape.tensors(reshape.matrix(self.features), row[1] // row[0], row[0], channels_last)
        return x if self.targets is None else x.join(self.targets, SUBJECT)

    def batches(self, channels_last: bool = True, bundles_as_channels: bool = True):
        """An iterator of (float32 array, targets) per subject, streamed through the driver partition by partition."""
        import numpy as np

        columns = [f"{c}_code" if c in (self.classes or {}) else c for c in self.target_cols]
        for row in self.tensors(channels_last, bundles_as_channels).toLocalIterator():
            yield np.array(row["x"], np.float32), np.array([row[c] for c in columns], np.float32)

    def fit(self, model, **params):
        """The model fitted on this dataset: any object with ``fit(matrix, "x", target, key)``."""
        return model.fit(self.matrix(), "x", self._target(), SUBJECT, **params)

    def transform(self, change) -> ProfileDataset:
        """With ``change(features)`` in the place of the features: an imputer, a scaler, or a chain of them."""
        return replace(self, features=change(self.features))

    def predict(self, model, **params) -> DataFrame:
        return model.predict(self.matrix(), "x", SUBJECT, **params)

    def score(self, model, **params) -> float:
        """The model's own score: accuracy for classifiers, R squared for regressors."""
        return model.score(self.matrix(), "x", self._target(), SUBJECT, **params)

    def _target(self) -> str:
        if len(self.target_cols) != 1:
            raise ValueError("models take exactly one target")
        c = self.target_cols[0]
        return f"{c}_code" if c in (self.classes or {}) else c


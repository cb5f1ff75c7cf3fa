"""Small fixtures with known results, errors, and properties of the profile operators."""

import itertools
import math
import os
import subprocess
import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from nodeloom.functions import series, stats
from nodeloom.operators import augment, features, match, profiles, reshape, scale, targets
from nodeloom.plans import bagging, validation
from nodeloom.plans.dataset import ProfileDataset
from nodeloom.plans.estimators import AdaBoost, Logistic, Ridge, SparseGroupClassifier, SparseGroupRegressor, make
from nodeloom.plans.fitted import Fitted
from nodeloom.plans.pipeline import make_classifier_pipeline, make_pipeline
from nodeloom.sources import store, studies, tables

GAPS = [
    ("s1", "A", 0, 1.0), ("s1", "A", 3, 4.0), ("s1", "A", 5, 8.0), ("s1", "A", 1, None), ("s2", "A", 1, 2.0), ("s2", "A", 5, 5.0), ("s1", "B", 0, 1.0), ("s1", "B", 1, 2.0),
    ("s1", "B", 3, 3.0), ("s1", "B", 4, 4.0), ("s2", "B", 5, 9.0), ("s2", "B", 5, 11.0), ("s3", "A", 0, None), ("s2", "A", 4, float("nan")),
]


def _nodes(spark):
    return spark.createDataFrame(GAPS, "subjectID string, tractID string, nodeID int, m double")


def _values(df, subject, tract):
    return [r["value"] for r in df.where((F.col("subjectID") == subject) & (F.col("tractID") == tract)).orderBy("nodeID").collect()]


def test_gaps_are_filled_by_position(spark):
    out = reshape.features_long(_nodes(spark)).persist()
    assert _values(out, "s1", "A") == [1, 2.5, 4, 6, 8]  # node 2 has no value anywhere, so node 1 is halfway
    assert _values(out, "s2", "A") == [None, 2, 3, 4, 5]
    assert _values(out, "s1", "B") == [1, 2, 3, 4, None]
    assert _values(out, "s2", "B") == [None, None, None, None, 10]
    assert {r[0] for r in out.select("subjectID").distinct().collect()} == {"s1", "s2"}


def test_fill_agrees_with_pandas(spark):
    random = np.random.default_rng(3)
    rows = [(f"s{s}", "T", n, float(random.normal())) for s in range(6) for n in range(20) if random.random() < 0.5]
    df = spark.createDataFrame(rows, "subjectID string, tractID string, nodeID int, m double")
    wide = pd.DataFrame(rows, columns=["s", "t", "n", "v"]).pivot(index="n", columns="s", values="v")
    for ours, theirs in (("linear", "linear"), ("nearest", None), ("ffill", None)):
        out = reshape.features_long(df, method=ours).toPandas().pivot(index="nodeID", columns="subjectID", values="value").astype(float)
        if theirs:
            expected = wide.interpolate(method=theirs, limit_direction="both", limit_area="inside")
            np.testing.assert_allclose(out.to_numpy(), expected.to_numpy(), equal_nan=True)
        known = ~np.isnan(wide.to_numpy())
        np.testing.assert_array_equal(out.to_numpy()[known], wide.to_numpy()[known])
    cubic = reshape.features_long(df, method="cubic").toPandas().pivot(index="nodeID", columns="subjectID", values="value").astype(float)
    for s in wide.columns:
        np.testing.assert_allclose(cubic[s].to_numpy(), series.fill_cubic(np.arange(float(len(wide))), wide[s].to_numpy()), equal_nan=True)


def test_bundles_keep_empty_subjects_and_take_functions(spark):
    out = reshape.bundle_aggregate(_nodes(spark), "mean")
    assert out.where("subjectID = 's3'").first()["value"] is None
    ours = reshape.bundle_aggregate(_nodes(spark), lambda s: s.max() - s.min()).where("subjectID = 's1' and tractID = 'A'").first()["value"]
    assert ours == 7
    both = reshape.bundle_aggregate(_nodes(spark), ["mean", "max"])
    assert {r["agg"] for r in both.select("agg").distinct().collect()} == {"mean", "max"}


def test_cubic_spline():
    x = np.array([0.0, 1, 2.5, 4, 7])
    f = lambda t: 2 - t + 0.5 * t**2 - 0.1 * t**3
    at = np.linspace(0, 7, 30)
    np.testing.assert_allclose(series.spline_basis(x, at) @ f(x), f(at), atol=1e-9)
    gappy = np.array([np.nan, 1, np.nan, 3, np.nan])
    np.testing.assert_allclose(series.fill_cubic(np.arange(5.0), gappy), [np.nan, 1, 2, 3, np.nan], equal_nan=True)


def test_ids_and_sessions(spark):
    df = spark.createDataFrame([("sub-01",), ("01",)], "i string")
    assert [r[0] for r in df.select(reshape.standard_id(F.col("i"))).collect()] == ["sub-01", "sub-01"]
    with pytest.raises(ValueError):
        reshape.with_sessions(_nodes(spark), True)


LABELLED = [(s, t, n, v) for s, vs in (("sub-1", ".1 .2 .3 .3"), ("sub-2", ".4 .5 .6 .6"), ("sub-3", ".7 .8 .9 .9")) for (t, n), v in zip((("A", 0), ("A", 1), ("B", 0), ("B", 1)), map(float, vs.split()), strict=True)]


def _labelled(spark):
    nodes = spark.createDataFrame([(s.removeprefix("sub-") if s == "sub-3" else s, t, n, v) for s, t, n, v in LABELLED], "subjectID string, tractID string, nodeID int, fa double")
    people = spark.createDataFrame([("1", 0, "A"), ("2", 1, "B"), ("3", 2, None)], "subject_id string, age int, site string")
    return nodes, people


def test_dataset_labels_and_missing(spark):
    nodes, people = _labelled(spark)
    d = ProfileDataset.build(nodes, people, ["age", "site"], ["site"], index_col="subject_id", prefix=True)
    assert d.shape == ((3, 4), (3, 2))
    assert [r["subjectID"] for r in d.subjects.orderBy("row_idx").collect()] == ["sub-1", "sub-2", "sub-3"]
    assert [r["label"] for r in d.classes["site"].orderBy("code").collect()] == ["A", "B", "NaN"]
    kept = d.drop_target_na()
    assert kept.shape == ((2, 4), (2, 2)) and len(d) == 3
    assert len(d[:2]) == 2 and len(d[[0, 2]]) == 2 and len(d[[True, False, False]]) == 1 and len(d[-1]) == 1
    assert "n_subjects=3" in d.describe()
    assert d.bundle_means().shape[0] == (3, 2)
    first = next(iter(d.batches()))
    assert first[0].shape == (2, 2) and first[0].dtype == np.float32


def test_dataset_errors(spark):
    nodes, people = _labelled(spark)
    with pytest.raises(ValueError):
        ProfileDataset.build(nodes, people, None, index_col="subject_id")
    with pytest.raises(ValueError):
        ProfileDataset.build(nodes, people, ["age"], ["site"], index_col="subject_id")
    with pytest.raises(ValueError):
        targets.join_targets(nodes, people.unionByName(people), ["age"], "subject_id")
    with pytest.raises(ValueError):
        reshape.channels(reshape.features_long(nodes), 3, 3)


def test_csv_round(spark, tmp_path):
    (tmp_path / "nodes.csv").write_text("subjectID,tractID,nodeID,md,fa,\n01,Left A,0,0.5,NaN,x\n01,Left A,1,,0.25,y\n", encoding="utf-8")
    (tmp_path / "subjects.tsv").write_text("\tsubjectID\tage\tsex\n0\t01\t20\tNA\n1\t02\tn/a\tF\n", encoding="utf-8")
    n = tables.read_nodes(spark, str(tmp_path / "nodes.csv"))
    assert n.columns == ["subjectID", "tractID", "nodeID", "md", "fa"]
    assert [tuple(r) for r in n.orderBy("nodeID").collect()] == [("01", "Left A", 0, 0.5, None), ("01", "Left A", 1, None, 0.25)]
    s = tables.read_subjects(spark, str(tmp_path / "subjects.tsv"))
    assert [tuple(r) for r in s.orderBy("subjectID").collect()] == [("01", 20.0, None), ("02", None, "F")]
    with pytest.raises(ValueError):
        tables.read_nodes(spark, str(tmp_path / "nodes.csv"), ["ad"])
    d = ProfileDataset.from_files(spark, str(tmp_path / "nodes.csv"), str(tmp_path / "subjects.tsv"), target_cols=["age"], dwi_metrics=["md"])
    assert d.targets.first()["subjectID"] == "sub-01"
    studies.register("here", studies.Study("nodes.csv", "subjects.tsv", {"target_cols": ["age"]}))
    assert len(studies.study(spark, "HERE", str(tmp_path))) == 1
    with pytest.raises(ValueError):
        studies.study(spark, "nowhere", str(tmp_path))


def test_cached_copy(tmp_path):
    calls = []

    def fetch(url, path):
        calls.append(url)
        with open(path, "w") as f:
            f.write("x")

    path = str(tmp_path / "a" / "f.csv")
    assert studies.cached("u", path, fetch) and not studies.cached("u", path, fetch)
    with open(path, "w") as f:
        f.write("changed")
    assert studies.cached("u", path, fetch) and calls == ["u", "u"]


TEST = [(1, 2, 3, 4), (4, 2, 1, 3), (1, 4, 5, 6)]
CONTROL = [(3, 2, 3, 4), (4, 5, 1, 3), (1, 10, 5, 6), (1, 2, 2, 4), (4, 2, 0, 3), (1, 4, 9, 6)]


def test_matching(spark):
    rows = [(34 + i, int(i < 3), *map(float, v)) for i, v in enumerate(TEST + CONTROL)]
    df = spark.createDataFrame(rows, "eid int, status int, f0 double, f1 double, f2 double, f3 double")
    out = match.mahalanobis_match(df, "status", "eid", threshold=1.0).orderBy("side", "ord").collect()
    assert [r["eid"] for r in out] == [34, 35, 40, 41]
    with pytest.raises(ValueError):
        match.mahalanobis_match(df, "nothing", "eid")
    with pytest.raises(ValueError):
        match.mahalanobis_match(df.withColumn("status", F.col("eid")), "status", "eid")
    with pytest.raises(ValueError):
        match.mahalanobis_match(df.withColumn("f0", F.when(F.col("eid") != 35, F.col("f0"))), "status", "eid")


def test_assignment_is_the_cheapest():
    random = np.random.default_rng(1)
    for n, m in ((1, 4), (3, 3), (4, 6), (6, 4), (5, 5)):
        cost = random.random((n, m)).round(1)
        r, c = match.assign(cost)
        assert len(r) == min(n, m) == len(set(c.tolist()))
        wide = cost if n <= m else cost.T
        best = min(sum(wide[i, p[i]] for i in range(len(wide))) for p in itertools.permutations(range(wide.shape[1]), len(wide)))
        assert math.isclose(cost[r, c].sum(), best)


def test_warping():
    random = np.random.default_rng(2)
    x = random.random((12, 2))
    for slope in ("symmetric", "asymmetric"):
        distance, p, q = series.warp(x, x, slope)
        assert distance == 0 and p.tolist() == q.tolist() == list(range(12))
        y = random.random((12, 2))
        distance, p, q = series.warp(x, y, slope, 3)
        assert (p[-1], q[-1]) == (11, 11) and np.abs(p - q).max() <= 3
        assert math.isclose(distance, np.sqrt(((x[p] - y[q]) ** 2).sum(1)).sum())
    assert series.warp(x, x, shape=True)[0] == 0
    assert series.warp(x, np.repeat(x, 2, axis=0)[:20], "symmetric")[0] < series.warp(x, random.random((20, 2)), "symmetric")[0]
    with pytest.raises(ValueError):
        series.warp(x, x, "steep")


def _sequences(spark, n=6, steps=20):
    random = np.random.default_rng(5)
    rows = [(s, s % 2 if s else 9, c, t, float(np.sin(t / 3 + s % 2) + 0.1 * random.normal())) for s in range(n) for c in range(2) for t in range(steps)]
    return spark.createDataFrame(rows, "sample_id int, label int, channel int, step int, value double")


def test_native_augmentation(spark):
    x = _sequences(spark).persist()
    for out in (augment.jitter(x), augment.scaling(x), augment.permutation(x), augment.permutation(x, equal=False), augment.window_slice(x), augment.window_slice(x, by_channel=True)):
        assert out.count() == x.count() and out.select("sample_id", "channel", "step").distinct().count() == x.count()
    p = augment.permutation(x, equal=False).toPandas().sort_values(["sample_id", "channel", "step"])
    for (s, c), g in x.toPandas().groupby(["sample_id", "channel"]):
        assert sorted(g["value"]) == sorted(p[(p.sample_id == s) & (p.channel == c)]["value"])
    assert augment.window_slice(x, 1.0).exceptAll(x).count() == 0
    means = augment.jitter(x, 0.01, 3).join(x.withColumnRenamed("value", "v"), ["sample_id", "channel", "step"]).agg(F.avg(F.col("value") - F.col("v"))).first()[0]
    assert abs(means) < 0.01


@pytest.mark.parametrize("name", ["magnitude_warp", "time_warp", "window_warp", "spawner", "barycenter", "guided_warp", "discriminative_warp"])
def test_other_augmentation(spark, name):
    x = _sequences(spark)
    packed = augment.pack(x)
    out = augment.unpack(getattr(augment, name)(packed, seed=1)).toPandas()
    again = augment.unpack(getattr(augment, name)(packed.repartition(3), seed=1)).toPandas()
    keys = ["sample_id", "channel", "step"]
    assert len(out) == x.count() and np.isfinite(out["value"]).all()
    pd.testing.assert_frame_equal(out.sort_values(keys, ignore_index=True), again.sort_values(keys, ignore_index=True))
    if name in ("guided_warp", "discriminative_warp"):  # the sample with a label of its own has no partner
        own = x.where("sample_id = 0").toPandas().sort_values(keys)["value"].to_numpy()
        got = out[out.sample_id == 0].sort_values(keys)["value"].to_numpy()
        assert name != "guided_warp" or np.allclose(own, got)


def test_partners_share_the_label(spark):
    packed = augment.pack(_sequences(spark, 9))
    rows = augment.with_partner(packed, "t", 1).collect()
    by_values = {tuple(r["x"]): r for r in packed.collect()}
    for r in rows:
        if r["partner"] is None:
            assert r["label"] == 9
        else:
            other = by_values[tuple(r["partner"])]
            assert other["label"] == r["label"] and other["sample_id"] != r["sample_id"]
    for r in augment.with_draws(packed, 3, 2, "t", 1, False).collect():
        same, different = ([by_values[tuple(v)] for v in r[c] or []] for c in ("same", "different"))
        assert all(s["label"] == r["label"] and s["sample_id"] != r["sample_id"] for s in same)
        assert len(different) == 2 and all(d["label"] != r["label"] for d in different)


def test_tails():
    assert math.isclose(stats.f_tail(4.0, 1, 10), 0.07338803477, abs_tol=1e-9)
    assert math.isclose(stats.t_quantile(0.975, 10), 2.228138852, abs_tol=1e-8)
    assert stats.f_tail(0.0, 1, 5) == 1.0


def test_bins(spark):
    df = spark.createDataFrame([(str(i), float(v)) for i, v in enumerate([1, 2, 3, 4, 10])], "subjectID string, v double")
    assert profiles.quantile_edges(df, "v", 4) == [1, 2, 3, 4, 10]
    edges = profiles.width_edges(df, "v", 3)
    np.testing.assert_allclose(edges, [0.991, 4, 7, 10])
    assert [r[0] for r in df.select(profiles.bin_index(F.col("v"), edges)).collect()] == [0, 0, 0, 0, 2]
    with pytest.raises(ValueError):
        profiles.hue(df, "v", quantiles=2, bins=2, name="v")
    with pytest.raises(ValueError):
        profiles.hue(df, "v", bins=2)
    with pytest.raises(ValueError):
        profiles.hue(df, None, name="v")


def test_intervals_hold_the_mean(spark):
    rows = [(f"s{i}", "m", "T", 0, float(i % 10)) for i in range(200)]
    df = spark.createDataFrame(rows, "subjectID string, metric string, tractID string, nodeID int, value double")
    hues = df.select("subjectID", F.lit("all").alias("hue"))
    r = profiles.profiles_with_intervals(df, hues, 300).first()
    assert r["mean"] == 4.5 and r["low"] < 4.5 < r["high"] and 0.5 < r["high"] - r["low"] < 1.2


def test_imputers_and_scalers(spark):
    df = spark.createDataFrame([(0, 0, 1.0), (1, 0, None), (2, 0, 3.0), (0, 1, 2.0), (1, 1, 2.0), (2, 1, 2.0), (0, 2, None), (1, 2, None), (2, 2, None)], "k int, feature_idx int, value double")
    out = {(r["k"], r["feature_idx"]): r["value"] for r in scale.impute(df).collect()}
    assert out[1, 0] == 2 and (0, 2) not in out
    assert {r["value"] for r in scale.scale(scale.impute(df), "standard").where("feature_idx = 1").collect()} == {0.0}
    assert scale.impute_nearest(df, "k", 1).where("k = 1 and feature_idx = 0").first()["value"] == 1.0
    with pytest.raises(ValueError):
        scale.scale(df, "upside")
    with pytest.raises(ValueError):
        scale.impute(df, "guess")
    random = np.random.default_rng(0)
    columns = [np.exp(random.normal(3, 0.4, size=500)) - 1, random.normal(size=500), random.gamma(2, size=500) - 1, np.full(500, 2.0)]
    long = spark.createDataFrame([(k, j, float(v)) for j, c in enumerate(columns) for k, v in enumerate(c)], "k int, feature_idx int, value double").repartition(3)
    powers = {r["feature_idx"]: r["__power"] for r in scale.best_powers(long).collect()}
    for j, c in enumerate(columns[:3]):
        loss = lambda p, c=c: len(c) / 2 * np.log(scale._bend(c, p).var()) - (p - 1) * (np.sign(c) * np.log1p(np.abs(c))).sum()
        grid = np.linspace(-4, 4, 4001)
        assert abs(powers[j] - grid[np.argmin([loss(p) for p in grid])]) < 0.01
    assert abs(powers[0]) < 0.3  # the logarithm after adding one is normal
    out = scale.power_transform(long).groupBy("feature_idx").agg(F.avg("value").alias("m"), F.stddev_pop("value").alias("s")).orderBy("feature_idx").collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in out[:3])


def test_powers_beyond_the_first_range(spark):
    random = np.random.default_rng(1)
    columns = [np.exp(random.normal(0, 2.5, size=400)), random.normal(1e-3, 1e-4, size=400) ** 2 * 1e3]
    columns[0] = (columns[0] - columns[0].mean()) / columns[0].std()
    long = spark.createDataFrame([(k, j, float(v)) for j, c in enumerate(columns) for k, v in enumerate(c)], "k int, feature_idx int, value double").repartition(3)
    powers = {r["feature_idx"]: r["__power"] for r in scale.best_powers(long).collect()}
    for j, c in enumerate(columns):
        loss = lambda p, c=c: len(c) / 2 * np.log(scale._bend(c, p).var()) - (p - 1) * (np.sign(c) * np.log1p(np.abs(c))).sum()
        assert abs(powers[j]) > 5 and loss(powers[j]) < loss(-4.5 if powers[j] < 0 else 4.5)
        around = np.linspace(powers[j] - abs(powers[j]) / 2, powers[j] + abs(powers[j]) / 2, 2001)
        assert abs(powers[j] / around[np.argmin([loss(p) for p in around])] - 1) < 0.01


def test_neighbours_of_all_rows(spark):
    random = np.random.default_rng(4)
    x = random.normal(size=(90, 3)).round(2)
    x[random.random(x.shape) < 0.2] = np.nan
    x[:3] = np.nan  # share nothing
    long = spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)], "k int, feature_idx int, value double")
    got = {(r["k"], r["feature_idx"]): r["value"] for r in scale.impute_nearest(long, "k", 4, rows=16).collect()}
    for i, j in itertools.product(range(90), range(3)):
        want = x[i, j]
        if np.isnan(want):
            square = (x - x[i]) ** 2
            offers = sorted((np.nansum(square[b]) * 3 / n, b) for b in range(90) if b != i and (n := (~np.isnan(square[b])).sum()) and not np.isnan(x[b, j]))
            want = np.mean([x[b, j] for _, b in offers[:4]]) if offers else np.nanmean(x[:, j])
        assert math.isclose(got[i, j], want, abs_tol=1e-9)


def test_coefficients(spark):
    rows = [(m, t, n, n, (0.0 if t == "Right SLF" else 1.0) * (i * 10 + n)) for i, (m, t) in enumerate(itertools.product("ab", ("Left SLF", "Right SLF"))) for n in range(3)]
    df = spark.createDataFrame(rows, "metric string, tractID string, nodeID int, pos int, beta double")
    assert {r["tractID"] for r in features.coefficients_by_group(df, True).collect()} == {"Left SLF"}
    assert features.coefficients_by_metric(df, ["Right SLF", "Left SLF"]).where("metric = 'a'").first()["beta"] == [0, 0, 0, 0, 1, 2]
    record = features.label_records(df).first()["record"]
    assert record["symmetrized_tractID"] == "SLF" and "SLF" in features.label_sets(df).first()["labels"]


def _regression(spark, n=60, classes=False):
    random = np.random.default_rng(0)
    x = random.normal(size=(n, 6))
    y = x @ np.array([2.0, -1, 0, 0, 0, 0]) + 0.1 * random.normal(size=n)
    rows = [(i, [float(v) for v in x[i]], float(y[i] > 0) if classes else float(y[i])) for i in range(n)]
    return spark.createDataFrame(rows, "k int, x array<double>, y double"), x, y


def test_estimators(spark):
    df, x, y = _regression(spark)
    assert Ridge(0.01).fit(x, y).score(x, y) > 0.99
    sparse = SparseGroupRegressor(0.3, 0.5, [[0, 1], [2, 3], [4, 5]]).fit(x, y)
    assert np.all(sparse.coef_[2:] == 0) and sparse.coef_[0] > 1
    assert SparseGroupRegressor(100.0).fit(x, y).coef_.any() == False  # noqa: E712
    label = (y > 0).astype(int)
    for model in (Logistic(), SparseGroupClassifier(0.01), AdaBoost(n_estimators=20)):
        assert model.fit(x, label).score(x, label) > 0.9
        np.testing.assert_allclose(model.predict_proba(x).sum(1), 1)
    with pytest.raises(ValueError):
        make("oracle")


def test_bagging(spark):
    df, x, y = _regression(spark)
    one = bagging.Bagging("ridge", 1, bootstrap=False).fit(df, "x", "y", "k")
    plain = Ridge().fit(x, y).predict(x)
    got = {r["sample"]: r["prediction"] for r in one.predict(df, "x", "k").collect()}
    np.testing.assert_allclose([got[i] for i in range(len(x))], plain)
    whole = bagging.Bagging("ridge", 4, seed=3).fit(df, "x", "y", "k")
    grown = bagging.Bagging("ridge", 2, seed=3, warm_start=True).fit(df, "x", "y", "k")
    grown.n_estimators = 4
    grown.fit(df, "x", "y", "k")
    for (a, m), (b, n) in zip(whole.members, grown.members, strict=True):
        assert a.tolist() == b.tolist()
        np.testing.assert_allclose(m.coef_, n.coef_)
    labelled, _, _ = _regression(spark, classes=True)
    model = bagging.Bagging("logistic", 8, oob_score=True).fit(labelled, "x", "y", "k")
    assert abs(model.oob_score_ - model.score(labelled, "x", "y", "k")) < 0.15
    sums = model.predict_proba(labelled, "x", "k").groupBy("sample").agg(F.sum("value").alias("s")).collect()
    assert all(math.isclose(r["s"], 1) for r in sums)
    assert bagging.Bagging("ridge", 1, max_features=0.3).columns_of(0, 2).tolist() in ([0], [1])
    for bad in ({"max_features": 0}, {"bootstrap": False, "oob_score": True}, {"oob_score": True, "warm_start": True}):
        with pytest.raises(ValueError):
            bagging.Bagging("ridge", 2, **bad)
    with pytest.raises(ValueError):
        bagging.draws(df, 1, 1.5, key="k")
    with pytest.raises(AttributeError):
        bagging.Bagging("adaboost", 1).decision_function(df, "x", "k")


def test_cross_validation_is_kept(spark, tmp_path):
    df, x, y = _regression(spark)
    options = {"folds": 3, "scoring": ["r2", "neg_mean_squared_error"], "return_train_score": True, "workdir": str(tmp_path), "checkpoint": True}
    first = validation.cross_validate(df, "x", "y", "k", **options).collect()
    kept = sorted(p.name for p in tmp_path.iterdir())
    again = validation.cross_validate(df, "x", "y", "k", **options).collect()
    assert sorted(map(tuple, first)) == sorted(map(tuple, again)) and kept == sorted(p.name for p in tmp_path.iterdir())
    validation.cross_validate(df.withColumn("y", F.col("y") + 1), "x", "y", "k", **options)
    assert len(list(tmp_path.iterdir())) == len(kept) + 1
    test = np.arange(20)
    model = Ridge().fit(np.delete(x, test, 0), np.delete(y, test))
    assert math.isclose(next(r["value"] for r in first if r["fold"] == 0 and r["metric"] == "r2" and r["split"] == "test"), model.score(x[test], y[test]))
    with pytest.raises(ValueError):
        validation.cross_validate(df, "x", "y", "k", checkpoint=True)


def test_pipelines(spark):
    nodes, people = _labelled(spark)
    nodes = nodes.withColumn("subjectID", reshape.standard_id(F.col("subjectID")))
    d = ProfileDataset.build(nodes, people.withColumn("subject_id", reshape.standard_id(F.col("subject_id"))), ["age"], index_col="subject_id")
    p = make_pipeline("simple", "standard", estimator="ridge", target_func=np.log1p, target_inverse=np.expm1).fit(d)
    assert p.predict(d).count() == 3 and p.score(d) <= 1
    assert isinstance(make_pipeline(estimator="ridge", ensemble="Bagging").estimate, bagging.Bagging)
    assert isinstance(make_pipeline(estimator="logistic", ensemble="adaboost").estimate, Fitted)
    assert make_classifier_pipeline([[0, 1]], use_cv=False).estimate.kind == "classifier"
    for bad in ({"imputer": None}, {"imputer": "crystal"}, {"scaler": "big"}, {"scaler": 3}, {"feature_transformer": "magic"}, {"estimator": "oracle"}, {"estimator": "ridge", "ensemble": "choir"}, {"ensemble": "bagging"}, {"imputer": int}):
        with pytest.raises(ValueError):
            make_pipeline(**bad)


def test_store(spark, tmp_path):
    shared = np.arange(6.0).reshape(3, 2)
    data = {
        "n": 1, "big": 10**30, "f": 0.1, "c": 1 + 2j, "s": "é", "b": b"\x00\xff", "none": None, "yes": True, "list": [1, "a", (2, None)], "x": shared, "again": shared, "empty": np.zeros((0, 3)), "point": np.array(3.5),
        "u64": np.array([2**63], np.uint64), "text": np.array(["a", "bcd"]), "z": np.array([1j, 2]), "frame": pd.DataFrame({"a": [1, 2]}), "odd": store.Pickled({1: 2}), "many": list(range(300)), "half": np.float16(0.5), "squeezed": store.Compressed(np.ones(4), "gzip"),
        "coo": store.Coo([0, 1], [1, 0], [2.0, 3.0], (2, 2)), "deep": {"y": {"z": np.arange(4)}},
    }
    data["deep"]["self"] = data["deep"]["y"]
    path = str(tmp_path / "o")
    store.save(spark, path, data)
    back = store.load(spark, path)
    for k in ("n", "big", "f", "c", "s", "b", "none", "yes", "list", "many"):
        assert back[k] == data[k] and type(back[k]) is type(data[k])
    for k in ("x", "empty", "point", "u64", "text", "z", "squeezed"):
        want = np.ones(4) if k == "squeezed" else data[k]
        np.testing.assert_array_equal(back[k], want)
        assert back[k].dtype == want.dtype
    assert back["again"] is back["x"] and back["deep"]["self"] is back["deep"]["y"] and back["odd"] == {1: 2} and back["half"] == np.float16(0.5)
    assert back["coo"].shape == (2, 2) and back["coo"].value.tolist() == [2, 3]
    pd.testing.assert_frame_equal(back["frame"], data["frame"])
    assert store.load(spark, path, "/deep/y/z", sel=slice(1, 3)).tolist() == [1, 2]
    assert store.load(spark, path, ["n", "s"]) == (1, "é")
    with pytest.raises(ValueError):
        store.load(spark, path, "/deep/nothing")
    with pytest.raises(ValueError):
        store.load(spark, path, sel=slice(0, 1))
    store.save(spark, str(tmp_path / "p"), np.arange(5))
    assert store.load(spark, str(tmp_path / "p"), sel=slice(2, 4)).tolist() == [2, 3]


def test_stream(spark, tmp_path):
    from nodeloom.streaming.means import running_means

    spark.createDataFrame([("s", "T", "2024-01-01 00:10:00", 1.0), ("s", "T", "2024-01-01 00:50:00", 3.0), ("s", "T", "2024-01-01 01:10:00", 5.0)], "subjectID string, tractID string, ts string, v double").write.parquet(str(tmp_path / "in"))
    source = spark.readStream.schema("subjectID string, tractID string, ts string, v double").parquet(str(tmp_path / "in"))
    out = running_means(source, "v").writeStream.format("memory").queryName("means").outputMode("complete").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "c")).start()
    out.awaitTermination(120)
    assert sorted(r["mean"] for r in spark.table("means").collect()) == [2.0, 5.0]


def test_mapper_gives_others_its_features(spark):
    from nodeloom.plans.mapper import FeatureMapper

    nodes = _nodes(spark)
    mapper = FeatureMapper().fit(nodes)
    assert mapper.feature_names() == [("m", t, n) for t in "AB" for n in (0, 1, 3, 4, 5)]
    other = spark.createDataFrame([("x", "A", 0, 1.0), ("x", "A", 9, 7.0), ("x", "C", 0, 7.0), ("x", "A", 3, 2.0)], "subjectID string, tractID string, nodeID int, m double")
    out = mapper.transform(other).orderBy("feature_idx").collect()
    assert [r["value"] for r in out] == [1, 1.5, 2, None, None] + [None] * 5
    same = mapper.transform(nodes).select("subjectID", "feature_idx", "value")
    assert same.exceptAll(reshape.features_long(nodes).select("subjectID", "feature_idx", "value")).count() == 0
    assert FeatureMapper(bundles="mean").fit_transform(nodes).where("subjectID = 's3'").count() == 2


def test_grids_of_any_size_agree(spark, monkeypatch):
    nodes = _nodes(spark)
    small = reshape.features_long(nodes).collect()
    monkeypatch.setattr(reshape, "DIMENSION_LIMIT", 1)
    large = reshape.features_long(nodes).select(*small[0].asDict()).collect()
    assert sorted(map(str, small)) == sorted(map(str, large))


def test_group_components(spark):
    random = np.random.default_rng(4)
    x = random.normal(size=(60, 8)) @ random.normal(size=(8, 8))
    long = spark.createDataFrame([(k, j // 4, j, float(x[k, j])) for k in range(60) for j in range(8)], "k int, group_idx int, feature_idx int, value double").repartition(4)
    out = scale.group_components(long, "k", 2).toPandas()
    for g in range(2):
        part = x[:, 4 * g : 4 * g + 4]
        u, s, vt = np.linalg.svd(part - part.mean(0), full_matrices=False)
        sign = np.sign(vt[np.arange(4), np.abs(vt).argmax(1)])
        got = out[out.group_idx == g].pivot(index="k", columns="component", values="value").to_numpy()
        np.testing.assert_allclose(got, (u * s * sign)[:, :2], atol=1e-8)


def test_sites_are_harmonised(spark):
    random = np.random.default_rng(6)
    rows = [(f"s{i}", "ab"[i % 2], float(i % 5), j, float(random.normal() * (1 + i % 2) + 3 * (i % 2) + 0.5 * (i % 5) + j)) for i in range(80) for j in range(6)]
    df = spark.createDataFrame(rows, "subjectID string, site string, age double, feature_idx int, value double")
    out = scale.combat(df, "site", ["age"])
    assert out.count() == df.count()
    apart = lambda d: d.groupBy("feature_idx").agg(F.abs(F.avg(F.when(F.col("site") == "a", F.col("value"))) - F.avg(F.when(F.col("site") == "b", F.col("value")))).alias("x")).agg(F.max("x")).first()[0]
    spread = lambda d: [r["s"] for r in d.groupBy("site").agg(F.stddev("value").alias("s")).orderBy("site").collect()]
    assert apart(df) > 2 and apart(out) < 0.5
    before, after = spread(df), spread(out)
    assert after[1] / after[0] < before[1] / before[0]


def _people(spark, n=40):
    """Subjects whose target is a line through their first feature; some values are missing."""
    random = np.random.default_rng(8)
    x = random.normal(size=(n, 3)) * [1, 10, 0.1] + [0, 50, 1]
    nodes = [(f"s{i:02d}", t, 0, None if (i + j) % 7 == 0 else float(x[i, j])) for i in range(n) for j, t in enumerate("ABC")]
    people = [(f"s{i:02d}", float(2 * x[i, 0] + i)) for i in range(n)]
    return ProfileDataset.build(spark.createDataFrame(nodes, "subjectID string, tractID string, nodeID int, m double"), spark.createDataFrame(people, "subjectID string, y double"), ["y"])


@pytest.mark.parametrize("steps", [{}, {"imputer": "knn", "scaler": "minmax"}, {"scaler": "robust", "feature_transformer": True}])
def test_prediction_does_not_depend_on_the_rows_beside(spark, steps):
    d = _people(spark)
    p = make_pipeline(estimator="ridge", **steps).fit(d[:30])
    whole = {r["sample"]: r["prediction"] for r in p.predict(d).collect()}
    for part in (d[30:40], d[35]):
        got = {r["sample"]: r["prediction"] for r in p.predict(part).collect()}
        assert len(got) == len(part) and all(math.isclose(got[k], whole[k], rel_tol=1e-9) for k in got)
    with pytest.raises(ValueError):
        make_pipeline(estimator="ridge").predict(d)
    with pytest.raises(ValueError):
        p.unfitted()


def test_steps_are_fitted_where_they_are_told(spark):
    class Shift:
        def fit(self, features):
            self.by = features.agg(F.max("value")).first()[0]
            return self

        def transform(self, features):
            return features.withColumn("value", F.col("value") - self.by)

    d = _people(spark)
    p = make_pipeline(scaler=Shift, estimator="ridge")
    p.fit_steps(d[:30])
    top = d[:30].features.agg(F.max("value")).first()[0]
    assert p.scale.by == top
    moved = p.prepare(d[30:]).features.join(d[30:].features.select("subjectID", "feature_idx", F.col("value").alias("old")), ["subjectID", "feature_idx"]).where("old is not null")
    assert moved.where(F.abs(F.col("old") - top - F.col("value")) > 1e-12).count() == 0


def test_draws_agree(spark):
    from nodeloom.functions import hashrand

    df = spark.createDataFrame([(i, j) for i in range(5) for j in range(4)], "a int, b int")
    rows = df.select("a", "b", hashrand.uniform("x", 3, F.col("a"), F.col("b")).alias("u"), hashrand.normal("x", 3, F.col("a"), F.col("b")).alias("n"), hashrand.below(7, "x", 3, F.col("a"), F.col("b")).alias("k")).collect()
    for r in rows:
        d = hashrand.Draws("x", 3, r["a"])
        assert d.uniform(r["b"]) == r["u"] and math.isclose(d.normal(r["b"]), r["n"], abs_tol=1e-12) and d.below(7, r["b"]) == r["k"]
    grid = hashrand.Draws("x", 3).normals(5, 4)
    assert all(math.isclose(grid[r["a"], r["b"]], r["n"], abs_tol=1e-12) for r in rows)


def test_splines_give_cubics_back():
    from nodeloom.functions.series import spline_basis

    knots, at = np.array([0, 1.5, 2, 4, 7.5, 9]), np.linspace(0, 9, 40)
    f = lambda t: 1 - t + 0.3 * t**2 - 0.05 * t**3
    np.testing.assert_allclose(spline_basis(knots, at) @ f(knots), f(at), atol=1e-10)


def test_harmoniser_against_a_plain_fit(spark):
    """Pooled least squares and shrinkage feature by feature, with covariates, on dense arrays."""
    random = np.random.default_rng(9)
    n, p = 60, 5
    site, age = np.arange(n) % 3, random.normal(size=n)
    y = random.normal(size=(n, p)) * (1 + 0.5 * site[:, None]) + site[:, None] + age[:, None] * np.arange(p)
    df = spark.createDataFrame([(f"s{i}", f"c{site[i]}", float(age[i]), j, float(y[i, j])) for i in range(n) for j in range(p)], "subjectID string, site string, age double, feature_idx int, value double").repartition(3)
    got = {(r["subjectID"], r["feature_idx"]): r["value"] for r in scale.combat(df, "site", ["age"]).collect()}
    hot = np.eye(3)[site]
    design = np.hstack([hot, age[:, None]])
    beta = np.linalg.lstsq(design, y, rcond=None)[0]
    plain = hot.mean(0) @ beta[:3] + age[:, None] * beta[3]
    spread = np.sqrt(((y - design @ beta) ** 2).mean(0))
    z = (y - plain) / spread
    for k in range(3):
        part, m = z[site == k], int((site == k).sum())
        place, width = part.mean(0), part.var(0, ddof=1)
        mean, tau, mw, vw = place.mean(), place.var(ddof=1), width.mean(), width.var(ddof=1)
        gamma, delta = place, width
        for _ in range(300):
            gamma = (tau * m * place + delta * mean) / (tau * m + delta)
            delta = (0.5 * ((part - gamma) ** 2).sum(0) + (mw * vw + mw**3) / vw) / (m / 2 + (2 * vw + mw**2) / vw - 1)
        z[site == k] = (part - gamma) / np.sqrt(delta)
    want = z * spread + plain
    assert all(math.isclose(got[f"s{i}", j], want[i, j], abs_tol=1e-7) for i in range(n) for j in range(p))


def test_bootstrap_weights_are_poisson():
    w = np.stack([profiles.replicate_weights(f"s{i}", 501, 3) for i in range(200)])
    assert w.shape == (200, 501) and abs(w.mean() - 1) < 0.02 and abs(w.var() - 1) < 0.03
    np.testing.assert_array_equal(w[4], profiles.replicate_weights("s4", 501, 3))


def test_curves_through_gaps():
    from nodeloom.functions import series

    x = np.array([0.0, 1, 3, 4, 6, 7, 9])
    at = np.linspace(0, 9, 31)
    for order in (1, 2, 3, 4, 5):
        f = np.polynomial.Polynomial(np.arange(1, order + 2) / 10)
        np.testing.assert_allclose(series.polynomial_pieces(x, f(x), at, order), f(at), atol=1e-8)
    y = np.array([0.0, 1, 1, 5, 5.5, 9, 9])
    steep = series.hermite(x, y, series.monotone_slopes(x, y), at)
    assert (np.diff(steep) >= -1e-12).all() and steep.max() <= 9
    for slopes in (series.monotone_slopes, series.akima_slopes):
        np.testing.assert_allclose(series.hermite(x, 3 - 2 * x, slopes(x, 3 - 2 * x), at), 3 - 2 * at, atol=1e-9)
        np.testing.assert_allclose(series.hermite(x, y, slopes(x, y), x), y, atol=1e-9)
    gaps = np.array([np.nan, 1, np.nan, 4, np.nan, np.nan, 49, np.nan])
    np.testing.assert_allclose(series.fill_smooth(np.arange(8.0), gaps, "polynomial", 2)[1:7], np.polynomial.polynomial.polyval(np.arange(1, 7), np.polynomial.polynomial.polyfit([1, 3, 6], [1, 4, 49], 2)))
    for method in ("cubic", "quadratic", "pchip", "akima"):
        found = series.fill_smooth(np.arange(8.0), gaps, method)
        assert np.isnan(found[[0, 7]]).all() and not np.isnan(found[1:7]).any() and found[3] == 4


def test_filling_by_name(spark):
    nodes = _nodes(spark)
    full = reshape.grid(reshape.collapse(reshape.melt(nodes)))
    value = lambda how, **o: {(r["subjectID"], r["tractID"], r["nodeID"]): r["value"] for r in reshape.interpolate(full, how, **o).collect()}
    assert value("pad") == value("ffill") == value("zero") and value("backfill") == value("bfill") and value("slinear") == value("linear") and value("index") == value("values")
    number, place = value("index"), value("linear")
    assert (number["s1", "A", 1], place["s1", "A", 1]) == (2.0, 2.5)  # nodes 0 and 3 are one place from node 1
    near = value("linear", limit=1)
    assert near["s2", "A", 3] == 3.0 and near["s2", "A", 4] is None
    for how in ("pchip", "akima", "quadratic", "polynomial"):
        assert {k for k, v in value(how).items() if v is None} == {k for k, v in place.items() if v is None}
    with pytest.raises(ValueError):
        reshape.interpolate(full, "guess")


def test_aggregates_in_one_pass(spark):
    nodes = _nodes(spark)
    table = {(r["subjectID"], r["tractID"]): r for r in reshape.bundle_table(nodes, ["mean", "max", "count"]).collect()}
    for how in ("mean", "max", "count"):
        for r in reshape.bundle_aggregate(nodes, how).collect():
            assert table[r["subjectID"], r["tractID"]][how] == r["value"]


def test_display(spark):
    df = spark.createDataFrame([("dki_md", "Left Arcuate", 0.5), ("fa", "Left Arcuate", 0.5), ("fa", "HCC_L", 1.0), ("fa", "Right Cingulum Hippocampus", 1.0)], "metric string, tractID string, value double")
    assert sorted((r["metric"], r["value"]) for r in profiles.displayed(df).collect()) == [("dki_md", 500.0), ("fa", 0.5)]


def test_warping_against_all_paths():
    """The cheapest of all monotone paths, written out, for both slope constraints."""
    from nodeloom.functions import series

    random = np.random.default_rng(5)
    for slope, (p, s) in itertools.product(("symmetric", "asymmetric"), ((4, 5), (5, 4), (3, 3), (1, 4), (4, 1))):
        a, b = random.normal(size=(p, 2)), random.normal(size=(s, 2))
        cost = np.linalg.norm(a[:, None] - b[None], axis=2)

        def ways(i, j):
            for up, back in series.MOVES[slope]:
                if (i - up, j - back) == (-1, -1):  # a path begins with any move from before both
                    yield [(i, j)]
                elif i >= up and j >= back:
                    for w in ways(i - up, j - back):
                        yield [*w, (i, j)]

        sums = [sum(cost[c] for c in w) for w in ways(p - 1, s - 1)]
        distance, ps, ss = series.warp(a, b, slope)
        if not sums:
            assert distance == np.inf and len(ps) == 0
            continue
        assert math.isclose(distance, min(sums)) and math.isclose(sum(cost[i, j] for i, j in zip(ps, ss, strict=True)), distance)
        assert (ps[0], ps[-1], ss[-1]) == (0, p - 1, s - 1) and (ss[0] == 0 or slope == "asymmetric")


def test_fitting_from_sums(spark, monkeypatch):
    from nodeloom.plans import fitted

    df, x, y = _regression(spark)
    for name, options in (("ridge", {"alpha": 0.7}), ("lasso", {"alpha": 0.2}), ("sgl", {"alpha": 0.3, "l1_ratio": 0.5, "groups": [[0, 1], [2, 3], [4, 5]]})):
        sums = Fitted(name, **options).fit(df.repartition(5), "x", "y", "k").model_
        with monkeypatch.context() as m:
            m.setattr(fitted, "SUMMED", 2)
            rows = Fitted(name, **options).fit(df, "x", "y", "k").model_
        np.testing.assert_allclose(sums.coef_, rows.coef_, atol=1e-6)
        assert math.isclose(sums.intercept_, rows.intercept_, abs_tol=1e-6)


def test_the_package_as_an_archive(tmp_path):
    """Importable without the repository, as on the workers of a cluster."""
    from nodeloom import shipping

    (tmp_path / "nodeloom.zip").write_bytes(shipping.archive())
    code = "import nodeloom.operators.reshape, nodeloom.plans.pipeline, sys; assert 'nodeloom.zip' in nodeloom.__file__"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, env={**os.environ, "PYTHONPATH": str(tmp_path / "nodeloom.zip")}, check=True, timeout=120)


def test_neighbours_in_boxes(spark):
    """Boxes of few offers, ties on whole numbers, and another table that is searched, which holds rows of the same keys."""
    random = np.random.default_rng(11)
    x = np.column_stack((random.normal(size=400), random.integers(0, 4, 400), random.integers(0, 5, 400)))
    x[random.random(x.shape) < 0.2] = np.nan
    long = lambda rows: spark.createDataFrame([(i, j, None if np.isnan(v) else float(v)) for i, row in rows for j, v in enumerate(row)], "k int, feature_idx int, value double")
    y = np.where(np.isnan(x), random.integers(0, 3, x.shape), x)[:300]
    for among, offers in ((None, x), (long(enumerate(y)), y)):
        got = {(r["k"], r["feature_idx"]): r["value"] for r in scale.impute_nearest(long(enumerate(x)), "k", 3, rows=16, among=among).collect()}
        for i, j in itertools.product(range(400), range(3)):
            want = x[i, j]
            if np.isnan(want):
                square = (offers - x[i]) ** 2
                near = sorted((np.nansum(square[b]) * 3 / n, b) for b in range(len(offers)) if b != i and (n := (~np.isnan(square[b])).sum()) and not np.isnan(offers[b, j]))
                want = np.mean([offers[b, j] for _, b in near[:3]]) if near else np.nanmean(offers[:, j])
            assert math.isclose(got[i, j], want, abs_tol=1e-9)


def test_neighbours_are_not_compared_with_all_rows(spark, monkeypatch):
    """The distances that are taken grow with the rows, not with their square."""
    from nodeloom.operators import nearest

    counted, plain = spark.sparkContext.accumulator(0), nearest.closest

    def closest(z, y, *rest):
        counted.add(len(z) * len(y))
        return plain(z, y, *rest)

    monkeypatch.setattr(nearest, "closest", closest)
    taken = []
    for n in (2_000, 4_000):
        random, before = np.random.default_rng(n), counted.value
        rows = [(i, j, None if j == 2 and i % 4 == 0 else float(v)) for i, row in enumerate(random.random((n, 3))) for j, v in enumerate(row)]
        scale.impute_nearest(spark.createDataFrame(rows, "k int, feature_idx int, value double"), "k", 3, rows=64).count()
        taken.append(counted.value - before)
    assert 0 < taken[0] < 2_000 * 500 / 4 and taken[1] < 3 * taken[0]


def test_assignment_on_a_line():
    random = np.random.default_rng(3)
    for n, m in [*random.integers(1, 12, (300, 2)).tolist(), (60, 200), (200, 60)]:
        a, b = (random.integers(0, 20, k).astype(float) if n % 2 else random.random(k) for k in (n, m))
        cost = np.abs(np.subtract.outer(a, b))
        r, c = match.assign_on_line(a, b)
        assert len(set(r.tolist())) == len(set(c.tolist())) == min(n, m)
        assert math.isclose(cost[r, c].sum(), cost[match.assign(cost)].sum(), abs_tol=1e-9)


def test_large_blocks_on_a_line_are_matched(spark):
    """16,000 by 4,000 units of one block have more pairs than a matrix may have."""
    df = spark.range(20_000).select("id", (F.col("id") % 5 == 0).alias("status"), F.sqrt("id").alias("f"), F.lit(1.0).alias("g"), F.lit(0).alias("b"))
    both = df.withColumn("g", F.col("b") + (F.col("id") % 2)).where("id < 100").withColumn("b", F.lit(1)).withColumn("id", F.col("id") + 20_000)
    out = match.mahalanobis_match(df.unionByName(both), "status", "id", ["f", "g"], 100.0, "b").where("b = 0")
    assert out.count() == 8_000 and out.select("id").distinct().count() == 8_000


def test_pairs_within_a_distance(spark, monkeypatch):
    """The near pairs are those of all pairs, for features that hang together, and all pairs are made in pieces."""
    random = np.random.default_rng(8)
    x = random.normal(size=(300, 3)) @ np.array([[2.0, 1.0, 0.0], [0.0, 0.5, 0.3], [0.0, 0.0, 0.1]])
    df = spark.createDataFrame([(i, i % 3 == 0, *map(float, v)) for i, v in enumerate(x)], "k int, status boolean, a double, b double, c double")
    test, control = match.split_by_status(df, "status")
    names = ["a", "b", "c"]
    inverse = match.precision(df, names)
    want = {(i, j): math.sqrt(max((x[i] - x[j]) @ inverse @ (x[i] - x[j]), 0)) for i in range(0, 300, 3) for j in range(300) if j % 3}
    every = match.pair_distances(test, control, names, inverse, "k")
    got = {(r["test_id"], r["ctrl_id"]): r["dist"] for r in every.collect()}
    assert got.keys() == want.keys() and all(math.isclose(got[p], want[p], abs_tol=1e-9) for p in want) and every.rdd.getNumPartitions() > 1
    for within in (0.4, 1.5):
        near = match.pair_distances(test, control, names, inverse, "k", within)
        assert {(r["test_id"], r["ctrl_id"]) for r in near.collect()} == {p for p, d in want.items() if d <= within}
        assert "NestedLoop" not in near._jdf.queryExecution().toString() and "Cartesian" not in near._jdf.queryExecution().toString()


def test_places_in_an_order(spark):
    from nodeloom.operators.ranks import numbered

    df = spark.range(1_000).select((F.col("id") % 3).alias("g"), F.when(F.col("id") % 50 != 7, (F.col("id") * 7 % 500).cast("string")).alias("k"), "id")
    got = numbered(df, ["k", "id"], ["g"], rows=100)
    plain = df.withColumn("w", F.expr("row_number() over (partition by g order by k, id) - 1")).withColumn("t", F.expr("count(*) over (partition by g)"))
    assert got.select("g", "k", "id", "__i", "__n").exceptAll(plain).count() == 0 and got.count() == 1_000


def test_members_fit_from_sums_and_from_files(spark, monkeypatch):
    """Bags of linear models equal those of rows, and rows that are read from a file give the same as rows in memory."""
    from nodeloom.plans import spilled
    from nodeloom.plans.estimators import Logistic, Ridge

    random = np.random.default_rng(6)
    x = random.normal(5, 1, size=(300, 3))
    y = x @ np.array([1.0, -2.0, 0.5]) + random.normal(size=300)
    df = spark.createDataFrame([(f"s{i:03d}", v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "k string, x array<double>, y double")
    drawn = bagging.draws(df, 3, 0.7, seed=5, key="k")
    bag = bagging.Bagging("ridge", 3, 0.7, 0.7, seed=5).fit(df, "x", "y", "k")
    for e, (columns, model) in enumerate(bag.members):
        rows = drawn.where(F.col("estimator") == e).orderBy("k").collect()
        assert sum(r["weight"] for r in rows) == 210
        plain = Ridge().fit(np.array([r["x"] for r in rows])[:, columns], np.array([r["y"] for r in rows]), np.array([r["weight"] for r in rows]))
        np.testing.assert_allclose(model.coef_, plain.coef_, atol=1e-9)
        np.testing.assert_allclose(model.intercept_, plain.intercept_, atol=1e-8)
    monkeypatch.setattr(spilled, "KEPT_BYTES", 2_000)
    monkeypatch.setattr(spilled, "BLOCK_ROWS", 64)
    file = spilled.Spilled(3)
    for i in range(0, 300, 50):
        file.append(x[i : i + 50])
    assert file._file is not None and (np.asarray(file) == x).all() and len(list(file.blocks())) == 5
    label, weight = (y > y.mean()).astype(int), random.integers(1, 4, 300).astype(float)
    np.testing.assert_allclose(Logistic().fit(file, label, weight).coef_, Logistic().fit(x, label, weight).coef_, atol=1e-9)


def test_draws_stand_in_no_single_row(spark):
    """Slots are dealt over the rows; no task makes a list as long as the table, and none ranks all of it."""
    df = spark.range(120_000).select(F.col("id").cast("string").alias("k"))
    plan = bagging.draws(df, 2, key="k")._jdf.queryExecution().optimizedPlan().toString()
    assert "sequence(1" not in plan and "__bucket" in plan


def test_correction_of_many_tests_is_no_square(spark):
    """No frame runs to the end of its part; ties, nulls and parts come out as by the rule."""
    df = spark.createDataFrame([(i % 3, i, None if i % 40 == 5 else (i * 37 % 100) / 100) for i in range(300)], "g int, i int, p double")
    out = profiles.false_discovery(df, by=["g"])
    assert "unboundedfollowing" not in out._jdf.queryExecution().optimizedPlan().toString().lower().replace("unboundedpreceding$(), unboundedfollowing", "")
    got = {r["i"]: r["q"] for r in out.collect()}
    rows = df.collect()
    for r in rows:
        mine = [t["p"] for t in rows if t["g"] == r["g"] and t["p"] is not None]
        if r["p"] is not None:
            assert math.isclose(got[r["i"]], min(1.0, min(v * len(mine) / sum(u <= v for u in mine) for v in mine if v >= r["p"])))


def test_many_alignments_at_once(monkeypatch):
    """Pairs of any lengths and windows align as one by one, and a batch of samples is aligned in a few calls."""
    random = np.random.default_rng(9)
    pairs = [(random.integers(0, 3, (random.integers(1, 9), 2)).astype(float), random.random((random.integers(1, 9), 2)), (None, 1, 3)[i % 3]) for i in range(90)]
    for slope, shape in itertools.product(("symmetric", "asymmetric"), (False, True)):
        for (a, b, window), (distance, p, q) in zip(pairs, series.warps(pairs, slope, shape), strict=True):
            one = series.warp(a, b, slope, window, shape)
            assert one[0] == distance and one[1].tolist() == p.tolist() and one[2].tolist() == q.tolist()
            if len(p):
                steps = set(zip(np.diff(p).tolist(), np.diff(q).tolist(), strict=True))
                assert steps <= set(series.MOVES[slope]) and (p[-1], q[-1]) == (len(a) - 1, len(b) - 1)
    calls, plain = [], augment.warps
    monkeypatch.setattr(augment, "warps", lambda *rest, **more: calls.append(len(rest[0])) or plain(*rest, **more))

    def change(own):
        ((distance, _, _),) = yield [(own, own, None)], False
        ((_, p, _),) = yield [(own, own, None)], True
        return distance, len(p)

    found = augment._aligned([change(a) for a, _, _ in pairs] + ["as it is"], "symmetric", False)
    assert found == [(0.0, len(a)) for a, _, _ in pairs] + ["as it is"] and sum(calls) == 180 and len(calls) == 4


def test_penalty_path_from_sums(spark, monkeypatch):
    """Scores and zeros from sums of folds are those of rows, and the table never meets in one task."""
    from nodeloom.plans import sgl

    random = np.random.default_rng(12)
    x = random.normal(3, 1, size=(90, 4))
    y = x @ np.array([1.0, 0.0, -1.0, 0.0]) + random.normal(size=90)
    df = spark.createDataFrame([(i, v.tolist(), float(t)) for i, (v, t) in enumerate(zip(x, y, strict=True))], "k int, x array<double>, y double").repartition(4)
    path = lambda: sgl.path(df, "x", "y", "k", [[0, 1], [2, 3]], [0.3, 0.05], [0.5, 1.0], 3)
    scores = lambda found: {(r["alpha"], r["l1_ratio"], r["fold"]): (r["score"], r["n_nonzero"]) for r in found.collect()}
    assert "FlatMapGroups" not in path()._jdf.queryExecution().toString()
    got = scores(path())
    monkeypatch.setattr(sgl, "SUMMED", 0)
    want = scores(path())
    assert len(got) == 12 and got.keys() == want.keys()
    assert all(math.isclose(got[s][0], want[s][0], abs_tol=1e-5) and got[s][1] == want[s][1] for s in want)


def test_gaps_are_filled_by_growing_frames(spark):
    """No frame runs to the end of its series, and a limit needs no join; values beyond the limit stay out."""
    full = spark.createDataFrame([("s", "t", "m", 2 * i, i, v) for i, v in enumerate([None, 1.0, None, None, 4.0, None])], "subjectID string, tractID string, metric string, nodeID int, pos int, value double")
    for limit, want in ((None, [None, 1, 2, 3, 4, None]), (1, [None, 1, 2, None, 4, None])):
        out = reshape.interpolate(full, "index", limit=limit)
        plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
        assert "unboundedfollowing" not in plan and "join" not in plan
        assert [r["value"] for r in out.orderBy("pos").collect()] == want


def test_replicates_of_many_small_products(spark, monkeypatch):
    """Intervals from tasks' sums, cut into small products and given away early, are those of the weights."""
    monkeypatch.setattr(profiles, "CELLS", 20)
    monkeypatch.setattr(profiles, "HELD_GROUPS", 2)
    monkeypatch.setattr(profiles, "KEPT_SUBJECTS", 3)
    rows = [(f"s{i}", "m", "T", n, float((i * 7 + n) % 11)) for i in range(40) for n in range(5)]
    df = spark.createDataFrame(rows, "subjectID string, metric string, tractID string, nodeID int, value double").repartition(3)
    out = profiles.profiles_with_intervals(df, df.select("subjectID", F.lit("all").alias("hue")).distinct(), 60).collect()
    weights = {s: profiles.replicate_weights(s, 60) for s in {r[0] for r in rows}}
    assert len(out) == 5
    for r in out:
        mine = [(weights[s], v) for s, _, _, n, v in rows if n == r["nodeID"]]
        means = sum(w * v for w, v in mine) / sum(w for w, _ in mine)
        assert r["n"] == 40 and math.isclose(r["low"], np.percentile(means, 2.5)) and math.isclose(r["high"], np.percentile(means, 97.5))

"""Registered queries of the profile operators on the star-schema tables, and the same in SQL.

``events`` is the node table: user is the subject, event type the tract, hour the node, ``value`` and
``k`` the metrics. ``customer`` is the subject table, ``embeddings`` a table of 64 features or of
sequences of 8 channels by 8 steps.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from nodeloom.functions import hashrand
from nodeloom.functions.series import spline_basis
from nodeloom.operators import augment, features, match, profiles, reshape, scale, targets
from nodeloom.plans import bagging, sgl, validation
from nodeloom.registry import ORACLE_SQL, QUERIES, query
from nodeloom.sources.tables import NODE, SESSION, SUBJECT, TRACT

def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def nodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    k = F.get_json_object("props", "$.k").cast("double")
    return e.select(F.col("user_id").cast("string").alias(SUBJECT), F.col("event_type").alias(TRACT), F.hour("ts").alias(NODE), "value", k.alias("k"))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "customer").withColumn(SUBJECT, F.col("c_custkey").cast("string"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(subjectID, label, feature_idx, value)"""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("vec_id").alias(SUBJECT), "label", F.posexplode("embedding").alias("feature_idx", "v")).select(SUBJECT, "label", "feature_idx", F.col("v").cast("double").alias("value"))


def sequences(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = vectors(spark, sf_dir)
    return v.select(F.col(SUBJECT).alias("sample_id"), "label", F.expr("feature_idx div 8").cast("int").alias("channel"), (F.col("feature_idx") % 8).alias("step"), "value")


def r(column, digits: int = 6):
    return F.round(column, digits) + F.lit(0.0)


def filled(spark: SparkSession, sf_dir: str, metrics=("value", "k")) -> DataFrame:
    return reshape.features_long(nodes(spark, sf_dir), list(metrics))


NODES = """nodes AS (SELECT CAST(user_id AS VARCHAR) AS s, event_type AS t, CAST(hour(ts) AS INTEGER) AS n, value, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events)"""
CELLS = f"""{NODES}, long AS (SELECT s, t, n, 'value' AS m, value AS v FROM nodes UNION ALL SELECT s, t, n, 'k', k FROM nodes),
cells AS (SELECT s, t, m, n, avg(v) AS v FROM long WHERE v IS NOT NULL GROUP BY ALL)"""
GRID = f"""{CELLS}, pos AS (SELECT n, CAST(row_number() OVER (ORDER BY n) - 1 AS INTEGER) AS pos FROM (SELECT DISTINCT n FROM cells)),
grp AS (SELECT m, t, row_number() OVER (ORDER BY m, t) - 1 AS g FROM (SELECT DISTINCT m FROM cells) CROSS JOIN (SELECT DISTINCT t FROM cells)),
dim AS (SELECT m, t, n, pos, g, g * (SELECT count(*) FROM pos) + pos AS f FROM grp CROSS JOIN pos),
full_grid AS (SELECT s, m, t, n, pos, g, f, v FROM (SELECT DISTINCT s FROM cells) CROSS JOIN dim LEFT JOIN cells USING (s, m, t, n))"""
FILLED = f"""{GRID}, around AS (SELECT *,
 last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER l AS p0, last_value(v IGNORE NULLS) OVER l AS v0,
 first_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER u AS p1, first_value(v IGNORE NULLS) OVER u AS v1 FROM full_grid
 WINDOW l AS (PARTITION BY s, t, m ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY s, t, m ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
filled AS (SELECT s, m, t, n, pos, g, f, coalesce(v, CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL AND p1 <> p0 THEN v0 + (v1 - v0) * (pos - p0) / (p1 - p0) END) AS v, p0, p1, v0, v1 FROM around)"""
VECTORS = """vec AS (SELECT vec_id AS s, label, CAST(i - 1 AS INTEGER) AS f, CAST(embedding[i] AS DOUBLE) AS v FROM (SELECT vec_id, label, embedding, unnest(range(1, len(embedding) + 1)) AS i FROM embeddings))"""
SEQS = f"""{VECTORS}, seq AS (SELECT s AS sample_id, label, f // 8 AS channel, f % 8 AS step, v AS value FROM vec)"""


# Ingest, reshaping and gap filling.


@query(f"WITH {FILLED} SELECT s AS \"subjectID\", m AS metric, t AS \"tractID\", n AS \"nodeID\", CAST(f AS INTEGER) AS feature_idx, round(v, 6) + 0.0 AS value FROM filled")
def interpolated_profile(spark, sf_dir):
    return filled(spark, sf_dir).select(SUBJECT, "metric", TRACT, NODE, "feature_idx", r("value").alias("value"))


@query(f"""WITH {FILLED} SELECT s AS "subjectID", m AS metric, t AS "tractID", n AS "nodeID",
 round(coalesce(v0x, v), 6) + 0.0 AS nearest, round(coalesce(v0y, v), 6) + 0.0 AS ffill, round(coalesce(v0z, v), 6) + 0.0 AS bfill
 FROM (SELECT *, CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN CASE WHEN pos - p0 <= p1 - pos THEN v0 ELSE v1 END END AS v0x,
 CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN v0 END AS v0y, CASE WHEN p0 IS NOT NULL AND p1 IS NOT NULL THEN v1 END AS v0z FROM filled)""")
def interpolated_otherwise(spark, sf_dir):
    full = reshape.grid(reshape.collapse(reshape.melt(nodes(spark, sf_dir))))
    keys = [SUBJECT, "metric", TRACT, NODE]
    out = full.select(*keys)
    for how in ("nearest", "ffill", "bfill"):
        out = out.join(reshape.interpolate(full, how).select(*keys, r("value").alias(how)), keys)
    return out


@query(f"""WITH {GRID}, around AS (SELECT *, last_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER l AS n0, last_value(CASE WHEN v IS NOT NULL THEN pos END IGNORE NULLS) OVER l AS p0, last_value(v IGNORE NULLS) OVER l AS v0,
 first_value(CASE WHEN v IS NOT NULL THEN n END IGNORE NULLS) OVER u AS n1, first_value(v IGNORE NULLS) OVER u AS v1 FROM full_grid
 WINDOW l AS (PARTITION BY s, t, m ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), u AS (PARTITION BY s, t, m ORDER BY pos ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
 li AS (SELECT *, coalesce(v, CASE WHEN n1 > n0 THEN v0 + (v1 - v0) * (n - n0) / (n1 - n0) END) AS w FROM around)
 SELECT s AS "subjectID", m AS metric, t AS "tractID", n AS "nodeID", round(w, 6) + 0.0 AS by_number, round(CASE WHEN pos - p0 <= 1 THEN w END, 6) + 0.0 AS near FROM li""")
def interpolated_by_number(spark, sf_dir):
    """Lines by the nodes' numbers, whole and at most one place from the value before."""
    full = reshape.grid(reshape.collapse(reshape.melt(nodes(spark, sf_dir))))
    found = reshape.interpolate(full.withColumn("far", reshape.since()), "index")
    return found.select(SUBJECT, "metric", TRACT, NODE, r("value").alias("by_number"), r(F.when(F.col("far") <= 1, F.col("value"))).alias("near"))


@query()
def interpolated_cubic(spark, sf_dir):
    return reshape.features_long(nodes(spark, sf_dir), ["value", "k"], method="cubic").select(SUBJECT, "metric", TRACT, NODE, "value")


@query(f"""WITH {NODES} SELECT s || CAST(n % 2 AS VARCHAR) AS "subjectID", t AS "tractID", n AS "nodeID", 'value' AS metric, round(avg(value), 6) + 0.0 AS value FROM nodes WHERE value IS NOT NULL GROUP BY ALL""")
def session_cells(spark, sf_dir):
    n = nodes(spark, sf_dir).withColumn(SESSION, F.col(NODE) % 2)
    cells = reshape.collapse(reshape.melt(reshape.with_sessions(n, True), ["value"]))
    return cells.select(SUBJECT, TRACT, NODE, "metric", r("value").alias("value"))


@query(f"""WITH {NODES}, long AS (SELECT s, t, 'value' AS m, value AS v FROM nodes UNION ALL SELECT s, t, 'k', k FROM nodes)
 SELECT s AS "subjectID", t AS "tractID", m AS metric, round(avg(v), 6) + 0.0 AS mean, round(median(v), 6) + 0.0 AS median, max(v) AS max, count(v)::DOUBLE AS count FROM long GROUP BY ALL""")
def bundle_aggregates(spark, sf_dir):
    found = reshape.bundle_table(nodes(spark, sf_dir), ["mean", "median", "max", "count"])
    return found.select(SUBJECT, TRACT, "metric", r("mean").alias("mean"), r("median").alias("median"), "max", "count")


@query(f"""WITH {FILLED} SELECT s AS "subjectID", CAST(g AS INTEGER) AS group_idx, m AS metric, t AS "tractID", round(avg(v), 9) + 0.0 AS value FROM filled GROUP BY ALL""")
def bundle_means(spark, sf_dir):
    return reshape.bundle_means(filled(spark, sf_dir)).withColumn("value", r("value", 9))


@query(f"""WITH {GRID} SELECT m AS metric, t AS "tractID", n AS "nodeID", pos, CAST(g AS INTEGER) AS group_idx, CAST(f AS INTEGER) AS feature_idx FROM dim""")
def feature_dimension(spark, sf_dir):
    return reshape.feature_dim(reshape.collapse(reshape.melt(nodes(spark, sf_dir))))


@query(f"""WITH {NODES}, bd AS (SELECT DISTINCT m, t FROM (SELECT t, unnest(['value', 'k']) AS m FROM nodes)) SELECT m AS metric, t AS "tractID", CAST(row_number() OVER (ORDER BY m <> 'value', t) - 1 AS INTEGER) AS feature_idx FROM bd""")
def bundle_order(spark, sf_dir):
    """The features of aggregated bundles: metrics in the order asked for, tracts sorted."""
    metrics = ["value", "k"]
    return reshape.bundle_dim(reshape.bundle_aggregate(nodes(spark, sf_dir), "mean", metrics), metrics)


@query(f"""WITH {VECTORS} SELECT s AS "subjectID", f // 8 AS channel, f % 8 AS step, round(v, 6) + 0.0 AS value FROM vec""")
def channels(spark, sf_dir):
    return reshape.channels(vectors(spark, sf_dir), 8, 8).withColumn("value", r("value"))


@query("""SELECT vec_id AS "subjectID", len(embedding) AS n, round(embedding[10]::DOUBLE, 6) + 0.0 AS c1s1, round(embedding[64]::DOUBLE, 6) + 0.0 AS c7s7 FROM embeddings""")
def tensor_layout(spark, sf_dir):
    m = reshape.matrix(vectors(spark, sf_dir))
    first, last = reshape.tensors(m, 8, 8, False), reshape.tensors(m, 8, 8, True).withColumnRenamed("x", "y")
    both = m.select(SUBJECT, F.size("x").cast("long").alias("n")).join(first, SUBJECT).join(last, SUBJECT)
    return both.select(SUBJECT, "n", r(F.expr("x[1][1]")).alias("c1s1"), r(F.expr("y[7][7]")).alias("c7s7"))


@query("""SELECT c_custkey, CASE WHEN starts_with(c_name, 'sub-') THEN c_name ELSE 'sub-' || c_name END AS name, CASE WHEN starts_with(k, 'sub-') THEN k ELSE 'sub-' || k END AS key
 FROM (SELECT *, CASE WHEN c_custkey % 2 = 0 THEN 'sub-' || c_custkey ELSE c_custkey::VARCHAR END AS k FROM customer)""")
def standard_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    key = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("sub-"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string"))
    return c.select("c_custkey", reshape.standard_id(F.col("c_name")).alias("name"), reshape.standard_id(key).alias("key"))


# Targets.

_TARGETS = """subj AS (SELECT DISTINCT CAST(user_id AS VARCHAR) AS s FROM events), attr AS (SELECT CAST(c_custkey AS VARCHAR) AS s, c_mktsegment, c_acctbal FROM customer WHERE c_custkey % 3 <> 0),
 tg AS (SELECT s, c_mktsegment, c_acctbal FROM subj LEFT JOIN attr USING (s)), cls AS (SELECT l, row_number() OVER (ORDER BY l) - 1 AS code FROM (SELECT DISTINCT coalesce(c_mktsegment, 'NaN') AS l FROM tg))"""


def _targets(spark, sf_dir):
    wanted = customers(spark, sf_dir).where("c_custkey % 3 <> 0")
    return targets.join_targets(nodes(spark, sf_dir), wanted, ["c_mktsegment", "c_acctbal"])


@query(f"""WITH {_TARGETS} SELECT s AS "subjectID", c_mktsegment, c_acctbal, CAST(code AS INTEGER) AS c_mktsegment_code FROM tg JOIN cls ON l = coalesce(c_mktsegment, 'NaN')""")
def encoded_targets(spark, sf_dir):
    return targets.encode(_targets(spark, sf_dir), ["c_mktsegment"])[0]


@query(f"WITH {_TARGETS} SELECT l AS label, CAST(code AS INTEGER) AS code FROM cls")
def label_classes(spark, sf_dir):
    return targets.encode(_targets(spark, sf_dir), ["c_mktsegment"])[1]["c_mktsegment"]


@query(f"""WITH {_TARGETS} SELECT s AS "subjectID", c_mktsegment, c_acctbal FROM tg WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL""")
def complete_targets(spark, sf_dir):
    return targets.drop_missing(_targets(spark, sf_dir), ["c_mktsegment", "c_acctbal"])


@query(f"""WITH {_TARGETS}, {FILLED} SELECT s AS "subjectID", count(*) AS n, round(sum(v), 4) + 0.0 AS total FROM filled SEMI JOIN (SELECT s FROM tg WHERE c_mktsegment IS NOT NULL) USING (s) GROUP BY s""")
def dataset_without_missing(spark, sf_dir):
    from nodeloom.plans.dataset import ProfileDataset

    d = ProfileDataset.build(nodes(spark, sf_dir), customers(spark, sf_dir).where("c_custkey % 3 <> 0"), ["c_mktsegment"], ["c_mktsegment"])
    return d.drop_target_na().features.groupBy(SUBJECT).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("total"))


@query("""WITH o AS (SELECT s, row_number() OVER (ORDER BY s) - 1 AS i FROM (SELECT DISTINCT CAST(user_id AS VARCHAR) AS s FROM events WHERE value IS NOT NULL)) SELECT s AS "subjectID", CAST(i AS INTEGER) AS row_idx FROM o WHERE i >= 2 AND i < 9""")
def dataset_rows(spark, sf_dir):
    from nodeloom.plans.dataset import ProfileDataset

    return ProfileDataset.build(nodes(spark, sf_dir), metrics=["value"])[2:9].subjects


# Names and coefficients.

_SYM = "trim(replace(replace(t, 'Left', ''), 'Right', ''))"
_NAMED = f"""{GRID}, named AS (SELECT m, CASE WHEN t < 'm' THEN 'Left ' || t ELSE 'Right ' || t END AS t, n, pos, g, f FROM dim)"""


def _named(spark, sf_dir):
    d = reshape.feature_dim(reshape.collapse(reshape.melt(nodes(spark, sf_dir))))
    return d.withColumn(TRACT, F.when(F.col(TRACT) < "m", F.concat(F.lit("Left "), TRACT)).otherwise(F.concat(F.lit("Right "), TRACT)))


@query(f"""WITH {_NAMED} SELECT CAST(f AS INTEGER) AS feature_idx, array_to_string(list_sort(list_distinct([m, t, n::VARCHAR, {_SYM}])), '|') AS labels FROM named""")
def label_sets(spark, sf_dir):
    return features.label_sets(_named(spark, sf_dir)).select("feature_idx", F.concat_ws("|", F.array_sort("labels")).alias("labels"))


@query(f"""WITH {_NAMED} SELECT CAST(f AS INTEGER) AS feature_idx, m AS metric, t AS "tractID", n::VARCHAR AS "nodeID", {_SYM} AS "symmetrized_tractID" FROM named""")
def label_records(spark, sf_dir):
    return features.label_records(_named(spark, sf_dir)).select("feature_idx", "record.*")


@query(f"""WITH {_NAMED} SELECT CAST(row_number() OVER (ORDER BY x) - 1 AS INTEGER) AS group_idx, m AS metric, t AS "tractID" FROM (SELECT m, t, min(f) AS x FROM named GROUP BY m, t)""")
def group_names(spark, sf_dir):
    return features.group_names(_named(spark, sf_dir))


@query(f"""WITH {_NAMED} SELECT CAST(f AS INTEGER) AS feature_idx, m AS metric, t AS "tractID" FROM named WHERE m = 'value' AND t LIKE 'Left%'""")
def selected_features(spark, sf_dir):
    return features.select_like(features.select_groups(_named(spark, sf_dir), "value"), "Left").select("feature_idx", "metric", TRACT)


@query("""SELECT p_partkey AS feature_idx, round(p_retailprice - a, 4) + 0.0 AS score, CAST(row_number() OVER (ORDER BY abs(round(p_retailprice - a, 4)) DESC, p_partkey) - 1 AS INTEGER) AS place FROM part, (SELECT round(avg(p_retailprice), 4) AS a FROM part)""")
def sorted_features(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    mean = p.agg(F.round(F.avg("p_retailprice"), 4).alias("a"))
    return features.sort_features(p.join(mean).select(F.col("p_partkey").alias("feature_idx"), r(F.col("p_retailprice") - F.col("a"), 4).alias("score")))


_BETA = f"CASE WHEN m = 'k' AND t LIKE '%c%' THEN 0 ELSE round({hashrand.uniform_sql(chr(39) + 'beta' + chr(39), 'CAST(f AS INTEGER)')} - 0.5, 6) END"


def _coefficients(spark, sf_dir):
    d = reshape.feature_dim(reshape.collapse(reshape.melt(nodes(spark, sf_dir))))
    zero = (F.col("metric") == "k") & F.col(TRACT).contains("c")
    return d.withColumn("beta", F.when(zero, 0.0).otherwise(F.round(hashrand.uniform("beta", F.col("feature_idx")) - 0.5, 6)))


@query(f"""WITH {GRID}, c AS (SELECT *, {_BETA} AS b FROM dim) SELECT t AS "tractID", m AS metric, array_to_string(list(round(b, 4)::DECIMAL(10,4)::VARCHAR ORDER BY pos), ' ') AS beta FROM c GROUP BY t, m HAVING max(abs(b)) > 0""")
def coefficients_by_group(spark, sf_dir):
    text = lambda c: F.concat_ws(" ", F.transform(c, lambda x: F.round(x, 4).cast("decimal(10,4)").cast("string")))
    return features.coefficients_by_group(_coefficients(spark, sf_dir), True).withColumn("beta", text("beta"))


@query(f"""WITH {GRID}, c AS (SELECT *, {_BETA} AS b FROM dim) SELECT m AS metric, array_to_string(list(round(b, 4)::DECIMAL(10,4)::VARCHAR ORDER BY t, pos), ' ') AS beta FROM c GROUP BY m""")
def coefficients_by_metric(spark, sf_dir):
    text = lambda c: F.concat_ws(" ", F.transform(c, lambda x: F.round(x, 4).cast("decimal(10,4)").cast("string")))
    return features.coefficients_by_metric(_coefficients(spark, sf_dir)).withColumn("beta", text("beta"))


@query("""WITH codes AS (SELECT unnest(['LeftArcuate', 'CallosumForcepsMinor', 'RightSLF']) AS name, unnest(['ARC_L', 'FA', 'SLF_R']) AS code), t AS (SELECT p_partkey, ['Left Arcuate', 'CallosumForcepsMinor', 'Right SLF', 'click'][1 + p_partkey % 4] AS t FROM part)
 SELECT p_partkey, coalesce(code, t) AS "tractID" FROM t LEFT JOIN codes ON name = replace(t, ' ', '')""")
def short_tract_names(spark, sf_dir):
    names = F.array(*map(F.lit, ("Left Arcuate", "CallosumForcepsMinor", "Right SLF", "click")))
    p = table(spark, sf_dir, "part").select("p_partkey", F.get(names, (F.col("p_partkey") % 4).cast("int")).alias(TRACT))
    return features.short_names(p)


_SCORES = hashrand.uniform_sql("'fold'", "p_partkey", "k")


@query(f"""SELECT p_partkey AS feature_idx, round(avg(abs(round({_SCORES} - 0.5, 6))), 6) + 0.0 AS score FROM part, (SELECT unnest(range(0, 3)) AS k) GROUP BY p_partkey""")
def mean_coefficients(spark, sf_dir):
    folds = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("feature_idx"), F.explode(F.sequence(F.lit(0), F.lit(2))).alias("k"))
    scored = folds.withColumn("beta", F.round(hashrand.uniform("fold", F.col("feature_idx"), F.col("k")) - 0.5, 6))
    return features.mean_size(scored).withColumn("score", r("score"))


# Profile statistics.

_QBINS = """q AS (SELECT quantile_cont(c_acctbal, [0.0, 0.25, 0.5, 0.75, 1.0]) AS e FROM customer),
 bins AS (SELECT CAST(c_custkey AS VARCHAR) AS s, CAST(CASE WHEN c_acctbal <= e[2] THEN 0 WHEN c_acctbal <= e[3] THEN 1 WHEN c_acctbal <= e[4] THEN 2 ELSE 3 END AS INTEGER) AS b, e FROM customer, q)"""


def _quartiles(spark, sf_dir):
    c = customers(spark, sf_dir)
    edges = profiles.quantile_edges(c, "c_acctbal", 4)
    return c.select(SUBJECT, profiles.bin_index(F.col("c_acctbal"), edges, True).alias("b")), edges


@query(f"""WITH {_QBINS} SELECT s AS "subjectID", b AS bin FROM bins""")
def quantile_bins(spark, sf_dir):
    return _quartiles(spark, sf_dir)[0].select(SUBJECT, F.col("b").alias("bin"))


@query("""WITH e AS (SELECT min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM customer), w AS (SELECT lo, hi, (hi - lo) / 5 AS d FROM e)
 SELECT CAST(c_custkey AS VARCHAR) AS "subjectID", CAST(CASE WHEN c_acctbal <= lo + d THEN 0 WHEN c_acctbal <= lo + 2 * d THEN 1 WHEN c_acctbal <= lo + 3 * d THEN 2 WHEN c_acctbal <= lo + 4 * d THEN 3 ELSE 4 END AS INTEGER) AS bin FROM customer, w""")
def width_bins(spark, sf_dir):
    c = customers(spark, sf_dir)
    return c.select(SUBJECT, profiles.bin_index(F.col("c_acctbal"), profiles.width_edges(c, "c_acctbal", 5)).alias("bin"))


@query(f"""WITH {_QBINS}, {FILLED} SELECT m AS metric, t AS "tractID", 'balance ' || printf('%.2f', e[b + 1]) || '-' || printf('%.2f', e[b + 2]) AS hue, n AS "nodeID", round(avg(v), 9) + 0.0 AS mean, count(v) AS n FROM filled JOIN bins USING (s) WHERE v IS NOT NULL GROUP BY ALL""")
def mean_profiles(spark, sf_dir):
    hues = profiles.hue(customers(spark, sf_dir), "c_acctbal", quantiles=4, name="balance")
    return profiles.mean_profiles(filled(spark, sf_dir), hues).withColumn("mean", r("mean", 9))


@query(f"""WITH {CELLS}, named AS (SELECT CASE WHEN m = 'k' THEN 'dki_md' ELSE m END AS m, CASE WHEN t = 'click' THEN 'Left Cingulum Hippocampus' ELSE t END AS t, n, v FROM cells)
 SELECT m AS metric, t AS "tractID", n AS "nodeID", round(avg(v) * CASE WHEN m = 'dki_md' THEN 1000 ELSE 1 END, 6) + 0.0 AS mean FROM named WHERE t NOT LIKE '%Cingulum Hippocampus%' GROUP BY m, t, n""")
def displayed_profiles(spark, sf_dir):
    """Mean profiles as displays show them, with one event type in the place of a bundle that they leave out."""
    cells = reshape.collapse(reshape.melt(nodes(spark, sf_dir)))
    named = cells.withColumn("metric", F.when(F.col("metric") == "k", "dki_md").otherwise(F.col("metric"))).withColumn(TRACT, F.when(F.col(TRACT) == "click", "Left Cingulum Hippocampus").otherwise(F.col(TRACT)))
    means = named.groupBy("metric", TRACT, NODE).agg(F.avg("value").alias("mean"))
    return profiles.displayed(means, ["mean"]).withColumn("mean", r("mean"))


_WEIGHT = " + ".join(f"CAST(u > {x!r} AS INTEGER)" for x in profiles.POISSON)


@query(f"""WITH {FILLED}, q AS (SELECT quantile_cont(c_acctbal, [0.0, 0.5, 1.0]) AS e FROM customer), hues AS (SELECT CAST(c_custkey AS VARCHAR) AS s, CASE WHEN c_acctbal <= e[2] THEN 'balance ' || printf('%.2f', e[1]) || '-' || printf('%.2f', e[2]) ELSE 'balance ' || printf('%.2f', e[2]) || '-' || printf('%.2f', e[3]) END AS hue FROM customer, q),
 rw AS (SELECT s, m, t, n, hue, v FROM filled JOIN hues USING (s) WHERE v IS NOT NULL), words AS (SELECT s, q, md5('boot|0|' || s || '|' || q) AS h FROM (SELECT DISTINCT s FROM rw), (SELECT unnest(range(0, 125)) AS q)),
 draws AS (SELECT s, q * 4 + j AS b, (('0x' || substr(h, CAST(j * 8 + 1 AS BIGINT), 8))::BIGINT::DOUBLE + 0.5) / 4294967296.0 AS u FROM words, (SELECT unnest(range(0, 4)) AS j)), wt AS (SELECT s, b, {_WEIGHT} AS w FROM draws),
 rep AS (SELECT m, t, hue, n, b, sum(w * v) / nullif(sum(w), 0) AS x FROM rw JOIN wt USING (s) GROUP BY m, t, hue, n, b), ci AS (SELECT m, t, hue, n, quantile_cont(x, 0.025) AS low, quantile_cont(x, 0.975) AS high FROM rep GROUP BY m, t, hue, n)
 SELECT m AS metric, t AS "tractID", hue, n AS "nodeID", count(*) AS n, round(avg(v), 10) + 0.0 AS mean, round(any_value(low), 10) + 0.0 AS low, round(any_value(high), 10) + 0.0 AS high FROM rw JOIN ci USING (m, t, hue, n) GROUP BY m, t, hue, rw.n""")
def profile_intervals(spark, sf_dir):
    hues = profiles.hue(customers(spark, sf_dir), "c_acctbal", quantiles=2, name="balance")
    out = profiles.profiles_with_intervals(filled(spark, sf_dir), hues, 500)
    return out.withColumns({c: r(c, 10) for c in ("mean", "low", "high")})


_GROUPS = """grps AS (SELECT CAST(c_custkey AS VARCHAR) AS s, c_mktsegment = 'BUILDING' AS h FROM customer)"""


@query(f"""WITH {_GROUPS}, {FILLED} SELECT m AS metric, t AS "tractID", n AS "nodeID", round(avg(v) FILTER (h) - avg(v) FILTER (NOT h), 9) + 0.0 AS coef FROM filled JOIN grps USING (s) WHERE v IS NOT NULL GROUP BY ALL HAVING count(v) FILTER (h) > 0 AND count(v) FILTER (NOT h) > 0 AND count(v) > 2""")
def group_difference(spark, sf_dir):
    return _tests(spark, sf_dir).select("metric", TRACT, NODE, r("coef", 9).alias("coef"))


def _tests(spark, sf_dir):
    groups = customers(spark, sf_dir).select(SUBJECT, F.when(F.col("c_mktsegment") == "BUILDING", "b").otherwise("a").alias("hue"))
    return profiles.group_tests(filled(spark, sf_dir), groups, "a")


def _between(t: str, df: str) -> str:
    """The chance that a t variable lies between -t and t, by its finite sums for whole degrees of freedom."""
    cos2, angle = f"({df} / ({df} + ({t}) * ({t})))", f"atan(({t}) / sqrt({df}))"
    even = f"list_sum(list_transform(range(0, CAST({df} AS BIGINT) // 2), lambda j: exp(lgamma(j + 0.5) - lgamma(j + 1.0)) / sqrt(pi()) * pow({cos2}, j)))"
    odd = f"coalesce(list_sum(list_transform(range(0, (CAST({df} AS BIGINT) - 1) // 2), lambda j: exp(lgamma(j + 1.0) - lgamma(j + 1.5)) * sqrt(pi()) / 2 * pow({cos2}, j))), 0)"
    return f"CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN sin({angle}) * {even} ELSE 2 / pi() * ({angle} + sin({angle}) * cos({angle}) * {odd}) END"


@query(f"""WITH RECURSIVE {_GROUPS}, {FILLED}, su AS (SELECT m, t, n, count(v) FILTER (h) AS n1, avg(v) FILTER (h) AS m1, var_pop(v) FILTER (h) AS v1, count(v) FILTER (NOT h) AS n0, avg(v) FILTER (NOT h) AS m0, var_pop(v) FILTER (NOT h) AS v0 FROM filled JOIN grps USING (s) WHERE v IS NOT NULL GROUP BY m, t, n),
 te AS (SELECT m, t, n, m1 - m0 AS coef, sqrt((n0 * v0 + n1 * v1) / (n0 + n1 - 2) * (1.0 / n0 + 1.0 / n1)) AS se, CAST(n0 + n1 - 2 AS DOUBLE) AS df FROM su WHERE n0 > 0 AND n1 > 0 AND n0 + n1 > 2),
 bi AS (SELECT DISTINCT df, 0.0::DOUBLE AS lo, 1000.0::DOUBLE AS hi, 0 AS k FROM te UNION ALL SELECT df, CASE WHEN below THEN (lo + hi) / 2 ELSE lo END, CASE WHEN below THEN hi ELSE (lo + hi) / 2 END, k + 1 FROM (SELECT *, ({_between('(lo + hi) / 2', 'df')}) < 0.95 AS below FROM bi) WHERE k < 60),
 pv AS (SELECT te.*, 1 - ({_between('abs(coef) / se', 'te.df')}) AS p, (lo + hi) / 2 AS tq FROM te JOIN bi ON bi.df = te.df AND bi.k = 60), rk AS (SELECT *, p * count(*) OVER (PARTITION BY m) / count(*) OVER (PARTITION BY m ORDER BY p) AS raw FROM pv)
 SELECT m AS metric, t AS "tractID", n AS "nodeID", round(coef, 7) + 0.0 AS coef, round(coef - tq * se, 7) + 0.0 AS low, round(coef + tq * se, 7) + 0.0 AS high, round(p, 8) + 0.0 AS p, round(least(1.0, min(raw) OVER (PARTITION BY m ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 8) + 0.0 AS q FROM rk""")
def group_tests_corrected(spark, sf_dir):
    out = profiles.false_discovery(_tests(spark, sf_dir), by=["metric"])
    return out.withColumns({c: r(c, 7) for c in ("coef", "low", "high")} | {c: r(c, 8) for c in ("p", "q")})


_P = hashrand.uniform_sql("'p'", "c_custkey")


@query(f"""WITH t AS (SELECT c_custkey, c_nationkey, round(pow({_P}, 3), 6) AS p FROM customer), k AS (SELECT *, p * count(*) OVER (PARTITION BY c_nationkey) / count(*) OVER (PARTITION BY c_nationkey ORDER BY p) AS raw FROM t)
 SELECT c_custkey, c_nationkey, round(least(1.0, min(raw) OVER (PARTITION BY c_nationkey ORDER BY p RANGE BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9) + 0.0 AS q FROM k""")
def false_discovery(spark, sf_dir):
    t = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.round(F.pow(hashrand.uniform("p", F.col("c_custkey")), F.lit(3.0)), 6).alias("p"))
    return profiles.false_discovery(t, by=["c_nationkey"]).select("c_custkey", "c_nationkey", r("q", 9).alias("q"))


@query(f"""SELECT CAST(c_custkey AS VARCHAR) AS "subjectID", {hashrand.uniform_sql("3", "c_custkey")} < 0.25 AS test FROM customer""")
def train_test_split(spark, sf_dir):
    return profiles.split(customers(spark, sf_dir).select(SUBJECT), 0.25, 3)


@query("""SELECT date_trunc('hour', ts) AS start, CAST(user_id AS VARCHAR) AS "subjectID", event_type AS "tractID", round(avg(value), 6) + 0.0 AS mean, count(value) AS n FROM events WHERE value IS NOT NULL GROUP BY ALL""")
def windowed_means(spark, sf_dir):
    from nodeloom.streaming.means import running_means

    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias(SUBJECT), F.col("event_type").alias(TRACT), "ts", "value")
    means = running_means(e, "value").withColumn("mean", r("mean"))
    return means.withColumn("start", F.col("start").cast("timestamp_ntz"))


# Matching.


def _units(c):
    return c.select("c_custkey", (F.col("c_mktsegment") == "BUILDING").alias("status"), "c_acctbal", F.col("c_nationkey").cast("double").alias("nation"))


_UNITS = """u AS (SELECT c_custkey, c_mktsegment = 'BUILDING' AS status, c_acctbal AS a, c_nationkey::DOUBLE AS b FROM customer),
 cv AS (SELECT var_pop(a) AS aa, covar_pop(a, b) AS ab, var_pop(b) AS bb FROM u)"""


@query(f"""WITH {_UNITS}, d AS (SELECT x.c_custkey AS test_id, y.c_custkey AS ctrl_id, sqrt(((x.a - y.a) * (x.a - y.a) * bb - 2 * (x.a - y.a) * (x.b - y.b) * ab + (x.b - y.b) * (x.b - y.b) * aa) / (aa * bb - ab * ab)) AS dist
 FROM u x JOIN u y ON x.status AND NOT y.status, cv) SELECT test_id, ctrl_id, round(dist, 6) + 0.0 AS dist FROM d WHERE dist <= 0.05""")
def pair_distances(spark, sf_dir):
    return _distances(_units(table(spark, sf_dir, "customer")), 0.05)


def _distances(u, within=None):
    test, control = match.split_by_status(u, "status")
    names = ["c_acctbal", "nation"]
    found = match.pair_distances(test, control, names, match.precision(u, names), "c_custkey", within)
    return found.withColumn("dist", F.floor(F.col("dist") * 1e6 + 0.5) / 1e6)  # rounded as SQL does, in a tenth of the time of round


@query(f"""WITH {_UNITS}, d AS (SELECT x.c_custkey AS test_id, y.c_custkey AS ctrl_id, sqrt(((x.a - y.a) * (x.a - y.a) * bb - 2 * (x.a - y.a) * (x.b - y.b) * ab + (x.b - y.b) * (x.b - y.b) * aa) / (aa * bb - ab * ab)) AS dist
 FROM u x JOIN u y ON x.status AND NOT y.status, cv) SELECT test_id, ctrl_id, round(dist, 6) + 0.0 AS dist FROM d""")
def all_pair_distances(spark, sf_dir):
    return _distances(_units(table(spark, sf_dir, "customer")))


@query()
def matched_units(spark, sf_dir):
    u = _units(table(spark, sf_dir, "customer"))
    return match.mahalanobis_match(u.withColumn("block", F.col("nation")), "status", "c_custkey", ["c_acctbal", "nation"], threshold=0.2, block="block").drop("block")


# Imputation and scaling.

_GAPPY = f"""{VECTORS}, gap AS (SELECT s, f, CASE WHEN (s * 7 + f * 3) % 11 <> 0 THEN v END AS v FROM vec)"""


def _gappy(spark, sf_dir):
    return vectors(spark, sf_dir).select(SUBJECT, "feature_idx", F.when((F.col(SUBJECT) * 7 + F.col("feature_idx") * 3) % 11 != 0, F.col("value")).alias("value"))


@query(f"""WITH {_GAPPY}, st AS (SELECT f, avg(v) AS a, quantile_cont(v, 0.5) AS d FROM gap GROUP BY f) SELECT s AS "subjectID", f AS feature_idx, round(coalesce(v, a), 6) + 0.0 AS mean, round(coalesce(v, d), 6) + 0.0 AS median FROM gap JOIN st USING (f)""")
def imputed(spark, sf_dir):
    keys = [SUBJECT, "feature_idx"]
    a = scale.impute(_gappy(spark, sf_dir), "mean").select(*keys, r("value").alias("mean"))
    return a.join(scale.impute(_gappy(spark, sf_dir), "median").select(*keys, r("value").alias("median")), keys)


_KNN = """WITH g AS (SELECT c_custkey AS s, f, v FROM (SELECT c_custkey, 0 AS f, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal / 1000 END AS v FROM customer
 UNION ALL SELECT c_custkey, 1, CASE WHEN c_custkey % 7 = 1 THEN NULL ELSE c_nationkey::DOUBLE END FROM customer UNION ALL SELECT c_custkey, 2, (c_custkey * 37 % 101)::DOUBLE FROM customer)),
 near AS (SELECT a.s AS a, b.s AS b, sum(pow(a.v - b.v, 2)) * 3 / count(*) AS d FROM g a JOIN g b ON a.f = b.f AND a.s <> b.s WHERE a.v IS NOT NULL AND b.v IS NOT NULL GROUP BY a.s, b.s),
 o AS (SELECT q.s, q.f, b.v, row_number() OVER (PARTITION BY q.s, q.f ORDER BY d, near.b) AS k FROM g q JOIN near ON q.s = near.a JOIN g b ON b.s = near.b AND b.f = q.f WHERE q.v IS NULL AND b.v IS NOT NULL),
 fl AS (SELECT s, f, avg(v) AS w FROM o WHERE k <= 5 GROUP BY s, f) SELECT s AS c_custkey, f AS feature_idx, round(coalesce(v, w), 6) + 0.0 AS value FROM g LEFT JOIN fl USING (s, f)"""


@query(_KNN)
def imputed_by_neighbours(spark, sf_dir):
    return _by_neighbours(table(spark, sf_dir, "customer"))


@query(_KNN)
def all_imputed_by_neighbours(spark, sf_dir):
    return _by_neighbours(table(spark, sf_dir, "customer"))


def _by_neighbours(c):
    key = F.col("c_custkey")
    x = F.array(F.when(key % 5 != 0, F.col("c_acctbal") / 1000), F.when(key % 7 != 1, F.col("c_nationkey").cast("double")), (key * 37 % 101).cast("double"))
    long = c.select("c_custkey", F.posexplode(x).alias("feature_idx", "value"))
    return scale.impute_nearest(long, "c_custkey", 5).select("c_custkey", "feature_idx", r("value").alias("value"))


@query(f"""WITH {VECTORS}, st AS (SELECT f, avg(v) AS a, stddev_pop(v) AS d, min(v) AS lo, max(v) AS hi, max(abs(v)) AS top, quantile_cont(v, 0.5) AS q2, quantile_cont(v, 0.75) - quantile_cont(v, 0.25) AS iqr FROM vec GROUP BY f)
 SELECT s AS "subjectID", f AS feature_idx, round((v - a) / d, 5) + 0.0 AS standard, round((v - lo) / (hi - lo), 5) + 0.0 AS minmax, round(v / top, 5) + 0.0 AS maxabs, round((v - q2) / iqr, 5) + 0.0 AS robust FROM vec JOIN st USING (f)""")
def scaled(spark, sf_dir):
    keys, out = [SUBJECT, "feature_idx"], None
    for how in ("standard", "minmax", "maxabs", "robust"):
        one = scale.scale(vectors(spark, sf_dir), how).select(*keys, r("value", 5).alias(how))
        out = one if out is None else out.join(one, keys)
    return out


@query("""SELECT c_custkey, round(CASE WHEN c_acctbal / 1000 >= 0 THEN (pow(c_acctbal / 1000 + 1, 0.5) - 1) / 0.5 ELSE -(pow(1 - c_acctbal / 1000, 1.5) - 1) / 1.5 END, 6) + 0.0 AS bent FROM customer""")
def yeo_johnson(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", r(scale.yeo_johnson(F.col("c_acctbal") / 1000, F.lit(0.5))).alias("bent"))


def _bent(v: str, p: str) -> str:
    return f"""CASE WHEN {v} >= 0 THEN CASE WHEN abs({p}) < 1e-12 THEN ln({v} + 1) ELSE (pow({v} + 1, {p}) - 1) / {p} END ELSE CASE WHEN abs({p} - 2) < 1e-12 THEN -ln(1 - {v}) ELSE -(pow(1 - {v}, 2 - ({p})) - 1) / (2 - ({p})) END END"""


def _powers() -> str:
    """Rounds of a search for each feature's likeliest power: the last CTE is best (f, power)."""
    out, ranges = "", "SELECT DISTINCT f, -4.0::DOUBLE AS lo, 4.0::DOUBLE AS hi FROM vec"
    for k in range(scale.ROUNDS):
        out += f""", g{k} AS (SELECT f, lo + i * ((hi - lo) / 16) AS p, (hi - lo) / 16 AS step FROM ({ranges}), (SELECT unnest(range(0, 17)) AS i)),
 l{k} AS (SELECT f, p, any_value(step) AS step, count(*) / 2.0 * ln(var_pop({_bent('v', 'p')})) - (p - 1) * sum(sign(v) * ln(1 + abs(v))) AS loss FROM g{k} JOIN vec USING (f) GROUP BY f, p), b{k} AS (SELECT f, arg_min(p, loss) AS best, any_value(step) AS step FROM l{k} GROUP BY f)"""
        ranges = f"SELECT f, best - step AS lo, best + step AS hi FROM b{k}"
    return f"{out}, best AS (SELECT f, best AS power FROM b{scale.ROUNDS - 1})"


@query(f"""WITH {VECTORS}{_powers()}, bt AS (SELECT s, f, {_bent('v', 'power')} AS w FROM vec JOIN best USING (f)), st AS (SELECT f, avg(w) AS a, stddev_pop(w) AS d FROM bt GROUP BY f)
 SELECT s AS "subjectID", f AS feature_idx, round((w - a) / d, 4) + 0.0 AS value FROM bt JOIN st USING (f)""")
def power_transformed(spark, sf_dir):
    return scale.power_transform(vectors(spark, sf_dir).select(SUBJECT, "feature_idx", "value")).withColumn("value", r("value", 4))


def _axis(k: int, source: str) -> str:
    """CTEs that square the matrices (g, a) of ``source``, 8 by 8, until one axis is left, and take it off: x{k} (g, v), c{k} (g, a)."""
    product = "list_transform(range(0, 64), lambda t: list_sum(list_transform(range(1, 9), lambda j: a[(t // 8) * 8 + j] * a[(j - 1) * 8 + t % 8 + 1])))"
    return f""", s{k} AS (SELECT g, list_transform(a, lambda x: x / list_max(list_transform(a, lambda y: abs(y)))) AS a, 0 AS k FROM {source} UNION ALL SELECT g, list_transform(p, lambda x: x / list_max(list_transform(p, lambda y: abs(y)))), k + 1 FROM (SELECT g, k, {product} AS p FROM s{k} WHERE k < 42)),
 d{k} AS (SELECT g, a, list_position(list_transform(range(0, 8), lambda i: a[i * 9 + 1]), list_max(list_transform(range(0, 8), lambda i: a[i * 9 + 1]))) AS j FROM s{k} WHERE k = 42), u{k} AS (SELECT g, list_transform(range(0, 8), lambda i: a[i * 8 + j]) AS u FROM d{k}),
 w{k} AS (SELECT g, list_transform(u, lambda x: x / sqrt(list_sum(list_transform(u, lambda y: y * y)))) AS u FROM u{k}), x{k} AS (SELECT g, list_transform(u, lambda x: x * sign(u[list_position(list_transform(u, lambda y: abs(y)), list_max(list_transform(u, lambda y: abs(y))))])) AS v FROM w{k}),
 e{k} AS (SELECT q.g, q.a, v, list_sum(list_transform(range(0, 64), lambda t: v[t // 8 + 1] * q.a[t + 1] * v[t % 8 + 1])) AS z FROM {source} q JOIN x{k} ON x{k}.g = q.g), c{k} AS (SELECT g, list_transform(range(0, 64), lambda t: a[t + 1] - z * v[t // 8 + 1] * v[t % 8 + 1]) AS a FROM e{k})"""


@query(f"""WITH RECURSIVE {VECTORS}, mv AS (SELECT f, avg(v) AS mean FROM vec GROUP BY f), ce AS (SELECT s, f // 8 AS g, f % 8 AS i, v - mean AS d FROM vec JOIN mv USING (f)), cc AS (SELECT x.g, x.i, y.i AS j, avg(x.d * y.d) AS c FROM ce x JOIN ce y ON x.s = y.s AND x.g = y.g GROUP BY x.g, x.i, y.i),
 c0 AS (SELECT g, list(c ORDER BY i, j) AS a FROM cc GROUP BY g){_axis(1, 'c0')}{_axis(2, 'c1')}{_axis(3, 'c2')}, axes AS (SELECT g, 0 AS k, v FROM x1 UNION ALL SELECT g, 1, v FROM x2 UNION ALL SELECT g, 2, v FROM x3)
 SELECT s AS "subjectID", CAST(ce.g AS INTEGER) AS group_idx, k AS component, round(sum(d * v[i + 1]), 6) + 0.0 AS value FROM ce JOIN axes ON axes.g = ce.g GROUP BY s, ce.g, k""")
def group_components(spark, sf_dir):
    v = vectors(spark, sf_dir).withColumn("group_idx", F.expr("feature_idx div 8").cast("int"))
    return scale.group_components(v, SUBJECT, 3).withColumn("value", r("value"))


_SITES = f"""{VECTORS}, sv AS (SELECT s, 's' || (s % 3) AS site, f, v FROM vec), fs AS (SELECT f, site, count(*) AS n, avg(v) AS my, var_pop(v) * count(*) AS w FROM sv WHERE learnt GROUP BY f, site), po AS (SELECT f, sum(n) AS total, sum(w) AS w FROM fs GROUP BY f),
 ba AS (SELECT f, sum(n * my) / max(total) AS base, sqrt(greatest(max(po.w) / max(total), 1e-12)) AS spread FROM fs JOIN po USING (f) GROUP BY f), pl AS (SELECT f, site, n, base, spread, (my - base) / spread AS place, w / (n - 1) / (spread * spread) AS width FROM fs JOIN ba USING (f)),
 pr AS (SELECT site, avg(place) AS mean, var_samp(place) AS tau, avg(width) AS m, var_samp(width) AS v FROM pl GROUP BY site), it AS (SELECT f, site, n, base, spread, place, width, mean, tau, m, v, place AS gamma, width AS delta, 0 AS k FROM pl JOIN pr USING (site)
 UNION ALL SELECT f, site, n, base, spread, place, width, mean, tau, m, v, g, (0.5 * ((n - 1) * width + n * (place - g) * (place - g)) + (m * v + m * m * m) / v) / (n / 2.0 + (2 * v + m * m) / v - 1), k + 1 FROM (SELECT *, (tau * n * place + delta * mean) / (tau * n + delta) AS g FROM it WHERE k < 60))
 SELECT s AS "subjectID", sv.site, sv.f AS feature_idx, round((((sv.v - base) / spread) - gamma) / sqrt(delta) * spread + base, 6) + 0.0 AS value FROM sv JOIN it ON it.f = sv.f AND it.site = sv.site AND it.k = 60"""


def _sited(spark, sf_dir):
    return vectors(spark, sf_dir).withColumn("site", F.concat(F.lit("s"), (F.col(SUBJECT) % 3).cast("string")))


@query(f"WITH RECURSIVE {_SITES.replace(' WHERE learnt', '')}")
def site_harmonised(spark, sf_dir):
    return scale.combat(_sited(spark, sf_dir), "site").withColumn("value", r("value"))


@query(f"WITH RECURSIVE {_SITES.replace('WHERE learnt', 'WHERE s % 4 <> 0')} WHERE s % 4 = 0")
def site_harmonised_held_out(spark, sf_dir):
    """Site effects learnt on three quarters of the subjects, taken off the others."""
    v = _sited(spark, sf_dir)
    learnt = scale.Harmoniser("site").fit(v.where(F.col(SUBJECT) % 4 != 0))
    return learnt.transform(v.where(F.col(SUBJECT) % 4 == 0)).withColumn("value", r("value"))


# Augmentation.


@query(f"""WITH {SEQS} SELECT sample_id, channel, step, round(value + {hashrand.normal_sql("'jitter'", '7', 'sample_id', 'channel', 'step', sigma=0.03)}, 6) + 0.0 AS jittered, round(value * {hashrand.normal_sql("'scaling'", '7', 'sample_id', 'channel', sigma=0.1, mean=1.0)}, 6) + 0.0 AS scaled FROM seq""")
def jittered_and_scaled(spark, sf_dir):
    x = sequences(spark, sf_dir)
    keys = list(augment.KEYS)
    a = augment.jitter(x, 0.03, 7).select(*keys, r("value").alias("jittered"))
    return a.join(augment.scaling(x, 0.1, 7).select(*keys, r("value").alias("scaled")), keys)


_SEG = "CASE WHEN step < (8 % k) * (8 // k + 1) THEN step // (8 // k + 1) ELSE (8 % k) + (step - (8 % k) * (8 // k + 1)) // greatest(8 // k, 1) END"


@query(f"""WITH {SEQS}, c AS (SELECT *, 1 + CAST(floor({hashrand.uniform_sql("'permutation'", '7', 'sample_id')} * 4) AS INTEGER) AS k FROM seq), g AS (SELECT *, CAST({_SEG} AS INTEGER) AS seg FROM c)
 SELECT sample_id, channel, CAST(row_number() OVER (PARTITION BY sample_id, channel ORDER BY {hashrand.uniform_sql("'segment'", '7', 'sample_id', 'seg')}, seg, step) - 1 AS INTEGER) AS step, round(value, 6) + 0.0 AS value FROM g""")
def permuted(spark, sf_dir):
    return augment.permutation(sequences(spark, sf_dir), seed=7).select(*augment.KEYS, r("value").alias("value"))


@query(f"""WITH {SEQS}, c AS (SELECT DISTINCT sample_id, 1 + CAST(floor({hashrand.uniform_sql("'permutation'", '7', 'sample_id')} * 4) AS INTEGER) AS k FROM seq), u AS (SELECT sample_id, k, cut, row_number() OVER (PARTITION BY sample_id ORDER BY {hashrand.uniform_sql("'cut'", '7', 'sample_id', 'cut')}, cut) AS o FROM c, (SELECT unnest(range(1, 7)) AS cut)),
 g AS (SELECT s.sample_id, s.channel, s.step, s.value, (SELECT count(*) FROM u WHERE u.sample_id = s.sample_id AND u.o <= u.k - 1 AND u.cut <= s.step) AS seg FROM seq s)
 SELECT sample_id, channel, CAST(row_number() OVER (PARTITION BY sample_id, channel ORDER BY {hashrand.uniform_sql("'segment'", '7', 'sample_id', 'seg')}, seg, step) - 1 AS INTEGER) AS step, round(value, 6) + 0.0 AS value FROM g""")
def permuted_at_random(spark, sf_dir):
    """Segments cut at drawn steps change places."""
    return augment.permutation(sequences(spark, sf_dir), equal=False, seed=7).select(*augment.KEYS, r("value").alias("value"))


@query(f"""WITH {SEQS}, c AS (SELECT *, CAST(floor({hashrand.uniform_sql("'slice'", '7', 'sample_id')} * 2) AS INTEGER) AS st FROM seq), p AS (SELECT *, st + step * 6 / 7.0 AS ps, least(st + 5, CAST(floor(st + step * 6 / 7.0) AS INTEGER)) AS i FROM c),
 w AS (SELECT p.sample_id, p.channel, p.step, p.ps, p.i, a.value AS v0, b.value AS v1 FROM p JOIN seq a ON a.sample_id = p.sample_id AND a.channel = p.channel AND a.step = p.i JOIN seq b ON b.sample_id = p.sample_id AND b.channel = p.channel AND b.step = least(p.i + 1, p.st + 5))
 SELECT sample_id, channel, step, round(v0 + (v1 - v0) * least(1.0, greatest(0.0, ps - i)), 6) + 0.0 AS value FROM w""")
def window_sliced(spark, sf_dir):
    return augment.window_slice(sequences(spark, sf_dir), 0.75, seed=7).select(*augment.KEYS, r("value").alias("value"))


def _augmented(name, sql=None, **options):
    def run(spark, sf_dir):
        return augment.unpack(getattr(augment, name)(augment.pack(sequences(spark, sf_dir)), seed=7, **options)).withColumn("value", r("value"))

    run.__name__ = f"augmented_{name}" + ("_shape" if options.get("shape") else "")
    query(sql)(run)


#: Fixed by 8 steps and 6 knots: what each knot's value counts for at each step.
_BASIS = ", ".join(f"({i}, {k}, {float(x)!r}::DOUBLE)" for i, row in enumerate(spline_basis(np.linspace(0, 7, 6), np.arange(8))) for k, x in enumerate(row))
_augmented("magnitude_warp", f"""WITH {SEQS}, basis(step, k, b) AS (VALUES {_BASIS}), ids AS (SELECT DISTINCT sample_id FROM seq), kn AS (SELECT sample_id, k, channel, 1 + 0.2 * {hashrand.normal_sql("'magnitude'", '7', 'sample_id', 'k', 'channel')} AS x FROM ids, (SELECT unnest(range(0, 6)) AS k), (SELECT unnest(range(0, 8)) AS channel)),
 cu AS (SELECT sample_id, channel, step, sum(b * x) AS c FROM kn JOIN basis USING (k) GROUP BY sample_id, channel, step) SELECT sample_id, label, CAST(channel AS INTEGER) AS channel, CAST(step AS INTEGER) AS step, round(value * c, 6) + 0.0 AS value FROM seq JOIN cu USING (sample_id, channel, step)""")
_augmented("time_warp")
_augmented("window_warp", f"""WITH {SEQS}, ids AS (SELECT DISTINCT sample_id FROM seq), w AS (SELECT sample_id, 1 + CAST(floor({hashrand.uniform_sql("'window'", '7', 'sample_id', "'start'")} * 5) AS INTEGER) AS st, 1 + CAST(floor({hashrand.uniform_sql("'window'", '7', 'sample_id', "'scale'")} * 2) AS INTEGER) AS len FROM ids),
 lo AS (SELECT sample_id, st, len, p, CASE WHEN p < st THEN p WHEN p < st + len THEN st ELSE p - len + 1 END AS step FROM w, (SELECT unnest(range(0, 9)) AS p) WHERE p < 7 + len), nv AS (SELECT sample_id, label, channel, p, value FROM lo JOIN seq USING (sample_id, step)),
 po AS (SELECT sample_id, t, t * (6 + len) / 7.0 AS x, least(CAST(floor(t * (6 + len) / 7.0) AS INTEGER), 6 + len) AS i, least(CAST(floor(t * (6 + len) / 7.0) AS INTEGER) + 1, 6 + len) AS j FROM w, (SELECT unnest(range(0, 8)) AS t))
 SELECT po.sample_id, a.label, CAST(a.channel AS INTEGER) AS channel, CAST(t AS INTEGER) AS step, round(a.value + (b.value - a.value) * (x - i), 6) + 0.0 AS value FROM po JOIN nv a ON a.sample_id = po.sample_id AND a.p = i JOIN nv b ON b.sample_id = po.sample_id AND b.p = j AND b.channel = a.channel""")


def _warped(name: str, band: int | None) -> str:
    """CTEs that align each sample with a drawn partner of its label: mate (sample_id, other), path (sample_id, distance, path of (i, j))."""
    apart = f"CASE WHEN j - i BETWEEN {-band} AND {band} THEN d ELSE 'inf'::DOUBLE END" if band is not None else "d"
    inf = "'inf'::DOUBLE"
    return f"""{SEQS}, rk AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY sample_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT sample_id, label FROM seq)),
 mate AS (SELECT a.sample_id, b.sample_id AS other FROM (SELECT *, (r + 1 + CAST(floor({hashrand.uniform_sql(f"'{name}'", '7', 'sample_id')} * greatest(n - 1, 1)) AS BIGINT)) % n AS o FROM rk WHERE n > 1) a JOIN rk b ON b.label = a.label AND b.r = a.o),
 ds AS (SELECT k, i, j, {apart} AS d FROM (SELECT mate.sample_id AS k, p.step AS i, q.step AS j, sqrt(sum((p.value - q.value) * (p.value - q.value))) AS d FROM mate JOIN seq p ON p.sample_id = PROTO JOIN seq q ON q.sample_id = SAMPLE AND q.channel = p.channel GROUP BY mate.sample_id, p.step, q.step)),
 dl AS (SELECT k, list(d ORDER BY i, j) AS c FROM ds GROUP BY k), dp AS (SELECT k, c, [c[1]] AS t, 1 AS z FROM dl UNION ALL SELECT k, c, list_append(t, c[z + 1] + least(CASE WHEN z >= 8 AND z % 8 > 0 THEN t[z - 8] ELSE {inf} END, CASE WHEN z >= 8 THEN t[z - 7] ELSE {inf} END, CASE WHEN z % 8 > 0 THEN t[z] ELSE {inf} END)), z + 1 FROM dp WHERE z < 64),
 tr AS (SELECT k, t, 7 AS i, 7 AS j, [{{'i': 7, 'j': 7}}] AS path FROM dp WHERE z = 64 UNION ALL SELECT k, t, ni, nj, list_prepend({{'i': ni, 'j': nj}}, path) FROM (SELECT k, t, path, i - CAST(w <> 2 AS INTEGER) AS ni, j - CAST(w <> 1 AS INTEGER) AS nj FROM (SELECT *, CASE WHEN dg <= up AND dg <= lf THEN 0 WHEN up <= lf THEN 1 ELSE 2 END AS w FROM (
 SELECT *, CASE WHEN i > 0 AND j > 0 THEN t[(i - 1) * 8 + j] ELSE {inf} END AS dg, CASE WHEN i > 0 THEN t[(i - 1) * 8 + j + 1] ELSE {inf} END AS up, CASE WHEN j > 0 THEN t[i * 8 + j] ELSE {inf} END AS lf FROM tr WHERE i > 0 OR j > 0)))),
 path AS (SELECT k AS sample_id, t[64] AS distance, path FROM tr WHERE i = 0 AND j = 0)"""


_augmented("spawner")
_augmented("barycenter")
_augmented("guided_warp", f"""WITH RECURSIVE {_warped('guided', 1).replace('PROTO', 'mate.other').replace('SAMPLE', 'mate.sample_id')}, po AS (SELECT sample_id, path, t, t * (len(path) - 1) / 7.0 AS x FROM path, (SELECT unnest(range(0, 8)) AS t)), st AS (SELECT sample_id, t, x - floor(x) AS share, path[CAST(floor(x) AS BIGINT) + 1].j AS a, path[least(CAST(floor(x) AS BIGINT) + 2, len(path))].j AS b FROM po)
 SELECT st.sample_id, p.label, CAST(p.channel AS INTEGER) AS channel, CAST(t AS INTEGER) AS step, round(p.value + (q.value - p.value) * share, 6) + 0.0 AS value FROM st JOIN seq p ON p.sample_id = st.sample_id AND p.step = a JOIN seq q ON q.sample_id = st.sample_id AND q.step = b AND q.channel = p.channel
 UNION ALL SELECT sample_id, label, CAST(channel AS INTEGER), CAST(step AS INTEGER), round(value, 6) + 0.0 FROM seq WHERE sample_id NOT IN (SELECT sample_id FROM path)""")
_augmented("discriminative_warp")
_augmented("guided_warp", shape=True)
_augmented("discriminative_warp", shape=True)


@query(f"""WITH RECURSIVE {_warped('pairs', None).replace('PROTO', 'mate.sample_id').replace('SAMPLE', 'mate.other')} SELECT sample_id, round(distance, 6) + 0.0 AS distance, array_to_string(list_transform(path, lambda p: p.i || ':' || p.j), ' ') AS path FROM path""")
def warp_distances(spark, sf_dir):
    x = augment.pack(sequences(spark, sf_dir))
    p = augment.with_partner(x, "pairs", 7).where("partner is not null")
    found = augment.warp_distances(p.select("sample_id", "n_channels", F.col("x").alias("prototype"), F.col("partner").alias("sample")), "symmetric")
    path = F.concat_ws(" ", F.transform("path", lambda s: F.concat_ws(":", s["i"].cast("string"), s["j"].cast("string"))))
    return found.select("sample_id", r("distance").alias("distance"), path.alias("path"))


@query(f"""WITH {SEQS}, rk AS (SELECT sample_id, label, row_number() OVER (PARTITION BY label ORDER BY sample_id) - 1 AS r, count(*) OVER (PARTITION BY label) AS n FROM (SELECT DISTINCT sample_id, label FROM seq)),
 a AS (SELECT *, CASE WHEN n > 1 THEN (r + 1 + CAST(floor({hashrand.uniform_sql("'mates'", '7', 'sample_id')} * (n - 1)) AS BIGINT)) % n END AS o FROM rk) SELECT a.sample_id, a.label, round(q.total, 5) + 0.0 AS partner_total FROM a LEFT JOIN rk b ON b.label = a.label AND b.r = a.o LEFT JOIN (SELECT sample_id, sum(value) AS total FROM seq GROUP BY sample_id) q ON q.sample_id = b.sample_id""")
def partners(spark, sf_dir):
    """Another sample of the same label for each, drawn at random."""
    p = augment.with_partner(augment.pack(sequences(spark, sf_dir)), "mates", 7)
    return p.select("sample_id", "label", r(F.aggregate("partner", F.lit(0.0), lambda a, v: a + v), 5).alias("partner_total"))


@query(f"""WITH {SEQS}, sz AS (SELECT label, count(*) AS n FROM (SELECT DISTINCT sample_id, label FROM seq) GROUP BY label), bg AS (SELECT label, n, sum(n) OVER (ORDER BY label) - n AS z, sum(n) OVER () AS total FROM sz),
 rk AS (SELECT sample_id, label, n, CAST(z AS BIGINT) AS z, CAST(total AS BIGINT) AS total, row_number() OVER (PARTITION BY label ORDER BY sample_id) - 1 AS r FROM (SELECT DISTINCT sample_id, label FROM seq) JOIN bg USING (label)),
 dr AS (SELECT *, CAST(floor({hashrand.uniform_sql("'mixed'", '7', 'sample_id')} * greatest(n - 1, 1)) AS BIGINT) AS st, CAST(floor({hashrand.uniform_sql("'mixed'", '7', "'others'", 'sample_id')} * greatest(total - n, 1)) AS BIGINT) AS b2 FROM rk),
 pk AS (SELECT sample_id, label, TRUE AS same, z + (r + 1 + (st + t) % (n - 1)) % n AS p FROM dr, (SELECT unnest(range(0, 3)) AS t) WHERE t < n - 1 UNION ALL SELECT sample_id, label, FALSE, (z + n + (b2 + t) % (total - n)) % total FROM dr, (SELECT unnest(range(0, 2)) AS t) WHERE t < total - n),
 tv AS (SELECT rk.z + rk.r AS p, sum(value) AS v FROM rk JOIN seq ON seq.sample_id = rk.sample_id GROUP BY rk.z + rk.r)
 SELECT rk.sample_id, rk.label, count(*) FILTER (same) AS n_same, count(*) FILTER (NOT same) AS n_others, round(coalesce(sum(v) FILTER (same), 0), 5) + 0.0 AS same_total, round(coalesce(sum(v) FILTER (NOT same), 0), 5) + 0.0 AS others_total FROM rk LEFT JOIN pk ON pk.sample_id = rk.sample_id LEFT JOIN tv ON tv.p = pk.p GROUP BY rk.sample_id, rk.label""")
def draws_by_label(spark, sf_dir):
    """Three other samples of the same label for each, and two of other labels, without repeats."""
    d = augment.with_draws(augment.pack(sequences(spark, sf_dir)), 3, 2, "mixed", 7, False)
    size = lambda c: F.coalesce(F.size(c), F.lit(0)).cast("long")
    total = lambda c: r(F.coalesce(F.aggregate(F.flatten(c), F.lit(0.0), lambda a, v: a + v), F.lit(0.0)), 5)
    return d.select("sample_id", "label", size("same").alias("n_same"), size("different").alias("n_others"), total("same").alias("same_total"), total("different").alias("others_total"))


# Ensembles and validation.


@query(f"""WITH o AS (SELECT e, label, vec_id, row_number() OVER (PARTITION BY e, label ORDER BY {hashrand.uniform_sql("'bag'", '7', 'e', 'vec_id')}, vec_id) AS k, count(*) OVER (PARTITION BY e, label) AS n FROM embeddings, (SELECT unnest(range(0, 3)) AS e))
 SELECT CAST(e AS INTEGER) AS estimator, vec_id AS "subjectID", label FROM o WHERE k <= floor(n * 0.5)""")
def bagging_draws(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(SUBJECT), "label")
    return bagging.draws(rows, 3, 0.5, stratify="label", replace=False, seed=7).select("estimator", SUBJECT, "label")


@query()
def bagged_predictions(spark, sf_dir):
    m = reshape.matrix(vectors(spark, sf_dir)).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(SUBJECT), (F.col("label") % 2).alias("y")), SUBJECT)
    fitted = bagging.Bagging("logistic", n_estimators=5, seed=7).fit(m, "x", "y", SUBJECT)
    return fitted.predict_proba(m, "x", SUBJECT)


@query("""WITH t AS (SELECT c_custkey AS k, e, 0.1 + 0.8 * ((c_custkey * (e + 3)) % 10) / 10.0 AS p FROM customer, (SELECT unnest(range(0, 4)) AS e)) SELECT k AS sample, round(avg(p), 6) + 0.0 AS proba, round(ln(sum(exp(ln(p)))) - ln(4), 6) + 0.0 AS log_proba FROM t GROUP BY k""")
def ensemble_means(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("sample"), F.explode(F.sequence(F.lit(0), F.lit(3))).alias("estimator"))
    members = c.withColumn("proba", 0.1 + 0.8 * ((F.col("sample") * (F.col("estimator") + 3)) % 10) / 10.0).withColumn("class", F.lit(1))
    members = members.withColumn("log_proba", F.log("proba"))
    both = bagging.mean_of(members, "proba").join(bagging.log_mean_of(members, "log_proba"), ["sample", "class"])
    return both.select("sample", r("proba").alias("proba"), r("log_proba").alias("log_proba"))


@query()
def cross_validated(spark, sf_dir):
    m = reshape.matrix(vectors(spark, sf_dir)).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(SUBJECT), (F.col("label") % 2).cast("double").alias("y")), SUBJECT)
    return validation.cross_validate(m, "x", "y", SUBJECT, estimator="ridge", folds=3, scoring=["r2", "neg_mean_squared_error"]).drop("fit_time", "score_time")


@query(f"""WITH o AS (SELECT vec_id, row_number() OVER (ORDER BY vec_id) - 1 AS i, count(*) OVER () AS n FROM embeddings)
 SELECT vec_id AS "subjectID", CAST(CASE WHEN i < (n % 7) * (n // 7 + 1) THEN i // (n // 7 + 1) ELSE n % 7 + (i - (n % 7) * (n // 7 + 1)) // (n // 7) END AS INTEGER) AS fold FROM o""")
def fold_assignment(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(SUBJECT))
    return validation.with_folds(rows, SUBJECT, 7)


@query()
def lasso_predictions(spark, sf_dir):
    from nodeloom.plans.fitted import Fitted

    m = reshape.matrix(vectors(spark, sf_dir)).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(SUBJECT), F.col("label").cast("double").alias("y")), SUBJECT)
    return Fitted("lasso", alpha=0.05).fit(m, "x", "y", SUBJECT).predict(m, "x", SUBJECT)


@query(f"""WITH {FILLED} SELECT s AS "subjectID", m AS metric, t AS "tractID", n AS "nodeID", CAST(f AS INTEGER) AS feature_idx, round(v, 6) + 0.0 AS value FROM filled""")
def mapped_features(spark, sf_dir):
    from nodeloom.plans.mapper import FeatureMapper

    n = nodes(spark, sf_dir)
    return FeatureMapper(metrics=["value", "k"]).fit(n).transform(n).select(SUBJECT, "metric", TRACT, NODE, F.col("feature_idx").cast("int").alias("feature_idx"), r("value").alias("value"))


@query()
def sparse_group_path(spark, sf_dir):
    m = reshape.matrix(vectors(spark, sf_dir)).join(table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias(SUBJECT), (F.col("label") % 2).cast("double").alias("y")), SUBJECT)
    groups = [list(range(8 * g, 8 * g + 8)) for g in range(8)]
    return sgl.path(m, "x", "y", SUBJECT, groups, alphas=[0.2, 0.05], l1_ratios=[0.5, 1.0], folds=3)


from nodeloom import queries_files, queries_models  # noqa: E402, F401  they register more queries, and use what stands above

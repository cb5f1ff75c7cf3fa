"""Registered queries that write files and read them again: text tables and the store of nested objects.

What they write goes to a new folder each time, on the storage that the session names for checkpoints.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nodeloom.plans.dataset import ProfileDataset
from nodeloom.queries import customers, nodes, r, table
from nodeloom.registry import query
from nodeloom.sources import store
from nodeloom.sources.scratch import folder
from nodeloom.sources.tables import NODE, SUBJECT, TRACT, read_nodes, read_subjects

_NODES = "SELECT CAST(user_id AS VARCHAR) AS s, event_type AS t, CAST(hour(ts) AS INTEGER) AS n, value AS v, CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k FROM events"


def _written_nodes(spark, sf_dir) -> str:
    path = folder(spark, "nodes")
    index = F.monotonically_increasing_id().cast("string")
    nodes(spark, sf_dir).select(index.alias("Unnamed: 0"), SUBJECT, TRACT, NODE, "value", "k").write.option("header", True).csv(path)
    return path


def _written_subjects(spark, sf_dir, sep: str) -> str:
    path = folder(spark, "subjects")
    balance = F.when(F.col("c_custkey") % 9 == 0, "n/a").otherwise(F.col("c_acctbal").cast("string"))
    customers(spark, sf_dir).select(F.lit("0").alias("Unnamed: 0"), SUBJECT, balance.alias("balance"), F.col("c_mktsegment").alias("segment")).write.option("header", True).option("sep", sep).csv(path)
    return path


@query(f"""SELECT s AS "subjectID", t AS "tractID", n AS "nodeID", count(*) AS n, round(sum(v), 4) + 0.0 AS value, round(sum(k), 4) + 0.0 AS k FROM ({_NODES}) GROUP BY ALL""")
def nodes_from_text(spark, sf_dir):
    """A node table written as CSV with an index column, and read again."""
    found = read_nodes(spark, _written_nodes(spark, sf_dir))
    return found.groupBy(SUBJECT, TRACT, NODE).agg(F.count("*").alias("n"), r(F.sum("value"), 4).alias("value"), r(F.sum("k"), 4).alias("k"))


@query(f"""SELECT s AS "subjectID", t AS "tractID", n AS "nodeID", count(*) AS n, round(sum(k), 4) + 0.0 AS k FROM ({_NODES}) GROUP BY ALL""")
def one_metric_from_text(spark, sf_dir):
    found = read_nodes(spark, _written_nodes(spark, sf_dir), ["k"])
    return found.groupBy(SUBJECT, TRACT, NODE).agg(F.count("*").alias("n"), r(F.sum("k"), 4).alias("k"))


_SUBJECTS = "SELECT CAST(c_custkey AS VARCHAR) AS s, CASE WHEN c_custkey % 9 <> 0 THEN c_acctbal END AS a, c_mktsegment AS g FROM customer"


def _subjects_query(name: str, sep: str) -> None:
    def run(spark, sf_dir):
        return read_subjects(spark, _written_subjects(spark, sf_dir, sep)).select(SUBJECT, r("balance", 4).alias("balance"), "segment")

    run.__name__ = name
    query(f"""SELECT s AS "subjectID", round(a, 4) + 0.0 AS balance, g AS segment FROM ({_SUBJECTS})""")(run)


for _name, _sep in (("subjects_from_tabs", "\t"), ("subjects_from_semicolons", ";"), ("subjects_from_commas", ",")):
    _subjects_query(_name, _sep)


_FROM_FILES = f"""nd AS ({_NODES}), sb AS ({_SUBJECTS}), ids AS (SELECT DISTINCT s FROM nd WHERE k IS NOT NULL), tg AS (SELECT ids.s, a, g FROM ids LEFT JOIN sb USING (s)), cls AS (SELECT g, row_number() OVER (ORDER BY g) - 1 AS code FROM (SELECT DISTINCT coalesce(g, 'NaN') AS g FROM tg))"""


@query(f"""WITH {_FROM_FILES} SELECT 'sub-' || s AS "subjectID", round(a, 4) + 0.0 AS balance, CAST(code AS INTEGER) AS segment_code FROM tg JOIN cls ON cls.g = coalesce(tg.g, 'NaN')""")
def targets_from_files(spark, sf_dir):
    """The targets of a dataset read from two text files, ids with their prefix, labels encoded."""
    d = ProfileDataset.from_files(spark, _written_nodes(spark, sf_dir), _written_subjects(spark, sf_dir, "\t"), target_cols=["balance", "segment"], label_encode_cols=["segment"], dwi_metrics=["k"])
    return d.targets.select(SUBJECT, r("balance", 4).alias("balance"), "segment_code")


@query(f"""WITH nd AS ({_NODES}) SELECT 'sub-' || s AS "subjectID", t AS "tractID", round(avg(k), 6) + 0.0 AS value FROM nd WHERE k IS NOT NULL GROUP BY s, t""")
def bundle_means_from_files(spark, sf_dir):
    d = ProfileDataset.from_files(spark, _written_nodes(spark, sf_dir), unsupervised=True, dwi_metrics=["k"], return_bundle_means=True)
    return d.features.where("value is not null").select(SUBJECT, TRACT, r("value").alias("value"))


@query(f"""WITH nd AS ({_NODES}) SELECT 'sub-' || s AS "subjectID", count(DISTINCT t || n) AS cells, round(sum(v), 4) + 0.0 AS total FROM (SELECT s, t, n, avg(k) AS v FROM nd WHERE k IS NOT NULL GROUP BY s, t, n) GROUP BY s""")
def study_cells(spark, sf_dir):
    """A registered study whose tables lie in a folder: the cells of its profiles that were measured."""
    from nodeloom.operators import reshape
    from nodeloom.sources import studies

    path = folder(spark, "study")
    nodes(spark, sf_dir).select(SUBJECT, TRACT, NODE, "value", "k").write.option("header", True).csv(f"{path}/nodes.csv")
    customers(spark, sf_dir).select(SUBJECT, F.col("c_mktsegment").alias("class")).write.option("header", True).csv(f"{path}/subjects.csv")
    studies.register("events", studies.Study("nodes.csv", "subjects.csv", {"dwi_metrics": ["k"], "target_cols": ["class"], "label_encode_cols": ["class"]}))
    d = studies.study(spark, "events", path)
    cells = reshape.collapse(reshape.melt(read_nodes(spark, f"{path}/nodes.csv", ["k"]).withColumn(SUBJECT, reshape.standard_id(F.col(SUBJECT)))))
    counted = cells.groupBy(SUBJECT).agg(F.count("*").alias("cells"), r(F.sum("value"), 4).alias("total"))
    return counted.join(d.targets.select(SUBJECT), SUBJECT)


# The store of nested objects; the tables that the driver holds for it are the two of fixed size.


def _nations(spark, sf_dir):
    rows = table(spark, sf_dir, "nation").orderBy("n_nationkey").select("n_nationkey", "n_name", "n_regionkey").collect()
    return [np.array([x[i] for x in rows]) for i in range(3)]


@query("""SELECT n_nationkey AS key, n_name AS name, n_regionkey AS region, (n_nationkey * 0.5)::DOUBLE AS half, -n_nationkey::DOUBLE AS imaginary, n_nationkey % 2 = 0 AS even FROM nation""")
def stored_arrays(spark, sf_dir):
    """Arrays of whole numbers, texts, reals, complex numbers and truth values, saved under groups with links and codecs, and loaded."""
    keys, names, regions = _nations(spark, sf_dir)
    path = folder(spark, "store")
    data = {"ids": {"key": keys, "name": names}, "more": [store.Compressed(keys * 0.5, "gzip"), keys - 1j * keys], "again": keys, "even": store.Pickled(list(keys % 2 == 0)), "region": regions}
    store.save(spark, path, data)
    back = store.load(spark, path)
    rows = zip(back["again"], back["ids"]["name"], back["region"], back["more"][0], back["more"][1], back["even"], strict=True)
    return spark.createDataFrame([(int(a), str(b), int(c), float(d), float(e.imag), bool(f)) for a, b, c, d, e, f in rows], "key int, name string, region int, half double, imaginary double, even boolean")


@query("""SELECT n_nationkey AS key, n_name AS name FROM nation WHERE n_nationkey BETWEEN 5 AND 14""")
def stored_slices(spark, sf_dir):
    """Parts of stored arrays, named by their path and read without the rest."""
    keys, names, _ = _nations(spark, sf_dir)
    path = folder(spark, "store")
    store.save(spark, path, {"deep": {"key": keys, "names": [names]}})
    a = store.load(spark, path, "deep/key", sel=slice(5, 15))
    b = store.load(spark, path, "/deep/names/0", sel=slice(5, 15))
    return spark.createDataFrame([(int(x), str(y)) for x, y in zip(a, b, strict=True)], "key int, name string")


@query("""SELECT n_regionkey AS row, n_nationkey AS col, (n_nationkey + 1.0)::DOUBLE AS value FROM nation""")
def stored_triplets(spark, sf_dir):
    keys, _, regions = _nations(spark, sf_dir)
    path = folder(spark, "store")
    store.save(spark, path, store.Coo(regions, keys, keys + 1.0, (5, 25)))
    m = store.load(spark, path)
    return spark.createDataFrame([(int(a), int(b), float(c)) for a, b, c in zip(m.row, m.col, m.value, strict=True)], "row int, col int, value double")


@query("""SELECT c_custkey, c_name, round(c_acctbal, 4) + 0.0 AS balance FROM customer""")
def stored_tables(spark, sf_dir):
    """A Spark table in the store: it is written and read by the executors."""
    path = folder(spark, "store")
    store.save(spark, path, {"people": table(spark, sf_dir, "customer"), "note": "all"}, compression="gzip")
    return store.load(spark, path, "people").select("c_custkey", "c_name", r("c_acctbal", 4).alias("balance"))

"""The corpus pipeline's stages against plain versions, and the guard around the optional parts."""

import collections
import importlib
import os
import random
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from nodeloom.llm import pii

SF = "/root/testdata/sf0.001"
ROOT = os.path.dirname(os.path.abspath(corpus_pipeline.__file__))
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def stages(spark):
    """What each stage was given and what it returned, at the smallest scale."""
    docs, seen = spark.read.parquet(f"{SF}/documents.parquet"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, SF).persist()
        seen.append((name, docs, out))
        docs = out
    return seen


def test_shape(stages):
    assert [n for n, _, _ in stages] == ["quality", "simhash", "suffixes", "pii", "packing"]
    for _, given, out in stages[:-1]:
        assert out.columns == given.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        assert [t for _, t in out.dtypes] == [t for _, t in given.dtypes]


def test_quality_keeps_good_documents(stages, spark):
    _, given, out = stages[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    kept = {r[0] for r in out.select("doc_id").collect()}
    good = {r[0] for r in labels.where("quality = 1").collect()}
    poor = {r[0] for r in labels.where("quality = 0").collect()}
    assert good <= kept and len(poor & kept) <= len(poor) // 3
    assert out.exceptAll(given).count() == 0


def shingles(text, width=5):
    words = text.lower().split()
    return {tuple(words[i : i + width]) for i in range(len(words) - width + 1)} or {tuple(words)}


def test_one_of_each_group_stays(stages):
    _, given, out = stages[1]
    rows = {r["doc_id"]: shingles(r["text"]) for r in given.collect()}
    kept = {r["doc_id"] for r in out.select("doc_id").collect()}
    ids = sorted(rows)
    like = collections.defaultdict(dict)
    for i in ids:
        for j in ids:
            if i != j and (both := len(rows[i] & rows[j])):
                like[i][j] = both / len(rows[i] | rows[j])
    for i in ids:
        sure = [j for j, s in like[i].items() if s >= 0.88]
        assert i not in kept or not any(j in kept for j in sure)
        if i not in kept:  # something like it stays, or something like that
            assert any(s >= 0.7 for s in like[i].values())
    assert out.exceptAll(given).count() == 0


def test_groups_are_those_of_the_true_similarity(stages):
    _, given, out = stages[1]
    rows = {r["doc_id"]: shingles(r["text"]) for r in given.collect()}
    root = {i: i for i in rows}
    for i in sorted(rows):
        for j in rows:
            if i < j and len(both := rows[i] & rows[j]) >= 0.8 * len(rows[i] | rows[j]) and both and root[i] != root[j]:
                a, b = sorted((root[i], root[j]))
                root = {k: a if x == b else x for k, x in root.items()}
    assert sorted(r["doc_id"] for r in out.collect()) == sorted(set(root.values()))


def test_repeats_go(stages):
    _, given, out = stages[2]
    data = {r["doc_id"]: r["text"].encode() for r in given.collect()}
    starts = collections.Counter(d[i : i + 400] for d in data.values() for i in range(len(d) - 399))
    for r in out.collect():
        d = data[r["doc_id"]]
        gone = [False] * len(d)
        for i in range(len(d) - 399):
            if starts[d[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        assert r["text"] == bytes(x for x, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert r["n_chars"] == len(r["text"])


def test_passages_of_over_50_words_go(stages, spark):
    """The corpus without passages loses every 51 words in a row that also stand elsewhere; most have under 400 bytes."""
    assert [n for n, _ in corpus_pipeline.WITH_PASSAGES] == [n for n, _ in corpus_pipeline.STAGES]
    _, given, plain = stages[2]
    data = {r["doc_id"]: r["text"].encode() for r in given.collect()}
    starts = collections.Counter(d[i : i + 400] for d in data.values() for i in range(len(d) - 399))
    passages = collections.Counter(tuple(w[i : i + 51]) for w in map(bytes.split, data.values()) for i in range(len(w) - 50))
    out = dict(corpus_pipeline.WITH_PASSAGES)["suffixes"](spark, given, SF)
    assert out.columns == given.columns and [t for _, t in out.dtypes] == [t for _, t in given.dtypes]
    got = {r["doc_id"]: r for r in out.collect()}
    for k, d in data.items():
        gone = [False] * len(d)
        for i in range(len(d) - 399):
            if starts[d[i : i + 400]] > 1:
                gone[i : i + 400] = [True] * 400
        spans = [m.span() for m in re.finditer(rb"[^ \t-\r]+", d)]
        for i in range(len(spans) - 50):
            if passages[tuple(d[a:b] for a, b in spans[i : i + 51])] > 1:
                a, b = spans[i][0], spans[i + 50][1]
                gone[a:b] = [True] * (b - a)
        assert got[k]["text"] == bytes(x for x, g in zip(d, gone, strict=True) if not g).decode("utf-8", "ignore")
        assert got[k]["n_chars"] == len(got[k]["text"])
    before = {r["doc_id"]: r["text"] for r in plain.collect()}
    assert sum(got[k]["text"] != before[k] for k in data) > 5


def test_personal_data_is_masked(stages):
    _, given, out = stages[3]
    texts = {r["doc_id"]: r["text"] for r in given.collect()}
    for r in out.collect():
        assert r["text"] == pii.masked(texts[r["doc_id"]], pii.spans(texts[r["doc_id"]])) and r["n_chars"] == len(r["text"])


def test_all_is_packed(stages):
    _, given, out = stages[4]
    assert {r[0] for r in out.select("doc_id").collect()} == {r[0] for r in given.select("doc_id").collect()}
    bins = collections.Counter()
    for r in out.collect():
        bins[r["sequence_id"]] += r["length"]
    assert max(bins.values()) <= 4096 and len(bins) <= -(-sum(bins.values()) // 4096) + 1


def test_run_is_the_stages(stages, spark):
    got = corpus_pipeline.run(spark, SF).select("doc_id", "piece", "length").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, stages[-1][2].select("doc_id", "piece", "length").collect()))


def test_columns_that_clash_go_through(spark, stages):
    """Columns named like those of the operators, null and repeated, keep their values through every stage."""
    extra = ["score", "predicted", "held_out", "fingerprint", "t1", "kept", "n_bytes", "row", "rank", "length", "piece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for i, c in enumerate(extra):
        docs = docs.withColumn(c, F.when(F.col("doc_id") % 3 != 0, F.concat(F.lit(f"{c}-"), F.col("doc_id").cast("string"))))
    for (name, stage), (_, _, plain) in zip(corpus_pipeline.STAGES, stages, strict=True):
        out = stage(spark, docs, SF).persist()
        if name == "packing":
            assert sorted(map(tuple, out.select("doc_id", "piece", "length").collect())) == sorted(map(tuple, plain.select("doc_id", "piece", "length").collect()))
            break
        assert out.columns == docs.columns and [t for _, t in out.dtypes] == [t for _, t in docs.dtypes]
        assert sorted(out.select("doc_id", "text", "n_chars").collect()) == sorted(plain.select("doc_id", "text", "n_chars").collect())
        for r in out.collect():
            assert all(r[c] == (f"{c}-{r['doc_id']}" if r["doc_id"] % 3 else None) for c in extra), (name, r["doc_id"])
        docs = out


def test_no_documents(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_order_of_rows_does_not_matter(spark):
    r = random.Random(1)
    rows = [(i, " ".join(r.choice("abcdefgh") * r.randint(1, 6) for _ in range(80)), "en", "s", 0) for i in range(40)]
    rows += [(100 + i, rows[i][1], "en", "s", 0) for i in range(10)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    stage = corpus_pipeline.drop_near_duplicates
    a, b = (sorted(x["doc_id"] for x in stage(spark, d, SF).collect()) for d in (df, df.repartition(6)))
    assert a == b == list(range(40))


def test_rest_works_without(tmp_path):
    """With this subpackage, its tests and the pipeline gone, the entry imports and lists the other queries."""
    copy = tmp_path / "repo"
    shutil.copytree(ROOT, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", "llm", "corpus_pipeline.py"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'pipeline' not in q and not any(k.startswith('op') for k in q); assert set(e.oracle_sql()) <= set(q) and len(q) > 30"
    subprocess.run([sys.executable, "-c", code], cwd=copy, env={**os.environ, "PYTHONPATH": str(copy)}, check=True, timeout=120)
    entry = importlib.import_module("__spark_entry__")
    names = list(entry.queries())
    assert "pipeline" in names and [sum(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)] == [1] * 10

"""Registered queries of pipelines, estimators, ensembles and validation, with closed forms in SQL.

``customer`` is the table of subjects with two features: the balance, and a number from the key. The target
is a line through both with noise that is named by a hash. Least squares with two features has a closed
form, so SQL can fit every model anew from sums.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from nodeloom.functions import hashrand
from nodeloom.plans import bagging, validation
from nodeloom.plans.dataset import ProfileDataset
from nodeloom.plans.estimators import Ridge, Transformed
from nodeloom.plans.fitted import Fitted
from nodeloom.plans.pipeline import make_pipeline, make_regressor_pipeline
from nodeloom.queries import r, table
from nodeloom.registry import query
from nodeloom.sources.tables import NODE, SUBJECT, TRACT

_NOISE = hashrand.uniform_sql("'noise'", "c_custkey")
#: k, the key as text, a and b the features (a null for every eleventh customer), y the target.
POINTS = f"""pt AS (SELECT c_custkey, CAST(c_custkey AS VARCHAR) AS k, c_acctbal / 1000 AS a, CAST(c_custkey % 7 AS DOUBLE) AS b, 3 + 0.5 * (c_acctbal / 1000) - 0.25 * (c_custkey % 7) + {_NOISE} AS y FROM customer)"""
GAPPY = f"""{POINTS}, gap AS (SELECT k, CASE WHEN c_custkey % 11 <> 0 THEN a END AS a, b, y, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM pt)"""


def ridge_sql(rows: str, by: str = "", alpha: float = 1.0, y: str = "y", w: str = "1.0") -> str:
    """A query that fits least squares with a squared penalty on a and b to the rows of each ``by``: (by, b0, b1, c)."""
    keys = f"{by}, " if by else ""
    group = f"GROUP BY {by}" if by else ""
    return f"""SELECT {keys}b0, b1, my - ma * b0 - mb * b1 AS c FROM (SELECT *, ((sbb + {alpha}) * say - sab * sby) / d AS b0, ((saa + {alpha}) * sby - sab * say) / d AS b1 FROM (
 SELECT *, (saa + {alpha}) * (sbb + {alpha}) - sab * sab AS d FROM (SELECT {keys}sa / n AS ma, sb / n AS mb, sy / n AS my, qaa - sa * sa / n AS saa, qbb - sb * sb / n AS sbb, qab - sa * sb / n AS sab, qay - sa * sy / n AS say, qby - sb * sy / n AS sby FROM (
 SELECT {keys}sum({w}) AS n, sum({w} * a) AS sa, sum({w} * b) AS sb, sum({w} * {y}) AS sy, sum({w} * a * a) AS qaa, sum({w} * b * b) AS qbb, sum({w} * a * b) AS qab, sum({w} * a * {y}) AS qay, sum({w} * b * {y}) AS qby FROM {rows} {group}))))"""


def points(spark, sf_dir):
    """(k, x, a, b, y)"""
    c = table(spark, sf_dir, "customer")
    a, b = F.col("c_acctbal") / 1000, (F.col("c_custkey") % 7).cast("double")
    y = 3 + 0.5 * a - 0.25 * b + hashrand.uniform("noise", F.col("c_custkey"))
    return c.select(F.col("c_custkey").cast("string").alias("k"), F.array(a, b).alias("x"), a.alias("a"), b.alias("b"), y.alias("y"))


def gappy(spark, sf_dir) -> ProfileDataset:
    """The points as a dataset of two tracts, the first feature null for every eleventh customer."""
    p = points(spark, sf_dir)
    a = F.when(F.col("k").cast("long") % 11 != 0, F.col("a"))
    cells = F.array(F.struct(F.lit("a").alias(TRACT), a.alias("v")), F.struct(F.lit("b").alias(TRACT), F.col("b").alias("v")))
    nodes = p.select(F.col("k").alias(SUBJECT), F.explode(cells).alias("c")).select(SUBJECT, f"c.{TRACT}", F.lit(0).alias(NODE), "c.v")
    return ProfileDataset.build(nodes, p.select(F.col("k").alias(SUBJECT), "y"), ["y"]).persist()


# Estimators.


@query(f"WITH {POINTS}, m AS ({ridge_sql('pt')}) SELECT k AS sample, round(c + b0 * a + b1 * b, 6) + 0.0 AS prediction FROM pt, m")
def ridge_predictions(spark, sf_dir):
    p = points(spark, sf_dir)
    return Fitted("ridge").fit(p, "x", "y", "k").predict(p, "x", "k").withColumn("prediction", r("prediction"))


@query(f"""WITH {POINTS}, m AS ({ridge_sql('pt')}), e AS (SELECT y, c + b0 * a + b1 * b AS p FROM pt, m) SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 9) + 0.0 AS score FROM e""")
def ridge_score(spark, sf_dir):
    p = points(spark, sf_dir)
    score = Fitted("ridge").fit(p, "x", "y", "k").score(p, "x", "y", "k")
    return spark.range(1).select(r(F.lit(score), 9).alias("score"))


@query(f"""WITH {POINTS}, logs AS (SELECT *, ln(1 + y) AS l FROM pt), m AS ({ridge_sql('logs', y='l')}) SELECT k AS sample, round(exp(c + b0 * a + b1 * b) - 1, 6) + 0.0 AS prediction FROM pt, m""")
def transformed_target(spark, sf_dir):
    p = points(spark, sf_dir)
    model = Fitted(Transformed(Ridge(), np.log1p, np.expm1)).fit(p, "x", "y", "k")
    return model.predict(p, "x", "k").withColumn("prediction", r("prediction"))


@query(f"""WITH {POINTS}, s AS (SELECT avg(a) AS ma, avg(y) AS my, var_pop(a) AS v, covar_pop(a, y) AS c FROM pt), m AS (SELECT *, sign(c) * greatest(abs(c) - 0.3, 0) / v AS w FROM s)
 SELECT k AS sample, round(my + w * (a - ma), 4) + 0.0 AS prediction FROM pt, m""")
def lasso_line(spark, sf_dir):
    p = points(spark, sf_dir).withColumn("x", F.array("a"))
    return Fitted("lasso", alpha=0.3, max_iter=20_000, tol=1e-12).fit(p, "x", "y", "k").predict(p, "x", "k").withColumn("prediction", r("prediction", 4))


# Pipelines: statistics of the training rows, applied to others.

_FILLED = """fl AS (SELECT k, i, n, coalesce(a, (SELECT avg(a) FROM tr)) AS a, b, y FROM gap)"""
_TRAIN = f"""{GAPPY}, tr AS (SELECT * FROM gap WHERE i < n * 3 // 4), {_FILLED}, ft AS (SELECT * FROM fl WHERE i < n * 3 // 4),
 st AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM ft), z AS (SELECT k, i, n, (a - ma) / sa AS a, (b - mb) / sb AS b, y FROM fl, st), zt AS (SELECT * FROM z WHERE i < n * 3 // 4)"""


def _parts(spark, sf_dir):
    d = gappy(spark, sf_dir)
    cut = len(d) * 3 // 4
    return d[:cut], d[cut:]


@query(f"""WITH {_TRAIN} SELECT k AS "subjectID", u.t AS "tractID", round(u.v, 6) + 0.0 AS value FROM (SELECT k, i, n, unnest([{{'t': 'a', 'v': a}}, {{'t': 'b', 'v': b}}]) AS u FROM z) WHERE i >= n * 3 // 4""")
def scaled_held_out(spark, sf_dir):
    train, rest = _parts(spark, sf_dir)
    p = make_pipeline("simple", "standard")
    p.fit_steps(train)
    return p.prepare(rest).features.select(SUBJECT, TRACT, r("value").alias("value"))


@query(f"""WITH {_TRAIN}, m AS ({ridge_sql('zt')}) SELECT k AS sample, round(c + b0 * a + b1 * b, 6) + 0.0 AS prediction FROM z, m WHERE i >= n * 3 // 4""")
def pipeline_held_out(spark, sf_dir):
    train, rest = _parts(spark, sf_dir)
    return make_pipeline("simple", "standard", estimator="ridge").fit(train).predict(rest).withColumn("prediction", r("prediction"))


@query(f"""WITH {GAPPY}, tr AS (SELECT * FROM gap WHERE i < n * 3 // 4), st AS (SELECT quantile_cont(a, 0.5) AS md, min(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM tr))) AS la, max(coalesce(a, (SELECT quantile_cont(a, 0.5) FROM tr))) AS ha, min(b) AS lb, max(b) AS hb FROM tr),
 z AS (SELECT k, i, n, (coalesce(a, md) - la) / (ha - la) AS a, (b - lb) / (hb - lb) AS b, ln(1 + y) AS y FROM gap, st), zt AS (SELECT * FROM z WHERE i < n * 3 // 4), m AS ({ridge_sql('zt')})
 SELECT k AS sample, round(exp(c + b0 * a + b1 * b) - 1, 6) + 0.0 AS prediction FROM z, m WHERE i >= n * 3 // 4""")
def pipeline_transformed_target(spark, sf_dir):
    train, rest = _parts(spark, sf_dir)
    p = make_pipeline("simple", "minmax", estimator="ridge", imputer_kwargs={"strategy": "median"}, target_func=np.log1p, target_inverse=np.expm1)
    return p.fit(train).predict(rest).withColumn("prediction", r("prediction"))


@query(f"""WITH {GAPPY}, tr AS (SELECT * FROM gap WHERE i < n * 3 // 4), {_FILLED}, ft AS (SELECT * FROM fl WHERE i < n * 3 // 4), st AS (SELECT avg(b) AS mb, stddev_pop(b) AS sb, avg(y) AS my FROM ft),
 co AS (SELECT avg((b - mb) / sb * (y - my)) AS c FROM ft, st) SELECT k AS sample, round(my + sign(c) * greatest(abs(c) - 0.1 * 0.5 - 0.1 * 0.5, 0) * (b - mb) / sb, 4) + 0.0 AS prediction FROM fl, st, co WHERE i >= n * 3 // 4""")
def sparse_group_pipeline(spark, sf_dir):
    """On one feature the group penalty is a second soft threshold."""
    train, rest = (d.transform(lambda f: f.where(F.col(TRACT) == "b").withColumn("feature_idx", F.lit(0))) for d in _parts(spark, sf_dir))
    p = make_regressor_pipeline([[0]], use_cv=False, estimator_kwargs={"alpha": 0.1, "l1_ratio": 0.5, "max_iter": 20_000, "tol": 1e-12})
    return p.fit(train).predict(rest).withColumn("prediction", r("prediction", 4))


def _folded(rows: str, folds: int) -> str:
    """The rows with their fold: consecutive parts by i, of n in all."""
    big = f"(n % {folds}) * (n // {folds} + 1)"
    return f"SELECT *, CASE WHEN i < {big} THEN i // (n // {folds} + 1) ELSE n % {folds} + (i - {big}) // (n // {folds}) END AS fold FROM {rows}"


_CV = f"""{GAPPY}, fo AS ({_folded('gap', 3)}), ru AS (SELECT *, fold = run AS test FROM fo, (SELECT unnest(range(0, 3)) AS run)), mn AS (SELECT run, avg(a) AS fa FROM ru WHERE NOT test GROUP BY run),
 fi AS (SELECT k, run, test, coalesce(a, fa) AS a, b, y FROM ru JOIN mn USING (run)), st AS (SELECT run, avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb FROM fi WHERE NOT test GROUP BY run),
 z AS (SELECT run, test, (a - ma) / sa AS a, (b - mb) / sb AS b, y FROM fi JOIN st USING (run)), zt AS (SELECT * FROM z WHERE NOT test), m AS ({ridge_sql('zt', 'run')}), e AS (SELECT run, test, y, c + b0 * a + b1 * b AS p FROM z JOIN m USING (run))"""
_SCORES = """SELECT CAST(run AS INTEGER) AS fold, u.m AS metric, CASE WHEN test THEN 'test' ELSE 'train' END AS split, round(u.v, 9) + 0.0 AS value FROM (SELECT run, test, unnest([{'m': 'r2', 'v': 1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*))}, {'m': 'neg_mean_squared_error', 'v': -avg((y - p) * (y - p))}, {'m': 'neg_mean_absolute_error', 'v': -avg(abs(y - p))}]) AS u FROM e GROUP BY run, test)"""
_METRICS = ["r2", "neg_mean_squared_error", "neg_mean_absolute_error"]


@query(f"WITH {_CV} {_SCORES}")
def cross_validated_pipeline(spark, sf_dir):
    p = make_pipeline("simple", "standard", estimator="ridge")
    return validation.cross_validate_pipeline(p, gappy(spark, sf_dir), 3, _METRICS, return_train_score=True).withColumn("value", r("value", 9))


_CV_PLAIN = f"""{POINTS}, pi AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM pt), fo AS ({_folded('pi', 4)}), z AS (SELECT *, fold = run AS test FROM fo, (SELECT unnest(range(0, 4)) AS run)),
 zt AS (SELECT * FROM z WHERE NOT test), m AS ({ridge_sql('zt', 'run')}), e AS (SELECT run, test, y, c + b0 * a + b1 * b AS p FROM z JOIN m USING (run))"""


@query(f"WITH {_CV_PLAIN} {_SCORES}")
def cross_validated_ridge(spark, sf_dir):
    scores = validation.cross_validate(points(spark, sf_dir), "x", "y", "k", "ridge", 4, _METRICS, return_train_score=True)
    return scores.select("fold", "metric", "split", r("value", 9).alias("value"))


@query(f"WITH {_CV_PLAIN}, s AS ({_SCORES}) SELECT metric, split, round(avg(value), 7) + 0.0 AS mean, round(stddev_pop(value), 7) + 0.0 AS std FROM s GROUP BY metric, split")
def score_summary(spark, sf_dir):
    scores = validation.cross_validate(points(spark, sf_dir), "x", "y", "k", "ridge", 4, _METRICS, return_train_score=True)
    return validation.summary(scores).select("metric", "split", r("mean", 7).alias("mean"), r("std", 7).alias("std"))


@query(f"WITH {_CV_PLAIN} {_SCORES}")
def cross_validation_kept(spark, sf_dir):
    """The scores as they are read again from the folder where the first run left them."""
    from nodeloom.sources.scratch import folder

    options = {"estimator": "ridge", "folds": 4, "scoring": _METRICS, "return_train_score": True, "workdir": folder(spark, "scores"), "checkpoint": True}
    validation.cross_validate(points(spark, sf_dir), "x", "y", "k", **options)
    return validation.cross_validate(points(spark, sf_dir), "x", "y", "k", **options).select("fold", "metric", "split", r("value", 9).alias("value"))


# Ensembles.

_DRAWN = f"""{POINTS}, pi AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS i, count(*) OVER () AS n FROM pt), es AS (SELECT CAST(unnest(range(0, 4)) AS INTEGER) AS e),
 dr AS (SELECT e, CAST(floor({hashrand.uniform_sql("'boot'", '3', 'e', 'slot')} * n) AS BIGINT) AS i FROM (SELECT e, n, unnest(range(1, n + 1)) AS slot FROM es, (SELECT count(*) AS n FROM pt))),
 wt AS (SELECT e, i, CAST(count(*) AS DOUBLE) AS w FROM dr GROUP BY e, i), sm AS (SELECT e, k, a, b, y, w FROM wt JOIN pi USING (i)), m AS ({ridge_sql('sm', 'e', w='w')})"""


def _bagged(spark, sf_dir, **options):
    p = points(spark, sf_dir)
    return p, bagging.Bagging("ridge", 4, seed=3, **options).fit(p, "x", "y", "k")


@query(f"WITH {_DRAWN} SELECT e AS estimator, k AS sample, CAST(w AS BIGINT) AS weight FROM sm")
def bootstrap_draws(spark, sf_dir):
    return bagging.draws(points(spark, sf_dir), 4, seed=3, key="k").select("estimator", F.col("k").alias("sample"), "weight")


@query(f"WITH {_DRAWN} SELECT k AS sample, round(avg(c + b0 * a + b1 * b), 6) + 0.0 AS prediction FROM pt, m GROUP BY k")
def bagged_regression(spark, sf_dir):
    p, model = _bagged(spark, sf_dir)
    return model.predict(p, "x", "k").withColumn("prediction", r("prediction"))


@query(f"""WITH {_DRAWN}, o AS (SELECT k, y, avg(c + b0 * a + b1 * b) AS p FROM (SELECT * FROM pt, m) t WHERE NOT EXISTS (SELECT 1 FROM sm WHERE sm.e = t.e AND sm.k = t.k) GROUP BY k, y)
 SELECT round(1 - sum((y - p) * (y - p)) / (var_pop(y) * count(*)), 9) + 0.0 AS score FROM o""")
def out_of_bag_score(spark, sf_dir):
    _, model = _bagged(spark, sf_dir, oob_score=True)
    return spark.range(1).select(r(F.lit(model.oob_score_), 9).alias("score"))


@query(f"""WITH {_TRAIN}, es AS (SELECT CAST(unnest(range(0, 3)) AS INTEGER) AS e), oz AS (SELECT *, row_number() OVER (ORDER BY k) - 1 AS j, count(*) OVER () AS nt FROM zt),
 dr AS (SELECT e, CAST(floor({hashrand.uniform_sql("'boot'", '0', 'e', 'slot')} * nt) AS BIGINT) AS j FROM (SELECT e, nt, unnest(range(1, nt + 1)) AS slot FROM es, (SELECT count(*) AS nt FROM zt))),
 wt AS (SELECT e, j, CAST(count(*) AS DOUBLE) AS w FROM dr GROUP BY e, j), sm AS (SELECT e, a, b, y, w FROM wt JOIN oz USING (j)), m AS ({ridge_sql('sm', 'e', w='w')})
 SELECT k AS sample, round(avg(c + b0 * a + b1 * b), 6) + 0.0 AS prediction FROM z, m WHERE i >= n * 3 // 4 GROUP BY k""")
def bagged_pipeline(spark, sf_dir):
    train, rest = _parts(spark, sf_dir)
    p = make_pipeline("simple", "standard", estimator="ridge", ensemble="bagging", ensemble_kwargs={"n_estimators": 3})
    return p.fit(train).predict(rest).withColumn("prediction", r("prediction"))


# Targets of the dataset, and arrays for other libraries.


@query(f"WITH {GAPPY} SELECT k AS \"subjectID\", CAST(i AS INTEGER) AS row_idx, round(y, 6) + 0.0 AS y FROM gap WHERE i >= n // 2")
def dataset_slice(spark, sf_dir):
    d = gappy(spark, sf_dir)
    part = d[len(d) // 2 :]
    return part.subjects.join(part.targets, SUBJECT).select(SUBJECT, "row_idx", r("y").alias("y"))


@query(f"WITH {GAPPY} SELECT count(*) AS subjects, CAST(2 AS BIGINT) AS features, CAST(2 AS BIGINT) AS groups, CAST(1 AS BIGINT) AS targets FROM gap")
def dataset_shape(spark, sf_dir):
    d = gappy(spark, sf_dir)
    (n, width), (_, targets) = d.shape
    return spark.createDataFrame([(n, width, d.group_names.count(), targets)], "subjects long, features long, groups long, targets long")


@query(f"""WITH {GAPPY} SELECT CAST(count(*) AS BIGINT) AS items, CAST(count(a) + count(b) AS BIGINT) AS numbers, round(sum(CAST(a AS FLOAT)::DOUBLE), 3) + 0.0 AS first, round(sum(CAST(b AS FLOAT)::DOUBLE), 3) + 0.0 AS second, round(sum(CAST(y AS FLOAT)::DOUBLE), 3) + 0.0 AS target FROM gap""")
def tensor_items(spark, sf_dir):
    """Single-precision items (features, targets) as other libraries take them, one partition at a time."""
    items = numbers = 0
    totals = np.zeros(3)
    for x, y in gappy(spark, sf_dir).batches(bundles_as_channels=False):
        assert x.dtype == y.dtype == np.float32
        items, numbers = items + 1, numbers + int((~np.isnan(x)).sum())
        totals += [*np.nan_to_num(x.astype(float)), float(y[0])]
    return spark.createDataFrame([(items, numbers, *totals.tolist())], "items long, numbers long, first double, second double, target double").select("items", "numbers", *(r(c, 3).alias(c) for c in ("first", "second", "target")))

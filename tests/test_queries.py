"""Every registered query with SQL gives the rows that SQL gives; the others give rows."""

import collections
import glob
import os

import duckdb
import numpy as np
import pytest

from nodeloom import queries
from nodeloom.operators import match

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"
pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="the test tables are not here")


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        c.sql(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_same_as_sql(spark, con, name, tmp_path):
    queries.QUERIES[name](spark, SF).write.parquet(f"{tmp_path}/out")
    ours, sql = f"SELECT * FROM '{tmp_path}/out/*.parquet'", queries.ORACLE_SQL[name]
    columns = sorted(con.sql(sql).columns)
    assert columns == sorted(con.sql(ours).columns)
    c = ", ".join(f'"{x}"' for x in columns)
    count = lambda q: con.sql(f"SELECT count(*) FROM ({q})").fetchall()[0][0]
    assert count(sql) == count(ours) > 0
    assert con.sql(f"SELECT {c} FROM ({sql}) EXCEPT ALL SELECT {c} FROM ({ours})").fetchall() == []


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.ORACLE_SQL)))
def test_gives_rows(spark, name):
    rows = queries.QUERIES[name](spark, SF)
    assert rows.count() > 0


@pytest.mark.parametrize("name", ["interpolated_cubic", "profile_intervals", "mapped_features"])
def test_both_metrics(spark, name):
    assert {r[0] for r in queries.QUERIES[name](spark, SF).select("metric").distinct().collect()} == {"value", "k"}


@pytest.mark.skipif(not os.path.isdir(LARGER), reason="the test tables are not here")
def test_all_rows_are_used(spark):
    c = spark.read.parquet(f"{LARGER}/customer.parquet")
    ids = {r[0] for r in c.select("c_custkey").collect()}
    assert max(ids) > 1_000
    assert queries.QUERIES["all_imputed_by_neighbours"](spark, LARGER).where("value is not null").count() == 3 * len(ids)
    tests = c.where("c_mktsegment = 'BUILDING'").count()
    assert queries.QUERIES["all_pair_distances"](spark, LARGER).count() == tests * (len(ids) - tests)
    units = {r["c_custkey"]: r for r in queries._units(c).collect()}
    x = np.array([(r["c_acctbal"], r["nation"]) for r in units.values()])
    spread = np.sqrt(np.linalg.inv(np.cov(x.T, bias=True))[0, 0])
    got = collections.defaultdict(dict)
    for r in queries.QUERIES["matched_units"](spark, LARGER).collect():
        got[r["nation"], r["ord"]][r["side"]] = r["c_custkey"]
    assert all(units[p[0]]["status"] and not units[p[1]]["status"] and units[p[0]]["nation"] == units[p[1]]["nation"] == n for (n, _), p in got.items())
    want = 0
    for n in {r["nation"] for r in units.values()}:
        a, b = ([r["c_acctbal"] for r in units.values() if r["nation"] == n and r["status"] == s] for s in (True, False))
        cost = np.abs(np.subtract.outer(a, b)) * spread
        want += (cost[match.assign(cost)] <= 0.2).sum()
    assert len({i for p in got.values() for i in p.values()}) == 2 * len(got)
    assert abs(len(got) - want) <= 3 and max(p[0] for p in got.values()) > 1_000  # assignments of equal cost differ in what is over the threshold
    subjects = spark.read.parquet(f"{LARGER}/events.parquet").where("value is not null").select("user_id").distinct().count()
    assert queries.QUERIES["mapped_features"](spark, LARGER).select("subjectID").distinct().count() == subjects


def _matrix(con, target):
    rows = con.sql(f"SELECT vec_id, embedding, {target} FROM embeddings ORDER BY vec_id").fetchall()
    return np.array([r[0] for r in rows]), np.array([r[1] for r in rows], np.float32).astype(float), np.array([r[2] for r in rows], float)


def test_cross_validated_against_normal_equations(spark, con):
    _, x, y = _matrix(con, "label % 2")
    got = {(r["fold"], r["metric"]): r["value"] for r in queries.QUERIES["cross_validated"](spark, SF).collect()}
    for k, test in enumerate(np.array_split(np.arange(len(x)), 3)):
        train = np.setdiff1d(np.arange(len(x)), test)
        a = np.column_stack((x[train], np.ones(len(train))))
        b = np.linalg.solve(a.T @ a + np.diag([1.0] * x.shape[1] + [0.0]), a.T @ y[train])
        error = y[test] - np.column_stack((x[test], np.ones(len(test)))) @ b
        assert abs(got[k, "neg_mean_squared_error"] + (error**2).mean()) < 1e-9
        assert abs(got[k, "r2"] - (1 - (error**2).sum() / ((y[test] - y[test].mean()) ** 2).sum())) < 1e-9


def test_lasso_against_coordinate_descent(spark, con):
    ids, x, y = _matrix(con, "label")
    z, t = x - x.mean(0), y - y.mean()
    b = np.zeros(x.shape[1])
    for _ in range(2_000):
        for j in range(len(b)):
            rest = z[:, j] @ (t - z @ b + z[:, j] * b[j]) / len(z)
            b[j] = np.sign(rest) * max(abs(rest) - 0.05, 0) / (z[:, j] @ z[:, j] / len(z))
    got = {r["sample"]: r["prediction"] for r in queries.QUERIES["lasso_predictions"](spark, SF).collect()}
    np.testing.assert_allclose([got[i] for i in ids], y.mean() + z @ b, atol=1e-4)


def test_cubic_filling_against_whole_systems(spark, con):
    """Every piece's four coefficients from one system: values, two slopes and curvatures at the points, and no knot at the second and last but one."""
    rows = con.sql(f"WITH {queries.GRID} SELECT s, m, t, n, pos, v FROM full_grid ORDER BY s, m, t, pos").fetchall()
    got = {(r["subjectID"], r["metric"], r["tractID"], r["nodeID"]): r["value"] for r in queries.QUERIES["interpolated_cubic"](spark, SF).collect()}
    assert len(got) == len(rows)
    series = collections.defaultdict(list)
    for s, m, t, n, pos, v in rows:
        series[s, m, t].append((n, pos, v))
    seen = 0
    for key, cells in list(series.items())[:40]:
        x, y = np.array([(p, v) for _, p, v in cells if v is not None]).reshape(-1, 2).T
        n = len(x) - 1
        for node, pos, v in cells:
            value = got[(*key, node)]
            if v is not None:
                assert value == v
            elif len(x) < 2 or not x[0] < pos < x[-1]:
                assert value is None
            elif n < 3:
                assert abs(value - np.interp(pos, x, y)) < 1e-9
            else:
                a, b = np.zeros((4 * n, 4 * n)), np.zeros(4 * n)
                power = lambda i, at, d: np.array([0.0 if k < d else np.prod(np.arange(k, k - d, -1)) * (at - x[i]) ** (k - d) for k in range(4)])  # noqa: E731, B023
                row = 0
                for i in range(n):
                    for at, value_at in ((x[i], y[i]), (x[i + 1], y[i + 1])):
                        a[row, 4 * i : 4 * i + 4], b[row] = power(i, at, 0), value_at
                        row += 1
                for i in range(1, n):
                    for d in (1, 2, *((3,) if i in (1, n - 1) else ())):
                        if row < 4 * n:
                            a[row, 4 * i - 4 : 4 * i], a[row, 4 * i : 4 * i + 4] = power(i - 1, x[i], d), -power(i, x[i], d)
                            row += 1
                if n == 2:
                    continue
                c = np.linalg.lstsq(a, b, rcond=None)[0]
                i = int(np.searchsorted(x, pos) - 1)
                assert abs(value - power(i, pos, 0) @ c[4 * i : 4 * i + 4]) < 1e-6
                seen += 1
    assert seen > 20


def test_time_warp_against_plain_clocks(spark, con):
    from nodeloom.functions.hashrand import Draws
    from nodeloom.functions.series import spline_basis

    ids, x, _ = _matrix(con, "label")
    got = collections.defaultdict(dict)
    for r in queries.QUERIES["augmented_time_warp"](spark, SF).where("sample_id < 30").collect():
        got[r["sample_id"]][r["channel"], r["step"]] = r["value"]
    at = np.linspace(0, 7, 6)
    basis = spline_basis(at, np.arange(8))
    for i, row in zip(ids[:30].tolist(), x[:30], strict=True):
        own, draws = row.reshape(8, 8), Draws("time", 7, i)  # channels by steps
        for c in range(8):
            clock = [sum(basis[s, k] * at[k] * (1 + 0.2 * draws.normal(k, c)) for k in range(6)) for s in range(8)]
            clock = np.clip(np.array(clock) * 7 / (clock[-1] or 1), 0, 7)
            want = np.interp(np.arange(8), clock, own[c])
            assert all(abs(got[i][c, s] - want[s]) < 1e-5 for s in range(8))

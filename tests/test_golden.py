"""The fixed battery of queries over the small tables, against DuckDB; date units, whatever the session's time zone."""

from datetime import datetime

import pytest

from babelframe.config import REFERENCE
from babelframe.errors import BindError, RunError
from babelframe.session import Engine
from babelframe.verify.checks import against_duckdb

from .fixtures import tables

# The queries that every build of this engine must answer alike.
GOLDEN = {
    "scan": [
        "SELECT * FROM employees", "SELECT * FROM departments", "SELECT * FROM sales", "SELECT id, name FROM employees",
    ],
    "filter": [
        f"SELECT id FROM employees WHERE {c}" for c in (
            "dept_id = 10", "dept_id <> 10", "salary < 90000", "salary >= 100000", "salary > 80000 AND active", "dept_id = 10 OR dept_id = 20", "NOT active",
            "dept_id IN (10, 30)", "dept_id NOT IN (10)", "salary BETWEEN 80000 AND 120000", "salary NOT BETWEEN 80000 AND 120000", "dept_id IS NULL",
            "dept_id IS NOT NULL", "name LIKE 'A%'", "(active AND salary > 90000) OR dept_id IS NULL",
        )
    ],
    "project": [
        f"SELECT id, {e} FROM employees" for e in (
            "salary * 0.1 AS bonus", "(salary + 1000) * 1.05 AS adj", "name || ' (active)' AS tag",
            "CASE WHEN salary > 100000 THEN 'high' WHEN salary > 80000 THEN 'mid' ELSE 'low' END AS bucket", "CAST(salary AS BIGINT) AS rounded", "-salary AS neg",
        )
    ],
    "join": [
        *(f"SELECT e.id, d.name FROM employees e {j} JOIN departments d ON e.dept_id = d.id" for j in ("INNER", "LEFT", "RIGHT", "FULL OUTER")),
        "SELECT e.id, d.id AS d_id FROM employees e CROSS JOIN departments d",
        "SELECT e.id FROM employees e INNER JOIN departments d ON e.dept_id = d.id AND d.budget > 500000",
        "SELECT e.id, d.name AS dept, s.amount FROM employees e INNER JOIN departments d ON e.dept_id = d.id INNER JOIN sales s ON s.employee_id = e.id",
    ],
    "aggregate": [
        "SELECT COUNT(*) AS n FROM employees", "SELECT COUNT(dept_id) AS n FROM employees",
        "SELECT SUM(salary) AS s, AVG(salary) AS a, MIN(salary) AS lo, MAX(salary) AS hi FROM employees",
        "SELECT dept_id, COUNT(*) AS n FROM employees GROUP BY dept_id", "SELECT dept_id, active, COUNT(*) AS n FROM employees GROUP BY dept_id, active",
        "SELECT dept_id, COUNT(*) AS n FROM employees GROUP BY dept_id HAVING COUNT(*) > 1", "SELECT COUNT(DISTINCT dept_id) AS unique_depts FROM employees",
        "SELECT dept_id, SUM(salary) FILTER (WHERE active) AS active_pay FROM employees GROUP BY dept_id",
    ],
    "sort": [
        f"SELECT id FROM employees ORDER BY {o}" for o in ("salary ASC", "dept_id DESC NULLS LAST", "active DESC, salary ASC, id ASC", "salary DESC NULLS LAST LIMIT 5", "salary DESC NULLS LAST LIMIT 3 OFFSET 2")
    ],
    "distinct": ["SELECT DISTINCT dept_id FROM employees", "SELECT DISTINCT dept_id, active FROM employees"],
    "set": [
        "SELECT id FROM employees UNION SELECT id FROM departments", "SELECT id FROM employees UNION ALL SELECT id FROM departments",
        "SELECT dept_id FROM employees INTERSECT SELECT id FROM departments", "SELECT id FROM departments EXCEPT SELECT dept_id FROM employees",
    ],
    "cte": [
        "WITH active_emps AS (SELECT id, name FROM employees WHERE active) SELECT name FROM active_emps",
        "WITH high_pay AS (SELECT id FROM employees WHERE salary > 100000), active_emps AS (SELECT id FROM employees WHERE active) SELECT id FROM high_pay UNION SELECT id FROM active_emps",
        "WITH e AS (SELECT id, dept_id, salary FROM employees) SELECT a.id FROM e a INNER JOIN e b ON a.dept_id = b.dept_id AND a.salary > b.salary",
    ],
    "subquery": [
        "SELECT id, salary - (SELECT AVG(salary) FROM employees) AS gap FROM employees",
        "SELECT name FROM employees WHERE dept_id IN (SELECT id FROM departments WHERE budget > 500000)",
        "SELECT name FROM employees WHERE dept_id NOT IN (SELECT id FROM departments WHERE budget < 200000)",
        "SELECT name FROM employees WHERE EXISTS (SELECT 1 FROM departments WHERE budget > 1000000)",
        "SELECT t.id FROM (SELECT id, salary FROM employees WHERE active) AS t WHERE t.salary > 90000",
    ],
    "window": [
        "SELECT id, dept_id, ROW_NUMBER() OVER (PARTITION BY dept_id ORDER BY salary DESC NULLS LAST) AS rn FROM employees",
        "SELECT id, RANK() OVER (ORDER BY salary DESC NULLS LAST) AS r FROM employees", "SELECT id, DENSE_RANK() OVER (ORDER BY salary DESC NULLS LAST) AS dr FROM employees",
        "SELECT id, dept_id, SUM(salary) OVER (PARTITION BY dept_id ORDER BY id) AS running FROM employees",
    ],
    "ordering": ["SELECT id, dept_id FROM employees ORDER BY dept_id ASC"],
}


@pytest.fixture(scope="module")
def db(spark):
    return tables(spark)


@pytest.mark.parametrize("kind", GOLDEN)
def test_golden(spark, db, kind):
    engine = Engine(spark, REFERENCE, db)
    for sql in GOLDEN[kind]:
        assert against_duckdb(engine.sql(sql), sql, db), sql


def test_division_by_zero(spark, db):
    assert Engine(spark, REFERENCE, db).rows("SELECT id, salary / 0.0 AS x FROM employees LIMIT 1")[0]["x"] is None
    with pytest.raises(RunError):
        Engine(spark, REFERENCE.with_semantics(division_by_zero="error"), db).rows("SELECT salary / 0.0 AS x FROM employees")


#: Unit, first, second, boundaries or whole units between them.
DIFFERENCES = [
    ("day", "2024-01-01", "2024-01-31", 30), ("days", "2024-01-31", "2024-01-01", -30), ("week", "2024-01-01", "2024-01-08", 1), ("week", "2024-01-01", "2024-01-07", 0),
    ("weeks", "2024-01-08", "2024-01-01", -1), ("week", "2024-01-07", "2024-01-01", 0), ("month", "2024-01-31", "2024-02-01", 1), ("month", "2024-02-01", "2024-01-31", -1),
    ("months", "2024-01-01", "2025-01-01", 12), ("quarter", "2024-01-01", "2024-04-01", 1), ("quarter", "2024-01-01", "2024-12-31", 3), ("year", "2024-06-15", "2026-01-01", 2),
    ("years", "2026-01-01", "2024-06-15", -2), ("hour", "2024-01-01 00:00:00", "2024-01-01 05:00:00", 5), ("hours", "2024-01-01 05:00:00", "2024-01-01 00:00:00", -5),
    ("minute", "2024-01-01 00:00:00", "2024-01-01 01:30:00", 90), ("second", "2024-01-01 00:00:00", "2024-01-01 00:00:30", 30),
    ("hour", "2024-03-10 01:00:00", "2024-03-10 04:00:00", 3),
]


@pytest.mark.parametrize("zone", ["UTC", "America/New_York"])
def test_dates_in_any_time_zone(spark, db, zone):
    engine, was = Engine(spark, REFERENCE, db), spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", zone)
    try:
        at = lambda v: f"{'TIMESTAMP' if ' ' in v else 'DATE'} '{v}'"
        cols = ", ".join(f"DATE_DIFF('{u}', {at(a)}, {at(b)}) AS d{i}" for i, (u, a, b, _) in enumerate(DIFFERENCES))
        assert list(engine.rows(f"SELECT {cols} FROM regions LIMIT 1")[0].values()) == [n for *_, n in DIFFERENCES]
        units = ("year", "quarter", "month", "week", "day", "hour", "minute", "second")
        cut = engine.rows("SELECT " + ", ".join(f"DATE_TRUNC('{u}', TIMESTAMP '2024-03-10 02:30:59.25') AS {u}s" for u in units) + " FROM regions LIMIT 1")[0]
        want = [(2024, 1, 1), (2024, 1, 1), (2024, 3, 1), (2024, 3, 4), (2024, 3, 10), (2024, 3, 10, 2), (2024, 3, 10, 2, 30), (2024, 3, 10, 2, 30, 59)]
        assert list(cut.values()) == [datetime(*w) for w in want]
    finally:
        spark.conf.set("spark.sql.session.timeZone", was)


def test_lag_and_lead_defaults(spark):
    db = {"t": spark.createDataFrame([(1, None), (2, 5), (3, None), (4, 7)], "k long, v long")}
    get = lambda e: [r["x"] for r in Engine(spark, REFERENCE, db).rows(f"SELECT k, {e} OVER (ORDER BY k) AS x FROM t ORDER BY k")]
    assert get("LAG(v, 1, 99)") == [99, None, 5, None] and get("LEAD(v, 1, 99)") == [5, None, 7, 99]
    assert get("LAG(v, 2, 0)") == [0, 0, None, 5] and get("LAG(v)") == [None, None, 5, None] and get("LAG(v, 0, 9)") == [None, 5, None, 7]
    assert get("LAG(v, 1, 99) IGNORE NULLS") == [99, 99, 5, 5] and get("LEAD(v, 2, 99) IGNORE NULLS") == [7, 99, 99, 99] and get("LAG(v, 2) IGNORE NULLS") == [None] * 4


@pytest.mark.parametrize("n", (1, 2, 3))
def test_lag_and_lead_past_nulls_go_over_a_partition_once(spark, n):
    values = [None if k % 7 in (0, 1, 4) else k for k in range(500)]
    db = {"t": spark.createDataFrame(list(enumerate(values)), "k long, v long")}
    over = "IGNORE NULLS OVER (ORDER BY k)"
    df = Engine(spark, REFERENCE, db).sql(f"SELECT k, LAG(v, {n}) {over} AS a, LAG(v, {n}, k) {over} AS b, LEAD(v, {n}) {over} AS c, LEAD(v, {n}, -1) {over} AS d FROM t")
    # Spark computes a frame to the partition's end anew for each row
    assert "unboundedfollowing" not in df._jdf.queryExecution().executedPlan().toString().lower()
    for r in df.collect():
        before, after = [v for v in values[: r["k"]] if v is not None], [v for v in values[r["k"] + 1 :] if v is not None]
        a, c = before[-n] if len(before) >= n else None, after[n - 1] if len(after) >= n else None
        assert (r["a"], r["b"], r["c"], r["d"]) == (a, r["k"] if a is None else a, c, -1 if c is None else c)


def test_correlated_scalar_with_group_by(spark, db):
    engine = Engine(spark, REFERENCE, db)
    got = engine.rows("SELECT e.id, (SELECT COUNT(*) FROM sales s WHERE s.employee_id = e.id GROUP BY s.employee_id) AS n FROM employees e ORDER BY e.id")
    assert [r["n"] for r in got] == [2, 2, 2, None, 3, 1, None, None]
    with pytest.raises(RunError):  # two regions for employee 2 and more for others: several rows
        engine.rows("SELECT e.id, (SELECT COUNT(*) FROM sales s WHERE s.employee_id = e.id GROUP BY s.id) AS n FROM employees e")
    with pytest.raises(RunError):  # an error of the JVM carries its stage too
        engine.rows("SELECT e.id, (SELECT id FROM sales) AS n FROM employees e")


def test_recursion_beside_others(spark, db):
    sql = "WITH RECURSIVE top AS (SELECT id FROM categories WHERE parent_id IS NULL), r AS (SELECT id, 0 AS d FROM top UNION ALL SELECT c.id, r.d + 1 FROM categories c JOIN r ON c.parent_id = r.id) SELECT d, COUNT(*) AS n FROM r GROUP BY d ORDER BY d"
    assert [tuple(r.values()) for r in Engine(spark, REFERENCE, db).rows(sql)] == [(0, 1), (1, 2), (2, 3), (3, 1)]
    with pytest.raises(RunError):
        Engine(spark, REFERENCE, db, max_recursive_rows=3).sql(sql)
    none = "WITH RECURSIVE r AS (SELECT id FROM categories WHERE id < 0 UNION SELECT c.id FROM categories c JOIN r ON c.parent_id = r.id) SELECT COUNT(*) AS n FROM r"
    assert Engine(spark, REFERENCE, db).rows(none) == [{"n": 0}]


def test_global_window_aggregates_are_partial(spark, db):
    df = Engine(spark, REFERENCE, db).sql("SELECT id, SUM(salary) OVER () AS s, COUNT(*) OVER () AS n FROM employees")
    assert "Window" not in df._jdf.queryExecution().executedPlan().toString() and {(r["s"], r["n"]) for r in df.collect()} == {(715000.0, 8)}
    with pytest.raises(BindError):
        Engine(spark, REFERENCE, db).sql("SELECT LAG(id) OVER () AS x FROM employees")


def test_labels_are_checked():
    from babelframe.config import Dialect

    with pytest.raises(ValueError):
        Dialect.from_dict({"name": "x", "surface": {"join_syntax": "spaghetti"}})

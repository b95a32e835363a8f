"""SQL end to end on the small tables, against expected rows and DuckDB."""

import pytest

from babelframe.config import REFERENCE
from babelframe.errors import BindError, ParseError, RunError
from babelframe.session import Engine
from babelframe.verify.checks import against_duckdb, broken_properties

from .fixtures import tables

SAME_IN_DUCKDB = [
    "SELECT id, name FROM employees WHERE salary > 85000 OR active = FALSE",
    "SELECT e.name, d.name AS dept FROM employees e LEFT JOIN departments d ON e.dept_id = d.id",
    "SELECT d.name, r.name AS region FROM departments d FULL JOIN regions r ON d.region_id = r.id",
    "SELECT d.name, COUNT(e.id) AS n, AVG(e.salary) AS pay FROM departments d LEFT JOIN employees e ON e.dept_id = d.id GROUP BY d.name HAVING COUNT(e.id) >= 1",
    "SELECT name FROM employees WHERE dept_id IN (SELECT id FROM departments WHERE region_id = 1)",
    "SELECT name FROM employees WHERE dept_id NOT IN (SELECT dept_id FROM employees WHERE salary > 100000)",
    "SELECT name FROM departments d WHERE NOT EXISTS (SELECT 1 FROM employees e WHERE e.dept_id = d.id)",
    "SELECT a.name, b.name AS boss FROM employees a JOIN employees b ON a.manager_id = b.id",
    "SELECT employee_id, amount, SUM(amount) OVER (PARTITION BY employee_id ORDER BY sold_on, id) AS running FROM sales",
    "SELECT region_id, COUNT(*) AS n, SUM(amount) AS s FROM sales GROUP BY region_id",
    "SELECT id, CASE WHEN amount IS NULL THEN 'none' WHEN amount >= 100 THEN 'big' ELSE 'small' END AS size FROM sales",
    "SELECT dept_id FROM employees UNION SELECT id FROM departments",
    "SELECT region_id FROM sales EXCEPT SELECT id FROM regions",
    "SELECT region_id FROM sales INTERSECT SELECT region_id FROM departments",
    "SELECT COUNT(DISTINCT region_id) AS n, COUNT(*) FILTER (WHERE amount > 60) AS big FROM sales",
    "WITH t AS (SELECT employee_id AS e, SUM(amount) AS s FROM sales GROUP BY employee_id) SELECT e, s FROM t WHERE s > (SELECT AVG(s) FROM t)",
    "SELECT e.name, (SELECT MAX(s.amount) FROM sales s WHERE s.employee_id = e.id) AS best FROM employees e",
    "SELECT name, RANK() OVER (ORDER BY salary DESC NULLS LAST) AS r FROM employees",
    "SELECT DISTINCT active, dept_id IS NULL AS free FROM employees",
]


@pytest.fixture(scope="module")
def db(spark):
    return tables(spark)


@pytest.fixture(scope="module")
def engine(spark, db):
    return Engine(spark, REFERENCE, db)


@pytest.mark.parametrize("sql", SAME_IN_DUCKDB)
def test_against_duckdb(engine, db, sql):
    df = engine.sql(sql)
    assert against_duckdb(df, sql, db)
    assert broken_properties(engine.parse(sql), [tuple(r) for r in df.collect()], len(df.columns)) == []


def rows(engine, sql):
    return [tuple(r) for r in engine.sql(sql).collect()]


def test_names(engine):
    assert engine.sql("SELECT id + 1, id + 2, name AS Label FROM regions").columns == ["_col", "_col_1", "label"]
    assert engine.sql("SELECT * FROM departments d JOIN regions r ON d.region_id = r.id").columns == ["id", "name", "region_id", "budget"]
    assert engine.sql("SELECT r.* FROM departments d JOIN regions r ON d.region_id = r.id").columns == ["id", "name"]


def test_errors_carry_their_stage(engine):
    with pytest.raises(ParseError):
        engine.sql("SELECT FROM regions")
    with pytest.raises(ParseError):
        engine.sql("")
    for bad in ("SELECT nope FROM regions", "SELECT id FROM nowhere", "SELECT d.id, name FROM departments d JOIN regions r ON TRUE", "SELECT name, COUNT(*) FROM regions", "SELECT id FROM regions WHERE COUNT(*) > 1", "SELECT NOSUCH(id) FROM regions", "SELECT id FROM regions WHERE id", "SELECT LAG(id) OVER (PARTITION BY name) AS x FROM regions", "SELECT id FROM regions UNION SELECT id, name FROM regions"):
        with pytest.raises(BindError):
            engine.sql(bad)


def test_null_order_defaults(engine):
    assert [r[0] for r in rows(engine, "SELECT dept_id FROM employees ORDER BY dept_id")][-1] is None
    assert [r[0] for r in rows(engine, "SELECT dept_id FROM employees ORDER BY dept_id DESC")][0] is None


@pytest.mark.parametrize(("mode", "expected"), [("null", None), ("inf", float("inf"))])
def test_division_by_zero(spark, db, mode, expected):
    e = Engine(spark, REFERENCE.with_semantics(division_by_zero=mode), db)
    assert rows(e, "SELECT amount / 0.0 AS q FROM sales WHERE id = 101") == [(expected,)]


def test_division_by_zero_error(spark, db):
    e = Engine(spark, REFERENCE.with_semantics(division_by_zero="error"), db)
    with pytest.raises(RunError):
        e.rows("SELECT amount / 0.0 AS q FROM sales")
    with pytest.raises(RunError):
        e.rows("SELECT id % 0 AS q FROM sales")


def test_integer_division(spark, db):
    cut = Engine(spark, REFERENCE.with_semantics(integer_division="truncate"), db)
    assert rows(cut, "SELECT -7 / 2 AS q, 7 / 2.0 AS f FROM regions LIMIT 1") == [(-3, 3.5)]
    assert rows(Engine(spark, REFERENCE, db), "SELECT 7 / 2 AS q FROM regions LIMIT 1") == [(3.5,)]


def test_truthiness(spark, db):
    loose = Engine(spark, REFERENCE.with_semantics(boolean_truthiness="c_style"), db)
    assert len(rows(loose, "SELECT id FROM sales WHERE amount")) == 8
    assert len(rows(loose, "SELECT id FROM regions WHERE name AND NOT 0")) == 3


def test_sum_of_empty(spark, db, engine):
    sql = "SELECT SUM(amount) AS s, COUNT(amount) AS n FROM sales WHERE id < 0"
    assert rows(engine, sql) == [(None, 0)]
    assert rows(Engine(spark, REFERENCE.with_semantics(sum_of_empty_returns_null=False), db), sql) == [(0.0, 0)]


def test_count_distinct_null(spark, db, engine):
    sql = "SELECT COUNT(DISTINCT region_id) AS n FROM sales"
    assert rows(engine, sql) == [(2,)]
    assert rows(Engine(spark, REFERENCE.with_semantics(count_distinct_null="included"), db), sql) == [(3,)]


def test_scope_knobs(spark, db):
    strict = Engine(spark, REFERENCE.with_semantics(group_by_accepts_select_aliases=False, select_resolves_through_group_by=False), db)
    with pytest.raises(BindError):
        strict.sql("SELECT dept_id AS d, COUNT(*) AS n FROM employees GROUP BY d")
    with pytest.raises(BindError):
        strict.sql("SELECT id + 1, COUNT(*) AS n FROM employees GROUP BY id + 1")
    assert len(rows(strict, "SELECT dept_id, COUNT(*) AS n FROM employees GROUP BY dept_id")) == 4


def test_concat_choices(spark, db):
    plus = Engine(spark, REFERENCE.with_semantics(string_concat_op="+"), db)
    assert rows(plus, "SELECT name + '!' AS x, id + 1 AS y FROM regions WHERE id = 1") == [("NA!", 2)]
    only = Engine(spark, REFERENCE.with_semantics(string_concat_op="CONCAT_only"), db)
    with pytest.raises(BindError):
        only.sql("SELECT name || 'x' AS x FROM regions")
    assert rows(only, "SELECT CONCAT(name, 'x') AS x FROM regions WHERE id = 1") == [("NAx",)]


def test_implicit_coercion_rules(spark, db):
    e = Engine(spark, REFERENCE.with_semantics(implicit_coercion=({"from": "TEXT", "to": "INT", "rule": "forbidden"},)), db)
    with pytest.raises(BindError):
        e.sql("SELECT id FROM regions WHERE name = 1")
    assert rows(Engine(spark, REFERENCE, db), "SELECT id FROM regions WHERE name = 1") == []


def test_identifier_quoting(spark, db, engine):
    assert engine.sql('SELECT "id" AS "Mixed Case" FROM regions').columns == ["Mixed Case"]
    with pytest.raises(BindError):
        engine.sql('SELECT "ID" FROM regions')
    loose = Engine(spark, REFERENCE.with_semantics(quoted_identifiers_case_sensitive=False), db)
    assert len(rows(loose, 'SELECT "ID" FROM regions')) == 3
    assert Engine(spark, REFERENCE.with_semantics(identifier_case_fold="upper"), db).sql("SELECT id AS k FROM regions").columns == ["K"]


def test_in_lists_keep_three_values(engine):
    assert rows(engine, "SELECT COUNT(*) AS n FROM regions WHERE id IN (9, NULL) IS NULL") == [(3,)]
    assert rows(engine, "SELECT COUNT(*) AS n FROM regions WHERE id IN ()") == [(0,)]


def test_recursion(spark, engine):
    sql = "WITH RECURSIVE t AS (SELECT id, name, 0 AS depth FROM categories WHERE parent_id IS NULL UNION ALL SELECT c.id, c.name, t.depth + 1 FROM categories c JOIN t ON c.parent_id = t.id) SELECT name, depth FROM t"
    assert sorted(rows(engine, sql)) == [("books", 1), ("computers", 2), ("electronics", 1), ("fiction", 2), ("laptops", 3), ("phones", 2), ("root", 0)]
    loop = "WITH RECURSIVE t AS (SELECT id AS k FROM regions UNION SELECT (k + 1) % 4 FROM t) SELECT k FROM t"
    assert sorted(rows(engine, loop)) == [(0,), (1,), (2,), (3,)]


def test_with_ties(spark):
    df = spark.createDataFrame([(1, 10), (1, 11), (1, 12), (2, 13), (3, 14)], "x long, y long")
    assert sorted(rows(Engine(spark, catalog={"t": df}), "SELECT y FROM t ORDER BY x LIMIT 2 WITH TIES")) == [(10,), (11,), (12,)]


@pytest.mark.parametrize(
    ("unit", "a", "b", "expected"),
    [("day", "2024-01-01", "2024-01-31", 30), ("days", "2024-01-31", "2024-01-01", -30), ("week", "2024-01-01", "2024-01-08", 1), ("week", "2024-01-01", "2024-01-07", 0), ("weeks", "2024-01-08", "2024-01-01", -1),
     ("week", "2024-01-07", "2024-01-01", 0), ("month", "2024-01-31", "2024-02-01", 1), ("month", "2024-02-01", "2024-01-31", -1), ("months", "2024-01-01", "2025-01-01", 12), ("quarter", "2024-01-01", "2024-04-01", 1),
     ("quarter", "2024-01-01", "2024-12-31", 3), ("year", "2024-06-15", "2026-01-01", 2), ("years", "2026-01-01", "2024-06-15", -2)],
)
def test_date_differences(engine, unit, a, b, expected):
    assert rows(engine, f"SELECT DATE_DIFF('{unit}', DATE '{a}', DATE '{b}') AS d FROM regions LIMIT 1") == [(expected,)]


@pytest.mark.parametrize(("unit", "a", "b", "expected"), [("hour", "00:00:00", "05:00:00", 5), ("hours", "05:00:00", "00:00:00", -5), ("minute", "00:00:00", "01:30:00", 90), ("second", "00:00:00", "00:00:30", 30), ("hour", "00:30:00", "00:00:00", 0)])
def test_time_differences(engine, unit, a, b, expected):
    assert rows(engine, f"SELECT DATE_DIFF('{unit}', TIMESTAMP '2024-01-01 {a}', TIMESTAMP '2024-01-01 {b}') AS d FROM regions LIMIT 1") == [(expected,)]


def test_unknown_date_unit(engine):
    with pytest.raises(BindError):
        engine.sql("SELECT DATE_DIFF('fortnight', hired_on, hired_on) AS d FROM employees")

"""Surfaces: every dialect parses its own spelling, rejects dropped ones, and agrees with the reference on plain queries."""

import pytest

from babelframe.config import FOLDER, REFERENCE, Dialect, list_dialects, load_dialect, save_dialect
from babelframe.errors import ParseError
from babelframe.session import Engine
from babelframe.sql.parser import parse
from babelframe.sql.passes import fold_constants, limit_with_ties
from babelframe.verify.checks import dialects_agree, to_surface

from .fixtures import tables

PLAIN = [
    "SELECT name, salary FROM employees WHERE salary >= 80000 AND NOT active = FALSE ORDER BY name",
    "SELECT dept_id, COUNT(*) AS n FROM employees WHERE dept_id IS NOT NULL GROUP BY dept_id HAVING COUNT(*) > 1",
    "SELECT e.name, d.name AS dept FROM employees AS e LEFT JOIN departments AS d ON e.dept_id = d.id",
    "SELECT CASE WHEN salary > 100000 THEN 'high' ELSE 'low' END AS band FROM employees WHERE salary IS NOT NULL",
    "SELECT name FROM employees WHERE dept_id IN (10, 20) AND salary BETWEEN 80000 AND 130000",
    "SELECT name FROM employees ORDER BY name LIMIT 3 OFFSET 0",
    "WITH t AS (SELECT id FROM regions) SELECT COUNT(*) AS n FROM t",
]


@pytest.fixture(scope="module")
def db(spark):
    return tables(spark)


def test_there_are_forty():
    assert len(list_dialects()) == 41


@pytest.mark.parametrize("name", list_dialects())
def test_dialect_parses_its_own_spelling(name):
    d = load_dialect(name)
    for sql in PLAIN:
        parse(to_surface(sql, d), d)


@pytest.mark.parametrize("name", [n for n in list_dialects() if load_dialect(n).surface.keywords])
def test_renamed_keywords_are_rejected_as_they_were(name):
    d = load_dialect(name)
    renamed = {k for k, v in d.surface.keywords.items() if k in ("select", "where", "with", "distinct")}
    sqls = {"select": "SELECT id FROM regions", "where": "SELECT id FROM regions WHERE id = 1", "with": "WITH t AS (SELECT id FROM regions) SELECT id FROM t", "distinct": "SELECT DISTINCT id FROM regions"}
    for k in renamed:
        good = to_surface(sqls[k], d)
        bad = good.replace(" ".join(d.surface.keyword(k)), {"select": "SELECT", "where": "WHERE", "with": "WITH", "distinct": "DISTINCT"}[k], 1)
        parse(good, d)
        with pytest.raises(ParseError):
            parse(bad, d)


def test_dropped_operators_and_missing_terminators_are_rejected():
    only = REFERENCE.with_surface(operators={"neq": ["<>"], "null_safe_eq": []}, requires_terminator=True)
    parse("SELECT id FROM t WHERE id <> 1;", only)
    for bad in ("SELECT id FROM t WHERE id != 1;", "SELECT id FROM t WHERE id <> 1", "SELECT id FROM t WHERE id IS NOT DISTINCT FROM 1;"):
        with pytest.raises(ParseError):
            parse(bad, only)


def test_comments_and_quotes():
    d = REFERENCE.with_surface(comments=("#", "//"), identifier_quote="bracket", string_quote="double")
    assert parse('SELECT [a b] FROM t # note\n WHERE x = "y" // end', d).body.where.right.value == "y"
    with pytest.raises(ParseError):
        parse("SELECT a FROM t -- note", d)


@pytest.mark.parametrize("sql", PLAIN)
def test_dialects_agree(spark, db, sql):
    names = ["postgres_clone", "sqlite_clone", "mariadb_bigquery_oracle_rows", "pipe_redshift_maria", "oracle_maria_modconcat", "snowdb2_dotmod_nullsafe"]
    engines = [Engine(spark, REFERENCE, db), *(Engine(spark, n, db) for n in names)]
    assert dialects_agree(engines, sql) == []


def test_save_and_load(tmp_path):
    for name in list_dialects(FOLDER):
        d = load_dialect(name)
        save_dialect(d, tmp_path)
        assert load_dialect(name, tmp_path).to_dict() == d.to_dict()
    with pytest.raises(KeyError):
        load_dialect("nope")
    with pytest.raises(ValueError):
        Dialect.from_dict({"name": "x", "semantics": {"division_by_zero": "maybe"}})


def test_extension_lanes(spark, db):
    from pyspark.sql import functions as F

    ran = []

    def note(tree, semantics):
        ran.append(semantics)
        return tree

    e = Engine(spark, REFERENCE, db, functions={"TWICE": lambda a, s: a[0] * 2, "UPPER": lambda a, s: F.lit("never")}, effects={"text_eq": lambda a, b, s: F.lower(a) == F.lower(b), "text_neq": lambda a, b, s: None}, passes=[fold_constants, note])
    assert e.rows("SELECT TWICE(id) AS x, UPPER(name) AS u FROM regions WHERE name = 'na' AND TRUE") == [{"x": 2, "u": "NA"}]
    assert len(e.rows("SELECT id FROM regions WHERE name <> 'na'")) == 3
    assert len(ran) == 2
    ties = Engine(spark, REFERENCE, db, passes=[limit_with_ties])
    assert len(ties.rows("SELECT id FROM sales ORDER BY amount LIMIT 3")) == 4
    with pytest.raises(Exception, match="returned nothing"):
        Engine(spark, REFERENCE, db, passes=[lambda t, s: None]).sql("SELECT id FROM regions")

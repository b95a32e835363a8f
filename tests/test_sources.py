import json
import sqlite3

from babelframe.config import REFERENCE
from babelframe.session import Engine
from babelframe.sources.catalog import Catalog
from babelframe.sources.tables import event_table, json_tables, row_dicts, sqlite_tables, write_parquet, write_report

from .fixtures import REGIONS, tables


def test_parquet_catalog(spark, tmp_path):
    for n, df in tables(spark).items():
        write_parquet(df, f"{tmp_path}/{n}.parquet")
    c = Catalog.parquet(spark, str(tmp_path), ["regions", "sales"])
    assert sorted(tuple(r.values()) for r in row_dicts(Engine(spark, REFERENCE, c).sql("SELECT * FROM regions"))) == REGIONS
    assert "regions(id bigint, name string)" in c.describe()


def test_sqlite(spark, tmp_path):
    path = tmp_path / "x.db"
    con = sqlite3.connect(path)
    con.execute('CREATE TABLE "my table" ("a b" INTEGER, x REAL, d DATE, "a-b" TEXT)')
    con.executemany('INSERT INTO "my table" VALUES (?, ?, ?, ?)', [(1, 1.5, "2024-01-01", "t"), ("bad", "bad", None, b"q")])
    con.execute("CREATE TABLE empty (k INT)")
    con.commit()
    con.close()
    got = sqlite_tables(spark, str(path))
    assert [tuple(r) for r in got["my_table"].collect()] == [(1, 1.5, "2024-01-01", "t"), (None, None, None, "q")]
    assert got["my_table"].columns == ["a_b", "x", "d", "a_b_2"] and got["empty"].count() == 0


def test_json_tables(spark, tmp_path):
    path = tmp_path / "t.jsonl"
    path.write_text(json.dumps({"id": "1-2", "header": ["No.", "Name"], "types": ["real", "text"], "rows": [["1,200", "a"], ["x", "b"]]}) + "\n")
    assert [tuple(r) for r in json_tables(spark, str(path))["c_1_2"].collect()] == [(1200.0, "a"), (None, "b")]


def test_event_table(spark, tmp_path):
    a, b = event_table(spark, 500), event_table(spark, 500).repartition(7)
    assert len(a.columns) == 30 and a.exceptAll(b).count() == 0 and event_table(spark, 500, seed=1).exceptAll(a).count() > 0
    e = Engine(spark, REFERENCE, {"github_events": a})
    assert e.rows("SELECT COUNT(DISTINCT repo_name) AS repos FROM github_events") == [{"repos": 20}]
    write_report(f"{tmp_path}/r.json", {"rows": 1})

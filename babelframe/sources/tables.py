"""Sources other than Parquet, and sinks."""

from __future__ import annotations

import datetime as dt
import json
import re
import sqlite3
from collections.abc import Iterable, Sequence
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.semantics import SPARK_TYPE


def literal_table(spark: SparkSession, rows: Iterable[Sequence[Any]], columns: dict[str, str]) -> DataFrame:
    """Rows and {name: kind}, kinds as in casts: INT FLOAT TEXT BOOL DATE TIMESTAMP."""
    schema = ", ".join(f"`{n}` {SPARK_TYPE[k]}" for n, k in columns.items())
    kinds = list(columns.values())
    made = [tuple(float(v) if k == "FLOAT" and v is not None else v for v, k in zip(r, kinds, strict=True)) for r in rows]
    return spark.createDataFrame(made, schema)


def write_parquet(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").parquet(path)


def row_dicts(df: DataFrame) -> list[dict[str, Any]]:
    return [r.asDict() for r in df.collect()]


def write_report(path: str, report: dict[str, Any]) -> None:
    with open(path, "w") as f:
        json.dump(report, f, indent=1, default=str)


def _affinity(declared: str) -> str:
    """SQLite's column affinity as a kind: whole numbers, other numbers, text for everything else."""
    d = declared.upper()
    if "INT" in d:
        return "INT"
    if any(w in d for w in ("REAL", "FLOA", "DOUB", "NUM", "DEC")):
        return "FLOAT"
    return "TEXT"


def clean_names(names: Iterable[str]) -> list[str]:
    """Names fit for unquoted use, made distinct by a number."""
    out: list[str] = []
    for n in names:
        base = re.sub(r"\W+", "_", n).strip("_") or "col"
        base = f"c_{base}" if base[0].isdigit() else base
        name, k = base, 2
        while name.lower() in {o.lower() for o in out}:
            name, k = f"{base}_{k}", k + 1
        out.append(name)
    return out


def _as_kind(value: Any, kind: str) -> Any:
    """SQLite lets any cell hold anything; what doesn't fit its column is NULL."""
    if value is None:
        return None
    try:
        if kind == "INT":
            return int(value) if not isinstance(value, float) or value.is_integer() else None
        if kind == "FLOAT":
            return float(value)
        return value if isinstance(value, str) else value.decode("utf-8", "replace") if isinstance(value, bytes) else str(value)
    except (TypeError, ValueError):
        return None


def sqlite_tables(spark: SparkSession, path: str, batch: int = 100_000) -> dict[str, DataFrame]:
    """Every table of a SQLite file. The file is local to the driver and is read in batches."""
    out: dict[str, DataFrame] = {}
    con = sqlite3.connect(f"file:{path}?mode=ro", uri=True)
    con.text_factory = lambda b: b.decode("utf-8", "replace")
    try:
        tables = [r[0] for r in con.execute("SELECT name FROM sqlite_master WHERE type = 'table' AND name NOT LIKE 'sqlite_%' ORDER BY name")]
        for raw, name in zip(tables, clean_names(tables), strict=True):
            quoted = '"' + raw.replace('"', '""') + '"'
            info = con.execute(f"PRAGMA table_info({quoted})").fetchall()
            kinds = [_affinity(i[2] or "") for i in info]
            names = clean_names(i[1] for i in info)
            schema = ", ".join(f"`{n}` {SPARK_TYPE[k]}" for n, k in zip(names, kinds, strict=True))
            cur, df = con.execute(f"SELECT * FROM {quoted}"), None
            while rows := cur.fetchmany(batch):
                part = spark.createDataFrame([tuple(_as_kind(v, k) for v, k in zip(r, kinds, strict=True)) for r in rows], schema)
                df = part if df is None else df.union(part)
            out[name] = df if df is not None else spark.createDataFrame([], schema)
    finally:
        con.close()
    return out


def json_tables(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """A JSON-lines file with a table a line: id, header, types (real or text) and rows. Numbers that don't parse are NULL."""
    lines = spark.read.schema("id string, header array<string>, types array<string>, rows array<array<string>>").json(path)
    out = {}
    for t in lines.select("id", "header", "types").collect():  # names only; the rows stay with the executors
        names = clean_names(t["header"])
        body = lines.where(F.col("id") == t["id"]).select(F.explode("rows").alias("r"))
        number = F.regexp_replace  # thousands separators go before the cast
        cols = [(number(F.col("r")[i], ",", "").try_cast("double") if k == "real" else F.col("r")[i]).alias(n) for i, (n, k) in enumerate(zip(names, t["types"], strict=True))]
        out[clean_names([t["id"]])[0]] = body.select(*cols)
    return out


#: Event types of the synthetic event table and their weights.
EVENT_TYPES = {
    "WatchEvent": 30, "PushEvent": 40, "PullRequestEvent": 10, "IssueCommentEvent": 8, "IssuesEvent": 8, "CreateEvent": 6, "DeleteEvent": 2, "ForkEvent": 5,
    "PullRequestReviewEvent": 3, "PullRequestReviewCommentEvent": 3, "ReleaseEvent": 2, "MemberEvent": 1, "GollumEvent": 1, "CommitCommentEvent": 1,
}
_TEXT = "file_time event_type actor_login repo_name created_at updated_at action commit_id body ref title labels state assignee author_association closed_at merged_at release_tag_name release_name review_state".split()
_NUMBERS = "comment_id number locked comments merged commits additions deletions changed_files push_size".split()


def event_table(spark: SparkSession, rows: int = 5000, seed: int = 219, actors: int = 20, repos: int = 20) -> DataFrame:
    """Repository events, 30 columns, the same for a seed whatever the partitioning and time zone. Made by the executors, column by column.

    A draw of n for a purpose is the first eight hexadecimal digits of md5('seed:purpose:id') modulo n. Times are ISO text and absent text is ''; body and title may be NULL.
    """
    h = lambda salt, n: F.conv(F.substring(F.md5(F.concat(F.lit(f"{seed}:{salt}:"), F.col("id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % n
    base = spark.range(rows)
    pick, upto, kind = h("type", sum(EVENT_TYPES.values())), 0, None
    for name, weight in EVENT_TYPES.items():
        upto += weight
        kind = F.when(pick < upto, name) if kind is None else kind.when(pick < upto, name)
    when = F.lit(dt.datetime(2015, 1, 1)).cast("timestamp_ntz") + F.make_dt_interval(days=h("day", 11 * 365).cast("int"), secs=h("second", 86400))
    df = base.select("id", kind.alias("event_type"), F.substring(when.cast("string"), 1, 19).alias("created_at"))
    push, pull, issue = (F.col("event_type") == x for x in ("PushEvent", "PullRequestEvent", "IssuesEvent"))
    action = F.when(pull | issue, F.element_at(F.array(*map(F.lit, ("opened", "closed", "reopened"))), (h("action", 3) + 1).cast("int"))).when(F.col("event_type") == "WatchEvent", "started").otherwise("")
    made = {
        "file_time": F.concat(F.substring("created_at", 1, 13), F.lit(":00:00")), "actor_login": F.concat(F.lit("actor"), h("actor", actors).cast("string")),
        "repo_name": F.concat(F.lit("org/repo"), h("repo", repos).cast("string")), "updated_at": F.col("created_at"), "action": action,
        "commit_id": F.when(push, F.sha1(F.col("id").cast("string"))).otherwise(""), "body": F.when(h("body", 3) > 0, F.concat(F.lit("body "), F.col("id").cast("string"))),
        "ref": F.when(push, "refs/heads/main").otherwise(""), "title": F.when(pull | issue, F.concat(F.lit("title "), h("title", 500).cast("string"))),
        "labels": F.when(issue, "bug,help wanted").otherwise(""), "state": F.when(pull | issue, F.when(action == "closed", "closed").otherwise("open")).otherwise(""),
        "author_association": F.element_at(F.array(*map(F.lit, ("NONE", "MEMBER", "CONTRIBUTOR"))), (h("assoc", 3) + 1).cast("int")),
        "closed_at": F.when(action == "closed", F.col("created_at")).otherwise(""), "merged_at": F.when(pull & (action == "closed"), F.col("created_at")).otherwise(""),
        "number": F.when(pull | issue, h("number", 9000)).otherwise(0), "comments": h("comments", 20), "merged": (pull & (action == "closed")).cast("bigint"),
        "commits": F.when(pull | push, h("commits", 9) + 1).otherwise(0), "additions": F.when(push | pull, h("additions", 400)).otherwise(0),
        "deletions": F.when(push | pull, h("deletions", 200)).otherwise(0), "changed_files": F.when(push | pull, h("files", 30)).otherwise(0), "push_size": F.when(push, h("push", 12) + 1).otherwise(0),
    }
    cols = {c: made.get(c, F.col(c) if c in df.columns else F.lit("")).cast("string") for c in _TEXT} | {c: made.get(c, F.lit(0)).cast("bigint") for c in _NUMBERS}
    return df.select(*(v.alias(k) for k, v in cols.items()))


__all__ = ["event_table", "json_tables", "literal_table", "row_dicts", "sqlite_tables", "write_parquet", "write_report"]

"""WARC records with a Merkle fixity audit.

Pages become WARC records; FILE_SPAN consecutive page_ids make a file, in which records stand in order of page_id
with their offsets. The tree over a replica: a leaf is the SHA-256 of a record's bytes with its offset range; a node is
the SHA-256 of its children's hashes in order with the range that they cover, FANOUT children to a node, first within a
file, in as many levels as the largest file needs, and then over files, up to one root. Every level is a stored table,
so an audit of two replicas compares the roots, then reads on each level only the children of the nodes that differ,
down to the records.

Records are hashed where they are read; no task shuffles a page's text, and a node gathers FANOUT hashes. Equal records
are one leaf with a number, counted by a partial aggregation. Places come from the sums of cells, a cell being the
records of one page_id that share four digits of their hash, plus the place within the cell. So neither a page_id that
a third of all rows share, nor rows without any, nor repeats of one row make a large sort.

Defined results: null url and html are empty; rows without a page_id are in file -1, before those with one; repeated rows
are records of their own, next to each other; a record that one replica lacks counts as a mismatch, as does one at another
offset, so a lost record marks those after it in its file; equal replicas end at the root; empty tables have no tree and
an empty report; other columns are not read. The date of a record, which pages don't have, is the parameter `date`.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stored

FILE_SPAN, FANOUT = 1024, 16
DATE = "2000-01-01T00:00:00Z"


def record_bytes(page_id: Column, url: Column, html: Column, date: str = DATE) -> Column:
    body = F.coalesce(html, F.lit("")).cast("binary")
    head = F.concat(
        F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("none")),
        F.lit(f">\r\nWARC-Date: {date}\r\nWARC-Target-URI: "), F.coalesce(F.regexp_replace(url, r"[\r\n]", ""), F.lit("")),
        F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"),
    )
    return F.concat(head.cast("binary"), body, F.lit("\r\n\r\n").cast("binary"))


def _hashed(pages: DataFrame, date: str, with_bytes: bool = False) -> DataFrame:
    rec = record_bytes(F.col("page_id"), F.col("url"), F.col("html"), date)
    file = F.coalesce(F.floor(F.col("page_id") / FILE_SPAN).cast("long"), F.lit(-1).cast("long"))
    key = F.coalesce(F.col("page_id").cast("string"), F.lit(""))  # joins on it find rows without a page_id too
    return pages.select("page_id", key.alias("key"), file.alias("file"), F.octet_length(rec).cast("long").alias("length"), F.sha2(rec, 256).alias("hash"), *([rec.alias("record")] if with_bytes else []))


def records(pages: DataFrame, date: str = DATE) -> DataFrame:
    """page_id, key, file, idx, position, offset, length, copies, hash: a row for each distinct record, the idx-th of its file.

    position and offset are those of the first of its copies.
    """
    rows = _hashed(pages, date).groupBy("page_id", "key", "file", "length", "hash").agg(F.count(F.lit(1)).alias("copies")).withColumn("cell", F.substring("hash", 1, 4))
    sums = {"idx": F.lit(1).cast("long"), "position": F.col("copies"), "offset": F.col("copies") * F.col("length")}
    cells = rows.groupBy("page_id", "key", "file", "cell").agg(*(F.sum(x).alias(n) for n, x in sums.items()))
    ahead = W.partitionBy("file").orderBy(F.col("page_id").asc_nulls_first(), "cell").rowsBetween(W.unboundedPreceding, -1)
    cells = cells.select("key", "file", "cell", *(F.coalesce(F.sum(n).over(ahead), F.lit(0)).alias(f"{n}_before") for n in sums))
    inside = W.partitionBy("file", "key", "cell").orderBy("hash").rowsBetween(W.unboundedPreceding, -1)
    placed = rows.withColumns({n: F.coalesce(F.sum(x).over(inside), F.lit(0)) for n, x in sums.items()}).join(cells, ["file", "key", "cell"])
    return placed.select("page_id", "key", "file", *((F.col(n) + F.col(f"{n}_before")).alias(n) for n in sums), "length", "copies", "hash")


def warc_files(pages: DataFrame, date: str = DATE) -> DataFrame:
    """file, volume, content: the bytes of each WARC file, in volumes of FILE_SPAN records where it has more."""
    found = records(pages, date).select("file", "key", "hash", "position", "copies")
    rows = _hashed(pages, date, with_bytes=True).groupBy("file", "key", "hash").agg(F.first("record").alias("record")).join(found, ["file", "key", "hash"])
    rows = rows.withColumn("position", F.explode(F.expr("sequence(position, position + copies - 1)"))).withColumn("volume", F.floor(F.col("position") / FILE_SPAN).cast("long"))
    rows = rows.groupBy("file", "volume").agg(F.sort_array(F.collect_list(F.struct("position", "record"))).alias("all"))

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            content = [b"".join(r["record"] for r in x) for x in b.column("all").to_pylist()]
            yield pa.RecordBatch.from_pydict({"file": b.column("file"), "volume": b.column("volume"), "content": pa.array(content, pa.binary())})

    return rows.mapInArrow(join, "file long, volume long, content binary")


def _plain(content: bytes) -> bytes:
    """The bytes without gzip, whose members follow each other; what can't be unpacked is left out."""
    out = []
    while content[:2] == b"\x1f\x8b":
        member = zlib.decompressobj(31)
        try:
            out.append(member.decompress(content) + member.flush())
        except zlib.error:
            break
        content = member.unused_data
    return b"".join(out) if out else content


def parse_warc(content: bytes) -> Iterator[tuple[int | None, str | None, str | None, int, int]]:
    """(page_id, url, html, offset, length) of each record. Names of fields are read in any case.

    page_id is null where the record's id isn't one of ours, url where it has no target. Empty lines between records are
    skipped. A record that is cut short, or has no header or length that can be read, is one row of nulls that covers the rest.
    """
    content, at = _plain(content), 0
    while at < len(content):
        if content[at : at + 1] in b"\r\n":
            at += 1
            continue
        split = content.find(b"\r\n\r\n", at)
        lines = content[at:split].decode("utf-8", "replace").split("\r\n") if split >= 0 else [""]
        fields = {n.strip().lower(): v.strip() for n, _, v in (line.partition(":") for line in lines[1:])}
        size = fields.get("content-length", "")
        end = split + 4 + int(size) if size.isdecimal() else len(content) + 1
        if not lines[0].startswith("WARC/") or end > len(content):
            yield None, None, None, at, len(content) - at
            return
        ident = re.fullmatch(r"<urn:page:(-?\d+)>", fields.get("warc-record-id", ""))
        after = end + 4 if content[end : end + 4] == b"\r\n\r\n" else end
        yield int(ident[1]) if ident else None, fields.get("warc-target-uri"), content[split + 4 : end].decode("utf-8", "replace"), at, after - at
        at = after


def read_warc(files: DataFrame) -> DataFrame:
    """page_id, url, html, offset, length of every record of (file, content) rows, such as those of Spark's binaryFile reader.

    Offsets are in the unpacked bytes where a file is gzip. Null contents have no records.
    """

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for content in b.column("content"):
                rows = list(parse_warc(content.as_py() or b""))
                cols = list(zip(*rows, strict=True)) if rows else [[]] * 5
                yield pa.RecordBatch.from_pydict({n: pa.array(c, t) for (n, t), c in zip(KINDS, cols, strict=True)})

    return files.select("content").mapInArrow(parse, "page_id long, url string, html string, offset long, length long")


KINDS = (("page_id", pa.int64()), ("url", pa.string()), ("html", pa.string()), ("offset", pa.int64()), ("length", pa.int64()))


class FixityTree:
    """levels[0]: the records; levels[k]: (file, idx, up_file, up_idx, start, end, hash), k = len(levels) - 1 the root."""

    def __init__(self, pages: DataFrame, stored: Stored, levels: int | None = None):
        """levels: those within a file, where another replica asks for more than this one needs."""
        self.leaves = stored.put(records(pages))
        node = F.sha2(F.concat_ws(":", "offset", "length", "copies", "hash"), 256)
        level = self.leaves.select("page_id", "file", "idx", F.col("offset").alias("start"), (F.col("offset") + F.col("length") * F.col("copies")).alias("end"), node.alias("hash"))
        most = self.leaves.agg(F.max("idx").alias("n")).first()["n"] or 0
        self.file_levels = 1
        while FANOUT**self.file_levels <= most:
            self.file_levels += 1
        self.file_levels = max(self.file_levels, levels or 1)
        self.levels = [stored.put(self._parents(level, 0))]
        # over files the first level above file_levels joins FANOUT files, and so on until one node covers any long
        span = self.leaves.agg(F.min("file").alias("a"), F.max("file").alias("b")).first()
        k = 0
        if span["a"] is not None:
            while k < self.file_levels or not (span["a"] == span["b"] == 0 or (span["a"], span["b"]) in ((-1, -1),)):
                here = self.levels[-1]
                child = F.struct("file", "idx", "hash", "start", "end")
                up = here.groupBy(F.col("up_file").alias("file"), F.col("up_idx").alias("idx")).agg(F.sort_array(F.collect_list(child)).alias("c"))
                text = F.concat_ws(",", F.transform("c", lambda x: x["hash"]))
                first, last = F.col("c")[0], F.element_at("c", -1)
                up = up.select("file", "idx", first["start"].alias("start"), last["end"].alias("end"), F.sha2(F.concat_ws(":", first["start"], last["end"], text), 256).alias("hash"))
                k += 1
                if k > self.file_levels:
                    span = {n: span[n] // FANOUT for n in "ab"}
                self.levels.append(stored.put(self._parents(up, k)))
                if k > self.file_levels and span["a"] == -1 and span["b"] == 0:
                    break  # ids of both signs: two nodes remain, which compare as one root

    def _parents(self, level: DataFrame, k: int) -> DataFrame:
        inside = k < self.file_levels
        return level.withColumns({"up_file": F.col("file") if inside else F.floor(F.col("file") / FANOUT).cast("long"), "up_idx": F.floor(F.col("idx") / FANOUT).cast("long") if inside else F.lit(0).cast("long")})


def audit(a: FixityTree, b: FixityTree, stored: Stored) -> DataFrame:
    """page_id, file, idx, in_a, in_b of the distinct records in which two replicas, of equal levels within a file, differ."""
    top = max(len(a.levels), len(b.levels)) - 1
    if len(a.levels) != len(b.levels):  # one replica has more files than fit under the other's root: begin at the common height
        top = min(len(a.levels), len(b.levels)) - 1
    bad: DataFrame | None = None
    for k in range(top, -1, -1):
        sides = []
        for t in (a, b):
            level = t.levels[k]
            if bad is not None:  # only children of nodes that differ
                level = level.join(bad, (level["up_file"] == bad["bf"]) & (level["up_idx"] == bad["bi"]), "left_semi")
            sides.append(level)
        x, y = (s.select(F.col("file").alias(f"{n}f"), F.col("idx").alias(f"{n}i"), F.col("hash").alias(f"{n}h"), *([F.col("page_id").alias(f"{n}p")] if k == 0 else [])) for s, n in zip(sides, "xy", strict=True))
        differ = x.join(y, (x["xf"] == y["yf"]) & (x["xi"] == y["yi"]), "full").where("NOT (xh <=> yh)")
        if k == 0:
            return differ.select(F.coalesce("xp", "yp").alias("page_id"), F.coalesce("xf", "yf").alias("file"), F.coalesce("xi", "yi").alias("idx"), F.col("xh").isNotNull().alias("in_a"), F.col("yh").isNotNull().alias("in_b"))
        bad = stored.put(differ.select(F.coalesce("xf", "yf").alias("bf"), F.coalesce("xi", "yi").alias("bi")))
    raise AssertionError("a tree has at least one level")


def fixity_report(primary: DataFrame, replica: DataFrame) -> DataFrame:
    """Every record of the primary: page_id, warc_file, position, offset, length, record_sha256, intact."""
    stored = Stored(primary.sparkSession)
    a, b = trees(primary, replica, stored)
    bad = audit(a, b, stored).where("in_a").select("file", "idx", F.lit(False).alias("intact"))
    rows = a.leaves.join(bad, ["file", "idx"], "left").withColumn("copy", F.explode(F.expr("sequence(0L, copies - 1)")))
    return rows.select(
        "page_id", F.col("file").alias("warc_file"), (F.col("position") + F.col("copy")).alias("position"), (F.col("offset") + F.col("copy") * F.col("length")).alias("offset"),
        "length", F.col("hash").alias("record_sha256"), F.coalesce("intact", F.lit(True)).alias("intact"),
    )


def trees(primary: DataFrame, replica: DataFrame, stored: Stored) -> tuple[FixityTree, FixityTree]:
    """Of two replicas, with equally many levels within a file."""
    a = FixityTree(primary, stored)
    b = FixityTree(replica, stored, a.file_levels)
    return (a if a.file_levels == b.file_levels else FixityTree(primary, stored, b.file_levels)), b


def damaged(pages: DataFrame, one_in: int = 97) -> DataFrame:
    """A replica for tests and the query: the first character of some pages' html is overwritten, by a rule on page_id."""
    hit = F.pmod(F.crc32(F.col("page_id").cast("string").cast("binary")), F.lit(one_in)) == 0
    return pages.select("page_id", "url", F.when(hit, F.concat(F.lit("?"), F.expr("substring(html, 2)"))).otherwise(F.col("html")).alias("html"))

"""Exact dedup by content-defined chunk recipes. DataFrame functions only.

Texts are cut into chunks at places that the content decides: the first sentence or line end after
MIN_CHUNK characters, or MAX_CHUNK characters where none comes. A chunk's identifier is a pair of
seeded 64-bit hashes. Identifiers are verified: the corpus' chunks are reduced to distinct ones (each
task first drops its own repeats, so a common passage moves once a task) and no two distinct chunks may
share an identifier; were two to, the next seeds are taken. Chunks cover a text wholly and in order, so
two texts are equal exactly if their ordered identifier lists, the recipes, are equal. Only recipes
are compared and moved from there on: sixteen bytes for each half kilobyte of text.

Groups are found by a partial aggregation over recipes; the join back to the rows is one that adaptive
execution splits where a group of copies is large.

Defined results: null counts as the empty text; the empty text is a group like any other; the row with
the largest doc_id stays (null doc_ids last); where that row is itself repeated, exactly one of the
repeats stays; an empty table gives an empty result; other columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import Stored

MIN_CHUNK, MAX_CHUNK = 512, 4096
SEEDS = ((11, 12), (21, 22), (31, 32))


def chunk_list(text: Column) -> Column:
    pattern = rf"(?s).{{{MIN_CHUNK},{MAX_CHUNK}}}?(?<=[.!?\n])|.{{1,{MAX_CHUNK}}}"
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def identifier(chunk: Column, seeds: tuple[int, int], bits: int = 64) -> Column:
    """bits: fewer only in tests, to bring about collisions."""
    one = [F.xxhash64(F.lit(s), chunk) for s in seeds]
    if bits < 64:
        one = [F.shiftrightunsigned(x, 64 - bits) for x in one]
    return F.struct(one[0].alias("p"), one[1].alias("q"))


def collides(docs: DataFrame, seeds: tuple[int, int], bits: int = 64) -> bool:
    """Whether two distinct chunks of the corpus share an identifier."""
    text = F.coalesce(F.col("text"), F.lit(""))
    chunks = docs.select(F.explode(chunk_list(text)).alias("chunk")).select(identifier(F.col("chunk"), seeds, bits).alias("id"), "chunk").distinct()
    return chunks.groupBy("id").count().where("count > 1").limit(1).count() > 0


def recipes(docs: DataFrame, seeds: tuple[int, int], bits: int = 64) -> Column:
    return F.transform(chunk_list(F.coalesce(F.col("text"), F.lit(""))), lambda c: identifier(c, seeds, bits))


def exact_dedup(docs: DataFrame, bits: int = 64, extra: list[Column] | None = None) -> DataFrame:
    """doc_id, keep_id, group_size, kept, text_sha256 (and extra columns) for every row of docs."""
    stored = Stored(docs.sparkSession)
    for seeds in SEEDS:
        if not collides(docs, seeds, bits):
            break
    else:
        raise RuntimeError("chunk identifiers collide under every seed")
    text = F.coalesce(F.col("text"), F.lit(""))
    slim = docs.select(
        "doc_id", F.monotonically_increasing_id().alias("rid"), recipes(docs, seeds, bits).alias("recipe"),
        F.sha2(text.cast("binary"), 256).alias("text_sha256"), *(extra or []),
    ).withColumn("parts", F.size("recipe"))
    slim = stored.put(slim)
    groups = slim.groupBy("recipe").agg(F.max(F.struct("doc_id", "rid")).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    groups = groups.withColumn("parts", F.size("recipe"))
    joined = slim.join(groups, ["parts", "recipe"])  # two keys: both sides are exchanged, so a large group can be split
    names = [c for c in slim.columns if c not in ("doc_id", "rid", "recipe", "text_sha256", "parts")]
    return joined.select(
        "doc_id", F.col("keep.doc_id").alias("keep_id"), "group_size", (F.col("rid") == F.col("keep.rid")).alias("kept"), "text_sha256", *names,
    )

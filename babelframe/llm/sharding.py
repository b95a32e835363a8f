"""Sharding by proportional stratified interleaving. DataFrame functions only.

Law: ``rows`` (shard sizes in rows differ by one at most).

1. Rows that are equal in all that matters here (source, doc_id, text's checksum and size) are one row with a
   number, counted by a partial aggregation, so that repeats, however many, are never sorted or gathered.
2. Within each source, rows stand in a seeded random order: md5 of seed, doc_id, checksum and size. Rows that share a
   doc_id, or have none, are spread like any others.
3. The row of rank r among its source's n rows has the fractional rank (2r - 1) / 2n.
4. All rows are put in order of fractional rank; shard k gets the k-th of equal consecutive runs.

Any run of the order covers one interval of fractional ranks and so holds each source in the
proportion of the whole mixture.

Neither ranking gathers a source or the table in one task. Ranks are offsets of cells plus the
place within a cell: (source, leading digits of the hash) first, then equal intervals of fractional
rank. The number of cells follows the number of rows: FEW to a cell, up to 4096 cells, and CELL_ROWS to a cell beyond. So a cell holds an even share of any
source, a hot one included, whatever the size of the table. Cell sizes of the second ranking
follow from the sources' row counts alone, so rows are shuffled without their texts.

Defined results: null and empty texts have size 1 and checksum 0; null sources are one source; null
doc_ids hash as the word null; repeated rows get slots of their own, in runs of their ranks; ties fall to hash, doc_id,
checksum and size; an empty table gives an empty result; other columns are not read.
Rows of equal texts are not held together: with counts at most one apart, a group of copies that
holds a third of the rows cannot share a shard of a sixteenth.
"""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

SEED = "shard-1"
FEW, CELL_ROWS = 64, 50_000
COPIES = 10_000  # repeats of a row are written out in runs of so many


def interleave(docs: DataFrame, shards: int = 16, seed: str = SEED, cells: int | None = None, digits: int | None = None, stratum: str = "source") -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard, position for every row of docs.

    cells: intervals of fractional rank; digits: hexadecimal digits of the hash that part a source. Both follow from the number of rows by default.
    """
    if cells is None or digits is None:
        n = docs.count()
        need = max(16, min(-(-n // FEW), 4096), -(-n // CELL_ROWS))
        cells, digits = cells or 4 * need, digits or math.ceil(math.log(need, 16))
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(
        F.col("doc_id"),
        F.coalesce(F.concat(F.lit("s"), F.col(stratum).cast("string")), F.lit("")).alias("sk"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
    ).groupBy("sk", "doc_id", "text_crc32", "size").agg(F.count(F.lit(1)).alias("copies"))
    key = F.md5(F.concat(F.lit(f"{seed}:"), F.concat_ws(":", F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), "text_crc32", "size")).cast("binary"))
    rows = rows.withColumn("h", key).withColumn("cell", F.substring("h", 1, digits))

    per_cell = rows.groupBy("sk", "cell").agg(F.sum("copies").alias("n"))
    by_source = W.partitionBy("sk")
    before = F.coalesce(F.sum("n").over(by_source.orderBy("cell").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    offsets = per_cell.select("sk", "cell", before.alias("before"), F.sum("n").over(by_source).alias("total"))

    in_cell = W.partitionBy("sk", "cell").orderBy("h", "doc_id", "text_crc32", "size").rowsBetween(W.unboundedPreceding, -1)
    ranked = rows.withColumn("r", F.coalesce(F.sum("copies").over(in_cell), F.lit(0))).join(offsets, ["sk", "cell"])
    # repeats are written out: runs of ranks first, dealt over all tasks, then the ranks
    ranked = ranked.withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.expr(f"(copies - 1) div {COPIES}")))).repartition("h", "k")
    ranked = ranked.withColumn("r", F.explode(F.expr(f"sequence(before + r + k * {COPIES} + 1, before + r + least(copies, (k + 1) * {COPIES}))")))
    twice = "(2 * r - 1)"
    ranked = ranked.select(
        "doc_id", "size", "text_crc32", "h",
        F.expr(f"CAST({twice} AS DOUBLE) / CAST(2 * total AS DOUBLE)").alias("f"),
        F.expr(f"{twice} * {cells} div (2 * total)").alias("fc"),
    )

    # Rows of each fraction cell, from the sources' totals: rank by rank where a source has fewer rows than cells.
    totals = per_cell.groupBy("sk").agg(F.sum("n").alias("n"))
    few = totals.where(F.col("n") <= cells).select(F.explode(F.expr(f"transform(sequence(1L, n), r -> (2 * r - 1) * {cells} div (2 * n))")).alias("fc"), F.lit(1).cast("long").alias("m"))
    upto = lambda b: f"(2 * n * ({b}) + {cells} - 1) div (2 * {cells})"
    many = totals.where(F.col("n") > cells).select("n", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(cells - 1).cast("long"))).alias("fc"))
    many = many.select("fc", F.expr(f"{upto('fc + 1')} - {upto('fc')}").alias("m"))
    sizes = few.union(many).groupBy("fc").agg(F.sum("m").alias("m"))
    one = W.partitionBy(F.lit(0))  # at most `cells` rows
    starts = sizes.select("fc", F.coalesce(F.sum("m").over(one.orderBy("fc").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("start"), F.sum("m").over(one).alias("all"))

    in_fraction = W.partitionBy("fc").orderBy("f", "h", "doc_id", "text_crc32", "size")
    placed = ranked.withColumn("i", F.row_number().over(in_fraction)).join(starts, "fc").withColumn("position", F.expr("start + i - 1"))
    return placed.withColumn("shard", F.expr(f"CAST(position * {shards} div all AS INT)")).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard",
        F.expr(f"position - (shard * all + {shards - 1}) div {shards}").alias("slot"),
        F.lit(None).cast("int").alias("grown_shard"), "position",
    )

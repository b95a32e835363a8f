"""Shared helpers: the shared scratch folder, stored tables, table reading, connected components."""

from __future__ import annotations

import atexit
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LOCAL_SCRATCH = "/tmp/checkpoints/babelframe"


def unused(columns, *wanted: str) -> list[str]:
    """Names like the wanted ones that none of the columns has, whatever the case."""
    taken, out = {c.lower() for c in columns}, []
    for name in wanted:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Only a session in one process may go without."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found:
        found = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("on a cluster spark.checkpoint.dir must name a folder that driver and executors share")
    return (found or LOCAL_SCRATCH).rstrip("/")


def drop_path(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def _drop_at_exit(spark: SparkSession, path: str, name: str | None = None) -> None:
    try:
        if name:
            spark.sql(f"DROP TABLE IF EXISTS {name}")
        drop_path(spark, path)
    except Exception:  # the JVM has gone already; its own clean-up is the cluster's matter
        pass


def ship_code(spark: SparkSession) -> None:
    """Gives the executors' Python workers this package, once a session, so that it need not be installed there."""
    sc = spark.sparkContext
    if getattr(sc, "_babelframe_shipped", False):
        return
    root = Path(__file__).resolve().parents[1]
    path = Path(tempfile.mkdtemp(prefix="babelframe-")) / "babelframe_code.zip"
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for f in sorted(root.rglob("*.py")):
            z.write(f, f"{root.name}/{f.relative_to(root)}")
    sc.addPyFile(str(path))
    sc._babelframe_shipped = True


class Stored:
    """Tables cut from their lineage: written to the shared folder as Parquet and read again.

    Every task attempt commits whole files, so a lost executor costs only a re-read or a re-run
    of the unfinished tasks. Tables go when dropped here, or at the driver's exit.
    """

    def __init__(self, spark: SparkSession):
        ship_code(spark)
        self.spark = spark
        self.paths: set[str] = set()

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{scratch_dir(self.spark)}/bf-{uuid.uuid4().hex}"
        df.write.mode("overwrite").parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._stored_at = path
        self.paths.add(path)
        atexit.register(_drop_at_exit, self.spark, path)
        return out

    def put_bucketed(self, df: DataFrame, key: str, buckets: int) -> DataFrame:
        """The same, with the rows of a key in one bucket, so that later groupings by it need no shuffle."""
        name = f"bf_{uuid.uuid4().hex}"
        path = f"{scratch_dir(self.spark)}/{name}"
        df.write.bucketBy(buckets, key).option("path", path).format("parquet").saveAsTable(name)
        atexit.register(_drop_at_exit, self.spark, path, name)
        return self.spark.read.table(name)

    def drop(self, df: DataFrame | None) -> None:
        path = getattr(df, "_stored_at", None)
        if path in self.paths:
            self.paths.discard(path)
            drop_path(self.spark, path)

    def free_shuffles(self) -> None:
        """Has the shuffle files of what was stored so far go now: Spark drops them only once the driver's JVM collects its garbage."""
        self.spark.sparkContext._jvm.System.gc()

    def keep_only(self, *needed: DataFrame) -> None:
        """Drops every table made here but those that a result still reads."""
        for path in self.paths - {df._stored_at for df in needed}:
            self.paths.discard(path)
            drop_path(self.spark, path)


#: Documented parameter: a graph of at most so many edges (16 bytes each) is solved by one task. 0 sends all through the rounds.
SMALL_GRAPH = 500_000


def components(spark: SparkSession, edges: DataFrame, stored: Stored, small: int = SMALL_GRAPH, max_rounds: int = 200) -> DataFrame:
    """Connected components of undirected edges (a, b), both long.

    Returns (node, root): root is the smallest node id of the component; nodes without an edge are absent.
    A graph of at most `small` edges, counted first, is solved by one task; its size is bounded, and so is the task.
    A larger one goes by hash-to-min with pointer jumping: each round a node takes the smallest root among its own, its
    neighbours' and its root's. Partial aggregation keeps a hub's edges out of any one task, the joins
    are ones that adaptive execution can split, and each round's labels are a stored table. A path of
    n nodes needs about log2(n) rounds. Nothing but counts reaches the driver.
    """
    edges = stored.put(edges.where("a <> b").select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct())
    if edges.count() <= small:
        return stored.put(edges.repartition(1).mapInArrow(_solve, "node long, root long"))
    both = stored.put(edges.selectExpr("a AS u", "b AS v").union(edges.selectExpr("b AS u", "a AS v")))
    labels = stored.put(both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("root")).select(F.col("u").alias("node"), "root"))
    for _ in range(max_rounds):
        seen = both.join(labels.select(F.col("node").alias("v"), "root"), "v").select(F.col("u").alias("node"), "root")
        # the root of a node hears of the node's better root too, so that chains contract
        offered = seen.union(labels).groupBy("node").agg(F.min("root").alias("root"))
        hook = offered.join(labels.withColumnRenamed("root", "was"), "node").where("root < was").selectExpr("was AS node", "root")
        best = offered.union(hook).groupBy("node").agg(F.min("root").alias("root"))
        jump = best.alias("x").join(best.select(F.col("node").alias("root"), F.col("root").alias("far")), "root", "left")
        new = stored.put(jump.select("node", F.least("root", F.coalesce("far", "root")).alias("root")))
        changed = new.join(labels.withColumnRenamed("root", "was"), "node").where("root <> was").limit(1).count()
        stored.drop(labels)
        labels = new
        if not changed:
            stored.drop(both)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")


def _solve(batches):
    """All edges of a small graph -> (node, root), by union-find."""
    import pyarrow as pa

    up: dict[int, int] = {}

    def root(x: int) -> int:
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for r in batches:
        for a, b in zip(r.column("a").to_pylist(), r.column("b").to_pylist(), strict=True):
            up.setdefault(a, a)
            up.setdefault(b, b)
            x, y = root(a), root(b)
            if x != y:
                up[max(x, y)] = min(x, y)
    nodes = list(up)
    yield pa.RecordBatch.from_pydict({"node": pa.array(nodes, pa.int64()), "root": pa.array([root(n) for n in nodes], pa.int64())})


def merge_components(spark: SparkSession, labels: DataFrame, edges: DataFrame, stored: Stored, small: int = SMALL_GRAPH) -> DataFrame:
    """Components (node, root) after more edges (a, b): only the roots that these connect are solved anew."""
    root = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias("r" + x))
    between = edges.join(root("a"), "a", "left").join(root("b"), "b", "left").select(F.coalesce("ra", "a").alias("a"), F.coalesce("rb", "b").alias("b"))
    moved = components(spark, between, stored, small).select(F.col("node").alias("old"), F.col("root").alias("new"))
    kept = labels.join(moved, labels["root"] == moved["old"], "left").select("node", F.coalesce("new", "root").alias("root"))
    fresh = moved.select(F.col("old").alias("node"), F.col("new").alias("root")).join(labels, "node", "left_anti")
    return stored.put(kept.union(fresh))


def keep_rows(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The rows of docs, with all their columns, that found (doc_id, text_sha256, kept for every row of docs) marks as kept.

    Rows are known by doc_id and text. Where such a pair is repeated, one row stays; texts are grouped for that only
    if there are repeats at all.
    """
    sha, other_id, other_sha = unused([*docs.columns, "doc_id", "text_sha256"], "sha", "kept_id", "kept_sha")
    rows = docs.withColumn(sha, F.sha2(F.coalesce(docs["text"], F.lit("")).cast("binary"), 256))
    kept = found.where("kept").select(F.col("doc_id").alias(other_id), F.col("text_sha256").alias(other_sha)).distinct()
    rows = rows.join(kept, rows["doc_id"].eqNullSafe(kept[other_id]) & (rows[sha] == kept[other_sha]), "left_semi")
    repeated = found.groupBy("doc_id", "text_sha256").count().where("count > 1").limit(1).count()
    if repeated:
        rows = rows.dropDuplicates(["doc_id", sha])
    return rows.drop(sha)


def lowest(df: DataFrame, h, n: int, ties: list) -> DataFrame:
    """The n rows of df with the lowest hash h (a long, evenly spread).

    Rows are counted first and only those under a matching cut of the hash's range are sorted, so that the
    partitions together, and not each, offer about n rows.
    """
    every = df.count()
    if every > 2 * n:
        cut = -(1 << 63) + int((1 << 64) * min(1.0, (n + 8 * n**0.5 + 20) / every))  # eight deviations to spare
        df = df.where(h < F.lit(min(cut, (1 << 63) - 1)))
    return df.orderBy(h, *ties).limit(n)


_LOADED: dict = {}


def once(key: tuple, make):
    """A worker process' own copy of something that is dear to build. At most eight are kept."""
    if key not in _LOADED:
        if len(_LOADED) >= 8:
            _LOADED.clear()
        _LOADED[key] = make()
    return _LOADED[key]


def ship_file(spark: SparkSession, path: str):
    """A vocabulary file of a few megabytes, read by the driver and broadcast: (key, broadcast of its bytes)."""
    import hashlib

    ship_code(spark)
    with open(path, "rb") as f:
        data = f.read()
    if len(data) > 64 << 20:
        raise ValueError(f"{path} is over 64 MB and is not a vocabulary file")
    return hashlib.sha256(data).hexdigest(), spark.sparkContext.broadcast(data)


def vocabulary(name: str) -> str:
    """The usual place of a public tokenizer's file; every operator also takes a path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def by_size(batch, column: str, chars: int = 1_000_000):
    """Slices of an Arrow batch with about so many characters each, so that a batch of long texts is worked on in turns."""
    import numpy as np
    import pyarrow.compute as pc

    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0))
    edges = np.flatnonzero(np.diff(np.cumsum(sizes) // chars, prepend=-1))
    for a, b in zip(edges, [*edges[1:], batch.num_rows], strict=True):
        yield batch.slice(a, b - a)

"""Embedding near-dedup: exact threshold pairs by dual traversal of cover trees.

Vectors are compared only within one label (and one length). Equal vectors are one point with a multiplicity; distance is
that of the unit vectors, and cosine >= t is distance <= sqrt(2 - 2t), the reach.

*Tree.* CoverTree has nested levels: the node at level s covers its points with radius s at most, and its children are a net of
radius s / 2 over them, the node's own centre among them, down to single points. Each node also knows its true
covering radius. Two trees (or one and itself) are walked level by level from the roots. A pair of nodes whose centres are
further apart than reach and both radii goes; one whose points are all within reach by the same bound is taken
whole, without looking at the points; the others are replaced by their children's pairs. Two single points are decided by
their cosine in double precision.

*Over a whole label.* The tree's levels are built from the bottom:

1. Points are dealt to blocks of about BLOCK (a pivot's cell, then a hash), a tree a block. Its walk finds the links inside the
   block. Its highest nodes with radius <= reach / 3 are the block's anchors, and every point learns its anchor: a
   cluster of near copies is an anchor or few, however many points it has.
2. Anchors alone, with radius and number of points, meet the other blocks of their label, each pair of blocks in a run of
   its own; an anchor goes only to blocks whose cell the triangle inequality leaves. There they are the leaves of upper
   trees, walked as before with their radii: pairs go, are taken whole by their numbers, or stay undecided.
3. The points of undecided anchors, and no others, are brought together, a run of rows for each pair of anchors.

So points move twice, anchors as often as their label has blocks, and neither a label nor a cluster is ever in one task.
Where no two points are near, every point is its own anchor, and exact answers need all pairs of centres: distances in
such data don't bound each other, and the blocks are then what keeps memory fixed.

Links: cosine >= 0.93 in double precision. Defined results: vectors that are null, empty, zero or hold null
or non-finite components, and those without a label, link with nothing and are their own component; repeated
rows link with each other; a component is named by its smallest vec_id, and rows without a vec_id get a null
component; kept is vec_id = component_id; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_GRAPH, Stored, components, lowest

THRESHOLD = 0.93
PIVOT_SAMPLE, PIVOTS = 4096, 16
BLOCK, LEAF = 2048, 8
EPS = 1e-9


def between(u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """Distances of unit vectors, to about 1e-8 where they are near each other."""
    return np.sqrt(np.maximum(0.0, 2 - 2 * (u @ v.T)))


class CoverTree:
    """Over unit vectors u; extra: a radius that each brings along (0 for a point). Children of a node are numbered consecutively."""

    def __init__(self, u: np.ndarray, extra: np.ndarray | None = None):
        self.u, self.extra = u, np.zeros(len(u)) if extra is None else extra
        self.points = [np.arange(len(u))]
        self.centre, self.radius, self.first, self.many = [0], [], [], []
        scale, k = [2.0], 0
        while k < len(self.points):
            ids, c = self.points[k], self.centre[k]
            d = np.linalg.norm(u[ids] - u[c], axis=1)
            far = float(d.max())
            self.radius.append(float((d + self.extra[ids]).max()))
            s = scale[k]
            while s / 2 >= far > EPS:  # levels that would hold the same node again
                s /= 2
            groups = self.net(ids, c, s / 2) if far > EPS and len(ids) > LEAF else [(i, ids[j : j + 1]) for j, i in enumerate(ids)] if len(ids) > 1 else []
            self.first.append(len(self.points) if groups else -1)
            self.many.append(len(groups))
            for i, g in groups:
                self.points.append(g)
                self.centre.append(i)
                scale.append(s / 2)
            k += 1
        self.centre, self.radius, self.many = np.asarray(self.centre), np.asarray(self.radius), np.asarray(self.many)

    def net(self, ids: np.ndarray, centre: int, radius: float) -> list[tuple[int, np.ndarray]]:
        """Centres further apart than radius, the given one first, and the points that each is the first to cover."""
        left = np.concatenate([[centre], ids[ids != centre]])
        out = []
        while len(left):
            some = left[:128]
            near = between(self.u[some], self.u[left]) <= radius
            free = np.ones(len(left), bool)
            for k in range(len(some)):
                if free[k]:
                    mine = near[k] & free
                    mine[k] = True
                    out.append((some[k], left[mine]))
                    free &= ~mine
            left = left[free]
        return out

    def children(self, k: int) -> np.ndarray:
        return np.arange(self.first[k], self.first[k] + self.many[k]) if self.many[k] else np.asarray([k])

    def anchors(self, most: float) -> tuple[np.ndarray, np.ndarray]:
        """Each point's anchor (a row of u) and its radius: the highest nodes of at most that radius."""
        of, radius, stack = np.empty(len(self.u), np.int64), np.empty(len(self.u)), [0]
        while stack:
            k = stack.pop()
            if self.radius[k] <= most or not self.many[k]:
                of[self.points[k]], radius[self.points[k]] = self.centre[k], self.radius[k]
            else:
                stack += self.children(k).tolist()
        return of, radius


class Run:
    """Links between two sets of points, or within one (y is None). radii: of anchors, where the sets hold anchors."""

    def __init__(self, x: np.ndarray, y: np.ndarray | None, threshold: float, radii: tuple[np.ndarray, np.ndarray] | None = None):
        self.same = y is None
        self.raw = [x] if self.same else [x, y]
        self.norm = [np.linalg.norm(v, axis=1) for v in self.raw]
        self.threshold, self.reach = threshold, math.sqrt(max(0.0, 2 - 2 * threshold))
        self.found: list[tuple[np.ndarray, np.ndarray]] = []  # linked pairs of rows of the two sides
        self.whole: list[tuple[np.ndarray, np.ndarray]] = []  # sets of rows linked pair by pair
        self.open: list[tuple[np.ndarray, np.ndarray]] = []  # pairs of anchors that their radii leave undecided
        self.node_pairs = self.pruned = self.compared = 0
        self.trees = [CoverTree(v / n[:, None], radii[k] if radii else None) for k, (v, n) in enumerate(zip(self.raw, self.norm, strict=True))]
        self._walk()

    def _walk(self) -> None:
        """Nodes meet in rectangles: the children of one node, and all nodes of the other tree that it is undecided with."""
        a, b = self.trees[0], self.trees[-1]
        root = np.zeros(1, np.int64)
        if not self.same:
            stack = [(root, root, False)]
        elif 2 * a.radius[0] < self.reach - 2 * EPS:
            self.whole.append((a.points[0], a.points[0]))
            return
        else:
            stack = [(a.children(0), a.children(0), True)] if a.many[0] else []
        while stack:
            rows, cols, own = stack.pop()
            for at in range(0, len(rows), 512):
                self._meet(rows[at : at + 512], cols, own, at, stack)

    def _meet(self, rows: np.ndarray, cols: np.ndarray, own: bool, at: int, stack: list) -> None:
        a, b = self.trees[0], self.trees[-1]
        cos = a.u[a.centre[rows]] @ b.u[b.centre[cols]].T
        d = np.sqrt(np.maximum(0.0, 2 - 2 * cos))
        slack = a.radius[rows][:, None] + b.radius[cols]
        near = d - slack <= self.reach + 2 * EPS + 1e-8
        total = d.size
        if own:
            later = np.arange(d.shape[1]) > np.arange(at, at + d.shape[0])[:, None]
            near &= later
            total = int(later.sum())
        i, j = np.nonzero(near)
        self.node_pairs += total
        self.pruned += total - len(i)
        single_a, single_b = a.many[rows] == 0, b.many[cols] == 0
        if own:
            for k in rows[~single_a].tolist():
                if 2 * a.radius[k] < self.reach - 2 * EPS:
                    self.whole.append((a.points[k], a.points[k]))
                else:
                    stack.append((a.children(k), a.children(k), True))
        if not len(i):
            return
        d, slack, cos = d[i, j], slack[i, j], cos[i, j]
        row_single, both = single_a[i], single_a[i] & single_b[j]
        points = both & (slack == 0)  # two single points: their cosine decides
        self.compared += int(points.sum())
        self._decide(a.centre[rows[i[points]]], b.centre[cols[j[points]]], cos[points])
        inside = (d + slack < self.reach - 2 * EPS - 1e-8) & ~points
        for r, c in zip(rows[i[inside]].tolist(), cols[j[inside]].tolist(), strict=True):
            self.whole.append((a.points[r], b.points[c]))
        left = ~inside & ~points
        if (both & left).any():
            self.open.append((a.centre[rows[i[both & left]]], b.centre[cols[j[both & left]]]))
        down = np.flatnonzero(left & ~row_single)  # sorted by row
        for part in np.split(down, np.flatnonzero(np.diff(i[down])) + 1) if len(down) else []:
            stack.append((a.children(rows[i[part[0]]]), cols[j[part]], False))
        down = np.flatnonzero(left & row_single & ~both)
        down = down[np.argsort(j[down], kind="stable")]
        for part in np.split(down, np.flatnonzero(np.diff(j[down])) + 1) if len(down) else []:
            stack.append((rows[i[part]], b.children(cols[j[part[0]]]), False))

    def _decide(self, i: np.ndarray, j: np.ndarray, cos: np.ndarray) -> None:
        x, y = self.raw[0], self.raw[-1]
        for k in np.flatnonzero(np.abs(cos - self.threshold) < 1e-12).tolist():
            s, t = x[i[k]], y[j[k]]
            cos[k] = math.fsum(s * t) / math.sqrt(math.fsum(s * s) * math.fsum(t * t))
        hit = cos >= self.threshold
        if hit.any():
            self.found.append((i[hit], j[hit]))

    def report(self, node: list[np.ndarray], many: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(node, links, smallest node connected) of every point with a link. many: multiplicities."""
        n = len(node[0])
        ids = np.concatenate(node)
        links = np.zeros(len(ids), np.int64)
        shift = 0 if self.same else n
        heads, tails = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
        for i, j in self.found:
            np.add.at(links, i, many[-1][j])
            np.add.at(links, j + shift, many[0][i])
            heads.append(i)
            tails.append(j + shift)
        for i, j in self.whole:
            if self.same and i is j:
                links[i] += many[0][i].sum() - many[0][i]
            else:
                links[i] += many[-1][j].sum()
                links[j + shift] += many[0][i].sum()
            every = np.concatenate([i, j + shift])
            heads.append(every)
            tails.append(np.full(len(every), every[0]))
        head, tail = np.concatenate(heads), np.concatenate(tails)
        root = np.argsort(np.argsort(ids, kind="stable"), kind="stable")  # the place of each among all, in order of their ids
        at = np.argsort(ids, kind="stable")
        while len(head):
            was = root.copy()
            low = np.minimum(root[head], root[tail])
            np.minimum.at(root, head, low)
            np.minimum.at(root, tail, low)
            root = np.minimum(root, root[at[root]])
            if (root == was).all():
                break
        some = links > 0
        return ids[some], links[some], ids[at[root]][some]


def runs(batches: Iterator[pa.RecordBatch], key: list[str], work) -> Iterator[pa.RecordBatch]:
    """Hands each run of rows with one key to work(table) and yields the batches that it returns; rows of a key follow each other."""
    now, held = None, []
    for r in batches:
        keys = list(zip(*(r.column(c).to_pylist() for c in key), strict=True))
        begins = [k for k in range(len(keys)) if k == 0 or keys[k] != keys[k - 1]]
        for a, b in zip(begins, [*begins[1:], len(keys)], strict=True):
            if keys[a] != now and held:
                yield from work(pa.Table.from_batches(held).combine_chunks())
                held = []
            now = keys[a]
            held.append(r.slice(a, b - a))
    if held:
        yield from work(pa.Table.from_batches(held).combine_chunks())


def matrix(t: pa.Table) -> np.ndarray:
    return t.column("embedding").combine_chunks().flatten().to_numpy().reshape(t.num_rows, -1)


def _usable() -> str:
    return (
        "label IS NOT NULL AND embedding IS NOT NULL AND size(embedding) > 0 AND "
        "forall(embedding, x -> x IS NOT NULL AND NOT isnan(x) AND abs(x) <> double('inf')) AND exists(embedding, x -> x <> 0)"
    )


def _cells(points: DataFrame, stored: Stored, block: int):
    """points with their cell, and, broadcast, {(label, dim): (pivots, {cell: (blocks, radius)})} of labels with several cells.

    A bounded sample supplies the pivots: PIVOT_SAMPLE vectors in all, at most PIVOTS a label and no more than the label
    has blocks. Labels with one block, or unseen by the sample, have one cell.
    """
    spark = points.sparkSession
    sample = lowest(points.select("node", "label", "dim", "embedding"), F.xxhash64(F.lit(8), "node"), PIVOT_SAMPLE, ["node"])
    asked: dict[tuple, list] = {}
    for r in sample.collect():
        asked.setdefault((r["label"], r["dim"]), []).append(np.asarray(r["embedding"]))
    size = {(r["label"], r["dim"]): r["n"] for r in points.join(F.broadcast(sample.select("label", "dim").distinct()), ["label", "dim"]).groupBy("label", "dim").agg(F.count(F.lit(1)).alias("n")).collect()}
    pivots = {}
    for k, vs in asked.items():
        most = min(PIVOTS, -(-size.get(k, 0) // block))
        u = np.stack(vs)
        u = u / np.linalg.norm(u, axis=1)[:, None]
        chosen, far = [0], np.linalg.norm(u - u[0], axis=1)
        while len(chosen) < most and far.max() > EPS:  # farthest first
            chosen.append(int(far.argmax()))
            far = np.minimum(far, np.linalg.norm(u - u[chosen[-1]], axis=1))
        if len(chosen) > 1:
            pivots[k] = u[chosen]
    known = spark.sparkContext.broadcast(pivots)  # at most PIVOT_SAMPLE vectors

    def at_home(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            cell, far = np.zeros(r.num_rows, np.int32), np.zeros(r.num_rows)
            for i, (label, dim, e) in enumerate(zip(*(r.column(c).to_pylist() for c in ("label", "dim", "embedding")), strict=True)):
                p = known.value.get((label, dim))
                if p is not None:
                    x = np.asarray(e)
                    d = np.linalg.norm(p - x / np.linalg.norm(x), axis=1)
                    cell[i], far[i] = d.argmin(), d.min()
            yield pa.RecordBatch.from_arrays([*r.columns, pa.array(cell), pa.array(far)], names=[*r.schema.names, "cell", "far"])

    if not pivots:
        return points.select("label", "embedding", "node", "many", "dim", F.lit(0).alias("cell")), spark.sparkContext.broadcast({})
    homes = stored.put(points.mapInArrow(at_home, "label string, embedding array<double>, node long, many long, dim int, cell int, far double"))
    cells: dict[tuple, tuple] = {k: (p, {}) for k, p in pivots.items()}
    # grouped by label and cell, and only labels with pivots have a cell but 0 or a distance: no more rows than pivots
    known_labels = F.broadcast(spark.createDataFrame([(label, dim) for label, dim in pivots], "label string, dim int"))
    for r in homes.join(known_labels, ["label", "dim"]).groupBy("label", "dim", "cell").agg(F.max("far").alias("far"), F.count(F.lit(1)).alias("n")).collect():
        cells[r["label"], r["dim"]][1][r["cell"]] = (-(-r["n"] // block), r["far"])
    return homes, spark.sparkContext.broadcast(cells)


def embed_dedup(vectors: DataFrame, threshold: float = THRESHOLD, block: int = BLOCK, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row of vectors (vec_id, embedding, label)."""
    spark = vectors.sparkSession
    stored = Stored(spark)
    rows = vectors.select("vec_id", F.col("embedding").cast("array<double>").alias("embedding"), F.col("label").cast("string").alias("label"))
    rows = stored.put(rows.withColumn("usable", F.coalesce(F.expr(_usable()), F.lit(False))))
    own = F.coalesce(F.min("vec_id").cast("long"), F.shiftrightunsigned(F.min(F.xxhash64("label", "embedding")), 2) + F.lit(1 << 62))
    points = rows.where("usable").groupBy("label", "embedding").agg(own.alias("node"), F.count(F.lit(1)).alias("many"))
    points = stored.put(points.withColumn("dim", F.size("embedding")))
    homes, cells = _cells(points, stored, block)
    parts = homes.groupBy("label", "dim", "cell").agg(F.count(F.lit(1)).alias("n")).selectExpr("label", "dim", "cell", f"CAST((n + {block} - 1) div {block} AS INT) AS parts")
    dealt = homes.withColumn("c2", F.pmod(F.xxhash64("cell"), F.lit(1021))).join(parts.withColumn("c2", F.pmod(F.xxhash64("cell"), F.lit(1021))), ["label", "dim", "cell", "c2"])
    dealt = dealt.select("label", "dim", "cell", "parts", F.expr("CAST(pmod(xxhash64(node), parts) AS INT)").alias("part"), "node", "many", "embedding")
    most = math.sqrt(max(0.0, 2 - 2 * threshold)) / 3

    # 1. a tree a block
    home = ["label", "dim", "cell", "part"]
    ordered = dealt.repartition(*home).sortWithinPartitions(*home)
    whole = "label string, dim int, cell int, parts int, part int, node long, many long, embedding array<double>, links long, root long, anchor long, radius double"

    def in_block(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> list:
            node, many = t.column("node").to_numpy(), t.column("many").to_numpy()
            run = Run(matrix(t), None, threshold)
            links, root = np.zeros(len(node), np.int64), node.copy()
            linked, n, r = run.report([node], [many])
            by = np.argsort(node)
            at = by[np.searchsorted(node[by], linked)]
            links[at], root[at] = n, r
            of, radius = run.trees[0].anchors(most)
            same = [t.column(c).combine_chunks() for c in ("label", "dim", "cell", "parts", "part", "node", "many", "embedding")]
            return [pa.RecordBatch.from_arrays([*same, *map(pa.array, (links, root, node[of], radius))], names=[c.split()[0] for c in whole.split(", ")])]

        yield from runs(batches, home, work)

    members = stored.put(ordered.mapInArrow(in_block, whole))

    # 2. anchors against the other blocks of their label
    anchors = members.groupBy("label", "dim", "cell", "parts", "part", "anchor", "radius").agg(F.sum("many").alias("many"))
    centres = members.where("node = anchor").select(F.col("node").alias("anchor"), "embedding")
    several = F.col("parts") > 1
    if cells.value:
        several |= F.concat_ws(" ", "dim", "label").isin([f"{dim} {label}" for label, dim in cells.value])
    anchors = anchors.where(several).join(centres, "anchor").select("label", "dim", "cell", "parts", "part", "anchor", "radius", "many", "embedding")
    reach = math.sqrt(max(0.0, 2 - 2 * threshold)) + EPS
    pair = "label string, dim int, low long, high long, side int, anchor long, radius double, many long, embedding array<double>"

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            of, mine, other = [], [], []
            for i, (label, dim, cell, parts, part, radius, e) in enumerate(zip(*(r.column(c).to_pylist() for c in ("label", "dim", "cell", "parts", "part", "radius", "embedding")), strict=True)):
                blocks = [(cell << 32) + p for p in range(parts) if p != part]
                known = cells.value.get((label, dim))
                if known is not None:
                    x = np.asarray(e)
                    d = np.linalg.norm(known[0] - x / np.linalg.norm(x), axis=1)
                    for j, (n, far) in known[1].items():
                        if j != cell and d[j] <= far + radius + reach:
                            blocks += [(j << 32) + p for p in range(n)]
                of += [i] * len(blocks)
                mine += [(cell << 32) + part] * len(blocks)
                other += blocks
            a, b = np.asarray(mine, np.int64), np.asarray(other, np.int64)
            out = {"low": pa.array(np.minimum(a, b)), "high": pa.array(np.maximum(a, b)), "side": pa.array((a > b).astype(np.int32))}
            yield pa.RecordBatch.from_pydict({n: out[n] if n in out else r.column(n).take(pa.array(of, pa.int64())) for n in (c.split()[0] for c in pair.split(", "))})

    met = ["label", "dim", "low", "high"]
    between_blocks = anchors.mapInArrow(meet, pair).repartition(*met).sortWithinPartitions(*met)

    def upper(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> list:
            side, node, many, radius, x = (*(t.column(c).to_numpy() for c in ("side", "anchor", "many", "radius")), matrix(t))
            a, b = side == 0, side == 1
            if not a.any() or not b.any():
                return []
            run = Run(x[a], x[b], threshold, (radius[a], radius[b]))
            linked, n, root = run.report([node[a], node[b]], [many[a], many[b]])
            i, j = (np.concatenate([np.zeros(0, np.int64), *(p[k] for p in run.open)]) for k in (0, 1))
            left, right = node[a][i], node[b][j]
            none = lambda m: pa.nulls(m, pa.int64())
            return [
                pa.RecordBatch.from_arrays([pa.array(linked), pa.array(n), pa.array(root), none(len(n))], names=["anchor", "links", "root", "other"]),
                pa.RecordBatch.from_arrays([pa.array(left), none(len(left)), none(len(left)), pa.array(right)], names=["anchor", "links", "root", "other"]),
            ]

        yield from runs(batches, met, work)

    found = stored.put(between_blocks.mapInArrow(upper, "anchor long, links long, root long, other long"))

    # 3. the points of anchors that are left undecided
    left = stored.put(found.where("other IS NOT NULL").select(F.col("anchor").alias("a"), F.col("other").alias("b")))
    of = lambda n, k: left.join(members.select(F.col("anchor").alias(n), "node", "many", "embedding"), n).select("a", "b", F.lit(k).alias("side"), "node", "many", "embedding")
    last = of("a", 0).union(of("b", 1)).repartition("a", "b").sortWithinPartitions("a", "b")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def work(t: pa.Table) -> list:
            side, node, many, x = (*(t.column(c).to_numpy() for c in ("side", "node", "many")), matrix(t))
            a, b = side == 0, side == 1
            cols = Run(x[a], x[b], threshold).report([node[a], node[b]], [many[a], many[b]])
            return [pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["node", "links", "root"])]

        yield from runs(batches, ["a", "b"], work)

    late = stored.put(last.mapInArrow(decide, "node long, links long, root long"))

    linked = found.where("other IS NULL")
    edges = members.where("root <> node").select(F.col("node").alias("a"), F.col("root").alias("b"))
    # a point's anchor is within reach of it, so what links the anchors' points links the anchors
    edges = edges.union(linked.select("anchor", "root")).union(late.select("node", "root"))
    labels = components(spark, edges, stored, small_graph)
    by_anchor = linked.groupBy("anchor").agg(F.sum("links").alias("far"))
    by_node = late.groupBy("node").agg(F.sum("links").alias("late"))
    per_point = members.join(by_anchor, "anchor", "left").join(by_node, "node", "left").join(labels.withColumnRenamed("root", "top"), "node", "left")
    n_links = F.col("many") - 1 + F.col("links") + F.coalesce("far", F.lit(0)) + F.coalesce("late", F.lit(0))
    per_point = stored.put(per_point.select("label", "embedding", "dim", "node", n_links.alias("n_links"), F.coalesce("top", "node").alias("root")))
    stored.keep_only(rows, per_point)
    usable = rows.where("usable").withColumn("dim", F.size("embedding")).join(per_point, ["label", "embedding", "dim"]).select("vec_id", "n_links", F.when(F.col("vec_id").isNotNull(), F.col("root")).alias("component_id"))
    rest = rows.where("NOT usable").select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").cast("long").alias("component_id"))
    every = usable.union(rest)
    return every.withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))

"""Near-duplicate documents by BagMinHash.

*Similarity.* Texts are lower-cased and split into words: runs of ASCII letters and digits and of any characters
beyond ASCII. A text is the multiset of its runs of five words (one run, where it has fewer words). Two texts
are linked where the weighted Jaccard similarity of the multisets, sum of minima over sum of maxima, is at
least 0.8. A class is a connected component of links.

*Signature.* Over an element's weight axis, discretised to whole counts, and over time there is a Poisson
process, the same for every text that holds the element. The axis is halved hierarchically, into
(0, 1], (1, 2], (2, 4], (4, 8] and so on, each part with a process of its own whose rate is its size; within the part in
which the element's count ends, a point's place decides whether it is under the count. Each point falls on
one of SIZE positions; a position's signature value is one byte of a hash of its earliest point. Two texts have the same
earliest point at a position with exactly their weighted Jaccard similarity J as probability, and the same byte with
J + (1 - J) / 256; the thresholds on agreement allow for that, and what they let through is verified. Points come in order of time and only up to a
horizon that leaves few positions open, so long texts generate no more points than short ones; texts
with an open position go on to twice the horizon.

*Candidates.* SIZE / ROWS bands of the signature are bucket keys. At similarity 0.8 a pair shares no bucket
with probability under 1e-4. Copies of a text are one node. In each bucket of several nodes the smallest is
paired with the others; pairs whose signatures agree too little to be similar go, the others are verified on
the words themselves. Buckets whose nodes are by then in one class are done, since classes are what
is asked for. In the others the remaining nodes get signatures of LONG positions, which are compared block by
block, and pairs from different classes that may be similar by the words carried along are verified too: in the end every pair in a bucket was compared or is in one class.
No bucket is gathered in a task, and pairs are emitted only where their signatures agree.

Defined results: a null text is the empty one; equal texts are of one class, those without words too; a
text without words is linked with no other text; the class is named by its smallest doc_id, whose row stays; texts
are told apart by their SHA-256, so different texts under one doc_id are of different classes unless they are similar. Where
that leaves several classes with one smallest doc_id, one of them has its name, and the others, like classes
without any doc_id, are named by a number of their own from 2**62 on; of repeated rows one stays; an
empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SMALL_GRAPH, Stored, by_size, components, merge_components

SHINGLE, THRESHOLD = 5, 0.8
SIZE, ROWS = 192, 6
LONG = 768
#: Signature agreement that a pair of similarity 0.8 falls short of with probability under 1e-4, as with the bands.
LEAST_AGREEMENT = 0.68
LEAST_LONG_AGREEMENT = 0.745
#: Nodes of a block, up to PARTS blocks a bucket; a larger bucket has larger blocks, up to LARGE nodes.
BLOCK, PARTS, LARGE = 256, 4, 2048
#: Texts of at most so many runs of words carry them into the blocks, as 32 bits each.
CARRIED = 8192
#: What collisions of 32 bits can move a similarity by is far below.
MARGIN = 0.01
WAVES = 2
_U = np.uint64
_P = _U(0x9E3779B97F4A7C15)  # odd, so it has an inverse modulo 2**64
_P_INV = _U(pow(int(_P), -1, 1 << 64))


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def _powers(p: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, p, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_WORD = np.zeros(256, bool)
_WORD[128:] = True
_WORD[[*range(ord("0"), ord("9") + 1), *range(ord("a"), ord("z") + 1)]] = True


def shingles(texts: list[str], size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """(text index, 64-bit hash) of every run of `size` words of every text, in order."""
    encoded = [t.lower().encode("utf-8", "surrogatepass") for t in texts]
    data = np.frombuffer(b"\n".join(encoded) + b"\n", np.uint8)
    inside = _WORD[data]
    edge = np.diff(inside.astype(np.int8), prepend=0)
    start, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    if not len(start):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    summed = np.concatenate([np.zeros(1, np.uint64), np.cumsum((data.astype(np.uint64) + _U(1)) * _powers(_P, len(data)), dtype=np.uint64)])
    word = mix((summed[end] - summed[start]) * _powers(_P_INV, len(data))[start] + (end - start).astype(np.uint64))
    text_end = np.cumsum([len(e) + 1 for e in encoded])
    owner = np.searchsorted(text_end, start, side="right")
    many = np.bincount(owner, minlength=len(texts))
    run = np.zeros(len(word), np.uint64)
    short = many[owner] < size
    for k in range(size):
        n = max(0, len(word) - k)  # a slice may hold a few words in all
        follows = owner[:n] == owner[k:]
        run[:n] += np.where(follows, mix(word[k:] + _U(k + 1)), _U(0))
    first = np.flatnonzero(np.diff(owner, prepend=-1))
    begins = np.zeros(len(word), bool)
    begins[first] = True
    whole = np.arange(len(word)) + size <= np.cumsum(many)[owner]
    keep = whole | (short & begins)
    return owner[keep], mix(run[keep])


def multisets(texts: list[str]) -> list[tuple[np.ndarray, np.ndarray]]:
    owner, run = shingles(texts)
    ends = np.searchsorted(owner, np.arange(len(texts) + 1))
    return [np.unique(run[a:b], return_counts=True) for a, b in zip(ends, ends[1:])]


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Weighted Jaccard similarity of two multisets; 0 where either is empty."""
    if not len(a[0]) or not len(b[0]):
        return 0.0
    _, i, j = np.intersect1d(a[0], b[0], assume_unique=True, return_indices=True)
    low = int(np.minimum(a[1][i], b[1][j]).sum())
    return low / (int(a[1].sum()) + int(b[1].sum()) - low)


def carried(texts: list[str]) -> list[bytes | None]:
    """Each text's multiset as sorted 32-bit numbers, a repeated element's occurrences told apart; None for long texts."""
    out: list[bytes | None] = []
    for element, count in multisets(texts):
        if int(count.sum()) > CARRIED:
            out.append(None)
            continue
        nth = np.arange(int(count.sum())) - np.repeat(np.cumsum(count) - count, count)
        each = mix(np.repeat(element, count) + nth.astype(np.uint64) * _P)
        out.append(np.unique((each >> _U(32)).astype(np.uint32)).tobytes())
    return out


def similarities(one: np.ndarray, others: list[np.ndarray]) -> np.ndarray:
    """Of one multiset with others, as carried() has them."""
    n = np.array([len(x) for x in others])
    every = np.concatenate(others)
    same = one[np.minimum(np.searchsorted(one, every), len(one) - 1)] == every
    low = np.add.reduceat(same.astype(np.int64), np.cumsum(n) - n)
    return low / (len(one) + n - low)


def signatures(texts: list[str], size: int = SIZE) -> np.ndarray:
    """[texts, size] bytes; rows of texts without words are zeros."""
    owner, run = shingles(texts)
    out = np.zeros((len(texts), size), np.uint8)
    if not len(run):
        return out
    key = np.sort((owner.astype(np.uint64) << _U(44)) | (run >> _U(20)))
    first = np.flatnonzero(np.diff(key, prepend=key[0] ^ _U(1)))
    element, weight = key[first], np.diff(np.append(first, len(key)))
    doc = (element >> _U(44)).astype(np.int64)
    total = np.bincount(doc, weights=weight, minlength=len(texts))
    # parts of the weight axis: part 0 is (0, 1], part k is (2**(k-1), 2**k]
    parts = [(np.arange(len(doc)), 0, np.ones(len(doc)), np.ones(len(doc)))]
    k = 1
    while (has := np.flatnonzero(weight > 1 << (k - 1))).size:
        wide = float(1 << (k - 1))
        parts.append((has, k, np.full(len(has), wide), np.minimum(wide, weight[has] - wide)))
        k += 1
    of = np.concatenate([p[0] for p in parts])
    part = np.concatenate([np.full(len(p[0]), p[1], np.uint64) for p in parts])
    wide, under = (np.concatenate([p[i] for p in parts]) for i in (2, 3))
    seed = mix((element[of] & _U((1 << 44) - 1)) * _P + part)
    doc = doc[of]
    best = np.full(len(texts) * size, np.inf)
    value = np.zeros(len(texts) * size, np.uint8)
    open_docs = total > 0
    horizon = np.log(size) + 2.0
    while open_docs.any():
        until = np.where(open_docs, horizon / np.maximum(total, 1), 0.0)
        # an element's points: gap, position, place under the part's width; all from its seed and the point's number
        alive = np.arange(len(seed))
        time, n = np.zeros(len(seed)), 0
        while len(alive):
            n += 1
            h = mix(seed[alive] + _U(n * int(_P) % (1 << 64)))
            gap = -np.log(((h >> _U(11)).astype(np.float64) + 1) * 2.0**-53) / (size * wide[alive])
            t = time[alive] + gap
            ok = t < until[doc[alive]]
            alive, t, h = alive[ok], t[ok], h[ok]
            time[alive] = t
            g = mix(h + _U(0x632BE59BD9B4E019))
            place = (g >> _U(40)).astype(np.float64) * 2.0**-24
            hit = place * wide[alive] < under[alive]
            at = doc[alive[hit]] * size + ((g[hit] & _U(0xFFFFFF)) * _U(size) >> _U(24)).astype(np.int64)
            x = t[hit]
            np.minimum.at(best, at, x)
            won = best[at] == x
            value[at[won]] = (g[hit][won] >> _U(28)).astype(np.uint8)
        open_docs &= np.isinf(best.reshape(len(texts), size)).any(axis=1)
        horizon *= 2
    out[:] = value.reshape(len(texts), size)
    return out


def _signed(docs: DataFrame) -> DataFrame:
    """doc_id, rid, digest, sig (null without words) of every row."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, "text"):
                texts = part.column("text").to_pylist()
                sig = signatures(texts)
                has = np.zeros(len(texts), bool)
                has[np.unique(shingle_owner(texts))] = True
                col = pa.array([s.tobytes() if y else None for s, y in zip(sig, has, strict=True)], pa.binary())
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "rid": part.column("rid"), "digest": part.column("digest"), "sig": col})

    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("rid"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), text.alias("text"))
    return rows.mapInArrow(sign, "doc_id long, rid long, digest binary, sig binary")


def shingle_owner(texts: list[str]) -> list[int]:
    """Texts with at least one word."""
    table = _WORD.tobytes()
    return [i for i, t in enumerate(texts) if b"\x01" in t.lower().encode("utf-8", "surrogatepass").translate(table)]


def _agree(pairs: DataFrame, groups: DataFrame) -> DataFrame:
    """Pairs (a, b) whose signatures agree often enough."""

    def agree(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for r in batches:
            x, y = (np.frombuffer(b"".join(r.column(c).to_pylist()), np.uint8).reshape(-1, SIZE) for c in ("sa", "sb"))
            keep = pa.array((x == y).mean(axis=1) >= LEAST_AGREEMENT)
            yield pa.RecordBatch.from_pydict({"a": r.column("a").filter(keep), "b": r.column("b").filter(keep)})

    of = lambda n: groups.select(F.col("node").alias(n), F.col("sig").alias("s" + n))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "sa", "sb").mapInArrow(agree, "a long, b long")


def _long_signatures(texts: DataFrame) -> DataFrame:
    """(node, sig, short, words) of every (node, text): LONG positions, the usual ones, and carried()."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, "text"):
                own = part.column("text").to_pylist()
                made = (signatures(own, n) for n in (LONG, SIZE))
                sig, short = (pa.array([x.tobytes() for x in m], pa.binary()) for m in made)
                yield pa.RecordBatch.from_pydict({"node": part.column("node"), "sig": sig, "short": short, "words": pa.array(carried(own), pa.binary())})

    return texts.select("node", "text").mapInArrow(sign, "node long, sig binary, short binary, words binary")


def _within(members: DataFrame, signed: DataFrame, threshold: float) -> DataFrame:
    """Pairs (a, b, agreement) of nodes of one bucket (key) and different classes (root) whose long signatures agree often enough.

    A bucket of more than BLOCK nodes is dealt into blocks, and each pair of blocks is compared in a run of rows of its
    own, so no run exceeds two blocks. Of pairs whose signatures agree, those whose words are carried along go unless these
    are similar up to MARGIN, so that texts near the threshold aren't fetched for each pair. Only what may be similar is
    emitted, and by one bucket: that of the first band that the two share. Where that bucket isn't open, or one of them was its smallest node, they were met before.
    """
    blocks = members.withColumn("parts", F.expr(f"CAST(greatest(least((n + {BLOCK} - 1) div {BLOCK}, {PARTS}), (n + {LARGE} - 1) div {LARGE}) AS INT)"))
    blocks = blocks.withColumn("mine", F.pmod(F.xxhash64("node"), F.col("parts")).cast("int"))
    other = F.explode(F.expr("sequence(0, parts - 1)")).alias("other")
    blocks = blocks.join(signed, "node").select("key", "band", "node", "root", "sig", "short", "words", "mine", other)
    blocks = blocks.select("key", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"), "mine", "band", "node", "root", "sig", "short", "words")
    ordered = blocks.repartition("key", "i", "j").sortWithinPartitions("key", "i", "j")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def run(rows: list) -> list[tuple[np.ndarray, ...]]:
            i, j, mine, band, node, root, sig, short, words = (np.concatenate(c) for c in zip(*rows, strict=True))
            words = [w and np.frombuffer(w, np.uint32) for w in words]
            found = []
            one = np.flatnonzero(mine == i[0])
            two = one if i[0] == j[0] else np.flatnonzero(mine == j[0])
            for k, x in enumerate(one):
                rest = two[k + 1 :] if i[0] == j[0] else two
                rest = rest[(root[rest] != root[x]) & (node[rest] != node[x])]
                if len(rest):
                    same = (sig[rest] == sig[x]).mean(axis=1)
                    hit = same >= LEAST_LONG_AGREEMENT
                    shared = (short[rest[hit]] == short[x]).reshape(-1, SIZE // ROWS, ROWS).all(axis=2)
                    hit[hit] = shared.argmax(axis=1) == band[0]
                    at = [k for k in np.flatnonzero(hit) if words[rest[k]] is not None] if words[x] is not None else []
                    if at:
                        hit[at] = similarities(words[x], [words[rest[k]] for k in at]) >= threshold - MARGIN
                    found.append((np.minimum(node[x], node[rest[hit]]), np.maximum(node[x], node[rest[hit]]), same[hit]))
            return found

        now, rows = None, []
        kinds = (("a", np.int64), ("b", np.int64), ("agreement", np.float64))
        out = lambda f: pa.RecordBatch.from_pydict({n: pa.array(np.concatenate([p[k] for p in f]) if f else np.zeros(0, t)) for k, (n, t) in enumerate(kinds)})
        for r in batches:
            key, i, j, mine, band, node, root = (r.column(c).to_numpy() for c in ("key", "i", "j", "mine", "band", "node", "root"))
            sig, short = (np.frombuffer(b"".join(r.column(c).to_pylist()), np.uint8).reshape(-1, n) for c, n in (("sig", LONG), ("short", SIZE)))
            words = np.array(r.column("words").to_pylist(), object)
            new = np.ones(len(key), bool)
            new[1:] = (np.diff(key) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)
            starts, found = np.flatnonzero(new).tolist(), []
            for a, b in zip(starts, [*starts[1:], len(key)], strict=True):
                this = (key[a], i[a], j[a])
                if this != now and rows:
                    found += run(rows)
                    rows = []
                now = this
                rows.append((i[a:b], j[a:b], mine[a:b], band[a:b], node[a:b], root[a:b], sig[a:b], short[a:b], words[a:b]))
            yield out(found)
        if rows:
            yield out(run(rows))

    return ordered.mapInArrow(compare, "a long, b long, agreement double")


def _verify(pairs: DataFrame, texts: DataFrame, threshold: float) -> DataFrame:
    """Pairs whose multisets overlap enough, on the words themselves."""

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, left = None, None
        for r in batches:
            for part in by_size(r, "tb"):
                a, ta = part.column("a").to_pylist(), part.column("ta")
                keep = []
                for i, right in enumerate(multisets(part.column("tb").to_pylist())):
                    if a[i] != last:
                        last, left = a[i], multisets([ta[i].as_py()])[0]
                    keep.append(overlap(left, right) >= threshold)
                keep = pa.array(keep, pa.bool_())
                yield pa.RecordBatch.from_pydict({"a": part.column("a").filter(keep), "b": part.column("b").filter(keep)})

    of = lambda n: texts.select(F.col("node").alias(n), F.col("text").alias("t" + n))
    return pairs.join(of("b"), "b").join(of("a"), "a").select("a", "b", "ta", "tb").mapInArrow(verify, "a long, b long")


def near_dedup(docs: DataFrame, threshold: float = THRESHOLD, small_graph: int = SMALL_GRAPH) -> DataFrame:
    """doc_id, class_id, class_size, kept, text_sha256 for every row of docs."""
    spark = docs.sparkSession
    stored = Stored(spark)
    signed = stored.put(_signed(docs))
    groups = signed.groupBy("digest", "sig").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")).alias("one"), F.count(F.lit(1)).alias("copies"))
    # a text's node is the number of its first row, which nothing else has
    groups = stored.put(groups.select("digest", "sig", F.col("one.rid").alias("node"), F.col("one.doc_id").alias("first_id"), "copies"))

    bands = F.posexplode(F.expr(f"transform(sequence(0, {SIZE // ROWS - 1}), i -> xxhash64(i, substring(sig, i * {ROWS} + 1, {ROWS})))")).alias("band", "key")
    second = F.pmod("key", F.lit(1021)).alias("key2")  # joins on two keys are exchanged on both sides, and so can be split
    rows = groups.where("sig IS NOT NULL").select("node", bands)
    multi = rows.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("node").alias("least")).where("n > 1 AND n IS NOT NULL").select("key", second, "n", "least")
    members = stored.put(rows.select("node", "band", "key", second).join(multi, ["key", "key2"]))

    wanted = members.select("node").distinct().join(groups.select("node", "digest", "first_id"), "node")
    texts = docs.select("doc_id", F.coalesce(F.col("text"), F.lit("")).alias("text")).withColumn("digest", F.unhex(F.sha2(F.col("text").cast("binary"), 256)))
    texts = texts.join(wanted, (texts["digest"] == wanted["digest"]) & texts["doc_id"].eqNullSafe(wanted["first_id"])).select("node", "text")
    if signed.groupBy("doc_id", "digest").count().where("count > 1").limit(1).count():  # else texts aren't shuffled again for it
        texts = texts.dropDuplicates(["node"])
    texts = stored.put(texts)
    stored.free_shuffles()

    # the smallest node of a bucket against the others
    pairs = stored.put(members.where("node <> least").select(F.col("least").alias("a"), F.col("node").alias("b")).distinct())
    edges = stored.put(_verify(_agree(pairs, groups), texts, threshold))
    stored.free_shuffles()
    labels = components(spark, edges, stored, small_graph)

    # what is left of buckets that still hold nodes of several classes
    left = members.where("node <> least").select("key", "key2", "band", "node").join(labels, "node", "left").select("key", "key2", "band", "node", F.coalesce("root", "node").alias("root"))
    open_ = left.groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.min("root").alias("r0"), F.max("root").alias("r1")).where("r0 < r1").select("key", second, "n")
    left = stored.put(left.join(open_, ["key", "key2"]).select("key", "band", "n", "node", "root"))
    if not left.isEmpty():
        # each node's most promising pair first: most other pairs are within a class by then and need no words
        signed_long = stored.put(_long_signatures(texts.join(left.select("node").distinct(), "node", "left_semi")))
        late = stored.put(_within(left, signed_long, threshold))
        stored.free_shuffles()
        for wave in range(WAVES):
            now = late
            if wave == WAVES - 1:
                chosen = now.select("a", "b")
            else:
                best = [now.groupBy(x).agg(F.max_by(y, "agreement").alias(y)).select("a", "b") for x, y in (("a", "b"), ("b", "a"))]
                chosen = best[0].union(best[1]).distinct()
            chosen = stored.put(chosen)
            more = stored.put(_verify(chosen, texts, threshold))
            stored.free_shuffles()
            if not more.isEmpty():
                labels = merge_components(spark, labels, more, stored, small_graph)
            if wave == WAVES - 1:
                break
            root = lambda x: labels.select(F.col("node").alias(x), F.col("root").alias("r" + x))  # noqa: B023, E731
            late = late.join(chosen, ["a", "b"], "left_anti").join(root("a"), "a", "left").join(root("b"), "b", "left")
            late = stored.put(late.where(F.coalesce("ra", "a") != F.coalesce("rb", "b")).select("a", "b", "agreement"))
            stored.drop(now)
            if late.isEmpty():
                break

    classes = groups.join(labels, "node", "left").select("digest", "node", "first_id", "copies", F.coalesce("root", "node").alias("top")).withColumn("c2", F.pmod("top", F.lit(1021)))
    first = F.min(F.struct(F.col("first_id").isNull().alias("none"), "first_id", "digest", "node")).alias("one")
    named = classes.groupBy("top", "c2").agg(F.sum("copies").alias("class_size"), first)
    nameless = F.shiftrightunsigned(F.xxhash64("one.digest"), 2) + F.lit(1 << 62)
    if groups.where("first_id IS NOT NULL").groupBy("first_id").count().where("count > 1").isEmpty():
        named = named.withColumn("class_id", F.coalesce("one.first_id", nameless))
    else:
        owner = named.select(F.col("one.first_id").alias("first_id"), F.col("one.digest").alias("d")).where("first_id IS NOT NULL").groupBy("first_id").agg(F.min("d").alias("owner"))
        named = named.join(owner, named["one.first_id"] == owner["first_id"], "left")
        named = named.withColumn("class_id", F.when(F.col("one.digest") == F.col("owner"), F.col("one.first_id")).otherwise(nameless))
    named = named.select("top", "c2", "class_id", "class_size", F.col("one.node").alias("stays"))
    classes = classes.join(named, ["top", "c2"]).withColumn("d2", F.substring("digest", 1, 2))
    classes = stored.put(classes.select("digest", "d2", "class_id", "class_size", "stays"))
    stored.keep_only(signed, classes)
    rows = signed.select("doc_id", "rid", "digest", F.substring("digest", 1, 2).alias("d2")).join(classes, ["digest", "d2"])
    return rows.select("doc_id", "class_id", "class_size", (F.col("rid") == F.col("stays")).alias("kept"), F.lower(F.hex("digest")).alias("text_sha256"))

"""Sharding, exact dedup and shared helpers."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from babelframe.llm.common import Stored, components, keep_rows, lowest, merge_components
from babelframe.llm.exact_dedup import chunk_list, collides, exact_dedup
from babelframe.llm.sharding import interleave

from .data import classes, corpus, empty_documents, odd_documents


def brute_positions(rows, shards):
    by = defaultdict(list)
    for k, (doc_id, text, source) in enumerate(rows):
        b = (text or "").encode()
        h = hashlib.md5(f"shard-1:{'null' if doc_id is None else doc_id}:{zlib.crc32(b)}:{len(b) + 1}".encode()).hexdigest()
        by[source].append((h, doc_id is not None, doc_id or 0, zlib.crc32(b), len(b) + 1, k))
    out = []
    for group in by.values():
        group.sort()
        out += [((2 * r - 1) / (2 * len(group)), g) for r, g in enumerate(group, 1)]
    out.sort()
    return [(g[-1], p * shards // len(out)) for p, (_, g) in enumerate(out)]


@pytest.mark.parametrize("shards", [1, 3, 16])
def test_interleave_against_brute_force(spark, shards):
    r = random.Random(5)
    rows = [(i, f"text {i % 7}", r.choice(["a", "a", "a", "b", None])) for i in range(400)]
    got = interleave(spark.createDataFrame(rows, "doc_id long, text string, source string"), shards, cells=64).collect()
    want = {rows[k][0]: s for k, s in brute_positions(rows, shards)}
    assert {x["doc_id"]: x["shard"] for x in got} == want
    sizes = Counter(x["shard"] for x in got)
    assert max(sizes.values()) - min(sizes.values()) <= 1
    for s in range(shards):
        assert sorted(x["slot"] for x in got if x["shard"] == s) == list(range(sizes[s]))
    mix = Counter((x["shard"], rows[x["doc_id"]][2]) for x in got)
    for source, n in Counter(x[2] for x in rows).items():
        assert all(abs(mix[s, source] - n / shards) <= 2 for s in range(shards))


def test_interleave_hot_ids(spark):
    """Half the rows without a doc_id, and a fifth one repeated row: ranks as by brute force, and no cell holds them together."""
    r = random.Random(6)
    rows = [(None, f"text {i}", r.choice("ab")) for i in range(3000)] + [(7, "same", "a")] * 1200 + [(i, "t", "b") for i in range(1800)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = Counter((x["doc_id"], x["text_crc32"], x["shard"]) for x in interleave(df, 7, digits=2, cells=64).collect())
    want = Counter((rows[k][0], zlib.crc32(rows[k][1].encode()), s) for k, s in brute_positions(rows, 7))
    assert got == want
    key = F.md5(F.concat(F.lit("shard-1:null:"), F.crc32(F.col("text").cast("binary")).cast("string"), F.lit(":"), (F.octet_length("text") + 1).cast("string")).cast("binary"))
    assert df.where("doc_id IS NULL").groupBy(F.substring(key, 1, 1)).count().agg({"count": "max"}).first()[0] < 400


def test_interleave_odd_rows(spark):
    got = interleave(odd_documents(spark)).collect()
    assert len(got) == 16 and {x["law"] for x in got} == {"rows"} and all(x["grown_shard"] is None for x in got)
    assert sorted((x["doc_id"] is None, x["size"]) for x in got if x["doc_id"] in (2, 3)) == [(False, 1), (False, 1)]
    assert sorted(x["position"] for x in got) == list(range(16))
    assert interleave(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("bits", [64, 3])
def test_exact_dedup_against_brute_force(spark, bits):
    rows = corpus(90, 2)
    rows += [(i + 1000, t) for i, t in rows[::3]] + [(7000, None), (7001, "")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    if bits == 3:  # so few bits that identifiers must collide: never a wrong merge, but an error
        with pytest.raises(RuntimeError):
            exact_dedup(df, bits=bits).collect()
        return
    groups = defaultdict(list)
    for i, t in rows:
        groups[t or ""].append(i)
    for x in exact_dedup(df).collect():
        t = dict(rows)[x["doc_id"]] or ""
        assert (x["keep_id"], x["group_size"], x["kept"], x["text_sha256"]) == (max(groups[t]), len(groups[t]), x["doc_id"] == max(groups[t]), hashlib.sha256(t.encode()).hexdigest())


def test_chunks_cover_the_text(spark):
    texts = ["", "a. b.\n" * 500, "x" * 20_000, "Wort ä! " * 3000, "\n", "😀" * 5000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    for r in df.select("text", chunk_list(F.col("text")).alias("c")).collect():
        assert "".join(r["c"]) == r["text"] and all(len(c) <= 4096 for c in r["c"])
    assert not collides(df, (11, 12)) and collides(spark.createDataFrame([(str(i) * 9,) for i in range(300)], "text string"), (11, 12), 3)


def test_exact_dedup_odd_rows(spark):
    got = exact_dedup(odd_documents(spark)).collect()
    assert len(got) == 16
    kept = [x for x in got if x["kept"]]
    assert len(kept) == len({x["text_sha256"] for x in got})
    assert [x["keep_id"] for x in got if x["doc_id"] in (1, 11)] == [11] * 3
    assert {x["keep_id"] for x in got if x["doc_id"] in (2, 3)} == {3}
    assert exact_dedup(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("small", [0, 500_000])
def test_components(spark, small):
    r = random.Random(9)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)] + [(i, 500) for i in range(501, 560)]
    want = classes(600, links)
    got = components(spark, spark.createDataFrame(links, "a long, b long"), Stored(spark), small).collect()
    linked = {x for a, b in links if a != b for x in (a, b)}
    assert {x["node"]: x["root"] for x in got} == {i: want[i] for i in linked}


def test_merged_components(spark):
    r = random.Random(4)
    one, two = ([(r.randrange(200), r.randrange(200)) for _ in range(70)] for _ in range(2))
    s = Stored(spark)
    df = lambda x: spark.createDataFrame(x, "a long, b long")
    got = merge_components(spark, components(spark, df(one), s), df(two), s).collect()
    want = classes(200, one + two)
    assert {x["node"]: x["root"] for x in got} == {i: want[i] for i in {x for a, b in one + two if a != b for x in (a, b)}}


def test_keep_rows_and_lowest(spark):
    docs = odd_documents(spark)
    left = keep_rows(docs, exact_dedup(docs).select("doc_id", "text_sha256", "kept"))
    assert left.columns == docs.columns and left.count() == docs.select(F.coalesce("text", F.lit(""))).distinct().count()
    df = spark.range(1000)
    got = lowest(df, F.xxhash64("id"), 10, ["id"]).collect()
    assert got == df.orderBy(F.xxhash64("id"), "id").limit(10).collect()

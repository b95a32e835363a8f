"""WARC fixity, registration and the pipeline."""

import gzip
import os
import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__
import corpus_pipeline
from babelframe.llm.common import Stored
from babelframe.llm.warc import FixityTree, audit, damaged, fixity_report, parse_warc, read_warc, records, trees, warc_files

from .data import corpus, empty_documents, odd_documents

PAGES = "page_id long, url string, html string, file string"


def pages(spark, n=5000):
    rows = [(i * 3, f"http://h{i % 7}/p{i}", f"<p>{'x' * (i % 50)} {i}</p>", "clash") for i in range(n)]
    return spark.createDataFrame(rows + [(None, None, None, None), (-4, None, "<b>", None), (6, "http://h2/p2", "again", None)], PAGES)


def test_round_trip_and_offsets(spark):
    p = pages(spark, 300)
    got = read_warc(warc_files(p.union(spark.createDataFrame([(9, "u", "twice", None)] * 2, PAGES)))).collect()
    p = p.union(spark.createDataFrame([(9, "u", "twice", None)] * 2, PAGES))
    want = sorted((r["page_id"] or 0, r["url"] or "", r["html"] or "") for r in p.collect())
    assert sorted((r["page_id"] or 0, r["url"], r["html"]) for r in got) == want
    at = {(r["offset"], r["length"]) for r in got}
    assert {(r["offset"], r["length"]) for r in fixity_report(p, p).collect()} == at


def test_audit_finds_exactly_the_damage(spark):
    p = pages(spark)
    got = fixity_report(p, damaged(p, 101)).collect()
    bad = {r["page_id"] for r in got if not r["intact"]}
    assert len(got) == p.count() and bad == {i for i in {r["page_id"] for r in got} if i is not None and zlib.crc32(str(i).encode()) % 101 == 0}
    assert all(r["intact"] for r in fixity_report(p, p).collect())


def test_lost_record(spark):
    p = pages(spark)
    s = Stored(spark)
    a, b = trees(p, p.where("page_id <> 9000 OR page_id IS NULL"), s)
    found = audit(a, b, s).collect()
    assert any(r["page_id"] == 9000 and r["in_a"] for r in found)
    files = {r["file"] for r in found}
    assert files == {9000 // 1024}  # only the file that lost it: later records of that file moved
    assert a.levels[-1].count() <= 2  # a root for each sign of the ids


def test_hot_files(spark):
    """Half the rows without a page_id, a quarter under one, many of them equal: places as by brute force, FANOUT children at most."""
    rows = [(None, None, f"n{i % 1500}") for i in range(3000)] + [(7, "u", f"s{i % 700}") for i in range(1500)] + [(i * 2, "u", "x") for i in range(900)]
    p = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = fixity_report(p, p.where("html <> 's3'")).collect()
    assert len(got) == len(rows)
    files = {}
    for r in got:
        files.setdefault(r["warc_file"], []).append(r)
    for f, rs in files.items():
        rs.sort(key=lambda r: r["position"])
        assert [r["position"] for r in rs] == list(range(len(rs)))
        assert [(r["page_id"] or -1, r["record_sha256"]) for r in rs] == sorted((r["page_id"] or -1, r["record_sha256"]) for r in rs) or f == 0
        at = 0
        for r in rs:
            assert r["offset"] == at
            at += r["length"]
    assert all(r["intact"] for r in files[-1]) and not all(r["intact"] for r in files[0]) and len(files[-1]) == 3000
    s = Stored(spark)
    t = FixityTree(p, s)
    assert t.file_levels == 3
    for level in t.levels[:-1]:
        assert level.groupBy("up_file", "up_idx").count().agg({"count": "max"}).first()[0] <= 16
    assert records(p).count() == 1500 + 700 + 900
    assert warc_files(p).where("file = -1").count() == 3


def test_records_of_others():
    one = b"WARC/1.1\r\nwarc-type: response\r\nWARC-RECORD-ID: <urn:uuid:1>\r\nContent-length: 5\r\n\r\nhello\r\n\r\n"
    two = b"WARC/1.0\r\nWARC-Record-ID: <urn:page:-4>\r\nWARC-Target-URI: http://a\r\nContent-Length: 2\r\n\r\nhi\r\n\r\n"
    want = [(None, None, "hello", 0, len(one)), (-4, "http://a", "hi", len(one), len(two))]
    assert list(parse_warc(one + two)) == want and list(parse_warc(gzip.compress(one) + gzip.compress(two))) == want
    cut = one + two[:-8]
    assert list(parse_warc(cut)) == [want[0], (None, None, None, len(one), len(two) - 8)]
    assert list(parse_warc(one + b"\r\njunk")) == [want[0], (None, None, None, len(one) + 2, 4)]
    assert list(parse_warc(b"WARC/1.0\r\nContent-Type: x\r\n\r\nbody")) == [(None, None, None, 0, 33)] and list(parse_warc(b"")) == []


def test_empty_pages(spark):
    e = spark.createDataFrame([], PAGES)
    assert fixity_report(e, e).count() == 0


def test_registration():
    names = list(__spark_entry__.queries())
    assert all(any(n.startswith(f"op{k}_") for n in names) for k in range(1, 11)) and "pipeline" in names
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "language_id", "exact_dedup", "near_dedup", "packing"]


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="the driver's tables are not here")
def test_pipeline_stages(spark):
    d = "/root/testdata/sf0.001"
    docs = corpus_pipeline.table(spark, d, "documents")
    columns, s = docs.columns, Stored(spark)
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = s.put(stage(spark, docs, d))
        if k < 4:
            assert out.columns == columns and out.exceptAll(docs).count() == 0
        if name == "exact_dedup":
            assert out.count() == docs.select("text").distinct().count()
            assert {r["doc_id"] for r in out.collect()} == {r["m"] for r in docs.groupBy("text").agg({"doc_id": "max"}).toDF("t", "m").collect()}
        if name == "packing":
            assert {r["doc_id"] for r in out.select("doc_id").distinct().collect()} == {r["doc_id"] for r in docs.collect()}
        docs = out


def test_filters_keep_what_is_clean(spark, tmp_path):
    rows = corpus(40, 3)
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows] + [(900, "!!! ???", "en", "s", 7)], "doc_id long, text string, lang string, source string, n_chars long")
    out = corpus_pipeline.language(spark, docs, str(tmp_path))
    assert {r["doc_id"] for r in out.collect()} == {i for i, _ in rows}
    near = corpus_pipeline.near(spark, odd_documents(spark), str(tmp_path))
    assert near.columns == odd_documents(spark).columns


def test_stages_with_odd_rows(spark, tmp_path):
    """Nulls, empty and long texts, repeats and clashing names, and no rows at all, through every stage; only whole input rows come out."""
    spark.createDataFrame([(1, 0, 1), (5, 0, 0), (10, 0, 0)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    for make in (odd_documents, empty_documents):
        docs = make(spark).withColumn("toxic_predicted", F.lit("mine")).withColumn("lang_pred", F.lit(7))
        n, s = docs.count(), Stored(spark)
        for name, stage in corpus_pipeline.STAGES:
            out = s.put(stage(spark, docs, str(tmp_path)))
            if name == "packing":
                assert {r["doc_id"] for r in out.collect()} == {r["doc_id"] for r in docs.collect()}
                continue
            assert out.columns == docs.columns and out.exceptAll(docs).count() == 0
            assert (n == 0) == (out.count() == 0)
            if name in ("exact_dedup", "near_dedup"):
                assert out.select(F.coalesce("text", F.lit(""))).distinct().count() == out.count()

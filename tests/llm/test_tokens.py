"""Token counts, encoding and packing, against the libraries."""

import base64
import hashlib
import itertools
import random
import zlib
from collections import Counter

import numpy as np
import pytest

public_tokenizers = pytest.importorskip("public_tokenizers")
import tiktoken  # noqa: E402
from tokenizers import Tokenizer  # noqa: E402

from babelframe.llm.bpe import decode, encode_decode, pack_numbers, unpack_numbers  # noqa: E402
from babelframe.llm.packing import CAPACITY, WordIds, least_slack, pack, places  # noqa: E402
from babelframe.llm.token_count import ChunkMap, TokenCounter, boundaries, scan, symbols, token_counts  # noqa: E402

from .data import corpus, empty_documents, odd_documents  # noqa: E402


def read(name):
    with open(public_tokenizers.path(name), "rb") as f:
        return f.read()


@pytest.fixture(scope="module")
def byte_bpe():
    return Tokenizer.from_str(read("byte_bpe_50k.json").decode())


@pytest.fixture(scope="module")
def word_bpe():
    return Tokenizer.from_str(read("word_bpe_49k.json").decode())


def random_texts(n, seed=2):
    r = random.Random(seed)
    letters = "ab 'stredvml'  \n\t é中😀!?.\"1٣½́ΣİS"
    special = ["<|endoftext|>", "<|ENDOFTEXT|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|startoftext|>"]
    return ["".join(r.choice(special) if r.random() < 0.02 else r.choice(letters) for _ in range(r.randrange(0, 60))) for _ in range(n)]


def test_counts_match_the_library(byte_bpe):
    texts = [*random_texts(3000), "x" * 3000, " " * 700, "the " * 900, "<|endoftext|>", "'s's're", "a'rx"]
    assert TokenCounter(read("byte_bpe_50k.json"))(texts) == [len(e.ids) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]


def test_chunk_maps(byte_bpe):
    """Texts of many chunks, and pre-tokens that span several, whatever the chunk; the composition is associative."""
    counter = TokenCounter(read("byte_bpe_50k.json"))
    texts = [*random_texts(200, 9), "x" * 300, "longestwordwithoutanybreak" * 20 + " a b", " " * 90 + "'s", "中文" * 60]
    want = [len(e.ids) for e in byte_bpe.encode_batch(texts, add_special_tokens=False)]
    for span in (1, 2, 7, 64):
        assert counter(texts, span) == want
    m = counter.machine
    a, b, c = ChunkMap(b"", 0, m.walk(0, b"long")[0]), ChunkMap(b"est", 0, None), ChunkMap(b"word", 3, m.walk(0, b"x")[0])
    assert a.then(m, b).then(m, c) == a.then(m, b.then(m, c)) == scan(m, [a, b, c])[-1]


def test_chunk_size_does_not_matter():
    counter = TokenCounter(read("byte_bpe_50k.json"))
    texts = [t for t in random_texts(60, 6) if t]
    codes = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    s = symbols(codes, np.cumsum([len(t) for t in texts]), counter.classes)
    assert all((boundaries(s, c) == boundaries(s, 10**6)).all() for c in (1, 2, 7, 64))


def test_count_query(spark, byte_bpe):
    df = odd_documents(spark)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), len(byte_bpe.encode(r["text"] or "", add_special_tokens=False).ids)) for r in df.collect())
    got = token_counts(df).collect()
    assert Counter((x["doc_id"], x["n_bytes"], x["n_tokens"]) for x in got) == want and all(x["over_limit"] == (x["n_tokens"] > 512) for x in got)
    assert token_counts(empty_documents(spark)).count() == 0


def test_packed_numbers():
    for a in ([], [0], [249, 250, 1273, 1274, 65535, 65536, 10**6], list(range(2000))):
        assert unpack_numbers(pack_numbers(np.asarray(a, np.int64))).tolist() == a


@pytest.mark.parametrize("block_chars", [300, 24_000_000])
def test_encoding_matches_the_library(spark, block_chars):
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, read("byte_bpe_50k.tiktoken").splitlines())}
    enc = tiktoken.Encoding("t", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    df = odd_documents(spark).select("doc_id", "text").union(spark.createDataFrame([(i + 100, t) for i, t in enumerate(random_texts(60))], "doc_id long, text string"))
    want = Counter()
    for r in df.collect():
        ids = enc.encode_ordinary(r["text"] or "")
        want[r["doc_id"], len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((r["text"] or "").encode()).hexdigest()] += 1
    got = encode_decode(df, block_chars=block_chars, with_ids=True)
    rows = got.collect()
    assert Counter((x["doc_id"], x["n_tokens"], x["ids_sha256"], x["decoded_sha256"]) for x in rows) == want
    for x in decode(got.where("n_tokens < 2000")).collect():
        assert hashlib.sha256(x["decoded"]).hexdigest() == x["decoded_sha256"]
    assert encode_decode(empty_documents(spark)).count() == 0


def test_word_ids_match_the_library(word_bpe):
    texts = [*random_texts(1500, 7), "aaaa bbbb, ccc. x., y ,z e.g. U.S.A. don't", "Straße ÀÉ ﬁ", "<|ENDOFTEXT|>", "x<|ENDOFTEXT|>y", "<|EndOfText|>", "<|STARTOFTEXT|> a <|endoftext|>", "<|endoftext|>", "<|endoftext|> <|ENDOFTEXT|>"]
    encode = WordIds(read("word_bpe_49k.json"))
    for _ in range(2):  # once learning, once from memory
        assert [np.frombuffer(b, "<u4").tolist() for b in encode(texts)] == [e.ids for e in word_bpe.encode_batch(texts, add_special_tokens=False)]


def test_least_slack_fills_best():
    r = random.Random(3)
    for _ in range(40):
        cap = 32
        items = [r.randrange(1, cap + 1) for _ in range(r.randrange(1, 14))]
        plan = least_slack(Counter(items), cap)
        used = Counter()
        for times, takes in plan:
            assert sum(k * n for k, n in takes) <= cap
            for k, n in takes:
                used[k] += n * times
        assert used == Counter(items)
        first = sum(k * n for k, n in plan[0][1])
        rest = list(items)
        rest.remove(max(items))
        reach = {max(items) + sum(c) for n in range(len(rest) + 1) for c in itertools.combinations(rest, n) if max(items) + sum(c) <= cap}
        pad = lambda f: 0 if f & (f - 1) == 0 else cap - f
        assert pad(first) == min(map(pad, reach))


def check_packing(rows, docs, word_bpe, capacity):
    by_doc, by_seq = {}, {}
    for x in rows:
        by_doc.setdefault(x["doc_id"], []).append(x)
        by_seq.setdefault(x["sequence_id"], []).append(x)
    for i, t in docs:
        ids = np.asarray([*word_bpe.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        at = 0
        for x in sorted(by_doc[i], key=lambda x: x["start"]):
            assert x["start"] == at and x["doc_tokens"] == len(ids) and x["ids_crc32"] == zlib.crc32(ids[at : at + x["length"]].tobytes())
            at += x["length"]
        assert at == len(ids)
    for s in by_seq.values():
        at = 0
        for x in sorted(s, key=lambda x: x["offset"]):
            assert x["offset"] == at
            at += x["length"]
        assert at <= capacity
    assert sorted(by_seq) == list(range(len(by_seq)))


def test_packing(spark, word_bpe):
    docs = corpus(200, 6)
    check_packing(pack(spark.createDataFrame(docs, "doc_id long, text string"), capacity=256, cell_rows=7).collect(), docs, word_bpe, 256)


def test_packing_odd_rows(spark, word_bpe):
    df = odd_documents(spark)
    rows = pack(df, with_ids=True).collect()
    assert all(np.asarray(x["ids"], "<u4").tobytes() and zlib.crc32(np.asarray(x["ids"], "<u4").tobytes()) == x["ids_crc32"] for x in rows)
    single = [(r["doc_id"], r["text"]) for r in df.collect() if r["doc_id"] not in (None, 1)]
    check_packing(rows, single, word_bpe, CAPACITY)
    assert sum(x["length"] for x in rows if x["doc_id"] is None) == len(word_bpe.encode("no id here").ids) + 2
    assert pack(empty_documents(spark)).count() == 0 and places([]).empty

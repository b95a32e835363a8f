"""Byte-level BPE encoding and decoding by a global distinct-word shuffle.

1. Each task splits its texts into pre-tokens and takes about BLOCK_CHARS of text as a block: its distinct
   pre-tokens, numbered, and each document as the numbers of its pre-tokens in their order (the positions).
   Blocks are a stored table, so what follows never sees a block split twice; the table is bucketed by block,
   so that the documents' numbers, the largest part, are written once and never shuffled.
2. The distinct pre-tokens are exploded, in rows of one block and one hash bucket, and shuffled by bucket.
   A bucket's task encodes each distinct pre-token once, whatever the number of blocks that hold it: a word
   that stands in every document costs one entry a block.
3. The ids are joined back to the blocks, in rows of the same make, and each document is put together by
   position. Decoding looks every id up in the token-byte table, whose size the vocabulary fixes.

What stands for each step of the plain form, a row for every pre-token of every document:

- exploding pre-tokens with positions: step 1. The i-th number of a document is its pre-token at position i. A row
  (document, position, word) for each would write several times the input to disk; a number takes one to four bytes.
- encoding each distinct word once: step 2, the shuffle of distinct words by hash. A word that several blocks hold is met in
  one task; it is encoded again only if more than MEMO_WORDS other words of its bucket came in between.
- joining ids back: step 3, a join of the encoded words with the blocks on the block's number, then on the word's
  number in it. It is checked that every number finds exactly one word.
- reassembling by position: the ids of a document in the order of its numbers.
- joining the token-byte table for decoding: a look-up of every id in the table on its side, as a broadcast join would,
  whose size the vocabulary fixes. decode() does the same for any column of ids.

No document's tokens are exploded to rows; what is shuffled is the blocks' dictionaries and the packed
numbers. The largest thing a task holds is one block (or one text, where a text is longer).

Defined results: null is the empty text, with no ids; every row gets its row, repeats included; special
strings are ordinary text; an empty table gives an empty result; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Stored, once, ship_file, vocabulary

BLOCK_CHARS = 24_000_000
MEMO_WORDS = 1_000_000

BLOCKS = "block long, bucket int, first long, words binary, doc_ids array<bigint>, sizes array<bigint>, numbers binary"
RESULT = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"


def _pack(a: bytes) -> bytes:
    return pa.compress(a, codec="zstd", asbytes=True) if a else b""


def _unpack(a: bytes, size: int) -> bytes:
    return pa.decompress(a, decompressed_size=size, codec="zstd", asbytes=True) if size else b""


def pack_numbers(a: np.ndarray) -> bytes:
    """Small numbers take a byte, others two to four: lengths' planes apart, then compressed."""
    size = np.ones(len(a), np.uint8)
    for k, most in ((2, 250), (3, 4 * 256 + 250), (4, 65536)):
        size[a >= most] = k
    head = np.where(a < 250, a, 0)
    two, three, four = size == 2, size == 3, size == 4
    head[two] = 250 + (a[two] - 250) // 256
    head[three], head[four] = 254, 255
    low2 = ((a[two] - 250) % 256).astype(np.uint8)
    parts = [head.astype(np.uint8).tobytes(), low2.tobytes()]
    parts += [(a[three] >> s & 255).astype(np.uint8).tobytes() for s in (0, 8)]
    parts += [a[four].astype("<u4").tobytes()]
    sizes = np.asarray([len(p) for p in parts], "<i8").tobytes()
    return sizes + _pack(b"".join(parts))


def unpack_numbers(b: bytes) -> np.ndarray:
    sizes = np.frombuffer(b[:40], "<i8")
    data, at = _unpack(b[40:], int(sizes.sum())), np.concatenate([[0], np.cumsum(sizes)])
    part = [np.frombuffer(data[at[i] : at[i + 1]], np.uint8 if i < 4 else "<u4").astype(np.int64) for i in range(5)]
    out = part[0].copy()
    two, three, four = (out >= 250) & (out < 254), out == 254, out == 255
    out[two] = 250 + (out[two] - 250) * 256 + part[1]
    out[three] = part[2] | part[3] << 8
    out[four] = part[4]
    return out


def read_ranks(data: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in data.splitlines() if line)}


class Codec:
    def __init__(self, data: bytes):
        import tiktoken

        ranks = read_ranks(data)
        made = tiktoken.Encoding("own", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})  # a piece is one match
        # the call for bytes isn't public; the public one takes the piece as text
        self.encode_piece = getattr(made, "_encode_single_piece", None) or (lambda piece: made.encode_ordinary(piece.decode("utf-8", "surrogatepass")))
        self.bytes_of = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, i in ranks.items():
            self.bytes_of[i] = token


def blocks(docs: DataFrame, pattern: str, buckets: int, block_chars: int) -> DataFrame:
    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = once(("pattern", pattern), lambda: regex.compile(pattern)).findall
        base, made = TaskContext.get().partitionId() << 32, 0
        names = [c.split()[0] for c in BLOCKS.split(", ")]
        ids: list = []
        sizes: list[int] = []
        parts: list[np.ndarray] = []
        number: dict[str, int] = {}
        chars = 0

        def flush() -> pa.RecordBatch:
            flat = np.concatenate(parts) if parts else np.zeros(0, np.int64)
            by_use = np.argsort(-np.bincount(flat, minlength=len(number)), kind="stable")  # frequent words get small numbers
            new = np.empty(len(by_use), np.int64)
            new[by_use] = np.arange(len(by_use))
            flat = new[flat]
            raw = [w.encode("utf-8", "surrogatepass") for w in number]
            raw = [raw[i] for i in by_use.tolist()]
            block = base + made
            rows = [(block, -1, 0, None, ids, sizes, pack_numbers(flat))]
            home = np.fromiter((zlib.crc32(w) % buckets for w in raw), np.int64, len(raw))
            by = np.argsort(home, kind="stable")
            edges = np.flatnonzero(np.diff(home[by], prepend=-1)) if len(by) else []
            for a, b in zip(edges, [*edges[1:], len(by)], strict=False):
                mine = by[a:b]
                words = [raw[i] for i in mine]
                lens = pack_numbers(np.asarray([len(w) for w in words]))
                body = b"".join(words)
                head = np.asarray([len(lens), len(body)], "<i8").tobytes()
                where = pack_numbers(np.diff(mine, prepend=0))
                rows.append((block, int(home[mine[0]]), len(where), head + where + lens + _pack(body), None, None, None))
            return pa.RecordBatch.from_pydict({n: pa.array(c, t) for n, c, t in zip(names, zip(*rows), TYPES, strict=True)})

        for b in batches:
            for i, t in zip(b.column("doc_id").to_pylist(), b.column("text"), strict=True):
                text = t.as_py() or ""
                if ids and chars + len(text) > block_chars:
                    yield flush()
                    made, chars, ids, sizes, parts, number = made + 1, 0, [], [], [], {}
                words = find(text)
                ids.append(i)
                sizes.append(len(words))
                put = number.setdefault
                parts.append(np.asarray([put(w, len(number)) for w in words], np.int64))
                chars += len(text)
        if ids:
            yield flush()

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(split, BLOCKS)


TYPES = [pa.int64(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.binary()]


def encode_decode(docs: DataFrame, path: str | None = None, pattern: str | None = None, block_chars: int = BLOCK_CHARS, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and ids array<int>) for every row of docs."""
    spark = docs.sparkSession
    if pattern is None:
        from public_tokenizers import PATTERN as pattern  # noqa: N811
    key, data = ship_file(spark, path or vocabulary("byte_bpe_50k.tiktoken"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(16, min(4096, 2 * parts))
    stored = Stored(spark)
    made = stored.put_bucketed(blocks(docs, pattern, buckets, block_chars), "block", parts)

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = once(("codec", key), lambda: Codec(data.value))
        memo: dict[bytes, list[int]] = {}
        now = None
        for b in batches:
            out = []
            for block, bucket, first, packed in zip(*(b.column(c).to_pylist() for c in ("block", "bucket", "first", "words")), strict=True):
                if bucket != now:
                    now, memo = bucket, {}
                n_lens, n_body = np.frombuffer(packed[:16], "<i8")
                lens = unpack_numbers(packed[16 + first : 16 + first + n_lens])
                body, at, ids, sizes = _unpack(packed[16 + first + n_lens :], int(n_body)), 0, [], []
                for n in lens.tolist():
                    word = body[at : at + n]
                    at += n
                    found = memo.get(word)
                    if found is None:
                        if len(memo) >= MEMO_WORDS:
                            memo.clear()
                        found = memo[word] = codec.encode_piece(word)
                    ids += found
                    sizes.append(len(found))
                raw = np.asarray(ids, "<u4").tobytes() if max(ids, default=0) > 65535 else np.asarray(ids, "<u2").tobytes()
                counts = pack_numbers(np.asarray(sizes, np.int64))
                head = np.asarray([first, len(counts), len(raw), len(raw) // max(1, len(ids))], "<i8").tobytes()
                out.append((block, head + packed[16 : 16 + first] + counts + _pack(raw)))
            if out:
                yield pa.RecordBatch.from_pydict({"block": pa.array([o[0] for o in out], pa.int64()), "ids": pa.array([o[1] for o in out], pa.binary())})

    words = made.where("bucket >= 0").select("block", "bucket", "first", "words").repartition(buckets, "bucket").sortWithinPartitions("bucket")
    encoded = words.mapInArrow(encode, "block long, ids binary")
    whole = made.where("bucket < 0").select("block", "doc_ids", "sizes", "numbers")

    def put_together(docs: pa.Table, words: pa.Table) -> pa.Table:
        codec = once(("codec", key), lambda: Codec(data.value))
        where, counts, ids = [], [], []
        if docs.num_rows != 1:
            raise RuntimeError("a block has lost its documents")
        doc = docs.to_pylist()[0]
        for packed in (p.as_py() for p in words.column("ids")):
            n_where, n_counts, n_raw, width = np.frombuffer(packed[:32], "<i8").tolist()
            where.append(np.cumsum(unpack_numbers(packed[32 : 32 + n_where])))
            counts.append(unpack_numbers(packed[32 + n_where : 32 + n_where + n_counts]))
            ids.append(np.frombuffer(_unpack(packed[32 + n_where + n_counts :], n_raw), "<u2" if width <= 2 else "<u4").astype(np.int64))
        numbers = unpack_numbers(doc["numbers"])
        place, size, flat = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (where, counts, ids))
        if len(place) != len(np.unique(place)) or (len(numbers) and int(numbers.max()) >= len(place)):
            raise RuntimeError("a block's words don't match its documents")
        begin = np.cumsum(size) - size
        starts, lens = np.empty(len(place), np.int64), np.empty(len(place), np.int64)
        starts[place], lens[place] = begin, size
        shown, raw, as_list = [], [], flat.tolist()
        for a, n in zip(starts.tolist(), lens.tolist(), strict=True):
            mine = as_list[a : a + n]
            shown.append(" ".join(map(str, mine)).encode())
            raw.append(b"".join([codec.bytes_of[i] for i in mine]))
        out, at = {"doc_id": doc["doc_ids"], "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}, 0
        out |= {"ids": []} if with_ids else {}
        for n in doc["sizes"]:
            mine = numbers[at : at + n]
            at += n
            k = mine.tolist()
            out["n_tokens"].append(int(lens[mine].sum()))
            out["ids_sha256"].append(hashlib.sha256(b" ".join([shown[i] for i in k])).hexdigest())
            out["decoded_sha256"].append(hashlib.sha256(b"".join([raw[i] for i in k])).hexdigest())
            if with_ids:
                out["ids"].append([i for w in k for i in as_list[starts[w] : starts[w] + lens[w]]])
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32())]
        return pa.table({c: pa.array(v, k) for (c, v), k in zip(out.items(), kinds, strict=False)})

    return whole.groupBy("block").cogroup(encoded.groupBy("block")).applyInArrow(put_together, RESULT + (", ids array<int>" if with_ids else ""))


def decode(tokens: DataFrame, path: str | None = None, column: str = "ids") -> DataFrame:
    """Adds `decoded`, the bytes of an id array (null for null), by the token-byte table."""
    key, data = ship_file(tokens.sparkSession, path or vocabulary("byte_bpe_50k.tiktoken"))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = once(("token bytes", key), lambda: {i: t for t, i in read_ranks(data.value).items()})
        for b in batches:
            found = [None if ids is None else b"".join([table[i] for i in ids]) for ids in b.column(column).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(found, pa.binary())], names=[*b.schema.names, "decoded"])

    from pyspark.sql.types import BinaryType, StructField, StructType

    return tokens.mapInArrow(look_up, StructType([*tokens.schema.fields, StructField("decoded", BinaryType())]))

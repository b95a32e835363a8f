"""Packing into sequences by minimum bin slack.

A document is its token ids followed by one separator id. Whole windows' worth of ids are cut off from
its front and fill a sequence each; the rest, shorter than a window, is a remainder. Remainders differ
only in length, so the packing needs just how many there are of each length: at most capacity - 1
numbers, whatever the size of the corpus. On these counts the driver fills one window at a time: the
longest length left goes in, a bitset subset-sum over the counts of the others finds the fill with the
least padding, backtracking yields how many of each length it takes, and the pattern is repeated as
often as the counts allow. Each pattern uses up a length, so there are a few thousand patterns at most.

Pieces then learn their place from their rank among pieces of equal length. Ranks come from the counts
of cells (length, hash) plus the place within a cell. A length with n pieces has cells of FEW pieces, up to 4096 of
them, and beyond that as many as it takes at CELL_ROWS to a cell, so neither full windows, the most frequent length, nor
a length that a third of all documents share puts more than that many rows into one sort.

Padding: a sequence is padded to the capacity, except where its ids number a power of two.

Defined results: a null text is an empty document of one id, the separator; repeated rows are packed each;
ties of rank fall to hash, doc_id, start and checksum; an empty table gives no pieces; other columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import Stored, by_size, once, ship_file, vocabulary

CAPACITY = 2048
SEPARATOR = 1
FEW, CELL_ROWS = 128, 20_000
MEMO_WORDS = 900_000

#: Beyond these, lower-casing by Python and by the tokenizer may differ.
_ODD = re.compile("[^\x00-\u024f]")


def _odd(text: str) -> bool:
    """Whether white space or lower case may mean something else to Python: \\x1c-\\x1f are spaces to Python only."""
    return "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text or (not text.isascii() and _ODD.search(text) is not None)


class WordIds:
    """Token ids of whole texts as little-endian unsigned 32-bit bytes.

    The tokenizer drops white space and never merges across it, so the ids of a text are those of its
    white-space-separated words. Each distinct word is encoded by the library once and kept, up to a
    bound. Texts with characters on which word splitting could differ are encoded whole. So are texts that hold a
    special string in another case: the library looks for special strings before it lower-cases.
    """

    def __init__(self, data: bytes):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_str(data.decode())
        self.ends_word = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends_word[[i for t, i in self.tokenizer.get_vocab().items() if t.endswith("</w>")]] = True
        self.ranked = self._by_rank(data)
        self.memo: dict[str, bytes] = {}
        special = [t["content"] for t in json.loads(data)["added_tokens"]]
        self.cased = re.compile("|".join(map(re.escape, special)), re.IGNORECASE) if special else None

    def _whole(self, text: str) -> bool:
        return _odd(text) or (self.cased is not None and any(m != m.lower() for m in self.cased.findall(text)))

    @staticmethod
    def _by_rank(data: bytes):
        """The same merges for a library that merges by the rank of the joined bytes, and the id of each rank.

        A word's end is the byte 0xff, which UTF-8 never holds and which joins the last byte before all merges. Where every
        joined token has one merge, rank of the pair and rank of the token are the same order. None for other vocabularies.
        """
        import tiktoken

        spec = json.loads(data)["model"]
        if spec.get("end_of_word_suffix") != "</w>" or spec.get("continuing_subword_prefix"):
            return None
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}

        def raw(token: str) -> bytes:
            ends = token.endswith("</w>")
            return bytes(byte_of[c] for c in (token[:-4] if ends else token)) + b"\xff" * ends

        ranks = {bytes([b]): b for b in range(256)} | {bytes([b, 255]): 256 + b for b in range(255)}
        for i, m in enumerate(spec["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            if a.endswith("</w>") or raw(a) + raw(b) in ranks:
                return None
            ranks[raw(a) + raw(b)] = 1000 + i
        id_of = np.zeros(1000 + len(spec["merges"]), "<u4")
        for token, i in spec["vocab"].items():
            if all(c in byte_of for c in token.removesuffix("</w>")) and raw(token) in ranks:
                id_of[ranks[raw(token)]] = i
        made = tiktoken.Encoding("words", pat_str="(?s).+", mergeable_ranks=ranks, special_tokens={})
        core = getattr(getattr(made, "_core_bpe", None), "encode_single_piece", None)
        return None if core is None else (core, id_of)  # a word's end isn't UTF-8, so the public call can't take it

    def _encode(self, words: list[str]) -> list[bytes]:
        return [np.asarray(e.ids, dtype="<u4").tobytes() for e in self.tokenizer.encode_batch_fast(words, add_special_tokens=False)]

    def _learn(self, words: list[str]) -> None:
        """New words. A stop or comma after letters at a word's end is a pre-token of its own.

        Words of letters only are one pre-token each, so many go through the library as one text; its word-end tokens part them.
        """
        memo = self.memo
        plain, stopped, rest = [], [], []
        for w in words:
            if w.isalpha():
                plain.append(w)
            elif w[-1] in ".," and w[:-1].isalpha():
                stopped.append(w)
                if w[:-1] not in memo:
                    plain.append(w[:-1])
            else:
                rest.append(w)
        if stopped:
            plain = list(set(plain))
            rest += [c for c in ".," if c not in memo]
        if self.ranked is not None:
            encode, id_of = self.ranked
            found = [encode(w.encode() + b"\xff") for w in plain]
            raw, start = id_of[[r for f in found for r in f]].tobytes(), 0
            for w, f in zip(plain, found, strict=True):
                end = start + 4 * len(f)
                memo[w] = raw[start:end]
                start = end
            plain = []
        for k in range(0, len(plain), 1000):
            some = plain[k : k + 1000]
            ids = np.asarray(self.tokenizer.encode_batch_fast([" ".join(some)], add_special_tokens=False)[0].ids, dtype="<u4")
            ends = (np.flatnonzero(self.ends_word[ids]) + 1) * 4
            if len(ends) != len(some):
                memo.update(zip(some, self._encode(some), strict=True))
                continue
            raw, start = ids.tobytes(), 0
            for w, end in zip(some, ends.tolist(), strict=True):
                memo[w] = raw[start:end]
                start = end
        memo.update(zip(rest, self._encode(rest), strict=True))
        for w in stopped:
            memo[w] = memo[w[:-1]] + memo[w[-1]]

    def __call__(self, texts: list[str]) -> list[bytes]:
        split: list[list[str] | None] = []
        for x in texts:
            split.append(None if self._whole(x) else x.lower().split())
        new = set().union(*(s for s in split if s)) - self.memo.keys()
        if len(self.memo) + 2 * len(new) > MEMO_WORDS:
            self.memo.clear()
            new = set().union(*(s for s in split if s))
        self._learn(list(new))
        get = self.memo.__getitem__
        return [b"".join(map(get, s)) if s is not None else self._encode([x])[0] for s, x in zip(split, texts, strict=True)]


PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, capacity: int = CAPACITY, with_ids: bool = False) -> DataFrame:
    """Documents cut into full windows and one remainder each. with_ids: also the ids of each piece."""
    key, data = ship_file(docs.sparkSession, path)
    schema = PIECES + (", ids array<int>" if with_ids else "")
    end = np.asarray([SEPARATOR], dtype="<u4").tobytes()
    step = 4 * capacity

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = once(("word ids", key), lambda: WordIds(data.value))
        for b in batches:
            for part in by_size(b, "text"):
                of, rows, ids_of = [], [], []
                for i, ids in enumerate(encode([t or "" for t in part.column("text").to_pylist()])):
                    ids += end
                    for k in range(0, len(ids), step):
                        p = ids[k : k + step]
                        of.append(i)
                        rows.append((k // 4, len(p) // 4, zlib.crc32(p), len(ids) // 4))
                        if with_ids:
                            ids_of.append(np.frombuffer(p, "<u4").astype("int32"))
                cols = np.asarray(rows, dtype="int64").reshape(-1, 4)
                out = {"doc_id": part.column("doc_id").cast(pa.int64()).take(pa.array(of, pa.int64()))}
                out |= {n: pa.array(cols[:, j]) for j, n in enumerate(("start", "length", "ids_crc32", "doc_tokens"))}
                if with_ids:
                    out["ids"] = pa.array(ids_of, pa.list_(pa.int32()))
                yield pa.RecordBatch.from_pydict(out)

    return docs.select("doc_id", "text").mapInArrow(cut, schema)


def least_slack(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, list[tuple[int, int]]]]:
    """[(times, [(length, how many of it)...])...]: fillings of windows, all counts used up."""
    left = np.zeros(capacity + 1, dtype=np.int64)
    for k, v in counts.items():
        left[k] = v
    plan, mask, longest = [], (1 << (capacity + 1)) - 1, capacity
    powers = [1 << k for k in range(capacity.bit_length())]
    while True:
        while longest and not left[longest]:
            longest -= 1
        if not longest:
            return plan
        bits, stages, full = 1 << longest, [], 1 << capacity
        if not bits & full:
            have = np.flatnonzero(left[1 : capacity - longest + 1])[::-1] + 1
            for size in have.tolist():
                many = min(int(left[size]) - (size == longest), (capacity - longest) // size)
                k = 1
                while many > 0:
                    take = min(k, many)
                    stages.append((size, take, bits))
                    bits |= (bits << (size * take)) & mask
                    many -= take
                    k *= 2
                if bits & full:
                    break
        fill = bits.bit_length() - 1
        if fill not in powers:
            fill = max((p for p in powers if bits >> p & 1), default=fill)
        takes, at = {longest: 1}, fill
        for size, take, before in reversed(stages):
            if not before >> at & 1:
                takes[size] = takes.get(size, 0) + take
                at -= size * take
        times = min(int(left[k]) // n for k, n in takes.items())
        for k, n in takes.items():
            left[k] -= n * times
        plan.append((times, sorted(takes.items(), reverse=True)))


def places(plan: list[tuple[int, list[tuple[int, int]]]]) -> pd.DataFrame:
    """For each length and run of ranks: the sequence of the first and the offset within it."""
    used: dict[int, int] = {}
    rows, base = [], 0
    for times, takes in plan:
        offset = 0
        for size, n in takes:
            for _ in range(n):
                rows.append((size, used.get(size, 0), base, offset))
                used[size] = used.get(size, 0) + times
                offset += size
        base += times
    return pd.DataFrame(rows, columns=["length", "first", "sequence", "offset"], dtype="int64").sort_values(["length", "first"])


def pack(docs: DataFrame, path: str | None = None, capacity: int = CAPACITY, cell_rows: int = CELL_ROWS, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids) for every piece."""
    spark = docs.sparkSession
    stored = Stored(spark)
    cut = stored.put(pieces(docs, path or vocabulary("word_bpe_49k.json"), capacity, with_ids))
    h = F.xxhash64("doc_id", "start", "ids_crc32")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}  # at most `capacity` rows
    up = lambda n, d: -(-n // d)
    cells = F.array(*(F.lit(max(min(up(n, FEW), 4096), up(n, cell_rows))) for n in (counts.get(k, 1) for k in range(1, capacity + 1))))
    cells = spark.range(1).select(F.posexplode(cells).alias("k", "cells")).select((F.col("k") + 1).cast("long").alias("length"), "cells")
    keyed = cut.withColumn("h", h).join(F.broadcast(cells), "length").withColumn("cell", F.pmod("h", "cells")).drop("cells")
    per = keyed.groupBy("length", "cell").agg(F.count(F.lit(1)).alias("n"))
    plan = places(least_slack(counts, capacity))
    code = (plan["length"].to_numpy() << 44) + plan["first"].to_numpy()
    table = spark.sparkContext.broadcast((code, plan["first"].to_numpy(), plan["sequence"].to_numpy(), plan["offset"].to_numpy()))

    ahead = W.partitionBy("length").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    offsets = per.select("length", "cell", F.coalesce(F.sum("n").over(ahead), F.lit(0)).alias("before"))
    in_cell = W.partitionBy("length", "cell").orderBy("h", "doc_id", "start", "ids_crc32")
    ranked = keyed.withColumn("r", F.row_number().over(in_cell)).join(offsets, ["length", "cell"])
    ranked = ranked.withColumn("rank", F.col("before") + F.col("r") - 1).drop("r", "before", "cell", "h")

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code, first, sequence, offset = table.value
        for b in batches:
            rank, length = b.column("rank").to_numpy(), b.column("length").to_numpy()
            i = np.searchsorted(code, (length << 44) + rank, side="right") - 1
            found = {"sequence_id": pa.array(sequence[i] + rank - first[i]), "offset": pa.array(offset[i])}
            yield pa.RecordBatch.from_pydict({n: found[n] if n in found else b.column(n) for n in names})

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] + ["ids"] * with_ids
    schema = PIECES + ", sequence_id long, offset long" + (", ids array<int>" if with_ids else "")
    return ranked.mapInArrow(place, schema)

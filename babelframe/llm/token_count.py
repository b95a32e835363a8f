"""Token counts by finite-state compilation of a byte-level BPE tokenizer.

Two deterministic transducers, both compiled from the vocabulary file:

*Boundaries.* Characters become symbols (letter, digit, space, other white space, other, with the little
lookahead the split pattern needs folded in: the last white space before a word, the length of a
contraction). Over symbols a machine of nine states says at each character whether a pre-token begins
there. A batch of texts is one long symbol string cut into chunks. For each chunk the map from every
entry state to its exit state is computed, all chunks side by side; maps compose by a parallel prefix
scan (log2(chunks) doublings); with each chunk's entry state known, a second sweep marks the boundaries.
A text's first symbol maps every state to the same one, so texts don't influence each other, and a text
of any length is just more chunks.

*Tokens.* Within a pre-token the machine reads bytes. A state is what the future can depend on: the
suffix that may still be inside a token, and at each position where such a token might begin, the last
token of the encoding so far and the token count relative to the current one. A transition carries the
change of the count, the number of tokens that it emits. Which token ends at a position follows from adjacency: of the vocabulary's tokens
that are a suffix there, exactly one may follow the last token before it, where two tokens may be
adjacent if no merge across their seam would come before the merges that built them. Transitions are
compiled when first taken and kept, up to a bound, as are the maps of whole pre-tokens.

*Counts.* A text is cut into chunks of SPAN characters, and each chunk gets its map from the state in which it is
entered to (state at exit, tokens emitted). The token machine has far too many states to list a map entry by
entry, but every pre-token begins in state 0, so a chunk with a boundary in it maps all entry states to one exit state, and
only the bytes before its first boundary, its head, see the entry state. A map is held as (head, tokens after the
head, exit state); one without a boundary is its head alone, to be walked from whatever state comes in. Such maps compose
associatively, with counts adding up, and a text's count is the composition of its chunks' maps by the same scan.
A pre-token of many chunks, which no boundary resets, is the one case in which the scan can't do better than
walking the bytes in order.

Defined results: null is the empty text, with 0 bytes and tokens; every row gets its row, repeats
included; special strings in a text count one token each, as the library's default has it; an empty table
gives an empty result; other columns are not read.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import by_size, once, ship_file, vocabulary

LIMIT = 512
CHUNK = 256
SPAN = 1 << 16
MAX_TRANSITIONS, MAX_WORDS = 1_200_000, 500_000

# Symbols
L, N, SP, SP_LAST, WS, WS_LAST, O, A, A2, A3, END = range(11)
BEGIN = 11  # added to the symbol of a text's first character
# States: what has just been read
S0, IN_L, IN_N, IN_O, AFTER_SP, IN_WS, C1, C2, C_END = range(9)


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """next[symbol, state] and begins[symbol, state]."""
    nxt, cut = np.zeros((2 * BEGIN, 9), np.uint8), np.ones((2 * BEGIN, 9), bool)
    into = {L: IN_L, N: IN_N, O: IN_O, A: IN_O, A2: IN_O, A3: IN_O}
    for s in range(9):
        for x in range(BEGIN):
            if x in (SP, WS, SP_LAST, WS_LAST):
                # a run of white space is one pre-token but for its last character, if a word follows
                nxt[x, s] = AFTER_SP if x == SP_LAST else IN_WS
                cut[x, s] = x in (SP_LAST, WS_LAST) or s not in (IN_WS, AFTER_SP)
            elif x == END:
                nxt[x, s], cut[x, s] = S0, True
            elif s in (C1, C2):
                nxt[x, s], cut[x, s] = (C_END if s == C1 else C1), False
            elif s == AFTER_SP:
                nxt[x, s], cut[x, s] = into[x], False
            elif x in (A2, A3) and s != IN_O:
                nxt[x, s], cut[x, s] = (C1 if x == A2 else C2), True
            else:
                nxt[x, s], cut[x, s] = into[x], into[x] != s
        nxt[BEGIN:, s], cut[BEGIN:, s] = nxt[:BEGIN, S0], True
    return nxt, cut


NEXT, CUTS = _machine()


def character_classes() -> np.ndarray:
    """Class of every code point: L, N, WS (white space), O; space and apostrophe are told apart by code."""
    every = "".join(map(chr, (c for c in range(0x110000) if not 0xD800 <= c < 0xE000)))
    out = np.full(0x110000, O, np.uint8)
    for pattern, kind in ((r"\p{L}+", L), (r"\p{N}+", N), (r"\s+", WS)):
        for m in regex.finditer(pattern, every):
            a, b = ord(every[m.start()]), ord(every[m.end() - 1])
            out[a : b + 1] = kind
    out[0xD800:0xE000] = O
    return out


def symbols(codes: np.ndarray, ends: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Symbols of texts laid end to end; ends: index past each text's last character (texts aren't empty)."""
    out = classes[codes]
    last = np.zeros(len(codes), bool)
    last[ends - 1] = True
    white = out == WS
    follows = np.empty(len(codes), bool)  # a word follows in the same text
    follows[:-1], follows[-1] = ~white[1:], False
    follows &= ~last
    space = codes == 32
    out[space & white] = SP
    out[white & follows] = WS_LAST
    out[space & follows] = SP_LAST
    quote = np.flatnonzero(codes == 39)
    out[quote] = A
    if len(quote):
        room = ends[np.searchsorted(ends, quote, side="right")] - quote
        pad = np.concatenate([codes, np.zeros(2, codes.dtype)])
        a, b = pad[quote + 1], pad[quote + 2]
        two = np.isin(a, [ord(c) for c in "stmd"]) & (room > 1)
        three = (((a == ord("r")) | (a == ord("v"))) & (b == ord("e")) | (a == ord("l")) & (b == ord("l"))) & (room > 2)
        out[quote[two]], out[quote[three]] = A2, A3
    out[np.concatenate([[0], ends[:-1]])] += BEGIN
    return out


def boundaries(sym: np.ndarray, chunk: int = CHUNK) -> np.ndarray:
    """Where pre-tokens begin: chunk maps, their prefix composition, then one sweep from known states."""
    n = -(-len(sym) // chunk)
    grid = np.full(n * chunk, END, np.uint8)
    grid[: len(sym)] = sym
    grid = np.ascontiguousarray(grid.reshape(n, chunk).T)
    maps = np.tile(np.arange(9, dtype=np.uint8), (n, 1))
    flat = NEXT.ravel()
    for row in grid:
        maps = flat[row[:, None].astype(np.int32) * 9 + maps]
    step = 1
    while step < n:  # inclusive scan: maps[i] becomes the map of chunks 0..i
        later = np.take_along_axis(maps[step:], maps[:-step].astype(np.intp), axis=1)
        maps = np.concatenate([maps[:step], later])
        step *= 2
    state = np.concatenate([[S0], maps[:-1, S0]]).astype(np.uint8)
    out = np.empty((chunk, n), bool)
    cuts = CUTS.ravel()
    for j, row in enumerate(grid):
        at = row.astype(np.int32) * 9 + state
        out[j] = cuts[at]
        state = flat[at]
    return np.flatnonzero(out.T.ravel()[: len(sym)])


class ByteTransducer:
    """bytes of a pre-token -> number of its tokens."""

    def __init__(self, merges: list[tuple[bytes, bytes]]):
        self.rank: dict[tuple[bytes, bytes], int] = {}
        self.split: dict[bytes, tuple[bytes, bytes]] = {}
        for i, (a, b) in enumerate(merges):
            self.rank.setdefault((a, b), i)
            self.split.setdefault(a + b, (a, b))
        self.vocab = {bytes([i]) for i in range(256)} | self.split.keys()
        self.open = {t[:k] for t in self.vocab for k in range(1, len(t))}  # what may still grow into a token
        self.spines: dict[bytes, tuple[list, list]] = {}
        self.adjacent: dict[tuple[bytes, bytes], bool] = {}
        self.restart()

    def restart(self) -> None:
        self.states: list[tuple] = [(b"", ((None, 0),))]
        self.number = {self.states[0]: 0}
        self.moves: dict[int, int] = {}  # state << 8 | byte -> next state << 8 | (change of the count + 128)

    def _spine(self, t: bytes) -> tuple[list, list]:
        """What stands at t's left and right edge while it is built, each with the merge that replaces it."""
        found = self.spines.get(t)
        if found is None:
            sides = []
            for side in (0, 1):
                chain, x, until = [], t, 1 << 60
                while True:
                    chain.append((x, until))
                    if len(x) == 1:
                        break
                    until = self.rank[self.split[x]]
                    x = self.split[x][side]
                sides.append(chain[::-1])
            found = self.spines[t] = (sides[0], sides[1])
        return found

    def may_follow(self, a: bytes | None, b: bytes) -> bool:
        if a is None:
            return True
        found = self.adjacent.get((a, b))
        if found is None:
            left, right, i, j, found = self._spine(a)[1], self._spine(b)[0], 0, 0, True
            while True:
                (x, x_until), (y, y_until) = left[i], right[j]
                seam = self.rank.get((x, y), 1 << 61)
                if seam < x_until and seam <= y_until:
                    found = False
                    break
                if x_until == y_until == 1 << 60:
                    break
                if x_until <= y_until:
                    i += 1
                else:
                    j += 1
            if len(self.adjacent) > MAX_TRANSITIONS // 2:
                self.adjacent.clear()
            self.adjacent[a, b] = found
        return found

    def _compile(self, state: int, byte: int) -> int:
        held, at = self.states[state]
        now = held + bytes([byte])
        here = at[-1][1]
        for j, entry in enumerate(at):
            if entry is not None and now[j:] in self.vocab and self.may_follow(entry[0], now[j:]):
                ends = (now[j:], entry[1] + 1)
                break
        else:
            raise AssertionError("no token may end here")
        keep = [e if e is not None and now[j:] in self.open else None for j, e in enumerate(at)]
        first = next((j for j, e in enumerate(keep) if e is not None), len(keep))
        base = ends[1]
        new = (now[first:], tuple(None if e is None else (e[0], e[1] - base) for e in [*keep[first:], ends]))
        to = self.number.get(new)
        if to is None:
            to = self.number[new] = len(self.states)
            self.states.append(new)
        move = self.moves[state << 8 | byte] = to << 8 | base - here + 128
        return move

    def walk(self, state: int, word: bytes) -> tuple[int, int]:
        """The state after word, and the tokens emitted on the way."""
        total, get = 0, self.moves.get
        for b in word:
            move = get(state << 8 | b)
            if move is None:
                move = self._compile(state, b)
            state = move >> 8
            total += move & 255
        return state, total - 128 * len(word)


class ChunkMap(NamedTuple):
    """entry state -> (exit state, tokens). exit is None where no pre-token begins in the chunk: then the head is all there is."""

    head: bytes
    tokens: int
    exit: int | None

    def __call__(self, machine: ByteTransducer, state: int) -> tuple[int, int]:
        at, n = machine.walk(state, self.head)
        return (at, n) if self.exit is None else (self.exit, n + self.tokens)

    def then(self, machine: ByteTransducer, later: ChunkMap) -> ChunkMap:
        if self.exit is None:
            return ChunkMap(self.head + later.head, later.tokens, later.exit)
        state, n = later(machine, self.exit)
        return ChunkMap(self.head, self.tokens + n, state)


def scan(machine: ByteTransducer, maps: list[ChunkMap]) -> list[ChunkMap]:
    """Inclusive prefix composition by doubling: the i-th becomes the map of chunks 0..i."""
    step = 1
    while step < len(maps):
        maps = maps[:step] + [maps[i - step].then(machine, maps[i]) for i in range(step, len(maps))]
        step *= 2
    return maps


class TokenCounter:
    def __init__(self, data: bytes):
        spec = json.loads(data)
        if spec["model"]["type"] != "BPE" or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel" or spec["normalizer"]:
            raise ValueError("a byte-level BPE tokenizer file is needed")
        shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in shown}
        byte_of |= {chr(256 + i): b for i, b in enumerate(sorted(set(range(256)) - set(shown)))}
        raw = lambda s: bytes(byte_of[c] for c in s)
        pairs = (m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"])
        self.machine = ByteTransducer([(raw(a), raw(b)) for a, b in pairs])
        special = [t["content"] for t in spec["added_tokens"]]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None
        self.classes = character_classes()
        self.words: dict[str, int] = {}

    def _word(self, word: str) -> int:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= MAX_WORDS:
                self.words.clear()
            found = self.words[word] = self.machine.walk(0, word.encode())[1]
        return found

    def _chunked(self, text: str, starts: list[int], span: int) -> int:
        """Tokens of a text longer than a chunk, whose pre-tokens begin at starts: the composition of its chunks' maps."""
        if len(self.machine.moves) > MAX_TRANSITIONS:
            self.machine.restart()
        maps, k = [], 0
        for a in range(0, len(text), span):
            end, first = min(a + span, len(text)), k
            while k < len(starts) and starts[k] < end:
                k += 1
            mine = starts[first:k]
            if not mine:
                maps.append(ChunkMap(text[a:end].encode(), 0, None))
                continue
            tokens = sum(map(self._word, (text[x:y] for x, y in zip(mine, mine[1:]))))
            state, n = self.machine.walk(0, text[mine[-1] : end].encode())
            maps.append(ChunkMap(text[a : mine[0]].encode(), tokens + n, state))
        return scan(self.machine, maps)[-1](self.machine, 0)[1]

    def __call__(self, texts: list[str], span: int = SPAN) -> list[int]:
        totals, parts, owner = [0] * len(texts), [], []
        for i, x in enumerate(texts):
            split = [x]
            if self.special is not None and self.special.search(x):
                split = self.special.split(x)
                totals[i] += len(split) - 1
            for p in split:
                if p:
                    parts.append(p)
                    owner.append(i)
        if not parts:
            return totals
        whole = "".join(parts)
        codes = np.frombuffer(whole.encode("utf-32-le", "surrogatepass"), np.uint32)
        ends = np.cumsum([len(p) for p in parts])
        starts = boundaries(symbols(codes, ends, self.classes))
        begin = np.searchsorted(starts, np.concatenate([[0], ends]))  # of each part's pre-tokens
        if len(self.machine.moves) > MAX_TRANSITIONS:
            self.machine.restart()
        for k in [k for k, p in enumerate(parts) if len(p) > span]:
            base = int(ends[k]) - len(parts[k])
            totals[owner[k]] += self._chunked(parts[k], (starts[begin[k] : begin[k + 1]] - base).tolist(), span)
        # a text of one chunk is one map, entered in state 0: its tokens are the sum over its pre-tokens
        short = np.asarray([len(p) <= span for p in parts])
        mine = np.repeat(short, np.diff(begin))
        cuts = np.append(starts, len(whole))
        get, word = self.words.get, self._word
        counts = [c if (c := get(w := whole[a:b])) is not None else word(w) for a, b in zip(starts[mine].tolist(), cuts[1:][mine].tolist(), strict=True)]
        sums = np.concatenate([[0], np.cumsum(np.asarray(counts, np.int64))])
        upto = np.concatenate([[0], np.cumsum(np.diff(begin)[short])])
        for i, n in zip(np.asarray(owner)[short].tolist(), np.diff(sums[upto]).tolist(), strict=True):
            totals[i] += n
        return totals


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit for every row of docs."""
    key, data = ship_file(docs.sparkSession, path or vocabulary("byte_bpe_50k.json"))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = once(("token counter", key), lambda: TokenCounter(data.value))
        for b in batches:
            for part in by_size(b, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                n = np.asarray(counter(texts), dtype=np.int64)
                size = np.asarray([len(t.encode("utf-8", "surrogatepass")) for t in texts], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"doc_id": part.column("doc_id").cast(pa.int64()), "n_bytes": pa.array(size), "n_tokens": pa.array(n), "over_limit": pa.array(n > limit)})

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Toxicity by subword-bag embeddings averaged into a linear softmax, trained jointly in numpy.

A bag is a multiset of character n-grams (3 to 5, with word ends marked). Each n-gram hashes to a bucket
with an embedding; a bag is the average of its embeddings; a linear softmax over two classes reads it.
Embeddings and softmax are trained together, by Adam on the whole sample, from document labels alone. A
misspelling that was never seen shares most n-grams with words that were.

What a bag is taken over, `pool` says, in the fit and in scoring alike. `document`: one bag for all distinct words of a
text. `words`, the default: a bag for each distinct word, and the text's logit is a smooth maximum (log-sum-exp at
temperature SOFT) over all of them, so that a few words mark a text of any length. In texts of up to 20,000 words one
average drowns the few words that the label is about; the README has held-out figures of both.

The fit is on a bounded sample, TRAIN_DOCS labelled documents of either class in hash order, reduced on the executors
to their distinct words. Scoring reads every whole text: each distinct word is scored once in a worker
and kept up to a bound, and every distinct word counts.

Defined results: null and empty texts get the score of a document without words; labels are learnt only from
rows where crc32 of doc_id as text is not 2 modulo 4 and only for ids that have a document; any label above 0 is toxic; where
a document has several labels the highest holds, and where a doc_id has several texts one of them is learnt from, chosen by a
hash; without labels of both kinds every score is that of a document without words, about 2e-9; repeated rows are
scored each; an empty table gives an empty result; score() leaves all other columns as they are, and its new ones
take names that none of them has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from sys import intern

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import by_size, lowest, once, ship_code, unused

TRAIN_DOCS = 800
BUCKETS, DIM = 1 << 16, 8
GRAMS = (3, 4, 5)
PHASES, MINED = (24, 10, 10), 10_000
RATE, DECAY, SOFT = 0.05, 2e-6, 0.5
SHRINK, START = 4.0, 0.5
TRUST = 1.0
THRESHOLD = 0.3
MEMO_WORDS = 600_000
MARKS = ".,;:!?\"()"


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def grams(words: list[str], buckets: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of all n-grams of all words, and where each word's begin. Words have at least one gram."""
    text = "".join(f"<{w}>" for w in words)
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    size = np.asarray([len(w) + 2 for w in words])
    end = np.repeat(np.cumsum(size), size)
    at = np.arange(len(codes))
    found, places = [], []
    h = np.zeros(len(codes), np.uint64)
    for n in range(1, max(GRAMS) + 1):
        h = h[: len(codes) - n + 1] * np.uint64(0x9E3779B97F4A7C15) + codes[n - 1 :]
        if n in GRAMS:
            inside = at[: len(h)] + n <= end[: len(h)]
            x = h[inside] * np.uint64(0xBF58476D1CE4E5B9) + np.uint64(n)
            found.append((x ^ x >> np.uint64(29)) * np.uint64(0x94D049BB133111EB) >> np.uint64(64 - buckets.bit_length() + 1))
            places.append(at[: len(h)][inside])
    place = np.concatenate(places)
    by = np.argsort(place, kind="stable")
    word = np.repeat(np.arange(len(words)), size)[place[by]]
    return np.concatenate(found)[by].astype(np.int64), np.searchsorted(word, np.arange(len(words)))


class SubwordSoftmax:
    """Trained weights, reduced for scoring to one number a bucket: its embedding times the softmax's difference."""

    def __init__(self, buckets: int = BUCKETS, pool: str = "words"):
        if pool not in ("words", "document"):
            raise ValueError("pool is words or document")
        self.buckets, self.pool, self.value, self.bias, self.key = buckets, pool, np.zeros(buckets, np.float32), -20.0, "none"

    def fit(self, bags: list[list[str]], labels: list[int], phases: tuple[int, ...] = PHASES, seed: int = 7) -> SubwordSoftmax:
        """Words of one document only are left out at first, lest they be learnt by heart. Between the phases those of
        clean documents that score highest are taken in, since scoring will meet such words."""
        rng = np.random.RandomState(seed)
        seen: dict[str, int] = {}
        for bag in bags:
            for w in bag:
                seen[w] = seen.get(w, 0) + 1
        words = sorted(w for w, n in seen.items() if n > 1) or sorted(seen)
        if not words or len(set(labels)) < 2:
            return self
        known = set(words)
        spare = sorted({w for bag, y in zip(bags, labels, strict=True) if not y for w in bag} - known)
        E = rng.normal(0, 0.3, (self.buckets, DIM)).astype(np.float32)
        P = rng.normal(0, 0.3, (DIM, 2)).astype(np.float32)
        b = np.asarray([2.0, -2.0], np.float32)
        params = [E, P, b]
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        t = 0
        for phase, rounds in enumerate(phases):
            if phase and spare:
                hard = np.argsort(-self.word_logits(spare))[:MINED]
                words = words + [spare[i] for i in hard]
                taken = set(hard.tolist())
                spare = [w for i, w in enumerate(spare) if i not in taken]
            t = self._rounds(words, bags, labels, rounds, params, m, v, t)
            self.value = E @ (P[:, 1] - P[:, 0])
            self.bias = float(b[1] - b[0])
        self.key = hashlib.sha256(self.value.tobytes() + f"{self.pool} {self.bias}".encode()).hexdigest()
        return self

    def _rounds(self, words: list[str], bags: list[list[str]], labels: list[int], rounds: int, params: list, m: list, v: list, t: int) -> int:
        E, P, b = params
        number = {w: i for i, w in enumerate(words)}
        gram, first = grams(words, self.buckets)
        count = np.diff(np.append(first, len(gram)))
        by_gram = np.argsort(gram, kind="stable")
        of_word = np.repeat(np.arange(len(words)), count)[by_gram]
        used, gram_first = np.unique(gram[by_gram], return_index=True)
        docs = [[number[w] for w in bag if w in number] for bag in bags]
        keep = [i for i, d in enumerate(docs) if d]
        y = np.asarray([labels[i] for i in keep], np.float32)
        flat = np.asarray([w for i in keep for w in docs[i]])
        size = np.asarray([len(docs[i]) for i in keep])
        start, owner = np.cumsum(size) - size, np.repeat(np.arange(len(keep)), size)
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, len(y) - y.sum())).astype(np.float32)
        if not t:
            # one dimension starts from each n-gram's log-odds, shrunk where few toxic documents have it
            with_class = [np.bincount(flat, weights=(y[owner] == k), minlength=len(words)) for k in (0, 1)]
            clean_n, toxic_n = (np.add.reduceat(w[of_word], gram_first) for w in with_class)
            odds = np.log((toxic_n + 0.5) / max(1, y.sum())) - np.log((clean_n + 0.5) / max(1, len(y) - y.sum()))
            E[:, 0] = 0
            E[used, 0] = np.clip(odds * toxic_n / (toxic_n + SHRINK), -3, 3)
            P[0] = (-START, START)
        for t in range(t + 1, t + rounds + 1):
            bag = np.add.reduceat(E[gram], first) / count[:, None]
            logit = bag @ P + b
            z, share = pooled((logit[:, 1] - logit[:, 0])[flat], count[flat], start, owner, self.pool)
            p_doc = 1 / (1 + np.exp(-z))
            # a toxic label that the model finds hard to believe counts for less, so that wrong labels aren't learnt by heart
            dz = weight * (p_doc - y) * np.where(y > 0, (p_doc + 0.02) ** TRUST, 1)
            ds = np.bincount(flat, weights=share * dz[owner], minlength=len(words)).astype(np.float32)
            dlogit = np.stack([-ds, ds], axis=1)
            dbag = (dlogit @ P.T) / count[:, None]
            gE = DECAY * E
            gE[used] += np.add.reduceat(dbag[of_word], gram_first)
            for p, g, mi, vi in zip(params, [gE, bag.T @ dlogit + DECAY * P, dlogit.sum(0)], m, v, strict=True):
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                p -= RATE * (mi / (1 - 0.9**t)) / (np.sqrt(vi / (1 - 0.99**t)) + 1e-8)
        return t

    def word_logits(self, words: list[str]) -> np.ndarray:
        return self.word_terms(words)[0] + self.bias

    def word_terms(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Of each word: the average over its n-grams, and how many they are."""
        mean, many = np.empty(len(words), np.float32), np.empty(len(words), np.int64)
        for a in range(0, len(words), 20_000):
            gram, first = grams(words[a : a + 20_000], self.buckets)
            many[a : a + 20_000] = np.diff(np.append(first, len(gram)))
            mean[a : a + 20_000] = np.add.reduceat(self.value[gram], first) / many[a : a + 20_000]
        return mean, many


def pooled(logit: np.ndarray, many: np.ndarray, start: np.ndarray, owner: np.ndarray, pool: str) -> tuple[np.ndarray, np.ndarray]:
    """A document's logit from those of its words, and each word's share in it. many: n-grams of each word."""
    if pool == "document":
        share = many / np.add.reduceat(many, start)[owner]
        return np.add.reduceat(share * logit, start), share
    s = logit / SOFT
    top = np.maximum.reduceat(s, start)
    e = np.exp(s - top[owner])
    total = np.add.reduceat(e, start)
    return SOFT * (top + np.log(total)), e / total[owner]


def clean(text: str) -> str:
    text = text.lower()
    for c in MARKS:
        text = text.replace(c, " ")
    return text


class Scorer:
    def __init__(self, model: SubwordSoftmax):
        self.model, self.number = model, {}
        self.logit, self.many = np.empty(MEMO_WORDS, np.float32), np.empty(MEMO_WORDS, np.int64)

    def __call__(self, texts: list[str]) -> np.ndarray:
        bags = [set(clean(x).split()) for x in texts]
        known = self.number
        new = list(set().union(*bags) - known.keys())
        if len(known) + len(new) > len(self.logit):
            known.clear()
            new = list(set().union(*bags))
            if len(new) > len(self.logit):
                self.logit, self.many = np.empty(len(new), np.float32), np.empty(len(new), np.int64)
        a, b = len(known), len(known) + len(new)
        mean, self.many[a:b] = self.model.word_terms(new)
        self.logit[a:b] = mean + self.model.bias
        known.update(zip(new, range(a, b), strict=True))
        out, has = np.full(len(texts), float(self.model.bias)), np.flatnonzero([bool(x) for x in bags])
        if len(has):
            flat = np.fromiter((known[w] for x in bags for w in x), np.int64)
            size = np.asarray([len(bags[i]) for i in has])
            start, owner = np.cumsum(size) - size, np.repeat(np.arange(len(has)), size)
            # sorted, so that a text's score doesn't depend on the order of a set
            flat = flat[np.lexsort((self.logit[flat], owner))]
            out[has] = pooled(self.logit[flat].astype(np.float64), self.many[flat], start, owner, self.model.pool)[0]
        return 1 / (1 + np.exp(-np.clip(out, -500, 500)))


def train(docs: DataFrame, labels: DataFrame, per_class: int = TRAIN_DOCS, pool: str = "words") -> SubwordSoftmax:
    """docs: doc_id, text; labels: doc_id, toxic."""
    known = labels.where(F.col("toxic").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg((F.max("toxic") > 0).alias("y"))
    known = known.join(docs.select("doc_id"), "doc_id", "left_semi")
    # the sample is chosen among the ids alone; their texts are looked up by a join on at most 2 * per_class ids
    chosen = [lowest(known.where(F.col("y") == F.lit(k)), F.xxhash64(F.lit(5), "doc_id"), per_class, ["doc_id"]) for k in (False, True)]
    ids = F.broadcast(chosen[0].union(chosen[1]))
    one = docs.select("doc_id", "text").join(ids, "doc_id").groupBy("doc_id", "y").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"))
    text = F.lower(F.coalesce(F.col("text"), F.lit("")))
    bag = F.array_remove(F.array_distinct(F.split(text, r'[\s.,;:!?"()]+')), "")
    rows = one.select("doc_id", bag.alias("bag"), "y").orderBy("doc_id").collect()  # one row an id
    bags, y = [[intern(w) for w in r["bag"]] for r in rows], [int(r["y"]) for r in rows]
    del rows
    return SubwordSoftmax(pool=pool).fit(bags, y)


def score(docs: DataFrame, model: SubwordSoftmax, threshold: float = THRESHOLD, names: tuple[str, str] | None = None) -> DataFrame:
    """docs with two columns appended, score and predicted: `names`, or toxic_score and toxic_predicted made unlike docs' own."""
    from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

    ship_code(docs.sparkSession)
    extra = list(names or unused(docs.columns, "toxic_score", "toxic_predicted"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = once(("toxicity", model.key), lambda: Scorer(model))
        for b in batches:
            for part in by_size(b, "text"):
                p = scorer([t or "" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(p), pa.array((p >= threshold).astype("int32"))], names=[*part.schema.names, *extra])

    schema = StructType([*docs.schema.fields, StructField(extra[0], DoubleType()), StructField(extra[1], IntegerType())])
    return docs.mapInArrow(apply, schema)


def toxicity(docs: DataFrame, labels: DataFrame, pool: str = "words") -> DataFrame:
    """doc_id, held_out, score, predicted for every row of docs."""
    scored = score(docs.select("doc_id", "text"), train(docs, labels, pool=pool), names=("score", "predicted"))
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")

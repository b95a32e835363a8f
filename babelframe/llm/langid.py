"""Language identification by a bidirectional gated recurrent network over bytes, trained in numpy.

A text's UTF-8 bytes are cut into windows of WINDOW bytes. Two GRUs of HIDDEN units read each window, one
from either end; a softmax over both states labels every byte; a document's probabilities are the mean
over all its bytes. Training is backpropagation through time with Adam, on the label at every byte.

The fit is on a bounded sample: TRAIN_DOCS labelled documents in order of a hash of doc_id and text, SAMPLES
places of each. The hash doesn't know the language and takes in the text, so rows whose doc_id is null or repeated are
sampled like any others; rows without a text aren't candidates.
Prediction reads every byte of every text, thousands of windows side by side, both directions in one step.
A padding byte leaves a state as it is, so a short window reads like a longer one.

Defined results: `und` with score 0 where the text is null, empty or without a letter, and everywhere if
there is nothing to learn from; learning uses rows with a text and a lang whose crc32 of doc_id as text
is not 2 modulo 4; rows without a doc_id are learnt from; repeated rows are predicted each; an empty table gives
an empty result; predict() leaves all other columns as they are, and its new ones take names that none of them has.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_size, lowest, ship_code, unused
from .toxicity import held_out

HIDDEN, WINDOW = 12, 64
TRAIN_DOCS, SAMPLES = 3000, 2
STEPS, BATCH, TRAIN_WINDOW, RATE = 160, 192, 40, 0.02
PAD = 256
SIDE_BY_SIDE = 4096
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")


class BiGru:
    """Weights: X [2, 257, 3H] of the input byte, U [2, H, 3H] of the state, n_bias [2, H], V [2, H, K] and c [K] of the labels.

    With gates z, r and candidate n: h' = n + z (h - n), n = tanh(Xn + r (Un h + n_bias)). The gates' halves of X and U
    hold half their arguments, so that a logistic is 0.5 + 0.5 tanh.
    """

    def __init__(self, langs: list[str], hidden: int = HIDDEN, seed: int = 3):
        rng = np.random.RandomState(seed)
        H, K = hidden, len(langs)
        self.langs, self.hidden = langs, H
        self.X = rng.normal(0, 0.3, (2, 257, 3 * H)).astype(np.float32)
        self.U = rng.normal(0, 1 / np.sqrt(H), (2, H, 3 * H)).astype(np.float32)
        self.nb = np.zeros((2, 1, H), np.float32)
        self.V = rng.normal(0, 1 / np.sqrt(2 * H), (2, H, K)).astype(np.float32)
        self.c = np.zeros(K, np.float32)
        self._pads()

    def _pads(self) -> None:
        self.X[:, PAD, : self.hidden] = 20.0  # z = 1: the state stays

    def key(self) -> str:
        return hashlib.sha256(b"".join(p.tobytes() for p in self.params())).hexdigest()

    def params(self) -> list[np.ndarray]:
        return [self.X, self.U, self.nb, self.V, self.c]

    def _step(self, x: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        H = self.hidden
        g = np.matmul(h, self.U)
        zr = x[:, :, : 2 * H] + g[:, :, : 2 * H]
        np.tanh(zr, out=zr)
        zr *= 0.5
        zr += 0.5
        un = g[:, :, 2 * H :] + self.nb
        n = zr[:, :, H:] * un
        n += x[:, :, 2 * H :]
        np.tanh(n, out=n)
        new = h - n
        new *= zr[:, :, :H]
        new += n
        return new, zr, un, n

    def read(self, windows: np.ndarray) -> np.ndarray:
        """Label probabilities [T, K, N] of byte windows [N, T]. Units lie along rows, so that every step works on long runs, in buffers made once."""
        T, N, H = windows.shape[1], windows.shape[0], self.hidden
        of_byte = [np.ascontiguousarray(x.T) for x in self.X]
        U, nb, V = (p.transpose(0, 2, 1) for p in (self.U, self.nb, self.V))
        U = np.ascontiguousarray(U)
        byte = windows.T.astype(np.intp)
        x, g = np.empty((2, 3 * H, N), np.float32), np.empty((2, 3 * H, N), np.float32)
        h, n, states = np.zeros((2, H, N), np.float32), np.empty((2, H, N), np.float32), np.empty((T, 2, H, N), np.float32)
        gate, z, r = x[:, : 2 * H], x[:, :H], x[:, H : 2 * H]
        for t in range(T):
            np.take(of_byte[0], byte[t], axis=1, out=x[0], mode="clip")
            np.take(of_byte[1], byte[T - 1 - t], axis=1, out=x[1], mode="clip")
            np.matmul(U, h, out=g)
            gate += g[:, : 2 * H]
            np.tanh(gate, out=gate)
            gate *= 0.5
            gate += 0.5
            un = g[:, 2 * H :]
            un += nb
            un *= r
            un += x[:, 2 * H :]
            np.tanh(un, out=n)
            new = states[t]
            np.subtract(h, n, out=new)
            new *= z
            new += n
            h = new
        out = np.matmul(V[0], states[:, 0])
        out += np.matmul(V[1], states[::-1, 1])
        out += self.c[:, None]
        out -= out.max(axis=1, keepdims=True)
        np.exp(out, out=out)
        out /= out.sum(axis=1, keepdims=True)
        return out

    def learn(self, windows: np.ndarray, y: np.ndarray, steps: int = STEPS, batch: int = BATCH, seed: int = 4) -> BiGru:
        rng = np.random.RandomState(seed)
        params = self.params()
        m, v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
        for it in range(1, steps + 1):
            pick = rng.randint(0, len(windows), batch)
            grads = self.gradients(windows[pick], y[pick])
            norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
            rate = RATE * min(1.0, 2 * (1 - it / (steps + 1)))
            for prm, g, mi, vi in zip(params, grads, m, v, strict=True):
                g = g / max(1.0, norm)
                mi += 0.1 * (g - mi)
                vi += 0.01 * (g * g - vi)
                prm -= rate * (mi / (1 - 0.9**it)) / (np.sqrt(vi / (1 - 0.99**it)) + 1e-8)
            self._pads()
        return self

    def gradients(self, w: np.ndarray, lab: np.ndarray) -> list[np.ndarray]:
        """Of the mean loss over all bytes of windows w [N, T] with labels lab, by backpropagation through time; in the order of params()."""
        H, T, batch = self.hidden, w.shape[1], len(w)
        both = np.stack([w.T, w.T[::-1]])  # [2, T, N]
        h, kept = np.zeros((2, batch, H), np.float32), []
        states = np.zeros((2, T, batch, H), np.float32)
        for t in range(T):
            x = np.stack([self.X[0][both[0, t]], self.X[1][both[1, t]]])
            new, zr, un, n = self._step(x, h)
            kept.append((h, zr, un, n))
            h = states[:, t] = new
        logit = states[0] @ self.V[0] + (states[1] @ self.V[1])[::-1] + self.c
        logit -= logit.max(axis=2, keepdims=True)
        p = np.exp(logit)
        p /= p.sum(axis=2, keepdims=True)
        p[:, np.arange(batch), lab] -= 1
        real = (w.T != PAD)[:, :, None]
        d = p * real / max(1, real.sum())
        dboth = np.stack([d, d[::-1]])
        gV = np.einsum("stnh,stnk->shk", states, dboth, optimize=True)
        gX, gU, gnb, gc = np.zeros_like(self.X), np.zeros_like(self.U), np.zeros_like(self.nb), d.sum((0, 1))
        dout = np.matmul(dboth, self.V.transpose(0, 2, 1)[:, None])
        dh = np.zeros((2, batch, H), np.float32)
        for t in range(T - 1, -1, -1):
            h, zr, un, n = kept[t]
            z, r = zr[:, :, :H], zr[:, :, H:]
            dh = dh + dout[:, t]
            dn = dh * (1 - z) * (1 - n * n)
            da = np.empty((2, batch, 3 * H), np.float32)
            da[:, :, :H] = dh * (h - n) * z * (1 - z) * 2
            da[:, :, H : 2 * H] = dn * un * r * (1 - r) * 2
            da[:, :, 2 * H :] = dn
            dg = da.copy()
            dg[:, :, 2 * H :] *= r
            gU += np.matmul(h.transpose(0, 2, 1), dg)
            gnb += dg[:, :, 2 * H :].sum(1, keepdims=True)
            for s in (0, 1):
                np.add.at(gX[s], both[s, t], da[s])
            dh = dh * z + np.matmul(dg, self.U.transpose(0, 2, 1))
        return [gX, gU, gnb, gV, gc]

    def documents(self, texts: list[bytes]) -> np.ndarray:
        """Mean label probabilities [D, K] over all bytes of each text; texts aren't empty."""
        order_of, total = [], np.zeros((len(texts), len(self.langs)))
        rows = []
        for i, b in enumerate(texts):
            n = -(-len(b) // WINDOW)
            buf = np.full(n * WINDOW, PAD, np.int16)
            buf[: len(b)] = np.frombuffer(b, np.uint8)
            rows.append(buf)
            order_of.append(n)
        windows = np.concatenate(rows).reshape(-1, WINDOW)
        owner = np.repeat(np.arange(len(texts)), order_of)
        pooled = np.empty((len(windows), len(self.langs)))
        for a in range(0, len(windows), SIDE_BY_SIDE):
            w = windows[a : a + SIDE_BY_SIDE]
            p = self.read(w)
            p *= (w.T != PAD)[:, None]
            pooled[a : a + SIDE_BY_SIDE] = p.sum(axis=0).T
        np.add.at(total, owner, pooled)
        return total / np.asarray([len(b) for b in texts])[:, None]


def train(docs: DataFrame, train_docs: int = TRAIN_DOCS, samples: int = SAMPLES, window: int = TRAIN_WINDOW) -> BiGru | None:
    """docs: doc_id, text, lang. The sample's places are cut out on the executors; a few hundred kilobytes reach the driver."""
    able = docs.where(F.col("lang").isNotNull() & (F.length("text") > 0) & ~held_out(F.col("doc_id")))
    usable = lowest(able.select("doc_id", "lang", "text"), F.xxhash64(F.lit(6), "doc_id", "text"), train_docs, ["doc_id", F.xxhash64(F.lit(7), "text")])
    near = F.expr(f"transform(sequence(0, {samples - 1}), i -> substring(text, 1 + CAST(pmod(xxhash64(doc_id, text, i), greatest(1, length(text) - {window})) AS INT), {window}))")
    rows = usable.select("doc_id", "lang", near.alias("places")).orderBy("doc_id", "lang", "places").collect()
    if not rows:
        return None
    langs = sorted({r["lang"] for r in rows})
    number = {k: i for i, k in enumerate(langs)}
    windows, y = [], []
    for r in rows:
        for place in r["places"]:
            b = place.encode("utf-8", "surrogatepass")[:window]
            if b:
                windows.append(np.concatenate([np.frombuffer(b, np.uint8), np.full(window - len(b), PAD)]).astype(np.int16))
                y.append(number[r["lang"]])
    return BiGru(langs).learn(np.stack(windows), np.asarray(y))


def predict(docs: DataFrame, model: BiGru | None, names: tuple[str, str] | None = None) -> DataFrame:
    """docs with two columns appended, language and score: `names`, or lang_pred and lang_score made unlike docs' own."""
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    ship_code(docs.sparkSession)
    extra = list(names or unused(docs.columns, "lang_pred", "lang_score"))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for part in by_size(b, "text"):
                texts = [t or "" for t in part.column("text").to_pylist()]
                lang, score = [UNKNOWN] * len(texts), [0.0] * len(texts)
                able = [i for i, t in enumerate(texts) if model is not None and _LETTER.search(t)]
                if able:
                    p = model.documents([texts[i].encode("utf-8", "surrogatepass") for i in able])
                    for i, k, s in zip(able, p.argmax(axis=1).tolist(), p.max(axis=1).tolist(), strict=True):
                        lang[i], score[i] = model.langs[k], min(1.0, s)
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*part.schema.names, *extra])

    return docs.mapInArrow(apply, StructType([*docs.schema.fields, StructField(extra[0], StringType()), StructField(extra[1], DoubleType())]))


def language_id(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs."""
    found = predict(docs.select("doc_id", "text"), train(docs.select("doc_id", "text", "lang")), ("lang_pred", "score"))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")

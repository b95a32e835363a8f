"""Toxicity and language: held-out accuracy, what is learnt from, odd rows."""

import random

import numpy as np
import pytest

from babelframe.llm.langid import BiGru, language_id, predict
from babelframe.llm.langid import train as train_language
from babelframe.llm.toxicity import Scorer, SubwordSoftmax, score, toxicity
from babelframe.llm.toxicity import train as train_toxicity

from .data import WORDS, empty_documents, is_held_out, odd_documents

LABELS = "doc_id long, quality int, toxic int"
BAD = ["grumbleton", "snarkwhistle", "fizzlewort"]


def labelled(n=600, seed=1):
    r = random.Random(seed)
    docs, labels = [], []
    for i in range(n):
        w = [r.choice(WORDS) + r.choice(["", "s", "ing"]) for _ in range(r.randrange(10, 80))]
        y = int(r.random() < 0.25)
        if y:
            w[r.randrange(len(w))] = r.choice(BAD)
        docs.append((i, " ".join(w)))
        labels.append((i, 0, y))
    return docs, labels


def test_toxicity_held_out(spark):
    docs, labels = labelled()
    got = {x["doc_id"]: x for x in toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)).collect()}
    test = [(i, y) for i, _, y in labels if is_held_out(i)]
    assert all(got[i]["held_out"] == is_held_out(i) and 0 <= got[i]["score"] <= 1 and got[i]["predicted"] == (got[i]["score"] >= 0.3) for i, _ in docs)
    assert np.mean([got[i]["predicted"] == y for i, y in test]) > 0.97


def test_misspellings_share_grams():
    docs, labels = labelled()
    model = SubwordSoftmax().fit([sorted(set(t.split())) for _, t in docs], [y for _, _, y in labels])
    s = Scorer(model)(["a river of grumbletonn", "snarkwhistler stone", "the river of stone", ""])
    assert s[0] > 0.5 and s[1] > 0.5 and s[2] < 0.1 and s[3] < 0.1


def test_held_out_labels_are_not_learnt(spark):
    docs, labels = labelled()
    flipped = [(i, q, 1 - y if is_held_out(i) else y) for i, q, y in labels]
    a, b = (toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(x, LABELS)).orderBy("doc_id").collect() for x in (labels, flipped))
    assert a == b


def test_toxicity_odd_rows(spark):
    labels = spark.createDataFrame([(1, 0, 1), (1, 0, 0), (None, 0, 1), (3, 0, None), (5, None, 0), (10, 0, 0), (99, 0, 1)], LABELS)
    got = toxicity(odd_documents(spark), labels).collect()
    assert len(got) == 16 and all(0 <= x["score"] <= 1 for x in got)
    assert toxicity(empty_documents(spark), labels).count() == 0
    assert toxicity(odd_documents(spark), spark.createDataFrame([], LABELS)).count() == 16


def languages(n=300):
    r = random.Random(2)
    syllables = {"aa": "ka lo mi tu".split(), "bb": "sch üng ber eß".split(), "cc": "ción ñez que ía".split()}
    out = []
    for i in range(n):
        k = r.choice(sorted(syllables))
        out.append((i, " ".join("".join(r.choice(syllables[k]) for _ in range(r.randrange(1, 4))) for _ in range(r.randrange(5, 60))), k))
    return out


def test_language_held_out(spark):
    rows = languages()
    got = {x["doc_id"]: x for x in language_id(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    test = [(i, k) for i, _, k in rows if is_held_out(i)]
    assert np.mean([got[i]["lang_pred"] == k for i, k in test]) > 0.97
    assert all(0 <= x["score"] <= 1 and x["held_out"] == is_held_out(x["doc_id"]) for x in got.values())


def forward(m, text):
    """The network as its docstring has it, one byte and one unit at a time: label probabilities at every byte."""
    H, sig = m.hidden, lambda v: 1 / (1 + np.exp(-v))
    sides = []
    for s, order in ((0, text), (1, text[::-1])):
        h, out = np.zeros(H), []
        for b in order:
            x, u = m.X[s, b].astype(float), h @ m.U[s].astype(float)
            z, r = sig(2 * (x[:H] + u[:H])), sig(2 * (x[H : 2 * H] + u[H : 2 * H]))
            n = np.tanh(x[2 * H :] + r * (u[2 * H :] + m.nb[s, 0]))
            h = n + z * (h - n)
            out.append(h @ m.V[s])
        sides.append(out if s == 0 else out[::-1])
    logit = np.asarray(sides[0]) + np.asarray(sides[1]) + m.c
    e = np.exp(logit - logit.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def test_gradients():
    """Backpropagation through time against differences: one step of Adam moves each weight against its slope's sign."""
    r = np.random.RandomState(1)
    w, y = r.randint(97, 107, (6, 9)).astype(np.int16), r.randint(0, 2, 6)
    w[0, 5:] = 256

    def loss(m):
        p = m.read(w)  # [T, K, N]
        real = w.T != 256
        return -(np.log(p[:, y, np.arange(6)].astype(float)) * real).sum() / real.sum()

    m, moved = BiGru(["a", "b"], hidden=4), BiGru(["a", "b"], hidden=4)
    grads = moved.gradients(w, y)
    checked = 0
    for p, g in zip(m.params(), grads, strict=True):
        flat, slope = p.reshape(-1), g.reshape(-1)
        for i in np.argsort(-np.abs(slope))[:12]:
            was = flat[i]
            if was == 20.0:
                continue
            flat[i] = was + 1e-2
            up = loss(m)
            flat[i] = was - 1e-2
            down = loss(m)
            flat[i] = was
            assert abs((up - down) / 2e-2 - slope[i]) < 2e-3 + 0.02 * abs(slope[i])
            checked += 1
    assert checked > 40
    before = loss(m)
    m.learn(np.repeat(w, 40, axis=0), np.repeat(y, 40), steps=25, batch=64)
    assert loss(m) < 0.3 * before


def test_documents_against_the_plain_network():
    m = BiGru(["a", "b", "c"], hidden=4)
    text = bytes(range(32, 127)) * 5
    p = m.documents([text, text[:10]])
    parts = [forward(m, text[a : a + 64]).sum(0) for a in range(0, len(text), 64)]
    assert np.allclose(p[0], np.sum(parts, axis=0) / len(text), atol=1e-5) and np.allclose(p.sum(axis=1), 1, atol=1e-5)
    assert np.allclose(p[1], forward(m, text[:10]).mean(axis=0), atol=1e-5)


def test_toxicity_scores_against_plain_sums():
    """Every score from the weights alone: each word's n-grams one by one, then the pooling."""
    docs, labels = labelled(300)
    bags = [sorted(set(t.split())) for _, t in docs]
    for pool in ("words", "document"):
        m = SubwordSoftmax(pool=pool).fit(bags, [y for _, _, y in labels], phases=(6, 2))

        def terms(w):
            out = []
            for n in (3, 4, 5):
                for k in range(len(w) + 2 - n + 1):
                    h = 0
                    for c in f"<{w}>"[k : k + n]:
                        h = (h * 0x9E3779B97F4A7C15 + ord(c)) % 2**64
                    x = (h * 0xBF58476D1CE4E5B9 + n) % 2**64
                    out.append(float(m.value[(x ^ x >> 29) * 0x94D049BB133111EB % 2**64 >> 48]))
            return out

        texts = [docs[0][1], docs[1][1] + " odd1 odd2, odd3!", "x", "grumbletonn river"]
        for t, got in zip(texts, Scorer(m)(texts), strict=True):
            words = [terms(w) for w in sorted(set("".join(" " if c in '.,;:!?"()' else c for c in t.lower()).split()))]
            if pool == "document":
                z = sum(map(sum, words)) / sum(map(len, words)) + m.bias
            else:
                z = 0.5 * np.log(sum(np.exp((sum(w) / len(w) + m.bias) / 0.5) for w in words))
            assert abs(got - 1 / (1 + np.exp(-z))) < 1e-4


@pytest.mark.parametrize("ids", ["null", "repeated"])
def test_language_sample_without_ids(spark, ids):
    """7,000 rows, more than twice the sample, none of them with a doc_id of its own: both languages are learnt."""
    rows = [(None if ids == "null" else 1, f"{'ka lo mi tu' if k % 2 else 'sch ber ess nun'} {k}", "aa" if k % 2 else "bb") for k in range(7000)]
    m = train_language(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert m.langs == ["aa", "bb"]


def test_toxicity_one_text_an_id(spark):
    """A doc_id with many texts doesn't push others out of the sample, and labels without a document take no place."""
    docs, labels = labelled(200)
    docs += [(0, f"copy {k} of zero") for k in range(4000)]
    labels += [(100_000 + k, 0, k % 2) for k in range(4000)]
    got = {x["doc_id"]: x["score"] for x in toxicity(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, LABELS)).collect()}
    test = [(i, y) for i, _, y in labels[:200] if is_held_out(i)]
    assert np.mean([(got[i] >= 0.3) == y for i, y in test]) > 0.9


def test_clashing_names(spark):
    docs = spark.createDataFrame([(1, "the river", "en", 5, "x"), (2, "of stone", "en", 6, "y")], "doc_id long, text string, lang_pred string, toxic_predicted int, score string")
    labels = spark.createDataFrame([(1, 0, 1), (2, 0, 0)], LABELS)
    out = score(docs, train_toxicity(docs, labels))
    assert out.columns == [*docs.columns, "toxic_score", "toxic_predicted_"] and out.select(*docs.columns).exceptAll(docs).count() == 0
    out = predict(docs, None)
    assert out.columns == [*docs.columns, "lang_pred_", "lang_score"] and out.select(*docs.columns).exceptAll(docs).count() == 0


def test_language_odd_rows(spark):
    got = language_id(odd_documents(spark)).collect()
    assert len(got) == 16
    for x in got:
        assert (x["lang_pred"] == "und") == (x["doc_id"] in (2, 3, 4) or (x["doc_id"] is None and x["score"] == 0))
    assert language_id(empty_documents(spark)).count() == 0
    assert train_language(empty_documents(spark)) is None

"""Near duplicates of texts and vectors, against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from babelframe.llm import minhash
from babelframe.llm.common import Stored
from babelframe.llm.embed_dedup import CoverTree, Run, embed_dedup
from babelframe.llm.minhash import multisets, near_dedup, overlap, signatures

from .data import classes, corpus, empty_documents, odd_documents


def bag(text):
    w = re.findall("[a-z0-9\u0080-\U0010ffff]+", (text or "").lower())
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else Counter()


def jaccard(p, q):
    return sum((p & q).values()) / sum((p | q).values()) if p and q else 0.0


def test_signatures_are_unbiased():
    r = random.Random(1)
    a, b = [], []
    for _ in range(250):
        w = [r.choice("abcdefgh") + str(r.randrange(r.choice((2, 30)))) for _ in range(r.randrange(30, 300))]
        v = list(w)
        for _ in range(r.randrange(0, 9)):
            v[r.randrange(len(v))] = "z"
        a.append(" ".join(w))
        b.append(" ".join(v))
    true = np.array([overlap(x, y) for x, y in zip(multisets(a), multisets(b), strict=True)])
    assert np.allclose(true, [jaccard(bag(x), bag(y)) for x, y in zip(a, b, strict=True)])
    got = (signatures(a) == signatures(b)).mean(axis=1)
    assert abs((got - true).mean()) < 0.006 and (got - true).std() < 0.035


def test_near_dedup_against_brute_force(spark):
    rows = corpus(260, 4)
    # a chain of edits, so that ends are linked through the middle only, and a passage that many texts share
    r = random.Random(8)
    w = [f"c{r.randrange(10**6)}" for _ in range(120)]
    for _ in range(25):
        w = list(w)
        w[r.randrange(len(w))] = f"d{r.randrange(10**6)}"
        rows.append((len(rows), " ".join(w)))
    passage = " ".join(f"p{k}" for k in range(60))
    for k in range(30):
        rows.append((len(rows), passage + " " + " ".join(f"q{k}x{j}" for j in range(25))))
    bags = [bag(t) for _, t in rows]
    links = [(i, j) for i in range(len(rows)) for j in range(i) if jaccard(bags[i], bags[j]) >= 0.8]
    want = classes(len(rows), links)
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {x["doc_id"]: x["class_id"] for x in got} == dict(enumerate(want))
    sizes = Counter(want)
    assert all(x["class_size"] == sizes[x["class_id"]] and x["kept"] == (x["doc_id"] == x["class_id"]) for x in got)


def test_near_dedup_fetches_few_words(spark, monkeypatch):
    """Texts that are all nearly similar meet in their buckets; their words aren't fetched for each pair."""
    r = random.Random(3)
    base = [f"w{r.randrange(10**6)}" for _ in range(1600)]
    texts = []
    for k in range(80):
        w = list(base)
        for at in r.sample(range(0, 1600, 6), 22):
            w[at] = f"x{k}x{at}"
        texts.append(" ".join(w))
    sets = minhash.multisets(texts)
    for one, words in ((0, minhash.carried(texts)), (1, minhash.carried(["a b a b a b a b a b a b a b", *texts]))):
        words = [np.frombuffer(x, np.uint32) for x in words]
        if one:
            assert len(words[0]) == 10 and minhash.similarities(words[0], words[1:]).max() == 0
        else:
            assert np.allclose(minhash.similarities(words[0], words[1:]), [overlap(sets[0], x) for x in sets[1:]])
    fetched, verify = [], minhash._verify
    monkeypatch.setattr(minhash, "_verify", lambda pairs, *a: fetched.append(pairs.count()) or verify(pairs, *a))
    got = near_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    links = [(i, j) for i in range(len(texts)) for j in range(i) if overlap(sets[i], sets[j]) >= 0.8]
    assert [x["class_id"] for x in sorted(got)] == list(classes(len(texts), links))
    assert sum(fetched[1:]) < 100, fetched


def test_near_dedup_repeated_ids(spark):
    """Different texts under one doc_id are nodes of their own; each class keeps one row and has a name of its own."""
    rows = [(1, "alpha beta gamma delta epsilon zeta"), (1, "one two three four five six seven"), (2, "one two three four five six seven"), (None, "x y z x y z w"), (1, "one two three four five six seven")]
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string"), small_graph=0).collect()
    by = {}
    for x in got:
        by.setdefault(x["class_id"], []).append(x)
    assert sorted(len(g) for g in by.values()) == [1, 1, 3] and all(sum(x["kept"] for x in g) == 1 and {x["class_size"] for x in g} == {len(g)} for g in by.values())
    assert all(x["doc_id"] == 1 for g in by.values() if len(g) == 3 for x in g if x["kept"])


def test_near_dedup_odd_rows(spark):
    got = near_dedup(odd_documents(spark)).collect()
    assert len(got) == 16
    by = {}
    for x in got:
        by.setdefault(x["class_id"], []).append(x)
    assert all(sum(x["kept"] for x in g) == 1 for g in by.values())
    assert {x["class_id"] for x in got if x["doc_id"] in (1, 11)} == {1} and {x["class_id"] for x in got if x["doc_id"] in (5, 6)} == {5}
    assert {x["class_id"] for x in got if x["doc_id"] in (10, -5, 2**40)} == {-5}  # one word each, equal but for case and marks
    assert len({x["class_id"] for x in got if x["doc_id"] in (2, 3)}) == 1 and {x["class_id"] for x in got if x["doc_id"] == 4} == {4}
    assert near_dedup(empty_documents(spark)).count() == 0


@pytest.mark.parametrize("block", [16, 2048])
def test_embed_dedup_against_brute_force(spark, block):
    r = np.random.RandomState(3)
    rows, centres = [], r.normal(size=(12, 16))
    for i in range(300):
        c = centres[r.randint(12)]
        v = c + r.normal(size=16) * r.choice([0.02, 0.25, 0.4])
        rows.append((i, [float(x) for x in v], int(r.randint(3))))
    rows += [(1000 + k, rows[5][1], rows[5][2]) for k in range(40)]  # copies
    rows += [(2000, None, 1), (2001, [0.0] * 16, 1), (2002, [float("nan")] + [1.0] * 15, 1), (2003, [float("inf")] + [1.0] * 15, 1), (2004, rows[5][1], None), (2005, [], 1), (2006, [None] + [1.0] * 15, 1), (2007, [1.0, 2.0], 1), (2008, [2.0, 4.0], 1)]
    ok = [k for k, (_, v, label) in enumerate(rows) if label is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    links = []
    for p, i in enumerate(ok):
        for j in ok[:p]:
            a, b = (np.asarray(rows[x][1]) for x in (i, j))
            if rows[i][2] == rows[j][2] and len(a) == len(b) and a @ b / np.linalg.norm(a) / np.linalg.norm(b) >= 0.93:
                links.append((j, i))
    root, n = classes(len(rows), links), Counter(x for p in links for x in p)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    got = {x["vec_id"]: x for x in embed_dedup(df, block=block).collect()}
    assert len(got) == len(rows)
    for k, (i, _, _) in enumerate(rows):
        assert (got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (n[k], rows[root[k]][0], rows[root[k]][0] == i)


def test_embed_dedup_many_blocks(spark):
    """Clusters of every density over many blocks: pairs taken whole, pairs of anchors left undecided, single points."""
    r = np.random.RandomState(5)
    rows, centres = [], r.normal(size=(9, 12))
    for i in range(700):
        k = r.randint(9) if i % 3 else 0
        v = centres[k] + r.normal(size=12) * (0.02, 0.1, 0.22)[k % 3]
        rows.append((i, [float(x) for x in v], 1))
    x = np.asarray([v for _, v, _ in rows])
    x /= np.linalg.norm(x, axis=1)[:, None]
    hit = x @ x.T >= 0.93
    links = [(int(a), int(b)) for a, b in zip(*np.nonzero(np.triu(hit, 1)), strict=True)]
    root = classes(len(rows), links)
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    for small in (0, 500_000):
        got = {g["vec_id"]: g for g in embed_dedup(df, block=40, small_graph=small).collect()}
        assert len(got) == 700 and all((got[i]["n_links"], got[i]["component_id"]) == (hit[i].sum() - 1, root[i]) for i in range(700))


def test_cover_tree_levels():
    """Nested levels with halving radii, each point in one branch, down to single points."""
    r = np.random.RandomState(2)
    u = np.concatenate([c + r.normal(size=(60, 10)) * s for c, s in zip(r.normal(size=(10, 10)), [0.01, 0.05, 0.3] * 4)])
    u /= np.linalg.norm(u, axis=1)[:, None]
    t = CoverTree(u)
    leaves = []
    for k, ids in enumerate(t.points):
        assert t.centre[k] in ids and abs(t.radius[k] - np.linalg.norm(u[ids] - u[t.centre[k]], axis=1).max()) < 1e-9
        if not t.many[k]:
            leaves += ids.tolist()
            continue
        kids = t.children(k)
        assert t.centre[k] in t.centre[kids] and sorted(np.concatenate([t.points[c] for c in kids])) == sorted(ids)
        if len(ids) > 8:
            level = next(2.0 ** (1 - n) for n in range(60) if 2.0 ** (1 - n) / 2 < t.radius[k])
            assert all(t.radius[c] <= level / 2 + 1e-7 for c in kids)
            gaps = np.linalg.norm(u[t.centre[kids]][:, None] - u[t.centre[kids]], axis=2) + 9 * np.eye(len(kids))
            assert gaps.min() > level / 2 - 1e-7
    assert sorted(leaves) == list(range(len(u)))


def test_dual_traversal_prunes():
    r = np.random.RandomState(7)
    x = np.concatenate([c + r.normal(size=(40, 32)) * s for c, s in zip(r.normal(size=(50, 32)), [0.01, 0.08, 0.12, 0.2, 0.25] * 10)])
    run = Run(x, None, 0.93)
    all_pairs = len(x) * (len(x) - 1) // 2
    assert run.pruned > 0 and run.compared < all_pairs / 10 and run.node_pairs < all_pairs / 4
    u = x / np.linalg.norm(x, axis=1)[:, None]
    node, links, _ = run.report([np.arange(len(x))], [np.ones(len(x), np.int64)])
    want = (u @ u.T >= 0.93).sum(axis=1) - 1
    assert dict(zip(node.tolist(), links.tolist())) == {i: n for i, n in enumerate(want.tolist()) if n}


def test_embed_dedup_odd_rows(spark):
    schema = "vec_id long, embedding array<float>, label int, node string, cell string"
    v = [1.0, 2.0, 3.0]
    got = embed_dedup(spark.createDataFrame([(None, v, 1, "x", "y"), (4, v, 1, "x", "y"), (4, v, 1, "x", "y"), (9, None, None, None, None)], schema)).collect()
    rows = sorted(((x["vec_id"], x["n_links"], x["component_id"], x["kept"]) for x in got), key=str)
    assert rows == [(4, 2, 4, True), (4, 2, 4, True), (9, 0, 9, True), (None, 2, None, False)]
    assert embed_dedup(spark.createDataFrame([], schema)).count() == 0


def test_signatures_of_a_few_words_alone():
    for n in range(7):
        text = " ".join(f"w{i}" for i in range(n))
        assert (signatures([text])[0] == signatures([text, " ".join(f"v{i}" for i in range(50))])[0]).all()
        assert len(multisets([text])[0][0]) == (n > 0) * max(1, n - 4)


@pytest.mark.parametrize("repeats", (1, 2))
def test_near_dedup_shuffles_texts_again_only_for_repeated_rows(spark, monkeypatch, repeats):
    plans, put = [], Stored.put

    def seen(self, df):
        if df.columns == ["node", "text"]:
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return put(self, df)

    monkeypatch.setattr(Stored, "put", seen)
    words = " ".join(f"w{i}" for i in range(200))
    rows = [(1, words), (2, words + " end"), (3, "another text altogether")] * repeats
    got = near_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r["doc_id"], r["class_id"], r["class_size"]) for r in got) == sorted([(1, 1, 2 * repeats), (2, 1, 2 * repeats), (3, 3, repeats)] * repeats)
    assert sum(r["kept"] for r in got) == 2
    assert [("first(text" in p) for p in plans] == [repeats > 1]

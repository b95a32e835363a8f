"""Small documents with every odd case, and brute-force helpers."""

import random
import zlib

WORDS = "the of and river stone market window garden silver letter winter engine copper yellow forest bridge castle orange pencil rocket".split()
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, shard string, kept int, score string, ids string, node string, key string"


def odd_documents(spark, rows=None):
    """Nulls in every column, empty and long texts, repeated rows, equal texts, special strings; names that clash with results."""
    long_text = " ".join(random.Random(3).choice(WORDS) for _ in range(30_000))
    base = rows if rows is not None else [
        (1, "the river and the stone of winter"), (1, "the river and the stone of winter"), (2, None), (3, ""), (4, "!!! ... ???"), (None, "no id here"), (None, None),
        (5, long_text), (6, long_text), (7, "x<|endoftext|>y <|startoftext|> don't 's"), (8, " \t\n  spaces \r\n\x1c\x1f   end  "), (9, "Ünïcode ΣΑΣ 中文 😀 é İ ﬁ ½ ٣"), (10, "a"), (11, "the river and the stone of winter"), (-5, "a"), (2**40, "A."),
    ]
    made = [(i, t, None if k % 5 == 4 else "en", None if k % 3 == 2 else f"s{k % 2}", None, "x", None, None, None, None, "k") for k, (i, t) in enumerate(base)]
    return spark.createDataFrame(made, SCHEMA)


def empty_documents(spark):
    return spark.createDataFrame([], SCHEMA)


def corpus(n=120, seed=1):
    """(doc_id, text): random texts, each third with near copies and copies."""
    r = random.Random(seed)
    out = []
    while len(out) < n:
        w = [r.choice(WORDS) + str(r.randrange(40)) for _ in range(r.randrange(20, 160))]
        out.append(" ".join(w))
        for _ in range(r.choice((0, 0, 4))):
            v = list(w)
            for _ in range(r.randrange(0, 5)):
                v[r.randrange(len(v))] = r.choice(WORDS)
            out.append(" ".join(v))
    r.shuffle(out)
    return list(enumerate(out[:n]))


def is_held_out(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 4 == 2


def classes(n, links):
    """Smallest member of each member's class."""
    root = list(range(n))
    changed = True
    while changed:
        changed = False
        for a, b in links:
            m = min(root[a], root[b])
            if root[a] != m or root[b] != m:
                root[a] = root[b] = m
                changed = True
    return root

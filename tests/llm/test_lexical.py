"""Ranked lexical search against scores computed one by one."""

import math
import random
import re
from collections import Counter

from llm.helpers import ODD_TEXTS, docs, empty, rows

from cuespark.llm import lexical

TERM = re.compile("[0-9A-Za-z\u0080-\U0010ffff]+")


def terms(text):
    low = "".join(c.lower() if c.isascii() else c for c in text or "")
    return TERM.findall(low)


def brute(texts, items, top=10):
    """[(item_id, rank, doc_id, score)]: texts and items are (id, text)."""
    counts = [(i, Counter(terms(t))) for i, t in texts]
    counts = [(i, c) for i, c in counts if c]
    total = sum(c.total() for _, c in counts)
    out = []
    for item, text in dict.fromkeys(items):
        found = []
        for doc, c in counts:
            m, score = 10 + 90 * c.total() * len(counts) // total, 0
            for t in set(terms(text)) & set(c):
                df = sum(t in other for _, other in counts)
                w = math.floor(1000 * math.log((2 * len(counts) + 2) / (2 * df + 1)))
                score += w * (10**9 * c[t] // (1000 * c[t] + 8 * m))
            if score > 0:
                found.append((-score, doc is None, doc))
        for k, (score, _, doc) in enumerate(sorted(found, key=lambda x: x[:2] + (x[2] or 0,))[:top]):
            out.append((item, k + 1, doc, -score))
    return out


def table_of(spark, items):
    made = [(i, t, 0) for i, t in items]
    return spark.createDataFrame(made, "item_id long, text string, rank int")


def check(spark, texts, items, **settings):
    made = spark.createDataFrame(
        [(i, t, 1) for i, t in texts], "doc_id long, text string, score int"
    ).repartition(3)
    found = lexical.search(made, table_of(spark, items), **settings)
    assert rows(found) == sorted(brute(texts, items, settings.get("top", 10)), key=repr)


def test_scores_ranks_and_ties(spark):
    random.seed(5)
    words = [f"w{i}" for i in range(60)] + ["\u00e9t\u00e9", "\u4f60", "A1"]
    texts = [(i, " ".join(random.choices(words, k=random.randrange(1, 40)))) for i in range(150)]
    texts += [(1000 + i, texts[3][1]) for i in range(30)]  # copies: ties by doc_id
    items = [(i, " ".join(random.choices(words + ["absent"], k=random.randrange(1, 9))))
             for i in range(12)]
    check(spark, texts, items)
    check(spark, texts, items, top=3, block=200)  # several blocks, small heaps


def test_odd_rows(spark):
    texts = list(enumerate(ODD_TEXTS)) + [(None, "the cat"), (4, "One two"), (99, "mat " * 50_000)]
    items = [(0, "the CAT, on the mat!"), (1, None), (2, ""), (3, "two x"), (3, "two x"),
             (None, "mat"), (5, "\u00f6ffnen \u4e16\u754c 123")]
    check(spark, texts, items)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert lexical.search(empty(spark), table_of(spark, [(1, "a")])).count() == 0
    assert lexical.search(docs(spark), none).count() == 0
    assert lexical.search(docs(spark, [None, "", "!"]), table_of(spark, [(1, "a")])).count() == 0


def test_large_scores_are_summed_exactly():
    import numpy as np

    index = lexical.Index([(0, b" ".join(b"t%d" % i for i in range(3000)))])
    weights = np.full(3000, 1 << 42, np.int64)
    numbers = [np.arange(3000, dtype=np.int32)]
    times = [np.arange(1, 3001, dtype=np.int64)]
    found = lexical.scores_of([4_501_500], numbers, times, index, weights, 1, 4_501_500)
    want = sum((1 << 42) * (10**9 * t // (1000 * t + 800)) for t in range(1, 3001))
    assert found.tolist() == [[(want + 2**63) % 2**64 - 2**63]]

"""URL rules, nearest neighbours, benchmark passages."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from llm.helpers import docs, empty, rows
from pyspark.sql import functions as F

from cuespark.llm import ann, decontaminate, urls

# URLs.

URLS = [
    None, "", "no scheme.com/en/", "http://example.com", "https://EXAMPLE.com/en/x?y#z",
    "http://www.example.com/en/a", "http://badexample.com/en/a", "http://m.example.net/es/",
    "http://net/fr/", "ftp://a.net/fr?x", "http://a.org/fr/", "x://h.com?/en/", "://com/",
    "http://a.com/b://net/es/", "http://a.com:80/", "http://www.example.com/EN/a",
    "http://é.example.com/en/\nq", "http://a.b.www.example.com/en/",
]


def _judged(url):
    found = re.match(r"(?s).*?://([^/?#]*)([^?#]*)", url or "")
    host, path = found.groups() if found else ("", "")
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    best = (0, None, "allow")
    for h, p, verdict in urls.RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and len(h + p) > best[0]:
            best = (len(h + p), h + p, verdict)
    return host, path, best[1], best[2]


def test_urls_equal_a_plain_loop(spark):
    given = [(i, u, "x") for i, u in enumerate(URLS)] + [(4, URLS[4], "x"), (None, URLS[5], "x")]
    pages = spark.createDataFrame(given, "page_id long, url string, rule string")
    assert rows(urls.judge_urls(pages)) == sorted(
        ((i, *_judged(u)) for i, u, _ in given), key=repr
    )
    assert urls.judge_urls(pages.limit(0)).count() == 0


def test_rules_with_open_segments_and_signs(spark):
    rules = [("a.com", "/x+y", "block"), ("a.com", "/x+y/z", "allow"), ("com", "", "block")]
    given = ["http://a.com/x+yes", "http://b.a.com/x+y/zoo", "http://axcom/x+y", "http://c.com"]
    pages = spark.createDataFrame(list(enumerate(given)), "page_id long, url string")
    found = {r["page_id"]: (r["rule"], r["verdict"]) for r in urls.judge_urls(pages, rules).collect()}
    assert found == {0: ("a.com/x+y", "block"), 1: ("a.com/x+y/z", "allow"), 2: (None, "allow"),
                     3: ("com", "block")}


def test_urls_run_no_python(spark):
    pages = spark.createDataFrame([(1, "http://a.com")], "page_id long, url string")
    plan = urls.judge_urls(pages)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "Exchange" not in plan


# Nearest neighbours.


def _vectors(spark, vectors):
    return spark.createDataFrame(
        [(i, None if v is None else [float(x) if x is not None else None for x in v], "x")
         for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, rank string"
    )


def _brute(vectors, every, k):
    out = {}
    for q in range(0, len(vectors), every):
        scores = ann.cosines(np.repeat(vectors[q : q + 1], len(vectors), 0), vectors)
        order = [i for i in np.lexsort((np.arange(len(vectors)), -scores)) if i != q]
        out[q] = [(int(i), scores[i]) for i in order[:k]]
    return out


@pytest.mark.parametrize("dim", [64, 13, 1])
def test_neighbours_and_recall_against_brute_force(spark, dim):
    made = np.random.default_rng(dim).standard_normal((900, dim)).astype(np.float32)
    made[100:140] = made[7]  # a group of copies
    found = ann.nearest(_vectors(spark, made), F.col("vec_id") % 50 == 0).collect()
    wanted = _brute(made.astype(float), 50, 5)
    got = {}
    for r in sorted(found, key=lambda r: (r["query_id"], r["rank"])):
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    hits = sum(len({i for i, _ in wanted[q]} & {i for i, _ in got[q]}) for q in wanted)
    assert hits >= 0.98 * 5 * len(wanted)
    assert got[100] == wanted[100]
    assert dim == 1 or [i for i, _ in got[100]] == [7, 101, 102, 103, 104]


def test_odd_vectors_take_no_part(spark):
    given = [[1, 0], None, [0, 0], [1, None], [float("nan"), 1], [float("inf"), 1], [1, 1], [1, 2, 3],
             [], [2, 0]]
    found = ann.nearest(_vectors(spark, given), F.col("vec_id") % 3 == 0)
    assert rows(found.select("query_id", "rank", "vec_id")) == [
        (0, 1, 9), (0, 2, 6), (6, 1, 0), (6, 2, 9), (9, 1, 0), (9, 2, 6)]
    assert ann.nearest(_vectors(spark, given).limit(0), F.col("vec_id") == 0).count() == 0
    assert ann.nearest(_vectors(spark, given[:2]), F.col("vec_id") == 0).count() == 0


def test_vectors_of_every_length_are_compared_among_themselves(spark):
    rng = np.random.default_rng(9)
    given = [rng.normal(size=(4, 16, 16, 33)[i % 4]) for i in range(200)]
    found = ann.nearest(_vectors(spark, given), F.col("vec_id") % 10 == 0, bound=100.0).collect()
    got = {}
    for r in found:
        got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"]))
    for q in range(0, 200, 10):
        own = [i for i in range(200) if len(given[i]) == len(given[q]) and i != q]
        # the table holds floats
        a, b = np.float32(given[q]).astype(float), [np.float32(given[i]).astype(float) for i in own]
        order = np.argsort([-(a @ x) / np.linalg.norm(a) / np.linalg.norm(x) for x in b])[:5]
        assert sorted(got[q]) == [(k + 1, own[i]) for k, i in enumerate(order)]


# Benchmark passages.


def _words(text):
    low = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def _passages(texts, items, window):
    out = []
    for text in texts:
        words, hits, found = _words(text), set(), set()
        for item_id, item in items:
            own = _words(item)
            for i in range(max(1, len(own) - window + 1) if own else 0):
                part = own[i : i + window]
                for p in range(len(words) - len(part) + 1):
                    if words[p : p + len(part)] == part:
                        hits.update(range(p, p + len(part)))
                        found.add(item_id)
        out.append((len(words), sorted(hits), sorted(found - {None})))
    return out


ITEMS = [
    ("10", "One small step for a man, one giant leap for all of us"), ("2", "short item"), ("3", None),
    ("4", "solo"), ("5", "go go go go go go go go go go go go"), ("2", "short item"), (None, "ghost word"),
    ("6", "ÉTÉ à la mer"),
]
TEXTS = [
    None, "", "one small step for a man one giant leap", "x One-small step; for a man one giant leap for",
    "a short, item! solo ghost word", "go " * 30, "été à la mer", "ÉTÉ à la mer, SOLO", "short", "item solo",
]


@pytest.mark.parametrize("window", [2, 3, 10])
def test_passages_equal_a_plain_loop(spark, window, monkeypatch):
    random.seed(window)
    letters = ["one small step".split()[random.randrange(3)] for _ in range(400)]
    texts = TEXTS + [" ".join(letters)]
    items = ITEMS + [("7", " ".join(letters[50:80])), ("8", " ".join(letters[90:70:-1]))]
    benchmark = spark.createDataFrame(items, "item_id string, text string")
    given = docs(spark, texts).selectExpr("doc_id", "encode(coalesce(text, ''), 'utf-8') AS body")
    want = [(i, *x) for i, x in enumerate(_passages(texts, items, window))]
    one = decontaminate.find_passages(given, benchmark, window).drop("matches")
    assert sorted(tuple(r) for r in one.collect()) == want
    monkeypatch.setattr(decontaminate, "BLOCK", 40)  # several blocks of the benchmark
    many = decontaminate.find_passages(given, benchmark, window).drop("matches")
    assert sorted(tuple(r) for r in many.collect()) == want


def test_longest_matches_and_removal(spark):
    benchmark = spark.createDataFrame(ITEMS[:1], "item_id string, text string")
    given = docs(spark, ["so: One small step for a man, one giant leap for all", "clean", None])
    body = given.selectExpr("doc_id", "encode(coalesce(text, ''), 'utf-8') AS body")
    found = decontaminate.find_passages(body, benchmark, 10, matches=True).collect()
    matches = {r["doc_id"]: [m.asDict() for m in r["matches"]] for r in found}
    assert matches == {0: [{"item_id": "10", "item_word": 0, "doc_word": 1, "n_words": 11}], 1: [], 2: []}
    kept = decontaminate.remove_contaminated(given, benchmark)
    assert kept.columns == given.columns and [r["doc_id"] for r in kept.collect()] == [1, 2]


def test_odd_rows_and_empty_tables(spark):
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    assert decontaminate.judge_documents(docs(spark), benchmark).count() == docs(spark).count()
    assert decontaminate.judge_documents(empty(spark), benchmark).count() == 0
    none = decontaminate.judge_documents(docs(spark), benchmark.limit(0)).collect()
    assert Counter(r["contaminated"] for r in none) == {False: len(none)}


def test_repeated_items_do_not_fill_a_block(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 200)
    sizes, keep = [], decontaminate._searcher

    def seen(texts, window, matches):
        sizes.append(sum(len(body) for _, body in texts.value))
        return keep(texts, window, matches)

    monkeypatch.setattr(decontaminate, "_searcher", seen)
    given = spark.createDataFrame([(1, "one two three four")], "doc_id long, text string")
    items = spark.createDataFrame([(7, "two three")] * 100 + [(None, "four")] * 9, "item_id long, text string")
    found = decontaminate.judge_documents(given, items, 2).first()
    assert (found["n_hit"], found["n_items"]) == (3, 1)
    assert sizes == [len("two three") + len("four")]


def test_words_of_a_batch_take_few_times_its_bytes():
    import tracemalloc
    from types import SimpleNamespace

    import pyarrow as pa

    texts = [b" ".join(b"w%d" % ((i * 31 + j * 7) % 50_021) for j in range(1000)) for i in range(1500)]
    texts[7] += b" alone " + b" ".join([b"go"] * 12)
    none = pa.array([[]] * len(texts), pa.list_(pa.string()))
    columns = {
        "body": pa.array(texts), "n_words": pa.array([0] * len(texts)),
        "hits": none.cast(pa.list_(pa.int64())), "items": none, "matches": none,
    }
    items = [("1", b"alone " + b"go " * 10), ("2", b"no such words")]
    search = decontaminate._searcher(SimpleNamespace(value=items), 10, False)
    tracemalloc.start()
    (found,) = search([pa.RecordBatch.from_pydict(columns)])
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert found["n_words"].to_pylist() == [1013 if i == 7 else 1000 for i in range(1500)]
    assert found["hits"].to_pylist() == [list(range(1000, 1013)) if i == 7 else [] for i in range(1500)]
    assert found["items"].to_pylist() == [["1"] if i == 7 else [] for i in range(1500)]
    assert peak < 6 * sum(map(len, texts))


def test_removal_reads_a_text_of_any_type_and_name(spark, monkeypatch):
    monkeypatch.setattr(decontaminate, "BLOCK", 30)  # several blocks
    benchmark = spark.createDataFrame(ITEMS, "item_id string, text string")
    given = docs(spark, TEXTS)
    want = [r["doc_id"] for r in decontaminate.judge_documents(given, benchmark).collect() if not r["contaminated"]]
    plain = decontaminate.remove_contaminated(given, benchmark)
    raw = decontaminate.remove_contaminated(given.withColumn("text", F.col("text").cast("binary")), benchmark)
    other = decontaminate.remove_contaminated(given, benchmark, text="TEXT")
    for kept in (plain, raw, other):
        assert kept.columns == given.columns and [r["doc_id"] for r in kept.collect()] == want
    assert "body" not in plain._jdf.queryExecution().optimizedPlan().toString().split("MapInArrow")[-1]

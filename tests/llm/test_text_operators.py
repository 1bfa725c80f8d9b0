"""Operators whose result a few lines of Python can give: shards, BPE, counts, PPM, SimHash."""

import hashlib
import math
import random
import zlib
from collections import Counter

import pytest
from llm.helpers import ODD_TEXTS, docs, empty, rows

from cuespark import session
from cuespark.llm import bpe, common, counts, ppm, shards, simhash
from cuespark.llm.common import components
from cuespark.llm.queries import tokenizer_file

BYTES, WORDS = "byte_bpe_50k.json", "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return {n: Tokenizer.from_file(tokenizer_file(n)) for n in (BYTES, WORDS)}


# Shards.


def test_shards_are_contiguous_gapless_and_near_equal(spark):
    random.seed(1)
    texts = ["x" * random.randrange(300) + str(i % 350) for i in range(700)]
    found = shards.shard_by_bytes(docs(spark, texts)).collect()
    sizes, slots = Counter(), {}
    for r in found:
        text = texts[r["doc_id"]].encode()
        assert (r["size"], r["text_crc32"]) == (len(text) + 1, zlib.crc32(text))
        sizes[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(slots) == 8
    target = sum(sizes.values()) / 8
    assert all(abs(s - target) <= 0.02 * target + 600 for s in sizes.values())


def test_small_groups_of_equal_texts_stay_whole_and_large_ones_are_cut(spark):
    texts = [f"pair {i // 2} " + "y" * 50 for i in range(4000)]
    shard = {}
    for r in shards.shard_by_bytes(docs(spark, texts)).collect():
        shard.setdefault(texts[r["doc_id"]], set()).add(r["shard"])
    assert all(len(s) == 1 for s in shard.values())
    same = shards.shard_by_bytes(docs(spark, ["same"] * 800)).collect()
    assert Counter(r["shard"] for r in same) == {i: 100 for i in range(8)}


def test_shards_of_odd_rows(spark):
    found = shards.shard_by_bytes(docs(spark)).collect()
    assert len(found) == len(ODD_TEXTS) + 2 and {r["law"] for r in found} == {"bytes"}
    assert sorted(r["size"] for r in found)[:2] == [1, 1]
    assert shards.shard_by_bytes(empty(spark)).count() == 0


# BPE.


def test_encoding_equals_the_library(spark, library):
    found = bpe.round_trip(docs(spark), tokenizer_file(BYTES), leaf=64).collect()
    texts = {i: t or "" for i, t in enumerate(ODD_TEXTS)} | {None: "no id here"}
    assert len(found) == len(ODD_TEXTS) + 2
    for r in found:
        ids = library[BYTES].encode(texts[r["doc_id"]], add_special_tokens=False).ids
        text = library[BYTES].decode(ids, skip_special_tokens=False)
        assert r["n_tokens"] == len(ids)
        assert r["ids_sha256"] == hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(text.encode()).hexdigest()
    assert bpe.round_trip(empty(spark), tokenizer_file(BYTES)).count() == 0


@pytest.mark.parametrize("leaf", [8, 37, 200])
def test_unsplit_text_is_joined_exactly(spark, library, leaf):
    random.seed(leaf)
    pieces = ["er", "the", "in", "aa", "a", "é", "zu", "9", "==", "'s", "你", "\t", "\n\n"]
    texts = ["".join(random.choices(pieces, k=n)) for n in (30, 300, 3000)]
    texts += ["ab" * 2000, "=" * 999, " " * 500 + "x", "q" * 700 + "<|endoftext|>" + "q" * 700]
    texts += texts[:1]
    found = bpe.decode(bpe.encode(docs(spark, texts), tokenizer_file(BYTES), leaf=leaf),
                       tokenizer_file(BYTES)).collect()
    assert len(found) == len(texts)
    for r in found:
        text = texts[r["row"]["doc_id"]]
        assert r["ids"] == library[BYTES].encode(text, add_special_tokens=False).ids
        assert r["decoded"] == text and r["row"]["text"] == text


def test_decoding_of_ids_that_are_no_text(spark):
    ids = spark.createDataFrame([([182, 0],), (None,), ([],)], "ids array<int>")
    found = [r["decoded"] for r in bpe.decode(ids, tokenizer_file(BYTES)).collect()]
    assert found[0].endswith("!") and found[1:] == ["", ""]


# Token counts.


def test_token_counts_equal_the_library(spark, library):
    extra = ODD_TEXTS + ["e\u0301 \u0301x", "a\x0bb\x0cc\x85d\u2028e", "A\u0130B \u03a3\u03a3"]
    found = counts.count_tokens(docs(spark, extra), tokenizer_file(WORDS), limit=5).collect()
    assert len(found) == len(extra)
    for r in found:
        text = extra[r["doc_id"]] or ""
        n = len(library[WORDS].encode(text, add_special_tokens=False).ids)
        assert (r["n_bytes"], r["n_tokens"]) == (len(text.encode()), n)
        assert r["over_limit"] == (n > 5)
    assert len(counts.count_tokens(docs(spark), tokenizer_file(WORDS)).collect()) == len(ODD_TEXTS) + 2
    assert counts.count_tokens(empty(spark), tokenizer_file(WORDS)).count() == 0


def test_rare_words_are_summed_by_join(spark):
    from cuespark.llm.common import sums_by_word, utf8, word_counts

    given = docs(spark).select("doc_id", utf8("text").alias("body"))
    words = word_counts(given.selectExpr("body", "false AS counted"), bytes.split)
    valued = words.selectExpr("word", "n", "length(word) AS v").cache()
    near = rows(sums_by_word(given, valued, ["v"], bytes.split, most=1000))
    assert near == rows(sums_by_word(given, valued, ["v"], bytes.split, most=2))
    assert sum(r[2] for r in near) == sum(
        len(w) for t in [*ODD_TEXTS, "no id here", "One two"] for w in (t or "").encode().split()
    )


# PPM.


def _ppm_by_hand(training, text, order):
    """The score with counts taken from the running texts, not from distinct words and events."""
    nodes = [{} for _ in range(order + 1)]
    for t in training:
        for word in ppm.words_and_end((t or "").encode()):
            line = b" " + (word + b" " if word != b"\n" else word)
            for i in range(1, len(line)):
                for k in range(min(order, i) + 1):
                    below = nodes[k].setdefault(line[i - k : i], Counter())
                    below[line[i]] += 1
    total = 0.0
    for word in ppm.words_and_end((text or "").encode()):
        line = b" " + (word + b" " if word != b"\n" else word)
        for i in range(1, len(line)):
            gone = set()
            for k in range(min(order, i), -1, -1):
                found = {s: n for s, n in nodes[k].get(line[i - k : i], {}).items() if s not in gone}
                if not found:
                    continue
                n = sum(found.values())
                if line[i] in found:
                    total += math.log10((found[line[i]] - 0.5) / n)
                    break
                total += math.log10(len(found) / 2 / n)
                gone |= set(found)
            else:
                total -= math.log10(256 - len(gone))
    return total


@pytest.mark.parametrize("order", [2, 5])
def test_scores_equal_a_trie_by_hand(spark, order):
    found = ppm.score_texts(docs(spark), order=order).collect()
    assert len(found) == len(ODD_TEXTS) + 2
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 7 == 2
    every = [*enumerate(ODD_TEXTS), (None, "no id here"), (4, "One two")]
    training = [t for i, t in every if not held(i)]
    words = Counter(w for t in training for w in ppm.words_and_end((t or "").encode()))
    n, v = sum(words.values()), len(words)
    texts = dict(every)
    for r in found:
        own = ppm.words_and_end((texts[r["doc_id"]] or "").encode())
        base = sum(math.log10((words[w] + 1) / (n + v + 1)) for w in own)
        assert (r["held_out"], r["n_tokens"], r["train_tokens"]) == (held(r["doc_id"]), len(own), n)
        assert r["n_known"] == sum(words[w] > 0 for w in own)
        assert r["base_score"] == pytest.approx(base)
        assert r["score"] == pytest.approx(_ppm_by_hand(training, texts[r["doc_id"]], order))


def test_probabilities_of_a_context_add_up_to_one(spark):
    events = [(e, 1) for w in (b"the", b"then", b"at", b"\n") for e in ppm.events_of(w, 3)]
    nodes = ppm.trie(events, range(4))
    for context in (b" ", b" th", b"the", b"zzz"):
        total = sum(10 ** ppm.log10_probability(context + bytes([s]), nodes) for s in range(256))
        assert total == pytest.approx(1.0)


def test_score_without_training_rows(spark):
    assert ppm.score_texts(empty(spark)).count() == 0
    one = next(i for i in range(99) if zlib.crc32(str(i).encode()) % 7 == 2)
    alone = spark.createDataFrame([(one, "ab")], "doc_id long, text string")
    r = ppm.score_texts(alone).first()
    assert (r["train_tokens"], r["n_known"], r["base_score"]) == (0, 0, 0.0)
    assert r["score"] == pytest.approx(-4 * math.log10(256))


# SimHash.


def _fingerprint(text):
    from xxhash import xxh64_intdigest

    words = (text or "").encode().lower().split()
    runs = [b" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))] if words else []
    found = [xxh64_intdigest(r, 42) for r in runs]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in found) > len(found))


def test_fingerprints_and_components_of_odd_rows(spark):
    found = simhash.near_duplicates(docs(spark)).collect()
    texts = dict(enumerate(ODD_TEXTS)) | {None: "no id here"}
    assert len(found) == len(texts) + 1
    for r in found:
        assert r["fp"] % 2**64 == _fingerprint(texts[r["doc_id"]])
    by = {r["doc_id"]: r["component_id"] for r in found}
    assert by[0] == by[1] == by[2] == 0 and by[5] == by[6] == by[7] == 5 and by[None] is None
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("few", [1, 3, 1000])
def test_links_on_both_sides_of_a_crowded_entry(spark, few):
    random.seed(5)
    values = set()
    for _ in range(25):
        centre = random.getrandbits(64)
        for _ in range(12):
            centre ^= sum(1 << b for b in random.sample(range(64), random.randrange(1, 4)))
            values.add(centre)
    values |= {0, 1, 3, 7, 2**63, 2**63 + 1}
    values = sorted(values)
    signed = [simhash._signed(v) for v in values]
    classes = spark.createDataFrame([(v,) for v in signed], "fp long")
    links = simhash.links(classes, few)
    wanted = {(a, b) for a in values for b in values if a < b and (a ^ b).bit_count() <= 2}
    got = {tuple(sorted((r["a"] % 2**64, r["b"] % 2**64))) for r in links.collect()}
    assert got <= wanted and (got == wanted or few < 1000)
    found = {r["node"] % 2**64: r["component"] for r in components(links).collect()}
    assert _classes(found, set(found)) == _classes(_union(wanted), set(found))


def _union(pairs):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in pairs:
        parent[find(a)] = find(b)
    return {x: find(x) for x in list(parent)}


def _classes(of, nodes):
    groups = {}
    for x in nodes:
        groups.setdefault(of[x], set()).add(x)
    assert nodes == set(of)
    return sorted(map(sorted, groups.values()))


def test_components_of_a_long_path_and_a_star(spark):
    pairs = [(i, i + 1) for i in range(200)] + [(1000, 1000 + i) for i in range(1, 300)]
    random.seed(3)
    random.shuffle(pairs)
    links = spark.createDataFrame(pairs + [(5, 5), pairs[0]], "a long, b long")
    found = dict(tuple(r) for r in components(links).collect())
    assert found == {i: 0 for i in range(201)} | {1000 + i: 1000 for i in range(300)}
    assert components(links.limit(0)).count() == 0


@pytest.mark.parametrize("most, tables", [(1 << 16, 1), (700, 3), (0, 99)])
def test_components_of_few_edges_need_no_rounds(spark, monkeypatch, most, tables):
    written = []
    monkeypatch.setattr(common, "stored", lambda df, name: written.append(name) or session.stored(df, name))
    pairs = [(i, i + 1) for i in range(-100, 200)] + [(1000, 1000 + i) for i in range(1, 300)]
    random.seed(4)
    random.shuffle(pairs)
    links = spark.createDataFrame(2 * pairs + [(5, 5), (None, 3)], "a long, b long")
    found = dict(tuple(r) for r in common.components(links, most=most).collect())
    assert found == {i: -100 for i in range(-100, 201)} | {1000 + i: 1000 for i in range(300)}
    assert len(written) <= tables


def test_one_row_of_each_component_stays_as_it_was(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "d"))
    stored = spark.read.parquet(str(tmp_path / "d"))
    kept = simhash.keep_one(stored)
    assert kept.columns == stored.columns
    ids = sorted((r["doc_id"] for r in kept.collect()), key=str)
    assert ids == sorted([0, 3, 4, 5, *range(8, len(ODD_TEXTS)), None], key=str)


def test_a_frequent_word_is_looked_up_near_however_long_it_is(spark):
    from cuespark.llm.common import frequent_words

    rows = [(b"x" * 5000, 4000), *((f"w{i}".encode(), 3) for i in range(500)), (b"y" * 900, 3)]
    words = spark.createDataFrame(rows, "word binary, n long")
    assert [len(r["word"]) for r in frequent_words(words, 100).collect()] == [5000]
    assert frequent_words(words, 1000).count() == 502
    assert frequent_words(words, 1000, 1).count() == 0
    assert frequent_words(words.limit(0), 10).count() == 0


def test_long_hot_words_are_counted(spark, library):
    texts = ["z" * 3000 + f" word{i % 7} end" for i in range(200)]
    found = counts.count_tokens(docs(spark, texts), tokenizer_file(WORDS)).collect()
    for r in found:
        assert r["n_tokens"] == len(library[WORDS].encode(texts[r["doc_id"]], add_special_tokens=False).ids)

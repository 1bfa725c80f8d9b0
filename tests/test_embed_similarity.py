import hashlib
import re
import sys

import numpy as np
import pytest
from pyspark import cloudpickle

from conftest import column
from cuespark.functions import vectors
from cuespark.operators import embed, similarity
from cuespark.plans.backends import DigestEncoder

TEXTS = ["The cat sat", "the", "", None, "Ünï 日本 x_1, the THE cat"]


def word_vector(word, dim=16):
    h = hashlib.md5(word.encode()).hexdigest()
    numbers = [int(h[:14], 16), int(h[14:28], 16)]
    return np.array([((numbers[j // 8] >> 7 * (j % 8)) & 127) / 63.5 - 1 for j in range(dim)])


def pooled(text, strategy, window=None):
    words = re.findall(r"\w+", (text or "").lower())[:window]
    if not words:
        return np.zeros(16)
    rows = [word_vector(w) for w in words]
    return rows[0] if strategy == "cls" else np.mean(rows, axis=0)


@pytest.mark.parametrize("strategy", ["cls", "mean"])
@pytest.mark.parametrize("window", [None, 2])
def test_pooling_equals_numpy(texts, strategy, window):
    df = embed.embed_table(texts(*TEXTS), "raw_text", strategy, max_tokens=window)
    for got, text in zip(column(df, "embedding"), TEXTS):
        np.testing.assert_allclose(got, pooled(text, strategy, window), atol=1e-6)
    assert set(column(df, "method")) == {f"lexical_{strategy}"}


def test_methods_come_from_one_pass(texts):
    df = embed.embed_methods(texts(*TEXTS), "raw_text", {"a": "cls", "b": "mean", "c": "cls"}, dim=5)
    assert df.count() == 15
    rows = {(r.post_id, r.method): r.embedding for r in df.collect()}
    np.testing.assert_allclose(rows[(4, "b")], pooled(TEXTS[4], "mean")[:5], atol=1e-6)
    assert rows[(4, "a")] == rows[(4, "c")]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan


def test_wrong_strategy_column_or_dimension(texts):
    with pytest.raises(ValueError, match="'max'"):
        embed.embed_table(texts("a"), "raw_text", "max")
    with pytest.raises(ValueError, match="nowhere"):
        embed.embed_table(texts("a"), "nowhere")
    with pytest.raises(ValueError):
        embed.embed_table(texts("a"), "raw_text", dim=0)


@pytest.mark.parametrize("strategy", ["cls", "mean"])
def test_more_components_than_one_digest_holds(texts, strategy):
    df = texts("one two", "", "one")
    short = column(embed.embed_table(df, "raw_text", strategy), "embedding")
    long = column(embed.embed_table(df, "raw_text", strategy, dim=100), "embedding")
    assert [v[:16] for v in long] == short and all(len(v) == 100 for v in long)
    assert len(set(long[0])) > 50 and set(long[1]) == {0.0}


# Backends defined here travel to the Python workers with their code.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


class BadEncoder(DigestEncoder):
    def embed_batch(self, texts):
        if "bad" in texts:
            raise RuntimeError("too long")
        return super().embed_batch(texts)


def test_external_encoder(texts, tmp_path):
    values = ["a", "bad", "a", None, " a\n"]
    df = embed.embed_external(texts(*values), BadEncoder, 8, "ext", text="raw_text",
                              store=f"{tmp_path}/vectors")
    got = column(df, "embedding")
    want = DigestEncoder().embed_batch(["a", ""])
    np.testing.assert_allclose(got[0], want[0], atol=1e-6)
    np.testing.assert_allclose(got[3], want[1], atol=1e-6)
    assert got[0] == got[2] == got[4] and got[1] == [0.0] * 8
    assert [e is None for e in column(df, "embed_error")] == [True, False, True, True, True]
    again = embed.embed_external(texts(*values, "new"), DigestEncoder, 8, "ext", text="raw_text",
                                 store=f"{tmp_path}/vectors")
    assert column(again, "embedding")[1] == [0.0] * 8  # kept, not encoded again
    assert len(column(again, "embedding")) == 6 and column(again, "embed_error")[1]
    mended = embed.embed_external(texts(*values), DigestEncoder, 8, "ext", text="raw_text",
                                  store=f"{tmp_path}/vectors", retry_errors=True)
    np.testing.assert_allclose(column(mended, "embedding")[1], DigestEncoder().embed_batch(["bad"])[0], atol=1e-6)
    assert column(mended, "embed_error") == [None] * 5


def test_learned_vocabulary_is_bounded(texts):
    df = texts(*["often often often often some some once"] * 8)
    model = embed.fit_learned(df, "raw_text", dim=4, min_count=1, most_words=2)
    assert {r.word for r in model.getVectors().collect()} == {"often", "some"}


def test_learned_vectors(texts):
    df = texts(*["alpha beta gamma delta"] * 20)
    model = embed.fit_learned(df, "raw_text", dim=4, min_count=1)
    made = embed.embed_learned(df, model, "raw_text")
    assert made.count() == 20 and len(made.first().embedding) == 4


def test_cost(texts):
    row = embed.embedding_cost(texts("a b c", None, "d"), "raw_text", "text-embedding-3-large").first()
    assert (row.num_texts, row.estimated_tokens, row.dimension) == (3, 5, 3072)
    assert row.estimated_cost_usd == pytest.approx(4 / 0.75 / 1000 * 0.00013)
    assert embed.dimension_of("unknown") == 1536
    assert embed.embedding_cost(texts("a"), "raw_text", "unknown").first().cost_per_1k_tokens == 1e-4


@pytest.fixture
def table(spark):
    rng = np.random.default_rng(1)
    data = rng.normal(size=(60, 5))
    data[7] = 0
    rows = [(i, "m1" if i % 2 else "m2", v.tolist()) for i, v in enumerate(data)]
    return data, spark.createDataFrame(rows, "vec_id bigint, method string, embedding array<double>")


def test_norms(table):
    data, df = table
    row = similarity.norm_stats(df).first()
    norms = np.linalg.norm(data, axis=1)
    assert row.avg_norm == pytest.approx(norms.mean()) and row.std_norm == pytest.approx(norms.std())


def cosines(data):
    n = len(data)
    return {
        (i, j): float(data[i] @ data[j] / (np.linalg.norm(data[i]) * np.linalg.norm(data[j])))
        for i in range(n) for j in range(i + 1, n)
    }


def test_pairs(table):
    data, df = table
    got = {(r.left_id, r.right_id): r.similarity for r in similarity.pairwise_similarity(df, n=7).collect()}
    assert got == pytest.approx(cosines(data[:7]))
    few = similarity.pairwise_similarity(df.filter("vec_id < 1"))
    assert few.count() == 0
    with pytest.raises(ValueError):
        similarity.pairwise_similarity(df, n=1000)


def test_mean_similarity_equals_all_pairs(table):
    data, df = table
    units = np.delete(data, 7, axis=0)
    row = similarity.mean_similarity(df).first()
    assert row.n_vectors == 59
    assert row.mean_similarity == pytest.approx(np.mean(list(cosines(units).values())))
    assert similarity.mean_similarity(df.filter("vec_id = 1")).first().mean_similarity is None


def test_report_and_zero_vectors(table):
    data, df = table
    row = similarity.embedding_report(df, sample_size=1000).first()
    assert (row.sample_size, row.embedding_dimension) == (60, 5)
    found = [c for c in cosines(data[:10]).values() if not np.isnan(c)]
    assert row.avg_pairwise_similarity == pytest.approx(np.mean(found))
    single = similarity.embedding_report(df.filter("vec_id = 3")).first()
    assert (single.sample_size, single.avg_pairwise_similarity) == (1, 0.0)
    both = df.withColumn("other", df.embedding)
    stats = similarity.strategy_compare(both, "embedding", "other").first()
    assert stats.n_undefined == 1 and stats.avg_cosine_similarity == pytest.approx(1.0)


def test_pack_and_unpack(spark, table):
    _, df = table
    wide = vectors.unpack(df, "bert_cls", 5)
    assert wide.columns[-1] == "bert_cls_embed_4"
    shuffled = wide.select(*sorted(wide.columns, reverse=True))
    packed = vectors.pack(shuffled)
    assert sorted(packed.select("vec_id", "embedding").collect()) == sorted(
        df.select("vec_id", "embedding").collect())
    many = spark.range(1).selectExpr(*[f"{i} as embed_{i}" for i in range(12)])
    assert vectors.pack(many).first().embedding == list(range(12))
    with pytest.raises(ValueError, match="No embedding columns"):
        vectors.pack(spark.range(1))


def test_spread_of_all_pairs(spark):
    rng = np.random.default_rng(2)
    rows = [(i, "a", rng.normal(size=70).tolist()) for i in range(40)]
    rows += [(100 + i, "b", (rng.normal(size=3) + 2).tolist()) for i in range(25)]
    rows += [(200, "b", [0.0, 0.0, 0.0]), (201, "c", [1.0, 2.0]), (202, "b", None), (203, "b", [1.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, method string, embedding array<double>").repartition(5)
    got = {(r.method, r.dimension): r for r in similarity.similarity_spread(df, "method", rows=16).collect()}
    for (name, d), n in {("a", 70): 40, ("b", 3): 25}.items():
        x = np.array([v for _, m, v in rows if m == name and v and len(v) == d and any(v)])
        u = x / np.linalg.norm(x, axis=1, keepdims=True)
        pairs = (u @ u.T)[np.triu_indices(n, 1)]
        r = got[name, d]
        assert r.n_vectors == n
        assert (r.mean_similarity, r.std_similarity) == (pytest.approx(pairs.mean()), pytest.approx(pairs.std()))
    assert got["c", 2].mean_similarity is None and got["c", 2].std_similarity is None
    assert got["b", 2].n_vectors == 1 and len(got) == 4
    assert similarity.similarity_spread(df.limit(0), "method").count() == 0


def test_sums_of_long_texts_stay_exact(spark):
    """Texts at, and over, the number of words up to which three sums share a number."""
    import hashlib

    from cuespark.operators import embed

    digests = {w: hashlib.md5(w.encode()).hexdigest() for w in ("a", "b")}
    for n in (0, 1, embed._APART, embed._APART + 1):
        text = " ".join(["a"] * (n - n // 3) + ["b"] * (n // 3))
        rows = spark.createDataFrame([(1, text)], "post_id bigint, t string")
        got = embed.embed_table(rows, "t", dim=20).first()["embedding"]
        for j, value in enumerate(got):
            if j < 16:
                part = {w: int(d[14 * (j // 8) :][:14], 16) >> 7 * (j % 8) & 127 for w, d in digests.items()}
                total = part["a"] * (n - n // 3) + part["b"] * (n // 3)
                assert value == (np.float32(total / n / 63.5 - 1.0) if n else 0.0)
        assert len(got) == 20


def test_texts_are_cleaned_and_hashed_once(texts, capsys):
    """The joined rows come from a stored copy: their plan hashes no text again."""
    df = texts("one two", " one two\n", "three", None)
    made = embed.embed_external(df, DigestEncoder, DigestEncoder.dim, "digest", text="raw_text")
    made.explain()
    assert "sha2(" not in capsys.readouterr().out
    found = column(made, "embedding")
    assert found[0] == found[1] != found[2] and len(found) == 4

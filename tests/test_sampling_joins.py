import hashlib
import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from cuespark.operators import joins, sampling


def digest(seed, key):
    return hashlib.md5(f"{seed}:{key}".encode()).hexdigest()


@pytest.fixture(params=[100_000, 40, 1])
def rank_rows(request, monkeypatch):
    """Also with buckets so small that they are divided several times."""
    monkeypatch.setattr(sampling, "_RANK_ROWS", request.param)


@pytest.mark.parametrize("n", [1, 7, 500, 1999, 2000, 9999])
def test_sample_is_the_smallest_hashes(spark, rank_rows, n):
    df = spark.range(2000).withColumnRenamed("id", "post_id")
    got = {r.post_id for r in sampling.sample_rows(df, n).collect()}
    assert got == set(sorted(range(2000), key=lambda i: digest(42, i))[:n])


def test_sample_of_copies_of_one_key_terminates(spark, rank_rows):
    df = spark.range(500).select(F.lit(7).alias("post_id"))
    assert sampling.sample_rows(df, 10).count() == 10


@pytest.mark.parametrize("n", [1, 5, 9_999, 10_000, 10_001])
def test_repeated_keys_give_the_size_asked_for(spark, n):
    df = spark.range(14_000).select((F.col("id") % 7).alias("post_id"), F.col("id").alias("row"))
    rows = sampling.sample_rows(df, n).collect()
    assert len(rows) == n
    first = sorted(range(7), key=lambda k: digest(42, k))[: -(-n // 2000)]
    assert {r.post_id for r in rows} == set(first)
    assert set(rows) == set(sampling.sample_rows(df.repartition(5), n).collect())


def test_fraction_is_stable_under_partitioning(spark):
    df = spark.range(5000).withColumnRenamed("id", "post_id")
    one = {r.post_id for r in sampling.sample_fraction(df, 0.1).collect()}
    two = {r.post_id for r in sampling.sample_fraction(df.repartition(7), 0.1).collect()}
    assert one == two and 400 < len(one) < 600


def labelled(spark, counts):
    rows, i = [], 0
    for label, n in counts.items():
        rows += [(i + j, label) for j in range(n)]
        i += n
    random.Random(3).shuffle(rows)
    return rows, spark.createDataFrame(rows, "vec_id bigint, gender string")


@pytest.mark.parametrize("counts", [{"A": 900, "B": 31, "C": 4}, {"A": 5, "B": 5}, {"x": 333, "y": 334}])
def test_split_is_exact_per_class(spark, rank_rows, counts):
    rows, df = labelled(spark, counts)
    got = {r.vec_id: r.split for r in sampling.stratified_split(df).collect()}
    total = len(rows)
    quotas = sampling.train_quotas(counts, 0.2)
    assert sum(quotas.values()) == total - math.ceil(0.2 * total)
    for label, n in counts.items():
        ids = sorted((i for i, g in rows if g == label), key=lambda i: digest(42, i))
        cut = n - quotas[label]
        assert abs(cut - 0.2 * n) <= 1
        assert [got[i] for i in ids] == ["test"] * cut + ["train"] * (n - cut)


def test_split_refuses_what_cannot_be_stratified(spark):
    for counts in ({"A": 1, "B": 1, "C": 1}, {"A": 2, "B": 2, "C": 2}):
        with pytest.raises(ValueError):
            sampling.stratified_split(labelled(spark, counts)[1])
    missing = spark.createDataFrame([(0, None), (1, "A")], "vec_id bigint, gender string")
    with pytest.raises(ValueError, match="missing"):
        sampling.stratified_split(missing)


@pytest.mark.parametrize("k", [2, 3, 5])
def test_folds_deal_sorted_labels_in_turn(spark, rank_rows, k):
    counts = {"A": 100, "B": 37, "C": 8}
    rows, df = labelled(spark, counts)
    got = {r.vec_id: r.fold for r in sampling.stratified_folds(df, k=k).collect()}
    dealt = Counter((g, p % k) for p, g in enumerate(sorted(g for _, g in rows)))
    label_of = dict(rows)
    assert Counter((label_of[i], f) for i, f in got.items()) == dealt
    for label in counts:
        order = sorted((i for i, g in rows if g == label), key=lambda i: digest(42, i))
        folds = [got[i] for i in order]
        assert folds == sorted(folds)


def test_split_with_seed_zero_differs(spark):
    _, df = labelled(spark, {"A": 200, "B": 200})
    zero = {r.vec_id: r.split for r in sampling.stratified_split(df, seed=0).collect()}
    other = {r.vec_id: r.split for r in sampling.stratified_split(df, seed=42).collect()}
    assert zero != other


def test_split_plan_has_no_window_and_no_shuffle(spark):
    _, df = labelled(spark, {"A": 200, "B": 200})
    plan = sampling.stratified_split(df)._jdf.queryExecution().executedPlan().toString()
    assert "Window" not in plan and "Exchange hashpartitioning" not in plan


@pytest.mark.parametrize("how", ["left", "inner"])
def test_hot_key_join_equals_plain_join(spark, how):
    rng = random.Random(5)
    keys = [1] * 400 + [rng.randint(2, 60) for _ in range(600)] + [None] * 5
    many = spark.createDataFrame(list(enumerate(keys)), "post_id bigint, k bigint")
    one = spark.createDataFrame([(k, f"v{k}") for k in range(50)], "k bigint, v string")
    hot = joins.hot_keys(many, "k", rows_per_split=50, max_hot=20)
    assert dict(hot)[1] == math.ceil(400 / 50) and len(hot) <= 20
    joined = joins.join_many_to_one(many, one, "k", "post_id", how, rows_per_split=50, max_hot=20)
    plain = many.join(one, "k", how)
    rows = lambda df: sorted(df.select("post_id", "k", "v").collect(), key=str)
    assert rows(joined) == rows(plain)


def test_rows_without_a_key_pass_the_join_by(spark):
    many = spark.range(3000).select(
        F.col("id").alias("post_id"), F.when(F.col("id") % 10 == 0, F.col("id")).alias("k"))
    one = many.filter("k IS NOT NULL").select("k", F.lit("v").alias("v"))
    assert joins.hot_keys(many, "k", rows_per_split=50, max_hot=20) == []
    joined = joins.join_many_to_one(many, one, "k", "post_id")
    assert joined.count() == 3000 and joined.filter("v IS NOT NULL").count() == 300
    plan = joined._jdf.queryExecution().optimizedPlan().toString()
    assert "Union" in plan


def test_hot_key_is_spread_over_tasks(spark):
    many = spark.range(4000).select(F.col("id").alias("post_id"), F.lit("same").alias("k"))
    one = spark.createDataFrame([("same", 1)], "k string, v bigint")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        joined = joins.join_many_to_one(many, one, "k", "post_id", rows_per_split=400, max_hot=20)
        sizes = [r[1] for r in joined.groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "10485760")
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert sum(sizes) == 4000 and len(sizes) > 1

import json

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from conftest import SF_DIR, column
from cuespark.operators.embed import embed_methods
from cuespark.operators.label import label_posts
from cuespark.operators.models import FOREST, LASSO, registry
from cuespark.operators.scrub import scrub_posts
from cuespark.plans import corpus, stages
from cuespark.schema import POSTS, require_rows
from cuespark.session import stored, work_folder
from cuespark.sources import tables

from cuespark.streaming import incremental


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_round_trip(spark, tmp_path, fmt):
    rows = [(1, 2, 'a "quoted"\nline, with comma', 1.0), (2, 3, "  padded ", None), (3, None, None, 0.0)]
    df = spark.createDataFrame(rows, POSTS)
    path = f"{tmp_path}/t.{fmt}"
    tables.write_table(df, path)
    got = tables.read_table(spark, path, schema=POSTS)
    assert sorted(got.collect(), key=str) == sorted(df.collect(), key=str)


def test_csv_missing_values(spark, tmp_path):
    path = tmp_path / "t.csv"
    path.write_text('post_id,thread_id,raw_text,female_pred\n1,2,NA,nan\n2,,"x, ""y""\nz",1.0\n3,N/A,None,NULL\n')
    got = tables.read_table(spark, str(path), schema=POSTS).orderBy("post_id").collect()
    assert [tuple(r) for r in got] == [(1, 2, None, None), (2, None, 'x, "y"\nz', 1.0), (3, None, None, None)]
    assert tables.read_table(spark, str(path)).dtypes[0] == ("post_id", "string")
    with pytest.raises(ValueError, match="thread_id"):
        (tmp_path / "u.csv").write_text("post_id\n1\n")
        tables.read_table(spark, str(tmp_path / "u.csv"), schema=POSTS)


def test_missing_files_and_formats(spark, tmp_path):
    for name in ("x.csv", "x.parquet", "x.json"):
        with pytest.raises(FileNotFoundError):
            tables.read_table(spark, f"{tmp_path}/{name}")
    with pytest.raises(ValueError, match="Unsupported"):
        tables.read_table(spark, f"{tmp_path}/x.pickle")
    with pytest.raises(FileNotFoundError):
        tables.read_report(spark, f"{tmp_path}/none.json")
    with pytest.raises(ValueError, match="No valid"):
        require_rows(spark.range(0))


def test_reports(spark, tmp_path):
    report = spark.range(1).select(
        F.lit(5).cast("bigint").alias("count"), F.lit(0.25).alias("ratio"), F.lit(True).alias("ok"),
        F.array(F.lit(1), F.lit(2)).alias("arr"), F.lit(None).cast("double").alias("none"))
    tables.write_report(report, f"{tmp_path}/r.json")
    part = next((tmp_path / "r.json").glob("part-*"))
    assert json.loads(part.read_text()) == {"count": 5, "ratio": 0.25, "ok": True, "arr": [1, 2], "none": None}
    pretty = tmp_path / "p.json"
    pretty.write_text(json.dumps({"count": 5, "nested": {"a": 1.5}}, indent=2))
    row = tables.read_report(spark, str(pretty), pretty=True).first()
    assert row["count"] == 5 and row.nested.a == 1.5


def test_wide_embedding_files(spark, tmp_path):
    (tmp_path / "bert.csv").write_text(
        "id,gender,bert_embed_0,bert_embed_1,bert_embed_10,bert_embed_2\n1,MALE,0.5,1.5,10,2\n2,NA,1,1,1,\n")
    (tmp_path / "other.csv").write_text("id,embed_0\n1,0.25\n")
    (tmp_path / "none.csv").write_text("id,text\n1,x\n")
    df, skipped = tables.import_wide_embeddings(spark, str(tmp_path))
    rows = {(r.method, r.id): r for r in df.collect()}
    assert rows[("bert", "1")].embedding == [0.5, 1.5, 2.0, 10.0]
    assert rows[("bert", "2")].embedding[2] is None and rows[("bert", "2")].gender is None
    assert rows[("other", "1")].embedding == [0.25] and rows[("other", "1")].gender is None
    assert list(skipped) == ["none"]
    tables.write_embeddings(df, f"{tmp_path}/out")
    back = spark.read.parquet(f"{tmp_path}/out").filter("method = 'other'")
    assert back.count() == 1
    assert "PartitionFilters: [isnotnull(method" in back._jdf.queryExecution().executedPlan().toString()
    found = {r.method: r.n for r in tables.method_catalog(spark.read.parquet(f"{tmp_path}/out")).collect()}
    assert found == {"bert": 2, "other": 1}


def test_work_folder_and_stored_tables(spark):
    assert work_folder(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
    df = stored(spark.range(5), "numbers")
    assert df.count() == 5 and "FileScan parquet" in df._jdf.queryExecution().executedPlan().toString()


def test_a_report_keeps_the_tasks_of_what_makes_it(spark, tmp_path):
    slow = spark.range(64, numPartitions=8).select((F.col("id") * 2).alias("x"))
    tables.write_report(slow, f"{tmp_path}/report.json")
    assert tables.read_report(spark, f"{tmp_path}/report.json").count() == 64
    with open(tables.__file__) as source:
        assert "coalesce(1)" not in source.read()


def test_bad_cells_and_files_of_wide_vectors(spark, tmp_path):
    (tmp_path / "good.csv").write_text("vec_id,a_embed_0,a_embed_1\n1,0.5,oops\n2,1.5,2\n")
    (tmp_path / "bad.csv").write_text("vec_id,b_embed_0\n1,none\n")
    (tmp_path / "other.csv").write_text("vec_id,x\n1,2\n")
    found, skipped = tables.import_wide_embeddings(spark, str(tmp_path))
    rows = {r.vec_id: r.embedding for r in found.collect()}
    assert rows == {"1": [0.5, None], "2": [1.5, 2.0]} and set(skipped) == {"bad", "other"}
    assert [tuple(r) for r in tables.lost_cells(found).collect()] == [("good", 1)]


def test_stream_equals_batch_and_adds_nothing_twice(spark, tmp_path):
    posts = corpus.posts(spark, SF_DIR).select("post_id", "raw_text")
    arriving, sink, checkpoint = (f"{tmp_path}/{n}" for n in ("in", "out", "check"))

    def run():
        stream = incremental.label_and_scrub(
            incremental.post_stream(spark, arriving, posts.schema))
        incremental.run_to_parquet(stream, sink, checkpoint).awaitTermination()
        return spark.read.parquet(sink)

    posts.filter("post_id % 2 = 0").write.parquet(arriving)
    half = run().count()
    assert run().count() == half  # nothing new
    posts.filter("post_id % 2 <> 0").write.mode("append").parquet(arriving)
    got = run().select("post_id", "gender", "scrubbed_text")
    from cuespark.operators.filters import drop_blank_text

    want = scrub_posts(label_posts(drop_blank_text(posts))).select("post_id", "gender", "scrubbed_text")
    assert sorted(got.collect()) == sorted(want.collect())


def test_stream_drops_posts_delivered_again(spark, tmp_path):
    rows = spark.createDataFrame(
        [(1, "She left", "2024-01-01 00:00:00"), (1, "She left", "2024-01-01 00:05:00"),
         (2, "He left", "2024-01-01 00:06:00")], "post_id bigint, raw_text string, at string",
    ).withColumn("at", F.col("at").cast("timestamp"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = incremental.label_and_scrub(
        incremental.post_stream(spark, f"{tmp_path}/in", rows.schema), event_time="at")
    incremental.run_to_parquet(stream, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination()
    assert sorted(column(spark.read.parquet(f"{tmp_path}/out"), "gender")) == ["FEMALE", "MALE"]


def test_running_counts(spark, tmp_path):
    posts = corpus.posts(spark, SF_DIR).select("post_id", "raw_text")
    posts.write.parquet(f"{tmp_path}/in")
    stream = incremental.label_and_scrub(incremental.post_stream(spark, f"{tmp_path}/in", posts.schema))
    sink = f"{tmp_path}/counts"
    incremental.run_label_counts(stream, sink, f"{tmp_path}/check").awaitTermination()
    got = {r.gender: r["count"] for r in incremental.latest_counts(spark, sink).collect()}
    want = label_posts(posts.filter("raw_text rlike '[a-z]'")).groupBy("gender").count().collect()
    assert got == {r.gender: r["count"] for r in want}


@pytest.mark.parametrize("folder", [False, True])
def test_stream_of_a_table_of_one_file_or_many(spark, tmp_path, folder):
    """A table is a file or a folder of part files; its neighbours are not read."""
    import shutil

    from cuespark.plans.queries import QUERIES

    for name in ("documents", "labels"):
        source = spark.read.parquet(f"{SF_DIR}/{name}.parquet")
        if folder:
            source.repartition(3).write.parquet(f"{tmp_path}/{name}.parquet")
        else:
            shutil.copy(f"{SF_DIR}/{name}.parquet", tmp_path)
    for name in ("stream_label_scrub", "stream_label_counts", "stream_revised_counts"):
        want = QUERIES[name](spark, SF_DIR).collect()
        assert want and sorted(QUERIES[name](spark, str(tmp_path)).collect()) == sorted(want)


def test_all_stages(spark, tmp_path):
    out = str(tmp_path)
    posts = corpus.posts(spark, SF_DIR)
    labelled = stages.label_stage(posts, f"{out}/label", validation_size=20)
    assert labelled.count() == 200
    agreement = tables.read_report(spark, f"{out}/label/validation.json").first()
    assert agreement.agreement_rate == 1.0 and agreement.sample_size == 20
    scrubbed = stages.scrub_stage(labelled, f"{out}/scrub")
    assert tables.read_report(spark, f"{out}/scrub/analysis.json").first().total_texts == 200
    assert tables.read_table(spark, f"{out}/scrub/scrubbing_examples.csv").count() == 10
    assert tables.read_table(spark, f"{out}/scrub/gender_scrubbing_analysis.csv").count() == 3
    embedded = stages.embed_stage(scrubbed.select("post_id", "gender", "scrubbed_text"), f"{out}/embed")
    assert embedded.count() == 400
    make = lambda d, k: {n: e for n, e in registry(d, k, trees=3, depth=3, max_iter=20).items()
                         if n in (LASSO, FOREST)}
    results = stages.train_stage(embedded, f"{out}/train", binary=True, make_estimators=make, cv_folds=None)
    assert results.count() == 4 and results.filter("error is not null").count() == 0
    one = stages.train_stage(embedded, f"{out}/one", method="lexical_mean", make_estimators=make, cv_folds=2)
    assert one.count() == 2 * 40
    assert tables.read_report(spark, f"{out}/one/random_forest/confusion_matrix.json").count() >= 4
    with pytest.raises(ValueError, match="No valid"):
        stages.label_stage(posts.limit(0), f"{out}/empty")


def test_stage_sample_and_encoder(spark, tmp_path):
    from cuespark.plans.backends import CueBackend, DigestEncoder

    posts = corpus.posts(spark, SF_DIR)
    labelled = stages.label_stage(posts, f"{tmp_path}/l", sample_size=30, make_backend=CueBackend,
                                  validation_size=10, store=f"{tmp_path}/answers")
    assert labelled.count() == 30
    scrubbed = scrub_posts(labelled)
    made = stages.embed_stage(scrubbed, f"{tmp_path}/e", methods={"m": "mean"},
                              encoders={"d": (DigestEncoder, 8)})
    sizes = {r.method: (r.n, r.max_dimension) for r in tables.method_catalog(made).collect()}
    assert sizes == {"m": (30, 16), "d": (30, 8)}


def test_embedding_values_survive_storage(spark, tmp_path, texts):
    made = embed_methods(texts("a b", "c"), "raw_text")
    tables.write_embeddings(made, f"{tmp_path}/e")
    got = {(r.post_id, r.method): r.embedding for r in spark.read.parquet(f"{tmp_path}/e").collect()}
    for r in made.collect():
        np.testing.assert_array_equal(got[(r.post_id, r.method)], r.embedding)


def test_revisions_take_their_old_labels_back(spark, tmp_path):
    drops = [
        [(1, 0, "She is here."), (2, 0, "He left."), (3, 0, "Rain."), (4, 0, None), (5, 0, " "), (1, 0, "She is here.")],
        [(1, 1, "He is here."), (2, 2, None), (3, 1, "Rain again."), (6, 0, "His hat."), (6, 1, "Her hat.")],
        [(2, 1, "She left."), (1, 0, "She is here."), (4, 1, "He came."), (3, None, "She?"), (7, 0, "")],
    ]
    wanted = [
        {"FEMALE": 1, "MALE": 1, "NEUTRAL": 1},
        {"FEMALE": 1, "MALE": 1, "NEUTRAL": 1},  # late and repeated revisions change nothing
        {"FEMALE": 1, "MALE": 2, "NEUTRAL": 1},
    ]
    schema = "post_id long, revision int, raw_text string"
    for drop, want in zip(drops, wanted):
        spark.createDataFrame(drop, schema).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
        posts = incremental.post_stream(spark, f"{tmp_path}/in", T._parse_datatype_string(schema))
        incremental.run_label_changes(
            incremental.label_changes(posts), f"{tmp_path}/out", f"{tmp_path}/check"
        ).awaitTermination()
        got = {r["gender"]: r["count"] for r in incremental.current_counts(spark, f"{tmp_path}/out").collect()}
        assert got == want

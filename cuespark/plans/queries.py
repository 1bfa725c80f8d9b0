"""One registered query per operator: (spark, sf_dir) -> DataFrame over the whole tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.functions import text as tx
from cuespark.functions.hashing import row_key
from cuespark.functions.responses import parse_label, parse_scrub
from cuespark.functions.vectors import pack, unpack
from cuespark.operators import (
    audit, boosting, embed, evaluate, filters, inference, joins, label, models,
)
from cuespark.operators import prepare as prep
from cuespark.operators import sampling, scrub, similarity
from cuespark.plans import corpus, stages
from cuespark.plans.backends import BracketBackend, CueBackend, DigestEncoder, FailingEncoder
from cuespark.session import stored, work_folder
from cuespark.sources import tables
from cuespark.streaming import incremental

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(function: Query) -> Query:
    QUERIES[function.__name__.rstrip("_")] = function
    return function


def _r6(column: Column | str) -> Column:
    """Rounded to 6 places, without a negative zero."""
    return F.round(F.col(column) if isinstance(column, str) else column, 6) + F.lit(0.0)


def _rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: _r6(n) for n in names})


def _rounded_stats(df: DataFrame) -> DataFrame:
    return _rounded(df, *[c for c in df.columns if "avg" in c or "std" in c])


def _components(df: DataFrame, n: int, column: str = "embedding") -> DataFrame:
    """Vector components as rounded columns c0, c1, ..."""
    rest = [c for c in df.columns if c != column]
    parts = [_r6(F.col(column)[i].cast("double")).alias(f"c{i}") for i in range(n)]
    return df.select(*rest, *parts)


def _labelled(spark, sf_dir) -> DataFrame:
    return label.label_posts(filters.drop_blank_text(corpus.posts(spark, sf_dir)))


def _scrubbed(spark, sf_dir) -> DataFrame:
    return scrub.scrub_posts(filters.drop_missing_text(corpus.posts(spark, sf_dir)))


# Filters and projections.


@query
def posts_filtered(spark, sf_dir):
    kept = filters.drop_blank_text(corpus.posts(spark, sf_dir))
    return kept.select("post_id", "thread_id", "raw_text")


@query
def filter_gender(spark, sf_dir):
    return filters.keep_gender(_labelled(spark, sf_dir), "FEMALE").select("post_id", "gender")


@query
def binary_only(spark, sf_dir):
    # Withdrawn posts have no label here, which is not the label NEUTRAL.
    shown = corpus.posts(spark, sf_dir).select(
        "post_id", F.when(F.col("post_id") >= 0, F.col("gold")).alias("gender")
    )
    return filters.binary_only(shown)


@query
def decode_label(spark, sf_dir):
    decoded = filters.decode_label(corpus.posts(spark, sf_dir))
    return decoded.select("post_id", "female_pred", "gender")


@query
def unpack_embedding(spark, sf_dir):
    wide = unpack(corpus.vectors(spark, sf_dir), "full", 64)
    return wide.select(
        "vec_id", *[_r6(F.col(f"full_embed_{i}").cast("double")).alias(f"full_embed_{i}")
                    for i in range(64)]
    )


@query
def pack_embedding(spark, sf_dir):
    # 64 wide columns become one array again; its elements come out in the right order.
    packed = pack(unpack(corpus.vectors(spark, sf_dir), "full", 64))
    return packed.select(
        "vec_id",
        F.size("embedding").cast("bigint").alias("dimension"),
        *[_r6(F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(64)],
    )


# Labels.


@query
def label_requests(spark, sf_dir):
    filled = F.when(F.col("raw_text") != "", label.label_prompt(F.col("raw_text")))
    asked = corpus.posts(spark, sf_dir).select("post_id", filled.alias("prompt"))
    return asked.select(
        "post_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("h")
    )


@query
def parse_label_response(spark, sf_dir):
    answers = corpus.with_label_answers(corpus.posts(spark, sf_dir).select("post_id"))
    parsed = answers.select("post_id", parse_label(F.col("raw")).alias("p"))
    return parsed.select(
        "post_id", "p.gender", "p.reasoning",
        F.col("p.parse_error").isNotNull().cast("int").alias("wrong_shape"),
    )


@query
def label_policy(spark, sf_dir):
    answers = corpus.with_label_answers(corpus.posts(spark, sf_dir))
    judged = label.apply_label_policy(answers)
    reason = F.when(F.col("reasoning").startswith("Error: "), "Error").otherwise(F.col("reasoning"))
    return judged.select("post_id", "gender", reason.alias("reasoning"), "confidence")


@query
def label_posts(spark, sf_dir):
    labelled = _labelled(spark, sf_dir)
    return labelled.select("post_id", "gender", "reasoning", "confidence", "text")


@query
def label_posts_backend(spark, sf_dir):
    """The batch-inference path: distinct prompts, backend in the tasks, answers joined back."""
    labelled = inference.label_with_backend(
        filters.drop_blank_text(corpus.posts(spark, sf_dir)), CueBackend
    )
    return labelled.select("post_id", "gender", "reasoning", "confidence")


@query
def label_cues(spark, sf_dir):
    found = filters.drop_blank_text(corpus.posts(spark, sf_dir)).select(
        "post_id", label.cues(F.col("raw_text")).alias("c")
    )
    return found.select(
        "post_id", F.size("c").cast("bigint").alias("n_cues"), F.array_join("c", " ").alias("cues")
    )


@query
def cue_hits(spark, sf_dir):
    return label.cue_hits(filters.drop_blank_text(corpus.posts(spark, sf_dir)))


@query
def label_counts(spark, sf_dir):
    return _rounded(label.label_counts(_labelled(spark, sf_dir)), "share")


@query
def label_agreement(spark, sf_dir):
    sample = sampling.sample_rows(_labelled(spark, sf_dir).select("post_id", "gender"), 500)
    again = corpus.posts(spark, sf_dir).select("post_id", F.col("gold").alias("gender"))
    return _rounded(label.label_agreement(sample, again), "agreement_rate")


@query
def inference_resume(spark, sf_dir):
    # Documents with a quality label count as answered already.
    kept = filters.drop_blank_text(corpus.posts(spark, sf_dir))
    done = corpus.table(spark, sf_dir, "labels").select(F.col("doc_id").alias("post_id"))
    key_of = inference.request_hash(label.label_prompt, "raw_text")
    answers = kept.join(done, "post_id").select(key_of.alias("request_hash"))
    return inference.pending(kept, label.label_prompt, answers).select("request_hash")


# Scrubbing.


@query
def scrub_requests(spark, sf_dir):
    filled = F.when(F.col("raw_text") != "", scrub.scrub_prompt(F.col("raw_text")))
    asked = corpus.posts(spark, sf_dir).select("post_id", filled.alias("prompt"))
    return asked.select(
        "post_id", F.length("prompt").cast("bigint").alias("n_chars"), F.md5("prompt").alias("h")
    )


@query
def parse_scrub_response(spark, sf_dir):
    answers = corpus.with_scrub_answers(
        corpus.posts(spark, sf_dir).select("post_id", "raw_text")
    )
    return answers.select("post_id", parse_scrub(F.col("raw")).alias("scrubbed_text"))


@query
def scrub_policy(spark, sf_dir):
    answers = corpus.with_scrub_answers(
        corpus.posts(spark, sf_dir).select("post_id", "raw_text")
    )
    return scrub.apply_scrub_policy(answers).select("post_id", "scrubbed_text", "scrub_status")


def _one_step(spark, sf_dir, step) -> DataFrame:
    kept = filters.drop_missing_text(corpus.posts(spark, sf_dir))
    return kept.select("post_id", step(F.col("raw_text")).alias("scrubbed_text"))


@query
def scrub_pronouns(spark, sf_dir):
    return _one_step(spark, sf_dir, scrub.scrub_pronouns)


@query
def scrub_kinship(spark, sf_dir):
    return _one_step(spark, sf_dir, scrub.scrub_kinship)


@query
def scrub_names(spark, sf_dir):
    return _one_step(spark, sf_dir, scrub.scrub_names)


@query
def scrub_names_long(spark, sf_dir):
    """Over a thousand names, with some of two words, a hyphen or an apostrophe in the texts."""
    made_up = [f"Name{i}" for i in range(1200)]
    names = ["Mary Ann", "Mary", "O'Brien", "Jean-Luc", "John", "Sarah", *made_up]
    return _one_step(spark, sf_dir, lambda t: scrub.scrub_names(t, names))


@query
def scrub_names_table(spark, sf_dir):
    """Names from a table that grows with the documents: the first word of each, if it is a capital
    and small letters.
    """
    first = F.regexp_extract("text", "^[A-Z][a-z]+", 0)
    names = corpus.table(spark, sf_dir, "documents").select(first.alias("name"))
    shown = corpus.posts(spark, sf_dir).select("post_id", "raw_text")
    return scrub.scrub_names_by_table(shown, names).drop("raw_text")


@query
def scrub_titles(spark, sf_dir):
    return _one_step(spark, sf_dir, scrub.scrub_titles)


@query
def scrub_posts(spark, sf_dir):
    return _scrubbed(spark, sf_dir).select("post_id", "raw_text", "scrubbed_text")


@query
def scrub_posts_backend(spark, sf_dir):
    done = inference.scrub_with_backend(
        filters.drop_missing_text(corpus.posts(spark, sf_dir)), BracketBackend
    )
    return done.select("post_id", "scrubbed_text", "scrub_status")


@query
def scrub_length_delta(spark, sf_dir):
    return _rounded(audit.length_delta(_scrubbed(spark, sf_dir)), "avg_length_reduction")


@query
def scrub_impact(spark, sf_dir):
    everything = scrub.scrub_posts(corpus.posts(spark, sf_dir))
    return _rounded(
        audit.scrub_impact(everything),
        "avg_original_length", "avg_scrubbed_length", "avg_word_reduction",
    )


@query
def replacement_counts(spark, sf_dir):
    counted = audit.with_replacements(_scrubbed(spark, sf_dir))
    return counted.select("post_id", "num_replacements")


@query
def top_replacements(spark, sf_dir):
    kept = filters.drop_missing_text(corpus.posts(spark, sf_dir))
    winners = audit.most_rewritten(scrub.scrub_posts(kept))
    # Ten posts: fetched and scrubbed again for display.
    shown = scrub.scrub_posts(kept.join(F.broadcast(winners), "post_id"))
    return shown.select("post_id", "raw_text", "scrubbed_text", "num_replacements")


@query
def gender_scrub_report(spark, sf_dir):
    return audit.gender_report(scrub.scrub_posts(_labelled(spark, sf_dir)))


def _issue_rows(issues: DataFrame) -> DataFrame:
    return issues.withColumn("missed_cues", F.array_join("missed_cues", " "))


@query
def scrub_issues(spark, sf_dir):
    """The audit of a sample of 100 posts."""
    return _issue_rows(audit.scrub_issues(_scrubbed(spark, sf_dir)))


@query
def first_issues(spark, sf_dir):
    """The first five issues, as the report shows them."""
    issues = _issue_rows(audit.scrub_issues(_scrubbed(spark, sf_dir)))
    return filters.head(issues, 5, "post_id", "pattern")


@query
def scrub_issues_all(spark, sf_dir):
    """The same audit over the whole corpus, here of the texts before scrubbing."""
    return _issue_rows(
        audit.scrub_issues(
            filters.drop_missing_text(corpus.posts(spark, sf_dir)),
            scrubbed="raw_text", sample_size=None,
        )
    )


@query
def scrub_issue_rate(spark, sf_dir):
    summary = _rounded(audit.issue_rate(_scrubbed(spark, sf_dir)), "issue_rate")
    return summary.withColumn("examples", F.array_join("examples", " "))


@query
def scrub_modification(spark, sf_dir):
    summary = audit.modification_summary(_scrubbed(spark, sf_dir))
    rounded = _rounded(summary, "modification_rate", "avg_words_replaced")
    return rounded.withColumn("examples", F.array_join("examples", " "))


# Samples and splits.


@query
def sample_posts(spark, sf_dir):
    kept = filters.drop_blank_text(corpus.posts(spark, sf_dir)).select("post_id", "raw_text")
    return sampling.sample_rows(kept, 500)


@query
def sample_fraction(spark, sf_dir):
    kept = filters.drop_blank_text(corpus.posts(spark, sf_dir)).select("post_id")
    return sampling.sample_fraction(kept, 0.01)


@query
def stratified_split(spark, sf_dir):
    shown = corpus.vectors(spark, sf_dir).select("vec_id", "gender")
    return sampling.stratified_split(shown)


@query
def nested_split(spark, sf_dir):
    """A validation part of the training side, under another seed."""
    shown = sampling.stratified_split(corpus.vectors(spark, sf_dir).select("vec_id", "gender"))
    train = shown.filter(F.col("split") == "train").drop("split")
    return sampling.stratified_split(train, seed="42-validation")


@query
def stratified_kfold(spark, sf_dir):
    shown = corpus.vectors(spark, sf_dir).select("vec_id", "gender")
    folded = sampling.stratified_folds(shown)
    return folded.withColumn("fold", F.col("fold").cast("bigint"))


@query
def stratified_split_posts(spark, sf_dir):
    """The same split over the rule labels of all posts."""
    labels = stored(_labelled(spark, sf_dir).select("post_id", "gender"), "labels")
    return sampling.stratified_split(labels, key="post_id")


# Joins.


@query
def attach_embeddings(spark, sf_dir):
    kept = filters.drop_missing_text(corpus.posts(spark, sf_dir)).select("post_id", "gold")
    vecs = corpus.vectors(spark, sf_dir).select(F.col("vec_id").alias("post_id"), "embedding")
    both = embed.attach_embeddings(kept, vecs)
    return both.select("post_id", "gold", *[
        _r6(F.col("embedding")[i].cast("double")).alias(f"e{i}") for i in range(64)
    ])


@query
def thread_sizes(spark, sf_dir):
    """Posts joined to a table with one row per thread; busy threads are spread over tasks."""
    everything = corpus.posts(spark, sf_dir).select("post_id", "thread_id")
    sizes = everything.groupBy("thread_id").agg(F.count(F.lit(1)).alias("n_posts"))
    return joins.join_many_to_one(
        everything, sizes, "thread_id", spread_by="post_id", rows_per_split=12, max_hot=200
    )


# Embeddings.


@query
def clean_for_embedding(spark, sf_dir):
    return corpus.posts(spark, sf_dir).select(
        "post_id", tx.clean_for_encoder(F.col("raw_text")).alias("cleaned")
    )


@query
def embedding_cost(spark, sf_dir):
    cost = embed.embedding_cost(_scrubbed(spark, sf_dir))
    return cost.withColumn("estimated_cost_usd", F.round("estimated_cost_usd", 9))


@query
def pool_first(spark, sf_dir):
    made = embed.embed_table(_scrubbed(spark, sf_dir).select("post_id", "scrubbed_text"),
                             strategy="cls")
    return _components(made, 16).drop("scrubbed_text", "method")


@query
def pool_mean(spark, sf_dir):
    made = embed.embed_table(_scrubbed(spark, sf_dir).select("post_id", "scrubbed_text"))
    return _components(made, 16).drop("scrubbed_text", "method")


@query
def embed_table(spark, sf_dir):
    everything = corpus.posts(spark, sf_dir).select("post_id", "raw_text")
    made = embed.embed_table(everything, "raw_text", method="raw_mean", dim=20)
    return _components(made, 20).drop("raw_text")


@query
def embed_methods(spark, sf_dir):
    made = embed.embed_methods(_scrubbed(spark, sf_dir).select("post_id", "scrubbed_text"), dim=20)
    return _components(made, 20).drop("scrubbed_text")


@query
def embed_external(spark, sf_dir):
    made = embed.embed_external(
        corpus.posts(spark, sf_dir).select("post_id", "raw_text"),
        DigestEncoder, DigestEncoder.dim, "digest", text="raw_text",
    )
    return _components(made, 8).drop("raw_text", "embed_error")


@query
def embed_store(spark, sf_dir):
    """A first run whose calls fail for texts of even length, a second one that asks them again."""
    posts = corpus.posts(spark, sf_dir).select("post_id", "raw_text")
    store, dim = work_folder(spark, "vectors"), DigestEncoder.dim
    first = embed.embed_external(
        posts, FailingEncoder, dim, "digest", text="raw_text", store=store
    )
    failed = stored(first.filter("embed_error IS NOT NULL").select("post_id"), "failed")
    again = embed.embed_external(
        posts, DigestEncoder, dim, "digest", text="raw_text", store=store, retry_errors=True
    )
    both = again.join(failed.withColumn("first_run", F.lit("failed")), "post_id", "left")
    return _components(both, 8).drop("raw_text")


@query
def embed_learned(spark, sf_dir):
    kept = _scrubbed(spark, sf_dir).select("post_id", "scrubbed_text")
    model = embed.fit_learned(kept, dim=16)
    return embed.embed_learned(kept, model).drop("scrubbed_text")


@query
def norm_stats(spark, sf_dir):
    stats = similarity.norm_stats(corpus.methods(corpus.vectors(spark, sf_dir)), "method")
    return _rounded(stats, "avg_norm", "std_norm")


@query
def strategy_compare(spark, sf_dir):
    stats = similarity.compare_strategies(
        corpus.posts(spark, sf_dir), "raw_text", sample_size=None
    )
    return _rounded_stats(stats)


@query
def strategy_compare_sample(spark, sf_dir):
    """The same report from a seeded sample of 100 texts."""
    return _rounded_stats(similarity.compare_strategies(corpus.posts(spark, sf_dir), "raw_text"))


@query
def pairwise_similarity(spark, sf_dir):
    pairs = similarity.pairwise_similarity(corpus.vectors(spark, sf_dir))
    return _rounded(pairs, "similarity")


@query
def mean_similarity_all(spark, sf_dir):
    shown = corpus.methods(corpus.vectors(spark, sf_dir))
    return _rounded(similarity.mean_similarity(shown, "method"), "mean_similarity")


@query
def similarity_spread(spark, sf_dir):
    found = similarity.similarity_spread(corpus.methods(corpus.vectors(spark, sf_dir)), "method")
    return _rounded(found, "mean_similarity", "std_similarity")


@query
def embedding_report(spark, sf_dir):
    return _rounded_stats(similarity.embedding_report(corpus.vectors(spark, sf_dir)))


@query
def method_catalog(spark, sf_dir):
    shown = corpus.methods(corpus.vectors(spark, sf_dir))
    path = work_folder(spark, "embeddings")
    tables.write_embeddings(shown, path)
    return tables.method_catalog(spark.read.parquet(path))


# Files.


def _file_trip(spark, sf_dir, suffix: str) -> DataFrame:
    shown = corpus.posts(spark, sf_dir).select("post_id", "raw_text", "female_pred")
    path = work_folder(spark, "files") + suffix
    tables.write_table(shown, path)
    return tables.read_table(spark, path, schema=shown.schema)


@query
def csv_round_trip(spark, sf_dir):
    return _file_trip(spark, sf_dir, ".csv")


@query
def json_round_trip(spark, sf_dir):
    return _file_trip(spark, sf_dir, ".json")


@query
def report_round_trip(spark, sf_dir):
    counts = label_counts(spark, sf_dir)
    path = work_folder(spark, "reports") + ".json"
    tables.write_report(counts, path)
    return tables.read_report(spark, path, counts.schema)


@query
def import_wide(spark, sf_dir):
    """Wide vectors from CSV files; one cell is no number, and a second file has none at all."""
    folder = work_folder(spark, "wide")
    wide = unpack(corpus.vectors(spark, sf_dir), "full", 64)
    bad = F.when(F.col("vec_id") == 3, F.lit("oops")).otherwise(
        F.col("full_embed_5").cast("string")
    )
    # a folder of many files is one method; cells hold no line feeds, so files can be cut
    tables.write_table(wide.withColumn("full_embed_5", bad).repartition("vec_id"), f"{folder}/good.csv")
    words = wide.select("vec_id", F.lit("none").alias("bad_embed_0"))
    tables.write_table(words, f"{folder}/bad.csv")
    found, skipped = tables.import_wide_embeddings(spark, folder, multiline=False)
    lost = F.size(F.filter("embedding", lambda x: x.isNull())).cast("bigint")
    shown = _components(found.withColumn("lost_cells", lost), 64)
    return shown.select(
        F.col("vec_id").cast("bigint").alias("vec_id"), *[f"c{i}" for i in range(64)], "lost_cells",
        F.lit(len(skipped)).cast("bigint").alias("n_skipped"),
    )


# Features and metrics.


@query
def nan_audit(spark, sf_dir):
    found = prep.nan_audit(corpus.vectors_with_gaps(spark, sf_dir))
    return found.withColumn("any_gap", F.col("any_gap").cast("int"))


@query
def feature_moments(spark, sf_dir):
    shown = corpus.methods(corpus.vectors(spark, sf_dir))
    moments = prep.feature_moments(shown, "method")
    return _rounded(moments, "mean", "std").withColumn("dim", F.col("dim").cast("bigint"))


@query
def prepare_features(spark, sf_dir):
    from pyspark.ml.functions import vector_to_array

    rows, _ = prep.split_and_scale(corpus.vectors_with_gaps(spark, sf_dir))
    long = rows.select(
        "vec_id", "split", "label", F.posexplode(vector_to_array("features")).alias("dim", "value")
    )
    return _rounded(long, "value").withColumn("dim", F.col("dim").cast("bigint"))


@query
def class_distribution(spark, sf_dir):
    shown = corpus.vectors(spark, sf_dir).select("vec_id", "gender")
    return evaluate.class_distribution(sampling.stratified_split(shown))


def _judged(spark, sf_dir) -> DataFrame:
    """Rule labels as predictions of the intended subject."""
    return _labelled(spark, sf_dir).select(
        "post_id", F.col("gold").alias("label"), F.col("gender").alias("prediction")
    )


@query
def accuracy(spark, sf_dir):
    return _rounded(evaluate.accuracy(_judged(spark, sf_dir)), "accuracy")


@query
def confusion_matrix(spark, sf_dir):
    return evaluate.confusion_matrix(_judged(spark, sf_dir))


@query
def classification_report(spark, sf_dir):
    report = evaluate.classification_report(_judged(spark, sf_dir))
    return _rounded(report, "precision", "recall", "f1_score")


def _predictions(spark, sf_dir) -> DataFrame:
    return corpus.predictions(corpus.methods(corpus.vectors(spark, sf_dir)))


def _model_results(spark, sf_dir) -> DataFrame:
    return evaluate.accuracy(_predictions(spark, sf_dir), ["method", "model", "ord"])


@query
def evaluate_(spark, sf_dir):
    return _rounded(_model_results(spark, sf_dir), "accuracy").drop("ord")


@query
def cv_summary(spark, sf_dir):
    folds = sampling.stratified_folds(corpus.vectors(spark, sf_dir))
    judged = corpus.predictions(corpus.methods(folds), "fold")
    return _rounded(
        evaluate.cv_summary(judged, ["method", "model"]), "cv_accuracy_mean", "cv_accuracy_std"
    )


def _best(spark, sf_dir) -> DataFrame:
    return evaluate.best_model(_model_results(spark, sf_dir))


@query
def best_model(spark, sf_dir):
    return _rounded(_best(spark, sf_dir), "best_accuracy").select(
        "method", "best_model", "best_accuracy",
        F.size("model_results").cast("bigint").alias("n_models"),
    )


@query
def method_ranking(spark, sf_dir):
    ranked = evaluate.method_ranking(_best(spark, sf_dir))
    return _rounded(ranked, "best_accuracy").select("method", "best_model", "best_accuracy")


# Training.  Fitted numbers have no SQL; what must hold for any fit has: the test rows with
# their labels, the sizes, the share of the largest class, and `sound`, which says that the fitted
# results agree with each other and that the model knows more of the rows it has seen than their
# labels' shares.


def _settings(dim: int, n_classes: int):
    """The study's settings."""
    return models.registry(dim, n_classes, mlp_batch=32)


def _binary_vectors(spark, sf_dir) -> DataFrame:
    return filters.binary_only(corpus.vectors(spark, sf_dir))


def _sound(predicted: DataFrame) -> DataFrame:
    """Predictions are classes, and the most probable ones where there are probabilities."""
    p = F.col("probability")
    chosen = p[F.col("prediction").cast("int")]
    fits = (F.abs(F.aggregate(p, F.lit(0.0), lambda s, x: s + x) - 1) < 1e-6) & (
        chosen >= F.array_max(p) - 1e-9
    )
    whole = F.col("prediction") == F.floor("prediction")
    sound = whole & (F.col("prediction") < F.size(p)) & F.coalesce(fits, F.lit(True))
    return predicted.select("vec_id", "label", "model", sound.alias("sound"))


def _learned(seen: DataFrame, shares: list[float]) -> DataFrame:
    """(model, learned): predictions of training rows tell more than their labels' shares do.

    A model may beat the largest share, or the log loss of all shares.  Labels that have nothing to do
    with the features leave a regression no other prediction than the largest class, however many rows
    there are, but any L1 regression that has a weight has the smaller loss.
    """
    own = F.col("probability")[F.col("label").cast("int")]
    told = seen.groupBy("model").agg(
        F.avg((F.col("prediction") == F.col("label")).cast("double")).alias("accuracy"),
        F.avg(-F.log(F.greatest(own, F.lit(1e-15)))).alias("loss"),
    )
    entropy = -sum(p * math.log(p) for p in shares)
    less = F.coalesce(F.col("loss") < entropy - 1e-9, F.lit(False))  # more than rounding
    return told.select("model", ((F.col("accuracy") > max(shares)) | less).alias("learned"))


def _train(spark, sf_dir, *names: str, settings=_settings, rows=_binary_vectors) -> DataFrame:
    data = prep.prepare(rows(spark, sf_dir))
    made = settings(data.dim, len(data.classes))
    fitted, results = models.train_models(data, {n: made[n] for n in names or made}, cv_folds=None)
    failed = {n: r["error"] for n, r in results.items() if "error" in r}
    if failed:
        raise RuntimeError(f"models failed: {failed}")
    shares = [r["count"] / data.n_train for r in data.train.groupBy("label").count().collect()]
    majority = max(shares)
    learned = _learned(models.predict(fitted, data.train), shares)
    predicted = stored(
        _sound(models.predict(fitted, data.test)).join(F.broadcast(learned), "model").select(
            "vec_id", "label", "model", _r6(F.lit(majority)).alias("majority"),
            (F.col("sound") & F.col("learned")).alias("sound"),
        ),
        "predictions",
    )
    data.unpersist()
    return predicted


@query
def train_lasso(spark, sf_dir):
    return _train(spark, sf_dir, models.LASSO)


@query
def train_forest(spark, sf_dir):
    return _train(spark, sf_dir, models.FOREST)


@query
def train_mlp(spark, sf_dir):
    return _train(spark, sf_dir, models.MLP)


@query
def train_boosted(spark, sf_dir):
    return _train(spark, sf_dir, models.BOOSTED_DEEP)


@query
def train_boosted_slow(spark, sf_dir):
    return _train(spark, sf_dir, models.BOOSTED_SLOW)


@query
def train_boosted_three(spark, sf_dir):
    """A softmax over all three labels, best leaf first."""
    return _train(spark, sf_dir, models.BOOSTED_SLOW, rows=corpus.vectors)


@query
def boosted_first_splits(spark, sf_dir):
    """What the first pass of boosting finds in every dimension: the best split of all rows."""
    rows = _binary_vectors(spark, sf_dir).select(
        array_to_vector(F.transform("embedding", lambda x: x.cast("double"))).alias("features"),
        F.when(F.col("gender") == "MALE", 1.0).otherwise(0.0).alias("label"),
    )
    found = boosting.first_splits(stored(rows, "first-splits-rows"), boosting.Settings())
    return _rounded(found, "threshold", "gain")


@query
def train_all(spark, sf_dir):
    return _train(spark, sf_dir)


def _results(rows: DataFrame) -> DataFrame:
    """Result rows with their sizes; sound if every score that is there is a share."""

    def share(c: str):
        return F.coalesce(F.col(c).between(0.0, 1.0), F.lit(True))

    validated = F.col("cv_accuracy_mean").isNotNull()
    return rows.select(
        "method", "model", "training_samples", "test_samples", "dimension",
        validated.alias("validated"),
        (share("accuracy") & share("cv_accuracy_mean") & F.col("error").isNull()).alias("sound"),
    )


@query
def train_cross_validated(spark, sf_dir):
    rows, _, _ = models.run_method(_binary_vectors(spark, sf_dir), "full64", _settings, cv_folds=5)
    return _results(spark.createDataFrame(rows, models.RESULTS))


@query
def compare_embeddings(spark, sf_dir):
    shown = filters.binary_only(corpus.vectors(spark, sf_dir))
    results = models.compare_methods(corpus.methods(shown), _settings, cv_folds=5)
    best = models.comparison(results)
    top = F.array_max(F.map_values("model_results"))
    return best.select(
        "method", F.col("embedding_dimension").cast("bigint").alias("dimension"),
        F.size("model_results").cast("bigint").alias("n_models"),
        (F.col("error").isNull() & (F.col("best_accuracy") == top)).alias("sound"),
    )


def _few(dim: int, n_classes: int):
    return models.registry(dim, n_classes, trees=20, models=[models.LASSO, models.FOREST])


@query
def models_reloaded(spark, sf_dir):
    """Models that were saved and loaded predict what they predicted before."""
    data = prep.prepare(_binary_vectors(spark, sf_dir))
    fitted, results = models.train_models(data, _few(data.dim, 2), cv_folds=None)
    folder = work_folder(spark, "saved-models")
    models.save_models(spark, folder, fitted, data.preprocessing, results)
    loaded, _, _ = models.load_models(spark, folder)
    both = [
        models.predict(m, data.test).select("vec_id", "model", F.col("prediction").alias(c))
        for m, c in ((fitted, "before"), (loaded, "after"))
    ]
    same = stored(
        both[0].join(both[1], ["vec_id", "model"]).select(
            "vec_id", "model", (F.col("before") == F.col("after")).alias("same")
        ),
        "reloaded",
    )
    data.unpersist()
    return same


@query
def train_single(spark, sf_dir):
    """The run over one method with its reports; of each report the lines and their supports."""
    out = work_folder(spark, "single")
    rows = corpus.methods(corpus.vectors(spark, sf_dir))
    stages.train_stage(
        rows, out, method="half32", key="vec_id", binary=True, make_estimators=_few, cv_folds=None
    )
    reports = [
        tables.read_report(spark, f"{out}/{name.lower().replace(' ', '_')}/classification_report.json")
        .select(F.lit(name).alias("model"), F.col("class"), F.col("support").cast("long").alias("support"))
        for name in (models.LASSO, models.FOREST)
    ]
    return reports[0].unionByName(reports[1])


@query
def row_keys(spark, sf_dir):
    """Rows without a key of their own get one; equal rows share it."""
    shown = corpus.posts(spark, sf_dir).select("raw_text", "gold")
    keyed = shown.select(row_key("raw_text", "gold").alias("k"), "raw_text", "gold")
    return keyed.agg(
        F.count("*").alias("n_rows"), F.count_distinct("k").alias("n_keys"),
        F.count_if(F.col("k").isNull()).alias("without"),
    )


@query
def grid_search(spark, sf_dir):
    data = prep.prepare(_binary_vectors(spark, sf_dir))
    found = models.tune(data, models.LASSO, _settings(data.dim, len(data.classes)), cv_folds=3)
    data.unpersist()
    rows = [(r["params"]["C"], 0 <= r["mean"] <= found["best_score"]) for r in found["cv_results"]]
    return spark.createDataFrame(rows, "c double, sound boolean")


@query
def grid_search_forest(spark, sf_dir):
    """All 36 points of the forest's grid, three folds each."""
    data = prep.prepare(_binary_vectors(spark, sf_dir))
    made = {models.FOREST: models.registry(data.dim, 2)[models.FOREST]}
    found = models.tune(data, models.FOREST, made, cv_folds=3)
    data.unpersist()
    rows = [
        (r["params"]["numTrees"], r["params"]["maxDepth"], r["params"]["minInstancesPerNode"],
         0 <= r["mean"] <= found["best_score"])
        for r in found["cv_results"]
    ]
    return spark.createDataFrame(rows, "trees int, depth int, leaf_rows int, sound boolean")


# Streams.


def _document_stream(spark, sf_dir) -> DataFrame:
    schema = corpus.table(spark, sf_dir, "documents").schema
    arriving = incremental.post_stream(spark, sf_dir, schema, "documents.parquet")
    return incremental.label_and_scrub(corpus.posts_of_documents(arriving))


@query
def stream_label_scrub(spark, sf_dir):
    sink = work_folder(spark, "stream-sink")
    stream = _document_stream(spark, sf_dir).select("post_id", "gender", "scrubbed_text")
    incremental.run_to_parquet(
        stream, sink, work_folder(spark, "stream-checkpoint")
    ).awaitTermination()
    return spark.read.parquet(sink)


@query
def stream_label_counts(spark, sf_dir):
    sink = work_folder(spark, "stream-counts")
    incremental.run_label_counts(
        _document_stream(spark, sf_dir), sink, work_folder(spark, "stream-checkpoint")
    ).awaitTermination()
    return incremental.latest_counts(spark, sink).select("gender", F.col("count").alias("n"))


@query
def stream_revised_counts(spark, sf_dir):
    """Labels of all posts after the revisions that `labels` brings: a toxic one withdraws its post,
    another gives it the sentence of the next document.
    """
    documents = corpus.table(spark, sf_dir, "documents").schema
    labels = corpus.table(spark, sf_dir, "labels").schema
    first = corpus.posts_of_documents(
        incremental.post_stream(spark, sf_dir, documents, "documents.parquet")
    ).select("post_id", F.lit(0).alias("revision"), "raw_text")
    later = incremental.post_stream(spark, sf_dir, labels, "labels.parquet")
    next_text = corpus.sentence_of(F.col("doc_id") + 1)
    revised = later.select(
        F.col("doc_id").alias("post_id"), F.lit(1).alias("revision"),
        F.when(F.col("toxic") == 0, next_text).alias("raw_text"),
    )
    sink = work_folder(spark, "stream-revisions")
    incremental.run_label_changes(
        incremental.label_changes(first.unionByName(revised)), sink,
        work_folder(spark, "stream-checkpoint"),
    ).awaitTermination()
    return incremental.current_counts(spark, sink).select("gender", F.col("count").alias("n"))

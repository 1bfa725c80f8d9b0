"""The four stages, each from a table to tables.

A stage stores its main result first and makes its reports from the stored Parquet, so no text
is processed twice and a lost executor costs a task, not the stage.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.ml import Estimator
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.operators import audit, filters, models
from cuespark.operators.embed import embed_external, embed_methods
from cuespark.operators.evaluate import classification_report, confusion_matrix
from cuespark.operators.inference import label_with_backend, scrub_with_backend
from cuespark.operators.label import label_agreement, label_counts, label_posts
from cuespark.operators.sampling import sample_rows
from cuespark.operators.scrub import scrub_posts
from cuespark.schema import require_columns, require_rows
from cuespark.sources.tables import write_embeddings, write_report, write_table


def label_stage(
    df: DataFrame,
    out: str,
    text: str = "raw_text",
    key: str = "post_id",
    sample_size: int | None = None,
    make_backend: Callable | None = None,
    validation_size: int | None = None,
    seed: int = 42,
    **backend_options,
) -> DataFrame:
    """Filter, label, store; writes labels, label counts and, if asked, an agreement report.

    Without a backend the rule labeller is used.
    """
    require_columns(df, text, key)
    posts = filters.drop_blank_text(df, text)
    if sample_size:
        posts = sample_rows(posts, sample_size, key, seed)
    require_rows(posts, "texts")

    def labelled(rows: DataFrame) -> DataFrame:
        if make_backend is None:
            return label_posts(rows, text)
        return label_with_backend(rows, make_backend, key, text, **backend_options)

    spark = df.sparkSession
    write_table(labelled(posts), f"{out}/labeled.parquet")
    stored = spark.read.parquet(f"{out}/labeled.parquet")
    write_report(label_counts(stored), f"{out}/label_counts.json")
    if validation_size:
        checked = sample_rows(stored, validation_size, key, seed)
        # The answers of the first run must not be reused here, so no store is passed.
        again = (
            label_posts(checked.select(key, text), text)
            if make_backend is None
            else label_with_backend(checked.select(key, text), make_backend, key, text)
        )
        write_report(label_agreement(checked, again, key), f"{out}/validation.json")
    return stored


def scrub_stage(
    df: DataFrame,
    out: str,
    text: str = "raw_text",
    key: str = "post_id",
    gender: str | None = None,
    make_backend: Callable | None = None,
    validation_size: int | None = 100,
    seed: int = 42,
    **backend_options,
) -> DataFrame:
    """Filter, scrub, store; writes impact, examples, per-label report and residual cues."""
    require_columns(df, text, key)
    posts = filters.keep_gender(filters.drop_missing_text(df, text), gender)
    require_rows(posts, "texts")
    scrubbed = (
        scrub_posts(posts, text)
        if make_backend is None
        else scrub_with_backend(posts, make_backend, key, text, **backend_options)
    )
    write_table(scrubbed, f"{out}/scrubbed.parquet")
    stored = df.sparkSession.read.parquet(f"{out}/scrubbed.parquet")
    write_report(audit.scrub_impact(stored, text), f"{out}/analysis.json")
    examples = audit.top_replacements(stored, key)
    examples = examples.select(key, text, "scrubbed_text", "num_replacements")
    write_table(examples, f"{out}/scrubbing_examples.csv")
    if "gender" in stored.columns:
        write_table(audit.gender_report(stored, text), f"{out}/gender_scrubbing_analysis.csv")
        write_report(label_counts(stored), f"{out}/label_counts.json")
    if validation_size:
        issues = audit.scrub_issues(stored, key, sample_size=validation_size, seed=seed)
        write_report(issues, f"{out}/validation_issues.json")
    return stored


def embed_stage(
    df: DataFrame,
    out: str,
    text: str = "scrubbed_text",
    key: str = "post_id",
    methods: dict[str, str] | None = None,
    encoders: dict[str, tuple[Callable, int]] | None = None,
    sample_size: int | None = None,
    seed: int = 42,
    store: str | None = None,
    **options,
) -> DataFrame:
    """Embed with every method asked for; one Parquet partition per method.

    `methods` are lexical (name -> strategy), `encoders` external (name -> maker, dimension).
    Vectors of encoders are kept below `store`, one folder per name, so that a run that was
    stopped goes on; `options` go to `embed_external` (retry_errors, requests_per_minute, ...).
    """
    require_columns(df, text, key)
    if sample_size:
        df = sample_rows(df, sample_size, key, seed)
    if methods or not encoders:
        write_embeddings(embed_methods(df, text, methods), out)
    for number, (name, (make, dim)) in enumerate((encoders or {}).items()):
        mode = "append" if methods or number else "overwrite"
        kept = f"{store}/{name}" if store else None
        made = embed_external(df, make, dim, name, key, text, store=kept, **options)
        write_embeddings(made, out, mode)
    return df.sparkSession.read.parquet(out)


def train_stage(
    df: DataFrame,
    out: str,
    method: str | None = None,
    target: str = "gender",
    key: str = "post_id",
    binary: bool = False,
    make_estimators: Callable[[int, int], dict[str, Estimator]] = models.registry,
    cv_folds: int | None = 5,
    seed: int = 42,
) -> DataFrame:
    """Train on one method with detailed reports, or compare all methods of the table."""
    require_columns(df, "method", target, key)
    if binary:
        df = filters.binary_only(df, target)
    spark = df.sparkSession
    if method is None:
        results = models.compare_methods(
            df, make_estimators, target, key, cv_folds, seed, save_to=f"{out}/models"
        )
        write_table(results, f"{out}/results.parquet")
        stored = spark.read.parquet(f"{out}/results.parquet")
        write_report(models.comparison(stored), f"{out}/training_results.json")
        return stored
    part = df.filter(F.col("method") == method)
    data = models.prepare(part, target, key, seed=seed)
    estimators = make_estimators(data.dim, len(data.classes))
    fitted, trained = models.train_models(data, estimators, cv_folds, key, target, seed)
    write_table(models.predict(fitted, data.test, key), f"{out}/predictions.parquet",
                partition_by=["model"])
    predicted = spark.read.parquet(f"{out}/predictions.parquet")
    for name in fitted:
        rows = predicted.filter(F.col("model") == name)
        folder = f"{out}/{name.lower().replace(' ', '_')}"
        write_report(classification_report(rows), f"{folder}/classification_report.json")
        write_report(confusion_matrix(rows), f"{folder}/confusion_matrix.json")
    models.save_models(spark, f"{out}/models", fitted, data.preprocessing, trained)
    data.unpersist()
    return predicted

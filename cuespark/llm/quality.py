"""A quality classifier of few rules over text statistics."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, RandomForestClassifier
from pyspark.ml.functions import array_to_vector
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import fold
from cuespark.session import stored

FIT_ROWS = 20_000  # labelled rows that are fitted, those of the smallest hash of their id

#: (statistic, is above, threshold), ...
Rule = tuple[tuple[str, bool, float], ...]


def statistics(text: Column) -> dict[str, Column]:
    """Named statistics of a text; NULL counts as the empty text."""
    t = F.coalesce(text, F.lit(""))
    chars = F.greatest(F.length(t), F.lit(1))
    words = F.split(t, " ")
    n_words = F.size(words)
    distinct = F.size(F.array_distinct(words))
    lines = F.split(t, "\n")
    # a text without its small letters and white space is short: what follows searches that
    rest = F.regexp_replace(t, r"[\p{Ll}\s]+", "")

    def count(pattern: str) -> Column:
        return F.regexp_count(rest, F.lit(pattern))

    return {
        "chars": F.log1p(F.length(t)),
        "word_length": chars / n_words,
        "capitals": count(r"\p{Lu}") / chars,
        "symbols": count(r"[^\p{L}\p{N}]") / chars,
        "digits": count(r"\p{N}") / chars,
        "bars": count(r"[|•·»›]") / n_words,
        "distinct_words": distinct / n_words,
        "variety": F.log1p(distinct) / F.log1p(n_words),
        "distinct_lines": F.size(F.array_distinct(lines)) / F.size(lines),
        "line_words": F.log1p(n_words / F.size(lines)),
    }


NAMES = [
    "chars", "word_length", "capitals", "symbols", "digits", "bars", "distinct_words", "variety",
    "distinct_lines", "line_words",
]


@dataclass
class RuleModel:
    """Weights of conjunctive rules; `share` of good texts where nothing could be fitted."""

    rules: list[Rule]
    weights: list[float]
    intercept: float

    def score(self, stats: str) -> Column:
        """The probability of label 1 from a struct column of statistics."""
        total = F.lit(self.intercept)
        for rule, weight in zip(self.rules, self.weights):
            total = total + F.when(condition(rule, stats), F.lit(weight)).otherwise(F.lit(0.0))
        return 1 / (1 + F.exp(-total))


def condition(rule: Rule, stats: str) -> Column:
    holds = F.lit(True)
    for name, above, threshold in rule:
        value = F.col(f"{stats}.{name}")
        holds = holds & ((value > threshold) if above else (value <= threshold))
    return holds


def tree_rules(forest) -> list[Rule]:
    """The path to every node of every tree, as distinct conjunctions of one bound per side."""
    found: dict[Rule, None] = {}

    def walk(node, path: dict):
        if path:
            found[tuple(sorted((n, a, t) for (n, a), t in path.items()))] = None
        if node.getClass().getSimpleName() != "InternalNode":
            return
        split = node.split()
        name, threshold = NAMES[split.featureIndex()], float(split.threshold())
        above, below = path.get((name, True)), path.get((name, False))
        walk(node.leftChild(), path | {(name, False): threshold if below is None
                                       else min(below, threshold)})
        walk(node.rightChild(), path | {(name, True): threshold if above is None
                                        else max(above, threshold)})

    for tree in forest.trees:
        walk(tree._java_obj.rootNode(), {})
    return list(found)


def training_rows(
    docs: DataFrame, labels: DataFrame, label: str, folds: int, held: int, most: int
) -> DataFrame:
    """(text, label) of labelled documents outside the held-out fold, at most `most` labels."""
    fit = labels.filter(F.col(label).isNotNull() & F.col("doc_id").isNotNull()).select(
        "doc_id", F.col(label).cast("double").alias("label")
    )
    chosen = (
        fit.filter(fold("doc_id", folds) != held)
        .orderBy(F.xxhash64("doc_id"), "doc_id", "label").limit(most)
    )
    # `most` rows of two numbers
    return docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", "label")


def fit_quality(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = FIT_ROWS,
    trees: int = 20, depth: int = 3, penalty: float = 0.0005, seed: int = 7,
) -> RuleModel:
    """A rule ensemble from `labels` (doc_id, quality) of `docs` (doc_id, text).

    Trees over the statistics propose rules; a logistic regression with an L1 penalty chooses and
    weighs them.  At most `most` labelled rows are fitted, whatever the size of the tables.  Rows
    of the held-out fold (crc32 of doc_id modulo `folds`) never count.  With fewer than two labels
    among the rows every text gets the smoothed share of label 1.
    """
    rows = training_rows(docs, labels, "quality", folds, held, most)
    stats = statistics(F.col("text"))
    data = stored(
        rows.select(F.struct(*(c.cast("double").alias(n) for n, c in stats.items())).alias("stats"),
                    "label"),
        "quality-fit",
    )
    sums = data.agg(F.count("*"), F.sum("label")).first()
    n, good = sums[0], sums[1] or 0.0
    if not 0 < good < n:
        import math

        return RuleModel([], [], math.log((good + 1) / (n - good + 1)))
    vectors = data.select(
        array_to_vector(F.array(*(F.col(f"stats.{name}") for name in NAMES))).alias("features"),
        "label", "stats",
    )
    forest = RandomForestClassifier(
        numTrees=trees, maxDepth=depth, seed=seed, featureSubsetStrategy="onethird",
        minInstancesPerNode=5,
    ).fit(vectors)
    rules = tree_rules(forest)
    if not rules:
        import math

        return RuleModel([], [], math.log((good + 1) / (n - good + 1)))
    held_by = [F.when(condition(r, "stats"), F.lit(1.0)).otherwise(F.lit(0.0)) for r in rules]
    marked = vectors.select(array_to_vector(F.array(*held_by)).alias("features"), "label")
    lasso = LogisticRegression(
        elasticNetParam=1.0, regParam=penalty, maxIter=100, standardization=False
    ).fit(marked)
    kept = [(r, float(w)) for r, w in zip(rules, lasso.coefficients.toArray()) if abs(w) > 1e-6]
    return RuleModel([r for r, _ in kept], [w for _, w in kept], float(lasso.intercept))


def with_score(docs: DataFrame, model: RuleModel, text: str = "text") -> DataFrame:
    """(row, score): the row of docs as a struct and its probability of being good.

    The rules are one Project over the scan, without Python.  NULL and empty texts are scored by
    their statistics as every other; repeated rows are scored each; an empty table gives no rows;
    columns of docs keep their names inside `row`.
    """
    stats = statistics(F.col(text).cast("string"))
    rows = docs.select(
        F.struct("*").alias("row"),
        F.struct(*(c.cast("double").alias(n) for n, c in stats.items())).alias("stats"),
    )
    return rows.select("row", model.score("stats").alias("score"))

def keep_good(
    docs: DataFrame, model: RuleModel, threshold: float = 0.3, text: str = "text"
) -> DataFrame:
    """The rows of docs with a score of at least `threshold`, as they are.

    The rejected rows are counted as an observed metric, `quality`.  That also keeps the optimizer
    from moving the condition below the statistics, which it would then spell out once per rule.
    """
    scored = with_score(docs, model, text)
    seen = scored.observe("quality", F.count_if(F.col("score") < threshold).alias("rejected"))
    return seen.filter(F.col("score") >= threshold).select("row.*")

"""Every registered query against its SQL, and the shape of the plans."""

import pytest

from compare import compare, connect
from conftest import SF_DIR

import __spark_entry__ as entry
import oracle_sql
from cuespark.plans import queries

QUERIES, ORACLES = dict(queries.QUERIES), dict(oracle_sql.ORACLES)
# Many fits: compared with SQL, but their plans are not looked at.
SLOW = {n for n in QUERIES if n.startswith(("train_", "grid_search"))} | {"compare_embeddings"}
SLOW |= {"boosted_first_splits", "models_reloaded"}
# Results a table cannot be compared with: learned vectors.
WITHOUT_SQL = {"embed_learned"}


@pytest.fixture(scope="module")
def db():
    return connect(SF_DIR)


def test_every_query_has_sql_or_a_reason():
    assert set(QUERIES) - set(ORACLES) == WITHOUT_SQL
    assert set(ORACLES) <= set(QUERIES) <= set(entry.queries())


BUILT = {}


def built(spark, name):
    """Building a query may run jobs; once is enough."""
    if name not in BUILT:
        BUILT[name] = QUERIES[name](spark, SF_DIR)
    return BUILT[name]


# Minutes each; compared by tests/compare.py only.
LONG = {"grid_search_forest", "train_all", "train_cross_validated"}


@pytest.mark.parametrize("name", sorted(set(ORACLES) - LONG))
def test_query_equals_sql(spark, db, name):
    assert compare(built(spark, name), db, ORACLES[name]) is None


@pytest.mark.parametrize("name", sorted(WITHOUT_SQL))
def test_other_queries_give_rows(spark, name):
    assert QUERIES[name](spark, SF_DIR).count() > 0


def test_entry(spark):
    assert entry.entry(spark).count() == 3


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[-1]


# Model backends are the other Python in a plan.
PYTHON = {"label_posts_backend", "scrub_posts_backend", "embed_external", "embed_store"}
# Sums over rows that only arrays in a task can hold.
PYTHON |= {"similarity_spread"}
PER_ROW = [
    "label_posts", "label_cues", "scrub_posts", "parse_label_response", "label_policy",
    "scrub_policy", "pool_mean", "embed_methods", "sample_fraction", "replacement_counts",
]


@pytest.mark.parametrize("name", sorted(set(ORACLES) - PYTHON - SLOW))
def test_no_python_and_no_cross_join(spark, name):
    plan = plan_of(built(spark, name))
    for word in ("Python", "Pandas", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert word not in plan


@pytest.mark.parametrize("name", PER_ROW)
def test_row_operators_do_not_shuffle(spark, name):
    plan = plan_of(built(spark, name))
    assert "Exchange" not in plan and "SortMergeJoin" not in plan


def test_filters_and_columns_reach_the_scan(spark):
    from cuespark.operators.filters import drop_blank_text
    from cuespark.operators.label import label_counts, label_posts

    documents = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    plan = plan_of(label_counts(label_posts(drop_blank_text(documents, "text"), "text")))
    assert "PushedFilters: [IsNotNull(text)]" in plan and "ReadSchema: struct<text:string>" in plan
    plan = plan_of(built(spark, "attach_embeddings"))
    assert "ReadSchema: struct<vec_id:bigint,embedding:array<float>>" in plan
    plan = plan_of(built(spark, "norm_stats"))
    assert "ReadSchema: struct<embedding:array<float>>" in plan


def test_a_regression_on_labels_by_chance_has_learned_if_its_loss_is_less(spark):
    """It predicts the largest class alone, as it should; shares themselves, or worse, are no learning."""
    rows = [(float(i % 5 > 2), 0.0, [0.62, 0.38] if i % 5 < 3 else [0.58, 0.42], "lasso") for i in range(50)]
    rows += [(float(i % 5 > 2), 0.0, [0.6, 0.4], "shares") for i in range(50)]
    rows += [(float(i % 5 > 2), 0.0, [0.58, 0.42] if i % 5 < 3 else [0.62, 0.38], "worse") for i in range(50)]
    rows += [(float(i % 5 > 2), 0.0, None, "no probability") for i in range(50)]
    seen = spark.createDataFrame(rows, "label double, prediction double, probability array<double>, model string")
    got = {r.model: r.learned for r in queries._learned(seen, [0.6, 0.4]).collect()}
    assert got == {"lasso": True, "shares": False, "worse": False, "no probability": False}

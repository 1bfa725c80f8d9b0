"""Quality and toxicity: held-out accuracy, disguises, odd rows; the pipeline."""

import math

import pytest
from conftest import SF_DIR
from llm.helpers import ODD_TEXTS, docs, empty
from pyspark.sql import functions as F

import corpus_pipeline
from cuespark.llm import quality, toxicity
from cuespark.llm.common import fold, table

SF = SF_DIR.replace("0.001", "0.01")


def _accuracy(spark, scored, label, threshold):
    labels = table(spark, SF, "labels").select("doc_id", F.col(label).alias("y"))
    judged = scored.select("row.doc_id", "score").join(labels, "doc_id")
    held = judged.filter(fold("doc_id", 5) == 0)
    return held.agg(F.avg(((F.col("score") >= threshold).cast("int") == F.col("y")).cast("int"))).first()[0]


@pytest.fixture(scope="module")
def tables(spark):
    return table(spark, SF, "documents").select("doc_id", "text"), table(spark, SF, "labels")


def test_quality_on_held_out_rows(spark, tables):
    model = quality.fit_quality(*tables)
    assert 0 < len(model.rules) < 280
    assert _accuracy(spark, quality.with_score(tables[0], model), "quality", 0.3) > 0.93
    odd = quality.with_score(docs(spark), model)
    found = odd.collect()
    assert len(found) == len(ODD_TEXTS) + 2 and all(0 <= r["score"] <= 1 for r in found)
    assert odd.select("row.*").columns == docs(spark).columns
    assert quality.with_score(empty(spark), model).count() == 0
    assert "Python" not in odd._jdf.queryExecution().toString()


def test_rules_compile_to_conditions(spark):
    rule = (("chars", True, 1.0), ("digits", False, 0.5))
    model = quality.RuleModel([rule], [2.0], -1.0)
    given = spark.createDataFrame([("word",), ("12",), ("",), (None,)], "text string")
    scores = [r["score"] for r in quality.with_score(given, model).collect()]
    on, off = 1 / (1 + math.exp(-1)), 1 / (1 + math.exp(1))
    assert scores == pytest.approx([on, off, off, off])


def test_labels_of_one_kind_or_none(spark):
    given = docs(spark)
    labels = spark.createDataFrame([(i, 1, 0) for i in range(9)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(given, labels)
    assert not model.rules and model.intercept > 0
    assert quality.fit_quality(given, labels.limit(0)).intercept == 0
    toxic = toxicity.fit_toxicity(given, labels)
    assert toxic.intercept < 0 and not toxic.evidence
    assert toxicity.fit_toxicity(given, labels.limit(0)).intercept == 0


def test_held_out_rows_never_train(spark, tables):
    held = tables[1].filter(fold("doc_id", 5) == 0)
    assert quality.training_rows(tables[0], held, "quality", 5, 0, 100).count() == 0
    assert quality.training_rows(tables[0], tables[1], "quality", 5, 0, 50).count() == 50


def test_toxicity_on_held_out_rows(spark, tables):
    model = toxicity.fit_toxicity(*tables)
    assert _accuracy(spark, toxicity.with_score(tables[0], model), "toxic", 0.5) > 0.9
    reader = toxicity.Reader(model)
    for rude in ("idiot", "1d10t", "i d i o t", "i.d.i.o.t", "IDIOOOOT", "!diot", "id1ot", "id*ot"):
        read = [toxicity.restore(t, reader.letters) for t in toxicity.tokens(f"it {rude} on")]
        assert ["idiot"] in read, (rude, read)
        assert reader.score(f"{rude} moron") > reader.score("on the")
    found = toxicity.with_score(docs(spark), model)
    assert [r for r in found.collect() if not 0 <= r["score"] <= 1] == []
    assert found.count() == len(ODD_TEXTS) + 2
    assert toxicity.with_score(empty(spark), model).count() == 0


def test_decoding_equals_the_best_of_all_paths():
    import itertools

    words = ["hello", "world", "idiot", "low", "hold"]
    grams = {}
    for w in words:
        line = "  " + w + " "
        for i in range(len(line) - 2):
            grams[line[i : i + 3]] = grams.get(line[i : i + 3], 0) + 10
    model = toxicity.CharacterModel(grams)
    for token in ("h3llo", "w0rld", "1d10t", "heelllo", "h.o.l.d"):
        best = max(itertools.product(*toxicity.lattice(token)), key=lambda p: _cost(p, model))
        assert toxicity.decode(token, model, beam=10_000) == "".join(x for x, _ in best).strip()
    assert toxicity.decode("h3llo", model) == "hello"
    assert toxicity.decode("1d10t", model) == "idiot"
    assert toxicity.restore("hello!", model) == ["hello"]
    assert toxicity.restore("***", model) == []


def _model(*words):
    grams = {}
    for w in words:
        line = "  " + w + " "
        for i in range(len(line) - 2):
            grams[line[i : i + 3]] = grams.get(line[i : i + 3], 0) + 10
    return toxicity.CharacterModel(grams)


def test_disguises_wherever_they_stand_are_decoded():
    model = _model("idiot", "hate", "ass", "dumbass", "fuck", "hello", "on", "the")
    for rude, word in [
        ("idi07", "idiot"), ("hat3", "hate"), ("id10+", "idiot"), ("a$$", "ass"),
        ("dumba$$", "dumbass"), ("|diot", "idiot"), ("fuuck", "fuck"), ("i  d  i  o  t", "idiot"),
        ("i . d . i . o . t", "idiot"), ("i/d/i/o/t", "idiot"), ("i,d,i,o,t", "idiot"),
        ("id/iot", "idiot"), ("(idi07)", "idiot"),
    ]:
        read = [w for t in toxicity.tokens(f"on {rude} the") for w in toxicity.restore(t, model)]
        assert word in read, (rude, read)
    for plain in ("hello", "hello!", "hello,", "(hello", '"hello"'):
        assert "hello" in toxicity.restore(plain, model), plain
    assert "covid19" in toxicity.restore("covid19", model)
    assert toxicity.tokens("_" * 5000 + "a" + " _" * 5000)  # ends


def test_stars_are_decoded_without_a_beam():
    import itertools

    vowels = "aeiou"
    model = _model("fauk", "fuck", *(f"b{a}{b}h" for a in vowels for b in vowels), "booth", "beauh")
    for token in ("f**k", "b**h", "b***h", "b****h"):
        best = max(_cost(p, model) for p in itertools.product(*toxicity.lattice(token)))
        read = toxicity.decode(token, model)
        # the letters that were read have a path of the best cost
        assert _best_cost(token, read, model) == pytest.approx(best), (token, read)


def test_no_state_is_dropped():
    met = set()

    class Counting(toxicity.CharacterModel):
        def log(self, context, letter):
            if letter == "h":
                met.add(context)
            return super().log(context, letter)

    toxicity.decode("bo**h", Counting(_model("booth").three))
    vowels = "aeiou"
    assert {a + b for a in vowels for b in vowels} | {"o" + a for a in vowels} | {"bo"} <= met


def _best_cost(token, read, model):
    import itertools

    paths = itertools.product(*toxicity.lattice(token))
    return max(_cost(p, model) for p in paths if "".join(x for x, _ in p).strip() == read)


def _cost(path, model):
    context, total = "  ", 0.0
    for letter, channel in path:
        total += channel
        if letter and not (letter == " " and context[-1] == " "):
            total += model.log(context, letter)
            context = context[1] + letter
        if letter == " ":
            context = "  "
    return total + (0.0 if context == "  " else model.log(context, " "))


def test_pipeline_keeps_what_every_stage_keeps(spark):
    given = table(spark, SF_DIR, "documents")
    columns, before = given.columns, given.count()
    stored = given
    for name, stage in corpus_pipeline.STAGES:
        kept = stage(spark, stored, SF_DIR)
        if name != "encode":
            assert kept.columns == columns
            assert kept.exceptAll(stored).count() == 0
        if name == "near_duplicates":
            assert kept.select("text").distinct().count() == kept.count()
    final = corpus_pipeline.run(spark, SF_DIR)
    assert 0 < final.count() < before and final.filter("n_tokens <> size(ids)").count() == 0


def test_pipeline_stages_of_odd_rows(spark, tmp_path):
    docs(spark).write.parquet(str(tmp_path / "d"))
    odd = spark.read.parquet(str(tmp_path / "d"))
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, odd, SF_DIR).count() <= odd.count()
        assert stage(spark, odd.limit(0), SF_DIR).count() == 0, name

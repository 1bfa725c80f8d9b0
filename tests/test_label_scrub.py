import random
import re

import pytest
from pyspark.sql import functions as F

from conftest import column
from cuespark.functions import lexicon
from cuespark.operators import audit, filters, label, scrub

WORDS = ["he", "He", "she", "her", "HER", "hers", "him", "his", "himself", "herself", "wife",
         "Mr.", "mrs", "Sir", "John", "Mary", "man", "the", "note", "3", "é", ".", ",", "\n",
         "there", "shed", "ms.", "[x]", "Johnson", "her.", "grandmother"]


def random_texts(n, seed):
    rng = random.Random(seed)
    return [rng.choice(["", " "]).join(rng.choices(WORDS, k=rng.randint(0, 12))) for _ in range(n)]


def python_scrub(text):
    def swap(words, to, s, flags=re.IGNORECASE, end=r"\b"):
        return re.sub(rf"\b(?:{'|'.join(words)}){end}", to, s, flags=flags)

    text = swap(["himself", "herself"], "[PRONOUN_REFLEXIVE]", text)
    text = re.sub(r"\b(?:his|hers)\b|\bher(?=\s+[^\W\d_])", "[PRONOUN_POSSESSIVE]", text,
                  flags=re.IGNORECASE)
    text = swap(["him", "her"], "[PRONOUN_OBJECT]", text)
    text = swap(["he", "she"], "[PRONOUN]", text)
    text = swap(lexicon.words_of(None, "kinship"), "[FAMILY_MEMBER]", text)
    text = swap(lexicon.NAMES, "[NAME]", text, flags=0)
    return swap(lexicon.words_of(None, "title"), "[TITLE]", text, end=r"\b\.?")


def test_scrub_equals_python_on_random_texts(texts):
    samples = random_texts(600, 7)
    df = scrub.scrub_posts(texts(*samples))
    assert column(df, "scrubbed_text") == [python_scrub(s) for s in samples]


def test_one_search_equals_four_rewrites(texts):
    samples = random_texts(1500, 11) + [
        "her  herself", "her himself", "her\n\tHERSELF.", "her herselfish", "her his her", "her her her x",
        "her", "her ", "ſhe and hiſ", "Mr.Mrs.ms", "\ue000 he \ue000", "Her\u00a0note", "", "John's son"]
    samples += [s.upper() for s in samples[:300]]
    df = texts(*samples, None).select(
        "post_id", scrub.scrub(F.col("raw_text")).alias("one"),
        scrub.scrub_stepwise(F.col("raw_text")).alias("four"))
    assert column(df, "one") == column(df, "four")
    none = texts("John met her son", "x").select("post_id", scrub.scrub(F.col("raw_text"), []).alias("s"))
    assert column(none, "s") == ["John met [PRONOUN_POSSESSIVE] [FAMILY_MEMBER]", "x"]


def test_long_name_list_gives_the_same_result(texts):
    samples = random_texts(200, 8)
    names = lexicon.NAMES + [f"Nobody{i}" for i in range(1000)]
    df = texts(*samples)
    short = df.select("post_id", scrub.scrub_names(F.col("raw_text")).alias("s"))
    long = df.select("post_id", scrub.scrub_names(F.col("raw_text"), names).alias("s"))
    assert column(short, "s") == column(long, "s")
    full = df.select("post_id", scrub.scrub(F.col("raw_text"), names).alias("s"))
    plain = df.select("post_id", scrub.scrub(F.col("raw_text")).alias("s"))
    assert column(full, "s") == column(plain, "s")


@pytest.mark.parametrize("more", [0, 40, 1000])
def test_names_of_several_words_go_whatever_the_size_of_the_list(spark, texts, more):
    names = ["Mary Ann", "Mary", "O'Brien", "Jean-Luc", "John"] + [f"Nobody{i}" for i in range(more)]
    df = texts("Mary Ann met O'Brien, Jean-Luc and John; Mary Anne met Johnny.", "Nobody0x Nobody")
    listed = scrub.names_of(spark.createDataFrame([(n,) for n in [*names, " John ", ""]], "name string"))
    assert sorted(listed) == sorted(names)
    for result in (scrub.scrub_names, scrub.scrub):
        got = column(df.select("post_id", result(F.col("raw_text"), listed).alias("s")), "s")
        assert got == ["[NAME] met [NAME], [NAME] and [NAME]; [NAME] Anne met Johnny.", "Nobody0x Nobody"]


def test_scrub_examples(texts):
    df = scrub.scrub_posts(
        texts("he rang his aunt twice", "SHE lost HER keys!", "The dog sleeps.", None, "",
              "John asked his uncle whether he had seen his niece on the ferry.",
              "theory of others"),
        null_as_empty=True,
    )
    assert column(df, "scrubbed_text") == [
        "[PRONOUN] rang [PRONOUN_POSSESSIVE] [FAMILY_MEMBER] twice",
        "[PRONOUN] lost [PRONOUN_POSSESSIVE] keys!",
        "The dog sleeps.", "", "",
        "[NAME] asked [PRONOUN_POSSESSIVE] [FAMILY_MEMBER] whether [PRONOUN] had seen "
        "[PRONOUN_POSSESSIVE] [FAMILY_MEMBER] on the ferry.",
        "theory of others",
    ]


def test_prompts_name_what_they_ask_for(texts):
    df = texts("The kettle boiled over again.").select(
        label.label_prompt(F.col("raw_text")).alias("l"), scrub.scrub_prompt(F.col("raw_text")).alias("s")
    )
    asked = df.first()
    for word in ("The kettle boiled over again.", "FEMALE", "MALE", "NEUTRAL", "JSON", "reasoning", "answer"):
        assert word in asked.l
    for word in ("The kettle boiled over again.", "[PRONOUN]", "[NAME]", "[FAMILY_MEMBER]", "JSON", "scrubbed_text"):
        assert word in asked.s


def test_rule_labels(texts):
    samples = ["she paints boats", "Later he rowed.", "Rain fell on the pier.", "He met her.", "", None,
               "My wife left", "others theory shed", "MR. Smith"]
    df = label.label_posts(texts(*samples))
    assert column(df, "gender") == ["FEMALE", "MALE", "NEUTRAL", "NEUTRAL", "NEUTRAL", "NEUTRAL",
                                    "FEMALE", "NEUTRAL", "MALE"]
    assert column(df, "reasoning")[3:6] == ["cues: he her", "Empty text", "Empty text"]
    assert column(df, "text") == samples


def test_cue_hits_count_inside_the_row(texts):
    rows = label.cue_hits(texts("He said he saw her", "nothing")).collect()
    assert sorted(tuple(r) for r in rows) == [
        (0, "he", "pronoun", "MALE", 2), (0, "her", "pronoun", "FEMALE", 1),
    ]


def test_label_policy(spark):
    rows = [
        (0, "t", '{"reasoning": "r", "answer": "FEMALE"}', None),
        (1, "t", '{"reasoning": "", "answer": "MALE"}', None),
        (2, "t", None, "API rate limit exceeded"),
        (3, "t", "no object here", None),
        (4, "t", '{"answer": null}', None),
        (5, "", None, None), (6, None, None, None), (7, "t", None, None),
        (8, " ", '{"reasoning": "r", "answer": "MALE"}', None),
    ]
    df = label.apply_label_policy(
        spark.createDataFrame(rows, "post_id bigint, raw_text string, raw string, error string")
    )
    got = list(zip(column(df, "gender"), column(df, "reasoning"), column(df, "confidence")))
    assert got[:4] == [
        ("FEMALE", "r", "high"), ("MALE", "", "low"),
        ("NEUTRAL", "Error: API rate limit exceeded", "low"), ("NEUTRAL", "", "low"),
    ]
    assert got[4][0] == "NEUTRAL" and got[4][1].startswith("Error:") and got[4][2] == "low"
    assert got[5] == got[6] == ("NEUTRAL", "Empty text", "high")
    assert got[7][1].startswith("Error:") and got[8] == ("MALE", "r", "high")


def test_scrub_policy(spark):
    rows = [
        (0, "She left.", '{"scrubbed_text": "[PRONOUN] left."}', None),
        (1, "She left.", "no braces at all", None), (2, "She left.", None, "API Error"),
        (3, None, None, None), (4, "", None, None),
        (5, "They left.", '{"scrubbed_text": "They left."}', None),
    ]
    df = scrub.apply_scrub_policy(
        spark.createDataFrame(rows, "post_id bigint, raw_text string, raw string, error string")
    )
    assert column(df, "scrubbed_text") == [
        "[PRONOUN] left.", "She left.", "She left.", None, "", "They left."]
    assert column(df, "scrub_status") == [
        "scrubbed", "unparsed", "error", "empty", "empty", "unchanged"]


def test_counts_and_agreement(spark):
    df = spark.createDataFrame(
        [(0, "FEMALE"), (1, "FEMALE"), (2, "MALE"), (3, None)], "post_id bigint, gender string")
    counts = {r.gender: (r.n, r.share) for r in label.label_counts(df).collect()}
    assert counts == {"FEMALE": (2, 50.0), "MALE": (1, 25.0), None: (1, 25.0)}
    new = df.withColumn("gender", F.lit("FEMALE"))
    row = label.label_agreement(df, new).first()
    assert (row.agreements, row.disagreements, row.agreement_rate, row.sample_size) == (2, 2, 0.5, 4)
    nothing = label.label_agreement(df.limit(0), new).first()
    assert nothing.agreement_rate is None and nothing.sample_size == 0
    assert label.domain_violations(df).count() == 1


def test_filters(spark, texts):
    df = texts("a", None, "  ", "", "b")
    assert column(filters.drop_missing_text(df), "raw_text") == ["a", "  ", "", "b"]
    assert column(filters.drop_blank_text(df), "raw_text") == ["a", "b"]
    assert filters.keep_gender(df, "MALE") is df
    labelled = spark.createDataFrame(
        [(0, "NEUTRAL", 0.0), (1, None, 1.0), (2, "MALE", None), (3, "MALE", float("nan"))],
        "post_id bigint, gender string, female_pred double")
    assert column(filters.binary_only(labelled), "post_id") == [1, 2, 3]
    assert column(filters.decode_label(labelled), "gender") == ["MALE", "FEMALE"]
    with pytest.raises(ValueError, match="nothing.*available"):
        filters.drop_blank_text(df, "nothing")


def test_impact_counts_placeholders_literally(spark):
    rows = [(0, "He met his uncle.", "[PRONOUN] met [PRONOUN_POSSESSIVE] [FAMILY_MEMBER]."),
            (1, "She sings.", "[PRONOUN] sings."), (2, "Nobody [here] sings.", "Nobody [here] sings."),
            (3, None, None)]
    df = spark.createDataFrame(rows, "post_id bigint, raw_text string, scrubbed_text string")
    row = audit.scrub_impact(df).first()
    assert (row.total_texts, row.n_pronoun, row.n_family_member, row.total_replacements) == (4, 2, 1, 3)
    assert row.avg_word_reduction == 0.0
    change = audit.modification_summary(df).first()
    assert (change.total_texts, change.texts_modified, change.max_words_replaced) == (4, 2, 3)
    assert change.examples == [0, 1] and change.avg_words_replaced == 2.0
    top = audit.top_replacements(df, n=2).collect()
    assert sorted((r.post_id, r.num_replacements) for r in top) == [(0, 3), (1, 1)]
    expected = (len(rows[0][1]) - len(rows[0][2]) + len(rows[1][1]) - len(rows[1][2])) / 3
    assert audit.length_delta(df).first()[0] == pytest.approx(expected)


def test_gender_report_rounds_half_to_even_and_skips_missing_labels(spark):
    rows = [(0, "FEMALE", "x" * 8, "[a]"), (1, None, "y", "[b]")]
    rows += [(2 + i, "MALE", "z" * (1 if i else 2), "[a][b]" if i else "") for i in range(8)]
    df = spark.createDataFrame(rows, "post_id bigint, gender string, raw_text string, scrubbed_text string")
    found = {r.gender: r for r in audit.gender_report(df).collect()}
    assert set(found) == {"FEMALE", "MALE"}
    assert found["FEMALE"].replacements_std is None
    assert found["MALE"].original_length_mean == 1.12  # 1.125
    assert found["MALE"].replacements_max == 2


PYTHON_PATTERNS = [lexicon.audit_pattern(n) for n in lexicon.AUDIT_WORDS]


def test_audit_equals_python_on_random_texts(texts):
    samples = random_texts(300, 9) + ["mr.smith", "mr. smith", "MR.MS.X", "She is studying."]
    df = audit.scrub_issues(texts(*samples), scrubbed="raw_text", sample_size=None)
    got = {(r.post_id, r.pattern): r.missed_cues for r in df.collect()}
    want = {}
    for i, s in enumerate(samples):
        for pattern in PYTHON_PATTERNS:
            found = re.findall(pattern, s.lower(), re.IGNORECASE)
            if found:
                want[(i, pattern)] = found
    assert got == want


def test_audit_modes_and_summary(texts):
    df = texts("Mr. Smith came.", "[PRONOUN] is here.", "She left")
    strict = audit.scrub_issues(df, scrubbed="raw_text", mode="strict").collect()
    assert sorted((r.post_id, r.missed_cues) for r in strict) == [(0, ["mr."]), (2, ["she"])]
    row = audit.issue_rate(df, scrubbed="raw_text").first()
    assert (row.total_texts, row.texts_with_issues, row.total_issues) == (3, 1, 1)
    clean = audit.issue_rate(df.limit(0), scrubbed="raw_text").first()
    assert clean.total_issues == 0
    with pytest.raises(ValueError):
        audit.scrub_issues(df, scrubbed="raw_text", mode="other")


def test_names_of_a_table_equal_the_pattern(spark):
    import random

    random.seed(6)
    names = ["Mary", "Mary Ann", "Ann Lee", "O'Brien", "Jean-Luc", "Luc", "Zo\u00eb", "Mary Ann Lee Jones", "X"]
    words = ["Mary", "Ann", "Lee", "Jones", "O", "Brien", "Jean", "Luc", "luc", "Zo\u00eb", "Zo", "X", "Xx", "and"]
    gaps = [" ", " ", " ", "-", "'", ", ", "  ", ".", "\n"]
    texts = ["".join(random.choice(words) + random.choice(gaps) for _ in range(random.randrange(25)))
             for _ in range(300)] + [None, "", "Mary", "..Mary Ann", "no names"]
    df = spark.createDataFrame(list(enumerate(texts)), "post_id long, raw_text string").repartition(4)
    table = spark.createDataFrame([(n,) for n in [*names, " Luc ", "", None, "Luc"]], "name string")
    got = {r.post_id: r.scrubbed_text for r in scrub.scrub_names_by_table(df, table).collect()}
    want = df.withColumn("w", scrub.scrub_names(F.col("raw_text"), names))
    assert got == {r.post_id: r.w for r in want.collect()}
    none = scrub.scrub_names_by_table(df, table.limit(0))
    assert none.filter("scrubbed_text IS DISTINCT FROM raw_text").count() == 0
    with pytest.raises(ValueError, match="1 names"):
        scrub.scrub_names_by_table(df, spark.createDataFrame([("J.",), ("Luc",)], "name string"))


def test_names_by_table_take_work_in_proportion_to_a_text(spark):
    """The rows of a text's spans do not hold the list of all its pieces."""
    texts = spark.createDataFrame([(1, "Mary Ann met Bob and Mary. Bobby left " * 50)], "post_id bigint, raw_text string")
    names = spark.createDataFrame([("Mary Ann",), ("Mary",), ("Bob",)], "name string")
    made = scrub.scrub_names_by_table(texts, names)
    assert made.first()["scrubbed_text"] == "[NAME] met [NAME] and [NAME]. Bobby left " * 50
    plan = made._jdf.queryExecution().optimizedPlan().toString()
    generated = [line.split("Generate", 1)[1].split("],", 1)[-1] for line in plan.splitlines() if "Generate" in line]
    assert generated and not any("_pieces" in line for line in generated)


def test_summaries_search_texts_once(texts, capsys):
    """Examples are taken from the stored counts: the plan of a summary searches no text again."""
    df = texts("she [X] said", "nothing", None).withColumn("scrubbed_text", F.upper("raw_text"))
    for made in (audit.issue_rate(df), audit.modification_summary(df)):
        made.explain()
        assert "regexp" not in capsys.readouterr().out
        assert made.first()["total_texts"] == 3

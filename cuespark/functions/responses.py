"""Strict reading of JSON answers with Spark's variant functions.

`try_parse_json` ignores text behind the first JSON value.  The answer is therefore put into
an array that ends with a marker: only if the whole answer is one JSON value does the marker
come out as the second and last element.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cuespark.functions.text import strip
from cuespark.schema import LABELS, NEUTRAL

_MARK = "end of answer"


def _with(value: Column, use) -> Column:
    """`use(value)` with the value computed once, however often `use` mentions it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _wrapped(text: Column) -> Column:
    return F.try_parse_json(F.concat(F.lit("["), text, F.lit(f',"{_MARK}"]')))


def _is_whole(wrapped: Column) -> Column:
    """True if the wrapped text was exactly one JSON value."""
    return (
        wrapped.isNotNull()
        & F.try_variant_get(wrapped, "$[1]", "string").eqNullSafe(_MARK)
        & F.try_variant_get(wrapped, "$[2]", "variant").isNull()
    )


def _is(variant: Column, kind: str) -> Column:
    return F.coalesce(F.schema_of_variant(variant).startswith(kind), F.lit(False))


def strip_label_fence(text: Column) -> Column:
    """Of a stripped text.  A leading json fence makes every fence disappear; other fences stay."""
    return F.when(
        text.startswith("```json"),
        F.replace(F.replace(text, F.lit("```json"), F.lit("")), F.lit("```"), F.lit("")),
    ).otherwise(text)


def strip_scrub_fence(text: Column) -> Column:
    """Of a stripped text.  A leading fence line of any kind goes, and with it one trailing fence."""
    cut = F.locate("\n", text)
    body = F.when(cut > 0, F.substr(text, cut + F.lit(1))).otherwise(text)
    body = F.when(
        body.endswith("```"), F.substr(body, F.lit(1), F.length(body) - F.lit(3))
    ).otherwise(body)
    return F.when(text.startswith("```"), body).otherwise(text)


def parse_label(raw: Column) -> Column:
    """Answer text -> struct(gender, reasoning, parse_error).

    Not JSON, no answer or an unknown answer: NEUTRAL with empty reasoning.  JSON of the wrong
    shape (no object, answer not a string): NEUTRAL with `parse_error` set.
    """
    return _with(strip(raw), lambda text: _with(_wrapped(strip_label_fence(text)), _read_label))


def _read_label(wrapped: Column) -> Column:
    root = F.try_variant_get(wrapped, "$[0]", "variant")
    answer = F.try_variant_get(wrapped, "$[0].answer", "variant")
    gender = F.upper(F.try_variant_get(wrapped, "$[0].answer", "string"))
    reason = F.try_variant_get(wrapped, "$[0].reasoning", "variant")
    reason_text = F.when(reason.isNull(), F.lit("")).otherwise(
        F.try_variant_get(wrapped, "$[0].reasoning", "string")
    )

    def answered(gender: Column, reasoning: Column, error: Column) -> Column:
        return F.struct(
            gender.alias("gender"), reasoning.alias("reasoning"), error.alias("parse_error")
        )

    none, neutral, silent = F.lit(None).cast("string"), F.lit(NEUTRAL), F.lit("")
    return (
        F.when(~_is_whole(wrapped), answered(neutral, silent, none))
        .when(
            ~_is(root, "OBJECT"),
            answered(neutral, silent, F.lit("answer is not a JSON object")),
        )
        .when(
            answer.isNotNull() & ~_is(answer, "STRING"),
            answered(neutral, silent, F.lit("answer is not a string")),
        )
        .when(gender.isin(*LABELS), answered(gender, reason_text, none))
        .otherwise(answered(neutral, silent, none))
    )


def parse_scrub(raw: Column) -> Column:
    """Answer text -> the scrubbed text, or NULL if there is no non-empty string."""

    def read(wrapped: Column) -> Column:
        value = F.try_variant_get(wrapped, "$[0].scrubbed_text", "variant")
        text = F.try_variant_get(wrapped, "$[0].scrubbed_text", "string")
        return F.when(_is_whole(wrapped) & _is(value, "STRING") & (F.length(text) > 0), text)

    return _with(strip(raw), lambda text: _with(_wrapped(strip_scrub_fence(text)), read))

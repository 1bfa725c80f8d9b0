"""Block and allow rules for URLs, found through their rarest literal token."""

from __future__ import annotations

import re
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The contract's rules: host and path prefix, verdict.
RULES = (
    ("com", "/", "allow"),
    ("example.com", "/en/", "block"),
    ("www.example.com", "/en/", "allow"),
    ("net", "/es/", "block"),
    ("net", "/fr/", "block"),
)

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def url_host(url: Column) -> Column:
    """After the first `://` up to `/`, `?`, `#` or the end, A-Z lower-cased; else empty."""
    return F.translate(F.regexp_extract(url, r"^(?s).*?://([^/?#]*)", 1), _UPPER, _LOWER)


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end; empty without `://`."""
    return F.regexp_extract(url, r"^(?s).*?://[^/?#]*([^?#]*)", 1)


def rule_tokens(host: str, path: str) -> list[str]:
    """What every address that the rule fits has as whole tokens: host labels, closed segments."""
    closed = path[: path.rfind("/") + 1]
    return list(dict.fromkeys(t for t in [*host.split("."), *closed.split("/")] if t))


def rule_pattern(host: str, path: str) -> str:
    """A regular expression over host + path."""
    return rf"^(?s)([^/]*\.)?{_quoted(host)}{_quoted(path)}"


def _quoted(literal: str) -> str:
    return re.sub(r"([^0-9A-Za-z_/-])", r"\\\1", literal)


def judge_urls(
    pages: DataFrame,
    rules: Sequence[tuple[str, str, str]] = RULES,
    default: str = "allow",
    page_id: str = "page_id",
    url: str = "url",
) -> DataFrame:
    """(page_id, host, path, rule, verdict) per row of pages.

    Rules (host, path prefix, verdict) are indexed by the token of theirs that the fewest
    addresses of the table have (ties to the first); an address fetches the rules of its own
    tokens from that index, runs only their regular expressions, and the longest rule that fits
    wins (ties to the longer host, then to the later text).  No shuffle but that of the token
    counts, which are pre-aggregated: one row per token of a rule.

    A NULL url and one without `://` have an empty host and path and get the default verdict, as
    every url that no rule fits; their rule is NULL.  Repeated rows are judged each; an empty
    table gives no rows; other columns of pages are not read.
    """
    u = F.coalesce(F.col(url), F.lit(""))
    parted = pages.select(
        F.col(page_id).alias("page_id"), url_host(u).alias("host"), url_path(u).alias("path")
    )
    tokens = F.split(F.concat_ws("/", F.col("host"), F.col("path")), "[./]")
    index = _index(parted, tokens, rules)
    found = F.array_compact(
        F.flatten(
            F.transform(
                F.array_distinct(tokens),
                lambda t: F.coalesce(F.try_element_at(index, t), F.array().cast(_RULE)),
            )
        )
    )
    address = F.concat("host", "path")
    fitting = F.filter(found, lambda r: F.call_function("regexp_like", address, r["pattern"]))
    best = F.array_max(fitting)
    return (
        parted.withColumn("best", best)
        .select(
            "page_id", "host", "path", F.col("best")["rule"].alias("rule"),
            F.coalesce(F.col("best")["verdict"], F.lit(default)).alias("verdict"),
        )
    )


_RULE = (
    "array<struct<length: int, host_length: int, rule: string, pattern: string, verdict: string>>"
)


def _index(parted: DataFrame, tokens: Column, rules) -> Column:
    """A constant map from a token to the rules that are indexed by it."""
    names = sorted({t for host, path, _ in rules for t in rule_tokens(host, path)})
    counts = {
        r["token"]: r["count"]
        for r in parted.select(F.explode(F.array_intersect(tokens, _strings(names))).alias("token"))
        .groupBy("token").count().collect()
    }
    by_token: dict[str, list[Column]] = {}
    for host, path, verdict in rules:
        own = rule_tokens(host, path)
        if not own:
            raise ValueError(f"a rule needs a host label or a closed segment: {host + path!r}")
        rarest = min(own, key=lambda t: counts.get(t, 0))
        by_token.setdefault(rarest, []).append(
            F.struct(
                F.lit(len(host + path)).alias("length"), F.lit(len(host)).alias("host_length"),
                F.lit(host + path).alias("rule"), F.lit(rule_pattern(host, path)).alias("pattern"),
                F.lit(verdict).alias("verdict"),
            )
        )
    entries = [F.struct(F.lit(t), F.array(*found)) for t, found in by_token.items()]
    return F.map_from_entries(F.array(*entries)).cast(f"map<string, {_RULE}>")


def _strings(values: list[str]) -> Column:
    return F.array(*map(F.lit, values)) if values else F.array().cast("array<string>")

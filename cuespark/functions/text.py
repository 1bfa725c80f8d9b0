"""Text expressions whose results do not depend on the JVM version.

A *word* is a run of Unicode letters, digits and underscores.  Boundaries are written as
lookarounds on that class, since `\\b` and `\\s` changed meaning between Java releases.
"""

from __future__ import annotations

import re
from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

WORD = r"[\p{L}\p{N}_]"
# Unicode white space plus the four separators U+001C..U+001F.
SPACE = r"[\s\x1C-\x1F]"
NOT_SPACE = r"[^\s\x1C-\x1F]"


def alternation(words: Iterable[str]) -> str:
    """`(?:he(?:r)?|she)`: a prefix tree, so that a search costs the same for any number of words.

    The longest word that fits is taken.
    """
    tree: dict = {}
    for word in words:
        node = tree
        for letter in word:
            node = node.setdefault(letter, {})
        node[""] = {}
    return _branches(tree)


def _branches(node: dict) -> str:
    ways = []
    for letter, below in node.items():
        if letter:
            run = re.escape(letter)
            while len(below) == 1 and "" not in below:
                letter, below = next(iter(below.items()))
                run += re.escape(letter)
            ways.append(run + _branches(below))
    if not ways:
        return ""
    return "(?:" + "|".join(ways) + ")" + ("?" if "" in node else "")


def any_word(words: Iterable[str], ignore_case: bool = True, ends: str = f"(?!{WORD})") -> str:
    """Pattern for one of the words where it is not part of a longer one.

    The test for the first letter comes before the costlier one for the character before it.
    `ends` is what must hold behind the word.
    """
    words = list(words)
    initials = "".join(sorted({re.escape(w[0]) for w in words}))
    flags = "(?iu)" if ignore_case else ""
    return f"{flags}(?=[{initials}])(?<!{WORD}){alternation(words)}{ends}"


def tokens(text: Column) -> Column:
    """Lower-cased words, in order."""
    return F.regexp_extract_all(F.lower(text), F.lit(f"{WORD}+"), F.lit(0))


def is_blank(text: Column) -> Column:
    return ~text.rlike(f"(?U){NOT_SPACE}")


def strip(text: Column) -> Column:
    """Remove leading and trailing Unicode white space.

    Only a text that has some at an end is searched.
    """
    ends = [F.substring(text, at, 1).rlike(f"(?U){SPACE}") for at in (1, -1)]
    return F.when(~(ends[0] | ends[1]), text).otherwise(
        F.regexp_replace(text, f"(?U)^{SPACE}+|{SPACE}+\\z", "")
    )


def word_count(text: Column) -> Column:
    """Number of white-space separated words; NULL counts as none."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(f"(?U){NOT_SPACE}+")).cast("bigint")


def count_literal(text: Column, literal: str) -> Column:
    """Non-overlapping occurrences of a literal string."""
    shrunk = F.replace(text, F.lit(literal), F.lit(""))
    return ((F.length(text) - F.length(shrunk)) / len(literal)).cast("bigint")


def bracket_count(text: Column) -> Column:
    """`[...]` groups that do not span a line feed, author brackets included."""
    return F.regexp_count(text, F.lit(r"(?d)\[.*?\]")).cast("bigint")


def snippet(text: Column, size: int = 100) -> Column:
    """Lower-cased head of a text for display, always followed by dots."""
    return F.concat(F.substring(F.lower(text), 1, size), F.lit("..."))


def clean_for_encoder(text: Column) -> Column:
    """Line feeds become spaces, then strip; NULL becomes the empty text."""
    return strip(F.replace(F.coalesce(text, F.lit("")), F.lit("\n"), F.lit(" ")))

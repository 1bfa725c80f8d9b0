"""Cue words, placeholders and audit patterns.

Plain values; a lexicon is small by nature and enters the plan as literals.
"""

from __future__ import annotations

from cuespark.schema import FEMALE, MALE

# The placeholder vocabulary.
PRONOUN = "[PRONOUN]"
PRONOUN_OBJECT = "[PRONOUN_OBJECT]"
PRONOUN_POSSESSIVE = "[PRONOUN_POSSESSIVE]"
PRONOUN_REFLEXIVE = "[PRONOUN_REFLEXIVE]"
NAME = "[NAME]"
FAMILY_MEMBER = "[FAMILY_MEMBER]"
TITLE = "[TITLE]"

# The placeholders counted, literally, by the impact report.
COUNTED_PLACEHOLDERS = {
    "pronoun": PRONOUN,
    "name": NAME,
    "family_member": FAMILY_MEMBER,
    "title": TITLE,
}

# Gendered words by cue class and side.
CUES = {
    "pronoun": {
        FEMALE: ["she", "her", "hers", "herself"],
        MALE: ["he", "him", "his", "himself"],
    },
    "kinship": {
        FEMALE: ["wife", "sister", "mother", "daughter", "grandmother", "aunt", "niece"],
        MALE: ["husband", "brother", "father", "son", "grandfather", "uncle", "nephew"],
    },
    "title": {
        FEMALE: ["mrs", "ms", "madam"],
        MALE: ["mr", "sir"],
    },
    "noun": {
        FEMALE: ["woman", "girl", "lady", "female"],
        MALE: ["man", "boy", "guy", "gentleman", "male"],
    },
}

NAMES = ["John", "Mary", "Sarah"]

# Words of the four residual-cue patterns of the scrub audit.
AUDIT_WORDS = {
    "pronoun": ["he", "she", "him", "her", "his", "hers"],
    "kinship": ["husband", "wife", "brother", "sister", "son", "daughter"],
    "title": ["Mr.", "Mrs.", "Ms."],
    "noun": ["man", "woman", "male", "female", "guy", "girl", "boy", "lady", "gentleman"],
}


def audit_pattern(name: str) -> str:
    """The pattern as issues report it: `\\b(...|...)\\b`."""
    return r"\b(" + "|".join(w.replace(".", r"\.") for w in AUDIT_WORDS[name]) + r")\b"


def words_of(side: str | None = None, *classes: str) -> list[str]:
    """Cue words of one side (both if None) and the given classes (all if none)."""
    return [
        word
        for cue_class, sides in CUES.items()
        if not classes or cue_class in classes
        for cue_side, words in sides.items()
        if side is None or cue_side == side
        for word in words
    ]


def lexicon_rows() -> list[tuple[str, str, str]]:
    """(token, cue_class, side) triples."""
    return [
        (word, cue_class, side)
        for cue_class, sides in CUES.items()
        for side, words in sides.items()
        for word in words
    ]

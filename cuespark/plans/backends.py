"""A rule backend and a rule encoder: stand-ins for hosted models, answering in their format."""

from __future__ import annotations

import hashlib
import json
import re

import numpy as np

from cuespark.functions import lexicon
from cuespark.schema import FEMALE, MALE, NEUTRAL

_WORDS = re.compile(r"\w+")


class CueBackend:
    """Answers label prompts by counting cue words in the quoted post."""

    def __init__(self):
        self.female = set(lexicon.words_of(FEMALE))
        self.male = set(lexicon.words_of(MALE))

    def complete(self, prompts: list[str]) -> list[str]:
        return [json.dumps(self._answer(p)) for p in prompts]

    def _answer(self, prompt: str) -> dict[str, str]:
        post = prompt[prompt.index('"') + 1 : prompt.rindex('"\n\nReply')]
        words = set(_WORDS.findall(post.lower()))
        female, male = sorted(words & self.female), sorted(words & self.male)
        label = NEUTRAL
        if bool(female) != bool(male):
            label = FEMALE if female else MALE
        return {"reasoning": "cues: " + " ".join(sorted(female + male)), "answer": label}


class BracketBackend:
    """Answers scrub prompts by putting family words into placeholders."""

    def __init__(self):
        words = "|".join(lexicon.words_of(None, "kinship"))
        self.pattern = re.compile(rf"\b(?:{words})\b", re.IGNORECASE)

    def complete(self, prompts: list[str]) -> list[str]:
        posts = [p[p.index('"') + 1 : p.rindex('"\n\nReply')] for p in prompts]
        return [
            json.dumps({"scrubbed_text": self.pattern.sub(lexicon.FAMILY_MEMBER, post)})
            for post in posts
        ]


class FailingEncoder:
    """A digest encoder whose calls fail for texts of even length."""

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        if any(len(t) % 2 == 0 for t in texts):
            raise RuntimeError("no answer")
        return DigestEncoder().embed_batch(texts)


class DigestEncoder:
    """Eight components in [-1, 1] from a digest of the whole text."""

    dim = 8

    def embed_batch(self, texts: list[str]) -> np.ndarray:
        digests = [hashlib.md5(t.encode()).hexdigest() for t in texts]
        parts = [[int(d[4 * j : 4 * j + 4], 16) for j in range(self.dim)] for d in digests]
        return np.array(parts) / 32767.5 - 1.0

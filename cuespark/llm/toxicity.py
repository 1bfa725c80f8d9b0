"""Toxicity of texts after undoing disguises by a noisy-channel model."""

from __future__ import annotations

import math
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import asdict, dataclass, field
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from cuespark.llm.common import batches_of, utf8, worker_cache
from cuespark.llm.quality import training_rows
from cuespark.session import stored

FIT_ROWS = 20_000  # labelled rows that are fitted
KEPT = 200_000  # tokens whose reading a worker keeps

# Fixed values of the channel: what a sign may stand for.
LEET = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "gb", "7": "t", "8": "b",
    "9": "g", "*": "aeiou", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "(": "c", "€": "e", "£": "l",
}
SEPARATORS = " .-_*~/,"
LETTERS = frozenset("abcdefghijklmnopqrstuvwxyzßàáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿ")

_SIGN = "".join(map(re.escape, LEET))
_APARTS = re.escape(SEPARATORS)
_ONE = r"(?:[^\W_]|[@$!|])"  # no separator, so that runs of them have one reading
_EDGE = re.compile(r"^[\W_]+|[\W_]+$")
#: What stands around a token and for no letter.
_OUTER = re.compile(rf"^(?:(?![{_SIGN}])[\W_])+|(?:(?![{_SIGN}])[\W_])+$")
#: A token that is certainly disguised: a sign between or before letters, a letter three times, or
#: separators between single letters.
_NOISY = re.compile(
    rf"[^\W\d_][{_SIGN}]+[^\W\d_]|^[0-9@$!][^\W\d_]|([^\W_])\1\1|^[^\W_](?:[{_APARTS}]+[^\W_])+$"
)
#: A token that may be: a sign, a separator or a letter twice, wherever it stands.
_MAYBE = re.compile(rf"[{_SIGN}{_APARTS}]|([^\W\d_])\1")
_APART = re.compile(rf"{_ONE}(?:[{_APARTS}]+{_ONE})+")
_SPACED = re.compile(rf"(?<![\w{_SIGN}])(?:{_ONE}[{_APARTS}]+){{2,}}{_ONE}(?![\w{_SIGN}])")


_TWICE = re.compile(r"(.)\1")
_REPEATED = re.compile(r"(.)\1+")
_PLAIN_EDGE = ".,;:?\"'"  # signs around a word that stand for no letter


def single(word: str) -> str:
    """A word with every letter once that is repeated in a row."""
    return _REPEATED.sub(r"\1", word)


class CharacterModel:
    """Trigrams of letters within words, interpolated down to an even share; log probabilities."""

    def __init__(self, counts: dict[str, int]):
        self.three = counts
        self.two: Counter = Counter()
        self.after: Counter = Counter()
        self.pair: Counter = Counter()
        self.one: Counter = Counter()
        for (a, b, c), n in counts.items():
            self.two[a + b] += n
            self.pair[b + c] += n
            self.after[b] += n
            self.one[c] += n
        self.total = sum(self.one.values())
        self.known: dict[str, float] = {}

    def log(self, context: str, letter: str) -> float:
        gram = context + letter
        found = self.known.get(gram)
        if found is None:
            b = context[-1]
            p = (self.one[letter] + 1) / (self.total + len(LETTERS) + 1)
            p = (self.pair[b + letter] + 5 * p) / (self.after[b] + 5)
            p = (self.three.get(gram, 0) + 5 * p) / (self.two[context] + 5)
            found = self.known[gram] = math.log(p)
        return found


def lattice(token: str) -> list[list[tuple[str, float]]]:
    """Per sign of a token: (letters it may stand for, log probability of the channel).

    A letter stands for itself, or for nothing if it repeats the sign before it; a sign of LEET
    for its letters, or for nothing, which is likelier at the end, where it may be punctuation; a
    separator, between single letters if it is also in LEET (then for its letters too), for nothing or
    a gap between words;
    others for nothing.
    """
    if LETTERS.issuperset(token):
        end, apart = len(token), False
    else:
        end = len(_EDGE.sub("", "x" + token)) - 1  # signs from here on may be punctuation
        apart = bool(_APART.fullmatch(token))
    out = []
    before = two_before = ""
    for i, sign in enumerate(token):
        again = before == sign
        run = again and (two_before == sign or token[i + 1 : i + 2] == sign)
        out.append(_arcs(sign, again, run, apart, i == 0, i >= end))
        two_before, before = before, sign
    return out


@lru_cache(100_000)
def _arcs(
    sign: str, again: bool, run: bool, apart: bool, first: bool, at_end: bool
) -> list[tuple[str, float]]:
    if sign in LETTERS:
        arcs = [(sign, math.log(0.3 if run else 0.95 if again else 1.0))]
        if again:
            arcs.append(("", math.log(0.7 if run else 0.05)))
    elif sign in SEPARATORS and (apart or sign not in LEET):
        # a star may be a letter here as well: f**k
        letters = LEET.get(sign, "")
        rest = 0.5 if letters else 1.0
        arcs = [("", math.log(0.9 * rest)), (" ", math.log(0.1 * rest))]
        arcs += [(letter, math.log(0.5 / len(letters))) for letter in letters]
    elif sign in LEET:
        arcs = [(letter, math.log(0.8 / len(LEET[sign]))) for letter in LEET[sign]]
        edge = first and not sign.isdigit()
        none = 0.7 if again else 1e-3 if edge else 1e-4
        if at_end:
            none = 0.5 if sign == "!" else 0.05
        arcs.append(("", math.log(none)))
    else:
        arcs = [("", math.log(0.5))]
    return arcs


def decode(token: str, model: CharacterModel, beam: int | None = None) -> str:
    """The most probable words behind a token: Viterbi over its lattice and the letter model.

    A state is the two letters before, so the pairs of letters bound their number.  All go on; only
    if `beam` is given, that many of the best.
    """
    known, log = model.known, model.log
    states = {"  ": (0.0, None)}
    for arcs in lattice(token):
        if len(arcs) == 1 and len(states) == 1 and arcs[0][0] > " ":  # one way to go on
            ((context, (cost, path)),) = states.items()
            letter, channel = arcs[0]
            p = known.get(context + letter)
            now = cost + channel + (log(context, letter) if p is None else p)
            states = {context[1] + letter: (now, (letter, path))}
            continue
        reached: dict[str, tuple] = {}
        for context, (cost, path) in states.items():
            for letter, channel in arcs:
                if not letter or (letter == " " and context[1] == " "):
                    state, now, line = context, cost + channel, path
                else:
                    gram = context + letter
                    p = known.get(gram)
                    now = cost + channel + (log(context, letter) if p is None else p)
                    state, line = gram[1:], (letter, path)
                if letter == " ":
                    state = "  "
                if state not in reached or reached[state][0] < now:
                    reached[state] = (now, line)
        states = reached
        if beam is not None and len(reached) > beam:
            states = dict(sorted(reached.items(), key=lambda x: -x[1][0])[:beam])
    path = max(
        states.items(), key=lambda s: s[1][0] + (0.0 if s[0] == "  " else log(s[0], " "))
    )[1][1]
    letters = []
    while path is not None:
        letters.append(path[0])
        path = path[1]
    return "".join(reversed(letters)).strip()


def restore(token: str, model: CharacterModel) -> list[str]:
    """The words that a lower-cased token reads as: itself without its edges, its decoding, or both.

    Both, if its signs may as well be punctuation, digits, or a letter that belongs there twice.
    """
    if LETTERS.issuperset(token):
        plain = shown = token
    else:
        plain = _EDGE.sub("", token)
        shown = _OUTER.sub("", token)  # signs around the word may be its letters
    if not any(c in LETTERS for c in plain) or not _MAYBE.search(shown):
        return [plain] if plain else []
    found = decode(shown, model).split()
    if not found or not _NOISY.search(shown):
        found += [plain] if plain not in found else []
    return found


def likely(token: str, read: list[str]) -> list[str]:
    """What restore read, without a decoding that has the plain word beside it."""
    plain = _EDGE.sub("", token)
    return [plain] if plain in read and not _NOISY.search(_OUTER.sub("", token)) else read


def tokens(text: str) -> list[str]:
    """Lower-cased tokens of a text, single letters set apart by separators taken together."""
    low = text.lower()
    found = low.split()
    for spaced in _SPACED.finditer(low):
        found.append(spaced.group())
    return found


def keys(word: str) -> list[str]:
    """What speaks for a word: itself and how it begins."""
    return [word + "$", *(word[:n] for n in (4, 5, 6) if len(word) >= n)]


@dataclass
class ToxicityModel:
    trigrams: dict[str, int]
    #: key -> toxic and other training texts that have it; totals of both
    evidence: dict[str, tuple[int, int]] = field(default_factory=dict)
    totals: tuple[int, int] = (0, 0)
    coefficients: tuple[float, ...] = (0.0, 0.0, 0.0)
    intercept: float = 0.0


class Reader:
    """A model with what a worker has read so far.

    When so much is kept, further tokens are read anew each time: those kept are the earlier, and so
    the more frequent ones.
    """

    def __init__(self, model: ToxicityModel):
        self.letters = CharacterModel(model.trigrams)
        self.model = model
        self.best: dict[str, float] = {}
        self.odds = {key: self._odds(a, b) for key, (a, b) in model.evidence.items()}
        # keys without letters that repeat the one before
        self.whole = {single(k[:-1]) for k in self.odds if k.endswith("$")}
        self.starts = {single(k) for k in self.odds if not k.endswith("$")}
        self.lengths = sorted({len(k) for k in self.starts})

    def _odds(self, a: int, b: int) -> float:
        ones, zeros = self.model.totals
        return math.log((a + 0.5) / (ones + 1)) - math.log((b + 2.0) / (zeros + 4))

    def weight(self, word: str, label: float | None = None) -> float:
        """Log odds of the strongest key of a word; a training text's own count is left out."""
        best = 0.0
        for key in keys(word):
            odds = self.odds.get(key)
            if odds is not None:
                if label is not None:
                    a, b = self.model.evidence[key]
                    odds = self._odds(a - 1, b) if label else self._odds(a, b - 1)
                best = max(best, odds)
        return best

    def token_weight(self, token: str) -> float:
        """Weight of the strongest reading of a token.

        All readings of a token of letters are the same but for letters that repeat the one before:
        if no key agrees with it so far, none of them has a weight, and none is looked for.
        """
        word = token.strip(_PLAIN_EDGE)
        if word and LETTERS.issuperset(word):
            if not _TWICE.search(word):
                return self.weight(word)
            line = single(word)
            if line not in self.whole and not any(line[:n] in self.starts for n in self.lengths):
                return 0.0
        return max(map(self.weight, restore(token, self.letters)), default=0.0)

    def features(self, text: str) -> list[float]:
        best, weights = self.best, []
        for token in set(tokens(text)):
            w = best.get(token)
            if w is None:
                w = self.token_weight(token)
                if len(best) < KEPT:
                    best[token] = w
            if w:
                weights.append(w)
        return summary(weights)

    def readings(self, text: str) -> str:
        """What a training text reads as, in one string: its tokens, their words, and after a sign of
        their own the words that the text teaches, where these are not all.
        """
        lines = []
        for token in set(tokens(text)):
            if read := restore(token, self.letters):
                line = WORDS.join(read)
                taught = likely(token, read)
                lines.append(line if taught == read else line + TAUGHT + WORDS.join(taught))
        return TOKENS.join(lines)

    def training_features(self, readings: str, label: float) -> list[float]:
        """Of a training text; words that it taught count without it."""
        lines = readings.split(TOKENS)
        taught = taught_words(lines)
        weights = []
        for line in lines:
            w = max(
                self.weight(x, label if x in taught else None)
                for x in line.partition(TAUGHT)[0].split(WORDS)
            )
            if w:
                weights.append(w)
        return summary(weights)

    def score(self, text: str) -> float:
        line = self.model.intercept + sum(
            c * x for c, x in zip(self.model.coefficients, self.features(text))
        )
        return 1 / (1 + math.exp(-max(-700.0, min(700.0, line))))


# White space that no token holds.
TOKENS, WORDS, TAUGHT = "\x1e", "\x1f", "\x1d"


def taught_words(lines: list[str]) -> set[str]:
    return {w for line in lines for w in line.rpartition(TAUGHT)[2].split(WORDS) if w}


def slices(batch: pa.RecordBatch, rows: int = 100) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose Python objects fit a worker's memory."""
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def summary(weights: list[float]) -> list[float]:
    return [max(weights, default=0.0), math.log1p(sum(weights)), float(sum(w > 3 for w in weights))]


#: Numbers of letters, 0 for what parts words; signs that may stand around a word; all others.
_ORDERED = sorted(LETTERS)
SIGNS = len(_ORDERED) + 1
_AROUND, _OTHER = SIGNS, SIGNS + 1
_NO_LATIN = 256  # stands for all code points from here on
_NUMBER = np.full(257, _OTHER, np.uint8)
_NUMBER[[ord(c) for c in _ORDERED]] = np.arange(1, SIGNS)
_NUMBER[[ord(c) for c in ".,;:!?"]] = _AROUND
_NUMBER[[ord(c) for c in " \t\n\r\x0b\x0c"]] = 0


def trigram_counts(bodies: list[bytes]) -> np.ndarray:
    """How often each trigram of letter numbers occurs in the words of texts, two blanks before and one
    behind.  A word is a run without ASCII white space whose signs, but for .,;:!? around it, are letters.
    """
    text = b" ".join(bodies).decode("utf-8", "replace").lower()
    points = np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)
    number = np.full(len(points) + 2, _OTHER, np.uint8)
    number[0] = number[-1] = 0
    number[1:-1] = _NUMBER[np.minimum(points, _NO_LATIN)]
    blank = np.flatnonzero(number == 0)
    letters = np.flatnonzero((number > 0) & (number < SIGNS))
    others = np.flatnonzero(number == _OTHER)
    # all letters of a word must lie together, and nothing else but signs around them
    low, high = (np.searchsorted(letters, blank[i : len(blank) - 1 + i]) for i in (0, 1))
    bad = np.diff(np.searchsorted(others, blank))
    some = (high > low) & (bad == 0)
    low, high = low[some], high[some]
    whole = letters[high - 1] - letters[low] == high - low - 1
    low, size = low[whole], (high - low)[whole]
    # letters of good words, two blanks before each word and behind all
    at = letters[np.repeat(low - (np.cumsum(size) - size), size) + np.arange(size.sum())]
    line = np.zeros(len(at) + 2 * len(size) + 2, np.int32)
    line[np.arange(len(at)) + np.repeat(2 * np.arange(1, len(size) + 1), size)] = number[at]
    gram = (line[:-2] * SIGNS + line[1:-1]) * SIGNS + line[2:]
    return np.bincount(gram[(line[1:-1] > 0) | (line[2:] > 0)], minlength=SIGNS**3)


def named_trigrams(counts: np.ndarray) -> Iterator[tuple[str, int]]:
    letters = [" ", *_ORDERED]
    for code in np.flatnonzero(counts).tolist():
        a, rest = divmod(code, SIGNS * SIGNS)
        b, c = divmod(rest, SIGNS)
        yield letters[a] + letters[b] + letters[c], int(counts[code])


def letter_trigrams(docs: DataFrame, text: str = "text") -> dict[str, int]:
    """Trigrams of the plain words of all texts, padded by two spaces; at most 64 ** 3 of them."""
    schema = pa.schema([("gram", pa.string()), ("n", pa.int64())])

    def count(batches):
        total = np.zeros(SIGNS**3, np.int64)
        for part in (p for batch in batches for p in slices(batch, 200)):
            total += trigram_counts(part.column(0).to_pylist())
        yield from batches_of(named_trigrams(total), schema)

    counted = docs.select(utf8(text).alias("body")).mapInArrow(count, "gram string, n long")
    rows = counted.groupBy("gram").agg(F.sum("n").alias("n")).collect()
    return {r["gram"]: r["n"] for r in rows}


def fit_toxicity(
    docs: DataFrame, labels: DataFrame, folds: int = 5, held: int = 0, most: int = FIT_ROWS,
    least: int = 3,
) -> ToxicityModel:
    """A model from all texts of `docs` (doc_id, text) and `labels` (doc_id, toxic).

    The letter model counts every text.  Evidence of words and of their beginnings, and the
    weights of a text's features, come from at most `most` labelled rows outside the held-out fold,
    copies counted once; a key needs `least` toxic texts.  With fewer than two labels among the
    rows every text gets the smoothed share of label 1.
    """
    spark = docs.sparkSession
    model = ToxicityModel(letter_trigrams(docs))
    rows = training_rows(docs, labels, "toxic", folds, held, most)
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    fit = stored(
        rows.groupBy(body.alias("text")).agg(F.max("label").alias("label")), "toxicity-fit"
    ).repartition(spark.sparkContext.defaultParallelism)
    letters = spark.sparkContext.broadcast(asdict(model))

    def read_texts(batches):
        reader = Reader(ToxicityModel(**letters.value))
        for part in (p for batch in batches for p in slices(batch)):
            made = [reader.readings(text) for text in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("label"), pa.array(made, pa.string())], names=["label", "readings"]
            )

    # every text is read once, for the evidence and for its own features
    readings = stored(
        fit.select("text", "label").mapInArrow(read_texts, "label double, readings string"),
        "toxicity-readings",
    )
    schema = pa.schema([("key", pa.string()), ("ones", pa.int64()), ("zeros", pa.int64())])

    def count(batches):
        for part in (p for batch in batches for p in slices(batch, 500)):
            found: tuple[Counter, Counter] = (Counter(), Counter())
            for label, lines in zip(*(c.to_pylist() for c in part.columns)):
                taught = taught_words(lines.split(TOKENS))
                found[label == 0].update({k for w in taught for k in keys(w)})
            ones, zeros = found
            every = ((k, ones[k], zeros[k]) for k in {**ones, **zeros})
            yield from batches_of(every, schema, 50_000)

    totals = {r["label"]: r["count"] for r in fit.groupBy("label").count().collect()}
    model.totals = (totals.get(1.0, 0), totals.get(0.0, 0))
    if not all(model.totals):
        ones, zeros = model.totals
        model.intercept = math.log((ones + 1) / (zeros + 1))
        return model
    ratio = model.totals[1] / model.totals[0]
    kept = (
        readings.mapInArrow(count, "key string, ones long, zeros long")
        .groupBy("key").agg(F.sum("ones").alias("ones"), F.sum("zeros").alias("zeros"))
        .filter((F.col("ones") >= least) & (F.col("ones") * ratio >= 8 * F.col("zeros")))
        .collect()
    )
    model.evidence = {r["key"]: (r["ones"], r["zeros"]) for r in kept}
    read = spark.sparkContext.broadcast(asdict(model))

    def features(batches):
        reader = Reader(ToxicityModel(**read.value))
        for part in (p for batch in batches for p in slices(batch)):
            made = [
                reader.training_features(lines, label)
                for label, lines in zip(*(c.to_pylist() for c in part.columns))
            ]
            yield pa.RecordBatch.from_arrays(
                [pa.array(made, pa.list_(pa.float64())), part.column("label")], names=["x", "label"]
            )

    data = stored(
        readings.mapInArrow(features, "x array<double>, label double"),
        "toxicity-features",
    )
    fitted = LogisticRegression(regParam=0.001, maxIter=100).fit(
        data.select(array_to_vector("x").alias("features"), "label")
    )
    model.coefficients = tuple(map(float, fitted.coefficients.toArray()))
    model.intercept = float(fitted.intercept)
    return model


def with_score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """(row, score): the row of docs as a struct and its probability of being toxic.

    NULL and empty texts have no words and score low; repeated rows are scored each; an empty table
    gives no rows; columns of docs keep their names inside `row`.
    """
    held, key = docs.sparkSession.sparkContext.broadcast(asdict(model)), uuid.uuid4().hex
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), body.alias("text"))

    def score(batches):
        reader = worker_cache(key, lambda: Reader(ToxicityModel(**held.value)))
        for part in (p for batch in batches for p in slices(batch, 1000)):
            found = [reader.score(t) for t in part.column("text").to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(found, pa.float64())], names=["row", "score"]
            )

    return rows.mapInArrow(
        score, StructType([rows.schema["row"], StructField("score", DoubleType())])
    )

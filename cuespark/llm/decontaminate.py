"""Benchmark passages in documents, found in suffix arrays of the documents."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import (
    ArrayType, IntegerType, LongType, StringType, StructField, StructType,
)

from cuespark.llm.common import utf8, with_columns, worker_cache

WINDOW = 10
TEXTS = 100  # documents whose words are Python objects at a time
PART = 1 << 18  # positions of a shard that are sieved at a time
BLOCK = 16 << 20  # bytes of benchmark text that are broadcast at a time

#: Bytes of words: digits, lower-cased letters and all of a non-ASCII character; others part words.
LETTERS = bytes(
    b if b >= 0x80 or chr(b).isdigit() or chr(b).islower() else ord(chr(b).lower())
    if chr(b).isupper() else 0x20 for b in range(256)
)

MATCH = StructType(
    [StructField("item_id", StringType()), StructField("item_word", LongType()),
     StructField("doc_word", LongType()), StructField("n_words", LongType())]
)
FOUND = [
    StructField("n_words", LongType()),
    StructField("hits", ArrayType(LongType())),
    StructField("items", ArrayType(StringType())),
    StructField("matches", ArrayType(MATCH)),
]


def words_of(body: bytes) -> list[bytes]:
    return body.translate(LETTERS).split()


class Suffixes:
    """The distinct windows of a block of benchmark items, as numbers of their words."""

    def __init__(self, items: list[tuple[str | None, bytes]], window: int):
        self.window = window
        self.vocabulary: dict[bytes, int] = {}
        found: dict[tuple[int, ...], dict[tuple[str | None, int], None]] = {}
        for item_id, body in items:
            own = [self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words_of(body)]
            for i in range(max(1, len(own) - window + 1) if own else 0):
                found.setdefault(tuple(own[i : i + window]), {})[item_id, i] = None
        self.windows = sorted(found)
        self.places = [list(found[w]) for w in self.windows]
        self.length = np.array([len(w) for w in self.windows], np.int64)
        padded = np.zeros((len(self.windows), window), np.int64)
        for row, w in zip(padded, self.windows):
            row[: len(w)] = w
        self.low = _packed(padded)
        cover = np.arange(window)[None, :] < self.length[:, None]
        self.high = _packed(np.where(cover, padded, (1 << 31) - 1))
        # a suffix can only match if it begins with two words of a window, or with its only word
        two = padded[self.length > 1][:, :2] if window > 1 else padded[:0]
        self.pairs = np.unique(two[:, 0] << 32 | two[:, 1]) if len(two) else np.empty(0, np.int64)
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[_slot(self.pairs >> 32, self.pairs & 0xFFFFFFFF)] = True
        self.alone = np.zeros(len(self.vocabulary) + 1, bool)
        self.alone[padded[self.length == 1][:, 0]] = True


def _slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return (a * 2654435761 + b * 40503) & ((1 << 22) - 1)


def _packed(words: np.ndarray) -> np.ndarray:
    """Two word numbers per column; columns compare as the words do."""
    if words.shape[1] % 2:
        words = np.hstack([words, np.zeros((len(words), 1), np.int64)])
    return words[:, ::2] << 31 | words[:, 1::2]


def suffix_array(numbers: np.ndarray, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """Sorted suffixes of a shard's word numbers, to the depth of a window: keys and positions.

    Suffixes that cannot match, by their first two words, are left out before the sort.
    """
    padded = np.concatenate([numbers, np.zeros(suffixes.window + 1, numbers.dtype)])
    parts = [np.empty(0, np.int64)]
    for i in range(0, len(numbers), PART):
        here = numbers[i : i + PART].astype(np.int64)
        following = padded[i + 1 : i + 1 + len(here)].astype(np.int64)
        maybe = (here > 0) & suffixes.sieve[_slot(here, following)]
        maybe |= suffixes.alone[here]
        at = np.flatnonzero(maybe)
        code = here[at] << 32 | following[at]
        real = suffixes.alone[here[at]]
        if len(suffixes.pairs):
            spot = np.searchsorted(suffixes.pairs, code)
            real |= suffixes.pairs[np.minimum(spot, len(suffixes.pairs) - 1)] == code
        parts.append(at[real] + i)
    at = np.concatenate(parts)
    keys = _packed(padded[at[:, None] + np.arange(suffixes.window)[None, :]].astype(np.int64))
    order = np.lexsort(keys.T[::-1])
    return keys[order], at[order]


def bisect(keys: np.ndarray, wanted: np.ndarray, right: bool) -> np.ndarray:
    """For each wanted key, how many sorted keys are below it (right: not above it)."""
    low, high = np.zeros(len(wanted), np.int64), np.full(len(wanted), len(keys), np.int64)
    while (open_ := low < high).any():
        middle = (low + high) // 2
        row = keys[np.minimum(middle, len(keys) - 1)]
        below = np.full(len(wanted), right)
        for i in range(keys.shape[1] - 1, -1, -1):
            below = (row[:, i] < wanted[:, i]) | ((row[:, i] == wanted[:, i]) & below)
        low = np.where(open_ & below, middle + 1, low)
        high = np.where(open_ & ~below, middle, high)
    return low


def numbered(bodies: pa.Array, suffixes: Suffixes) -> tuple[np.ndarray, np.ndarray]:
    """The word numbers of a shard's documents (NULL has none), and where each document begins.

    A zero, which no window has, follows every document.  The words of a few documents at a time
    are Python objects; of a whole batch they would take many times its bytes.
    """
    get = suffixes.vocabulary.get
    found = [np.empty(0, np.int32)]
    sizes = []
    for i in range(0, len(bodies), TEXTS):
        for body in bodies.slice(i, TEXTS).to_pylist():
            words = words_of(body or b"")
            own = np.zeros(len(words) + 1, np.int32)
            own[:-1] = np.fromiter(map(get, words, repeat(0)), np.int32, len(words))
            found.append(own)
            sizes.append(len(own))
    return np.concatenate(found), np.cumsum([0, *sizes], dtype=np.int64)


def search_shard(bodies: pa.Array, suffixes: Suffixes, matches: bool):
    """Per document of a shard: n_words, hit words, items, and maximal matches if asked for."""
    numbers, starts = numbered(bodies, suffixes)
    out = [[n - 1, [], [], []] for n in np.diff(starts).tolist()]
    keys, positions = suffix_array(numbers, suffixes)
    if not len(positions) or not len(suffixes.windows):
        return out
    first, last = bisect(keys, suffixes.low, False), bisect(keys, suffixes.high, True)
    count = last - first
    window = np.repeat(np.arange(len(count)), count)
    spot = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = positions[spot]
    edge = np.zeros(len(numbers) + 1, np.int32)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + suffixes.length[window], -1)
    hit = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int32) > 0)
    of = np.searchsorted(starts, hit, "right") - 1
    cuts = np.searchsorted(of, np.arange(len(bodies) + 1))
    docs = np.searchsorted(starts, at, "right") - 1
    for d in np.unique(of):
        out[d][1] = (hit[cuts[d] : cuts[d + 1]] - starts[d]).tolist()
    both = np.unique(docs * np.int64(len(count)) + window)
    items: dict[int, set] = {}
    for d, w in zip((both // len(count)).tolist(), (both % len(count)).tolist()):
        items.setdefault(d, set()).update(i for i, _ in suffixes.places[w] if i is not None)
    for d, own in items.items():
        out[d][2] = sorted(own)
    if matches:
        for d, own in _maximal(docs, window, at - starts[docs], suffixes).items():
            out[d][3] = own
    return out


def _maximal(docs, window, at, suffixes: Suffixes) -> dict[int, list]:
    """Windows that follow each other in the document and the item, as one match each."""
    spans = sorted(
        {
            (d, str(item or ""), p - i, p, int(suffixes.length[w]), i)
            for d, w, p in zip(docs.tolist(), window.tolist(), at.tolist())
            for item, i in suffixes.places[w]
        }
    )
    out: dict[int, list] = {}
    before = None
    for d, item, shift, p, n, i in spans:
        own = out.setdefault(d, [])
        if before == (d, item, shift, p - 1):
            own[-1]["n_words"] += 1
        else:
            own.append({"item_id": item, "item_word": i, "doc_word": p, "n_words": n})
        before = (d, item, shift, p)
    return out


def find_passages(
    rows: DataFrame, benchmark: DataFrame, window: int = WINDOW, matches: bool = False,
    item_text: str = "text", item_id: str = "item_id",
) -> DataFrame:
    """rows (body, others) with n_words, hits, items and matches in place of body.

    hits: the numbers of the words inside an occurrence of a window of an item; items: the ids of
    the items with occurring windows, as strings, sorted; matches, if asked for: the longest
    verbatim matches of at least a window, as (item_id, item_word, doc_word, n_words).

    A shard is an Arrow batch of documents.  Its suffix array is searched for every suffix of the
    benchmark, which is broadcast in blocks of a fixed size; nothing is shuffled.
    """
    return _searched(rows, benchmark, window, matches, item_text, item_id)


def _searched(
    rows: DataFrame, benchmark: DataFrame, window: int, matches: bool = False,
    item_text: str = "text", item_id: str = "item_id", inner: str | None = None,
) -> DataFrame:
    """find_passages; with `inner`, the texts are not `body` but that field of the struct `row`."""
    spark = rows.sparkSession
    items = benchmark.select(
        F.col(item_id).cast("string").alias("item_id"), utf8(item_text).alias("body")
    ).distinct()
    blocks = (items.agg(F.sum(F.octet_length("body"))).first()[0] or 0) // BLOCK + 1
    others = [f for f in rows.schema if f.name != "body"]
    empty = [F.lit(0).cast("long"), *(F.array().cast(f.dataType) for f in FOUND[1:])]
    held = rows.withColumns({f.name: value for f, value in zip(FOUND, empty)})
    bare = StructType([*others, *FOUND])
    spread = F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks))
    for block in range(blocks):
        own = items.filter(spread == block).collect()
        texts = spark.sparkContext.broadcast([(r["item_id"], bytes(r["body"])) for r in own])
        search = _searcher(texts, window, matches)
        if inner is not None or block == blocks - 1:  # no block needs the texts that come back
            held = held.mapInArrow(_bare(search, inner), bare)
        else:
            held = held.mapInArrow(search, held.schema)
    return held


def _bare(search: Callable, inner: str | None) -> Callable:
    """search without `body` in what it gives; texts are those of the struct's field `inner`, if given."""

    def run(batches):
        if inner is not None:
            batches = (
                with_columns(b, body=b.column("row").field(inner).cast(pa.binary())) for b in batches
            )
        for batch in search(batches):
            yield batch.select([n for n in batch.schema.names if n != "body"])

    return run


def _searcher(texts, window: int, matches: bool):
    key = uuid.uuid4().hex

    def search(batches):
        suffixes = worker_cache(key, lambda: Suffixes(texts.value, window))
        for batch in batches:
            names = batch.schema.names
            found = search_shard(batch.column("body"), suffixes, matches)
            columns = {n: batch.column(n) for n in names}
            columns["n_words"] = pa.array([f[0] for f in found], pa.int64())
            for k, field in enumerate(("hits", "items", "matches"), 1):
                before = columns[field]
                made = [f[k] for f in found]
                if len(before.flatten()):
                    pairs = zip(before.to_pylist(), made)
                    made = [a + b if k == 3 else sorted({*a, *b}) for a, b in pairs]
                columns[field] = pa.array(made, before.type)
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=names)

    return search


def judge_documents(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW,
    text: str = "text", doc_id: str = "doc_id",
) -> DataFrame:
    """(doc_id, n_words, n_hit, n_items, items_sha256, contaminated) per row of docs.

    Words are runs of digits, letters A-Z of either case and non-ASCII characters.  A window is
    `window` consecutive words of an item, or all of an item that has fewer.

    NULL and empty texts have no words and no hits, and an item without words has no window; items
    with a NULL id mark words but are not counted; repeated rows are judged each; an empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("body"))
    found = find_passages(rows, benchmark, window)
    n_hit = F.size("hits").cast("long")
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ",").cast("binary"), 256).alias("items_sha256"),
        (n_hit > 0).alias("contaminated"),
    )


def remove_contaminated(
    docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, text: str = "text"
) -> DataFrame:
    """docs without the rows that hold a window of the benchmark."""
    row = F.struct("*").alias("row")
    kinds = {f.name: f.dataType for f in docs.schema}
    if isinstance(kinds.get(text), StringType):  # the text goes to the workers once
        found = _searched(docs.select(row), benchmark, window, inner=text)
    else:
        found = find_passages(docs.select(row, utf8(text).alias("body")), benchmark, window)
    return found.filter(F.size("hits") == 0).select("row.*")

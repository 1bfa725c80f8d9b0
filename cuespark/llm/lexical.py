"""Ranked lexical search the other way round: documents run through an index of the queries."""

from __future__ import annotations

import heapq
import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cuespark.llm.common import utf8, worker_cache
from cuespark.llm.decontaminate import words_of
from cuespark.session import stored

BLOCK = 16 << 20  # bytes of items whose index is broadcast at a time
CELLS = 1 << 20  # scores (documents x items), and postings met, that a task holds at a time
EXACT = 1 << 53  # whole numbers below are exact in double precision
RARITY = 1_000_000_000  # fixed value of the score
SHARE = 90  # fixed value: how much of m, in hundredths, a text of mean length has from it


class Index:
    """Postings of items' terms: term -> number, and per number the items that hold it."""

    def __init__(self, items: list[tuple[int, bytes]]):
        self.keys = [key for key, _ in items]
        self.numbers: dict[bytes, int] = {}
        postings: list[list[int]] = []
        for place, (_, body) in enumerate(items):
            for term in dict.fromkeys(words_of(body)):
                number = self.numbers.setdefault(term, len(postings))
                if number == len(postings):
                    postings.append([])
                postings[number].append(place)
        self.sizes = np.array([len(p) for p in postings], np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.items = np.array([i for p in postings for i in p], np.int64)
        self.longest = int(np.bincount(self.items, minlength=1).max())  # terms of an item

    def terms(self, body: bytes) -> tuple[int, np.ndarray, np.ndarray]:
        """How many terms a text has, and the numbers and frequencies of those in the index."""
        words = words_of(body)
        get = self.numbers.get
        found = np.array([i for w in words if (i := get(w)) is not None], np.int32)
        numbers, times = np.unique(found, return_counts=True)
        return len(words), numbers, times.astype(np.int64)


def term_weights(n_docs: int, frequencies: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2N + 2) / (2 df + 1))) of each document frequency df."""
    return np.array(
        [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(df) + 1))) for df in frequencies],
        np.int64,
    )


def length_share(n: int, n_docs: int, n_terms: int) -> int:
    """A document's m: what its length adds to the saturation of its terms."""
    return 100 - SHARE + SHARE * n * n_docs // n_terms


class Heaps:
    """The best documents of each item so far, `top` at most: (score, -doc, doc) with the worst first."""

    def __init__(self, items: int, top: int):
        self.top = top
        self.heaps: list[list] = [[] for _ in range(items)]
        self.least = np.ones(items, np.int64)  # a lower score cannot enter any more

    def update(self, scores: np.ndarray, docs: list) -> None:
        """scores: documents x items."""
        for row, item in zip(*np.nonzero(scores >= self.least)):
            heap, doc = self.heaps[item], docs[row]
            # of equal scores the smaller doc_id stays, a missing one goes first
            entry = (int(scores[row, item]), -math.inf if doc is None else -doc, doc)
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry[:2] > heap[0][:2]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                self.least[item] = heap[0][0]


def scores_of(
    sizes: list[int], numbers: list[np.ndarray], times: list[np.ndarray], index: Index,
    weights: np.ndarray, n_docs: int, n_terms: int,
) -> np.ndarray:
    """Scores of documents (rows) for the items of an index (columns), whole numbers."""
    width = len(index.keys)
    m = np.array([length_share(n, n_docs, n_terms) for n in sizes], np.int64)
    row = np.repeat(np.arange(len(sizes)), [len(x) for x in numbers])
    term, tf = np.concatenate(numbers), np.concatenate(times)
    gain = weights[term] * (RARITY * tf // (1000 * tf + 8 * m[row]))
    # every pair (document, term) meets the items of its term
    wide = index.sizes[term]
    shift = np.repeat(index.starts[term] - (np.cumsum(wide) - wide), wide)
    cell = np.repeat(row * width, wide) + index.items[np.arange(len(shift)) + shift]
    count = len(sizes) * width
    if int(gain.max(initial=0)) * index.longest < EXACT:
        summed = np.bincount(cell, np.repeat(gain, wide), count).astype(np.int64)
    else:
        summed = np.zeros(count, np.int64)
        np.add.at(summed, cell, np.repeat(gain, wide))
    return summed.reshape(len(sizes), width)


def _blocks(items: DataFrame, item_id: str, text: str, block: int) -> tuple[DataFrame, int]:
    """Distinct items (key, item_id, body) with their block, and how many blocks there are."""
    rows = items.select(F.col(item_id).alias("item_id"), utf8(text).alias("body")).distinct()
    size = rows.agg(F.sum(F.octet_length("body") + 100)).first()[0] or 0
    blocks = max(1, math.ceil(size / block))
    dealt = rows.select(
        "*", F.pmod(F.xxhash64("item_id", "body"), F.lit(blocks)).alias("block"),
        F.monotonically_increasing_id().alias("key"),
    )
    return stored(dealt, "search-items"), blocks


def _search_block(rows: DataFrame, items: list, top: int) -> DataFrame:
    """(key, doc_id, score): per task the best documents of each item of a block."""
    spark = rows.sparkSession
    held, name = spark.sparkContext.broadcast(items), uuid.uuid4().hex
    kind = rows.schema["doc_id"].dataType.simpleString()
    id_type = to_arrow_type(rows.schema["doc_id"].dataType)
    names = ["doc_id", "n", "numbers", "times", "docs", "terms"]

    def index() -> Index:
        return worker_cache(name, lambda: Index(held.value))

    def count(batches):
        own = index()
        docs = terms = 0
        frequencies = np.zeros(len(own.numbers), np.int64)
        for batch in batches:
            made: tuple = ([], [], [])
            for body in batch.column("body").to_pylist():
                n, numbers, times = own.terms(body)
                docs += n > 0
                terms += n
                frequencies[numbers] += 1
                if len(numbers):
                    for column, value in zip(made, (n, numbers, times)):
                        column.append(value)
                else:
                    for column in made:
                        column.append(None)
            kinds = (pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int64()))
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), *map(pa.array, made, kinds),
                 pa.nulls(batch.num_rows, pa.int64()), pa.nulls(batch.num_rows, pa.int64())],
                names=names,
            ).filter(pa.array([x is not None for x in made[0]]))
        held_by = np.flatnonzero(frequencies)
        yield pa.RecordBatch.from_arrays(
            [pa.nulls(1, id_type), pa.nulls(1, pa.int64()), pa.array([held_by], pa.list_(pa.int32())),
             pa.array([frequencies[held_by]], pa.list_(pa.int64())), pa.array([docs], pa.int64()),
             pa.array([terms], pa.int64())],
            names=names,
        )

    counted = stored(
        rows.mapInArrow(
            count, f"doc_id {kind}, n long, numbers array<int>, times array<long>, docs long,"
            " terms long"
        ),
        "search-terms",
    )
    ends = counted.filter(F.col("docs").isNotNull())
    totals = ends.agg(F.sum("docs"), F.sum("terms")).first()
    n_docs, n_terms = totals[0] or 0, totals[1] or 0
    shares = ends.select(F.explode(F.arrays_zip("numbers", "times")).alias("x"))
    df = np.zeros(len(Index(items).numbers), np.int64)  # as many as a block has terms
    for number, found in shares.groupBy("x.numbers").agg(F.sum("x.times")).collect():
        df[number] = found
    weights = spark.sparkContext.broadcast(term_weights(n_docs, df))

    def best(batches):
        own, weight = index(), weights.value
        heaps = Heaps(len(own.keys), top)
        step = max(1, CELLS // max(1, len(own.keys)))
        for batch in batches:
            if not batch.num_rows:
                continue
            docs, sizes = batch.column("doc_id").to_pylist(), batch.column("n").to_pylist()
            numbers, times = (
                np.split(c.flatten().to_numpy(), np.cumsum(c.value_lengths().to_numpy())[:-1])
                for c in (batch.column("numbers"), batch.column("times"))
            )
            met = np.cumsum([own.sizes[x].sum() for x in numbers])
            i = 0
            while i < len(docs):
                reach = np.searchsorted(met, (met[i - 1] if i else 0) + CELLS, "right")
                part = slice(i, max(i + 1, min(i + step, int(reach))))
                i = part.stop
                found = scores_of(
                    sizes[part], numbers[part], times[part], own, weight, n_docs, n_terms
                )
                heaps.update(found, docs[part])
        lines = [(own.keys[i], e[2], e[0]) for i, heap in enumerate(heaps.heaps) for e in heap]
        if lines:
            keys, ids, scores = zip(*lines)
            yield pa.RecordBatch.from_arrays(
                [pa.array(keys, pa.int64()), pa.array(ids, id_type), pa.array(scores, pa.int64())],
                names=["key", "doc_id", "score"],
            )

    matched = counted.filter(F.col("n").isNotNull()).select("doc_id", "n", "numbers", "times")
    return matched.mapInArrow(best, f"key long, doc_id {kind}, score long")


def _ranked(found: DataFrame, top: int) -> DataFrame:
    order: list[Column] = [F.desc("score"), F.asc_nulls_last("doc_id")]
    rank = F.row_number().over(Window.partitionBy("key").orderBy(*order))
    return found.select("*", rank.alias("rank")).filter(F.col("rank") <= top)


def search(
    docs: DataFrame, items: DataFrame, top: int = 10, text: str = "text", doc_id: str = "doc_id",
    item_text: str = "text", item_id: str = "item_id", block: int = BLOCK,
) -> DataFrame:
    """(item_id, rank, doc_id, score): the `top` documents of each item with a score above 0.

    A term is a run of ASCII letters, digits and all other than ASCII characters, A-Z lower-cased.
    The index holds the items, not the documents: it is broadcast, in blocks of `block` bytes of
    items.  Every text runs through it once and leaves the frequencies of the terms it shares;
    their document frequencies and the lengths of all texts are summed, then each task scores what
    its documents left and keeps a heap of `top` per item.  The heaps are merged by item.

    NULL and empty texts have no term and are not counted; repeated rows of docs are documents each
    (equal scores of one doc_id follow each other); equal rows of items are one item; items without
    a term, and empty tables, give no rows; a NULL doc_id comes after others of its score; other
    columns are not read.  doc_id must be a whole number.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("body"))
    dealt, blocks = _blocks(items, item_id, item_text, block)
    found = None
    for number in range(blocks):
        held = dealt.filter(F.col("block") == number).select("key", "body").collect()
        own = [(r["key"], bytes(r["body"])) for r in held]
        if own:
            part = _search_block(rows, own, top)
            found = part if found is None else found.unionByName(part)
    if found is None:
        found = rows.select(
            F.lit(0).cast("long").alias("key"), "doc_id", F.lit(0).cast("long").alias("score")
        ).limit(0)
    ranked = _ranked(found, top)
    return ranked.join(dealt.select("key", "item_id"), "key").select(
        "item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"
    )

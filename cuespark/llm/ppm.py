"""Scores of a language model by prediction by partial matching (PPM) over bytes."""

from __future__ import annotations

import math
import uuid
from collections import Counter, defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import batches_of, fold, sums_by_word, utf8, word_counts, worker_cache
from cuespark.session import stored

ORDER = 5  # bytes of context
END = b"\n"  # the end of a text; no word holds white space
EVENTS_PER_TASK = 20_000
SHARED = 2  # orders up to this are known to every task: at most 256 ** 3 counts

EVENTS = "word binary, n long, c long"


def words_and_end(body: bytes) -> list[bytes]:
    """Lower-cased (A-Z) words between white space, then the end of the text."""
    words = body.lower().split()
    words.append(END)
    return words


def events_of(word: bytes, order: int = ORDER) -> list[bytes]:
    """A word's symbols, each behind its context: the separator before the word and what follows.

    Contexts begin at the separator, so the code length of a word depends on the word alone.  Its
    closing separator is the last symbol; END is one symbol in place of a word.
    """
    if word == END:
        return [b" " + END]
    line = b" " + word + b" "
    return [line[max(0, i - order) : i + 1] for i in range(1, len(line))]


def event_counts(words: DataFrame, order: int) -> DataFrame:
    """(word, n, c), a word being an event: in how many distinct words, and how often in the counted texts."""
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("c", pa.int64())])

    def count(batches):
        for batch in batches:
            n: Counter = Counter()
            c: Counter = Counter()
            for word, times in zip(*(x.to_pylist() for x in batch.columns)):
                for event in events_of(word, order):
                    n[event] += 1
                    c[event] += times
            yield from batches_of(((e, k, c[e]) for e, k in n.items()), schema, 100_000)

    counted = words.select("word", "c").mapInArrow(count, EVENTS)
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def log10_probability(event: bytes, nodes: list[dict[bytes, dict[int, int]]]) -> float:
    """log10 P of an event's last byte behind its context.

    nodes: by order, the counts of the symbols behind each context.  From the longest context
    down: a symbol seen there gets (count - 1/2) / counts; else an escape of kinds / 2 / counts is
    paid and the symbols of that context are excluded below.  The last resort is an equal share of
    the bytes not excluded.
    """
    context, symbol = event[:-1], event[-1]
    excluded: set[int] = set()
    total = 0.0
    for k in range(len(context), -1, -1):
        found = nodes[k].get(context[len(context) - k :])
        if not found:
            continue
        counts, kinds = 0, 0
        for s, n in found.items():
            if s not in excluded:
                counts += n
                kinds += 1
        if not kinds:
            continue
        if symbol in found:
            return total + math.log10((found[symbol] - 0.5) / counts)
        total += math.log10(kinds / 2 / counts)
        excluded.update(found)
    return total - math.log10(256 - len(excluded))


def trie(events: list[tuple[bytes, int]], orders: range) -> list[dict[bytes, dict[int, int]]]:
    """By order, context -> symbol -> count, from counted events."""
    nodes: list[dict] = [defaultdict(dict) for _ in range(orders.stop)]
    for event, count in events:
        if count:
            symbol, context = event[-1], event[:-1]
            for k in orders:
                if k <= len(context):
                    below = nodes[k][context[len(context) - k :]]
                    below[symbol] = below.get(symbol, 0) + count
    return nodes


def event_scores(events: DataFrame, order: int) -> DataFrame:
    """(word, n, ppm) of every event; events must be a stored table.

    The trie is dealt by the last three bytes of the context: everything under one such node, at
    most 256 ** (order - 2) events, is in one task.  The orders above, at most 256 ** 3 counts
    whatever the corpus, are gathered by group-by and broadcast.
    """
    spark = events.sparkSession
    top = (
        events.filter("c > 0")
        .groupBy(F.expr(f"substring(word, -{SHARED + 1}, {SHARED + 1})").alias("event"))
        .agg(F.sum("c").alias("c"))
        .collect()
    )
    shared = spark.sparkContext.broadcast([(bytes(r["event"]), r["c"]) for r in top])
    depth, key = SHARED + 1, uuid.uuid4().hex

    def score(table: pa.Table) -> pa.Table:
        own = list(zip(table["word"].to_pylist(), table["c"].to_pylist()))
        nodes = trie(own, range(depth, order + 1))
        upper = worker_cache(key, lambda: trie(shared.value, range(depth)))
        found = [log10_probability(event, [*upper, *nodes[depth:]]) for event, _ in own]
        return pa.table({"word": table["word"], "n": table["n"],
                         "ppm": pa.array(found, pa.float64())})

    node = F.expr(f"substring(substring(word, 1, length(word) - 1), -{depth}, {depth})")
    # nodes share a task; their number grows with the events, so that a task's share does not
    groups = 64 + events.count() // EVENTS_PER_TASK
    return events.groupBy(F.pmod(F.xxhash64(node), F.lit(groups))).applyInArrow(score, "word binary, n long, ppm double")


def score_texts(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", order: int = ORDER,
    folds: int = 7, held: int = 2,
) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) per row of docs.

    Both models learn from the rows whose crc32(doc_id) mod `folds` is not `held`.  base_score is
    an add-one model of words.  score is the log10 probability of the text, as its lower-cased
    words, each closed by a separator, then the end, under a byte trie of `order` bytes with
    escapes and exclusion.

    Code lengths are made once per distinct event (symbol behind its context), added up once per
    distinct word, and joined to each document's word frequencies.

    NULL and empty texts consist of the end; rows with a NULL doc_id hash as the empty text;
    repeated rows count and are scored each; an empty table gives no rows; without training rows N
    and V are 0 and every byte costs log10(256); other columns are not read.
    """
    body = utf8(text)
    rows = docs.select(
        F.col(doc_id).alias("doc_id"), (fold(doc_id, folds) == held).alias("held_out"),
        body.alias("body"),
    )
    counted = rows.select("body", (~F.col("held_out")).alias("counted"))
    words = stored(word_counts(counted, words_and_end), "ppm-words")
    size = words.agg(F.sum("c"), F.count_if(F.col("c") > 0)).first()
    n, v = size[0] or 0, size[1] or 0
    events = stored(event_counts(words, order), "ppm-events")
    scores = stored(event_scores(events, order), "ppm-scores")
    lengths = sums_by_word(
        words.select("word", "n", "c", F.col("word").alias("body")), scores, ["ppm"],
        lambda word: events_of(word, order),
    )
    share = (F.col("c") + 1) / F.lit(float(n + v + 1))
    vocabulary = stored(
        lengths.select(
            "word", "n", "ppm", F.log10(share).alias("base"),
            (F.col("c") > 0).cast("long").alias("known"),
        ),
        "ppm-vocabulary",
    )
    summed = sums_by_word(rows, vocabulary, ["ppm", "base", "known"], words_and_end)
    return summed.select(
        "doc_id", "held_out", F.col("n_words").alias("n_tokens"),
        F.col("known").cast("long").alias("n_known"), F.lit(n).cast("long").alias("train_tokens"),
        F.col("base").alias("base_score"), F.col("ppm").alias("score"),
    )

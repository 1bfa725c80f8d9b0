"""What several operators share: tables, folds, per-task caches, word tables, graph components."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cuespark.session import stored


KEPT_VALUES = 3  # values a worker keeps for later tasks; a job needs one or two
EDGES = 1 << 16  # edges that one task takes as a whole


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fold(column: str, folds: int) -> Column:
    """crc32 of the column as text, modulo `folds`; NULL counts as the empty text."""
    text = F.coalesce(F.col(column).cast("string"), F.lit(""))
    return F.crc32(text.cast("binary")) % folds


def utf8(column: str) -> Column:
    """The text's bytes; NULL counts as the empty text."""
    return F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")


def worker_cache(key, make: Callable):
    """A value that a Python worker makes once and keeps for its later tasks.

    Functions travel to the workers by value, so that a module's own globals are made anew for
    every task; a registered module stays.
    """
    kept = sys.modules.setdefault("_cuespark_llm_kept", types.ModuleType("_cuespark_llm_kept"))
    values = kept.__dict__.setdefault("values", {})
    if key in values:
        values[key] = values.pop(key)  # the latest is last
    else:
        while len(values) >= KEPT_VALUES:
            values.pop(next(iter(values)))
        values[key] = make()
    return values[key]


def batches_of(
    rows: Iterable[tuple], schema: pa.Schema, size: int = 20_000
) -> Iterator[pa.RecordBatch]:
    """Row tuples as Arrow batches."""
    held: list[tuple] = []
    for row in rows:
        held.append(row)
        if len(held) >= size:
            yield _batch(held, schema)
            held = []
    if held:
        yield _batch(held, schema)


def _batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows)
    return pa.RecordBatch.from_arrays(
        [pa.array(values, field.type) for values, field in zip(columns, schema)], schema=schema
    )


def with_columns(batch: pa.RecordBatch, **arrays: pa.Array) -> pa.RecordBatch:
    """The batch with further columns."""
    return pa.RecordBatch.from_arrays(
        [*batch.columns, *arrays.values()], names=[*batch.schema.names, *arrays]
    )


# Words of documents joined to a table of all distinct words.

WORD_COUNTS = "word binary, n long, c long"


def word_counts(docs: DataFrame, split: Callable[[bytes], Iterable[bytes]]) -> DataFrame:
    """(word, n, c) over the column `body` (binary): counts in all rows and in rows with `counted`.

    A task adds up the words of each Arrow batch before anything is shuffled, so that a frequent
    word, or one of a large group of copies, is one row per batch.
    """
    schema = pa.schema([("word", pa.binary()), ("n", pa.int64()), ("c", pa.int64())])

    def count(batches):
        from collections import Counter

        for batch in batches:
            seen: tuple[Counter, Counter] = (Counter(), Counter())
            for body, flag in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                seen[bool(flag)].update(split(body))
            rest, own = seen
            rows = ((w, n + rest.pop(w, 0), n) for w, n in own.items())
            yield from batches_of(rows, schema, 100_000)
            yield from batches_of(((w, n, 0) for w, n in rest.items()), schema, 100_000)

    counted = docs.select("body", "counted").mapInArrow(count, WORD_COUNTS)
    return counted.groupBy("word").agg(F.sum("n").alias("n"), F.sum("c").alias("c"))


def frequent_words(words: DataFrame, most: int, bytes_each: int = 64) -> DataFrame:
    """The words whose count n reaches a power of two that at most `most` words reach, which have at
    most `most * bytes_each` bytes together.

    So the result has a proven size, and a frequent word is in it however long it is.  It only decides
    where a word's value is looked up.
    """
    power = F.floor(F.log2(F.greatest("n", F.lit(1)))).cast("int").alias("p")
    sizes = words.groupBy(power).agg(
        F.count("*").alias("words"), F.sum(F.length("word")).alias("bytes")
    ).collect()
    total = size = 0
    least = 62
    for r in sorted(sizes, key=lambda r: -r["p"]):
        total, size = total + r["words"], size + r["bytes"]
        if total > most or size > most * bytes_each:
            break
        least = r["p"]
    return words.filter(F.greatest("n", F.lit(1)) >= 2**least)


def sums_by_word(
    rows: DataFrame,
    words: DataFrame,
    values: list[str],
    split: Callable[[bytes], Iterable[bytes]],
    most: int = 200_000,
) -> DataFrame:
    """Per row (body, others): the others, n_words, and each value summed over the row's words.

    Every word must be in `words` (word, n, *values), a stored table.  Values of frequent words, a
    table of bounded size, are broadcast and added up inside the task; the other words of a row
    go, one row per distinct word with its frequency, to a join by word.
    """
    spark = rows.sparkSession
    held = frequent_words(words, most).select("word", *values).collect()
    near = spark.sparkContext.broadcast({bytes(r[0]): tuple(map(float, r[1:])) for r in held})
    k = len(values)
    others = [f for f in rows.schema.fields if f.name != "body"]
    numbered = rows.select(
        F.monotonically_increasing_id().alias("rid"), *(F.col(f.name) for f in others), "body"
    )
    out = ", ".join(
        ["rid long", *(f"`{f.name}` {f.dataType.simpleString()}" for f in others),
         "n_words long", "near array<double>", "far array<binary>", "freqs array<int>"]
    )

    def count(batches):
        from collections import Counter

        known = near.value.get
        kinds = (pa.int64(), pa.list_(pa.float64()), pa.list_(pa.binary()), pa.list_(pa.int32()))
        for batch in batches:
            made: tuple = ([], [], [], [])
            for body in batch.column(batch.num_columns - 1).to_pylist():
                seen = Counter(split(body))
                sums, far, freqs = [0.0] * k, [], []
                for word, n in seen.items():
                    value = known(word)
                    if value is None:
                        far.append(word)
                        freqs.append(n)
                    else:
                        for i in range(k):
                            sums[i] += n * value[i]
                for column, value in zip(made, (seen.total(), sums, far, freqs)):
                    column.append(value)
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], *map(pa.array, made, kinds)],
                names=[*batch.schema.names[:-1], "n_words", "near", "far", "freqs"],
            )

    counted = stored(numbered.mapInArrow(count, out), "word-sums")
    far = counted.select("rid", F.explode(F.arrays_zip("far", "freqs")).alias("w")).select(
        "rid", F.col("w.far").alias("word"), F.col("w.freqs").alias("f")
    )
    sums = (
        far.join(words.select("word", *values), "word")
        .groupBy("rid")
        .agg(*(F.sum(F.col("f") * F.col(v)).cast("double").alias(f"far_{v}") for v in values))
    )
    both = counted.drop("far", "freqs").join(sums, "rid", "left")
    return both.select(
        *(f.name for f in others), "n_words",
        *((F.coalesce(F.col(f"far_{v}"), F.lit(0.0)) + F.col("near")[i]).alias(v)
          for i, v in enumerate(values)),
    )


# Connected components.


def components(links: DataFrame, rounds: int = 60, most: int = EDGES) -> DataFrame:
    """(node, component) of the graph with edges (a, b); component is its smallest node.

    Alternating stars: every node's larger neighbours move to its smallest neighbour, then every
    node and its smaller neighbours do.  Rounds needed grow with the logarithm of the longest
    path.  Each round is written to the shared folder, so lineage stays short and a lost executor
    costs no round.  Minima are pre-aggregated, and joins by node can be split where a node has
    very many neighbours.  A graph of up to `most` edges, from the start or after a round, needs no
    further rounds: one task unites it.
    """
    edges = stored(
        links.filter("a <> b").select(
            F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")
        ),
        "links",
    )
    before = None
    for _ in range(rounds):
        now = edges.agg(F.count("*"), F.sum(F.hash("a", "b").cast("long"))).first()
        if now[0] <= most:
            return _united(edges)
        if now == before:
            break
        before = now
        edges = stored(_star(_star(edges, True), False), "links")
    else:
        raise RuntimeError(f"components need more than {rounds} rounds")
    centres = edges.select(F.col("b").alias("node")).distinct()
    return edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(
        centres.withColumn("component", F.col("node"))
    )


def _united(edges: DataFrame) -> DataFrame:
    """(node, component) of a table of few edges, in one task."""

    def unite(batches):
        above: dict = {}  # a node of the same component, the smaller one

        def top(x):
            above.setdefault(x, x)
            while above[x] != x:
                above[x] = x = above[above[x]]
            return x

        kind = None
        for batch in batches:
            kind = batch.schema.field("a").type
            for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                a, b = top(a), top(b)
                above[max(a, b)] = min(a, b)
        if kind is not None:
            yield from batches_of(
                ((x, top(x)) for x in list(above)), pa.schema([("node", kind), ("component", kind)])
            )

    kind = edges.schema["a"].dataType.simpleString()
    return edges.select("a", "b").coalesce(1).mapInArrow(unite, f"node {kind}, component {kind}")


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One step over edges (a > b), as edges (a > b)."""
    if large:
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select(
            "a", F.least("a", "m").alias("m")
        )
        # the larger neighbours of a node go to the smallest of its neighbourhood
        moved = edges.select(F.col("b").alias("a"), F.col("a").alias("v")).join(least, "a")
        kept = moved.select(F.col("v").alias("a"), F.col("m").alias("b"))
    else:
        least = edges.groupBy("a").agg(F.min("b").alias("m"))
        moved = edges.join(least, "a").select(
            F.col("b").alias("a"), F.col("m").alias("b")
        ).filter("a <> b")
        kept = moved.unionByName(least.select("a", F.col("m").alias("b")))
    return kept.filter("a <> b").distinct()

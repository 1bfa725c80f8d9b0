"""Near duplicates by SimHash fingerprints and an inverted index of their bytes."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import components, utf8
from cuespark.session import stored

WORDS = 3
BITS = 2  # differing bits of a link
FEW = 64  # fingerprints of an index entry that are compared with each other


def shingle_hashes(body: bytes, words: int = WORDS) -> list[int]:
    """XXH64 (seed 42) of every run of `words` lower-cased words; of all words if fewer."""
    from xxhash import xxh64_intdigest

    found = body.lower().split()
    if len(found) < words:
        return [xxh64_intdigest(b" ".join(found), 42)] if found else []
    runs = zip(*(found[i:] for i in range(words)))
    return [xxh64_intdigest(run, 42) for run in map(b" ".join, runs)]


def majority(hashes: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Per group of hashes (a group ends at each of `ends`): bits set in over half of them."""
    out = np.zeros(len(ends), np.uint64)
    starts = np.concatenate([[0], ends[:-1]]).astype(np.int64)
    sizes = ends - starts
    some = np.flatnonzero(sizes)
    if not len(some):
        return out
    counts = np.zeros((len(some), 64), np.int64)
    step = 1 << 16
    for a in range(0, len(hashes), step):
        part = hashes[a : a + step]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        first = np.searchsorted(ends[some], a, "right")
        last = np.searchsorted(starts[some], a + len(part), "left")
        at = np.maximum(starts[some][first:last] - a, 0)
        counts[first:last] += np.add.reduceat(bits, at, axis=0, dtype=np.int64)
    set_ = counts * 2 > sizes[some][:, None]
    out[some] = (set_.astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(
        axis=1, dtype=np.uint64
    )
    return out


def fingerprints(rows: DataFrame, words: int = WORDS) -> DataFrame:
    """rows (body, others) with `fp`, the fingerprint as a signed long, in place of body."""
    from pyspark.sql.types import LongType, StructField, StructType

    others = rows.drop("body")

    def mark(batches):
        for batch in batches:
            bodies = batch.column("body").to_pylist()
            hashes = [shingle_hashes(b, words) for b in bodies]
            ends = np.cumsum([len(h) for h in hashes], dtype=np.int64)
            flat = np.fromiter((x for h in hashes for x in h), np.uint64, int(ends[-1]) if len(ends) else 0)
            rest = batch.drop_columns(["body"])
            fp = pa.array(majority(flat, ends).view(np.int64), pa.int64())
            yield pa.RecordBatch.from_arrays([*rest.columns, fp], names=[*rest.schema.names, "fp"])

    return rows.mapInArrow(mark, StructType([*others.schema, StructField("fp", LongType())]))


def links(classes: DataFrame, few: int = FEW) -> DataFrame:
    """(a, b) links between the distinct fingerprints `fp` that differ in at most 2 bits.

    Two such fingerprints share at least 6 of their 8 positional bytes, hence two of the four
    pairs of neighbouring positions: the index has an entry for every two pairs of positions and
    their bytes.  Members of an entry are compared: their shared positional bytes are tallied, the
    guaranteed minimum of 6 is asked, then the differing bits are counted.

    An entry of over `few` members would make too many pairs.  Its members go another way, exact
    as well: each names itself and the 64 fingerprints one bit away; all that name the same one
    (at most 65) are within 2 bits of each other, and any two within 2 bits name a common one.
    Their first is linked to the others; so these links give the components, not every pair.
    """
    postings = stored(
        classes.select("fp", F.explode(_entries("fp")).alias("entry")), "simhash-postings"
    )
    sizes = postings.groupBy("entry").agg(F.count("*").alias("n")).filter("n > 1")
    shared = stored(postings.join(sizes, "entry"), "simhash-shared")
    small = shared.filter(F.col("n") <= few)
    other = small.select("entry", F.col("fp").alias("b"))
    differ = F.col("a").bitwiseXOR(F.col("b"))
    tally = sum(
        (F.shiftrightunsigned(differ, 8 * i).bitwiseAND(F.lit(255)) == 0).cast("int")
        for i in range(8)
    )
    pairs = (
        small.select("entry", F.col("fp").alias("a")).join(other, "entry")
        .filter(F.col("a") < F.col("b"))
        .filter(tally >= 8 - BITS)
        .filter(F.bit_count(differ) <= BITS)
        .select("a", "b")
    )
    crowded = shared.filter(F.col("n") > few).select("fp").distinct()
    flips = F.array(F.col("fp"), *(F.col("fp").bitwiseXOR(F.lit(_signed(1 << i))) for i in range(64)))
    groups = (
        crowded.select("fp", F.explode(flips).alias("near"))
        .groupBy("near").agg(F.collect_set("fp").alias("members"))
        .filter(F.size("members") > 1)
    )
    stars = groups.select(
        F.array_min("members").alias("a"), F.explode("members").alias("b")
    ).filter("a <> b")
    return pairs.unionByName(stars).distinct()


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


def _entries(fp: str) -> Column:
    """The index entries of a fingerprint: which two pairs of positions, and their bytes."""
    pair = [F.shiftrightunsigned(fp, 16 * i).bitwiseAND(F.lit(0xFFFF)) for i in range(4)]
    chosen = [(i, j) for i in range(4) for j in range(i)]
    return F.array(
        *(
            F.shiftleft(F.lit(which).cast("long"), 32)
            .bitwiseOR(F.shiftleft(pair[i], 16)).bitwiseOR(pair[j])
            for which, (i, j) in enumerate(chosen)
        )
    )


def near_duplicates(
    docs: DataFrame, text: str = "text", doc_id: str = "doc_id", few: int = FEW
) -> DataFrame:
    """(rid, doc_id, fp, component_id) per row of docs; rid is unique.

    component_id is the smallest doc_id that can be reached over links.  Copies are one
    fingerprint from the start: they are never paired.

    NULL and empty texts, and those without a word, have fingerprint 0; a NULL doc_id is never a
    component's id unless no row of it has one; repeated rows stay rows; an empty table gives no
    rows; other columns of docs are not read.
    """
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(doc_id).alias("doc_id"),
        utf8(text).alias("body"),
    )
    marked = stored(fingerprints(rows), "simhash-rows")
    classes = stored(marked.groupBy("fp").agg(F.min("doc_id").alias("first")), "simhash-classes")
    graph = stored(components(links(classes, few)), "simhash-components")
    linked = graph.select(F.col("node").alias("fp"), "component")
    smallest = (
        linked.join(classes, "fp").groupBy("component").agg(F.min("first").alias("least"))
    )
    least = linked.join(smallest, "component").select("fp", "least")
    named = stored(
        classes.join(least, "fp", "left").select(
            "fp", F.coalesce("least", "first").alias("component_id")
        ),
        "simhash-names",
    )
    return marked.join(named, "fp").select("rid", "doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, text: str = "text", doc_id: str = "doc_id") -> DataFrame:
    """docs with one row of each component, one with the smallest doc_id; docs must be stored.

    Ties of repeated doc_ids go to the first row.  Columns of docs are kept as they are.
    """
    found = near_duplicates(docs, text, doc_id)
    kept = found.groupBy("component_id").agg(
        F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "rid"))["rid"].alias("rid")
    ).select("rid")
    rows = docs.select(F.struct("*").alias("row"), F.monotonically_increasing_id().alias("rid"))
    return rows.join(kept, "rid", "left_semi").select("row.*")

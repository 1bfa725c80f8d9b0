"""Contiguous shards of near equal bytes from global prefix sums."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cuespark.session import stored


def shard_by_bytes(
    docs: DataFrame,
    shards: int = 8,
    text: str = "text",
    doc_id: str = "doc_id",
    tolerance: float = 0.02,
) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) per row of docs.

    size is the text's UTF-8 bytes plus 1 (NULL: 1).  Rows are put in the order of (hash of the
    text, doc_id), so that equal texts are neighbours.  Range partitions of that order are summed,
    the totals' prefix sums give every partition its offset, and a running sum inside each
    partition gives every row its own.  The order is cut at shards - 1 equal targets; a cut inside
    a group of equal texts moves to the nearer end of the group if that lies within
    `tolerance * total / shards` bytes, so that it stays whole; else the group is cut at the
    target, since equal bytes are the law.  slot counts a shard's rows from 0.

    Only ids, hashes and sizes are shuffled, never texts.  The range partitions include doc_id in
    their key, so one text that a third of all rows share is dealt over many tasks.

    NULL and empty texts have size 1 and crc32 0; NULL doc_ids come first; repeated rows get a
    slot each; an empty table gives no rows; other columns of docs are not read.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).alias("doc_id"),
        (F.octet_length(body) + 1).cast("long").alias("size"),
        F.crc32(body.cast("binary")).alias("text_crc32"),
        F.xxhash64(body).alias("text_hash"),
        F.monotonically_increasing_id().alias("row"),
    )
    order = ["text_hash", "doc_id", "row"]
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    ranged = stored(
        stored(rows, "shard-rows").repartitionByRange(parts, *order)
        .withColumn("part", F.spark_partition_id()),
        "shard-ranges",
    )
    totals = ranged.groupBy("part").agg(F.sum("size").alias("bytes"), F.count("*").alias("rows"))
    # as many rows as there are range partitions
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.select(
        "part",
        F.coalesce(F.sum("bytes").over(before), F.lit(0)).alias("bytes_before"),
        F.coalesce(F.sum("rows").over(before), F.lit(0)).alias("rows_before"),
    )
    inside = Window.partitionBy("part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    placed = stored(
        ranged.withColumns(
            {"sum": F.sum("size").over(inside), "nth": F.row_number().over(
                Window.partitionBy("part").orderBy(*order))}
        )
        .join(F.broadcast(offsets), "part")
        .select(
            "doc_id", "size", "text_crc32", "text_hash",
            (F.col("bytes_before") + F.col("sum") - F.col("size")).alias("start"),
            (F.col("rows_before") + F.col("nth") - 1).alias("nth"),
        ),
        "shard-offsets",
    )
    cuts = _cuts(placed, shards, tolerance)
    shard = F.lit(0)
    for cut in cuts:
        shard = shard + (F.col("start") >= cut).cast("int")
    dealt = placed.withColumn("shard", shard)
    # one row per shard
    first = dealt.groupBy("shard").agg(F.min("nth").alias("first"))
    return dealt.join(F.broadcast(first), "shard").select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
        (F.col("nth") - F.col("first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
    )


def _cuts(placed: DataFrame, shards: int, tolerance: float) -> list[int]:
    """The byte offsets at which shards 1, 2, ... begin; shards - 1 numbers."""
    total = placed.agg(F.sum("size")).first()[0] or 0
    targets = [total * i // shards for i in range(1, shards)]
    end = F.col("start") + F.col("size")
    at_target = F.lit(False)
    for t in targets:
        at_target = at_target | ((F.col("start") < t) & (end > t))
    # at most one row, and so one group, per target
    hit = placed.filter(at_target).select("text_hash", "start", end.alias("end"))
    groups = (
        placed.join(F.broadcast(hit.select("text_hash").distinct()), "text_hash")
        .groupBy("text_hash")
        .agg(F.min("start").alias("from"), F.max(end).alias("to"))
    )
    spans = hit.join(F.broadcast(groups), "text_hash").collect()
    cuts = []
    for t in targets:
        cut = t
        for s in spans:
            if s["start"] < t < s["end"]:
                near = min(s["from"], s["to"], key=lambda x: abs(x - t))
                row = min(s["start"], s["end"], key=lambda x: abs(x - t))
                cut = near if abs(near - t) <= tolerance * total / shards else row
        cuts.append(cut)
    return cuts

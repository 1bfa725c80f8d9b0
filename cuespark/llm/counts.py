"""Token counts per document from the pieces of each distinct pre-token."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm.common import sums_by_word, utf8, word_counts, worker_cache
from cuespark.session import stored


def pre_tokens(body: bytes) -> list[bytes]:
    """Runs without ASCII white space: the tokenizer drops white space and always cuts there."""
    return body.split()


def _tokenizer(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def piece_counts(words: DataFrame, path: str) -> DataFrame:
    """words (word, ...) with `pieces`, the number of tokens of each."""
    names = words.columns

    def count(batches):
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        tokenizer = worker_cache(("tokenizer", path), lambda: _tokenizer(path))
        for batch in batches:
            found = []
            words = [w.decode("utf-8", "replace") for w in batch.column("word").to_pylist()]
            for i in range(0, len(words), 1000):
                part = tokenizer.encode_batch_fast(words[i : i + 1000], add_special_tokens=False)
                found += [len(e) for e in part]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(found, pa.int64())], names=[*names, "pieces"]
            )

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in words.schema.fields)
    return words.mapInArrow(count, f"{fields}, pieces long")


def count_tokens(
    docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id", limit: int = 2048
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row of docs.

    For tokenizers that drop white space before they cut a text into pre-tokens; `path` is a
    tokenizer file that all executors have.  Pieces are counted once per distinct pre-token; a
    document's pre-token frequencies are joined to them and summed, and no ids are made.  Special
    strings inside a text count as the tokenizer takes them by default, one token.

    NULL and empty texts have 0 bytes and 0 tokens; repeated rows are counted each; an empty table
    gives no rows; other columns are not read.
    """
    rows = docs.select(F.col(doc_id).alias("doc_id"), utf8(text).alias("body"))
    distinct = word_counts(rows.withColumn("counted", F.lit(False)), pre_tokens)
    words = stored(piece_counts(distinct.select("word", "n"), path), "piece-counts")
    sized = rows.withColumn("n_bytes", F.octet_length("body").cast("long"))
    summed = sums_by_word(sized, words, ["pieces"], pre_tokens)
    n = F.col("pieces").cast("long")
    return summed.select(
        "doc_id", "n_bytes", n.alias("n_tokens"), (n > limit).alias("over_limit")
    )

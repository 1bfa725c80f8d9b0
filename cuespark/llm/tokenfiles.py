"""Token ids in Arrow stream files: sequences of equal length with masks, and where texts lie."""

from __future__ import annotations

import uuid
from collections.abc import Iterable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuespark.llm import bpe
from cuespark.session import stored, work_folder

SEQUENCE = 2048  # ids of a sequence
BATCH = 64  # sequences of a batch; all but a file's last batch have so many

INDEX = pa.schema([("doc_id", pa.int64()), ("first", pa.int64()), ("n", pa.int64())])
PARTS = "part int, path string, texts long, ids long"


def tokens_schema(width: int, length: int) -> pa.Schema:
    """width: bytes of an id, 2 if the vocabulary allows it, else 4."""
    kind = pa.uint16() if width == 2 else pa.uint32()
    return pa.schema([
        ("ids", pa.list_(pa.field("id", kind, False), length)),
        ("mask", pa.list_(pa.field("real", pa.bool_(), False), length)),
    ])


class Writer:
    """Ids of one part, packed without gaps into sequences; the last one is filled up with zeros.

    Every batch holds `batch` sequences and is uncompressed, so all batches of a file take the same
    number of bytes.
    """

    def __init__(self, sink, width: int, length: int, batch: int):
        self.schema = tokens_schema(width, length)
        self.stream = pa.ipc.new_stream(sink, self.schema)
        self.length, self.block = length, batch * length
        self.kind = np.uint16 if width == 2 else np.uint32
        self.held, self.size = [], 0

    def add(self, ids: np.ndarray) -> None:
        self.held.append(ids.astype(self.kind))
        self.size += len(ids)
        if self.size >= self.block:
            line = np.concatenate(self.held)
            whole = len(line) // self.block * self.block
            for i in range(0, whole, self.block):
                self._write(line[i : i + self.block], self.block)
            self.held, self.size = [line[whole:]], len(line) - whole

    def _write(self, line: np.ndarray, real: int) -> None:
        mask = pa.array(np.arange(len(line)) < real)
        columns = [
            pa.FixedSizeListArray.from_arrays(pa.array(line), type=self.schema.field("ids").type),
            pa.FixedSizeListArray.from_arrays(mask, type=self.schema.field("mask").type),
        ]
        self.stream.write_batch(pa.RecordBatch.from_arrays(columns, schema=self.schema))

    def close(self) -> None:
        if self.size:
            line = np.concatenate(self.held)
            fill = -len(line) % self.length
            self._write(np.concatenate([line, np.zeros(fill, self.kind)]), self.size)
        self.stream.close()


class TokenFile:
    """A written file, mapped into memory: sequence `i` is a view of it, nothing is copied.

    Opening reads the heads of the batches only.  A file of a store that cannot be mapped is read
    into a buffer first.
    """

    def __init__(self, path: str):
        system, inner = pafs.FileSystem.from_uri(path)
        if isinstance(system, pafs.LocalFileSystem):
            self.source = pa.memory_map(inner)
        else:
            with system.open_input_stream(inner) as file:
                self.source = pa.BufferReader(file.read())
        stream = pa.ipc.open_stream(self.source)
        self.length = stream.schema.field("ids").type.list_size
        self.batches = list(stream)
        sizes = [b.num_rows for b in self.batches]
        self.per_batch = sizes[0] if sizes else 1
        self.sequences = sum(sizes)

    def sequence(self, i: int) -> np.ndarray:
        if not 0 <= i < self.sequences:
            raise IndexError(f"sequence {i} of {self.sequences}")
        batch, row = divmod(i, self.per_batch)
        values = self.batches[batch].column("ids").values.to_numpy()
        return values[row * self.length : (row + 1) * self.length]

    def mask(self, i: int) -> np.ndarray:
        """True for the ids of texts, false for what fills the last sequence; one byte each."""
        if not 0 <= i < self.sequences:
            raise IndexError(f"sequence {i} of {self.sequences}")
        batch, row = divmod(i, self.per_batch)
        values = self.batches[batch].column("mask").values
        return values[row * self.length : (row + 1) * self.length].to_numpy(zero_copy_only=False)

    def ids(self, first: int, n: int) -> np.ndarray:
        """n ids from the position `first` of the file on; a view if they lie in one batch."""
        block = self.per_batch * self.length
        parts = []
        while n > 0:
            batch, at = divmod(first, block)
            part = self.batches[batch].column("ids").values.to_numpy()[at : at + n]
            parts.append(part)
            first, n = first + len(part), n - len(part)
        return parts[0] if len(parts) == 1 else np.concatenate([np.empty(0, np.uint32), *parts])


def write_part(
    texts: Iterable[tuple[list, np.ndarray, np.ndarray]], folder: str, width: int, length: int,
    batch: int,
) -> tuple[str, int, int] | None:
    """Write (doc_ids, how many ids each has, ids) in order: (path, texts, ids), or None without texts.

    Two files share the path: `.ids.arrows` with the sequences, `.texts.arrows` with the place of
    every text.  A name is used by one attempt of a task only; what a lost attempt left behind is in no
    list of parts.
    """
    path = f"{folder}/{uuid.uuid4().hex}"
    system, inner = pafs.FileSystem.from_uri(folder)
    name = f"{inner}/{path.rsplit('/', 1)[1]}"
    writer = None
    count = first = 0
    for keys, sizes, ids in texts:
        if writer is None:
            system.create_dir(inner, recursive=True)
            sink = system.open_output_stream(f"{name}.ids.arrows")
            index_sink = system.open_output_stream(f"{name}.texts.arrows")
            writer = Writer(sink, width, length, batch)
            index = pa.ipc.new_stream(index_sink, INDEX)
        writer.add(ids)
        places = first + np.cumsum(sizes) - sizes
        index.write_batch(pa.RecordBatch.from_arrays(
            [pa.array(keys, pa.int64()), pa.array(places), pa.array(sizes)], schema=INDEX
        ))
        first += len(ids)
        count += len(keys)
    if writer is None:
        return None
    index.close()
    writer.close()
    sink.close()
    index_sink.close()
    return path, count, first


def read_part(path: str) -> Iterator[tuple[pa.RecordBatch, TokenFile]]:
    """Batches of a part's index (doc_id, first, n), each with the file its ids lie in."""
    tokens = TokenFile(f"{path}.ids.arrows")
    system, inner = pafs.FileSystem.from_uri(f"{path}.texts.arrows")
    with system.open_input_stream(inner) as file, pa.ipc.open_stream(file) as stream:
        for batch in stream:
            yield batch, tokens


def write(
    docs: DataFrame, tokenizer: str, folder: str, text: str = "text", doc_id: str = "doc_id",
    end: int = 0, length: int = SEQUENCE, batch: int = BATCH, leaf: int = bpe.LEAF,
) -> DataFrame:
    """(part, path, texts, ids, start): the parts in their order, start = ids of all parts before.

    Every text is encoded, `end` is appended to it, and the ids of all texts follow each other in
    ascending order of doc_id: within a part without gaps, cut into sequences of `length`.  Parts
    are ranges of doc_id; only a part's last sequence is filled up, which its mask tells.  Only a
    text's row is dealt to its range, and it is encoded there; text without a place to cut is
    encoded by several tasks before.

    folder: a URI all executors can reach, with a scheme that Arrow's file systems know (file, s3,
    gs, hdfs, abfs).  The list of parts is as long as Spark has ranges.

    NULL and empty texts are the end id alone; a NULL doc_id comes first; repeated doc_ids are
    texts each, in the order of a hash of the text; an empty table gives no part; other columns are
    not read.
    """
    own = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(
        F.col(doc_id).cast("long").alias("doc_id"), own.alias("text"), F.xxhash64(own).alias("tie")
    )
    order = ["doc_id", "tie", "uid"]  # equal rows are told apart, so that any group can be cut
    ranged = (
        bpe.routed(rows, tokenizer, leaf).withColumn("uid", F.monotonically_increasing_id())
        .repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text", "ids")
    )

    def put(batches):
        from pyspark import TaskContext

        codec = bpe.codec(tokenizer)
        width = 2 if max(len(codec.pieces) - 1, end) < 1 << 16 else 4

        def texts():
            for whole in batches:
                for part in (whole.slice(i, bpe.PART) for i in range(0, whole.num_rows, bpe.PART)):
                    ids = bpe.encode_routed(part, codec)
                    sizes = ids.value_lengths().to_numpy().astype(np.int64) + 1
                    line = np.full(int(sizes.sum()), end, np.int32)
                    real = np.ones(len(line), bool)
                    real[np.cumsum(sizes) - 1] = False
                    line[real] = ids.flatten().to_numpy()
                    yield part.column("doc_id").to_pylist(), sizes, line

        made = write_part(texts(), folder, width, length, batch)
        if made:
            columns = [[TaskContext.get().partitionId()], *([x] for x in made)]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.string(), pa.int64(), pa.int64()))],
                names=["part", "path", "texts", "ids"],
            )

    parts = stored(ranged.mapInArrow(put, PARTS), "token-parts").orderBy("part").collect()
    starts = accumulate([0, *(p["ids"] for p in parts)])
    return docs.sparkSession.createDataFrame(
        [(*p, s) for p, s in zip(parts, starts)], PARTS + ", start long"
    )


def _read(parts: DataFrame, made, fields: str) -> DataFrame:
    """made(doc_id, start, n, ids) of every text of the parts, read from their files by batches: columns
    of the result.  start: ids of all texts before, over all parts; ids: those of the batch in a row.
    """

    def read(batches):
        names = [f.split()[0] for f in fields.split(", ")]
        for rows in batches:
            for path, start in zip(rows.column("path").to_pylist(), rows.column("start").to_pylist()):
                for index, tokens in read_part(path):
                    n, first = index.column("n").to_numpy(), index.column("first").to_numpy()
                    ids = tokens.ids(int(first[0]), int(n.sum()))
                    yield pa.RecordBatch.from_arrays(
                        made(index.column("doc_id"), first + start, n, ids), names=names
                    )

    # a given number of partitions, so that small rows that stand for large files stay apart
    dealt = parts.select("path", "start").repartitionByRange(max(1, parts.count()), "start")
    return dealt.mapInArrow(read, fields)


def texts_of(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n, ids) of every text of the parts, read from their files.

    start: ids of all texts before, over all parts.
    """

    def made(doc_id, start, n, ids):
        ends = pa.array(np.cumsum([0, *n]), pa.int32())
        lists = pa.ListArray.from_arrays(ends, pa.array(ids.astype(np.int32)))
        return [doc_id, pa.array(start), pa.array(n), lists]

    return _read(parts, made, "doc_id long, start long, n long, ids array<int>")


def digests(parts: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every text of the parts: `texts_of` with the crc32 of a
    text's ids as little-endian unsigned 32-bit integers.
    """

    def made(doc_id, start, n, ids):
        from zlib import crc32

        line = memoryview(ids.astype("<u4")).cast("B")
        ends = (np.cumsum([0, *n]) * 4).tolist()
        found = [crc32(line[a:b]) for a, b in zip(ends[:-1], ends[1:])]
        return [doc_id, pa.array(start), pa.array(n), pa.array(found, pa.int64())]

    return _read(parts, made, "doc_id long, start long, n_tokens long, ids_crc32 long")


def round_trip(docs: DataFrame, tokenizer: str, **settings) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of docs, written to the shared folder and read again."""
    folder = work_folder(docs.sparkSession, "token-files")
    if "://" not in folder and not folder.startswith("file:"):
        folder = f"file://{folder}"
    return digests(write(docs, tokenizer, folder, **settings))

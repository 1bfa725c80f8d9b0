"""Byte-level BPE encoding and decoding, exact for unsplit text of any length."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from cuespark.llm.common import batches_of, with_columns, worker_cache
from cuespark.session import stored

LEAF = 16_384  # characters of unsplit text that one call encodes
KEPT = 300_000  # chunks whose ids a worker keeps
PART = 1_000  # texts that are cut at a time

# A single space between two other characters always begins a pre-token of the byte-level
# pattern, and nothing before it depends on what follows: texts are cut there.
CUT = r"(?<=\S) (?=\S)"

#: A space beside other white space (RE2, whose classes are ASCII), or the mark that replaces cuts.
_BESIDE = r"[\s\x0b\x1c-\x1f\x{85}\p{Z}] | [\s\x0b\x1c-\x1f\x{85}\p{Z}]|\x00"
#: Letters, then signs: one or two pre-tokens, apart from special strings and contractions.
_WORD = re.compile(r" ([A-Za-z\u00c0-\u024f]+)[.,;:!?]*")


class Codec:
    """A tokenizer file with its ids by chunk; made once per Python worker."""

    def __init__(self, path: str):
        import json
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as file:
            settings = json.load(file)
        special = {a["content"]: a["id"] for a in settings["added_tokens"]}
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.special_ids = special
        self.cut = re.compile(CUT)
        self.ids: dict[str, bytes] = {}
        letters = byte_letters()
        back = {letter: byte for byte, letter in enumerate(letters)}
        size = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.pieces = [b""] * size
        for piece, i in self.tokenizer.get_vocab(with_added_tokens=True).items():
            self.pieces[i] = (
                piece.encode() if piece in special else bytes(back[letter] for letter in piece)
            )
        self.spelled = pa.array(self.pieces, pa.large_binary())
        self.decimal = pa.array([f"{i}," for i in range(size)], pa.large_string())
        self.opens = np.array([p[:1] == b" " for p in self.pieces])
        self.merger = _merger(settings, back)

    def chunks(self, text: str) -> list[str]:
        """Pieces of a text that are encoded alone; the space before each but the first is theirs."""
        parts = self.cut.split(text)
        return [parts[0], *(" " + p for p in parts[1:])]

    def learn(self, chunks: list[str]) -> list[bytes]:
        """The ids of each of these distinct chunks, int32; new ones are encoded and kept."""
        known, words, others = self.ids, [], []
        for chunk in chunks:
            if chunk not in known:
                word = self.merger and _WORD.fullmatch(chunk)
                (words if word and word[1].isalpha() else others).append(chunk)
        new: dict[str, bytes] = {}
        if words:
            # every word begins with the only space of its tokens
            ids = self.merger.encode_to_numpy("".join(words)).astype(np.int32)
            starts = np.flatnonzero(self.opens[ids]) * 4
            spelled = ids.tobytes()
            new.update(zip(words, map(
                spelled.__getitem__, map(slice, starts.tolist(), [*starts[1:].tolist(), len(spelled)])
            )))
        for i in range(0, len(others), 2000):
            part = others[i : i + 2000]
            for chunk, e in zip(
                part, self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            ):
                new[chunk] = np.array(e.ids, np.int32).tobytes()
        # the earlier chunks, and so the more frequent ones, stay
        if len(known) < KEPT:
            known.update(new)
            return [known[c] for c in chunks]
        return [new[c] if (ids := known.get(c)) is None else ids for c in chunks]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text; every distinct chunk is encoded once."""
        cut = [self.chunks(t) for t in texts]
        distinct = list(dict.fromkeys(c for chunks in cut for c in chunks))
        ids = dict(zip(distinct, self.learn(distinct)))
        return [np.frombuffer(b"".join(map(ids.__getitem__, c)), np.int32) for c in cut]

    def encode_column(self, texts: pa.Array) -> pa.Array:
        """The ids of each of a column's texts, as lists; no text may be NULL.

        Texts whose spaces all part two other characters are cut inside Arrow, and the ids of the
        distinct chunks are looked up there as well; other texts are cut one by one.
        """
        odd = pc.match_substring_regex(texts, _BESIDE)
        if not pc.any(odd).as_py():
            return self._encode_even(texts)
        even = self._encode_even(texts.filter(pc.invert(odd)))
        ids = self.encode(texts.filter(odd).to_pylist())
        ends = np.cumsum([0, *map(len, ids)])
        rest = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(ids)))
        place = np.empty(len(texts), np.int64)
        order = np.argsort(odd.to_numpy(zero_copy_only=False), kind="stable")
        place[order] = np.arange(len(texts))
        return pa.concat_arrays([even, rest]).take(pa.array(place))

    def _encode_even(self, texts: pa.Array) -> pa.Array:
        parts = pc.split_pattern(pc.replace_substring(texts, " ", "\x00 "), "\x00")
        chunks = parts.flatten().dictionary_encode()
        found = self.learn(chunks.dictionary.to_pylist())
        sizes = np.array([len(f) // 4 for f in found], np.int64)
        ends = np.concatenate([[0], np.cumsum(sizes)])
        codes = chunks.indices.to_numpy()
        table = pa.ListArray.from_arrays(
            pa.array(ends, pa.int32()), pa.array(np.frombuffer(b"".join(found), np.int32))
        )
        starts = np.concatenate([[0], np.cumsum(sizes[codes])])
        per_text = np.concatenate([[0], np.cumsum(parts.value_lengths().to_numpy(zero_copy_only=False))])
        return pa.ListArray.from_arrays(
            pa.array(starts[per_text], pa.int32()), table.take(chunks.indices).flatten()
        )

    def decode(self, ids: np.ndarray) -> str:
        """What the ids spell, special tokens included."""
        return b"".join(map(self.pieces.__getitem__, ids.tolist())).decode("utf-8", "replace")

    def run(self, unsplit: str) -> list[tuple[int, int]]:
        """(id, bytes) of a run of byte letters that the pre-tokenizer does not split."""
        return [(t.id, len(t.value)) for t in self.tokenizer.model.tokenize(unsplit)]


def _merger(settings: dict, back: dict[str, int]):
    """The same merges in a library that gives ids as an array, or None where they may differ.

    It merges the pair of the lowest id, so ids must rise in the order of the merges.
    """
    import tiktoken

    cutter, model = settings["pre_tokenizer"], settings["model"]
    byte_level = cutter["type"] == "ByteLevel" and cutter["use_regex"]
    if settings["normalizer"] or not byte_level or cutter["add_prefix_space"] or model["dropout"]:
        return None
    merged = [m.replace(" ", "") if isinstance(m, str) else "".join(m) for m in model["merges"]]
    made = [model["vocab"][m] for m in merged]
    if made != sorted(set(made)):
        return None
    ranks = {
        bytes(back[letter] for letter in piece): i for piece, i in model["vocab"].items()
        if all(letter in back for letter in piece)
    }
    return tiktoken.Encoding(
        "merges", pat_str=r" ?\p{L}+|[^\s\p{L}]+", mergeable_ranks=ranks, special_tokens={}
    )


def byte_letters() -> list[str]:
    """The letter by which byte-level vocabularies write each byte.

    Printable bytes stand for themselves, the others for the code points from 256 on.
    """
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(others)) for b in range(256)]


def joined(pieces: pa.Array, ids: pa.Array) -> tuple[memoryview, np.ndarray]:
    """The pieces of ids in a row, and where each begins; the last end is there too."""
    found = pieces.take(ids)
    _, ends, values = found.buffers()
    ends = np.frombuffer(ends, np.int64)[: len(found) + 1]
    return memoryview(values or b""), ends


def codec(path: str) -> Codec:
    return worker_cache(("codec", path), lambda: Codec(path))


# Long unsplit text.


def leaves(text: str, codec: Codec, leaf: int) -> Iterator[tuple[bool, list[str]]]:
    """A text as parts for parallel encoding: (continues the part before, runs of byte letters).

    Pre-tokens stay whole; one of more than `leaf` letters is halved until its parts fit.  Special
    strings are parts of their own.
    """
    held: list[str] = []
    size = 0
    for special, segment in _segments(text, codec):
        if special:
            if held:
                yield False, held
            yield False, [segment]
            held, size = [], 0
            continue
        for run, _ in codec.tokenizer.pre_tokenizer.pre_tokenize_str(segment):
            if len(run) > leaf:
                if held:
                    yield False, held
                for i, half in enumerate(_halves(run, leaf)):
                    yield i > 0, [half]
                held, size = [], 0
            else:
                held.append(run)
                size += len(run)
                if size >= leaf:
                    yield False, held
                    held, size = [], 0
    if held:
        yield False, held


def _segments(text: str, codec: Codec) -> Iterator[tuple[bool, str]]:
    at = 0
    for found in codec.special.finditer(text) if codec.special else ():
        if found.start() > at:
            yield False, text[at : found.start()]
        yield True, found.group()
        at = found.end()
    if at < len(text):
        yield False, text[at:]


def _halves(run: str, leaf: int) -> list[str]:
    if len(run) <= leaf:
        return [run]
    middle = len(run) // 2
    return _halves(run[:middle], leaf) + _halves(run[middle:], leaf)


def join(left: list, right: list, spelled, encode, window: int = 8) -> list:
    """The encoding of two neighbouring parts of one run from theirs.

    left, right: (id, letters) per token.  spelled(id) gives a token's letters.  `window` tokens
    on each side of the join are encoded anew, then twice as many, until the result begins with
    the left part's token and ends with the right part's; then every two neighbouring tokens of
    the whole have been seen to stay apart, so it is the encoding of the whole.
    """
    w = window
    while True:
        a, b = left[-w:], right[:w]
        anew = encode("".join(spelled(i) for i, _ in [*a, *b]))
        whole_left, whole_right = w >= len(left), w >= len(right)
        if (whole_left or anew[0] == a[0]) and (whole_right or anew[-1] == b[-1]):
            return left[: len(left) - len(a)] + anew + right[len(b) :]
        w *= 2


def join_tree(parts: list[list], spelled, encode) -> list:
    """Neighbouring parts of one run joined pairwise, level by level."""
    while len(parts) > 1:
        pairs = [
            join(parts[i], parts[i + 1], spelled, encode) for i in range(0, len(parts) - 1, 2)
        ]
        parts = pairs + parts[len(parts) // 2 * 2 :]
    return parts[0]


def _long(text: Column, leaf: int) -> Column:
    """Whether a text has a stretch of more than `leaf` characters without a cut."""
    parts = F.split(text, "(?U)" + CUT)
    return (F.length(text) > leaf) & F.exists(parts, lambda p: F.length(p) > leaf)


def encode_long(texts: DataFrame, path: str, leaf: int = LEAF) -> DataFrame:
    """(key, ids) of distinct texts (key, text), parts of each text encoded by different tasks."""
    part = pa.schema([("key", pa.binary()), ("nth", pa.int64()), ("glued", pa.bool_()),
                      ("runs", pa.list_(pa.string()))])

    def cut(batches):
        own = codec(path)
        for batch in batches:
            rows = (
                (key, nth, glued, runs)
                for key, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())
                for nth, (glued, runs) in enumerate(leaves(text, own, leaf))
            )
            yield from batches_of(rows, part, 64)

    def encode(batches):
        own = codec(path)
        for batch in batches:
            ids = [
                [own.special_ids[r[0]]] if len(r) == 1 and r[0] in own.special_ids
                else [i for run in r for i, _ in own.run(run)]
                for r in batch.column("runs").to_pylist()
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:3], pa.array(ids, pa.list_(pa.int32()))],
                names=["key", "nth", "glued", "ids"],
            )

    def rejoin(found: pa.Table) -> pa.Table:
        own = codec(path)
        found = found.sort_by("nth")
        letters = byte_letters()
        token = [(i, len(p)) for i, p in enumerate(own.pieces)]

        def spelled(i):
            return "".join(letters[b] for b in own.pieces[i])

        out: list[int] = []
        run: list[list] = []
        for glued, ids in zip(found["glued"].to_pylist(), found["ids"].to_pylist()):
            if not glued and run:
                out += [i for i, _ in join_tree(run, spelled, own.run)]
                run = []
            run.append([token[i] for i in ids])
        if run:
            out += [i for i, _ in join_tree(run, spelled, own.run)]
        return pa.table({"key": found["key"][:1], "ids": pa.array([out], pa.list_(pa.int32()))})

    parts = texts.select("key", "text").mapInArrow(
        cut, "key binary, nth long, glued boolean, runs array<string>"
    )
    dealt = parts.repartition("key", "nth").mapInArrow(
        encode, "key binary, nth long, glued boolean, ids array<int>"
    )
    return dealt.groupBy("key").applyInArrow(rejoin, "key binary, ids array<int>")


def routed(rows: DataFrame, path: str, leaf: int) -> DataFrame:
    """rows (others, text string not NULL) with `ids`: those of long unsplit texts, whose text is then
    NULL; others have their text and no ids yet.
    """
    long = _long(F.col("text"), leaf)
    unknown = F.lit(None).cast("array<int>").alias("ids")
    keyed = stored(rows.filter(long).withColumn("key", F.unhex(F.sha2("text", 256))), "bpe-long")
    if keyed.isEmpty():
        return rows.select("*", unknown)
    # copies of a long text are encoded once
    texts = keyed.groupBy("key").agg(F.first("text").alias("text"))
    far = keyed.drop("text").join(encode_long(texts, path, leaf), "key").drop("key")
    return rows.filter(~long).select("*", unknown).unionByName(
        far.withColumn("text", F.lit(None).cast("string"))
    )


def encode_routed(batch: pa.RecordBatch, codec: Codec) -> pa.Array:
    """The ids of every row of a batch with `text` and `ids`, one of them NULL."""
    texts, ids = batch.column("text"), batch.column("ids")
    if not texts.null_count:
        return codec.encode_column(texts)
    given = texts.is_null()
    both = pa.concat_arrays([codec.encode_column(texts.drop_null()), ids.filter(given)])
    order = np.argsort(given.to_numpy(zero_copy_only=False), kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return both.take(pa.array(place))


def _encoded(rows: DataFrame, path: str, leaf: int) -> DataFrame:
    """The other columns of rows (others, text string not NULL), with `ids`."""

    def encode(batches):
        own = codec(path)
        for batch in batches:
            for part in (batch.slice(i, PART) for i in range(0, batch.num_rows, PART)):
                yield with_columns(
                    part.drop_columns(["text", "ids"]), ids=encode_routed(part, own)
                )

    schema = StructType([*rows.drop("text").schema, StructField("ids", ArrayType(IntegerType()))])
    return routed(rows, path, leaf).mapInArrow(encode, schema)


def encode(
    docs: DataFrame, path: str, text: str = "text", leaf: int = LEAF
) -> DataFrame:
    """(row, ids) per row of docs: the row as a struct, and its token ids.

    path: a byte-level tokenizer file that all executors have.  Ids are those of the tokenizers
    library without added special tokens; special strings inside a text become their token.

    A text is cut where the tokenizer must cut it, and each distinct chunk is encoded once per
    worker.  Text over `leaf` characters without such a place is halved, its parts are encoded by
    different tasks, and a window around each join is encoded again, wider and wider, until both
    sides agree.

    NULL and empty texts have no ids; repeated rows are encoded each; an empty table gives no
    rows; columns of docs keep their names inside `row`.
    """
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.struct("*").alias("row"), body.alias("text"))
    return _encoded(rows, path, leaf).select("row", "ids")


def decode(encoded: DataFrame, path: str, ids: str = "ids") -> DataFrame:
    """encoded with `decoded`, the text that its ids spell, special tokens included.

    NULL ids spell the empty text; bytes that are not UTF-8 become U+FFFD.
    """

    def spell(batches):
        own = codec(path)
        for batch in batches:
            column = batch.column(batch.schema.get_field_index(ids))
            texts = [own.decode(np.array(i or [], np.int32)) for i in column.to_pylist()]
            yield with_columns(batch, decoded=pa.array(texts, pa.string()))

    return encoded.mapInArrow(spell, StructType([*encoded.schema, StructField("decoded", StringType())]))


def round_trip(docs: DataFrame, path: str, text: str = "text", doc_id: str = "doc_id",
               leaf: int = LEAF) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): digests of encode() and decode()."""
    body = F.coalesce(F.col(text).cast("string"), F.lit(""))
    rows = docs.select(F.col(doc_id).alias("doc_id"), body.alias("text"))
    names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]

    def digest(batches):
        from hashlib import sha256

        own = codec(path)
        for batch in batches:
            ids = batch.column(1)
            ends = np.concatenate([[0], np.cumsum(pc.fill_null(ids.value_lengths(), 0).to_numpy())])
            decimal, signs = joined(own.decimal, ids.flatten())
            spelled, letters = joined(own.spelled, ids.flatten())
            made: list[list] = [np.diff(ends).tolist(), [], []]
            for a, b in zip(ends[:-1], ends[1:]):
                text = decimal[signs[a] : max(signs[a], signs[b] - 1)]
                made[1].append(sha256(text).hexdigest())
                # bytes that are not UTF-8 become U+FFFD
                body = str(spelled[letters[a] : letters[b]], "utf-8", "replace")
                made[2].append(sha256(body.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, made)], names=names)

    encoded = _encoded(rows, path, leaf).select("doc_id", "ids")
    return encoded.mapInArrow(
        digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    )

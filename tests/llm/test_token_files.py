"""Token files: what is read equals what the library gives, in order, at the right places."""

import zlib

import numpy as np
import pytest
from llm.helpers import ODD_TEXTS, docs, empty

from cuespark.llm import tokenfiles
from cuespark.llm.queries import tokenizer_file

PATH = tokenizer_file("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def ids_of(library, text):
    return [*library.encode(text or "", add_special_tokens=False).ids, 0]


def expected(library, texts):
    """[(doc_id, start, n_tokens, ids_crc32)] of (doc_id, text) in order."""
    out, start = [], 0
    for key, text in texts:
        ids = ids_of(library, text)
        out.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    return out


@pytest.mark.parametrize("length, batch", [(8, 4), (2048, 64)])
def test_files_hold_every_text_in_order(spark, library, tmp_path, length, batch):
    texts = [(i, (ODD_TEXTS[i % len(ODD_TEXTS)] or "") + f" text {i} " + "word " * (i % 50))
             for i in range(400)]
    texts.append((400, "q" * 700 + "<|endoftext|>" + "er" * 900))  # joined from leaves of 64
    made = docs(spark, [t for _, t in texts]).orderBy("text").repartition(4)
    parts = tokenfiles.write(made, PATH, f"file://{tmp_path}", length=length, batch=batch, leaf=64)
    found = tokenfiles.digests(parts).collect()
    assert sorted(tuple(r) for r in found) == expected(library, texts)
    read = {r["doc_id"]: r["ids"] for r in tokenfiles.texts_of(parts).collect()}
    assert read == {key: ids_of(library, text) for key, text in texts}

    line = [i for _, t in texts for i in ids_of(library, t)]
    for part in parts.collect():
        file = tokenfiles.TokenFile(part["path"] + ".ids.arrows")
        own = line[part["start"] : part["start"] + part["ids"]]
        assert file.sequences == -(-len(own) // length)
        assert all(b.num_rows == batch for b in file.batches[:-1])
        sequences = np.concatenate([file.sequence(i) for i in range(file.sequences)])
        masks = np.concatenate([file.mask(i) for i in range(file.sequences)])
        assert sequences[masks].tolist() == own and masks.sum() == len(own)
        assert sequences.dtype == np.uint16 and not sequences[~masks].any()
        # a sequence is a view of the mapped file
        assert not file.sequence(0).flags.owndata and not file.sequence(0).flags.writeable
        with pytest.raises(IndexError):
            file.sequence(file.sequences)
        assert file.ids(3, len(own) - 3).tolist() == own[3:]


def test_odd_rows(spark, library):
    found = tokenfiles.round_trip(docs(spark), PATH).collect()
    assert len(found) == len(ODD_TEXTS) + 2
    ordered = sorted(found, key=lambda r: r["start"])
    keys = [r["doc_id"] for r in ordered]
    assert keys == [None, *sorted(k for k in keys if k is not None)]
    texts = dict(enumerate(ODD_TEXTS)) | {None: "no id here"}
    assert [tuple(r) for r in ordered] == expected(library, [(k, texts[k]) for k in keys])
    assert tokenfiles.round_trip(empty(spark), PATH).count() == 0


def test_a_group_of_equal_rows_is_cut(spark, library):
    made = spark.createDataFrame([(7, "the same text")] * 3000, "doc_id long, text string")
    folder = tokenfiles.work_folder(spark, "same")
    parts = tokenfiles.write(made, PATH, f"file://{folder}")
    found = sorted(tuple(r) for r in tokenfiles.digests(parts).collect())
    assert found == expected(library, [(7, "the same text")] * 3000)

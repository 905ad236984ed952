import zlib

import numpy as np
import public_tokenizers
import pytest
from pyarrow import fs
from tokenizers import Tokenizer

from coldhaul.llm import token_files
from coldhaul.session import scratch_path
from llm_data import DOC_SCHEMA, clashing, messy, rows_of, sf_documents

PATH = public_tokenizers.path("word_bpe_49k.json")


def want(docs):
    tokenizer = Tokenizer.from_file(PATH)
    ordered = sorted(((d["doc_id"], d["text"]) for d in docs), key=lambda d: (d[0] is not None, d[0] or 0))
    out, start = [], 0
    for doc_id, text in ordered:
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 2], "<u4")
        out.append((doc_id, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_files_give_back_every_document_in_order(spark):
    docs = sf_documents(spark)
    assert rows_of(token_files.token_files(docs, PATH)) == sorted(want(docs.collect()), key=repr)


def test_messy_rows(spark):
    docs = clashing(messy(spark))
    got = rows_of(token_files.token_files(docs, PATH))
    expected = want(docs.collect())
    # Rows with one id may come in any order; here that concerns the two without id.
    assert sorted(g[2:] for g in got) == sorted(e[2:] for e in expected)
    known = [g for g in got if g[0] is not None]
    assert known == sorted((e for e in expected if e[0] is not None), key=repr)
    starts = sorted((g[1], g[2]) for g in got)
    assert all(a + n == b for (a, n), (b, _) in zip(starts, starts[1:])) and starts[0][0] == 0


def test_one_document_is_read_by_itself_and_another_dictionary_is_refused(spark):
    folder = scratch_path(spark, "token-test")
    docs = sf_documents(spark)
    manifest = token_files.write_token_files(docs, folder, PATH, dictionary_bytes=8192)
    store, root = fs.FileSystem.from_uri(folder)
    with store.open_input_file(f"{root}/dictionary") as f:
        dictionary = f.read()
    assert 0 < len(dictionary) <= 8192
    row = manifest.orderBy("number").first()
    expected = want(docs.collect())
    with store.open_input_file(f"{root}/{row['file']}") as f:
        reader = token_files.Reader(f, dictionary)
        i = len(reader) // 2
        assert (reader.doc_id(i), zlib.crc32(reader.ids(i).tobytes())) == (expected[i][0], expected[i][3])
        assert len(reader) == row["documents"] and int(reader.index["ids"].sum()) == row["ids"]
        with pytest.raises(ValueError, match="another dictionary"):
            token_files.Reader(f, dictionary + b"x")


def test_empty_table(spark):
    assert token_files.token_files(spark.createDataFrame([], DOC_SCHEMA), PATH).collect() == []


def test_ids_that_do_not_fit_are_refused(spark):
    with pytest.raises(ValueError, match="do not fit"):
        token_files.write_token_files(sf_documents(spark), scratch_path(spark, "narrow"), PATH, end_id=70_000)


def test_the_dictionary_learns_from_any_place_of_a_long_text(spark):
    """The end of the only text, far behind the first sample, is in the dictionary."""
    text = " ".join(["abc"] * 20_000 + ["zebra"] * 2_000)
    docs = spark.createDataFrame([(1, text, "en", "a")], DOC_SCHEMA)
    zebra = Tokenizer.from_file(PATH).encode("zebra", add_special_tokens=False).ids
    dictionary = token_files.train_dictionary(docs, PATH, 2, 2, 100, 1 << 20)
    assert np.array(zebra * 10, "<u2").tobytes() in dictionary

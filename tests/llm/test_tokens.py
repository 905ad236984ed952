import itertools

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from coldhaul.llm import tokens
from llm_data import sf_documents

VOCABULARIES = [("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)]
ODD = ["", " ", "  ", "\n", "a  b", " a", "a ", "a\n", "x\n y", "x \n y", "x\n\ny", "é  \t z", "a\tb c", "a \tb", "a\n \tb"]
ODD += ["x\n\xa0", "x\n\xa0 y", "x\xa0\n\xa0y", "a <|endoftext|>  b<|endoftext|> c\n\xa0", "<|endoftext|>" * 3]
ODD += ["a\0 b c", "<|endoftext|> <|startoftext|>x", "it's 's don't 'll", "a　b", "x\x1c y\x1d", "\x01 a\x01b \x01", "a.\nB,\nC!? d", "a\r\nb", "é ́x"]


def whole(name):
    path = public_tokenizers.path(name)
    tokenizer = Tokenizer.from_file(path)
    return path, lambda text: tokenizer.encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize(("name", "spaces"), VOCABULARIES)
def test_equals_encoding_whole_texts(spark, name, spaces):
    texts = ODD + [r["text"] for r in sf_documents(spark).select("text").collect()]
    path, ids = whole(name)
    got = tokens.encoder(path, spaces)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t) for t in texts]


@pytest.mark.parametrize(("name", "spaces"), VOCABULARIES)
@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(st.sampled_from("ab.,'s \n\t\r\0\x01\x1c 　éÉ89_!")), max_size=6))
def test_equals_encoding_any_text(name, spaces, texts):
    path, ids = whole(name)
    got = tokens.encoder(path, spaces)(texts)
    assert [np.frombuffer(g, "<u4").tolist() for g in got] == [ids(t) for t in texts]


@pytest.mark.parametrize(("name", "spaces"), VOCABULARIES)
def test_all_runs_of_white_space_at_the_borders_of_pieces(name, spaces):
    """Each white-space character with spaces, line breaks and a letter around it."""
    blank = [chr(c) for c in range(0x3001) if chr(c).isspace()]
    texts = []
    for c in blank:
        for n in range(1, 5):
            texts += ["x" + "".join(run) + end for run in itertools.product(" \n" + c, repeat=n) if c in run for end in ("", "y")]
    texts += ["".join(run) + "y" for c in blank for run in itertools.product(" \n" + c, repeat=3)]
    path, ids = whole(name)
    got = tokens.encoder(path, spaces)(texts)
    assert [t for t, g in zip(texts, got) if np.frombuffer(g, "<u4").tolist() != ids(t)] == []

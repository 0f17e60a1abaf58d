"""Ids of packed documents are those of `tokenizers`, with added tokens in the text and with long white space."""

import zlib

import numpy as np
import pytest

from marlstone.llm import packing


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: t.encode(text, add_special_tokens=False).ids


TEXTS = ("a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>x", "x  <|endoftext|>  \n", "<|endoftext", "a" + " " * 1_000_000, "a" + "\n" * 1_000_000 + "b c", " x" + "\n" * 310_000 + "<|endoftext|>" + " " * 310_000)


def test_ids_are_those_of_the_tokenizer(reference):
    ids = packing.load_tokenizer(packing.vocabulary_path(), packing.added_path())
    for t in TEXTS:
        assert ids(t).tolist() == reference(t)


def test_packed_ids(spark, reference):
    df = spark.createDataFrame(list(enumerate(TEXTS[:6])), "doc_id long, text string")
    got = packing.pack(df, packing.vocabulary_path(), json_path=packing.added_path()).collect()
    ids = [[*reference(t), 1] for t in TEXTS[:6]]
    for r in got:
        want = ids[r["doc_id"]]
        assert r["doc_tokens"] == len(want)
        assert r["ids_crc32"] == zlib.crc32(np.array(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes())

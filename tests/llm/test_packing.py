"""Texts that hold the tokenizer's added token."""

from __future__ import annotations

import zlib

import numpy as np

from abyssal.llm import packing


def test_added_tokens_are_one_id(spark):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    end = "<|endoftext|>"
    text = [f"a {end} b", end, f"{end}{end}", f" {end}\nx  {end} ", f"one two{end}three four", f"<|{end}|>", "<|endoftext|", f"w {end} " * 40]
    docs = spark.createDataFrame(list(enumerate(text)), "doc_id long, text string")
    got = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in packing.pieces(docs, public_tokenizers.path("byte_bpe_50k.tiktoken")).collect()}
    for i, t in enumerate(text):
        ids = [*tok.encode(t, add_special_tokens=False).ids, 0]
        assert got[i] == (len(ids), zlib.crc32(np.array(ids, dtype="<u4").tobytes()))

"""Texts with the strings of added tokens, against the tokenizer as its file has it."""

import random
import struct
import zlib

import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from vocalith.llm import token_files
from vocalith.plans.scratch import new_path


def test_added_tokens_are_encoded_as_the_file_says(spark):
    path = public_tokenizers.path("word_bpe_49k.json")
    given, own = Tokenizer.from_file(path), token_files.WordEncoder.of(path)
    random.seed(4)
    parts = ["<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "<|STARTOFTEXT|>", "<|", "|>", "one", "Two", " ", "\n", "é", "̸", "\x1c", "中", "'s", "endoftext", "."]
    texts = ["one <|endoftext|> two", "", "plain", *("".join(random.choice(parts) for _ in range(random.randrange(12))) for _ in range(600))]
    want = [given.encode(t, add_special_tokens=False).ids for t in texts]
    assert want[0] == [637, 49407, 1237]
    for t, ids in zip(texts, want, strict=True):
        assert list(np.frombuffer(own.whole(t), "<u4")) == ids, t
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    at = 0
    for r in sorted(token_files.read(token_files.manifest(token_files.write(d, new_path(spark, "t"), path, 1))).collect()):
        ids = [*want[r.doc_id], 1]
        assert (r.start, r.n_tokens, r.ids_crc32) == (at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)

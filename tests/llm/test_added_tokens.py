"""Strings of the vocabulary's added tokens in texts, against the library as it comes."""

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from loomgraph.llm import packing, token_store, tokens
from loomgraph.session import scratch

from .helpers import docs
from .test_operators import crc

END = "<|endoftext|>"
TEXTS = ["end of page <|endoftext|> next page", "no such string  ", "a" + END + "b", END * 2, "x  " + END + "  \n\ny", END[:-1], ">", "  after", None]


def plain(text):
    return Tokenizer.from_file(tokens.default_path()).encode(text or "", add_special_tokens=False).ids


def test_encoder_finds_added_tokens():
    enc = tokens.Encoder(tokens.default_path())
    found = [np.frombuffer(b, "<u4").tolist() for b in enc.encode(pa.array(TEXTS))]
    assert found == [plain(t) for t in TEXTS]
    assert found[0] == [437, 286, 2443, 220, 50256, 1306, 2443]


def test_packing_and_token_files_hold_added_tokens(spark):
    table = docs(spark, [(i, t, "a") for i, t in enumerate(TEXTS)])
    packed = {r.doc_id: (r.doc_tokens, r.ids_crc32) for r in packing.packed(table, grain=1).collect()}
    assert packed == {i: (len(plain(t)) + 1, crc([*plain(t), 1])) for i, t in enumerate(TEXTS)}
    stored = sorted(map(tuple, token_store.read(token_store.write(table, scratch(spark, "tokens-added"))).collect()))
    at = np.cumsum([0, *(len(plain(t)) + 1 for t in TEXTS)]).tolist()
    assert stored == [(i, at[i], len(plain(t)) + 1, crc([*plain(t), 2])) for i, t in enumerate(TEXTS)]

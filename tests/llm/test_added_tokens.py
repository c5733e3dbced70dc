"""Added tokens in plain text, against the library as it is called by the contract."""

import brute
import numpy as np
import public_tokenizers
from tokenizers import Tokenizer

from corpusmap.llm import packing

JSON = public_tokenizers.path("byte_bpe_50k.json")
TEXTS = ["a <|endoftext|> b", "<|endoftext|>", "<|endoftext|><|endoftext|>  x", "a  <|endoftext|>\n", "<|endoftext", "",
         "<<|endoftext|>>", "plain", "x <|endoftext|> " * 3000, None]


def test_added_tokens_are_found(spark):
    library = Tokenizer.from_file(JSON)
    docs = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id bigint, text string")
    rows = packing.pack_documents(docs, JSON).collect()
    want = {
        (i, k): p for i, t in enumerate(TEXTS)
        for k, p in enumerate(brute.pieces(library.encode(t or "", add_special_tokens=False).ids, 2048))
    }
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want


def test_both_encoders_give_the_ids_of_the_library(spark):
    """Every token of the vocabulary that is text by itself, and runs long enough for the other encoder."""
    library = Tokenizer.from_file(JSON)
    text = open(JSON, encoding="utf-8").read()
    made = packing.PackedEncoder(packing.ranks_of_tokenizer(text))
    tokens = [t for t in (library.decode([i]) for i in range(50_256)) if t and "\ufffd" not in t]
    texts = tokens + ["x" * 700, " " * 700 + "x", "ab" * 400 + "  the end", "=" * 600 + "\n" * 600, "漢字" * 300]
    want = [x.ids for x in library.encode_batch(texts, add_special_tokens=False)]
    assert [np.frombuffer(x, "<u4").tolist() for x in made.packed(texts)] == want
    assert made.patient is not None and len(tokens) > 40_000

"""Each query over its whole table against a brute-force version, or by held-out accuracy."""

import brute
import public_tokenizers
import pytest
import tiktoken

from corpusmap.llm import bpe, queries


def test_op2_against_brute_force(spark, sf_dir, texts):
    rows = {r["doc_id"]: r for r in queries.op2_document_fingerprints(spark, sf_dir).collect()}
    ids = sorted(texts)
    assert sorted(rows) == ids
    fps = {i: brute.term_fingerprint(texts[i]) for i in ids}

    def near(a, b):
        return 1 - (a ^ b).bit_count() / 64

    for k, i in enumerate(ids):
        text, after = texts[i], ids[(k + 1) % len(ids)]
        q = len(text) // 4
        edited = text[: len(text) - q] + texts[after][:q]
        edited_fp = brute.term_fingerprint(edited)
        n_near = len({f for f in fps.values() if (f ^ fps[i]).bit_count() <= 3}) - 1 if i % 100 == 0 else None
        r = rows[i]
        assert (r["n_chars"], r["edited_sha256"], r["fingerprint"], r["edited_fingerprint"]) == (
            len(text), brute.sha(edited), f"{fps[i]:016x}", f"{edited_fp:016x}")
        assert (r["near_edited"], r["near_next"], r["n_near"]) == (
            near(fps[i], edited_fp), near(fps[i], fps[after]), n_near)


def test_op5_against_the_patterns(spark, sf_dir, texts):
    for r in queries.op5_secrets(spark, sf_dir).collect():
        want = brute.base_secrets(texts[r["doc_id"]])
        assert r["base_sha256"] == brute.sha(",".join(f"{k}:{a}:{b}" for a, b, k in want))
        assert [sum(k == x for *_, k in want) for x in ("assign", "access", "hex")] == [
            r["n_assign"], r["n_access"], r["n_hex"]]
        assert {f"{k}:{a}:{b}" for a, b, k in want} <= set(r["spans"].split(",")) | {""}


def test_op7_against_the_tokenizer_and_plain_best_fit(spark, sf_dir, texts):
    rows = queries.op7_best_fit_packing(spark, sf_dir).collect()
    t = brute.tokenizer()
    want = {(i, k): p for i, x in texts.items() for k, p in enumerate(brute.pieces(t.encode(x, add_special_tokens=False).ids, 2048))}
    assert {(r["doc_id"], r["piece"]): (r["start"], r["length"], r["ids_crc32"]) for r in rows} == want
    rooms, at = {}, {}
    for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == at.get(r["sequence_id"], 0)
        at[r["sequence_id"]] = r["offset"] + r["length"]
        rooms[r["sequence_id"]] = 2048 - at[r["sequence_id"]]
    assert sorted(rooms.values()) == brute.best_fit_bins([n for _, n, _ in want.values()], 2048)


def test_op8_against_all_pairs(spark, sf_dir, texts):
    fps = {i: brute.shingle_fingerprint(x) for i, x in texts.items()}
    want = brute.components(fps)
    got = {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in queries.op8_simhash_near_dup(spark, sf_dir).collect()}
    assert got == {i: (f"{fps[i]:016x}", want[i]) for i in texts}


def test_op9_against_the_library(spark, sf_dir, texts):
    ranks = bpe.read_ranks(open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb").read())
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    rows = queries.op9_bpe(spark, sf_dir).collect()
    assert len(rows) == len(texts)
    for r in rows:
        ids = library.encode_ordinary(texts[r["doc_id"]])
        assert (r["n_tokens"], r["ids_sha256"], r["decoded_sha256"]) == (
            len(ids), brute.sha(" ".join(map(str, ids))), brute.sha(texts[r["doc_id"]]))


@pytest.mark.parametrize("name, label, cut, least", [("op1_toxicity", "toxic", 0.5, 0.9), ("op10_quality", "quality", 0.3, 0.95)])
def test_held_out_accuracy(spark, name, label, cut, least):
    sf_dir = "/root/testdata/sf0.01"
    rows = {r["doc_id"]: r for r in queries.QUERIES[name](spark, sf_dir).collect()}
    assert len(rows) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= cut) for r in rows.values())
    labels = {r["doc_id"]: r[label] for r in spark.read.parquet(f"{sf_dir}/labels.parquet").collect()}
    held = [(rows[i]["predicted"], y) for i, y in labels.items() if rows[i]["held_out"]]
    assert len(held) > 40
    assert sum(a == b for a, b in held) / len(held) >= least

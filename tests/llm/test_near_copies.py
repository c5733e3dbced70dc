"""Near copies by exact Jaccard similarity against all pairs."""

import numpy as np
import pytest

import corpus_pipeline
from corpusmap.llm import near_copies, near_dup
from corpusmap.scratch import Tables

WORDS = [f"w{k}" for k in range(400)]


def sets(text):
    words = (text or "").lower().split()
    return {" ".join(words[k : k + 5]) for k in range(max(len(words) - 4, 1))} if words else set()


def stay(texts, similarity):
    """The smallest id of each component, by comparing all pairs."""
    made = {i: sets(t) for i, t in texts.items()}
    root = {i: i for i in made}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(made):
        for b in sorted(made):
            both = len(made[a] & made[b])
            if a < b and both >= similarity * (len(made[a]) + len(made[b]) - both) - 1e-9:
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted({find(i) for i in made})


def test_edited_copies_go(spark, sf_dir):
    rng = np.random.default_rng(6)
    words = rng.choice(WORDS, 120).tolist()
    edited = words[:60] + ["other", "words", "stand", "here"] + words[64:]
    texts = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(rng.choice(WORDS, 120)))]
    a, b = (near_dup.simhash(near_dup.shingle_hashes(t.encode())) for _, t in texts[:2])
    assert (a ^ b).bit_count() > near_dup.RADIUS
    docs = spark.createDataFrame(texts, "doc_id bigint, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()) == [1, 3]


@pytest.mark.parametrize("similarity", [0.8, 0.5])
def test_components_equal_all_pairs(spark, similarity):
    """Chains and crowds of edited copies under a passage that all texts hold, and texts of few or no words."""
    rng = np.random.default_rng(7)
    passage = rng.choice(WORDS, 30).tolist()
    texts = [None, "", " \n", "one two", "One two", "one two three"]
    for base in range(12):
        words = rng.choice(WORDS, rng.integers(20, 150)).tolist()
        for _ in range(12):
            texts.append(" ".join(words + passage))
            if base % 2:
                words = words.copy()
            for at in rng.integers(0, len(words), rng.integers(0, 4)):
                words[at] = str(rng.integers(1 << 30))
    docs = dict(enumerate(texts))
    rows = near_dup.filter_documents(
        spark.createDataFrame(list(docs.items()), "doc_id bigint, text string").repartition(3), shingle=5, similarity=similarity)
    assert sorted(r["doc_id"] for r in rows.collect()) == stay(docs, similarity)


def test_shared_passages_do_not_become_verified_pairs(spark, monkeypatch):
    """Texts of 8 of 30 passages: none are near copies, though every two share much; a passage's texts are cut into blocks."""
    monkeypatch.setattr(near_copies, "BLOCK", 32)
    rng = np.random.default_rng(8)
    passages = [" ".join(rng.choice(WORDS, 30)) for _ in range(30)]
    texts = {i: " ".join(passages[k] for k in rng.choice(30, 8, replace=False)) for i in range(400)}
    texts |= {1000 + i: texts[i] + " and more" for i in range(0, 400, 20)}
    saved = {}
    save = Tables.save

    def watch(self, df, name):
        saved[name] = save(self, df, name)
        return saved[name]

    monkeypatch.setattr(Tables, "save", watch)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    rows = near_dup.filter_documents(docs, shingle=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in rows.collect()) == stay(texts, 0.8)
    verified = sum(saved[f"{k}_bounds"].filter("most >= 0.8 - 1e-9").count() for k in ("star", "stars", "rest"))
    assert verified < 20 * len(texts)
    assert saved["rest"].count() < 20 * len(texts)


def test_sketches_bound_the_overlap():
    rng = np.random.default_rng(9)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 500).astype(np.uint64) * np.uint64(2)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 400))) for _ in range(2))
        both = len(np.intersect1d(a, b))
        assert both <= near_copies.most_shared(len(a), near_copies.sketch(a), len(b), near_copies.sketch(b)) <= min(len(a), len(b))


def test_a_crowd_of_edited_copies_does_not_become_pairs(spark, monkeypatch):
    """Copies of one text with none to a third of their words replaced: most are alike to few, but share shingles with all."""
    monkeypatch.setattr(near_copies, "PACKED", 16)
    rng = np.random.default_rng(10)
    words = rng.choice(WORDS, 150).tolist()
    texts = {}
    for i in range(400):
        copy = words.copy()
        for at in rng.integers(0, len(words), rng.integers(0, 12)):
            copy[at] = str(rng.integers(1 << 30))
        texts[i] = " ".join(copy)
    saved = {}
    save = Tables.save

    def watch(self, df, name):
        saved[name] = save(self, df, name)
        return saved[name]

    monkeypatch.setattr(Tables, "save", watch)
    docs = spark.createDataFrame(list(texts.items()), "doc_id bigint, text string").repartition(3)
    rows = near_dup.filter_documents(docs, shingle=5, similarity=0.8)
    assert sorted(r["doc_id"] for r in rows.collect()) == stay(texts, 0.8)
    assert sum(saved[f"{k}_bounds"].count() for k in ("star", "stars", "rest")) < 10 * len(texts)


def test_groups_of_one_id_or_none_each_keep_a_row(spark, sf_dir):
    """Different texts under one id, and under null ids, are different groups; each copy goes."""
    rng = np.random.default_rng(11)
    a, b, c, d = (" ".join(rng.choice(WORDS, 60)) for _ in range(4))
    rows = [(1, a), (1, b), (1, b), (2, a), (None, c), (None, c), (None, d), (3, d), (None, "x"), (None, "y"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)
    kept = corpus_pipeline.near_duplicates(spark, docs, sf_dir).collect()
    assert sorted(tuple(map(str, r)) for r in kept) == sorted(
        tuple(map(str, r)) for r in [(1, a), (1, b), (None, c), (3, d), (None, "x"), (None, "y"), (None, None)])

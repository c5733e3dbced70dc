"""Repeated passages, centroid clusters and spelling variants against plain Python over the whole tables."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from corpusmap.llm import centroids, queries, spelling, suffixes


def plain_passages(texts, window=400):
    """``(n_bytes, n_removed, n_spans, kept_sha256)`` of each text, by counting every window."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + window] for t in raw for i in range(len(t) - window + 1))
    out = []
    for t in raw:
        runs = []
        for i in range(len(t) - window + 1):
            if seen[t[i : i + window]] > 1:
                if runs and i <= runs[-1][1]:
                    runs[-1][1] = i + window
                else:
                    runs.append([i, i + window])
        kept, at = b"", 0
        for a, b in runs:
            kept += t[at:a]
            at = b
        out.append((len(t), sum(b - a for a, b in runs), len(runs), hashlib.sha256(kept + t[at:]).hexdigest()))
    return out


def same_passages(docs, rows):
    texts = docs.select("doc_id", "text").collect()
    want = Counter((r["doc_id"], *x) for r, x in zip(texts, plain_passages([r["text"] for r in texts])))
    return Counter(tuple(r[c] for c in ("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")) for r in rows) == want


def test_op11_against_counting_windows(spark, sf_dir, documents):
    assert same_passages(documents, queries.op11_suffix_array_dedup(spark, sf_dir).collect())


@pytest.mark.parametrize("crowd", [suffixes.CROWD, 2])
def test_passages_of_shared_parts(spark, crowd):
    """Passages with other texts around them, runs, periods, signs of several bytes, zeros; with and without crowded buckets."""
    rnd = random.Random(1)
    base = ["".join(rnd.choice("abcdefgh ") for _ in range(1500)) for _ in range(6)]

    def text():
        parts = []
        for _ in range(rnd.randrange(1, 6)):
            a = rnd.randrange(1200)
            parts.append(rnd.choice(base)[a : a + rnd.randrange(200, 700)] + rnd.choice(["", "x", "é"]))
        return "".join(parts)

    rows = [(i, text()) for i in range(100)] + [
        (900, "x" * 3000), (901, "x" * 399), (902, "x" * 400), (903, "ab" * 600), (904, None), (905, ""), (906, base[0]),
        (906, base[0]), (None, base[1] + "é" * 500), (907, "\0" * 900 + "x" + "\0" * 500)]
    docs = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    found = suffixes.repeated_passages(docs, crowd=crowd).collect()
    assert same_passages(docs, found)
    for r in found:
        assert all(b - a >= 400 for a, b in r["spans"]) and sum(b - a for a, b in r["spans"]) == r["n_removed"]


def test_cover_orders_any_two_windows():
    rng = np.random.default_rng(2)
    for r in range(suffixes.COVER):
        reached = (r + suffixes.CoverRanks.OFFSETS[r, np.arange(64)][:, None] + np.array([0])) % 64
        assert np.isin(reached, suffixes.CoverRanks.COVERED).all()
    data = np.frombuffer((b"abracadabra" * 200)[:1500] + bytes(rng.integers(97, 99, 1500).astype(np.uint8)) + b"abracadabra" * 100, np.uint8)
    made = suffixes.CoverRanks(data)
    whole = data.tobytes()
    at = rng.integers(0, len(data) - 400, (4000, 2))
    at = np.array([p for p in at if whole[p[0] : p[0] + 64] == whole[p[1] : p[1] + 64]])
    windows = [(whole[a : a + 400], whole[b : b + 400]) for a, b in at.tolist()]
    assert len(at) > 20
    assert made.compare(at[:, 0], at[:, 1], 400).tolist() == [(x > y) - (x < y) for x, y in windows]


def test_one_text_in_pieces_has_the_same_units(monkeypatch):
    rnd = random.Random(3)
    text = bytes(rnd.choice(b"abcd ") for _ in range(9000))

    def suffix_strings():
        found = set()
        for buffer, pieces in suffixes._pieces(iter([b"short", text]), 400):
            lo, size, off, _ = suffixes.units_of(buffer, [p[:2] for p in pieces])
            for a, n, o in zip(lo.tolist(), size.tolist(), off.tolist()):
                begin, _, row, at = max(p for p in pieces if p[0] <= a)
                assert row == 1
                found |= {(a - begin + at + k, a - begin + at + o) for k in range(n)}
        return found

    whole = suffix_strings()
    assert sorted(i for i, _ in whole) == list(range(len(text) - 399))
    monkeypatch.setattr(suffixes, "POSITION_BITS", 12)
    assert suffix_strings() == whole


def test_walk_equals_all_distances():
    rng = np.random.default_rng(4)
    for k, dims, top in ((1, 4, 5), (7, 3, 3), (16, 64, 40)):
        at, vectors = rng.integers(-top, top, (k, dims)), rng.integers(-top, top, (300, dims))
        number, best = centroids.SortedLists(at).nearest(vectors)
        apart = ((vectors[:, None] - at[None]) ** 2).sum(2)
        assert number.tolist() == apart.argmin(1).tolist() and best.tolist() == apart.min(1).tolist()


def test_clusters_of_odd_vectors(spark):
    inf, nan = float("inf"), float("nan")
    rows = [(1, [0.5, -0.5], 7), (1, [0.5, -0.5], 7), (2, [0.1], 7), (3, None, 7), (4, [nan, 1.0], 7), (5, [inf, 1.0], 7),
            (6, [None, 1.0], 7), (None, [3.0, 4.0], 7), (8, [3.0, 4.01], 7)]
    df = spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, cluster int")
    got = centroids.cluster_vectors(df, centroids=3, dims=2).collect()
    assert sorted(str(r["vec_id"]) for r in got) == ["1", "1", "8", "None"]
    assert len({r["cluster"] for r in got if r["vec_id"] == 1}) == 1 and sum(r["distance"] for r in got) == got[0]["inertia"]
    assert centroids.cluster_vectors(df.limit(0), dims=2).collect() == []
    with pytest.raises(Exception, match="too large"):
        centroids.cluster_vectors(spark.createDataFrame([(1, [1e9])], "vec_id int, embedding array<double>"), dims=1).collect()


def plain_variants(docs):
    count = Counter()
    for r in docs.select("doc_id", "text").collect():
        for run in re.findall("[A-Za-zÀ-ÿ]+", r["text"] or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if r['doc_id'] is None else r['doc_id']}:{run}".encode())
            count[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 97 == 0 else run] += 1
    n = {w: c for w, c in count.items() if len(w) >= 5 and c >= 3}
    signs = sorted({c for w in n for c in w})
    near, form = {}, {}
    for w in n:
        edits = {w[:i] + c + w[i + k :] for i in range(len(w) + 1) for k in (0, 1) for c in ["", *signs]}
        near[w] = sorted((x for x in edits - {w} if x in n), key=lambda x: (-n[x], x))
        form[w] = near[w][0] if near[w] and n[near[w][0]] >= 2 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return out


def as_set(rows):
    rows = [tuple(r[c] for c in ("word", "form", "root", "n", "n_near", "form_n")) for r in rows]
    assert len(set(rows)) == len(rows)
    return set(rows)


def test_op13_against_all_edits(spark, sf_dir, documents):
    assert as_set(queries.op13_spelling_variants(spark, sf_dir).collect()) == plain_variants(documents)


def test_variants_of_few_letters(spark):
    """Words of three letters in every order, so that runs, ties, chains and crowds of neighbours are common."""
    rnd = random.Random(5)
    words = ["".join(rnd.choice("abÉ") for _ in range(rnd.randrange(4, 8))) for _ in range(400)]
    texts = [(k if k else None, " ".join(rnd.choices(words, [1 / (i + 1) for i in range(400)], k=200))) for k in range(40)]
    docs = spark.createDataFrame([*texts, texts[1], (99, None), (98, "")], "doc_id int, text string")
    want = plain_variants(docs)
    assert any(f and r != f for _, f, r, *_ in want)
    assert as_set(spelling.spelling_variants(docs).collect()) == want

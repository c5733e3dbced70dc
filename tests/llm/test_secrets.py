"""Secrets that the patterns miss, set into real texts; the bound that skips chunks; field spans that meet base spans."""

import string

import numpy as np
import pytest

from corpusmap.llm import secrets

SIGNS = string.ascii_letters + string.digits
# What stands before a secret, its own beginning, its letters and their number; none of these leads is trained on.
PLANTED = [
    ("", "ghp_", SIGNS, 36), ("", "sk_live_", SIGNS, 24), ("Authorization: Bearer ", "", SIGNS, 40),
    ("private_key = ", "", SIGNS, 40), ("passphrase is ", "", SIGNS, 32), ("", "", string.ascii_letters, 24),
    ("password ", "", SIGNS, 16),
]


@pytest.fixture(scope="module")
def model(documents):
    return secrets.train(documents.select("text"))


def test_planted_secrets_are_found_in_whole_texts(model, texts):
    rng = np.random.default_rng(10)
    shown, where = [], []
    for text in texts.values():
        for lead, begin, signs, n in PLANTED:
            words = text.split(" ")
            before = " ".join(words[: len(words) // 2]) + " " + lead
            value = begin + "".join(signs[i] for i in rng.integers(len(signs), size=n))
            shown.append(f"{before}{value} {' '.join(words[len(words) // 2 :])}")
            where.append((len(before), len(before) + len(value)))
    caught = 0
    for spans, (a, b) in zip(secrets.scan_all(shown, model), where):
        caught += sum(max(0, min(b, y) - max(a, x)) for x, y, _ in spans) >= 0.9 * (b - a)
    assert caught >= 0.95 * len(shown)


def test_clean_texts_gain_few_spans(model, texts):
    found = secrets.scan_all(list(texts.values()), model)
    assert sum(k == "crf" for spans in found for *_, k in spans) <= len(texts) // 50


def test_bound_skips_nothing_that_is_tagged(model, texts):
    part = list(texts.values())[:60] + ["x" * 30 + "=" * 9 + "Qw3rTy" * 5, ""]
    for made in (model, secrets.Field(emit=np.random.default_rng(1).normal(size=model.emit.shape), unusual=model.unusual, trained=True)):
        t = secrets.Tokens(part)
        scores = made.scores(secrets.features(t, made.unusual))
        opens = np.flatnonzero(np.append(True, t.chunk[1:] != t.chunk[:-1]))
        left = set(made.open_chunks(scores, opens).tolist())
        for c, (a, b) in enumerate(zip(opens.tolist(), [*opens[1:].tolist(), len(scores)])):
            assert c in left or not any(made.viterbi(scores[a:b]))


def test_viterbi_takes_the_best_of_all_paths():
    rng = np.random.default_rng(2)
    for _ in range(50):
        made = secrets.Field(step=rng.normal(size=(3, 3)))
        scores = rng.normal(size=(5, 3))
        steps = made.step + made.BARRED

        def value(path):
            ends = [0, *path, 0]
            return sum(steps[a, b] for a, b in zip(ends, ends[1:])) + sum(s[t] for s, t in zip(scores, path))

        paths = np.stack(np.meshgrid(*[range(3)] * 5), -1).reshape(-1, 5).tolist()
        assert np.isclose(value(made.viterbi(scores)), max(map(value, paths)))


def test_slopes_are_those_of_the_likelihood():
    rng = np.random.default_rng(3)
    made = secrets.Field(emit=rng.normal(size=(secrets.FEATURES, 3)) * 0.1, step=rng.normal(size=(3, 3)))
    rows, tags = rng.integers(0, 50, (4, 3, 6)), np.array([[0, 1, 2], [0, 0, 0], [1, 1, 0], [1, 2, 2]])

    def loss():
        s, steps = made.scores(rows), made.step + made.BARRED
        paths = np.stack(np.meshgrid(*[range(3)] * 3), -1).reshape(-1, 3)
        out = 0.0
        for k in range(4):
            def value(p):
                ends = [0, *p, 0]
                return sum(steps[a, b] for a, b in zip(ends, ends[1:])) + sum(s[k, t, p[t]] for t in range(3))
            out += np.logaddexp.reduce([value(p) for p in paths]) - value(tags[k])
        return out

    emit, step = made._slopes(rows, tags)
    for table, slopes, at in ((made.emit, emit, (int(rows[0, 0, 0]), 1)), (made.step, step, (1, 2)), (made.step, step, (0, 0))):
        table[at] += 1e-5
        high = loss()
        table[at] -= 2e-5
        low = loss()
        table[at] += 1e-5
        assert np.isclose((high - low) / 2e-5, slopes[at], atol=1e-4)


def test_parts_beyond_base_spans_stay():
    assert list(secrets._outside(2, 20, [(0, 5, "assign"), (8, 10, "hex")])) == [(5, 8), (10, 20)]
    assert list(secrets._outside(2, 4, [(0, 5, "assign")])) == []

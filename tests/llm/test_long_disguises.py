"""Disguised runs of any length and any gaps."""

import time

import pytest

from corpusmap.llm import toxicity

PLAIN = "you are a stupid idiot and a moron this loser is pathetic start the train with disgusting trash "


@pytest.fixture(scope="module")
def restorer(spark):
    docs = spark.createDataFrame([(1, PLAIN * 50)], "doc_id bigint, text string")
    return toxicity.Restorer(toxicity.language_model(toxicity.trigram_counts(docs)))


def test_words_across_every_place_are_restored(restorer):
    sentence = "you are a pathetic loser and this train is disgusting trash".replace(" ", "")
    for sign in " .":
        assert {"pathetic", "loser", "disgusting"} <= restorer.restore(sign.join(sentence))
        # Without its first word "disgusting" stands at letters 32 to 41.
        assert {"pathetic", "loser", "disgusting"} <= restorer.restore(sign.join(sentence[3:]))


@pytest.mark.parametrize("text", ["s  t  u  p  i  d", "s\t t\t u\t p\t i\t d", "s \t t  u p   i d"])
def test_any_white_space_sets_apart(restorer, text):
    assert "stupid" in restorer.restore(f"so {text} here")


def test_wider_gaps_end_words(restorer):
    assert restorer.spaced("y o u  a r e  a  m o r o n") == ["you are a moron"]


def test_long_runs_take_linear_time(restorer):
    start = time.perf_counter()
    restorer.restore("x" * 60_000 + " " + "x1" * 20_000 + " " + "y o u " * 5_000)
    assert time.perf_counter() - start < 60

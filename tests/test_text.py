from pyspark.ml.feature import StopWordsRemover

from corpusmap.functions import text
from corpusmap.functions.stopwords import ENGLISH
from corpusmap.operators.embed import embed_hashing
from corpusmap.operators.tfidf import term_counts, tfidf_fit, tfidf_rows, tfidf_transform

DETAILED = (
    "id string, title string, keywords string, description string, file_extensions array<string>, "
    "software_engines array<string>, atom_number bigint, has_protein boolean, has_nucleic boolean, has_lipid boolean"
)


def test_golden_rows(spark):
    level = spark.createDataFrame(
        [
            ("1", "Lipid bilayer", "membrane", "n/a", ["gro", "xtc"], ["GROMACS"], None, True, False, True),
            ("2", "A", None, None, ["none"], ["unknown"], 12, None, None, None),
        ],
        DETAILED,
    )
    got = dict(text.text_of(level).collect())
    assert got["1"] == "Lipid bilayer membrane  gro xtc GROMACS atom_number= has_protein has_lipid"
    assert got["2"] == "A  unknown atom_number=12"


def test_sentinels_go_as_substrings_one_after_the_other(spark):
    basic = spark.createDataFrame(
        [("1", "Nonequilibrium and nonequilibrium runs", "None given"), ("2", "nNoneone", ""), ("3", "  x 　", None)],
        "id string, title string, description string",
    )
    got = dict(text.text_of(basic).collect())
    assert got == {"1": "quilibrium and quilibrium runs  given", "2": "", "3": "x"}
    whole = dict(text.text_of(basic, whole_words=True).collect())
    assert whole["1"] == "Nonequilibrium and nonequilibrium runs  given"


def test_stop_words_are_sparks(spark):
    assert list(ENGLISH) == StopWordsRemover.loadDefaultStopWords("english")


def test_tfidf_by_hand(spark):
    import math

    texts = spark.createDataFrame([("a", "Red red BLUE a"), ("b", "blue the"), ("c", "the")], "id string, text string")
    counts = {(r.id, r.term): r.tf for r in term_counts(texts).collect()}
    assert counts == {("a", "red"): 2, ("a", "blue"): 1, ("b", "blue"): 1}
    vocabulary = tfidf_fit(texts)
    idf = {r.term: r.idf for r in vocabulary.collect()}
    assert math.isclose(idf["red"], math.log(4 / 2) + 1) and math.isclose(idf["blue"], math.log(4 / 3) + 1)
    weights = {(r.id, r.term): r.weight for r in tfidf_transform(texts, vocabulary).collect()}
    length = math.hypot(2 * idf["red"], idf["blue"])
    assert math.isclose(weights["a", "red"], 2 * idf["red"] / length) and math.isclose(weights["b", "blue"], 1.0)
    assert {r.id: len(r.entries) for r in tfidf_rows(texts, vocabulary).collect()} == {"a": 2, "b": 1, "c": 0}


def test_max_features_keeps_the_most_frequent(spark):
    texts = spark.createDataFrame([("a", "xx xx yy zz"), ("b", "yy yy")], "id string, text string")
    assert {r.term for r in tfidf_fit(texts, max_features=2).collect()} == {"xx", "yy"}


def test_hashing_gives_unit_or_zero_vectors(spark):
    texts = spark.createDataFrame([("a", "red blue"), ("b", "the"), ("c", None)], "id string, text string")
    got = {r.id: r.embedding for r in embed_hashing(texts, dim=32).collect()}
    assert len(got) == 3 and all(len(v) == 32 for v in got.values())
    assert abs(sum(x * x for x in got["a"]) - 1.0) < 1e-6
    assert not any(got["b"]) and not any(got["c"])


def test_terms_are_counted_without_a_shuffle_and_repeated_ids_are_one_record(spark):
    rows = [("a", "Zeta zeta alpha"), ("a", "alpha beta"), ("b", None), ("c", "")]
    texts = spark.createDataFrame(rows, "id string, text string").repartition(3)
    counts = {(r.id, r.term): r.tf for r in term_counts(texts).collect()}
    assert counts == {("a", "zeta"): 2, ("a", "alpha"): 2, ("a", "beta"): 1}
    unique = texts.filter("id <> 'a' OR text LIKE 'Z%'")
    plan = term_counts(unique)._jdf.queryExecution().optimizedPlan().toString()
    assert "Aggregate" not in plan
    vocabulary = tfidf_fit(texts)
    entries = {r.id: [e.term for e in r.entries] for r in tfidf_rows(texts, vocabulary).collect()}
    assert {k: sorted(v) for k, v in entries.items()} == {"a": ["alpha", "beta", "zeta"], "b": [], "c": []}
    assert all(abs(sum(e.weight**2 for e in r.entries) - 1) < 1e-12 for r in tfidf_rows(texts, vocabulary).collect() if r.id == "a")


def test_stored_vectors_shuffle_records_and_not_their_text_forms(spark):
    from corpusmap.functions import records

    level = spark.createDataFrame([("a", "red", ["x"]), ("b", None, None)], "id string, title string, engines array<string>")
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [0.0])], "id string, embedding array<double>")
    found = records.stored_vectors(vectors, level)
    assert sorted(map(str, found.collect())) == sorted(map(str, vectors.join(records.as_store_rows(level), "id").collect()))
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("AS document") < plan.index("Join") and "AS document" not in plan[plan.index("Join") :]


def test_hits_are_found_before_documents_are_joined_to_them(spark):
    """A search plans no exchange of the stored documents, since it knows the size of its hits."""
    from corpusmap.operators.search import semantic_search

    texts = spark.createDataFrame([("a", "red blue"), ("b", "green blue")], "id string, text string")
    vocabulary = tfidf_fit(texts, None)
    stored = embed_hashing(texts, 16, vocabulary).selectExpr("id", "embedding", "'{\"title\":\"t\"}' AS document")
    asked = texts.withColumnRenamed("id", "query_id")
    found = semantic_search(asked, stored, "hashing", 1, vocabulary)
    assert {(r.query_id, r.id, r.title) for r in found.collect()} == {("a", "a", "t"), ("b", "b", "t")}
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" not in plan and "Window" not in plan


def test_hashing_leaves_only_its_vectors(spark, monkeypatch):
    import glob

    from corpusmap.operators import embed
    from corpusmap.scratch import shared_dir

    monkeypatch.setattr(embed, "FREQUENT", 1)
    texts = spark.createDataFrame([("a", "red blue"), ("b", "green blue")], "id string, text string")
    pattern = f"{shared_dir(spark).removeprefix('file:')}/hashing-*/*"
    before = set(glob.glob(pattern))
    assert len(embed.embed_hashing(texts, 16, tfidf_fit(texts, None)).collect()) == 2
    assert {path.split("/")[-1] for path in set(glob.glob(pattern)) - before} == {"vectors"}


def test_rare_terms_are_hashed_like_frequent_ones(spark, monkeypatch):
    from corpusmap.operators import embed

    rows = [("a", "red red blue green"), ("b", "blue white unknown"), ("c", None), ("d", "the"), ("e", "pink")]
    texts = spark.createDataFrame(rows, "id string, text string").repartition(2)

    def found():
        return {r.id: r.embedding for r in embed.embed_hashing(texts, dim=16).collect()}

    whole = found()
    monkeypatch.setattr(embed, "FREQUENT", 2)
    split = found()
    assert whole.keys() == split.keys() == set("abcde")
    assert all(abs(x - y) < 1e-6 for k in whole for x, y in zip(whole[k], split[k], strict=True))
    assert sum(map(abs, whole["a"])) > 0 and not any(whole["c"]) and not any(whole["d"])

"""The pipeline against its stages written out plainly."""

import brute
import pytest
from pyspark.sql import functions as F
from test_near_copies import stay

import corpus_pipeline
from corpusmap.llm import oracles, quality, secrets


@pytest.fixture(scope="module")
def stages(spark, sf_dir, tmp_path_factory):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    made = [docs]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        path = str(tmp_path_factory.mktemp("stage") / str(k))
        stage(spark, made[-1], sf_dir).write.parquet(path)
        made.append(spark.read.parquet(path))
    return made


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_stages_return_the_columns_of_documents(stages):
    assert all(s.schema == stages[0].schema for s in stages[1:-1])


def test_rules_equal_the_oracle(stages, sf_dir):
    import compare

    kept = compare.connect(sf_dir).execute(oracles.sql()["op6_host_rules"]).fetchdf()
    assert ids(stages[1]) == sorted(kept[kept["kept"]]["doc_id"])


def test_classifier_equals_the_scores(spark, sf_dir, stages):
    scores = quality.quality(stages[1], spark.read.parquet(f"{sf_dir}/labels.parquet"))
    assert ids(stages[2]) == ids(scores.filter("predicted = 1"))


def test_one_document_of_each_component_stays(stages):
    texts = {r["doc_id"]: r["text"] for r in stages[2].collect()}
    assert ids(stages[3]) == stay(texts, 0.8)


def test_secrets_are_gone_and_the_rest_is_the_same(stages):
    before = {r["doc_id"]: r for r in stages[3].collect()}
    model = secrets.train(stages[3].select("text"))
    after = stages[4].collect()
    assert sorted(before) == sorted(r["doc_id"] for r in after)
    for r in after:
        text = before[r["doc_id"]]["text"] or ""
        spans = secrets.scan(text, model)
        assert {(a, b, k) for a, b, k in spans} >= set(brute.base_secrets(text))
        assert r["text"] == secrets.redact(text, spans) and r["n_chars"] == len(r["text"])
        assert not brute.base_secrets(r["text"])


def test_packing_equals_plain_best_fit(stages):
    t = brute.tokenizer()
    want = [p for r in stages[4].collect() for p in brute.pieces(t.encode(r["text"], add_special_tokens=False).ids, 2048)]
    rows = stages[5].collect()
    assert sorted((r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    rooms = stages[5].groupBy("sequence_id").agg((2048 - F.sum("length")).alias("room")).collect()
    assert sorted(r["room"] for r in rooms) == brute.best_fit_bins([n for _, n, _ in want], 2048)


def test_run_gives_the_last_stage(spark, sf_dir, stages):
    last = corpus_pipeline.run(spark, sf_dir)
    assert sorted(last.drop("sequence_id", "offset").collect()) == sorted(stages[-1].drop("sequence_id", "offset").collect())


def test_stages_on_odd_rows_and_empty_tables(spark, sf_dir, odd, nothing):
    """Each stage takes nulls, repeated rows, long texts, clashing columns and no rows at all."""
    for docs in (odd, nothing):
        for name, stage in corpus_pipeline.STAGES:
            made = stage(spark, docs, sf_dir)
            if name != "packing":
                assert made.columns == docs.columns
            rows = made.collect()
            assert docs is odd or rows == []
            if docs is odd and name == "near_duplicates":
                assert sorted(r["doc_id"] for r in rows) == [1, 2, 5, 6, 7, 8, 9]
            if docs is odd and name == "secret_scan":
                assert len(rows) == odd.count() and not any(brute.base_secrets(r["text"]) for r in rows)

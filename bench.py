"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs once to warm up and then BENCH_RUNS times; the median counts. Results are forced with a
``noop`` write, shared inputs are built before the clock starts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from corpusmap.operators import graph, knn, search, simjoin, tfidf  # noqa: E402
from corpusmap.plans import queries as q  # noqa: E402
from corpusmap.session import local_session  # noqa: E402


def headline(spark, sf_dir):
    texts = q.docs(spark, sf_dir)
    rows = q.plain_rows(spark, sf_dir)
    similar = q.similar_09(spark, sf_dir)
    vectors = q.dense(spark, sf_dir)
    asked = vectors.withColumnRenamed("id", "query_id")
    return {
        "detailed_level": lambda: q.detailed(spark, sf_dir),
        "text_detailed": lambda: q.text_detailed(spark, sf_dir),
        "tfidf": lambda: tfidf.tfidf_rows(texts, tfidf.tfidf_fit(texts)),
        "embed_hashing": lambda: q.embed_hashing(spark, sf_dir),
        "sim_edges_sparse": lambda: simjoin.sparse_similarity_join(rows, 0.9),
        "cosine_topk": lambda: search.search(asked, vectors, 10),
        "sim_edges_dense": lambda: simjoin.similarity_join(vectors, 0.3),
        "knn10": lambda: knn.knn_join(q.points(spark, sf_dir), 10),
        "components": lambda: graph.components_of(similar),
        "communities": lambda: graph.communities(similar),
        "dbscan": lambda: q.dbscan(spark, sf_dir),
        "hdbscan": lambda: q.hdbscan(spark, sf_dir),
        "cluster_hulls": lambda: q.cluster_hulls(spark, sf_dir),
        "lsh_topk": lambda: q.lsh_topk(spark, sf_dir),
        "similar_09": lambda: q.sim_edges_sparse_09(spark, sf_dir),
    }


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = local_session(os.environ.get("BENCH_CPUS", "4"), memory="16g")
    times: dict[str, float] = {}
    for name, build in headline(spark, sf_dir).items():
        taken = []
        for _ in range(runs + 1):
            start = time.perf_counter()
            build().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        times[name] = round(statistics.median(taken[1:]), 3)
        print(name, [round(t, 2) for t in taken], file=sys.stderr, flush=True)
    spark.stop()
    total = round(sum(times.values()), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf}))


if __name__ == "__main__":
    main()

"""Time the headline queries: one JSON line on standard output.

Search is timed on a stored catalog, as the load leaves it; the jobs that build
that catalog are timed on their own. Every query runs once to warm up, and the
median of three further runs counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalith.operators import clean, features, impute, nearest, search, titles, traffic  # noqa: E402
from catalith.operators.embed import embed_documents, spread  # noqa: E402
from catalith.session import build_session, settle  # noqa: E402
from checks import queries as registered  # noqa: E402
from checks.items import items  # noqa: E402
from checks.model import hashing_model  # noqa: E402

RUNS = 3


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "12g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")

    raw = settle(items(spark, sf), "raw")
    kept = settle(clean.deduplicated(raw), "kept")
    cleaned = clean.validate_numerics(kept)
    corpus = settle(registered.corpus(spark, sf), "corpus")
    vectors = settle(spark.read.parquet(f"{sf}/embeddings.parquet"), "vectors")
    named = vectors.withColumnRenamed("vec_id", "id")
    source = search.vector_of(named, 7)
    stored = settle(named, "stored")
    hundred = registered._batch_requests(spark, sf).orderBy("query_id").limit(100)
    hundred = settle(hundred, "queries")
    asked = spark.read.parquet(f"{sf}/part.parquet").selectExpr(
        "p_partkey AS query_id", f"{registered.TITLE_RULE} AS title"
    )
    log = traffic.requests_of(spark.read.parquet(f"{sf}/events.parquet"))
    documents = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")

    def pipeline():
        fresh = clean.validate_numerics(settle(clean.deduplicated(raw), "kept"))
        return features.augment(impute.impute(fresh))

    timed = {
        "hybrid_search": lambda: search.hybrid_search(corpus, source, registered._FILTERS),
        "similar_items": lambda: search.similar_items(corpus, registered._bolt(corpus)),
        "hybrid_search_batch_100": lambda: search.search_many(corpus, hundred),
        "knn_all_10": lambda: nearest.similar_many(stored, stored, 10),
        "knn_index_10": lambda: nearest.nearest_rows(stored, source, 10),
        "title_lookup": lambda: titles.title_lookup(corpus, "Hott Gear"),
        "title_match_batch": lambda: titles.title_match(corpus, asked),
        "clean": lambda: clean.clean(raw),
        "impute": lambda: impute.impute(cleaned),
        "clean_impute_augment": pipeline,
        "cleaning_report": lambda: clean.cleaning_report(raw, kept=kept),
        "embed_documents": lambda: embed_documents(
            spread(documents), text="text", factory=hashing_model(64), dim=64
        ),
        "upsert_items": lambda: registered.upsert_items(spark, sf),
        "nl_search": lambda: registered.nl_search(spark, sf),
        "dedup_documents": lambda: registered.dedup_documents(spark, sf),
        "request_rate": lambda: traffic.request_rate(log),
        "latency_quantiles": lambda: traffic.latency_quantiles(log),
        "quota_rejections": lambda: traffic.quota_rejections(log, limit=4, window="1 day"),
    }
    seconds = {}
    for name, query in timed.items():
        taken = []
        for _ in range(RUNS + 1):
            start = time.perf_counter()
            query().write.format("noop").mode("overwrite").save()
            taken.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(taken[1:]), 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()

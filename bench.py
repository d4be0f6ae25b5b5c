"""Time the headline queries; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from docweir.catalog import load  # noqa: E402
from docweir.session import SCAN_PARTITIONS, local_session  # noqa: E402

HEADLINE = (
    "bm25_topk bm25_stemmed vector_topk hybrid_search postings_simple chunk_index_prefix markdown_chunks "
    "page_markdown url_plan_capped robots_decide bfs_crawl sitemap_expand history_window halving_truncate "
    "citation_attach token_assembly job_state_last"
).split()


def main(names: list[str]) -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("OFF")
    # the bench tables are single files
    spark.conf.set(SCAN_PARTITIONS, str(spark.sparkContext.defaultParallelism))
    queries = load()[0]
    # start the JVM's parquet and Python paths before the clock runs
    queries["token_count"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    queries["char_chunks"](spark, sf_dir).limit(10).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        start = time.time()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
        print(name, times[name], file=sys.stderr, flush=True)
    total = round(sum(times.values()), 3)
    print(json.dumps({"metric": "headline_total", "value": total, "unit": "sec", "queries": times, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:] or list(HEADLINE))

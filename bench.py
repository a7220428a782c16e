"""Headline queries over the fixture logs, timed; prints one JSON line.

The fixture is first appended to a day-partitioned log table, which is what the queries
then read. Every query runs to the end, into a sink that takes all rows.
"""

from __future__ import annotations

import itertools
import json
import os
import sys
import tempfile
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from pyspark.sql import functions as F  # noqa: E402

from timberline import build_session, fixtures  # noqa: E402
from timberline.functions.masks import apply_masks  # noqa: E402
from timberline.functions.text import match  # noqa: E402
from timberline.operators import filters, masking, paging, parsing, patterns, search, stats  # noqa: E402
from timberline.registry.base import AS_OF, END, START  # noqa: E402
from timberline.registry.search import LOG_QUERIES  # noqa: E402
from timberline.sources import logs as table  # noqa: E402
from timberline.sources.otlp import to_otlp  # noqa: E402
from timberline.sources.scratch import drop_scratch  # noqa: E402
from timberline.streaming import ingest  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "2"))


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    folder = tempfile.mkdtemp(prefix="timberline-bench-")
    spark = build_session(
        "timberline-bench",
        f"local[{CPUS}]",
        spark__sql__shuffle__partitions=CPUS,
        spark__ui__enabled="false",
        spark__driver__memory="16g",
        spark__checkpoint__dir=f"{folder}/shared",
    )
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name: str, run, repeats: int = REPEATS) -> None:
        best = None
        for _ in range(repeats):
            started = time.perf_counter()
            run()
            took = time.perf_counter() - started
            best = took if best is None else min(best, took)
        seconds[name] = round(best, 3)

    fresh = itertools.count()
    source = fixtures.event_logs(spark, SF_DIR)
    timed("append", lambda: table.write_logs(source, f"{folder}/logs{next(fresh)}"))
    logs = table.read_logs(spark, f"{folder}/logs0")
    rows = logs.count()

    timed("overview", lambda: drain(stats.overview(logs, START, END)))
    timed("hourly_volume", lambda: drain(stats.hourly_volume(logs, AS_OF)))
    timed("bucket_counts_15m", lambda: drain(stats.bucket_counts(logs, "15m", ["service_name"])))
    timed(
        "filter_page",
        lambda: drain(
            paging.log_page(logs, 100, 0, severity="error", start=START, end=END).rows
        ),
    )
    timed(
        "deep_page",
        lambda: drain(paging.log_page(logs, 100, int(0.7 * rows)).rows),
    )
    timed("trace_lookup", lambda: drain(filters.by_trace(logs, "0a113ef6b61820daa5611c870ed8d5ee")))
    for mode, query in LOG_QUERIES.items():
        name = mode.removeprefix("MATCH_").lower()
        timed(f"search_{name}", lambda m=mode, q=query: drain(logs.where(match(F.col("body"), q, m))))
    docs = fixtures.documents(spark, SF_DIR)
    timed("search_documents", lambda: drain(docs.where(match(F.col("text"), "by the", "MATCH_PHRASE"))))
    built = search.build_term_index(logs)
    fresh = itertools.count()
    timed("term_index", lambda: search.write_term_index(built, f"{folder}/index{next(fresh)}"))
    index = search.read_term_index(spark, f"{folder}/index0", built.schema)
    timed(
        "index_search",
        lambda: drain(search.search_index(index, logs, "timed out 110", "MATCH_PHRASE")),
    )
    timed("mask_default", lambda: drain(logs.select("log_id", apply_masks(F.col("body")))))
    timed("mask_report", lambda: drain(masking.mask_report(logs)))
    timed("masked_counts", lambda: drain(masking.masked_counts(logs)))
    timed("parse_logs", lambda: drain(parsing.parse_logs(logs).parsed))
    timed("position_templates", lambda: drain(patterns.position_templates(logs)))

    models = []
    timed("mine_patterns", lambda: models.append(patterns.mine_patterns(logs)))
    model = models[-1]
    assigned = patterns.assign_patterns(logs, model)
    timed("pattern_list", lambda: drain(patterns.list_patterns(model)))
    timed("pattern_series", lambda: drain(patterns.pattern_series(assigned, "1h")))
    timed(
        "pattern_samples",
        lambda: drain(patterns.pattern_samples(assigned, 10, totals=model.patterns)),
    )
    timed("match_patterns", lambda: drain(patterns.match_patterns(logs, model.patterns)))

    to_otlp(source).write.json(f"{folder}/documents")
    fresh_load, fresh_replay = itertools.count(), itertools.count()

    def load() -> None:
        n = next(fresh_load)
        ingest.stream_logs(
            spark, f"{folder}/documents", f"{folder}/loaded{n}", f"{folder}/load{n}", available_now=True
        ).awaitTermination()

    def replay() -> None:
        n = next(fresh_replay)
        stream = spark.readStream.schema(source.schema).parquet(f"{folder}/sent")
        ingest.write_stream(
            ingest.dedupe_stream(stream), f"{folder}/once{n}", f"{folder}/seen{n}", available_now=True
        ).awaitTermination()

    source.write.parquet(f"{folder}/sent")
    timed("stream_load", load)
    timed("replay_filter", replay)
    drop_scratch(spark)

    whole = sum(seconds.values())
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(whole, 3),
                "unit": "sec",
                "queries": seconds,
                "sf": Path(SF_DIR).name.removeprefix("sf"),
                "cpus": int(CPUS),
                "rows": rows,
                "rows_per_second": {k: round(rows / v) for k, v in seconds.items()},
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()

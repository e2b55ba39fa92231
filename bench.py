"""Headline queries, timed. Prints one JSON line.

Settings from the environment: BENCH_SF_DIR (data folder), BENCH_CPUS (local cores).
"""

from __future__ import annotations

import json
import os
import re
import time

from checks import queries as Q
from checks.star import star_tables
from rowloom.operators import cells, encode, match, metrics, samples, search, workload
from rowloom.session import get_spark, write_stage
from rowloom.sources.tables import union_samples

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def steps(spark):
    """(name, job) in build order; later jobs read what earlier ones wrote."""
    made = {}
    raw = union_samples(spark, star_tables(spark, SF_DIR))

    def keep(name, df):
        made[name] = write_stage(df, name)

    def workload_job():
        made["queries"], made["conditions"] = workload.build_queries(made["corpus"], Q.RETRIEVAL)

    def split_job():
        kept = samples.keep_classifiable(made["samples"], Q.CONFIG)
        drain(samples.mark_split(made["samples"], samples.class_cuts(kept)))

    def vectors_job():
        v = Q.vectors_table(spark, SF_DIR)
        k = max(metrics.TOP_K)
        hits = search.topk_flat(v.selectExpr("vec_id AS query_id", "embedding"), v.selectExpr("vec_id AS idx", "embedding"), k + 1)
        keep("hits", Q.other_hits(hits, k))

    def metrics_job():
        judged = metrics.hits_rel(made["hits"], Q.vector_qrels(spark, SF_DIR))
        drain(metrics.metric_cube(metrics.per_query_metrics(judged, Q.vector_queries(spark, SF_DIR))))

    return [
        ("serialize_row", lambda: drain(raw.select("dataset_key", "row_id", "text"))),
        ("build_samples", lambda: made.update(samples=samples.build_samples(raw, Q.CONFIG))),
        ("stratified_split", split_job),
        ("sample_per_dataset", lambda: drain(samples.sample_per_dataset(made["samples"], Q.SAMPLE_CAP))),
        ("corpus", lambda: keep("corpus", cells.number_corpus(made["samples"]))),
        ("cells", lambda: drain(cells.cells(made["corpus"]))),
        ("match_anchor", lambda: drain(match.match_anchor(made["corpus"], Q.conditions(spark)))),
        ("match_division", lambda: drain(match.match_division(made["corpus"], Q.conditions(spark)))),
        ("query_workload", workload_job),
        ("ground_truth", lambda: drain(match.match_anchor(made["corpus"], made["conditions"], 3))),
        ("topk_flat", vectors_job),
        ("metric_cube", metrics_job),
        ("encode_text", lambda: drain(encode.encode_text(made["samples"].select("dataset_key", "text")))),
        ("clf_fit_predict", lambda: drain(Q.clf_fit_predict(spark, SF_DIR))),
    ]


def main() -> None:
    spark = get_spark("bench", f"local[{CPUS}]", **{
        "spark.sql.shuffle.partitions": CPUS, "spark.driver.memory": "16g", "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name, job in steps(spark):
        start = time.perf_counter()
        job()
        times[name] = round(time.perf_counter() - start, 3)
    found = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": float(found.group(1)) if found else SF_DIR}))


if __name__ == "__main__":
    main()

"""Headline queries, timed. Prints one JSON line.

BENCH_SF_DIR  table folder (default /root/testdata/sf0.1)
BENCH_CPUS    local threads (default 8)
"""

from __future__ import annotations

import json
import os
import time
import warnings
from pathlib import Path

from gleaner.plans import load_all
from gleaner.plans.registry import QUERIES
from gleaner.session import build_session

HEADLINE = [
    "flagship_run_summary", "joi_08_components", "agg_04_merged_postings", "scr_05_score", "scr_07_keyword_gate",
    "joi_13_term_match", "src_01_rss_items", "src_09_html_to_text", "src_16_mark_relisted", "str_04_link_key",
    "str_12_extract_salary", "str_20_injection_markers", "joi_05_reposts", "srt_04_probe_candidates", "snk_04_merge_state",
    "win_03_rolling_baseline", "stm_01_last_seen_ttl", "stm_05_stale_jobs", "agg_13_thread_state",
]


def main() -> None:
    warnings.filterwarnings("ignore")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.gleaner.textPartitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "12g",
        "spark.ui.showConsoleProgress": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    load_all()
    spark.read.parquet(f"{sf_dir}/nation.parquet").count()  # the session itself is not what is measured
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": Path(sf_dir).name,
    }))


if __name__ == "__main__":
    main()

"""Benchmark: headline jobs over raw logs derived from the given tables.

The raw logs are staged once (text lines in a written table, spread over the cores, as
many log files would be) and are not part of the measured time. Every job is forced with
the noop sink, warmed up once, and the median of the measured runs is reported.

settings: BENCH_SF_DIR, BENCH_CPUS, BENCH_RUNS
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from workloads.logs import Logs  # noqa: E402
from workloads.queries import QUERIES  # noqa: E402

HEADLINE = [
    "src2_auth_events", "src3_web_events", "src4_win_tabular", "src5_win_blocks", "src7_csv_events", "src8_json_lines",
    "src10_windows_event_xml", "src12_detect_auth_content", "d1_ssh_brute_force_by_ip", "d2_ssh_user_enumeration",
    "d4_ssh_success_after_failures", "d5_web_sql_injection_attempt", "d9_web_scanner_detected", "d10_web_directory_scanning",
    "d11_windows_brute_force_logon", "d18_generic_repeated_auth_failures", "d21_generic_sensitive_action",
    "d22_xml_windows_brute_force_logon", "k2_top_keys", "q1_hunt_brute_force", "q5_hunt_sqli", "q18_hunt_denied",
    "w2_window_auth_failures", "w4_throttle", "r5_splunk_searches",
]


class StagedLogs(Logs):
    """Raw lines read from a table written beforehand."""

    def __init__(self, spark, sf_dir, folder, parts):
        super().__init__(spark, sf_dir)
        self.folder, self.parts = folder, parts

    def raw(self, view):
        path = f"{self.folder}/{view}"
        if not os.path.exists(path):
            super().raw(view).repartition(self.parts).write.parquet(path)
        return self.spark.read.schema("source_file string, seq bigint, value string").parquet(path)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", os.cpu_count() or 1))
    runs = int(os.environ.get("BENCH_RUNS", "1"))
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(cpus)).config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    folder = tempfile.mkdtemp(prefix="run-", dir="/tmp")
    staging = StagedLogs(spark, sf_dir, folder, cpus)
    for view in ("auth_lines", "web_lines", "win_lines", "win_blocks", "firewall_lines", "cloud_lines", "winevent_records"):
        staging.raw(view)
    seconds = {}
    for name in HEADLINE:
        taken = []
        for n in range(runs + 1):
            started = time.time()
            df = QUERIES[name](StagedLogs(spark, sf_dir, folder, cpus))
            df.write.format("noop").mode("overwrite").save()
            if n:
                taken.append(time.time() - started)
        seconds[name] = round(statistics.median(taken), 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"), "cpus": cpus,
    }))


if __name__ == "__main__":
    main()

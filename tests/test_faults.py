"""Task failures: the first attempt of one task dies mid-stream; Spark's
retry must leave complete, duplicate-free outputs (zst sink and batch job).
Runs in its own JVM because retries need a ``local[N, maxFailures]`` master."""

from __future__ import annotations

import json
import os
import subprocess
import sys
import textwrap

from .conftest import ROOT

SCRIPT = textwrap.dedent("""
    import json, sys
    sys.path.insert(0, sys.argv[1])
    import pandas as pd
    from pyspark import TaskContext
    from pyspark.sql import SparkSession, functions as F
    from portlens.plans.etl import run_etl
    from portlens.sources.ndjson import read_ndjson, write_ndjson_zst
    from portlens.sources.parquet import read_table

    out = sys.argv[2]
    spark = (SparkSession.builder.master("local[4,2]").config("spark.ui.enabled", "false")
             .config("spark.ui.showConsoleProgress", "false").config("spark.sql.shuffle.partitions", "4")
             .config("spark.checkpoint.dir", out + "/ckpt").getOrCreate())
    spark.sparkContext.setLogLevel("OFF")

    def flaky(batches):
        ctx = TaskContext.get()
        for i, pdf in enumerate(batches):
            if ctx.partitionId() == 1 and ctx.attemptNumber() == 0 and i == 1:
                with open(out + "/injected", "a") as marker:
                    marker.write("x")
                raise RuntimeError("injected failure")
            yield pdf

    n = 4000
    banner = F.to_json(F.struct(
        F.concat(F.lit("10.0.0."), (F.col("id") % 1000).cast("string")).alias("ip_str"),
        (F.col("id") % 3).cast("int").alias("port"),
        F.lit("2024-01-01T00:00:00").alias("timestamp"), F.col("id").alias("hash"), F.lit("Org").alias("org")))
    lines = spark.range(n).repartition(4).select(banner.alias("value"))
    faulty = lines.mapInPandas(flaky, "value string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "200")

    written = write_ndjson_zst(faulty, out + "/zst")
    back = read_ndjson(spark, out + "/zst")
    etl = run_etl(spark, None, out + "/etl", lines=faulty)
    scans = read_table(spark, etl.scans_path)
    print(json.dumps({
        "zst_lines": written, "zst_rows": back.count(), "zst_distinct": back.select("hash").distinct().count(),
        "scans": scans.count(), "scan_keys": scans.select("ip_str", "port").distinct().count(),
    }))
""")


def test_task_failures_leave_whole_outputs(tmp_path):
    script = tmp_path / "faults.py"
    script.write_text(SCRIPT)
    env = dict(os.environ, PYSPARK_PYTHON=sys.executable)
    proc = subprocess.run([sys.executable, str(script), ROOT, str(tmp_path)], capture_output=True, text=True,
                          timeout=600, env=env)
    assert proc.returncode == 0, proc.stderr[-3000:]
    result = json.loads(proc.stdout.strip().splitlines()[-1])
    assert result["zst_lines"] == result["zst_rows"] == result["zst_distinct"] == 4000
    # 1000 ips x 3 ports, all with the same timestamp: one row per key
    assert result["scans"] == result["scan_keys"] == 3000
    # the failure really happened (once per job that ran the flaky stage)
    assert len((tmp_path / "injected").read_text()) >= 2

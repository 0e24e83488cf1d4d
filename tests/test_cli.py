"""Command line: etl -> refresh (rebuild, then fresh) -> publish."""

from __future__ import annotations

import os

from portlens.__main__ import main


def test_cli_round(spark, edge_input, tmp_path, capsys):
    out, dst = str(tmp_path / "out"), str(tmp_path / "pub")
    sized = ("spark.sql.files.maxPartitionBytes", "spark.sql.shuffle.partitions",
             "spark.sql.adaptive.advisoryPartitionSizeInBytes")
    saved = {k: spark.conf.get(k, None) for k in sized}
    try:
        assert main(["etl", edge_input, out, "--input-gb", "0.001"]) == 0
        assert spark.conf.get("spark.sql.shuffle.partitions") == "200"
    finally:
        for k, v in saved.items():
            if v is None:
                spark.conf.unset(k)
            else:
                spark.conf.set(k, v)
    assert main(["refresh", out]) == 0
    assert main(["refresh", out]) == 0
    assert main(["publish", out, dst]) == 0
    printed = capsys.readouterr().out
    assert "rebuilt org_scores" in printed and "org_scores is fresh" in printed
    assert "copied scans, vulns, org_scores" in printed
    assert sorted(os.listdir(dst)) == ["org_scores", "scans", "vulns"]
    assert spark.read.parquet(f"{dst}/org_scores").count() == 3

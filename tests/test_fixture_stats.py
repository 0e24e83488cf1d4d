"""Coverage statistics of the banners derived from the driver tables, as
listed for the same derivation rules in FIXTURES.md §3 (an independent trial)."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from portlens.operators.rollup import org_scores
from portlens.operators.transform import explode_vulns
from portlens.plans import catalog

EXPECTED = {
    "/root/testdata/sf0.001": dict(
        counts=(1000, 191, 211), excluded=(58, 79, 54), capped_negative=(6, 19), null_country=25,
        bands={"9": 27, "7": 36, "4": 55, "<4": 71, "NULL": 22}, orgs=(12, 1), combined=(12.9, 83.65),
        hist=None,
    ),
    "/root/testdata/sf0.01": dict(
        counts=(10000, 1807, 2092), excluded=(615, 723, 469), capped_negative=(37, 200), null_country=251,
        bands={"9": 194, "7": 354, "4": 564, "<4": 733, "NULL": 247}, orgs=(37, 16), combined=(7.62, 86.225),
        hist={0: 1, 10: 1, 20: 13, 30: 6, 40: 1, 50: 5, 70: 4, 80: 6},
    ),
}


@pytest.mark.parametrize("sf", sorted(EXPECTED))
def test_derived_banner_statistics(spark, sf):
    exp = EXPECTED[sf]
    scans = catalog._scans(spark, sf).cache()
    try:
        cves = explode_vulns(scans)
        assert (catalog._banners(spark, sf).count(), scans.count(), cves.count()) == exp["counts"]
        flags = tuple(scans.where(c).count() for c in ("is_excluded", "NOT is_excluded", "is_excluded IS NULL"))
        assert flags == exp["excluded"]
        assert (scans.where("ip_risk_score = 100").count(), scans.where("ip_risk_score < 0").count()) == \
            exp["capped_negative"]
        assert scans.where("country_code IS NULL").count() == exp["null_country"]
        cvss = F.col("cvss")
        band = (F.when(cvss >= 9, "9").when(cvss >= 7, "7").when(cvss >= 4, "4")
                .when(cvss.isNotNull(), "<4").otherwise("NULL"))
        assert {r[0]: r[1] for r in cves.groupBy(band).count().collect()} == exp["bands"]
        orgs = org_scores(scans)
        assert (orgs.count(), orgs.where("exists(countries, x -> x IS NULL)").count()) == exp["orgs"]
        lo, hi = orgs.agg(F.min("combined_risk_score"), F.max("combined_risk_score")).first()
        assert (round(lo, 6), round(hi, 6)) == exp["combined"]
        if exp["hist"]:
            bucket = (F.floor(F.col("combined_risk_score") / 10) * 10).alias("b")
            assert {r[0]: r[1] for r in orgs.groupBy(bucket).count().collect()} == exp["hist"]
    finally:
        scans.unpersist()

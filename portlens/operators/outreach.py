"""Outreach material for the riskiest organisations: per-organisation context
(top ports, top CVEs, top services, certificate issues), the prompt and
fallback text built from it, and which organisations still need a pitch.

The text-generation call itself is an external service and not part of the
engine; everything it is fed is computed here.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .. import config as C
from ..session import shared_root
from .rollup import eligible_scans
from .transform import explode_vulns

# ---------------------------------------------------------------------------
# Prompt and fallback wording (must stay as written)
# ---------------------------------------------------------------------------
SYSTEM_PROMPT = """You are a senior cybersecurity sales consultant. 
Generate a compelling, personalized sales outreach email for a prospect 
based on their actual network security exposure data from Shodan scans.

Rules:
- Be professional but urgent — they have real vulnerabilities
- Reference SPECIFIC findings (CVEs, ports, products, locations)
- DO NOT fabricate vulnerabilities not in the data
- Include a clear call-to-action
- Keep under 200 words
- Suggest 2-3 specific services that could help
"""

USER_PROMPT_FORMAT = """
Generate a sales pitch for the following organization:

**Organization:** %s
**Risk Score:** %s/100
**Location(s):** %s
**Total Exposed IPs:** %s
**Open Ports:** %s
**Known Vulnerabilities:**
%s
**Exposed Services:**
%s
**SSL Issues:**
%s

Tone: %s
Focus Area: %s
"""

FALLBACK_FORMAT = (
    "Hi IT Team at %s,\nWe noticed %s exposed IPs with a high risk score of %s. Let's chat."
)

# Our choices where the original page is absent.
DEFAULT_TONE = "Professional"
DEFAULT_FOCUS = "Vulnerability Management"


def fixed1(x: Column) -> Column:
    """A double as text with one decimal, rounded half away from zero, in
    integer arithmetic (no locale or float-formatting differences)."""
    t = F.floor(F.abs(x) * F.lit(10) + F.lit(0.5)).cast("long")
    sign = F.when(x < 0, F.lit("-")).otherwise(F.lit(""))
    return F.concat(sign, (t / 10).cast("long").cast("string"), F.lit("."), (t % 10).cast("string"))


def eligible_orgs(org_scores: DataFrame, n: int = C.PITCH_ELIGIBLE_TOP_N) -> DataFrame:
    """The n riskiest organisations (ties by name) with their rank. A top-k
    (TakeOrderedAndProject), so the result has at most n rows; the rank is
    computed over those n rows only."""
    top = org_scores.orderBy(F.col("combined_risk_score").desc(), F.col("org").asc()).limit(n)
    w = Window.orderBy(F.col("combined_risk_score").desc(), F.col("org").asc())
    return top.withColumn("pitch_rank", F.row_number().over(w))


def _listed_text(df: DataFrame, group: str, order: list[Column], text: Column, sep: str) -> DataFrame:
    """All rows of a group as one ordered string; ``df`` is already
    aggregated, so a group has one row per distinct value."""
    w = Window.partitionBy(group).orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(w))
    return ranked.groupBy(group).agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct(F.col("_r"), text.alias("t")))), lambda s: s["t"]),
            sep,
        ).alias("text")
    )


def _ordered_text(cond: Column, text: Column, sep: str) -> Column:
    """Texts of the rows meeting ``cond`` joined in rank order (``_r``);
    NULL when there are none."""
    items = F.array_sort(F.collect_list(F.when(cond, F.struct(F.col("_r"), text.alias("t")))))
    return F.when(F.size(items) > 0, F.array_join(F.transform(items, lambda x: x["t"]), sep))


def outreach_context(scans: DataFrame, org_scores: DataFrame, n: int = C.PITCH_ELIGIBLE_TOP_N) -> DataFrame:
    """One row per eligible organisation with everything a pitch needs.

    Every list is complete: an organisation's ports, products and CVEs are
    bounded by their distinct values, not by its rows. Rows are aggregated
    once by (org, port, product); the grouping sets (ports, products,
    certificate counts) expand those aggregated rows only. The eligible set
    has at most ``n`` rows; how it is joined is left to its measured size.
    """
    # Computed once (at most n rows) into the shared checkpoint folder; the
    # three places below read it instead of re-running the ranking (and,
    # for a lazily defined `org_scores`, the whole rollup) each time.
    shared_root(org_scores.sparkSession)
    top = eligible_orgs(org_scores, n).checkpoint(eager=True)
    rows = eligible_scans(scans).join(top.select("org"), "org", "left_semi")

    # One pass over the rows for three groupings: (org, port), (org, product)
    # and (org). grouping_id tells the sets apart (NULL ports and products
    # are real values in their own set and are skipped below).
    weak_tls = F.coalesce(F.exists("ssl_versions", lambda v: v.isin(*C.WEAK_TLS_VERSIONS)), F.lit(False))
    counted = rows.groupBy("org", "port", "product").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(F.col("ssl_expired") == F.lit(True)).alias("n_expired"),
        F.count_if(F.coalesce(F.array_contains("tags", C.SELF_SIGNED_TAG), F.lit(False))).alias("n_self_signed"),
        F.count_if(weak_tls).alias("n_weak_tls"),
    )
    sets = counted.groupingSets([["org", "port"], ["org", "product"], ["org"]], "org", "port", "product").agg(
        F.grouping_id().alias("_g"),
        *[F.sum(c).alias(c) for c in ("n", "n_expired", "n_self_signed", "n_weak_tls")],
    )
    # Rank ports and products per organisation in one window (partitioned by
    # org and set), then fold all three sets into one row per org.
    g, n_ = F.col("_g"), F.col("n")
    kept = sets.where(((g == 1) & F.col("port").isNotNull()) | ((g == 2) & F.col("product").isNotNull()) | (g == 3))
    w = Window.partitionBy("org", "_g").orderBy(n_.desc(), F.col("port").asc(), F.col("product").asc())
    ranked = kept.withColumn("_r", F.row_number().over(w))
    port_text = F.concat(F.col("port").cast("string"), F.lit(" ("), n_.cast("string"), F.lit(")"))
    service_text = F.concat(F.lit("- "), F.col("product"), F.lit(" ("), n_.cast("string"), F.lit(" services)"))
    summary = ranked.groupBy("org").agg(
        _ordered_text(g == 1, port_text, ", ").alias("open_ports_summary"),
        _ordered_text(g == 2, service_text, "\n").alias("services_summary"),
        F.max(F.when(g == 3, F.col("n_expired"))).alias("n_expired"),
        F.max(F.when(g == 3, F.col("n_self_signed"))).alias("n_self_signed"),
        F.max(F.when(g == 3, F.col("n_weak_tls"))).alias("n_weak_tls"),
    )

    cves = explode_vulns(rows).groupBy("org", "cve_id").agg(
        F.max("cvss").alias("cvss"), F.max("epss").alias("epss"), F.count(F.lit(1)).alias("n")
    )
    cve_line = F.concat(
        F.lit("- "), F.col("cve_id"),
        F.lit(" (CVSS "), F.coalesce(F.col("cvss").cast("string"), F.lit("n/a")),
        F.lit(", EPSS "), F.coalesce(F.col("epss").cast("string"), F.lit("n/a")),
        F.lit(") on "), F.col("n").cast("string"), F.lit(" services"),
    )
    cves_txt = _listed_text(
        cves, "org", [F.col("cvss").desc_nulls_last(), F.col("cve_id").asc()], cve_line, "\n"
    ).withColumnRenamed("text", "cve_details")

    summary = summary.select(
        "org", "open_ports_summary", "services_summary",
        F.concat(
            F.lit("- expired certificates: "), F.col("n_expired").cast("string"),
            F.lit("\n- self-signed certificates: "), F.col("n_self_signed").cast("string"),
            F.lit("\n- weak TLS (SSLv3/TLSv1.0): "), F.col("n_weak_tls").cast("string"),
        ).alias("ssl_issues"),
    )

    return (
        top.select(
            "org", "pitch_rank", "combined_risk_score", "total_ips", "total_open_ports",
            F.array_join(F.col("countries"), ", ", "unknown").alias("locations"),
        )
        .join(summary, "org", "left")
        .join(cves_txt, "org", "left")
        .fillna({"open_ports_summary": "none", "cve_details": "none known", "services_summary": "none identified"})
    )


def outreach_text(context: DataFrame, tone: str = DEFAULT_TONE, focus_area: str = DEFAULT_FOCUS,
                  with_system_prompt: bool = True) -> DataFrame:
    """System prompt, prompt and fallback text per organisation."""
    score = fixed1(F.col("combined_risk_score"))
    prompt = F.format_string(
        USER_PROMPT_FORMAT,
        F.col("org"), score, F.col("locations"), F.col("total_ips").cast("string"),
        F.col("open_ports_summary"), F.col("cve_details"), F.col("services_summary"), F.col("ssl_issues"),
        F.lit(tone), F.lit(focus_area),
    )
    fallback = F.format_string(FALLBACK_FORMAT, F.col("org"), F.col("total_ips").cast("string"), score)
    cols = ["org", "pitch_rank", prompt.alias("user_prompt"), fallback.alias("fallback_text")]
    if with_system_prompt:
        cols.append(F.lit(SYSTEM_PROMPT).alias("system_prompt"))
    return context.select(*cols)


def pitches_needed(eligible: DataFrame, cached: DataFrame, force: bool = False) -> DataFrame:
    """Eligible organisations without a cached pitch (all of them when forced)."""
    if force:
        return eligible
    return eligible.join(cached.select("org"), "org", "left_anti")


def pitch_rows(texts: DataFrame, generated_at: Column | None = None, tone: str = DEFAULT_TONE,
               focus_area: str = DEFAULT_FOCUS) -> DataFrame:
    """Rows for the pitch cache from generated (here: fallback) text."""
    return texts.select(
        "org",
        F.col("fallback_text").alias("pitch_text"),
        (generated_at if generated_at is not None else F.current_timestamp()).alias("generated_at"),
        F.lit(tone).alias("tone"),
        F.lit(focus_area).alias("focus_area"),
    )

"""Independent DuckDB SQL for every query in ``catalog``.

The banner rules are restated in SQL without any JSON or map: the CVEs of a
banner are generated as rows. Scoring follows the original relational form
(explode, sum per (ip_str, port), left join on both keys), so the fused
Spark form is checked against a different formulation.
"""

from __future__ import annotations



def _sql_list(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" if isinstance(v, str) else str(v) for v in values)


# Written out here, not taken from the engine: a wrong constant there must show.
_EXCLUDED = _sql_list([
    "Google LLC", "Amazon.com, Inc.", "Cloudflare, Inc.", "Microsoft Corporation", "DigitalOcean, LLC", "OVH SAS",
    "Hetzner Online AG", "Linode", "Incapsula Inc", "Fastly, Inc.", "Akamai Technologies",
])

# Three-valued array_contains(tags, 'cdn') as Spark evaluates it.
_HAS_CDN = (
    "CASE WHEN tags IS NULL THEN NULL WHEN list_contains(tags, 'cdn') THEN TRUE "
    "WHEN len(list_filter(tags, lambda x: x IS NULL)) > 0 THEN NULL ELSE FALSE END"
)

BASE_CTES = f"""
ev AS (
  SELECT e.event_id AS e, e.user_id AS u, e.ts AS ts, e.value AS value, n.n_name AS n_name
  FROM events e LEFT JOIN nation n ON n.n_nationkey = e.user_id % 25
  WHERE /*EV_FILTER*/TRUE
),
raw AS (
  SELECT *,
    CAST([22, 23, 80, 443, 3389, 3306, 5432, 8291, 27017, 6379, 1521, 8080][e % 12 + 1] AS INTEGER) AS port,
    CASE e % 7 WHEN 0 THEN 'Fortinet FortiGate' WHEN 1 THEN 'DrayTek Vigor' WHEN 2 THEN 'nginx'
               WHEN 3 THEN 'HIKVISION cam' END AS product
  FROM ev
),
flat AS (
  SELECT
    CASE WHEN e % 97 <> 0 THEN '10.' || CAST(u % 4 AS VARCHAR) || '.' || CAST(u % 8 AS VARCHAR) || '.' || CAST(u AS VARCHAR) END AS ip_str,
    port,
    CASE WHEN e % 50 = 0 THEN 'udp' ELSE 'tcp' END AS transport,
    CASE WHEN e % 89 <> 0 THEN CAST(ts AS TIMESTAMP) END AS "timestamp",
    CASE WHEN u % 11 = 0 THEN NULL WHEN u % 13 = 0 THEN 'Linode' WHEN u % 17 = 0 THEN 'Google LLC'
         ELSE 'Org-' || CAST(u % 37 AS VARCHAR) END AS org,
    'ISP-' || CAST(u % 5 AS VARCHAR) AS isp,
    'AS' || CAST(u % 37 + 64500 AS VARCHAR) AS asn,
    product,
    CASE WHEN e % 9 = 0 THEN '1.' || CAST(e % 5 AS VARCHAR) END AS version,
    CASE WHEN e % 16 = 0 THEN 'banner ' || CAST(e AS VARCHAR) END AS info,
    CASE e % 8 WHEN 1 THEN CAST([] AS VARCHAR[]) WHEN 2 THEN ['cdn'] WHEN 3 THEN ['honeypot']
               WHEN 4 THEN ['self-signed'] WHEN 5 THEN ['cloud', NULL] WHEN 6 THEN ['self-signed', 'cdn']
               WHEN 7 THEN ['vpn'] END AS tags,
    CASE WHEN u % 7 <> 6 THEN 'City-' || CAST(u % 25 AS VARCHAR) END AS city,
    CASE WHEN u % 7 <> 6 THEN n_name END AS country_name,
    CASE WHEN u % 7 <> 6 THEN 'C' || CAST(u % 25 AS VARCHAR) END AS country_code,
    CASE WHEN u % 7 <> 6 THEN CAST((u * 7) % 180 - 90 AS DOUBLE) END AS latitude,
    CASE WHEN u % 7 <> 6 THEN CAST((u * 13) % 360 - 180 AS DOUBLE) END AS longitude,
    CASE WHEN value > 60 THEN TRUE WHEN value > 20 THEN FALSE END AS ssl_expired,
    CASE e % 5 WHEN 0 THEN ['SSLv3'] WHEN 1 THEN ['TLSv1.0', 'TLSv1.2'] WHEN 2 THEN ['TLSv1.2']
               WHEN 3 THEN CAST([] AS VARCHAR[]) END AS ssl_versions,
    CASE WHEN port IN (80, 443, 8080) THEN product END AS http_server,
    CASE WHEN port IN (80, 443, 8080) THEN 'page ' || CAST(e AS VARCHAR) END AS http_title,
    CASE u % 3 WHEN 0 THEN 'aws' WHEN 1 THEN 'gcp' END AS cloud_provider,
    CAST(NULL AS VARCHAR) AS cloud_service,
    e AS hash,
    CASE (u % 37) % 4 WHEN 0 THEN e % 8 WHEN 1 THEN e % 3 ELSE 0 END AS n_cves
  FROM raw
),
dedup AS (
  SELECT * EXCLUDE (rn) FROM (
    SELECT *, row_number() OVER (PARTITION BY ip_str, port
                                 ORDER BY "timestamp" DESC NULLS LAST, hash DESC NULLS LAST) AS rn
    FROM flat) WHERE rn = 1
),
vulns AS (
  SELECT d.ip_str, d.port, d.org,
    'CVE-2024-' || CAST((d.hash * 7 + r.k * 3) % 1000 AS VARCHAR) AS cve_id,
    CASE WHEN (d.hash + r.k) % 10 <> 9 THEN ((d.hash * 13 + r.k * 29) % 101) / 10 END AS cvss,
    ((d.hash * 17 + r.k * 31) % 100) / 100 AS epss,
    'finding ' || CAST((d.hash + r.k) % 50 AS VARCHAR) AS cve_summary,
    (d.hash + r.k) % 5 = 0 AS cve_verified
  FROM dedup d JOIN range(0, 7) AS r(k) ON r.k < d.n_cves
),
cve_scored AS (
  SELECT *, CAST(CASE WHEN cvss >= 9.0 THEN 25 WHEN cvss >= 7.0 THEN 15 WHEN cvss >= 4.0 THEN 8 ELSE 0 END
                 + CASE WHEN epss >= 0.5 THEN 10 ELSE 0 END
                 + CASE WHEN cve_verified = TRUE THEN 5 ELSE 0 END AS INTEGER) AS cve_score
  FROM vulns
),
vuln_totals AS (
  SELECT ip_str, port, CAST(SUM(cve_score) AS BIGINT) AS vuln_score_total FROM cve_scored GROUP BY ip_str, port
),
rules AS (
  SELECT d.* EXCLUDE (hash, n_cves),
    CASE WHEN version IS NOT NULL THEN 10 ELSE 0 END AS rule_version,
    CASE WHEN ssl_expired = TRUE THEN 12 ELSE 0 END AS rule_expired_cert,
    CASE WHEN list_contains(tags, 'self-signed') THEN 8 ELSE 0 END AS rule_self_signed,
    CASE WHEN list_contains(ssl_versions, 'SSLv3') OR list_contains(ssl_versions, 'TLSv1.0') THEN 8 ELSE 0 END AS rule_weak_tls,
    CASE WHEN port IN (22, 23, 3389, 8291) THEN 5 ELSE 0 END AS rule_admin_port,
    CASE WHEN port IN (3306, 5432, 1521, 27017, 6379) THEN 8 ELSE 0 END AS rule_db_port,
    CASE WHEN regexp_matches(product, '(?i)fortinet|hikvision|draytek') THEN 10 ELSE 0 END AS rule_device,
    CASE WHEN list_contains(tags, 'honeypot') THEN -100 ELSE 0 END AS rule_honeypot,
    (org IN ({_EXCLUDED})) OR ({_HAS_CDN}) AS is_excluded
  FROM dedup d
),
based AS (
  SELECT * EXCLUDE (rule_version, rule_expired_cert, rule_self_signed, rule_weak_tls, rule_admin_port,
                    rule_db_port, rule_device, rule_honeypot),
    CAST(rule_version + rule_expired_cert + rule_self_signed + rule_weak_tls + rule_admin_port
         + rule_db_port + rule_device + rule_honeypot AS INTEGER) AS score_base
  FROM rules
),
scans AS (
  SELECT b.*, COALESCE(v.vuln_score_total, 0) AS vuln_score_total,
    CAST(CASE WHEN b.is_excluded = TRUE THEN 0
              ELSE LEAST(100, b.score_base + COALESCE(v.vuln_score_total, 0)) END AS BIGINT) AS ip_risk_score
  FROM based b LEFT JOIN vuln_totals v ON b.ip_str = v.ip_str AND b.port = v.port
),
org_base AS (
  SELECT org,
    COUNT(DISTINCT ip_str) AS total_ips,
    COUNT(DISTINCT ip_str || ':' || CAST(port AS VARCHAR)) AS total_open_ports,
    MAX(ip_risk_score) AS max_risk_score,
    AVG(ip_risk_score) AS avg_risk_score,
    list_sort(LIST(DISTINCT country_name)) AS countries
  FROM scans
  WHERE org IS NOT NULL AND is_excluded = FALSE
  GROUP BY org
),
org_scores AS (
  SELECT *, LEAST(100.0, 0.7 * max_risk_score + 0.3 * avg_risk_score + LEAST(10.0, 0.5 * total_ips)) AS combined_risk_score FROM org_base
)
"""


_CTE_NAMES = ("ev", "raw", "flat", "dedup", "vulns", "cve_scored", "vuln_totals", "rules", "based",
              "scans", "org_base", "org_scores")


def chain(prefix: str = "", event_filter: str = "TRUE") -> str:
    """The CTE chain, with every CTE name prefixed and the events filtered."""
    import re

    text = BASE_CTES.strip().replace("/*EV_FILTER*/TRUE", f"({event_filter})")
    if prefix:
        text = re.sub(r"\b(" + "|".join(_CTE_NAMES) + r")\b", lambda m: prefix + m.group(1), text)
    return text


def _q(body: str, *extra: str) -> str:
    parts = [chain()] + list(extra)
    return "WITH " + ",\n".join(parts) + "\n" + body.strip()


CUTOFF = "2024-01-16 00:00:00"
_EARLIER = f"COALESCE(e.ts < TIMESTAMP '{CUTOFF}', FALSE)"
_LATER = f"NOT COALESCE(e.ts < TIMESTAMP '{CUTOFF}', FALSE)"

_NL = "chr(10)"


def _fixed1(x: str) -> str:
    t = f"CAST(floor(abs({x}) * 10 + 0.5) AS BIGINT)"
    return (f"(CASE WHEN {x} < 0 THEN '-' ELSE '' END || CAST({t} // 10 AS VARCHAR) || '.' "
            f"|| CAST({t} % 10 AS VARCHAR))")


def _sql_str(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _outreach_ctes(p: str = "") -> list[str]:
    """Outreach context over the chain with prefix ``p``."""
    from ..operators import outreach as O

    return [
        f"""{p}top AS (
  SELECT *, CAST(row_number() OVER (ORDER BY combined_risk_score DESC, org ASC) AS INTEGER) AS pitch_rank
  FROM (SELECT * FROM {p}org_scores ORDER BY combined_risk_score DESC, org ASC LIMIT 500)
)""",
        f"""{p}erows AS (
  SELECT * FROM {p}scans WHERE org IS NOT NULL AND is_excluded = FALSE AND org IN (SELECT org FROM {p}top)
)""",
        f"""{p}ports_txt AS (
  SELECT org, string_agg(CAST(port AS VARCHAR) || ' (' || CAST(n AS VARCHAR) || ')', ', ' ORDER BY r) AS open_ports_summary
  FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY n DESC, port ASC) AS r
        FROM (SELECT org, port, COUNT(*) AS n FROM {p}erows WHERE port IS NOT NULL GROUP BY org, port))
  GROUP BY org
)""",
        f"""{p}services_txt AS (
  SELECT org, string_agg('- ' || product || ' (' || CAST(n AS VARCHAR) || ' services)', {_NL} ORDER BY r) AS services_summary
  FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY n DESC, product ASC) AS r
        FROM (SELECT org, product, COUNT(*) AS n FROM {p}erows WHERE product IS NOT NULL GROUP BY org, product))
  GROUP BY org
)""",
        f"""{p}cves_txt AS (
  SELECT org, string_agg('- ' || cve_id || ' (CVSS ' || COALESCE(CAST(cvss AS VARCHAR), 'n/a') || ', EPSS '
                         || COALESCE(CAST(epss AS VARCHAR), 'n/a') || ') on ' || CAST(n AS VARCHAR) || ' services',
                         {_NL} ORDER BY r) AS cve_details
  FROM (SELECT *, row_number() OVER (PARTITION BY org ORDER BY cvss DESC NULLS LAST, cve_id ASC) AS r
        FROM (SELECT er.org, v.cve_id, MAX(v.cvss) AS cvss, MAX(v.epss) AS epss, COUNT(*) AS n
              FROM {p}erows er JOIN {p}vulns v
                ON er.ip_str IS NOT DISTINCT FROM v.ip_str AND er.port IS NOT DISTINCT FROM v.port
              GROUP BY er.org, v.cve_id))
  GROUP BY org
)""",
        f"""{p}ssl_txt AS (
  SELECT org, '- expired certificates: ' || CAST(COUNT(*) FILTER (WHERE ssl_expired = TRUE) AS VARCHAR)
      || {_NL} || '- self-signed certificates: '
      || CAST(COUNT(*) FILTER (WHERE COALESCE(list_contains(tags, 'self-signed'), FALSE)) AS VARCHAR)
      || {_NL} || '- weak TLS (SSLv3/TLSv1.0): '
      || CAST(COUNT(*) FILTER (WHERE COALESCE(list_contains(ssl_versions, 'SSLv3')
                                              OR list_contains(ssl_versions, 'TLSv1.0'), FALSE)) AS VARCHAR)
      AS ssl_issues
  FROM {p}erows GROUP BY org
)""",
        f"""{p}context AS (
  SELECT t.org, t.pitch_rank, t.combined_risk_score, t.total_ips, t.total_open_ports,
         array_to_string(list_transform(t.countries, lambda x: COALESCE(x, 'unknown')), ', ') AS locations,
         COALESCE(pt.open_ports_summary, 'none') AS open_ports_summary,
         COALESCE(ct.cve_details, 'none known') AS cve_details,
         COALESCE(st.services_summary, 'none identified') AS services_summary,
         sl.ssl_issues
  FROM {p}top t
  LEFT JOIN {p}ports_txt pt ON pt.org = t.org
  LEFT JOIN {p}cves_txt ct ON ct.org = t.org
  LEFT JOIN {p}services_txt st ON st.org = t.org
  LEFT JOIN {p}ssl_txt sl ON sl.org = t.org
)""",
        f"""{p}texts AS (
  SELECT org, pitch_rank,
    printf({_sql_str(O.USER_PROMPT_FORMAT)}, org, {_fixed1('combined_risk_score')}, locations,
           CAST(total_ips AS VARCHAR), open_ports_summary, cve_details, services_summary, ssl_issues,
           {_sql_str(O.DEFAULT_TONE)}, {_sql_str(O.DEFAULT_FOCUS)}) AS user_prompt,
    printf({_sql_str(O.FALLBACK_FORMAT)}, org, CAST(total_ips AS VARCHAR), {_fixed1('combined_risk_score')}) AS fallback_text,
    {_sql_str(O.SYSTEM_PROMPT)} AS system_prompt
  FROM {p}context
)""",
    ]


def _band(col: str) -> str:
    return (f"CASE WHEN {col} >= 70 THEN 'red' "
            f"WHEN {col} >= 40 THEN 'orange' ELSE 'blue' END")


ORACLE_SQL: dict[str, str] = {
    "ingest_count": _q("""
        SELECT COUNT(*) AS n_banners,
               COUNT(*) FILTER (WHERE ip_str IS NULL OR port IS NULL) AS n_without_key
        FROM flat"""),
    "flatten": _q("SELECT * EXCLUDE (n_cves) FROM flat"),
    "dedup_latest": _q("SELECT * EXCLUDE (hash, n_cves) FROM dedup"),
    "explode_vulns": _q("SELECT * FROM vulns"),
    "base_score_rules": _q("""
        SELECT ip_str, port, rule_version, rule_expired_cert, rule_self_signed, rule_weak_tls,
               rule_admin_port, rule_db_port, rule_device, rule_honeypot,
               CAST(rule_version + rule_expired_cert + rule_self_signed + rule_weak_tls + rule_admin_port
                    + rule_db_port + rule_device + rule_honeypot AS INTEGER) AS score_base
        FROM rules"""),
    "exclusion_flag": _q("SELECT ip_str, port, org, tags, is_excluded FROM rules"),
    "cve_score": _q("SELECT * FROM cve_scored"),
    "vuln_score_total": _q("SELECT * FROM vuln_totals"),
    "scored_scans": _q("SELECT * FROM scans"),
    "scored_scans_fused": _q("SELECT * FROM scans"),
    "org_scores": _q("SELECT * FROM org_scores"),
    "kpis": _q(f"""
        SELECT COUNT(*) AS total_orgs, CAST(COALESCE(SUM(total_ips), 0) AS BIGINT) AS total_ips,
               COUNT(*) FILTER (WHERE combined_risk_score >= 70) AS high_risk_orgs,
               ROUND(AVG(combined_risk_score), 6) AS avg_combined_score
        FROM org_scores"""),
    "top10_orgs": _q(f"SELECT * FROM org_scores ORDER BY combined_risk_score DESC, org ASC LIMIT 10"),
    "score_histogram": _q(f"""
        SELECT CAST(floor(combined_risk_score / 10.0) * 10 AS BIGINT) AS bucket,
               COUNT(*) AS n_orgs
        FROM org_scores GROUP BY 1"""),
    "prospect_filter": _q("SELECT * FROM org_scores WHERE combined_risk_score >= 40.0 AND total_ips >= 2"),
    "prospect_sort": _q("""
        SELECT org, total_ips, total_open_ports, max_risk_score, avg_risk_score,
               array_to_string(list_transform(countries, lambda x: COALESCE(x, 'unknown')), ';') AS countries,
               combined_risk_score
        FROM org_scores ORDER BY total_ips DESC, org"""),
    "org_selector": _q("SELECT org FROM org_scores ORDER BY org"),
    "org_deep_dive": _q("""
        SELECT s.org, s.ip_str, s.port, s.transport, s.product, s.version, s.ip_risk_score,
               o.combined_risk_score, o.total_ips
        FROM scans s JOIN org_scores o ON s.org = o.org
        WHERE s.org IS NOT NULL AND s.is_excluded = FALSE"""),
    "org_cves": _q("""
        SELECT v.org, v.ip_str, v.port, v.cve_id, v.cvss, v.epss, v.cve_summary, v.cve_verified
        FROM vulns v JOIN (SELECT DISTINCT ip_str, port FROM scans WHERE org IS NOT NULL AND is_excluded = FALSE) s
          ON v.ip_str IS NOT DISTINCT FROM s.ip_str AND v.port IS NOT DISTINCT FROM s.port"""),
    "geo_points": _q(f"""
        SELECT ip_str, port, org, latitude, longitude, ip_risk_score, {_band('ip_risk_score')} AS risk_band
        FROM scans WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND ip_risk_score >= 0"""),
    "geo_grid": _q(f"""
        SELECT lat_cell, lon_cell, n_services, max_risk_score, avg_risk_score, {_band('max_risk_score')} AS risk_band
        FROM (
          SELECT CAST(floor(latitude / 1.0) AS BIGINT) AS lat_cell,
                 CAST(floor(longitude / 1.0) AS BIGINT) AS lon_cell,
                 COUNT(*) AS n_services, MAX(ip_risk_score) AS max_risk_score, AVG(ip_risk_score) AS avg_risk_score
          FROM scans WHERE latitude IS NOT NULL AND longitude IS NOT NULL
          GROUP BY 1, 2)"""),
    "cloud_segments": _q("""
        SELECT COALESCE(cloud_provider, 'on-prem') AS segment, COUNT(*) AS n_services,
               COUNT(DISTINCT ip_str) AS n_ips, AVG(ip_risk_score) AS avg_risk_score,
               COUNT(*) FILTER (WHERE is_excluded = TRUE) AS n_excluded
        FROM scans GROUP BY 1"""),
    "risk_bands": _q(f"SELECT org, combined_risk_score, {_band('combined_risk_score')} AS risk_band FROM org_scores"),
    "outreach_context": _q("SELECT * FROM context", *_outreach_ctes()),
    "outreach_text": _q("SELECT * FROM texts", *_outreach_ctes()),
    "outreach_pending": _q(
        f"""SELECT t.org, t.pitch_rank, t.combined_risk_score FROM top t
            WHERE t.org NOT IN (SELECT org FROM p_org_scores WHERE combined_risk_score >= 70)""",
        *_outreach_ctes(), chain("p_", _EARLIER)),
    "json_roundtrip": _q("SELECT * EXCLUDE (n_cves) FROM flat"),
    "zst_scan": _q("SELECT * EXCLUDE (hash, n_cves) FROM dedup"),
    "partitioned_roundtrip": _q(
        f"SELECT * EXCLUDE (country_code), COALESCE(country_code, 'unknown') AS country_code FROM scans"),
    "optional_vulns": _q("SELECT * FROM vulns"),
    "merge_schema": _q(f"""
        SELECT * REPLACE (
          CASE WHEN COALESCE("timestamp" < TIMESTAMP '{CUTOFF}', FALSE) THEN NULL ELSE http_title END AS http_title,
          CASE WHEN COALESCE("timestamp" < TIMESTAMP '{CUTOFF}', FALSE) THEN NULL ELSE cloud_service END AS cloud_service)
        FROM scans"""),
    "refresh_ttl": _q("SELECT * FROM org_scores"),
    "org_scores_sql": _q("SELECT * FROM org_scores"),
    "metadata_upsert": _q(
        """SELECT * FROM l_org_scores
           UNION ALL
           SELECT * FROM e_org_scores WHERE org NOT IN (SELECT org FROM l_org_scores)""",
        chain("e_", _EARLIER), chain("l_", _LATER)),
    "publish_copy": _q("SELECT * FROM org_scores"),
    "publish_scans": _q("SELECT * EXCLUDE (country_code), COALESCE(country_code, 'unknown') AS country_code FROM scans"),
    "publish_vulns": _q("SELECT * FROM vulns"),
    # the written files repeat every 50th banner inside an array line and add lines without a record
    "etl_from_files": _q("""
        SELECT * EXCLUDE (country_code), COALESCE(country_code, 'unknown') AS country_code FROM scans
        WHERE NOT (ip_str IS NULL AND port IS NULL)"""),
    "refresh_decision": """
        SELECT * FROM (VALUES ('1 missing', TRUE), ('2 fresh', FALSE), ('3 stale', TRUE), ('4 forced', TRUE), ('5 bad metadata', TRUE))
          AS t(step, rebuilt)""",
    "incremental_scans": _q("SELECT * EXCLUDE (country_code), COALESCE(country_code, 'unknown') AS country_code FROM scans"),
    "incremental_vulns": _q("SELECT * FROM vulns"),
    "incremental_org_scores": _q("SELECT * FROM org_scores"),
    "rejected_lines": """
        SELECT CASE event_id % 101
                 WHEN 0 THEN '{"ip_str": "10.9.9.' || CAST(event_id AS VARCHAR)
                 WHEN 1 THEN '{"ip_str": "10.9.9.9", "port": "p' || CAST(event_id AS VARCHAR) || '"}'
                 WHEN 2 THEN '[{"port": 1}, {"port": "q' || CAST(event_id AS VARCHAR) || '"}]'
                 ELSE CAST(event_id AS VARCHAR) END AS line,
               CASE WHEN event_id % 101 = 2 THEN 1 ELSE 0 END AS position,
               CASE event_id % 101 WHEN 0 THEN 'malformed' WHEN 3 THEN 'not_an_object' ELSE 'wrong_type' END AS reason
        FROM events WHERE event_id % 101 <= 3""",
    # the damaged records leave three keys: (10.9.9.9, NULL), (NULL, 1) and (NULL, NULL), the last only if no banner has it
    "quarantined_scans": "WITH " + chain("g_", "e.event_id % 101 > 3") + """
        SELECT * EXCLUDE (country_code), COALESCE(country_code, 'unknown') AS country_code FROM g_scans
        UNION ALL BY NAME
        SELECT ip_str, CAST(port AS INTEGER) AS port, 'unknown' AS country_code, 0 AS score_base,
               CAST(0 AS BIGINT) AS vuln_score_total, CAST(0 AS BIGINT) AS ip_risk_score
        FROM (VALUES (1, '10.9.9.9', NULL), (2, NULL, 1), (2, NULL, NULL)) AS d(case_, ip_str, port)
        WHERE EXISTS (FROM events WHERE event_id % 101 = case_)""",
    "catalog_org_scores": _q("SELECT * FROM org_scores"),
    "catalog_pitches": _q(
        """SELECT org, fallback_text AS pitch_text, TRUE AS stamped FROM texts
           WHERE org IN (SELECT org FROM org_scores WHERE combined_risk_score >= 70)
           UNION ALL
           SELECT org, fallback_text, TRUE FROM p_texts
           WHERE org NOT IN (SELECT t.org FROM texts t JOIN org_scores o ON t.org = o.org WHERE o.combined_risk_score >= 70)""",
        *_outreach_ctes(), chain("p_", _EARLIER), *_outreach_ctes("p_")),
    "publish_together": _q("""
        SELECT 'scans' AS name, COUNT(*) AS n_rows FROM scans UNION ALL
        SELECT 'vulns', COUNT(*) FROM vulns UNION ALL
        SELECT 'org_scores', COUNT(*) FROM org_scores"""),
    "scored_scans_colocated": _q("SELECT * FROM scans"),
    "etl_metrics": _q("""
        SELECT (SELECT COUNT(*) FROM flat) AS n_banners,
               (SELECT COUNT(*) FROM flat WHERE ip_str IS NULL OR port IS NULL) AS n_without_key,
               COUNT(*) AS n_scans, COUNT(*) FILTER (WHERE is_excluded) AS n_excluded,
               COUNT(*) FILTER (WHERE is_excluded IS NULL) AS n_exclusion_unknown,
               (SELECT COUNT(*) FROM vulns) AS n_cves
        FROM scans"""),
    "geo_levels": _q(f"""
        SELECT zoom, quadkey, n_services, max_risk_score, avg_risk_score, {_band('max_risk_score')} AS risk_band
        FROM (
          SELECT CAST(z AS INTEGER) AS zoom,
                 array_to_string(list_transform(range(1, z + 1), lambda i:
                   CAST(2 * ((CAST(floor((latitude + 90) / 180 * 2 ** z) AS BIGINT) >> CAST(z - i AS INTEGER)) & 1)
                        + ((CAST(floor((longitude + 180) / 360 * 2 ** z) AS BIGINT) >> CAST(z - i AS INTEGER)) & 1) AS VARCHAR)), '') AS quadkey,
                 COUNT(*) AS n_services, MAX(ip_risk_score) AS max_risk_score, AVG(ip_risk_score) AS avg_risk_score
          FROM scans, range(0, 9) AS zooms(z)
          WHERE latitude IS NOT NULL AND longitude IS NOT NULL
          GROUP BY 1, 2)"""),
    "ip_lookup": _q("""
        SELECT ip_str, port, transport, org, product, version, ip_risk_score FROM scans
        WHERE ip_str IN ('10.0.0.8', '10.1.1.1', '10.2.2.50', '10.3.3.999999', 'none')"""),
    "export_csv": _q("""
        SELECT org, total_ips, total_open_ports, max_risk_score, avg_risk_score,
               array_to_string(list_transform(countries, lambda x: COALESCE(x, 'unknown')), ';') AS countries,
               combined_risk_score
        FROM org_scores WHERE list_contains(countries, 'FRANCE')"""),
    "schema_drift": _q(f"""
        SELECT * REPLACE (CAST(port AS BIGINT) AS port, CAST(score_base AS VARCHAR) AS score_base,
          CASE WHEN COALESCE("timestamp" < TIMESTAMP '{CUTOFF}', FALSE) THEN NULL ELSE http_title END AS http_title,
          CASE WHEN COALESCE("timestamp" < TIMESTAMP '{CUTOFF}', FALSE) THEN NULL ELSE isp END AS isp)
        FROM scans"""),
}

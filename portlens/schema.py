"""Explicit schemas: the raw banner record, the trimmed scan schema and the
small serving tables. No schema is ever inferred from data.

Fixed values: the field names, nesting and types of the banner record are
the input format and must stay exactly as written (a renamed or retyped
field would parse as NULL).
"""

from __future__ import annotations

from pyspark.sql.types import (
    ArrayType,
    BooleanType,
    DoubleType,
    IntegerType,
    LongType,
    MapType,
    StringType,
    StructField,
    StructType,
    TimestampType,
)

_STR = StringType()
_STR_ARRAY = ArrayType(StringType())
_STR_MAP = MapType(StringType(), StringType())


def _struct(*fields: tuple[str, object]) -> StructType:
    return StructType([StructField(name, dtype, True) for name, dtype in fields])


location_schema = _struct(
    ("city", _STR),
    ("country_code", _STR),
    ("country_name", _STR),
    ("latitude", DoubleType()),
    ("longitude", DoubleType()),
    ("region_code", _STR),
    ("area_code", IntegerType()),
)

vuln_detail_schema = _struct(
    ("cvss", DoubleType()),
    ("cvss_version", DoubleType()),
    ("cvss_v2", DoubleType()),
    ("epss", DoubleType()),
    ("ranking_epss", DoubleType()),
    ("summary", _STR),
    ("references", _STR_ARRAY),
    ("verified", BooleanType()),
)

ssl_cert_schema = _struct(
    ("subject", _STR_MAP),
    ("issuer", _STR_MAP),
    ("expires", _STR),
    ("expired", BooleanType()),
)

ssl_schema = _struct(("cert", ssl_cert_schema), ("versions", _STR_ARRAY), ("cipher", _STR_MAP))
cloud_schema = _struct(("provider", _STR), ("region", _STR), ("service", _STR))
http_schema = _struct(
    ("status", IntegerType()), ("title", _STR), ("server", _STR), ("components", _STR_MAP)
)
crawler_schema = _struct(("module", _STR), ("crawler", _STR), ("id", _STR), ("region", _STR))

# One scan record (one service banner) as it appears in the NDJSON input.
banner_schema = _struct(
    ("ip_str", _STR),
    ("ip", LongType()),
    ("port", IntegerType()),
    ("transport", _STR),
    ("timestamp", _STR),
    ("hostnames", _STR_ARRAY),
    ("domains", _STR_ARRAY),
    ("org", _STR),
    ("isp", _STR),
    ("asn", _STR),
    ("os", _STR),
    ("product", _STR),
    ("version", _STR),
    ("cpe", _STR_ARRAY),
    ("info", _STR),
    ("tags", _STR_ARRAY),
    ("location", location_schema),
    ("cloud", cloud_schema),
    ("ssl", ssl_schema),
    ("http", http_schema),
    ("vulns", MapType(StringType(), vuln_detail_schema)),
    ("_shodan", crawler_schema),
    ("hash", LongType()),
    ("data", _STR),
)

# The JSON reader parses every field of the schema it is given, even ones the
# plan never uses (nested struct fields are not pruned for JSON). Handing it a
# schema with only the fields the pipeline reads avoids materialising the raw
# banner payload (`data`), certificate maps and crawler metadata per row.
# `vulns` keeps its full value type because it is carried into `scans`.
scan_schema = _struct(
    ("ip_str", _STR),
    ("port", IntegerType()),
    ("transport", _STR),
    ("timestamp", _STR),
    ("org", _STR),
    ("isp", _STR),
    ("asn", _STR),
    ("product", _STR),
    ("version", _STR),
    ("info", _STR),
    ("tags", _STR_ARRAY),
    ("location", _struct(
        ("city", _STR),
        ("country_code", _STR),
        ("country_name", _STR),
        ("latitude", DoubleType()),
        ("longitude", DoubleType()),
    )),
    ("cloud", _struct(("provider", _STR), ("service", _STR))),
    ("ssl", _struct(("cert", _struct(("expired", BooleanType()))), ("versions", _STR_ARRAY))),
    ("http", _struct(("title", _STR), ("server", _STR))),
    ("vulns", MapType(StringType(), vuln_detail_schema)),
    ("hash", LongType()),
)

# CVE rows (one per ip_str, port, cve_id).
vulns_schema = _struct(
    ("ip_str", _STR),
    ("port", IntegerType()),
    ("org", _STR),
    ("cve_id", _STR),
    ("cvss", DoubleType()),
    ("epss", DoubleType()),
    ("cve_summary", _STR),
    ("cve_verified", BooleanType()),
)

# Cached outreach text, one row per organisation (key: org).
pitch_schema = StructType([
    StructField("org", StringType(), False),
    StructField("pitch_text", StringType(), True),
    StructField("generated_at", TimestampType(), True),
    StructField("tone", StringType(), True),
    StructField("focus_area", StringType(), True),
])

# Key/value metadata (key: key); the refresh stamp lives here.
metadata_schema = StructType([
    StructField("key", StringType(), False),
    StructField("value", StringType(), True),
])

"""Column names, types and defaults of the two log kinds."""

from __future__ import annotations

from pyspark.sql import types as T

# --- fixed values: log layouts (position matters) ---------------------------
CONN_FIELDS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "service",
    "duration", "orig_bytes", "resp_bytes", "conn_state", "local_orig", "local_resp",
    "missed_bytes", "history", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
    "tunnel_parents",
]
DNS_FIELDS = [
    "ts", "uid", "id.orig_h", "id.orig_p", "id.resp_h", "id.resp_p", "proto", "trans_id",
    "rtt", "query", "qclass", "qclass_name", "qtype", "qtype_name", "rcode", "rcode_name",
    "AA", "TC", "RD", "RA", "Z", "answers", "TTLs", "rejected",
]
CONN_LABEL_FIELDS = ["label", "detailed-label"]
# ---------------------------------------------------------------------------

CONN_INTS = [
    "orig_p", "resp_p", "orig_bytes", "resp_bytes", "missed_bytes",
    "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes",
]
CONN_DOUBLES = ["ts", "duration"]
CONN_BOOLS = ["local_orig", "local_resp"]
DNS_INTS = ["orig_p", "resp_p"]
DNS_DOUBLES = ["ts"]

# Value given to a column that the input does not have.
CONN_DEFAULTS = {
    "uid": "", "orig_h": "", "resp_h": "", "proto": "unknown", "service": "unknown",
    "conn_state": "unknown", "history": "", "tunnel_parents": "none",
    "local_orig": False, "local_resp": False,
}


def flat(name: str) -> str:
    """Dotted log names become plain column names: ``id.orig_h`` -> ``orig_h``."""
    return name.removeprefix("id.").replace("-", "_")


CONN_COLUMNS = [flat(c) for c in CONN_FIELDS]
DNS_COLUMNS = [flat(c) for c in DNS_FIELDS]


def conn_type(name: str) -> T.DataType:
    if name in CONN_INTS:
        return T.LongType()
    if name in CONN_DOUBLES:
        return T.DoubleType()
    if name in CONN_BOOLS:
        return T.BooleanType()
    return T.StringType()


def text_schema(fields: list[str]) -> T.StructType:
    """Every field as text: the shape of a log line before it is typed."""
    return T.StructType([T.StructField(f, T.StringType()) for f in fields])

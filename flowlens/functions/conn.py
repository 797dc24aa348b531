"""Scalar features of one connection: Column in, Column out."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# --- fixed values ------------------------------------------------------------
FAILED_STATES = ["REJ", "S0", "RSTO", "RSTR", "RSTOS0", "RSTRH", "SH", "SHR"]
TCP_SERVICES = {80: "http", 8080: "http", 443: "https", 8443: "https", 22: "ssh", 21: "ftp", 25: "smtp",
                110: "pop3", 143: "imap", 53: "dns", 23: "telnet"}
UDP_SERVICES = {53: "dns", 67: "dhcp", 68: "dhcp", 123: "ntp", 161: "snmp", 162: "snmp"}
WELL_KNOWN_PORT, REGISTERED_PORT, LAST_PORT = 1023, 49151, 65535
BENIGN_LABELS = ["normal", "benign", "0", "false", "unknown"]
ATTACK_LABELS = [
    "attack", "malicious", "anomaly", "1", "true", "dos", "ddos", "portscan", "bruteforce", "brute force",
    "infiltration", "botnet", "web attack", "bot", "dos hulk", "dos slowhttptest", "dos slowloris", "heartbleed",
    "ftp-patator", "ssh-patator", "c&c", "command and control", "botnet command", "partofahorizontalportscan",
    "port scan", "reconnaissance", "web attack â\u0080\u0093 brute force",
    "web attack â\u0080\u0093 sql injection", "web attack â\u0080\u0093 xss",
]
CRITICAL_TOKENS = FAILED_STATES
SUSPICIOUS_TOKENS = ["S1", "S2", "S3", "FIN", "PUSH"]
NORMAL_TOKENS = ["SF", "ESTABLISHED"]
COVERT_RECORDS = ["TXT", "MX", "CNAME", "SRV", "PTR"]
COMMON_RECORDS = ["A", "AAAA"]
# Address blocks that are not globally reachable.
PRIVATE_V4 = (r"^(10\.|127\.|0\.|192\.168\.|169\.254\.|172\.(1[6-9]|2[0-9]|3[01])\.|198\.1[89]\.|192\.0\.2\.|192\.0\.0\."
              r"|198\.51\.100\.|203\.0\.113\.|2(4[0-9]|5[0-5])\.)")
PRIVATE_V6 = r"^(::1?$|f[cd][0-9a-f]{2}:|fe[89ab][0-9a-f]:|2001:db8:)"
# -----------------------------------------------------------------------------


def failed_connection() -> Column:
    return F.coalesce(F.col("conn_state").isin(FAILED_STATES), F.lit(False)).cast("int")


def tunneled_connection() -> Column:
    return F.coalesce(~F.col("tunnel_parents").isin("", "-", "none"), F.lit(False)).cast("int")


def history_features() -> dict[str, Column]:
    h = F.coalesce(F.col("history"), F.lit(""))
    return {"hist_len": F.length(h), "hist_R_count": F.regexp_count(h, F.lit("[Rr]")), "hist_has_T": h.rlike("[Tt]").cast("int")}


def port_bin(port: str) -> Column:
    p = F.col(port)
    return (F.when(p.isNull() | (p <= WELL_KNOWN_PORT), "low").when(p <= REGISTERED_PORT, "medium")
            .when(p <= LAST_PORT, "high").otherwise("very_high"))


def infer_service(proto: str = "proto", port: str = "resp_p") -> Column:
    p = F.coalesce(F.col(port), F.lit(0))

    def named(table: Mapping[int, str], suffix: str) -> Column:
        chain = F.when(F.lit(False), "")
        for name in dict.fromkeys(table.values()):
            chain = chain.when(p.isin([n for n, s in table.items() if s == name]), name)
        return chain.when(p <= WELL_KNOWN_PORT, f"well_known_{suffix}").otherwise(f"dynamic_{suffix}")

    kind = F.col(proto)
    return (F.when(kind == "tcp", named(TCP_SERVICES, "tcp")).when(kind == "udp", named(UDP_SERVICES, "udp"))
            .when(kind == "icmp", "icmp").otherwise("unknown"))


def service_bin(top_services: Sequence[str], service: str = "service") -> Column:
    """The list is at most fifteen names long, so it travels as literals."""
    s = F.col(service)
    first, next_ten = list(top_services[:5]), list(top_services[5:15])
    return (F.when(s.isNull() | s.isin("unknown", "-", ""), "rare").when(s.isin(first), "common")
            .when(s.isin(next_ten), "uncommon").otherwise("rare"))


def conn_features(df: DataFrame, top_services: Sequence[str]) -> DataFrame:
    """All stateless connection features in one projection."""
    return df.withColumns({
        **history_features(),
        "is_failed_connection": failed_connection(),
        "is_tunneled_connection": tunneled_connection(),
        "orig_port_binned": port_bin("orig_p"),
        "resp_port_binned": port_bin("resp_p"),
        "service_binned": service_bin(top_services),
    })


def require(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Fails while the plan is built when feature columns are missing."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {missing}")
    return df


def private_ip(address: Column) -> Column:
    """Whether an address is private, loopback, link-local or reserved."""
    v4 = address.rlike(r"^[0-9]{1,3}(\.[0-9]{1,3}){3}$") & address.rlike(PRIVATE_V4)
    return F.coalesce(v4 | F.lower(address).rlike(PRIVATE_V6), F.lit(False))


def _hits(line: Column, tokens: Sequence[str], weight: int) -> Column:
    total = F.lit(0)
    for t in tokens:
        total = total + line.contains(t).cast("int") * weight
    return total


def triage_score(line: Column, kind: str) -> Column:
    """0-100: how soon a raw line should be looked at."""
    if kind == "conn":
        remote = F.when(line.contains(":22") | line.contains(":23") | line.contains(":3389"), 15)
        ports = remote.when(line.contains(":80") | line.contains(":443"), 5).otherwise(0)
        score = _hits(line, CRITICAL_TOKENS, 25) + _hits(line, SUSPICIOUS_TOKENS, 10) + _hits(line, NORMAL_TOKENS, 1) + ports
    else:
        lowered = F.lower(line)
        hints = (lowered.contains("dga") | lowered.contains("tunnel")).cast("int") * 25
        score = _hits(line, COVERT_RECORDS, 30) + hints + _hits(line, COMMON_RECORDS, 2)
    return F.least(F.lit(100), score)


def alert_id(*parts: Column) -> Column:
    """Twelve hex digits over the parts; the same alert always gets the same id."""
    return F.substring(F.md5(F.concat_ws("_", *[F.coalesce(p.cast("string"), F.lit("")) for p in parts])), 1, 12)


def normal_label(label: Column) -> Column:
    """1 for an attack word; benign and unknown words are 0."""
    return F.coalesce(F.lower(label).isin(ATTACK_LABELS), F.lit(False)).cast("int")


def as_number(value: Column, default: float = 0.0) -> Column:
    """Missing, empty, '-' or unreadable values become the default."""
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None)), F.lit(default))


def evidence(names: Sequence[str]) -> Column:
    """Named numeric columns of a row as a map; unreadable values are 0."""
    return F.create_map(*[x for n in names for x in (F.lit(n), as_number(F.col(n)))])

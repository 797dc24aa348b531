"""Line formats and envelopes, rendered from the tables and read back."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens import schema as S
from flowlens.fixtures import ctes, view
from flowlens.session import checkpoint_dir
from flowlens.sources import zeek
from flowlens.sources.envelope import unwrap_conn, unwrap_dns
from flowlens.sources.zeek import split_lines

QUERIES, SQL = {}, {}

HEAD = ["ts_us", "uid", "orig_h", "orig_p", "resp_h", "resp_p", "proto", "service", "duration"]


def src2(s, d):
    # every third line stops after five fields
    conn = view(s, d, "conn")
    full = F.concat_ws("\t", *[F.col(c).cast("string") for c in HEAD])
    short = F.concat_ws("\t", *[F.col(c).cast("string") for c in HEAD[:5]])
    lines = conn.select(F.when(F.col("orig_p") % 3 == 0, short).otherwise(full).alias("value"))
    return split_lines(lines, "conn").select("uid", "resp_h", "resp_p", "proto", "conn_state")


QUERIES["SRC_2_ragged_lines"] = src2
SQL["SRC_2_ragged_lines"] = ctes("conn") + """select uid, resp_h, case when orig_p % 3 = 0 then '-' else cast(resp_p as varchar) end as resp_p, case when orig_p % 3 = 0 then '-' else proto end as proto, '-' as conn_state from conn"""


def json_rows(df, fields):
    return F.to_json(F.struct(*[F.col(S.flat(f)).alias(f) for f in fields]))


def folder(s):
    return f"{checkpoint_dir(s)}/flowlens-{uuid.uuid4().hex}"


def lines_of(df, fields, *more):
    """Tab-separated lines; ``-`` for what the table does not have."""
    return F.concat_ws("\t", *[F.coalesce(F.col(S.flat(f)).cast("string"), F.lit("-")) if S.flat(f) in df.columns else F.lit("-") for f in fields], *more)


def write_log(lines, header, path):
    """Text files that each begin with the header."""
    def headed(batches):
        yield pd.DataFrame({"value": [header]})
        yield from batches

    lines.mapInPandas(headed, "value string").write.text(path)


def src4(s, d):
    conn, path = view(s, d, "conn").withColumn("ts", F.col("ts_us") / 1e6), folder(s)
    have = [f for f in S.CONN_FIELDS if S.flat(f) in conn.columns]
    conn.select(json_rows(conn, have).alias("value")).write.text(path)
    return zeek.read_conn_json(s, path).select("uid", "orig_h", F.col("orig_bytes").cast("bigint").alias("orig_bytes"), "local_orig")


QUERIES["SRC_4_json_lines"] = src4
SQL["SRC_4_json_lines"] = ctes("conn") + "select uid, orig_h, orig_bytes, null as local_orig from conn"


def src5(s, d):
    path = folder(s)
    view(s, d, "conn").select("uid", "orig_h", "resp_p", "proto").write.option("header", True).csv(path)
    return zeek.read_conn_csv(s, path).select("uid", "orig_h", F.col("resp_p").cast("bigint").alias("resp_p"), "proto")


QUERIES["SRC_5_csv_lines"] = src5
SQL["SRC_5_csv_lines"] = ctes("conn") + "select uid, orig_h, resp_p, proto from conn"


def src6(s, d):
    # one folder of four formats, dealt by port: labelled and plain lines, JSON, CSV with a label
    conn, path = view(s, d, "conn").withColumn("ts", F.col("ts_us")), folder(s)
    part = lambda i: conn.filter(F.col("orig_p") % 4 == i)
    part(0).select(lines_of(conn, S.CONN_FIELDS, F.concat(F.lit("L"), F.col("proto")), F.lit("-")).alias("value")).write.text(f"{path}/0")
    part(1).select(lines_of(conn, S.CONN_FIELDS).alias("value")).write.text(f"{path}/1")
    have = [f for f in S.CONN_FIELDS if S.flat(f) in conn.columns]
    part(2).select(json_rows(conn, have).alias("value")).write.text(f"{path}/2")
    part(3).select("uid", "ts", F.concat_ws(",", F.lit("a"), "proto").alias("label"), "resp_p").write.option("header", True).csv(f"{path}/3")
    rows = zeek.read_conn(s, [f"{path}/{i}" for i in range(4)])
    return rows.select("uid", F.col("ts").cast("bigint").alias("ts"), F.col("resp_p").cast("bigint").alias("resp_p"), "proto", "label", "tunnel_parents")


QUERIES["SRC_6_mixed_formats"] = src6
SQL["SRC_6_mixed_formats"] = ctes("conn") + """select uid, ts_us as ts, resp_p, case orig_p % 4 when 3 then 'unknown' else proto end as proto,
 case orig_p % 4 when 0 then 'L' || proto when 3 then 'a,' || proto end as label,
 case orig_p % 4 when 3 then 'none' else nullif(tunnel_parents, '-') end as tunnel_parents from conn"""


def src7(s, d):
    # three kinds of files under one glob: their columns differ in number and order, one has no header
    dns, path = view(s, d, "dns").withColumn("ts", F.col("ts_us")), folder(s)
    part = lambda i: dns.filter(F.col("ts_us") % 3 == i)
    for i, fields in ((0, ["uid", "query", "ts"]), (1, ["ts", "rcode_name", "uid", "id.orig_h", "query", "qtype_name"])):
        write_log(part(i).select(lines_of(dns, fields).alias("value")), "#fields\t" + "\t".join(fields), f"{path}/{i}")
    part(2).select(lines_of(dns, S.DNS_FIELDS).alias("value")).write.text(f"{path}/2")
    return zeek.read_dns(s, [f"{path}/*"]).select("uid", F.col("ts").cast("bigint").alias("ts"), "query", "rcode_name", "orig_h", "qtype_name", "TTLs")


QUERIES["SRC_7_mixed_headers"] = src7
SQL["SRC_7_mixed_headers"] = ctes("dns") + """select uid, ts_us as ts, nullif(query, '-') as query, case when ts_us % 3 > 0 then rcode_name end as rcode_name, case when ts_us % 3 > 0 then orig_h end as orig_h,
 case when ts_us % 3 > 0 then qtype_name end as qtype_name, case when ts_us % 3 = 2 then nullif("TTLs", '-') end as "TTLs" from dns"""


def src8(s, d):
    conn = view(s, d, "conn").withColumns({
        "ts": F.when(F.col("orig_p") % 7 > 0, F.col("ts_us") / 1e6), "local_orig": F.expr("case orig_p % 3 when 0 then true when 1 then false end"),
        "orig_bytes": F.when(F.col("orig_p") % 5 > 0, F.col("orig_bytes")), "service": F.nullif(F.col("service"), F.lit(""))})
    have = [f for f in S.CONN_FIELDS if S.flat(f) in conn.columns]
    lines = conn.select(F.to_json(F.struct(json_rows(conn, have).alias("message"), F.lit("conn").alias("pipeline"))).alias("value"))
    return unwrap_conn(lines).select("uid", "orig_h", "resp_p", "orig_bytes", "local_orig", "service", "conn_state")


QUERIES["SRC_8_conn_envelope"] = src8
SQL["SRC_8_conn_envelope"] = ctes("conn") + """select uid, orig_h, cast(resp_p as varchar) as resp_p, case when orig_p % 5 > 0 then cast(orig_bytes as varchar) else '0' end as orig_bytes,
 case orig_p % 3 when 0 then 'T' when 1 then 'F' else '' end as local_orig, service, conn_state from conn where orig_p % 7 > 0"""


def src9(s, d):
    dns = view(s, d, "dns").withColumns({"ts": F.col("ts_us") / 1e6, "query": F.when(F.col("ts_us") % 6 > 0, F.col("query"))})
    listed = F.split(F.col("TTLs"), ",")
    message = F.to_json(F.struct("ts", "uid", F.col("orig_h").alias("id.orig_h"), "query", "qtype_name", listed.alias("TTLs")))
    return unwrap_dns(dns.select(F.to_json(F.struct(message.alias("message"))).alias("value"))).select("uid", "orig_h", "query", "qtype_name", "TTLs", "rcode_name")


QUERIES["SRC_9_dns_envelope"] = src9
SQL["SRC_9_dns_envelope"] = ctes("dns") + "select uid, orig_h, query, qtype_name, \"TTLs\", '' as rcode_name from dns where ts_us % 6 > 0"


def src13(s, d):
    # every fourth line is cut in the middle and cannot be read
    kind = T.StructType([T.StructField("alert_id", T.StringType()), T.StructField("risk_score", T.IntegerType())])
    line, path = F.to_json(F.struct("alert_id", "risk_score")), folder(s)
    view(s, d, "alerts").select(F.when(F.col("dst_port") % 4 == 0, F.substring(line, 1, 9)).otherwise(line).alias("value")).write.text(path)
    return zeek.read_findings(s, path, kind)


QUERIES["SRC_13_tolerant_json"] = src13
SQL["SRC_13_tolerant_json"] = ctes("alerts") + "select alert_id, risk_score from alerts where dst_port % 4 <> 0"

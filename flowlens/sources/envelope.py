"""Queue envelopes: a JSON object whose ``message`` is itself JSON text."""

from __future__ import annotations

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schema as S

NUMBERS = ["ts", "id.orig_p", "id.resp_p", "duration", "orig_bytes", "resp_bytes", "missed_bytes", "orig_pkts", "orig_ip_bytes", "resp_pkts", "resp_ip_bytes"]
ZERO_WHEN_MISSING = ["duration", "orig_bytes", "resp_bytes", "orig_ip_bytes", "resp_ip_bytes"]
BOOLEANS = ["local_orig", "local_resp"]
LISTS = ["answers", "TTLs"]


def _opened(df: DataFrame, fields: list[str], required: list[str], column: str) -> DataFrame:
    """All fields as text; a JSON list stays JSON text. Messages that lack a required field drop out.

    They leave a list of one message, not by a filter: that would be pushed below the
    parsing, and every message parsed once more for each required field."""
    message = F.from_json(F.get_json_object(F.col(column), "$.message"), S.text_schema(fields))
    whole = F.filter(F.array(message), lambda m: reduce(and_, [F.coalesce(m.getField(name), F.lit("")) != "" for name in required]))
    return df.select(*[c for c in df.columns if c != column], F.explode(whole).alias("_m"))


def _field(name: str) -> Column:
    return F.coalesce(F.col("_m").getField(name), F.lit(""))


def _number(name: str) -> Column:
    text = _field(name)
    value = F.when(text == "", "").when(text.try_cast("double").isNull(), "0").otherwise(text)
    return F.when(value == "", "0").otherwise(value) if name in ZERO_WHEN_MISSING else value


def _truth(name: str) -> Column:
    return F.when(_field(name) == "", "").when(F.lower(_field(name)).isin("true", "t", "1"), "T").otherwise("F")


def _joined(name: str) -> Column:
    text = _field(name)
    items = F.from_json(text, "array<string>")
    return F.when(text.startswith("["), F.array_join(items, ",")).otherwise(text)


def _unwrap(df: DataFrame, fields: list[str], required: list[str], column: str) -> DataFrame:
    form = {**{c: _number for c in NUMBERS}, **{c: _truth for c in BOOLEANS}, **{c: _joined for c in LISTS}}
    opened = _opened(df, fields, required, column)
    keep = [c for c in df.columns if c != column]
    return opened.select(*keep, *[form.get(c, _field)(c).alias(S.flat(c)) for c in fields])


def unwrap_conn(df: DataFrame, column: str = "value") -> DataFrame:
    """Connections from envelopes, as text; those without ts or uid are rejected."""
    return _unwrap(df, S.CONN_FIELDS, ["ts", "uid"], column)


def unwrap_dns(df: DataFrame, column: str = "value") -> DataFrame:
    """DNS queries from envelopes, as text; ts, uid and query are required."""
    return _unwrap(df, S.DNS_FIELDS, ["ts", "uid", "query"], column)

"""Typing and cleaning of log rows."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import schema as S

MISSING_WORDS = ["-", "nan", "None", ""]
TRUE_WORDS = ["t", "true", "1"]
MAGNITUDES = [c for c in S.CONN_INTS if c not in ("orig_p", "resp_p")]
CATEGORY_DEFAULTS = {"proto": "unknown", "service": "unknown", "conn_state": "unknown", "history": "", "tunnel_parents": "none"}


def align_schema(df: DataFrame, columns: Sequence[str] = S.CONN_COLUMNS, defaults: Mapping[str, object] = S.CONN_DEFAULTS) -> DataFrame:
    """Exactly ``columns``, in order; a missing one gets its default (else 0)."""
    present = set(df.columns)
    return df.select(*[F.col(c) if c in present else F.lit(defaults.get(c, 0)).alias(c) for c in columns])


def to_double(value: Column) -> Column:
    return F.coalesce(F.nanvl(value.try_cast("double"), F.lit(None)), F.lit(0.0))


def to_bigint(value: Column) -> Column:
    """``3``, ``3.7`` and ``3e2`` are read by way of a double; bad text is 0."""
    return F.coalesce(value.try_cast("double").try_cast("bigint"), F.lit(0).cast("bigint"))


def to_boolean(value: Column) -> Column:
    return F.coalesce(F.lower(value.cast("string")).isin(TRUE_WORDS), F.lit(False))


def category(value: Column, default: str) -> Column:
    return F.when(value.isNull() | value.isin(MISSING_WORDS), default).otherwise(value)


def numeric_columns(df: DataFrame) -> DataFrame:
    """Unreadable numbers become 0; bytes and packets lose their sign."""
    known = {c: to_double(F.col(c)) for c in ("ts", "duration") if c in df.columns}
    known |= {c: to_bigint(F.col(c)) for c in ("orig_p", "resp_p") if c in df.columns}
    known |= {c: F.abs(to_bigint(F.col(c))) for c in MAGNITUDES if c in df.columns}
    return df.withColumns(known)


def category_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: category(F.col(c), d) for c, d in CATEGORY_DEFAULTS.items() if c in df.columns})


def boolean_columns(df: DataFrame) -> DataFrame:
    return df.withColumns({c: to_boolean(F.col(c)) for c in S.CONN_BOOLS if c in df.columns})


def with_ts_us(df: DataFrame) -> DataFrame:
    return df.withColumn("ts_us", F.round(F.col("ts") * 1e6).cast("bigint"))


def drop_empty_rows(df: DataFrame) -> DataFrame:
    return df.dropna(how="all")


def drop_untimed(df: DataFrame) -> DataFrame:
    return df.dropna(subset=["ts"])


def clean_conn(df: DataFrame) -> DataFrame:
    """Training form: aligned, typed, with defaults; keeps a label when there is one."""
    labels = [c for c in ("label", "detailed_label") if c in df.columns]
    aligned = align_schema(drop_empty_rows(df), [*S.CONN_COLUMNS, *labels])
    return with_ts_us(boolean_columns(category_columns(numeric_columns(drop_untimed(aligned)))))


def _serve(df: DataFrame, ints: Sequence[str], doubles: Sequence[str], bools: Sequence[str]) -> DataFrame:
    typed = {c: to_bigint(F.col(c)) for c in ints} | {c: to_double(F.col(c)) for c in doubles} | {c: to_boolean(F.col(c)) for c in bools}
    rest = {c: F.when(F.col(c) == "-", "").otherwise(F.col(c)) for c, t in df.dtypes if t == "string" and c not in typed}
    return with_ts_us(df.withColumns({**{c: e for c, e in typed.items() if c in df.columns}, **rest}))


def cast_conn(df: DataFrame) -> DataFrame:
    """Serving form of a connection: typed, ``-`` is the empty string."""
    return _serve(df, S.CONN_INTS, S.CONN_DOUBLES, S.CONN_BOOLS)


def cast_dns(df: DataFrame) -> DataFrame:
    return _serve(df, S.DNS_INTS, S.DNS_DOUBLES, [])


def coerce_numeric(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Text with a point is read as a double, else as an integer; ``<name>_num``
    is null where the text is not a number and must stay text."""
    def number(c: str) -> Column:
        value = F.col(c)
        whole = value.try_cast("bigint").cast("double")
        return F.when(value.contains("."), value.try_cast("double")).otherwise(whole)

    return df.withColumns({f"{c}_num": number(c) for c in columns})


def time_quality(df: DataFrame, *, now_us: Column | None = None) -> DataFrame:
    """Flags rows that claim to come from the future."""
    now = now_us if now_us is not None else F.unix_micros(F.current_timestamp())
    return df.withColumn("future_ts", F.col("ts_us") > now)

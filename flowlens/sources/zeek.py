"""Readers of connection and DNS logs in their several shapes."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens import schema as S
from flowlens.operators.clean import cast_conn, cast_dns
from flowlens.session import cut_lineage

FIELDS = {"conn": S.CONN_FIELDS, "dns": S.DNS_FIELDS}


def _flat(df: DataFrame) -> DataFrame:
    return df.toDF(*[S.flat(c) for c in df.columns])


def header_fields(spark: SparkSession, path: str, kind: str) -> list[str]:
    """Column names of the first ``#fields`` line, else the default list."""
    line = spark.read.text(path).filter(F.col("value").startswith("#fields")).first()
    return line[0].split("\t")[1:] if line else FIELDS[kind]


def read_zeek_tsv(spark: SparkSession, path: str, kind: str, *, header: bool = False, fields: Sequence[str] | None = None) -> DataFrame:
    """Tab-separated log as text columns: ``#`` lines skipped, ``-`` is null, lines
    of another width dropped."""
    names = list(fields) if fields else header_fields(spark, path, kind) if header else FIELDS[kind]
    reader = spark.read.schema(S.text_schema(names)).option("sep", "\t").option("comment", "#").option("nullValue", "-").option("quote", "")
    # Without pruning a line is judged by all its fields, whatever is selected.
    reader = reader.option("columnPruning", False).option("mode", "DROPMALFORMED")
    return _flat(reader.csv(path))


def split_lines(lines: DataFrame, kind: str, *, column: str = "value") -> DataFrame:
    """Ragged lines: short ones are padded with ``-``, extra fields are ignored."""
    kept = lines.filter((F.trim(F.col(column)) != "") & ~F.col(column).startswith("#"))
    parts = kept.select("*", F.split(F.col(column), "\t").alias("_f"))
    names = [S.flat(c) for c in FIELDS[kind]]
    rest = [c for c in lines.columns if c != column and c not in names]
    return parts.select(*rest, *[F.coalesce(F.get("_f", F.lit(i)), F.lit("-")).alias(n) for i, n in enumerate(names)])


def read_conn_json(spark: SparkSession, path: str) -> DataFrame:
    return _flat(spark.read.schema(S.text_schema([*S.CONN_FIELDS, *S.CONN_LABEL_FIELDS])).json(path))


def read_conn_csv(spark: SparkSession, path: str) -> DataFrame:
    return _flat(spark.read.option("header", True).option("nullValue", "-").csv(path))


CSV, JSON, TABS = "csv", "json", "tabs"

def is_data() -> Column:
    return ~F.col("value").startswith("#") & (F.trim("value") != "")


def layouts(lines: DataFrame, kind: str) -> DataFrame:
    """(file, form, names, width): how each file's lines read, from its first ``#fields`` line and its first data line.

    A file is CSV by its name, with the column names in the first line, JSON if the
    first line begins with a brace, else tab-separated: columns as the header says;
    without one the usual ones, connections with ``ip_proto`` behind them at 22
    columns and with labels at 23 or more. One row for each file, however long it is.
    """
    place = F.struct("start", "row")
    firsts = lines.groupBy("file").agg(
        F.min_by("value", F.when(F.col("value").startswith("#fields\t"), place)).alias("header"), F.min_by("value", F.when(is_data(), place)).alias("first"))
    form = F.when(F.lower("file").rlike(r"\.csv(\.\w+)?$"), CSV).when(F.col("first").startswith("{"), JSON).otherwise(TABS)
    tabs = F.size(F.split("first", "\t"))
    usual = F.array(*[F.lit(f) for f in FIELDS[kind]])
    if kind == "conn":
        label = F.array(*[F.lit(f) for f in S.CONN_LABEL_FIELDS])
        rest = F.transform(F.sequence(F.lit(0), tabs - 23), lambda i: F.concat(F.lit("extra_"), i.cast("string")))
        # columns behind the 23rd have no name of their own
        usual = F.when(tabs == 22, F.concat(usual, F.array(F.lit("ip_proto")))).when(tabs == 23, F.concat(usual, label)).when(
            tabs > 23, F.concat(usual, label, F.slice(rest, 2, F.greatest(tabs - 23, F.lit(1))))).otherwise(usual)
    named = F.split(F.regexp_replace("header", r"^#fields\t", ""), "\t")
    names = F.when(F.col("form") == CSV, F.transform(F.split("first", ","), lambda c: F.trim(F.replace(c, F.lit('"'), F.lit(""))))).when(
        F.col("form") == JSON, F.array().cast("array<string>")).when(F.col("header").isNotNull(), named).otherwise(usual)
    return firsts.withColumn("form", form).select("file", "form", "first", names.alias("names"))


def read_logs(spark: SparkSession, paths: str | Sequence[str], kind: str) -> DataFrame:
    """Logs of any supported shape, each file by its own header and format, as text columns.

    Columns are found by name; one that a file does not have is null, or the default of
    :func:`align_schema` in a CSV file. ``-`` is null. Tab-separated lines of another
    width than their file's and JSON lines that cannot be read drop out. Labels are kept
    where some file has them; ``file`` names a row's file.
    """
    paths = [paths] if isinstance(paths, str) else list(paths)
    lines = spark.read.text(paths).select(
        "value", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("row"))
    found = cut_lineage(layouts(lines, kind))
    labels = [S.flat(c) for c in S.CONN_LABEL_FIELDS] if kind == "conn" else []
    wanted = [*FIELDS[kind], *(S.CONN_LABEL_FIELDS if labels else [])]
    # a column may go by its dotted or its plain name, in any case
    plain = F.transform("names", lambda n: F.lower(F.replace(F.regexp_replace(n, "^id\\.", ""), F.lit("-"), F.lit("_"))))
    known = found.withColumn("plain", plain).select(
        F.col("file").alias("file_"), "form", F.col("first").alias("head"), F.size("names").alias("width"),
        F.array(*[F.array_position("plain", S.flat(c).lower()).cast("int") - 1 for c in wanted]).alias("at"))
    csv_width = found.filter(F.col("form") == CSV).agg(F.max(F.size("names"))).first()[0] or 0

    data = lines.filter(is_data()).select("value", "file").join(known, F.col("file") == F.col("file_"))
    data = data.filter((F.col("form") != CSV) | (F.col("value") != F.col("head")))  # a CSV header is no row
    parts = F.when(F.col("form") == TABS, F.split("value", "\t"))
    if csv_width:
        columns = ", ".join(f"c{i} string" for i in range(csv_width))
        row = F.from_csv("value", F.lit(columns), {"quote": '"'})
        parts = parts.when(F.col("form") == CSV, F.array(*[row[f"c{i}"] for i in range(csv_width)]))
    data = data.withColumn("parts", parts).withColumn("json", F.when(F.col("form") == JSON, F.from_json("value", S.text_schema(wanted))))
    data = data.filter((F.col("form") == CSV) | (F.col("form") == TABS) & (F.size("parts") == F.col("width")) | F.coalesce(F.to_json("json") != "{}", F.lit(False)))

    def value(i: int, name: str) -> Column:
        at = F.get("at", F.lit(i))
        text = F.when(F.col("form") == JSON, F.col("json")[name]).when(at >= 0, F.get("parts", at))
        text = F.nullif(text, F.lit("-"))
        if kind == "conn" and S.flat(name) not in labels:
            default = str(S.CONN_DEFAULTS.get(S.flat(name), 0)).lower()
            text = F.when((F.col("form") == CSV) & (at < 0), F.lit(default)).otherwise(text)
        return text.alias(S.flat(name))

    out = data.select(*[value(i, c) for i, c in enumerate(wanted)], "file")
    if labels:
        has = F.exists(plain, lambda n: n.isin(labels)) | (F.col("form") == JSON)
        if found.filter(has).limit(1).count() == 0:
            out = out.drop(*labels)
    return out


def read_conn(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Connection logs of any supported shape, decided file by file."""
    return read_logs(spark, path, "conn").drop("file")


def read_dns(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """All dns logs of the globs in ``paths``; every file may have a header of its own."""
    out = read_logs(spark, paths, "dns").drop("file")
    if out.limit(1).count() == 0:
        raise ValueError(f"no readable dns log in {list(paths)}")
    return out


def read_findings(spark: SparkSession, path: str, schema) -> DataFrame:
    """JSON lines; lines that cannot be read are skipped."""
    return spark.read.schema(schema).option("mode", "DROPMALFORMED").json(path)


def typed(df: DataFrame, kind: str) -> DataFrame:
    return cast_conn(df) if kind == "conn" else cast_dns(df)


def stream_lines(spark: SparkSession, path: str, *, max_files: int = 100) -> DataFrame:
    """New lines of a folder of log files; offsets live in the query's checkpoint."""
    lines = spark.readStream.option("maxFilesPerTrigger", max_files).text(path)
    return lines.filter((F.trim("value") != "") & ~F.col("value").startswith("#"))

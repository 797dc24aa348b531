"""Small pieces that several operators share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from flowlens.session import checkpoint_dir
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space, the separators of the word rules.
SPACE = r"[\x20\x09-\x0D]+"
#: Everything between two benchmark words, once A-Z is lower case.
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def settle(df: DataFrame) -> DataFrame:
    """Writes an intermediate table to the shared checkpoint folder and reads it back.

    Columnar files keep it small, and losing an executor costs no recomputation.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/flowlens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def ascii_lower(text: Column) -> Column:
    """Lower case for A-Z only, whatever the locale."""
    return F.translate(text, UPPER, LOWER)


def split_words(text: Column, separators: str) -> Column:
    """Words between runs of separators; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separators), "")


def remainder(doc_id: Column, modulus: int) -> Column:
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def fresh(df: DataFrame, *names: str) -> list[str]:
    """The names, lengthened until none is a column of ``df``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        out.append(name)
    return out


def packed(docs: DataFrame) -> DataFrame:
    """(doc_id, key, body): texts compressed, for the shuffles to come; key is the hash of the text."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        code = zstandard.ZstdCompressor(level=1).compress
        for batch in batches:
            bodies = [code((t.as_py() or "").encode("utf-8", "surrogatepass")) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("key"), pa.array(bodies, pa.binary())], names=["doc_id", "key", "body"])

    return docs.select("doc_id", F.xxhash64("text").alias("key"), "text").mapInArrow(run, f"doc_id {kind}, key long, body binary")


def unpack(body: bytes) -> bytes:
    return zstandard.decompress(body)

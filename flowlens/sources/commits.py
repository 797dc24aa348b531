"""A commit log: which folders make up a table, and which batches are in it.

Every commit is one small JSON file whose number follows the last one's. It holds all
there is to know, so readers open the newest file only and older ones can go. A file
is written under another name and renamed, so it is there whole or not at all; what a
failed writer left behind is named by no commit and is overwritten by the next try.

``runs`` maps a streaming query to its last batch. A replayed batch is known by it, and
a query that starts anew from an empty checkpoint has another id, so its batch 0 is not
mistaken for the old one. One driver writes a table; its threads take turns.
"""

from __future__ import annotations

import json
import threading
from collections import defaultdict

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

KEPT = 10
_TURNS: dict[str, threading.RLock] = defaultdict(threading.RLock)


def query_id(df: DataFrame, default: str = "batch") -> str:
    """The id of the streaming query that a ``foreachBatch`` frame belongs to."""
    return df.sparkSession.sparkContext.getLocalProperty("sql.streaming.queryId") or default


class CommitLog:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self.turn = _TURNS[path]

    def _hadoop(self, path: str):
        target = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return target.getFileSystem(self.spark._jsc.hadoopConfiguration()), target

    def _numbers(self) -> list[int]:
        fs, folder = self._hadoop(f"{self.path}/log")
        if not fs.exists(folder):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(folder)]
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[:-5].isdigit())

    def latest(self) -> dict:
        """The newest commit; before the first one, version 0 without content."""
        numbers = self._numbers()
        if not numbers:
            return {"version": 0, "runs": {}}
        return json.loads(self.spark.read.text(f"{self.path}/log/{numbers[-1]:012d}.json", wholetext=True).first()[0])

    def has(self, entry: dict, run: str, batch: int) -> bool:
        return entry["runs"].get(run, -1) >= batch

    def commit(self, entry: dict, run: str, batch: int) -> None:
        entry["runs"] = {**entry["runs"], run: batch}
        fs, temporary = self._hadoop(f"{self.path}/log/{entry['version']:012d}.writing")
        _, final = self._hadoop(f"{self.path}/log/{entry['version']:012d}.json")
        out = fs.create(temporary, True)
        out.write(bytearray(json.dumps(entry).encode()))
        out.close()
        if fs.exists(final) or not fs.rename(temporary, final):
            raise RuntimeError(f"version {entry['version']} of {self.path} was committed by another writer")
        for number in self._numbers()[:-KEPT]:
            self.remove(f"log/{number:012d}.json")

    def remove(self, name: str) -> None:
        fs, target = self._hadoop(f"{self.path}/{name}")
        fs.delete(target, True)

    def read(self, names: list[str], schema: str) -> DataFrame:
        """The rows of the named folders of one table; ``schema`` is a schema in JSON."""
        kind = T.StructType.fromJson(json.loads(schema))
        if not names:
            return self.spark.createDataFrame([], kind)
        base = f"{self.path}/{names[0].split("/")[0]}"
        return self.spark.read.schema(kind).option("basePath", base).parquet(*[f"{self.path}/{n}" for n in names]).select(*kind.names)

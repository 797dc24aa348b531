"""Saving and loading as stages of a ``pyspark.ml`` Pipeline.

A stage is written as any other: metadata with class and uid, so that a Pipeline finds
the class again, and beside it the constructor's arguments as JSON (estimators) or
whatever the model keeps (``write_data`` and ``read_data``).
"""

from __future__ import annotations

import inspect
import json

from pyspark.ml.util import DefaultParamsReader, DefaultParamsWriter, MLReadable, MLReader, MLWritable, MLWriter
from pyspark.sql import SparkSession


class _Writer(MLWriter):
    def __init__(self, stage):
        super().__init__()
        self.stage = stage

    def saveImpl(self, path: str) -> None:
        DefaultParamsWriter.saveMetadata(self.stage, path, self.sparkSession)
        self.stage.write_data(self.sparkSession, f"{path}/data")


class _Reader(MLReader):
    def __init__(self, kind: type):
        super().__init__()
        self.kind = kind

    def load(self, path: str):
        metadata = DefaultParamsReader.loadMetadata(path, self.sparkSession)
        stage = self.kind.read_data(self.sparkSession, f"{path}/data")
        stage._resetUid(metadata["uid"])
        return stage


class Stage(MLWritable, MLReadable):
    """Mixed into estimators whose constructor arguments are attributes of the same name;
    models replace ``write_data`` and ``read_data``."""

    def write(self) -> MLWriter:
        return _Writer(self)

    @classmethod
    def read(cls) -> MLReader:
        return _Reader(cls)

    def write_data(self, spark: SparkSession, path: str) -> None:
        names = [n for n in inspect.signature(type(self).__init__).parameters if n != "self"]
        write_json(spark, {n: getattr(self, n) for n in names}, path)

    @classmethod
    def read_data(cls, spark: SparkSession, path: str):
        return cls(**read_json(spark, path))


def write_json(spark: SparkSession, value: dict, path: str) -> None:
    spark.createDataFrame([(json.dumps(value),)], "value string").coalesce(1).write.mode("overwrite").text(path)


def read_json(spark: SparkSession, path: str) -> dict:
    return json.loads(spark.read.text(path).first()[0])

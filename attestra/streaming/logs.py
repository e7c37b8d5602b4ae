"""Append-only logs as streams: each micro-batch is folded into a table of the latest state.

State is cut into buckets by key. A batch reads and writes only the buckets that its keys are in; a manifest says
which folder holds each bucket, and is what makes a version: until it is there, nothing has changed. A
stream's own batches are numbered in it, so a batch that runs again is left out, and a stream with a new
checkpoint, whose numbers begin again, goes on from the state that is there.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from attestra.operators.history import latest

DECISION = "recorded_at string, use_case string, step string, decision string, reviewer string, reason string"
BUCKETS = 64


def read_log(spark: SparkSession, folder: str, schema: str = DECISION) -> DataFrame:
    return spark.readStream.schema(schema).json(folder)


class KeyedState:
    """The newest row of each key under a folder: data/<write>/bucket=<n>/, and manifests/<version>.json."""

    def __init__(self, spark: SparkSession, path: str, keys: list[str], order: str, buckets: int = BUCKETS) -> None:
        self.spark, self.path, self.keys, self.order, self.buckets = spark, path.rstrip("/"), keys, order, buckets

    def _bucket(self) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(self.buckets)).cast("int")

    def _files(self):
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests")
        return at, at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())

    def version(self) -> int:
        """The newest version; -1 if there is none."""
        at, system = self._files()
        if not system.exists(at):
            return -1
        return max((int(f.getPath().getName().removesuffix(".json")) for f in system.listStatus(at) if f.getPath().getName().endswith(".json")), default=-1)

    def manifest(self, version: int | None = None) -> dict:
        version = self.version() if version is None else version
        if version < 0:
            return {"version": -1, "buckets": {}, "streams": {}, "schema": None, "count": self.buckets}
        found = json.loads(self.spark.read.text(f"{self.path}/manifests/{version}.json", wholetext=True).first().value)
        if found["count"] != self.buckets:
            raise ValueError(f"the state in {self.path} has {found['count']} buckets, not {self.buckets}")
        return found

    def _commit(self, made: dict) -> None:
        """Put a manifest in place; of two writers of one version, the second fails and its state isn't seen."""
        at, system = self._files()
        path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/{made['version']}.json")
        draft = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        system.mkdirs(at)
        out = system.create(draft, False)
        out.write(bytearray(json.dumps(made, sort_keys=True).encode()))
        out.close()
        if system.exists(path) or not system.rename(draft, path):
            system.delete(draft, False)
            raise RuntimeError(f"version {made['version']} of {self.path} is there already")

    def read(self, version: int | None = None) -> DataFrame | None:
        """All rows of a version, the newest by default; None if there is no state yet."""
        found = self.manifest(version)
        return self._of(found, list(found["buckets"])) if found["schema"] else None

    def _of(self, found: dict, buckets: list[str]) -> DataFrame:
        paths = [f"{self.path}/data/{found['buckets'][b]}/bucket={b}" for b in buckets if b in found["buckets"]]
        if not paths:
            return self.spark.createDataFrame([], StructType.fromJson(found["schema"]))
        return self.spark.read.schema(StructType.fromJson(found["schema"])).parquet(*paths)

    def fold(self, batch: DataFrame, stream: str = "", number: int | None = None) -> bool:
        """Put a batch's rows into the state; whether it was new. Rows of equal keys and order: one of them stays."""
        found = self.manifest()
        if number is not None and found["streams"].get(stream, -1) >= number:
            return False
        rows = batch.withColumn("bucket", self._bucket()).persist()
        try:
            touched = [str(r.bucket) for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
            schema = found["schema"] or batch.schema.jsonValue()
            if touched:
                write = uuid.uuid4().hex
                both = rows
                if found["schema"]:
                    both = self._of(found, touched).select(*batch.columns).withColumn("bucket", self._bucket()).unionByName(rows)
                newest = latest(both, ["bucket", *self.keys], [self.order]).select(*batch.columns, "bucket")
                newest.repartition("bucket").write.partitionBy("bucket").parquet(f"{self.path}/data/{write}")
                found["buckets"] |= {b: write for b in touched}
        finally:
            rows.unpersist()
        if number is not None:
            found["streams"][stream] = number
        self._commit(found | {"version": found["version"] + 1, "schema": schema})
        return True


def keep_latest(log: DataFrame, keys: list[str], order: str, state: str, checkpoint: str, buckets: int = BUCKETS) -> StreamingQuery:
    """Start a query that keeps the newest row of each key in the KeyedState under `state`."""

    def fold(batch: DataFrame, number: int) -> None:
        KeyedState(batch.sparkSession, state, keys, order, buckets).fold(batch, checkpoint, number)

    return log.writeStream.foreachBatch(fold).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_rates(events: DataFrame, time: str, kind: str, late: str = "10 minutes", width: str = "1 hour") -> DataFrame:
    """Counts and mean of value by kind in windows, with a watermark for late rows."""
    return events.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), kind).agg(F.count("*").alias("n"), F.avg("value").alias("mean_value")).select(F.col("w.start").alias("start"), kind, "n", "mean_value")

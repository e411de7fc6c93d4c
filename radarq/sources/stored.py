"""A table kept by key on any store: deliveries replace rows, as `REPLACE INTO` does, in one atomic step each.

Rows lie in buckets by a hash of their key. A delivery rewrites the buckets that it touches beside the old ones
and is there when its manifest is: `manifests/<version>`, which names each bucket's folder and, for each
stream, the last batch taken. A manifest is written once, so of two deliveries that start from one version
the second begins anew. A batch that comes again is passed over.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .hadoop import Store

TRIES = 20


class StoredTable:
    """schema: of the rows; key: columns that name a row, which may be null; buckets: fixed when the table is made.

    bucket: an expression over the key that gives a row's bucket; a hash of the key if none is given.
    """

    def __init__(self, spark: SparkSession, folder: str, schema: T.StructType, key: tuple[str, ...], buckets: int = 64, bucket: Column | None = None):
        self.spark, self.schema, self.key = spark, schema, key
        self.store = Store(spark, folder)
        self.store.write_once("manifests/00000000", json.dumps({"buckets": buckets, "key": list(key), "paths": {}, "batches": {}}))
        first = json.loads(self.store.read("manifests/00000000"))
        if first["key"] != list(key):
            raise ValueError(f"the table in {folder} has the key {first['key']}")
        self.buckets = first["buckets"]
        self.bucket = (F.pmod(F.xxhash64(*key), F.lit(self.buckets)) if bucket is None else bucket).cast("int")

    def version(self) -> int:
        return max(int(n) for n in self.store.names("manifests") if n.isdigit())

    def manifest(self, version: int | None = None) -> dict:
        return json.loads(self.store.read(f"manifests/{self.version() if version is None else version:08d}"))

    def read(self, version: int | None = None) -> DataFrame:
        """The table's rows, now or as of a version that vacuum() has left."""
        return self._rows(list(self.manifest(version)["paths"].values()))

    def _rows(self, paths: list[str]) -> DataFrame:
        if not paths:
            return self.spark.createDataFrame([], self.schema)
        return self.spark.read.schema(self.schema).parquet(*(f"{self.store.folder}/{p}" for p in paths))

    def taken(self, batch: int, stream: str = "") -> bool:
        """Whether a stream's batch has been taken."""
        return batch <= self.manifest()["batches"].get(stream, -1)

    def upsert(self, rows: DataFrame, order: tuple[str, ...], batch: int, stream: str = "") -> bool:
        """Put rows in place of those with their keys; of equal keys, the last by order. False if the stream's batch has been taken before.

        Columns of order need not be the table's. Batches of a stream count up.
        """
        last = rows.select(*self.key, F.struct(*self.schema.fieldNames()).alias("_row"), F.struct(*order).alias("_order"))
        last = last.groupBy(*self.key).agg(F.max_by("_row", "_order").alias("_row")).select("_row.*")

        def replaced(old: DataFrame, new: DataFrame) -> DataFrame:
            same = None
            for k in self.key:
                same = old[k].eqNullSafe(new[k]) if same is None else same & old[k].eqNullSafe(new[k])
            return old.join(new.select(*self.key), same, "left_anti").unionByName(new)

        return self.deliver(last, replaced, batch, stream)

    def deliver(self, rows: DataFrame, together: Callable[[DataFrame, DataFrame], DataFrame], batch: int, stream: str = "") -> bool:
        """Put what `together` makes of old and new rows in place of the buckets that the new ones touch; old ones elsewhere are not read."""
        rows = rows.select(*self.schema.fieldNames())
        for _ in range(TRIES):
            version = self.version()
            now = self.manifest(version)
            if batch <= now["batches"].get(stream, -1):
                return False
            folder = f"data/{version + 1:08d}-{uuid.uuid4().hex}"
            touched = {r[0] for r in rows.select(self.bucket.alias("_bucket")).distinct().collect()}  # as many as there are buckets, at most
            old = self._rows([p for b, p in now["paths"].items() if int(b) in touched])
            made = together(old, rows).select(*self.schema.fieldNames()).withColumn("_bucket", self.bucket)
            made.repartition(len(touched) or 1, "_bucket").write.partitionBy("_bucket").parquet(f"{self.store.folder}/{folder}")
            there = {int(n.removeprefix("_bucket=")) for n in self.store.names(folder) if n.startswith("_bucket=")}
            paths = {b: p for b, p in now["paths"].items() if int(b) not in touched} | {str(b): f"{folder}/_bucket={b}" for b in sorted(there)}
            if self.store.write_once(f"manifests/{version + 1:08d}", json.dumps(now | {"paths": paths, "batches": now["batches"] | {stream: batch}})):
                return True
            self.store.delete(folder)  # another delivery came first
        raise RuntimeError(f"{TRIES} other deliveries came first")

    def vacuum(self, versions: int = 1) -> None:
        """Drop what only versions before the last few name, and what lost drivers left. No delivery may run meanwhile."""
        last = self.version()
        keep = {p.split("/")[1] for v in range(max(0, last - versions + 1), last + 1) for p in self.manifest(v)["paths"].values()}
        for name in self.store.names("data"):
            if name not in keep:
                self.store.delete(f"data/{name}")
        for name in self.store.names("manifests"):
            if not name.isdigit() or 0 < int(name) <= last - versions:
                self.store.delete(f"manifests/{name}")

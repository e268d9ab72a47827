"""A keyed table in versions: merges rewrite only the buckets they touch and become visible all at once.

Rows are dealt to a fixed number of buckets by a hash of their key.  A version is a manifest that names, for every bucket,
the folder with its rows; a merge writes the touched buckets anew and then creates the next manifest.  Until
that file exists readers see the version before, so a write that fails or is lost halfway changes nothing, and of two writers
that start from one version only the first can create the next.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from priorline.skew import attach, best_rows, same_keys

BUCKETS = 64  # of a new table; its own number is kept in the manifest


class ConcurrentWrite(RuntimeError):
    """Another writer made the version this one was about to make."""


class VersionedTable:
    def __init__(self, spark: SparkSession, path: str, keys: Sequence[str], buckets: int = BUCKETS):
        self.spark, self.path, self.keys, self.buckets = spark, path.rstrip("/"), list(keys), buckets

    def _files(self):
        jvm = self.spark._jvm
        folder = jvm.org.apache.hadoop.fs.Path(f"{self.path}/versions")
        return jvm, folder, folder.getFileSystem(self.spark._jsc.hadoopConfiguration())

    def manifest(self) -> dict:
        """The newest version: number, batches applied, schema and the folder of each bucket that has rows (as many entries as buckets)."""
        _, folder, fs = self._files()
        names = [s.getPath().getName() for s in fs.listStatus(folder)] if fs.exists(folder) else []
        numbers = [int(n.removesuffix(".json")) for n in names if n.endswith(".json") and n[0].isdigit()]
        if not numbers:
            return {"version": 0, "batches": [], "schema": None, "buckets": self.buckets, "folders": {}}
        text = self.spark.read.text(f"{self.path}/versions/{max(numbers):010d}.json", wholetext=True).first()[0]
        return json.loads(text)

    def _commit(self, manifest: dict) -> None:
        """Write under a name of its own, then rename it to the version's name, which fails if that is taken."""
        jvm, folder, fs = self._files()
        path = jvm.org.apache.hadoop.fs.Path
        own, target = path(folder, f".{uuid.uuid4().hex}"), path(folder, f"{manifest['version']:010d}.json")
        out = fs.create(own, False)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(folder.toUri(), self.spark._jsc.hadoopConfiguration())
        plain = self.spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
        try:
            context.rename(fs.makeQualified(own), fs.makeQualified(target), plain)
        except Exception as e:
            if fs.exists(target):
                raise ConcurrentWrite(f"version {manifest['version']} of {self.path} exists") from e
            raise

    def _bucket(self, buckets: int) -> Column:
        return F.pmod(F.xxhash64(*self.keys), F.lit(buckets)).cast("int")

    def _read(self, manifest: dict, only: set[int] | None = None) -> DataFrame | None:
        if manifest["schema"] is None:
            return None
        from pyspark.sql.types import StructType

        schema = StructType.fromJson(json.loads(manifest["schema"]))
        folders = [f"{self.path}/{f}" for b, f in manifest["folders"].items() if only is None or int(b) in only]
        return self.spark.read.schema(schema).parquet(*folders) if folders else self.spark.createDataFrame([], schema)

    def read(self) -> DataFrame:
        """The newest version; a table that was never written raises."""
        rows = self._read(self.manifest())
        if rows is None:
            raise FileNotFoundError(f"no version of {self.path}")
        return rows

    def _write(self, rows: DataFrame, before: dict, touched: set[int], batch: str | None) -> int:
        version, buckets = before["version"] + 1, before["buckets"]
        folder = f"data/{version:010d}-{uuid.uuid4().hex}"
        rows.withColumn("__bucket", self._bucket(buckets)).repartition("__bucket").write.partitionBy("__bucket").parquet(f"{self.path}/{folder}")
        # With the schema given, no row at all (and so no file) is as good as any; the rows are worked out by the write alone.
        found = self.spark.read.schema("__bucket int").parquet(f"{self.path}/{folder}")
        written = {r[0] for r in found.select("__bucket").distinct().collect()}
        folders = {b: f for b, f in before["folders"].items() if int(b) not in touched}
        folders |= {str(b): f"{folder}/__bucket={b}" for b in written}
        batches = [*before["batches"], *([batch] if batch else [])]
        schema = before["schema"] or rows.schema.json()
        self._commit({"version": version, "batches": batches, "schema": schema, "buckets": buckets, "folders": folders})
        return version

    def _merge(self, changes: DataFrame, batch: str | None, apply) -> int:
        before = self.manifest()
        if batch is not None and batch in before["batches"]:
            return before["version"]  # a replay
        touched = self._touched(changes, before)
        stored = self._read(before, touched)
        return self._write(apply(stored), before, touched, batch)

    def _touched(self, changes: DataFrame, manifest: dict) -> set[int]:
        """Buckets with stored rows that the changes may meet; of a table without rows there is none to look for."""
        if not manifest["folders"]:
            return set()
        return {r[0] for r in changes.select(self._bucket(manifest["buckets"]).alias("b")).distinct().collect()}

    def upsert(self, rows: DataFrame, ordering: Sequence[Column], batch: str | None = None) -> int:
        """Replace the rows of the keys that come, add the new ones; of rows that share a key the first by ``ordering`` counts."""
        new = best_rows(rows, self.keys, ordering)
        wanted = rows.select(*self.keys)

        def apply(stored: DataFrame | None) -> DataFrame:
            if stored is None:
                return new
            marked = new.select(*self.keys)
            return stored.join(marked, same_keys(stored, marked, self.keys), "left_anti").unionByName(new.select(*stored.columns))

        return self._merge(wanted, batch, apply)

    def update(self, rows: DataFrame, columns: Sequence[str], ordering: Sequence[Column], batch: str | None = None) -> int:
        """Give stored rows the non-null values of ``columns``; keys that are not stored are left out."""
        new = best_rows(rows, self.keys, ordering).select(*self.keys, *[F.col(c).alias(f"__new_{c}") for c in columns])
        wanted = rows.select(*self.keys)

        def apply(stored: DataFrame | None) -> DataFrame:
            if stored is None:
                raise FileNotFoundError(f"no version of {self.path}")
            joined = attach(stored, new, self.keys)
            return joined.select(*[F.coalesce(f"__new_{c}", c).alias(c) if c in columns else F.col(c) for c in stored.columns])

        return self._merge(wanted, batch, apply)

    def delete(self, doomed: DataFrame, batch: str | None = None) -> int:
        """Remove the rows of the given keys."""
        marked = doomed.select(*self.keys)  # repeats change nothing in an anti join

        def apply(stored: DataFrame | None) -> DataFrame:
            if stored is None:
                raise FileNotFoundError(f"no version of {self.path}")
            return stored.join(marked, same_keys(stored, marked, self.keys), "left_anti")

        return self._merge(marked, batch, apply)

    def delete_preview(self, doomed: DataFrame) -> int:
        """How many rows a delete would remove; only the buckets it would touch are read."""
        before = self.manifest()
        marked = doomed.select(*self.keys)  # nor in a semi join
        stored = self._read(before, self._touched(marked, before))
        return 0 if stored is None else stored.join(marked, same_keys(stored, marked, self.keys), "left_semi").count()

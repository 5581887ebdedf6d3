"""A table that is merged into: rows in hash buckets of their keys, and a manifest that says which files are the table.

A merge reads and writes only the buckets of the keys it changes, beside the old ones; then one small manifest is put in
place by a rename, under the next number. A reader takes the highest: it sees the table before a merge or after it, never
between, and what a merge that died has written is in no manifest. Of two merges at once one finds its number taken and
raises; it may be tried again. ``vacuum`` deletes what no kept manifest names.
"""

from __future__ import annotations

import json
import uuid
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

BUCKET = "_bucket"


class KeyedTable:
    """Rows with one row a key at ``path``. Keys must not be null. The number of buckets is set when the table is made."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")
        self._jvm: Any = spark._jvm
        self.files = self._at(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    def _at(self, path: str) -> Any:
        return self._jvm.org.apache.hadoop.fs.Path(path)

    def _versions(self) -> list[int]:
        found = self.files.globStatus(self._at(f"{self.path}/manifest-*.json")) or []
        return sorted(int(f.getPath().getName()[9:-5]) for f in found)

    def _manifest(self, version: int | None = None) -> dict[str, Any]:
        versions = self._versions()
        if not versions:
            raise FileNotFoundError(f"no table at {self.path}")
        text = self.spark.read.text(f"{self.path}/manifest-{versions[-1] if version is None else version:012d}.json", wholetext=True).first()[0]
        return json.loads(text) | {"version": versions[-1] if version is None else version}

    def _publish(self, manifest: dict[str, Any], version: int) -> None:
        target, draft = self._at(f"{self.path}/manifest-{version:012d}.json"), self._at(f"{self.path}/_draft-{uuid.uuid4().hex}")
        out = self.files.create(draft)
        out.write(bytearray(json.dumps(manifest).encode()))
        out.close()
        if self.files.exists(target) or not self.files.rename(draft, target):
            self.files.delete(draft, False)
            raise RuntimeError(f"another merge has made version {version}")

    @staticmethod
    def create(rows: DataFrame, path: str, keys: list[str], buckets: int = 64) -> KeyedTable:
        """A new table of rows with distinct keys."""
        table = KeyedTable(rows.sparkSession, path)
        if table._versions():
            raise FileExistsError(f"there is a table at {path}")
        manifest = {"keys": keys, "buckets": buckets, "schema": rows.schema.json()}
        table._publish(manifest | {"files": table._written(rows, manifest)}, 1)
        return table

    def _bucket(self, manifest: dict[str, Any]) -> Column:
        return F.pmod(F.xxhash64(*manifest["keys"]), F.lit(manifest["buckets"])).cast("int")

    def _written(self, rows: DataFrame, manifest: dict[str, Any]) -> dict[str, str]:
        """Writes rows by bucket; the folder of each bucket that has any."""
        name = f"data-{uuid.uuid4().hex}"
        rows.withColumn(BUCKET, self._bucket(manifest)).repartition(manifest["buckets"], BUCKET).write.partitionBy(BUCKET).parquet(f"{self.path}/{name}")
        found = self.files.globStatus(self._at(f"{self.path}/{name}/{BUCKET}=*")) or []
        return {f.getPath().getName().partition("=")[2]: f"{name}/{f.getPath().getName()}" for f in found}

    def _rows(self, manifest: dict[str, Any], buckets: list[str] | None = None) -> DataFrame:
        schema = StructType.fromJson(json.loads(manifest["schema"]))
        paths = [f"{self.path}/{folder}" for b, folder in manifest["files"].items() if buckets is None or b in buckets]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def read(self, version: int | None = None) -> DataFrame:
        """The table as it is now, or as it was at a version."""
        return self._rows(self._manifest(version))

    def merge(self, changes: DataFrame, action: str = "action") -> int:
        """Puts changes in: rows of the table's columns, one a key, with ``put`` or ``delete`` as ``action``; the new version.

        put replaces the row of its key or adds one; delete takes it away if it is there; other actions change nothing.
        """
        manifest = self._manifest()
        keys, columns = manifest["keys"], [f["name"] for f in json.loads(manifest["schema"])["fields"]]
        wanted = changes.filter(F.col(action).isin("put", "delete"))
        touched = [str(r[0]) for r in wanted.select(self._bucket(manifest)).distinct().collect()]  # as many as buckets at most
        if not touched:
            return manifest["version"]
        stay = self._rows(manifest, touched).join(wanted.select(*keys), keys, "left_anti").select(*columns)
        written = self._written(stay.unionByName(wanted.filter(F.col(action) == "put").select(*columns)), manifest)
        files = {b: folder for b, folder in manifest["files"].items() if b not in touched} | written
        version = manifest["version"] + 1
        self._publish({k: manifest[k] for k in ("keys", "buckets", "schema")} | {"files": files}, version)
        return version

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the last ``keep`` manifests and the data that none of those names; how many folders went.

        Not to be run beside a merge: what that has written is in no manifest yet.
        """
        versions = self._versions()
        kept = {folder.partition("/")[0] for v in versions[-keep:] for folder in self._manifest(v)["files"].values()}
        for v in versions[:-keep]:
            self.files.delete(self._at(f"{self.path}/manifest-{v:012d}.json"), False)
        old = [f.getPath() for f in self.files.globStatus(self._at(f"{self.path}/data-*")) or [] if f.getPath().getName() not in kept]
        return sum(bool(self.files.delete(p, True)) for p in old)

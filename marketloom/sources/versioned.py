"""Tables whose versions are manifests: a reader sees one version or the next, never a part of one.

A version is a small file that names, for each partition, the folder with its
files. A commit writes only the partitions that it touches, to a folder of its
own, and then gives the next manifest its final name by one rename that fails
if the name is taken; two writers that began from the same version can't both
win. Readers take the highest version. The present and the last version are
kept, older folders are deleted.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from marketloom.operators.lifecycle import GuardError

KEPT = 2
#: A partition is written by so many tasks at most, so that a large one is no single task's work.
SPREAD = 8
#: Column with the partition's name; rows that come with it have been dealt by it already.
PART = "_partition"


class ConflictError(RuntimeError):
    """Another commit made the version that this one was about to make."""


class VersionedTable:
    """A table below ``root``, divided by the values of the column ``partition``, or with ``buckets`` by their hash into so many."""

    def __init__(self, spark: SparkSession, root: str, partition: str, buckets: int | None = None) -> None:
        self.spark, self.root, self.partition, self.buckets = spark, root.rstrip("/"), partition, buckets
        self._path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.root).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def value(self) -> Column:
        """What a row's partition is called, as text; files and manifests grow with the number of these."""
        name = F.col(self.partition)
        return F.coalesce((F.pmod(F.xxhash64(name.cast("string")), F.lit(self.buckets)) if self.buckets else name).cast("string"), F.lit("-"))

    def versions(self) -> list[int]:
        at = self._path(f"{self.root}/versions")
        if not self._fs.exists(at):
            return []
        names = (f.getPath().getName() for f in self._fs.listStatus(at))
        return sorted(int(n.removesuffix(".json")) for n in names if n.endswith(".json"))

    def manifest(self, version: int | None = None) -> dict:
        """``schema``, and ``parts``: folder by partition value; of the latest version unless one is named."""
        found = self.versions()
        if not found:
            return {"version": 0, "schema": None, "parts": {}}
        version = found[-1] if version is None else version
        text = self.spark.read.text(f"{self.root}/versions/{version:020d}.json", wholetext=True).first()[0]
        return json.loads(text) | {"version": version}

    def read(self, version: int | None = None, only: Callable[[str], bool] | None = None) -> DataFrame:
        """A version; ``only`` chooses partitions by their value as text, so that no others are even listed."""
        now = self.manifest(version)
        if now["schema"] is None:
            raise LookupError(f"{self.root} has no version yet")
        places = [at for value, at in sorted(now["parts"].items()) if only is None or only(value)]
        schema = StructType.fromJson(now["schema"])
        if not places:
            return self.spark.createDataFrame([], schema)
        # Partitions lie below different commits, and their value stands in the files too.
        return self.spark.read.schema(schema).option("recursiveFileLookup", "true").parquet(*(f"{self.root}/{p}" for p in places))

    def commit(self, rows: DataFrame, whole: bool = False, least: int = 0, key: str | None = None, since: int | None = None, beside: Callable[[DataFrame, str], None] | None = None) -> int:
        """Replace the partitions that ``rows`` touch (all with ``whole``); the new version's number. Rows with a column ``PART`` are written as they lie.

        The staged files are checked before they count: at least ``least`` rows,
        and with ``key`` each of its values once. ``since`` is the version that
        ``rows`` were made from, if it is not the present one. ``beside`` gets the
        staged rows and a folder for what is derived from them; the version names
        that folder too, so that both change at once.
        """
        before = self.manifest(since)
        folder = f"data/{uuid.uuid4().hex}"
        staged = rows
        if PART in rows.columns:
            rows = rows.drop(PART)
        else:
            staged = rows.withColumn(PART, self.value()).repartition(PART, F.pmod(F.xxhash64(*rows.columns), F.lit(SPREAD)))
        staged.write.option("compression", "zstd").partitionBy(PART).parquet(f"{self.root}/{folder}")
        files = self.spark.read.schema(rows.schema).option("recursiveFileLookup", "true").parquet(f"{self.root}/{folder}")
        checks = [F.count("*").alias("n")] + ([F.count_distinct(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("nulls")] if key else [])
        found = files.agg(*checks).first()
        if found["n"] < least or (key and (found["keys"] != found["n"] or found["nulls"])):
            self._fs.delete(self._path(f"{self.root}/{folder}"), True)
            raise GuardError(f"{found.asDict()}, {least} rows wanted: the present version stays")
        touched = {}
        for f in self._fs.listStatus(self._path(f"{self.root}/{folder}")):
            if f.isDirectory():
                at = f.getPath().getName()
                touched[_unescaped(at.removeprefix(f"{PART}="))] = f"{folder}/{at}"
        parts = touched if whole else before["parts"] | touched
        body = {"schema": json.loads(rows.schema.json()), "parts": parts}
        if beside:
            body["beside"] = f"{folder}-beside"
            beside(files, f"{self.root}/{body['beside']}")
        self._name(before["version"] + 1, body)
        self._forget()
        return before["version"] + 1

    def _name(self, version: int, body: dict) -> None:
        """Write the manifest beside the others, then rename it: the one step that readers see."""
        draft = self._path(f"{self.root}/drafts/{uuid.uuid4().hex}.json")
        out = self._fs.create(draft)
        out.write(bytearray(json.dumps(body).encode()))
        out.close()
        final = self._path(f"{self.root}/versions/{version:020d}.json")
        self._fs.mkdirs(final.getParent())
        if self._fs.exists(final) or not self._fs.rename(draft, final):
            self._fs.delete(draft, False)
            raise ConflictError(f"version {version} of {self.root} is taken")

    def _forget(self) -> None:
        """Delete what only versions before the last ``KEPT`` read."""
        found = self.versions()
        old, kept = found[:-KEPT], found[-KEPT:]
        places = {v: {*(m := self.manifest(v))["parts"].values(), *([m["beside"]] if "beside" in m else [])} for v in found}
        needed = {place for v in kept for place in places[v]}
        for v in old:
            for place in places[v] - needed:
                self._fs.delete(self._path(f"{self.root}/{place}"), True)
            self._fs.delete(self._path(f"{self.root}/versions/{v:020d}.json"), False)


def _unescaped(name: str) -> str:
    from urllib.parse import unquote

    return unquote(name)

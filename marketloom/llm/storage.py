"""Where intermediate tables live, and small helpers that every operator shares."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

#: Tables of at most so many bytes are sent to every task.
BROADCAST_BYTES = 64 << 20
_OWN: dict[str, str] = {}
#: Tables written and not yet released; entries live as long as someone may release them.
_PATHS: dict[int, tuple[DataFrame, str]] = {}


def shared_dir(spark: SparkSession) -> str:
    """Folder that the driver and every executor see.

    It is ``spark.checkpoint.dir`` (or the directory already set on the
    context). Only where neither is set does a local session get a temporary
    folder; any other session then uses its warehouse.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        return spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="marketloom-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def shared_path(spark: SparkSession, kind: str) -> str:
    """A new path below :func:`shared_dir`."""
    return f"{shared_dir(spark)}/{kind}/{uuid.uuid4().hex}"


def materialise(df: DataFrame) -> DataFrame:
    """Write ``df`` as Parquet in the shared folder and read it back.

    This cuts the lineage (a lost executor costs no recomputation), runs an
    expensive plan once although several consumers follow, and gives the
    planner exact sizes, so that it broadcasts what is small and nothing else.
    """
    spark = df.sparkSession
    path = shared_path(spark, "tables")
    df.write.option("compression", "zstd").parquet(path)
    stored = spark.read.schema(df.schema).parquet(path)
    _PATHS[id(stored)] = (stored, path)
    return stored


def release(*tables: DataFrame) -> None:
    """Delete tables that :func:`materialise` wrote and nothing reads any more."""
    for df in tables:
        _, path = _PATHS.pop(id(df), (None, None))
        if path:
            spark = df.sparkSession
            place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(place, True)


def sent(df: DataFrame, n_bytes: int | None) -> DataFrame:
    """``df`` for a join: broadcast if its size, as counted, is at most BROADCAST_BYTES; else the join shuffles."""
    return F.broadcast(df) if (n_bytes or 0) <= BROADCAST_BYTES else df


def fresh(df: DataFrame, *names: str) -> list[str]:
    """Column names like ``names`` that ``df`` does not have yet."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        taken.add(name.lower())
        out.append(name)
    return out


def extended(schema: StructType, ddl: str) -> StructType:
    """``schema`` followed by the fields of ``ddl``."""
    return StructType(schema.fields + StructType.fromDDL(ddl).fields)


def beside(docs: DataFrame, keep: list[str], values: Column, ddl: str, run: Callable[[list], list[pa.Array]]) -> DataFrame:
    """``keep`` of ``docs``, and beside them what ``run`` makes of the ``values`` of a batch: one array for each field of ``ddl``.

    Kept columns may have any name; a new field whose name they have gets
    another one, as :func:`fresh` gives it.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    new = StructType.fromDDL(ddl)
    schema = StructType(kept.schema.fields + [StructField(n, f.dataType) for n, f in zip(fresh(kept, *new.names), new.fields, strict=True)])
    names = schema.names

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], *run(b.column(b.num_columns - 1).to_pylist())], names)

    # Plain names inside: a dot in a name has a meaning there.
    return docs.select(*(F.col(f"`{c}`").alias(f"kept{k}") for k, c in enumerate(keep)), values.alias("value")).mapInArrow(each, schema)

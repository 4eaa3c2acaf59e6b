"""Shared tables, shipped code and guarded broadcasts."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows that may be broadcast, and what they may take in memory; beyond either the join shuffles.
BROADCAST_ROWS, BROADCAST_BYTES = 500_000, 64 << 20
_folders: dict[str, str] = {}
_shipped: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Sends this package to the Python workers, which may not have it on their path."""
    sc = spark.sparkContext
    if sc.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    target = Path(tempfile.mkdtemp(prefix="plumbline-code-")) / f"{root.name}.zip"
    with zipfile.ZipFile(target, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(target))
    _shipped.add(sc.applicationId)


def scratch(spark: SparkSession) -> str:
    """The shared folder for intermediate tables: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a temporary folder; a cluster session is refused,
    as its executors would not see such a folder.
    """
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or _folders.get(sc.applicationId)
    if not folder:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = _folders[sc.applicationId] = "file://" + tempfile.mkdtemp(prefix="plumbline-")
    return folder.rstrip("/")


def _own_folder(spark: SparkSession) -> str:
    return f"{scratch(spark)}/plumbline/{spark.sparkContext.applicationId}"


def table(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and reads it back: a cut of lineage that outlives executors.

    All tables of an application lie in one folder, which ``clear`` removes.
    """
    path = f"{_own_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def clear(spark: SparkSession) -> None:
    """Removes the intermediate tables of this application; results that are not yet written need them."""
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_own_folder(spark))
    path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def _row_bytes(kind: T.DataType) -> int:
    """Bytes of a value in a hashed relation; of strings, binaries and collections a generous guess."""
    if isinstance(kind, T.StructType):
        return 8 + sum(8 + _row_bytes(f.dataType) for f in kind)
    return 8 if isinstance(kind, T.NumericType) else 128 if isinstance(kind, (T.ArrayType, T.MapType)) else 40


def guarded(small: DataFrame, rows: int | None = None, limit: int = BROADCAST_ROWS, size: int = BROADCAST_BYTES) -> DataFrame:
    """Marks ``small`` for broadcasting if its rows are at most ``limit`` and about ``size`` bytes; beyond, it stays as it is."""
    most = min(limit, size // _row_bytes(small.schema))
    return F.broadcast(small) if (small.count() if rows is None else rows) <= most else small

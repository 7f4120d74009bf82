"""Tables in the folder that driver and executors share."""

from __future__ import annotations

import contextlib
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Rows of a few narrow columns at most that a broadcast join may send; more are joined by a shuffle.
BROADCAST_ROWS = 500_000
#: Bytes at most of a table that a broadcast join may send.
BROADCAST_BYTES = 64 << 20


def shared_dir(spark: SparkSession, name: str) -> str:
    """A new folder path that the driver and all executors see.

    The parent is ``spark.checkpoint.dir`` of the session; where that is unset
    (tests on one machine) it is set to a folder of this process.
    """
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not root:
        import tempfile

        root = tempfile.mkdtemp(prefix="tracewise-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` to the shared folder and returns a reader of what was written.

    This cuts the lineage: a lost executor costs a reread, not a recomputation.
    """
    path = shared_dir(df.sparkSession, name)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    if _WRITTEN:
        _WRITTEN[-1][path] = out
    return out


#: Tables written within each open :func:`scratch`, by path.
_WRITTEN: list[dict[str, DataFrame]] = []


@contextlib.contextmanager
def scratch(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Deletes at its end the tables that :func:`materialize` wrote within, but for those given to its function.

    What leaves the block must be made of kept tables only.
    """
    _WRITTEN.append({})
    kept: set[int] = set()

    def keep(df: DataFrame) -> DataFrame:
        kept.add(id(df))
        return df

    try:
        yield keep
    finally:
        done = _WRITTEN.pop()
        for path, df in done.items():
            if id(df) in kept:
                if _WRITTEN:
                    _WRITTEN[-1][path] = df
            else:
                where = spark._jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def _bytes(field) -> "F.Column":
    """About how many bytes a column of a row takes."""
    kind, col = field.dataType, F.col(f"`{field.name}`")
    if isinstance(kind, (T.StringType, T.BinaryType)):
        return F.coalesce(F.octet_length(col), F.lit(0)) + 16
    if isinstance(kind, T.ArrayType):
        inner = kind.elementType
        width = 8 * len(inner.fields) if isinstance(inner, T.StructType) else 8
        return F.greatest(F.size(col), F.lit(0)) * width + 16
    return F.lit(8 * len(kind.fields) if isinstance(kind, T.StructType) else 8)


def hinted(df: DataFrame) -> DataFrame:
    """``df``, to be broadcast if it is small enough in rows and bytes.

    It is run once to be measured, so it should be a stored or stated table.
    """
    some = df.limit(BROADCAST_ROWS + 1)
    size = sum((_bytes(f) for f in df.schema.fields), F.lit(0)).cast("long")
    n, total = some.agg(F.count("*"), F.coalesce(F.sum(size), F.lit(0))).first()
    return F.broadcast(df) if n <= BROADCAST_ROWS and total <= BROADCAST_BYTES else df


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")

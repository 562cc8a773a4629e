"""Intermediate tables in the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

#: Rows of a short list (8 to 24 bytes each) that may be broadcast; longer lists are shuffled.
BROADCAST_ROWS = 1_000_000


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under the session's shared checkpoint folder. Where none is set, one of this machine for a
    local session; an error on a cluster, whose executors couldn't read it."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="spark-shared-")
        spark.sparkContext.setCheckpointDir(base)
    return f"{base.rstrip('/')}/vista-{uuid.uuid4().hex}"


def written(df: DataFrame) -> DataFrame:
    """The rows, written to the shared folder and reread: lost executors cost no recomputation."""
    path = shared_dir(df.sparkSession)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(ids: DataFrame) -> DataFrame:
    """The written list `ids`, marked for broadcast only if its row count is within BROADCAST_ROWS."""
    return F.broadcast(ids) if ids.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else ids


def dealt(rows: DataFrame, *keys: str) -> DataFrame:
    """Few rows that each become many, over all cores: else the cores of their few input files would do all the
    work. The rows themselves are small. With keys, what becomes of the rows of one key stays together, so that it can
    be gathered or joined by the keys without another shuffle."""
    spark = rows.sparkSession
    return rows.repartition(max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))), *keys)


def by_row(df: DataFrame, takes: list[str], gives: str, f: Callable[[dict], dict]) -> DataFrame:
    """df with the columns `takes` replaced by `gives` (DDL), which f makes of each row's values.

    The other columns pass through as Arrow data, so that ids stay exact beside nulls."""
    kept = [x for x in df.schema.fields if x.name not in takes]
    new = StructType.fromDDL(gives).fields

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_type

        for b in batches:
            given = [f({t: _plain(b.column(t)[i]) for t in takes}) for i in range(b.num_rows)]
            cols = [b.column(x.name) for x in kept] + [pa.array([g[x.name] for g in given], to_arrow_type(x.dataType)) for x in new]
            yield pa.RecordBatch.from_arrays(cols, names=[x.name for x in [*kept, *new]])

    return df.mapInArrow(run, StructType([*kept, *new]))


def _plain(value: pa.Scalar):
    if isinstance(value, (pa.ListScalar, pa.LargeListScalar)) and value.is_valid and not pa.types.is_nested(value.type.value_type):
        return value.values.to_numpy(zero_copy_only=False)
    return value.as_py()

"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


#: Bytes of a table that may be sent to all; beyond, both sides of a join are exchanged.
BROADCAST_LIMIT = 32 << 20
#: Whether the shuffle files of a query go at its end; a table written has no further use for them.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir, or in local mode (tests) a folder of our own where it is unset."""
    jsc = spark.sparkContext._jsc.sc()
    if jsc.getCheckpointDir().isDefined():
        return jsc.getCheckpointDir().get()
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder and spark.sparkContext.master.split("[")[0] != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    spark.sparkContext.setCheckpointDir(folder or tempfile.mkdtemp(prefix="telar-"))
    return jsc.getCheckpointDir().get()


def materialize(df: DataFrame) -> DataFrame:
    """Cut the lineage: write df as Parquet to the shared folder and read it back; its shuffle files go at once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/telar-{uuid.uuid4().hex}"
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        if before is None:
            spark.conf.unset(CLEANUP)
        else:
            spark.conf.set(CLEANUP, before)
    table = spark.read.schema(df.schema).parquet(path)
    table._telar_path = path
    return table


def forget(*tables: DataFrame) -> None:
    """Delete tables that materialize wrote and nothing will read again."""
    for table in tables:
        path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(table._telar_path)
        path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def planes(x: np.ndarray) -> bytes:
    """Numbers compressed with their bytes of the same weight together, after how many there are."""
    return len(x).to_bytes(8, "little") + pa.compress(np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.itemsize).T), "zstd", asbytes=True)


def whole(x: bytes, kind: type) -> np.ndarray:
    """The numbers that planes packed."""
    size = np.dtype(kind).itemsize
    data = pa.decompress(x[8:], int.from_bytes(x[:8], "little") * size, "zstd")
    return np.ascontiguousarray(np.frombuffer(data, np.uint8).reshape(size, -1).T).view(kind).reshape(-1)


def sent(table: DataFrame, size: Column) -> DataFrame:
    """A table written by materialize, to be sent to all where its rows' sizes sum up to BROADCAST_LIMIT bytes at most."""
    return F.broadcast(table) if (table.agg(F.sum(size)).first()[0] or 0) <= BROADCAST_LIMIT else table


def named(name: str) -> Column:
    """A column by its very name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def fresh(df: DataFrame, name: str) -> str:
    """name, or a longer one where df has it."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def grouped(df: DataFrame, keys: list[str], fn: Callable[[pa.Table], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Apply fn to the rows of each group of keys.

    One shuffle by the keys, one sort, and one Python call per partition: a group costs no call of its own, as it
    would with applyInPandas. A group must fit in a worker; callers split large groups beforehand.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        last = None
        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(batch.schema.get_field_index(k)).to_numpy(zero_copy_only=False) for k in keys]
            change = np.zeros(n, bool)
            change[0] = last is not None and any(c[0] != v for c, v in zip(cols, last))
            for c in cols:
                change[1:] |= c[1:] != c[:-1]
            start = 0
            for cut in np.flatnonzero(change).tolist():
                if cut > start:
                    held.append(batch.slice(start, cut - start))
                if held:
                    yield from fn(pa.Table.from_batches(held))
                held, start = [], cut
            held.append(batch.slice(start))
            last = [c[-1] for c in cols]
        if held:
            yield from fn(pa.Table.from_batches(held))

    return df.repartition(*keys).sortWithinPartitions(*keys).mapInArrow(run, schema)

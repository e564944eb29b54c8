"""What the operators of this subpackage share: tables, shared folders, Arrow maps, word splitting."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Words of the contracts that split at ASCII white space, as a Java regex.
SPACE = "[ \\t-\\r]"
#: Rows of an Arrow batch where the session keeps Spark's default of 10,000.
BATCH_ROWS = 1_000
#: The same for byte strings is what ``bytes.split()`` does.


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One parquet table of the data folder, read by Spark so that any file system works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    It is ``spark.checkpoint.dir``.  Where that is unset, only a local master may fall back to a
    folder of this machine; a cluster without the setting is an error rather than a lost file.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        import tempfile

        folder = tempfile.mkdtemp(prefix="satloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


#: Folders and tables of the open ``scratch`` of this driver thread.
_open: ContextVar[list[str] | None] = ContextVar("scratch", default=None)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """What ``stored`` and ``bucketed`` write inside this block, unless lasting, is deleted at its end."""
    token = _open.set(paths := [])
    try:
        yield
    finally:
        _open.reset(token)
        jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
        for path in paths:
            if path.startswith("table "):
                spark.sql(f"DROP TABLE IF EXISTS {path[6:]}")
            else:
                where = jvm.org.apache.hadoop.fs.Path(path)
                where.getFileSystem(conf).delete(where, True)


def _passing(path: str, lasting: bool = False) -> str:
    """Note ``path`` for the open scratch."""
    if not lasting and (paths := _open.get()) is not None:
        paths.append(path)
    return path


def stored(df: DataFrame, tag: str, lasting: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder as Parquet and read it again: cuts lineage, survives lost executors."""
    path = _passing(f"{shared_dir(df.sparkSession)}/{tag}-{uuid.uuid4().hex}", lasting)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def bucketed(df: DataFrame, tag: str, key: str) -> DataFrame:
    """``stored`` as a table bucketed by ``key``: later joins on it move only their other side."""
    spark, name = df.sparkSession, f"satloom_{tag.replace('-', '_')}_{uuid.uuid4().hex}"
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    _passing(f"table {name}")
    df.write.bucketBy(n, key).option("path", _passing(f"{shared_dir(spark)}/{name}")).saveAsTable(name)
    return spark.table(name)


def bitmap(rows: DataFrame, column: str, least: int = 24, most: int = 28, per_row: int = 16) -> np.ndarray:
    """Bits set at the mixed hashes of a column, 2^``least`` to 2^``most`` of them, ``per_row`` a row between.

    Partial sums are made on the map side, and one row a word of 64 bits that has any comes to the driver.  It is a
    prefilter of bounded size: exact joins follow it.
    """
    rows = stored(rows.select(F.col(column).alias("h")), "bitmap")
    bits = min(most, max(least, (per_row * rows.count()).bit_length()))
    low = F.col("h").bitwiseAND((1 << bits) - 1)
    words = rows.groupBy(F.shiftright(low, 6).alias("word")).agg(F.bit_or(F.call_function("shiftleft", F.lit(1).cast("bigint"), low.bitwiseAND(63).cast("int"))).alias("b")).toArrow()
    out = np.zeros(1 << bits - 6, np.int64)
    out[words.column("word").to_numpy()] = words.column("b").to_numpy()
    return out.view(np.uint8)


def passes(bits: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """Which hashes have their bit set in a ``bitmap``."""
    low = hashes.view(np.uint64) & np.uint64(len(bits) * 8 - 1)
    return (bits[(low >> np.uint64(3)).astype(np.int64)] >> (low & np.uint64(7)).astype(np.uint8) & 1).astype(bool)


def arrow_map(df: DataFrame, fn: Callable[[pa.RecordBatch], pa.RecordBatch | Iterable[pa.RecordBatch]], schema: str) -> DataFrame:
    """``mapInArrow`` of a function on one batch; see ``small_batches`` for the size of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                out = fn(batch)
                yield from [out] if isinstance(out, pa.RecordBatch) else out

    importable(df.sparkSession)
    small_batches(df.sparkSession)
    return df.mapInArrow(run, schema)


def small_batches(spark: SparkSession) -> None:
    """Arrow batches of at most ``BATCH_ROWS`` rows, unless the session has a size of its own: texts are long."""
    if spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") == "10000":
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS)


def importable(spark: SparkSession) -> None:
    """Let Python workers of this machine import this package from where the driver has it.

    Executors elsewhere get it as every Python package of a job (``--py-files`` or an installation).
    """
    root = str(Path(__file__).resolve().parents[2])
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


_kept: dict[tuple, object] = {}


def kept(name: str, key, make: Callable):
    """What a Python worker keeps between batches: the tables of one operator.

    Workers are used again by later stages; what another operator left goes first, so that memory is
    bounded by the largest and not by the sum.
    """
    if (name, key) not in _kept:
        _kept.clear()
        _kept[name, key] = make()
    return _kept[name, key]


def pieces(batch: pa.RecordBatch, column: str = "text", most: int = 1 << 23) -> Iterator[tuple[int, int]]:
    """Row ranges of ``batch`` whose texts hold about ``most`` bytes at most (one long text may exceed it)."""
    array = batch.column(column)
    start = size = 0
    for i in range(batch.num_rows):
        n = len(array[i].as_buffer() or b"") if array[i].is_valid else 0
        if i > start and size + n > most:
            yield start, i
            start, size = i, 0
        size += n
    if batch.num_rows > start:
        yield start, batch.num_rows


def held_out(column: str, folds: int):
    """crc32 of the id as text, modulo the number of folds, is 0 (a null id counts as the empty text)."""
    return (F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % folds) == 0


def let(value, body: Callable):
    """Bind ``value`` once and use it many times inside ``body``.

    A lambda variable is evaluated once a row, while Catalyst may copy a projected expression into
    every place that uses it.
    """
    return F.transform(F.array(value), body)[0]

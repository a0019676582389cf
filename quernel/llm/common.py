"""Shared plumbing: tables, the shared-folder workspace, Arrow maps, labelled samples."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Rows that one Arrow batch brings to Python at most, so that a batch of long texts stays small.
BATCH_ROWS = 512
#: Bytes of a batch at which Spark closes it.
BATCH_BYTES = 8 << 20


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.select(*columns) if columns else df


def parts(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches, cut into pieces of at most ``rows`` rows."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows)


def utf8(column: pa.Array) -> list[bytes]:
    """The UTF-8 bytes of a string column; null counts as empty."""
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [b"" if x is None else x for x in column.cast(kind).to_pylist()]


def map_arrow(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow on batches of bounded size; a task gives its memory back as it ends.

    Spark reads the two settings of a batch's size as it plans a query, so where
    the session has larger ones, or none, they are lowered once, and stay so: a
    table that is planned later needs them as well.
    """
    conf = df.sparkSession.conf
    for name, most in (("maxRecordsPerBatch", BATCH_ROWS * 4), ("maxBytesPerBatch", BATCH_BYTES)):
        name = f"spark.sql.execution.arrow.{name}"
        now = conf.get(name).lower().removesuffix("b")
        if not now.isdigit() or not 0 < int(now) <= most:
            conf.set(name, str(most))

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return df.mapInArrow(whole, schema)


def arrow_map(df: DataFrame, make: Callable[[], Callable[[pa.RecordBatch], dict]], schema: str, rows: int = BATCH_ROWS) -> DataFrame:
    """Map each row of ``df``: ``make`` runs once a task and returns the function of a batch."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = None
        for batch in parts(batches, rows):
            work = work or make()
            yield pa.RecordBatch.from_pydict(work(batch))

    return map_arrow(df, run, schema)


def held_out(doc_id):
    """True for the quarter of documents from which no label is learned."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


class Workspace:
    """Tables written to the folder that the cluster names in spark.checkpoint.dir.

    A table written there cuts the lineage and outlives any executor.  Where the
    setting is absent, a local master gets a folder of our own (as in tests); on a
    cluster that is an error, since machines would not see each other's files.
    """

    def __init__(self, spark: SparkSession):
        base = spark.conf.get("spark.checkpoint.dir", None)
        if not base:
            master = spark.sparkContext.master
            if not master.startswith("local") or master.startswith("local-cluster"):
                raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
            base = "file://" + tempfile.mkdtemp(prefix="quernel-")
        self.spark, self.root = spark, f"{base.rstrip('/')}/quernel-{uuid.uuid4().hex}"
        self.paths: list[str] = []

    def place(self, path: str):
        p = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return p.getFileSystem(self.spark._jsc.hadoopConfiguration()), p

    def save(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}-{uuid.uuid4().hex[:8]}"
        if not self.paths:  # what a result still reads goes as the driver ends
            system, root = self.place(self.root)
            system.deleteOnExit(root)
        df.write.parquet(path)
        self.paths.append(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quernel_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        """Delete tables that no later plan reads."""
        for df in frames:
            if (path := getattr(df, "_quernel_path", None)) in self.paths:
                self.paths.remove(path)
                system, at = self.place(path)
                system.delete(at, True)

    def keep(self, *frames: DataFrame) -> None:
        """Delete all tables but these, which the result reads."""
        kept = {getattr(df, "_quernel_path", None) for df in frames}
        for path in [p for p in self.paths if p not in kept]:
            self.paths.remove(path)
            system, at = self.place(path)
            system.delete(at, True)


#: Bytes and rows of a side up to which it is broadcast.
BROADCAST_BYTES, BROADCAST_ROWS = 16 << 20, 500_000


def width(df: DataFrame) -> str:
    """A SQL expression of the bytes of a row, near enough: of long values, their length."""
    out = []
    for f in df.schema.fields:
        kind, c = f.dataType.typeName(), f"`{f.name}`"
        out.append(f"coalesce(octet_length({c}), 0) + 16" if kind in ("string", "binary") else f"coalesce(size({c}), 0) * 16 + 16" if kind == "array" else "8")
    return " + ".join(out)


def keys_join(df: DataFrame, keys: DataFrame, on: str | list[str], how: str = "inner") -> DataFrame:
    """Join ``keys`` to ``df``; they are broadcast only if they are measured to be few and small, in rows and in bytes.

    Else the join shuffles, and Spark may split hot keys.
    """
    n, size = keys.limit(BROADCAST_ROWS + 1).agg(F.count("*"), F.expr(f"coalesce(sum({width(keys)}), 0)")).first()
    return df.join(F.broadcast(keys) if n <= BROADCAST_ROWS and size <= BROADCAST_BYTES else keys, on, how)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, or others like them that the table has not, whatever their case."""
    taken, out = {c.lower() for c in df.columns}, []
    for n in names:
        k, new = 0, n
        while new.lower() in taken:
            k += 1
            new = f"{n}_{k}"
        taken.add(new.lower())
        out.append(new)
    return out


def dealt(df: DataFrame, rows: int, by: list[str], each: int) -> DataFrame:
    """The rows by their keys, in as many partitions as ``rows`` of them need, ``each`` in one."""
    n = max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // each))
    return df.repartition(n, *by).sortWithinPartitions(*by)


def labelled_ids(labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, y) of at most ``bound`` labelled documents outside the held-out quarter, in hash order.

    A document with several labels takes the largest.  The bound is the size of
    the sample that a classifier is fitted on; nothing else is sampled.
    """
    rows = labels.where(F.col(column).isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    rows = rows.groupBy("doc_id").agg(F.max(F.col(column).cast("int")).alias("y"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)


def training_rows(documents: DataFrame, labels: DataFrame, column: str, bound: int) -> DataFrame:
    """(doc_id, text, y) for the sample; the sampled ids are bounded, so they can be broadcast."""
    spark = documents.sparkSession
    ids = labelled_ids(labels, column, bound).collect()
    schema = "doc_id " + dict(documents.dtypes)["doc_id"] + ", y int"
    small = spark.createDataFrame([(r.doc_id, r.y) for r in ids], schema).coalesce(1)
    found = documents.select("doc_id", "text").join(F.broadcast(small), "doc_id")
    return found.groupBy("doc_id", "y").agg(F.min("text").alias("text"))

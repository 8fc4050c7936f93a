"""What the operators share: tables, shared scratch space, free names and connected components."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import functools
import shutil
import tempfile
import time
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
import pyarrow.fs as pafs
from py4j.protocol import Py4JError
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes up to which a side may be broadcast. Beyond it, joins shuffle.
BROADCAST_BYTES = 64 << 20
#: Bytes that a row of a broadcast side takes besides its values.
ROW_BYTES = 24

#: Seconds between two times that the driver gives memory back.
TRIM_S = 5.0

_OWN: dict[str, str] = {}  #: temporary folders by application
_TRIMMED: dict[str, float] = {}  #: when the driver of an application last gave memory back


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where that is unset, a session of one process (tests) gets a temporary folder, removed at its end; a cluster has to name
    one, for executors wouldn't see each other's files.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not path:
        app, master = spark.sparkContext.applicationId, spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError(f"spark.checkpoint.dir must name a folder that the driver and the executors of {master} share")
        if app not in _OWN:
            _OWN[app] = tempfile.mkdtemp(prefix="lamplight-")
            atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
        path = f"file://{_OWN[app]}"
    return path.rstrip("/")


class Scratch:
    """Tables written to the shared folder, so that a lost executor never costs more than the stage that runs. What a result
    still reads stays until the application ends."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root, self.names = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}", set()
        self._files(self.root).deleteOnExit(self._path(self.root))

    def _path(self, path: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(path)

    def _files(self, path: str):
        return self._path(path).getFileSystem(self.spark._jsc.hadoopConfiguration())

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def save(self, df: DataFrame, name: str, **options: str) -> DataFrame:
        df.write.mode("overwrite").options(**options).parquet(self.path(name))
        trim_driver(self.spark)
        self.names.add(name)
        return self.spark.read.schema(df.schema).parquet(self.path(name))

    def drop(self, *names: str) -> None:
        for name in names:
            self._files(self.root).delete(self._path(self.path(name)), True)
            self.names.discard(name)

    def remove(self, folder: str) -> None:
        """Deletes a folder that tasks wrote to."""
        self._files(self.root).delete(self._path(self.path(folder)), True)

    def clear(self, *kept: str) -> None:
        """Drops all tables but those kept."""
        self.drop(*(self.names - set(kept)))


def file_system(path: str) -> tuple[pafs.FileSystem, str]:
    """Where tasks read and write files of the shared folder, and the path there."""
    return pafs.FileSystem.from_uri(path if "://" in path else "file://" + path)


def free(df: DataFrame, *names: str) -> list[str]:
    """The names, each with as many underscores before it as no column of the table, in any case, has."""
    taken, out = {c.lower() for c in df.columns}, []
    for name in names:
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        out.append(name)
    return out


def small(df: DataFrame, width: int | None = None, size: int = BROADCAST_BYTES) -> DataFrame:
    """The table with a broadcast hint if its rows, counted, are few enough bytes, else as it is. width: bytes of a row, those
    of its types by default. For written tables, which count cheaply."""
    rows = size // ((width or df._jdf.schema().defaultSize()) + ROW_BYTES)
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def trim() -> None:
    """Gives memory that was freed back to the system. What allocators can't give back stays."""
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):  # not glibc
        ctypes.CDLL(None).malloc_trim(0)


def trim_driver(spark: SparkSession) -> None:
    """trim() in the driver, for its Python and its JVM; nothing within TRIM_S of the last time.

    Spark's driver starts threads for exchanges, broadcasts and queries, hundreds a minute where tables are small, and the C
    library keeps what they freed, outside the heap. A JVM that has no such command (before 17.0.9, or not on glibc) keeps it.
    """
    app, now = spark.sparkContext.applicationId, time.monotonic()
    if now - _TRIMMED.get(app, float("-inf")) < TRIM_S:
        return
    _TRIMMED[app] = now
    trim()
    with contextlib.suppress(Py4JError):
        jvm, args = spark._jvm, spark.sparkContext._gateway.new_array(spark._jvm.Object, 4)
        args[0], args[1] = jvm.javax.management.ObjectName("com.sun.management:type=DiagnosticCommand"), "systemTrimNativeHeap"
        # by the interface, for the server's own class can't be reached
        invoke = next(m for m in jvm.java.lang.Class.forName("javax.management.MBeanServer").getMethods() if m.getName() == "invoke")
        invoke.invoke(jvm.java.lang.management.ManagementFactory.getPlatformMBeanServer(), args)


def lean(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], *sent: Broadcast) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """run for mapInArrow; at a task's end the worker, which waits beside the executor for other tasks, holds neither its
    batches nor the broadcasts it read, which the next task reads again."""

    @functools.wraps(run)
    def task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        for x in sent:
            vars(x).pop("_value", None)
        trim()

    return task


def spread(df: DataFrame, size: int = 16 << 20, part: int = 1 << 20) -> DataFrame:
    """A small table, which may lie in one file of one row group, dealt to all cores for work that is long a row; others as
    they are read."""
    held = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    return df.repartition(max(1, min(df.sparkSession.sparkContext.defaultParallelism, held // part + 1))) if held < size else df


def components(edges: DataFrame, scratch: Scratch, name: str) -> DataFrame:
    """(node, component) for each node of edges (a, b), longs or binaries: the smallest node reachable.

    Alternating large-star and small-star steps until the edges are stars. Minima are aggregates with map-side
    combination and joins, so that a node with very many edges is split; each round is written to the shared folder.
    """
    now = scratch.save(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), f"{name}-0")
    before, k = None, 0
    while True:
        seen = now.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
        if seen == before:
            break
        before, k = seen, k + 1
        both = now.union(now.select("b", "a"))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        joined = large.join(low, "a")
        star = joined.select("a", F.col("m").alias("b")).union(joined.where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))).distinct()
        now = scratch.save(star, f"{name}-{k}")
        scratch.drop(f"{name}-{k - 1}")
    return now.select(F.col("a").alias("node"), F.col("b").alias("component")).union(now.select("b", "b").distinct())

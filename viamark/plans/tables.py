"""Tables between the steps of a job: written to the shared folder and read back."""

from __future__ import annotations

import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Paths staged inside the innermost :func:`collecting` of this thread.
_scope: ContextVar[list[str] | None] = ContextVar("staged", default=None)


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where the session names none, a local session gets one of its own; on a cluster there is
    no folder that can be guessed, so it is an error.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = tempfile.mkdtemp(prefix="viamark-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that goes when the application ends."""
    path = f"{shared_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).deleteOnExit(where)
    if (scope := _scope.get()) is not None:
        scope.append(path)
    return path


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, gives true sizes.

    The table goes when the application ends, or with :func:`drop_paths`.
    """
    path = new_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


class Appended:
    """A staged table that grows by parts, so that a round writes only what is new in it."""

    def __init__(self, first: DataFrame, name: str):
        self.spark, self.schema, self.path = first.sparkSession, first.schema, new_path(first.sparkSession, name)
        self.parts = 0
        self.last = self.append(first)

    def append(self, part: DataFrame) -> DataFrame:
        """Adds a part and gives it back as a table."""
        at = f"{self.path}/part={self.parts}"
        part.select(*self.schema.names).write.parquet(at)
        self.parts += 1
        self.last = self.spark.read.schema(self.schema).parquet(at)
        return self.last

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).option("recursiveFileLookup", True).parquet(self.path)


class Bucketed:
    """A keyed table of iterative jobs: rounds append rows, and only the buckets they touch are read and compacted.

    Rows fall into ``buckets`` by the hash of ``by``. A bucket that has grown to ``COMPACT``
    parts is rewritten with ``best`` (a function of its rows); others are left alone, so what a
    round writes is its own rows.
    """

    COMPACT = 16

    def __init__(self, spark: SparkSession, name: str, by: list[str], best, buckets: int | None = None):
        self.spark, self.by, self.best, self.path = spark, by, best, new_path(spark, name)
        self.n = buckets or max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
        self.at: dict[int, list[str]] = {}
        self.parts, self.schema = 0, None

    def _write(self, rows: DataFrame) -> dict[int, str]:
        self.schema = self.schema or rows.schema
        to = f"{self.path}/part={self.parts}"
        self.parts += 1
        marked = rows.select(*self.schema.names).withColumn("bucket_", F.pmod(F.xxhash64(*self.by), F.lit(self.n)))
        marked.repartition("bucket_").write.partitionBy("bucket_").parquet(to)
        where = self.spark._jvm.org.apache.hadoop.fs.Path(to)
        found = where.getFileSystem(self.spark._jsc.hadoopConfiguration()).listStatus(where)
        names = [f.getPath().getName() for f in found if f.isDirectory()]
        return {int(n.partition("=")[2]): f"{to}/{n}" for n in names if n.startswith("bucket_=")}

    def append(self, rows: DataFrame) -> DataFrame | None:
        """Adds rows and gives them back as a table; None where there were none."""
        new = self._write(rows)
        for b, path in new.items():
            self.at.setdefault(b, []).append(path)
        full = [b for b in new if len(self.at[b]) > self.COMPACT]
        if full:
            again = self._write(self.best(self.read(full)))
            self.at.update({b: [again[b]] for b in full})
        self.touched = sorted(new)
        return self.spark.read.schema(self.schema).parquet(*new.values()) if new else None

    def read(self, buckets: list[int] | None = None) -> DataFrame:
        """All rows of some buckets, as they were appended."""
        paths = [p for b in (sorted(self.at) if buckets is None else buckets) for p in self.at.get(b, [])]
        return self.spark.read.schema(self.schema).parquet(*paths) if paths else self.spark.createDataFrame([], self.schema)


@contextmanager
def collecting() -> Iterator[list[str]]:
    """The paths of the tables that are staged inside the block."""
    paths: list[str] = []
    token = _scope.set(paths)
    try:
        yield paths
    finally:
        _scope.reset(token)


def drop_paths(spark: SparkSession, paths: list[str]) -> None:
    """Delete staged tables; their readers must have finished."""
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def stored_bytes(df: DataFrame) -> int:
    """Bytes of the files behind a DataFrame read from files."""
    spark, total = df.sparkSession, 0
    conf = spark._jsc.hadoopConfiguration()
    for f in df.inputFiles():
        where = spark._jvm.org.apache.hadoop.fs.Path(f)
        total += where.getFileSystem(conf).getFileStatus(where).getLen()
    return total


#: Bytes of stored input for each shuffle partition, and shuffled bytes that small partitions are put together to.
PER_PARTITION, PER_TASK = 4 << 20, 8 << 20
_STAR = ("customer", "supplier", "part", "orders", "lineitem", "events")


def sized_shuffles(spark: SparkSession, sf_dir: str) -> None:
    """Raise ``spark.sql.shuffle.partitions`` with the size of the tables, so that what a task sorts and holds does not grow with them.

    The session's own number is never lowered; where it is enough, nothing is set.
    """
    total, conf = 0, spark._jsc.hadoopConfiguration()
    for name in _STAR:
        where = spark._jvm.org.apache.hadoop.fs.Path(f"{sf_dir}/{name}.parquet")
        fs = where.getFileSystem(conf)
        if fs.exists(where):
            total += fs.getContentSummary(where).getLength()
    wanted = -(-total // PER_PARTITION)
    if wanted > int(spark.conf.get("spark.sql.shuffle.partitions")):
        spark.conf.set("spark.sql.shuffle.partitions", str(wanted))
        if spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes", None) is None:
            spark.conf.set("spark.sql.adaptive.advisoryPartitionSizeInBytes", str(PER_TASK))


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once an application, for functions that run in Python."""
    context = spark.sparkContext
    if context.applicationId in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    archive = Path(tempfile.mkdtemp(prefix="viamark-")) / f"{root.name}.zip"
    with zipfile.ZipFile(archive, "w") as out:
        for file in sorted(root.rglob("*.py")):
            out.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _shipped.add(context.applicationId)

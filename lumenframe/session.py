"""Session factory, table access and lineage cutting."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def session(master: str | None = None, shuffle_partitions: int | None = None, **conf: str) -> SparkSession:
    """A session with the settings the operators are written for (UTC, AQE, skew joins, Arrow)."""
    builder = SparkSession.builder
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.sql.python.filterPushdown.enabled": "true",
        "spark.ui.enabled": "false",
        **conf,
    }
    if shuffle_partitions:
        settings["spark.sql.shuffle.partitions"] = str(shuffle_partitions)
    return builder.config(map=settings).getOrCreate()


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: what the cluster names in ``spark.checkpoint.dir``.

    Only where that is unset and all work is done in this process (tests, a laptop) it is a temporary folder of this machine;
    a cluster without the setting is an error, since each executor would write to a disk of its own.
    """
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    global _own
    _own = _own or tempfile.mkdtemp(prefix="lumenframe-")
    return f"file://{_own}"


_own: str | None = None
_written: list[tuple[SparkSession, str]] = []


def _write(df: DataFrame) -> str:
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/lumenframe-{uuid.uuid4().hex}"
    if not _written:
        atexit.register(release)
    _written.append((spark, path))
    df.write.parquet(path)
    return path


def cut(df: DataFrame) -> DataFrame:
    """Write ``df`` as a table to the shared folder and continue from there.

    A written table survives lost executors, has true sizes for the planner, packs small files into few tasks and,
    unlike a checkpoint, carries no constraints of the earlier plan, which iterations would multiply.  The tables
    of a session are removed when the process ends.
    """
    return df.sparkSession.read.schema(df.schema).parquet(_write(df))


def cut_counted(df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
    """``cut``, and how many rows fulfil the condition, counted by the same job."""
    seen = Observation()
    held = cut(df.observe(seen, F.count_if(F.expr(condition)).alias("n")))
    return held, int(seen.get.get("n") or 0)


@contextmanager
def modest_broadcasts(spark: SparkSession, most: str = "1m") -> Iterator[None]:
    """Lower the size up to which joins send a table through the driver: iterations run many joins, whose tables the driver would hold together."""
    name = "spark.sql.autoBroadcastJoinThreshold"
    before = spark.conf.get(name)
    spark.conf.set(name, most)
    try:
        yield
    finally:
        spark.conf.set(name, before)


class Rounds:
    """Tables of one schema, written one after the other by an iteration, that can be read as one."""

    def __init__(self, spark: SparkSession, ddl: str) -> None:
        self.spark, self.ddl, self.paths = spark, ddl, []
        self.schema = StructType.fromDDL(ddl)

    def add(self, df: DataFrame, condition: str = "true") -> tuple[DataFrame, int]:
        """The rows as a table, and how many fulfil the condition."""
        seen = Observation()
        named = df.select(*[F.col(f.name).cast(f.dataType) for f in self.schema])
        self.paths.append(_write(named.observe(seen, F.count_if(F.expr(condition)).alias("n"))))
        return self.at(-1), int(seen.get.get("n") or 0)

    def at(self, i: int) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.paths[i])

    def all(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(*self.paths) if self.paths else self.spark.createDataFrame([], self.schema)


def release() -> None:
    """Remove the tables that ``cut`` wrote."""
    while _written:
        spark, path = _written.pop()
        try:
            where = spark._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)
        except Exception:  # noqa: BLE001 - the session may be gone already
            pass

"""Session defaults, the shared scratch folder and the size check used before a broadcast."""

from __future__ import annotations

import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import cache
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BinaryType, MapType, StringType, StructType

#: Rows a side may have before it is no longer broadcast, and the bytes of these rows.
BROADCAST_ROWS = 200_000
BROADCAST_BYTES = 256 << 20
#: Bytes of an Arrow batch inside ``small_batches``; a longer row is a batch of its own.
BATCH_BYTES = 4 << 20


def build_session(app_name: str = "corpusmill", master: str | None = None, **conf: str) -> SparkSession:
    """Session with the settings the engine relies on; cluster settings given in ``conf`` win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    defaults = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.sources.partitionOverwriteMode": "dynamic",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    }
    for key, value in {**defaults, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


@cache
def _machine_folder() -> str:
    return tempfile.mkdtemp(prefix="corpusmill-")


def scratch_folder(spark: SparkSession, purpose: str) -> str:
    """A fresh path for intermediate tables under the shared folder named in ``spark.checkpoint.dir``.

    Only a local master may fall back to a folder of this machine.
    """
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        shared = spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        shared = _machine_folder()
    return f"{shared.rstrip('/')}/{purpose}-{uuid.uuid4().hex[:12]}"


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the Python workers of the session, once per application.

    Executors have no other way to import it unless it is installed there.
    """
    context = spark.sparkContext
    if context.applicationId not in _SHIPPED:
        package = Path(__file__).resolve().parent
        archive = shutil.make_archive(
            f"{tempfile.mkdtemp(prefix='corpusmill-package-')}/corpusmill", "zip", package.parent, package.name
        )
        context.addPyFile(archive)
        _SHIPPED.add(context.applicationId)


def fits_broadcast(frame: DataFrame, max_rows: int = BROADCAST_ROWS, max_bytes: int = BROADCAST_BYTES) -> bool:
    """True when the frame holds at most ``max_rows`` rows of at most ``max_bytes`` together; reads no further than that number of rows.

    Long values are counted as they are, all others with eight bytes each.
    """
    size = F.lit(0).cast("bigint")
    for field in frame.schema:
        column = F.col(f"`{field.name}`")
        if isinstance(field.dataType, (StringType, BinaryType)):
            size += F.coalesce(F.octet_length(column), F.lit(0))
        elif isinstance(field.dataType, (ArrayType, MapType, StructType)):
            size += F.coalesce(F.octet_length(F.to_json(F.struct(column))), F.lit(0))
        else:
            size += F.lit(8)
    rows, held = frame.limit(max_rows + 1).agg(F.count("*"), F.sum(size)).first()
    return rows <= max_rows and (held or 0) <= max_bytes


@contextmanager
def small_batches(spark: SparkSession, size: int = BATCH_BYTES) -> Iterator[None]:
    """What is written inside hands its rows to Python workers in batches of about ``size`` bytes; the session's own setting comes back after.

    Spark holds a batch outside its heap and the worker holds it again, for every core, with whole texts 64 MB each time.
    """
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key, None)
    spark.conf.set(key, str(size))
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def _delete_at_exit(spark: SparkSession, path: str) -> None:
    """Have the folder removed by the file system it is on when the driver's JVM ends."""
    place = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(place)


def stored(frame: DataFrame, purpose: str) -> DataFrame:
    """The frame written to the shared scratch folder and read back.

    For small results that later steps read many times: their plan then starts at files, and an executor
    loss does not repeat the work behind them. The files go when the driver ends.
    """
    path = scratch_folder(frame.sparkSession, purpose)
    frame.write.parquet(path)
    _delete_at_exit(frame.sparkSession, path)
    found = frame.sparkSession.read.parquet(path)
    found._stored_in = path
    return found


def discard(frame: DataFrame) -> None:
    """Delete the files of a frame that ``stored`` gave, once nothing will read it any more; a loop drops each round so when the next one is written."""
    place = frame.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(frame._stored_in)
    place.getFileSystem(frame.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(place, True)

"""Session defaults and the shared working folder."""

from __future__ import annotations

import re
import tempfile
import threading
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


def local_session(name: str = "claimstone", cpus: str = "*", partitions: int = 8, **conf) -> SparkSession:
    """A local session for tests and benchmarks; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName(name)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_dir(spark: SparkSession, label: str) -> str:
    """A fresh path below the folder that driver and executors share.

    The folder is the one the session names in ``spark.checkpoint.dir``.  Only where that
    is unset in local mode (tests, a laptop) a temporary one is made and set as the
    checkpoint folder; a cluster must name one, since its machines share no other.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or context.getCheckpointDir()
    if not root:
        if not context.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        root = tempfile.mkdtemp(prefix="spark-")
        context.setCheckpointDir(root)
    path = f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"
    for made in _SCRATCH:
        made.append(path)
    return path


#: The folders made inside each open ``scratch()``.
_SCRATCH: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes, at its end, the folders that queries made inside it.

    Queries are lazy, so act on their results inside too.
    """
    made: list[str] = []
    _SCRATCH.append(made)
    try:
        yield
    finally:
        _SCRATCH.remove(made)
        for path in made:
            place = spark._jvm.org.apache.hadoop.fs.Path(path)
            place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


#: Spark's setting that removes an execution's shuffle files when it ends.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: A table of a write is broadcast by its estimate only below so many bytes.
SURE = 256 << 10
BROADCAST, ADAPTIVE = "spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold"


def _bytes(size: str) -> int:
    """What a setting like 10MB or 256k says."""
    number, unit = re.fullmatch(r"\s*(-?\d+)\s*([a-z]?)i?b?\s*", size.lower()).groups()
    return int(number) * 1024 ** " kmgtp".index(" " if unit in ("", "b") else unit)


#: Rows of an Arrow batch, and Parquet's option for rows of a row group.
BATCH, GROUP = "spark.sql.execution.arrow.maxRecordsPerBatch", "parquet.block.row.count.limit"

_WRITING: dict[str, tuple[int, dict[str, str | None]]] = {}
_LOCK = threading.Lock()


@contextmanager
def _writing(spark: SparkSession, batch: int | None = None) -> Iterator[None]:
    """CLEANUP on, and no broadcast by size of files; what was before comes back when the last of overlapping writes ends.

    ``batch``: Arrow batches of so many rows.

    Spark takes a Parquet file's bytes for its rows' size, but repeated values compress: rows of
    640 MB came from less than 10 MB and all met in the driver.  Above SURE such tables are
    shuffled; adaptive execution then broadcasts by the size that it has seen, up to the bound
    that the session has.
    """
    session = str(spark._jsparkSession.hashCode())
    with _LOCK:
        n, before = _WRITING.get(session, (0, {k: spark.conf.get(k, None) for k in (CLEANUP, BROADCAST, ADAPTIVE, BATCH)}))
        _WRITING[session] = (n + 1, before)
        if n == 0:
            most = before[BROADCAST] or "10MB"
            spark.conf.set(CLEANUP, "true")
            spark.conf.set(ADAPTIVE, before[ADAPTIVE] or most)
            spark.conf.set(BROADCAST, str(min(_bytes(most), SURE)))
        if batch:
            spark.conf.set(BATCH, str(batch))
    try:
        yield
    finally:
        with _LOCK:
            n, before = _WRITING.pop(session)
            if n > 1:
                _WRITING[session] = (n - 1, before)
            else:
                for key, value in before.items():
                    spark.conf.unset(key) if value is None else spark.conf.set(key, value)


def stored(df: DataFrame, label: str, *, group: int | None = None, batch: int | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage with files that survive the loss of executors, and gives the next
    join a plain scan on this side, which adaptive execution can split when a key is hot.
    Joins of tables that grow belong before such a write, which broadcasts none by the size of
    its file.  The shuffles behind the table aren't needed once it is written, and go with the write;
    a long query then needs the disk of its largest step and not of all steps together.

    Rows of a megabyte need bounds by number, since a task holds a row group whole when it writes
    one and when it reads one, and an Arrow batch beside it: ``group`` rows of the table make a row
    group, and while it is computed ``batch`` rows of others make an Arrow batch.
    """
    return written(df, shared_dir(df.sparkSession, label), group=group, batch=batch)


def written(df: DataFrame, path: str, *, group: int | None = None, batch: int | None = None) -> DataFrame:
    """``stored`` at a given path."""
    spark = df.sparkSession
    with _writing(spark, batch):
        df.write.options(compression="zstd", **{GROUP: str(group)} if group else {}).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


_SHIPPED: set[str] = set()


def ship(spark: SparkSession) -> None:
    """Give this package to the session's Python workers, as ``--py-files`` would; once for each application."""
    context = spark.sparkContext
    if context.applicationId in _SHIPPED:
        return
    root = Path(__file__).resolve().parent
    archive = Path(tempfile.mkdtemp(prefix="spark-")) / "claimstone.zip"
    with zipfile.ZipFile(archive, "w") as z:
        for file in sorted(root.rglob("*.py")):
            z.write(file, file.relative_to(root.parent))
    context.addPyFile(str(archive))
    _SHIPPED.add(context.applicationId)

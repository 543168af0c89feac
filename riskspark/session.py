"""Session settings and the shared folder in which operators keep tables."""

from __future__ import annotations

import os
import tempfile
import uuid
import zipfile
from collections.abc import Callable
from concurrent.futures import ThreadPoolExecutor
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}
_SHIPPED: set[str] = set()


def get_spark(app: str = "riskspark", cores: str = "*", shuffle: int = 8) -> SparkSession:
    """A local session for tests and the bench; a cluster passes its own session."""
    return (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", shuffle)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )


def ship(spark: SparkSession) -> None:
    """Send this package to the executors, once a session, unless their path has it already."""
    root = Path(__file__).resolve().parent.parent
    app = spark.sparkContext.applicationId
    if app in _SHIPPED or str(root) in os.environ.get("PYTHONPATH", "").split(os.pathsep):
        return
    at = os.path.join(tempfile.mkdtemp(prefix="riskspark-"), "riskspark.zip")  # read by the driver alone, which serves it
    with zipfile.ZipFile(at, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(Path(__file__).resolve().parent.rglob("*.py")):
            z.write(p, p.relative_to(root).as_posix())
    spark.sparkContext.addPyFile(at)
    _SHIPPED.add(app)


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir`` of the session.

    Where it is unset a session on one machine (tests) gets a temporary folder; on a cluster this raises, as no
    folder of one machine is shared.
    """
    ship(spark)
    at = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if at:
        return at.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="riskspark-")
        spark.sparkContext.setCheckpointDir(_OWN[app])
    return _OWN[app]


def workspace(spark: SparkSession, name: str) -> str:
    """A new, unique folder path inside the shared folder."""
    return f"{shared_dir(spark)}/riskspark/{name}-{uuid.uuid4().hex[:12]}"


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again.

    This cuts the lineage and survives the loss of executors, as nothing is held by them.
    """
    spark = df.sparkSession
    at = path or workspace(spark, name)
    df.write.mode("overwrite").parquet(at)
    return spark.read.schema(df.schema).parquet(at)


def at_once(*jobs: Callable[[], object]) -> None:
    """Run jobs that do not depend on each other at the same time; the first error is raised."""
    with ThreadPoolExecutor(len(jobs)) as pool:
        for done in [pool.submit(j) for j in jobs]:
            done.result()


MOST_SENT = 400_000


def small_side(df: DataFrame, most: int = MOST_SENT, rows: int | None = None) -> DataFrame:
    """``df``, a written table of a few numbers a row, to be broadcast in a join if it has at most ``most`` rows; else left to a shuffle.

    So a small batch meets a long history without moving it. ``rows``, where their number or a bound on it is known, saves counting.
    """
    return F.broadcast(df) if (df.count() if rows is None else rows) <= most else df


FEW_FILES = 16


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores, if it lies in a handful of files, fewer than there are cores; else as it is.

    A table of many files is never moved: its files are work enough for the cores.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if len(df.inputFiles()) < min(cores, FEW_FILES) else df


# Tables of texts and vectors, on which the work per row is large.
HEAVY = {"documents", "preprocessed_articles", "corpus_records", "article_encodings"}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table; a parquet file or a folder of them."""
    ship(spark)
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(df) if name in HEAVY else df

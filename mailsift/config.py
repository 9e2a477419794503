"""Session helpers and the frozen job configuration (no environment reads
happen on executors: everything a job needs is passed explicitly)."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from contextvars import ContextVar
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession


@dataclass(frozen=True)
class TriageConfig:
    # Body cap and thresholds equal the matched behaviour's
    # defaults; the versions and the contract are deployment labels (set them
    # to what downstream readers expect).
    max_body_chars: int = 12000
    model_version: str = "model-1"
    prompt_version: str = "prompt-1"
    contract: str = "insights-1"
    spam_threshold_h: int = 70      # score >= 0.70 -> spam (hundredths)
    not_spam_threshold_h: int = 20  # score <= 0.20 -> not_spam (hundredths)
    provider: str = "gmail"


DEFAULT_CONFIG = TriageConfig()


def get_spark(master: str | None = None, shuffle_partitions: int | None = None,
              app: str = "mailsift") -> SparkSession:
    """Local/test session builder. On a cluster the session comes from the
    launcher and this function only fills settings that are unset."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
        if master.startswith("local"):
            b = b.config("spark.driver.memory", "8g")
    b = (b.config("spark.ui.enabled", "false")
          .config("spark.sql.session.timeZone", "UTC")
          .config("spark.sql.adaptive.enabled", "true")
          .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
          .config("spark.sql.adaptive.skewJoin.enabled", "true")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.sql.execution.arrow.pyspark.enabled", "true"))
    if shuffle_partitions:
        b = (b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
              .config("mailsift.input.partitions", str(shuffle_partitions)))
    spark = b.getOrCreate()
    try:
        spark.sparkContext.setLogLevel("ERROR")
    except Exception:
        pass
    ensure_checkpoint_dir(spark)
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Use the cluster's shared ``spark.checkpoint.dir``; only when it is
    unset (tests, local runs) create a scratch one."""
    d = spark.conf.get("spark.checkpoint.dir", None)
    if not d:
        if not spark.conf.get("spark.master", "").startswith("local["):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="mailsift-ckpt-")
        spark.conf.set("spark.checkpoint.dir", d)
    try:
        spark.sparkContext.setCheckpointDir(d)
    except Exception:  # no SparkContext on this client (Spark Connect)
        pass
    return d


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a table written once to a new folder under the shared dir."""
    path = shared_dir(df.sparkSession, f"{name}-{uuid.uuid4().hex}")
    if (written := _written.get()) is not None:
        written.append(path)
    df.write.parquet(path, compression="zstd")
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Folders that ``stored`` has written inside ``released``.
_written: ContextVar[list[str] | None] = ContextVar("written", default=None)
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def released(spark: SparkSession) -> Iterator[None]:
    """Intermediate tables (``stored``) written inside are deleted at the end, and
    shuffle files with the query that made them: the disk does not fill up with
    what a job has done with. Results must be written before the end."""
    paths: list[str] = []
    token, before = _written.set(paths), spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        _written.reset(token)
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
        for p in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(p)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def shared_dir(spark: SparkSession, name: str) -> str:
    """A sub folder of the shared checkpoint dir for written intermediate
    tables (used to cut lineage instead of machine-local storage)."""
    base = ensure_checkpoint_dir(spark)
    return os.path.join(base, name) if "://" not in base else base.rstrip("/") + "/" + name

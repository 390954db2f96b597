"""Session helpers: a local session for tests, shared folders on clusters."""

from __future__ import annotations

import atexit
import functools
import os
import shutil
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

#: Bytes below which a side may be broadcast by an explicit hint.
BROADCAST_LIMIT_BYTES = 64 << 20


def local_session(cores: int | str = "*", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session for tests and benches; a cluster passes its own session in."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("claimlake")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("CLAIMLAKE_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    session = builder.getOrCreate()
    session.sparkContext.setLogLevel("ERROR")
    return session


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share, from ``spark.checkpoint.dir``.

    Where the cluster names none (a local session), a temporary folder is made
    once and set as the checkpoint folder; on a cluster that is an error,
    because a folder of one machine would not survive the loss of an executor.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not folder:
        jsc = spark.sparkContext._jsc.sc()
        option = jsc.getCheckpointDir()
        if option.isDefined():
            return option.get()
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        folder = tempfile.mkdtemp(prefix="claimlake-")
        atexit.register(shutil.rmtree, folder, ignore_errors=True)
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh path in the shared folder for one written table."""
    path = f"{shared_dir(spark).rstrip('/')}/claimlake-{name}-{uuid.uuid4().hex}"
    if _MADE:
        _MADE[-1].append(path)
    return path


#: Paths made by the operators that are running, innermost last.
_MADE: list[list[str]] = []


def settled(name: str) -> Callable[[Callable[..., DataFrame]], Callable[..., DataFrame]]:
    """For operators that write tables on their way: the result is written, too, and all other tables are deleted.

    So an operator leaves one table behind, and nothing if it fails.
    """

    def wrap(operator: Callable[..., DataFrame]) -> Callable[..., DataFrame]:
        @functools.wraps(operator)
        def run(*args: object, **options: object) -> DataFrame:
            made: list[str] = []
            _MADE.append(made)
            kept = None
            spark = next((a.sparkSession for a in args if isinstance(a, DataFrame)), None) or SparkSession.active()
            try:
                result = materialise(operator(*args, **options), name)
                kept = made[-1]
                return result
            finally:
                _MADE.pop()
                for path in made:
                    if path != kept:
                        remove_shared(spark, path)
                if kept and _MADE:
                    _MADE[-1].append(kept)

        return run

    return wrap


def materialise(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Cuts the lineage and keeps the rows on storage that outlives an executor.
    """
    path = shared_path(df.sparkSession, name)
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove_shared(spark: SparkSession, path: str) -> None:
    """Delete a folder that :func:`shared_path` named."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)

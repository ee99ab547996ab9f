"""Tables written between stages, in the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager, nullcontext

from pyspark.sql import DataFrame, SparkSession

_own_folders: dict[str, str] = {}
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: spark.checkpoint.dir; where it is unset, one of our own for the session, in local mode only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        name = spark.sparkContext.applicationId
        if name not in _own_folders:
            _own_folders[name] = "file://" + tempfile.mkdtemp(prefix="orebed-")
        folder = _own_folders[name]
    return folder.rstrip("/")


def written(df: DataFrame, name: str, tidy: bool = False) -> DataFrame:
    """The rows of ``df`` as a table in the shared folder: lineage ends here, and lost executors cost nothing that was done before.

    Shuffle files stay on disk until the driver happens to collect its garbage;
    with ``tidy`` those of this write go as soon as it is done.
    """
    path = f"{shared_folder(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    with _no_shuffle_left(df.sparkSession) if tidy else nullcontext():
        df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


@contextmanager
def _no_shuffle_left(spark: SparkSession) -> Iterator[None]:
    """What is run inside removes its shuffle files when it ends."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_CLEANUP)
        else:
            spark.conf.set(_CLEANUP, before)


def shards(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def removed(df: DataFrame) -> None:
    """Remove a table that :func:`written` made and nothing will read again."""
    spark = df.sparkSession
    folder = shared_folder(spark)
    paths = {f.rsplit("/", 1)[0] for f in df.inputFiles()}
    own = [p for p in paths if p.rstrip("/").rsplit("/", 1)[0].removeprefix("file:").lstrip("/") == folder.removeprefix("file:").lstrip("/")]
    for p in own:
        path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(p)
        path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(path, True)

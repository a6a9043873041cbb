"""Shared-folder tables that cut lineage.

Intermediate tables go below ``spark.checkpoint.dir``: every executor can read
them, so losing an executor loses nothing.  A folder of our own is used only
where the setting is absent, as in local tests.
"""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import urllib.parse
import uuid
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession

_CLEAN_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_live: set[str] = set()


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, or a temporary one if it names none."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if base is None and not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if base is None:
        base = "file://" + tempfile.mkdtemp(prefix="kelpwright-")
        spark.conf.set("spark.checkpoint.dir", base)
    return base.rstrip("/")


def delete(spark: SparkSession, path: str) -> None:
    """Remove a table written by :class:`Workspace`; absent paths are fine."""
    jvm = spark.sparkContext._jvm
    target = jvm.org.apache.hadoop.fs.Path(path)
    target.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(target, True)
    _live.discard(path)


def table_bytes(table: DataFrame) -> int:
    """Bytes of the files of a table that was read back."""
    spark = table.sparkSession
    conf, path = spark.sparkContext._jsc.hadoopConfiguration(), spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    files = [path(f) for f in table.inputFiles()]
    return sum(f.getFileSystem(conf).getFileStatus(f).getLen() for f in files)


@contextlib.contextmanager
def open_stream(path: str) -> Iterator[object]:
    """A file of any supported file system, read as it is asked for."""
    from pyarrow.fs import FileSystem

    if path.startswith("file:"):
        with open("/" + path.removeprefix("file:").lstrip("/"), "rb") as stream:
            yield stream
        return
    fs, inner = FileSystem.from_uri(urllib.parse.quote(path, safe=":/@"))
    with fs.open_input_stream(inner) as stream:
        yield stream


@contextlib.contextmanager
def shuffle_cleanup(spark: SparkSession) -> Iterator[None]:
    """Let each SQL execution inside drop its shuffle files when it ends.

    Staged operators then need the disk of their largest stage, not of all.
    """
    before = spark.conf.get(_CLEAN_SHUFFLES, "false")
    spark.conf.set(_CLEAN_SHUFFLES, "true")
    try:
        yield
    finally:
        spark.conf.set(_CLEAN_SHUFFLES, before)


class Workspace:
    """A folder of intermediate tables belonging to one operator call."""

    def __init__(self, spark: SparkSession, label: str) -> None:
        self.spark = spark
        self.root = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex[:12]}"
        _live.add(self.root)
        atexit.register(self._at_exit)

    def path(self, name: str) -> str:
        return f"{self.root}/{name}"

    def write(self, df: DataFrame, name: str, **options: object) -> DataFrame:
        """Write ``df`` as parquet and return the table read back."""
        path = self.path(name)
        with shuffle_cleanup(self.spark):
            df.write.options(**options).parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)

    def drop(self, name: str) -> None:
        delete(self.spark, self.path(name))

    def _at_exit(self) -> None:
        if self.root in _live:
            with contextlib.suppress(Exception):
                delete(self.spark, self.root)

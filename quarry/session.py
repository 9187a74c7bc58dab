"""Session helpers: the package on Python workers, and tables in the cluster's shared folder."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

ROOT = str(Path(__file__).resolve().parent.parent)

#: Bytes of one Arrow batch: long texts otherwise make batches of any size.
BATCH_BYTES = 8 << 20

_LOCAL: dict[str, str] = {}
_OPEN: list[list[Scratch]] = []


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package, also where it isn't installed or on their path.

    A cluster installs it, or gets it by ``--py-files``; the path does no harm there.
    """
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if ROOT not in paths:
        env["PYTHONPATH"] = ":".join([*paths, ROOT])


def tune(spark: SparkSession) -> None:
    """Bound the session's Arrow batches by bytes, where they aren't bounded lower already."""
    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    now = spark.conf.get(key).rstrip("bB")
    if not now.isdigit() or int(now) > BATCH_BYTES:
        spark.conf.set(key, str(BATCH_BYTES))


def shared_dir(spark: SparkSession) -> str:
    """The cluster's shared folder, ``spark.checkpoint.dir``. Only a local master may leave it unset and gets a temporary one."""
    found = spark.conf.get("spark.checkpoint.dir", None)
    if found:
        return found.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local[") and context.master != "local":
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if context.applicationId not in _LOCAL:
        _LOCAL[context.applicationId] = tempfile.mkdtemp(prefix="quarry-")
        atexit.register(shutil.rmtree, _LOCAL[context.applicationId], ignore_errors=True)
    return _LOCAL[context.applicationId]


class Scratch:
    """Tables written to the shared folder, so that lost executors can't lose them.

    ``cut`` writes a frame and reads it back; ``drop`` deletes what is no longer needed, ``close``
    all of it. What remains goes when the session's driver ends, or with ``released``.
    """

    def __init__(self, spark: SparkSession):
        self.spark = spark
        self.root = f"{shared_dir(spark)}/quarry-{uuid.uuid4().hex}"
        self.count = 0
        atexit.register(self.close)
        if _OPEN:
            _OPEN[-1].append(self)

    def path(self, tag: str) -> str:
        """A new path of its own."""
        self.count += 1
        return f"{self.root}/{self.count - 1:03d}-{tag}"

    def cut(self, df: DataFrame, tag: str, by: str | None = None) -> DataFrame:
        """df, written and read back; a column ``by`` parts the files, so that a filter on it reads its files only."""
        path = self.path(tag)
        (df.write.partitionBy(by) if by else df.write).parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out._quarry_path = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        for df in frames:
            path = getattr(df, "_quarry_path", None)
            if path:
                self._delete(path)

    def close(self) -> None:
        atexit.unregister(self.close)
        try:
            self._delete(self.root)
        except Exception:  # the JVM may be gone already
            pass

    def _delete(self, path: str) -> None:
        jvm = self.spark.sparkContext._jvm
        target = jvm.org.apache.hadoop.fs.Path(path)
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        target.getFileSystem(conf).delete(target, True)


@contextmanager
def released() -> Iterator[None]:
    """Delete, at the end, all tables that operators have written inside; their results must be written by then."""
    _OPEN.append([])
    try:
        yield
    finally:
        for s in _OPEN.pop():
            s.close()

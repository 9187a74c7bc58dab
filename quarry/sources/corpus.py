"""Documents from directories and strings, corpora as Parquet, and search results as text."""

from __future__ import annotations

import os
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as fs
from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.operators.order import running
from quarry.operators.search import search
from quarry.session import Scratch

MAX_FILE = 2 << 20


def parse_size(text: str) -> int:
    """Bytes of a size such as 256MB, 1.5 GiB or 4096."""
    number = text.strip().rstrip("BbiIKkMmGgTt ")
    unit = text.strip()[len(number) :].strip().lower()
    scale = {"": 1, "b": 1, "k": 1000, "kb": 1000, "kib": 1 << 10, "m": 10**6, "mb": 10**6, "mib": 1 << 20, "g": 10**9, "gb": 10**9, "gib": 1 << 30, "t": 10**12, "tb": 10**12, "tib": 1 << 40}
    if unit not in scale:
        raise ValueError(f"unknown unit in {text!r}")
    return int(float(number) * scale[unit])


def numbered(files: DataFrame, scratch: Scratch) -> DataFrame:
    """Rows (path, ...) with doc_id, 0 for the first path, in the order of paths."""
    names = files.columns
    return running(files.withColumn("_one", F.lit(1).cast("long")), ["path"], "_one", scratch).select(F.col("before").alias("doc_id"), *names)


def _listed(spark: SparkSession, path: str, max_file: int) -> DataFrame:
    """(path, size) of the regular files below a path, hidden ones too, of at most max_file bytes.

    The driver lists the first level; tasks list what is below, so that no machine lists it all. A
    task that can't see the path at all fails, instead of finding nothing; single entries that
    can't be read are left out.
    """
    store, root = fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), os.path.abspath(path))
    local = isinstance(store, fs.LocalFileSystem)
    first = store.get_file_info(fs.FileSelector(root))
    entries = spark.createDataFrame([(x.path, x.type == fs.FileType.Directory, x.size) for x in first], "path string, folder boolean, size long")
    entries = entries.repartition(max(1, min(len(first), 4 * spark.sparkContext.defaultParallelism)), "path")

    def below(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        there = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
        for batch in batches:
            if there.get_file_info(root).type != fs.FileType.Directory:
                raise FileNotFoundError(f"{root} isn't a folder on this machine; all executors must share it")
            out = []
            waiting = [(r["path"], r["folder"], r["size"]) for r in batch.to_pylist()]
            while waiting:
                name, folder, size = waiting.pop()
                if local and os.path.islink(name):
                    continue
                if folder:
                    try:
                        waiting += [(x.path, x.type == fs.FileType.Directory, x.size) for x in there.get_file_info(fs.FileSelector(name)) if x.type in (fs.FileType.Directory, fs.FileType.File)]
                    except OSError:
                        continue
                elif size is not None and size <= max_file and (not local or os.path.isfile(name) and os.access(name, os.R_OK)):
                    out.append((name, size))
            yield pa.RecordBatch.from_arrays([pa.array([n for n, _ in out], pa.string()), pa.array([k for _, k in out], pa.int64())], names=["path", "size"])

    return entries.mapInArrow(below, "path string, size long")


def directory(spark: SparkSession, path: str, max_file: int = MAX_FILE, hidden: bool = True) -> DataFrame:
    """(doc_id, path, content, text, valid) of all regular files below a directory, of at most max_file bytes.

    Spark's file source leaves out names with a leading dot or underscore; with ``hidden`` they are
    there. Paths may be local ones, on a file system that all executors share, or URIs. ``valid``
    tells whether the bytes were UTF-8; where not, text has replacements.
    """
    scratch = Scratch(spark)
    if hidden:
        def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            there = fs.FileSystem.from_uri(path)[0] if "://" in path else fs.LocalFileSystem()
            for batch in batches:
                # contents leave a few files at a time
                for lo in range(0, batch.num_rows, 16):
                    some = batch.slice(lo, 16)
                    raw = [there.open_input_stream(p).read() for p in some.column(1).to_pylist()]
                    yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), pa.array(raw, pa.binary())], names=["doc_id", "path", "content"])

        # the numbers are given to names, and no content is sorted
        files = numbered(_listed(spark, path, max_file), scratch).select("doc_id", "path")
        files = files.repartition(4 * spark.sparkContext.defaultParallelism, "path").mapInArrow(read, "doc_id long, path string, content binary")
    else:
        found = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).where(F.col("length") <= max_file)
        files = numbered(found.select("path"), scratch).join(found.select("path", "content"), "path")
    text = F.col("content").cast("string")
    return files.select("doc_id", "path", "content", F.make_valid_utf8(text).alias("text"), F.is_valid_utf8(text).alias("valid"))


def string(spark: SparkSession, text: str, path: str = "string") -> DataFrame:
    """One document, with id 0."""
    return spark.createDataFrame([(0, path, bytearray(text.encode()), text, True)], "doc_id long, path string, content binary, text string, valid boolean")


def write_corpus(docs: DataFrame, path: str, mode: str = "overwrite") -> DataFrame:
    """Write documents sorted by id in ranges, and read them back; the commit mark is written last."""
    docs.repartitionByRange("doc_id").sortWithinPartitions("doc_id").write.mode(mode).parquet(path)
    return open_corpus(docs.sparkSession, path)


def open_corpus(spark: SparkSession, path: str, cache: bool = False, level: StorageLevel = StorageLevel.MEMORY_AND_DISK_DESER) -> DataFrame:
    """A written corpus; cached at a storage level, whose size Spark's own memory settings bound."""
    docs = spark.read.parquet(path)
    return docs.persist(level) if cache else docs


def build_index(spark: SparkSession, out: str, directory_path: str | None = None, text: str | None = None, max_file: int = MAX_FILE, if_absent: bool = False) -> DataFrame:
    """A corpus and its trigram index below ``out``, from a directory or a string; a directory goes first."""
    from quarry.operators import index

    if directory_path is None and text is None:
        raise ValueError("a directory or a string is needed")
    mode = "ignore" if if_absent else "overwrite"
    docs = directory(spark, directory_path, max_file) if directory_path is not None else string(spark, text or "")
    docs = write_corpus(docs, f"{out}/docs", mode)
    index.build(docs, f"{out}/index", mode=mode)
    return docs


def result_lines(docs: DataFrame, pattern: str, limit: int | None = None, **options) -> list[str]:
    """The search as text: a header for each document, then a line for each match, of ``limit`` matches at most."""
    if limit is not None and limit <= 0:
        return []
    found = search(docs, pattern, **options)
    rows = found.select("doc_id", "content", F.explode("matches").alias("m")).orderBy("doc_id", "m.start", "m.end")
    out, last = [], None
    for r in rows.limit(limit).toLocalIterator() if limit is not None else rows.toLocalIterator():
        if r["doc_id"] != last:
            last = r["doc_id"]
            out.append(f"document {last}:")
        out.append(r["content"].encode()[r["m"]["start"] : r["m"]["end"]].decode("utf-8", "replace"))
    return out


def write_results(docs: DataFrame, pattern: str, path: str, **options) -> None:
    """The matches as text files, a line each: id, start, end and text by tabs."""
    from quarry.operators.search import exploded

    one = exploded(search(docs, pattern, **options))
    raw = F.substring(F.encode("content", "UTF-8"), F.col("start").cast("int") + 1, (F.col("end") - F.col("start")).cast("int"))
    one.select(F.concat_ws("\t", F.col("doc_id").cast("string"), F.col("start").cast("string"), F.col("end").cast("string"), F.make_valid_utf8(raw.cast("string")))).write.mode("overwrite").text(path)

"""Text file source: one row per file."""

from __future__ import annotations

import os
import re
import unicodedata
import zlib
from collections.abc import Iterator
from fnmatch import fnmatchcase
from itertools import islice

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FEW_FILES = 4096  # that the driver may list
SHARES_A_CORE = 2
ROWS_AT_ONCE, BYTES_AT_ONCE = 1000, 4 << 20
_PLAIN = frozenset("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789_-!.~'()*:@&=+$,;")  # fixed value: what a URI's path may hold


def read_documents(spark: SparkSession, folder: str, glob: str = "*.txt") -> DataFrame:
    """``file_name, text`` of all files matching ``glob``, each read whole; empty files are passed over.

    Plain text files are read as bytes, a quarter of the time a file that Spark's text reader takes. That
    reader unpacks files by the end of their names, so it stays for globs that may match packed ones.
    Spark's readers list all files on the driver, about a kilobyte each, so a folder of more than ``FEW_FILES``
    that can be opened without them is listed by the tasks (see :func:`_shares`).
    """
    name = F.col("_metadata.file_name").alias("file_name")
    if glob.endswith(".txt"):
        place = _place(spark, folder) if not re.search(r"[\[\]{}\\^,]", glob) else None
        if place is not None:
            return _shares(spark, place, glob).select("file_name", F.col("content").cast("string").alias("text"))
        df = spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder)
        return df.where("length > 0").select(name, F.col("content").cast("string").alias("text"))
    return spark.read.option("pathGlobFilter", glob).text(folder, wholetext=True).select(name, F.col("value").alias("text"))


def _open(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(re.sub(r"^file:/+", "/", uri))


def _place(spark: SparkSession, folder: str) -> str | None:
    """The URI of a folder that tasks can open by themselves; None for any other, and for one of few files."""
    if re.search(r"[*?\[\]{}\\%]", folder):
        return None
    path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
    uri = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(path).toString()
    try:
        system, at = _open(uri)
        if system.get_file_info(at).type != fs.FileType.Directory:
            return None
        few = isinstance(system, fs.LocalFileSystem) and len(list(islice(_names(system, at), FEW_FILES + 1))) <= FEW_FILES
        return None if few else uri
    except (pa.ArrowException, OSError):  # a store that only Spark opens
        return None


def _shown(name: str) -> str:
    """A file's name as Spark's ``_metadata.file_name`` has it, which is that of its URI."""

    def kept(c: str) -> bool:
        return c in _PLAIN or c >= "\xa0" and unicodedata.category(c) not in ("Zs", "Zl", "Zp")

    return name if _PLAIN.issuperset(name) else "".join(c if kept(c) else "".join(f"%{b:02X}" for b in c.encode()) for c in name)


def _names(system: fs.FileSystem, at: str) -> Iterator[str]:
    """Names of the files in a folder; those of a local one come without the list being held."""
    if isinstance(system, fs.LocalFileSystem):
        with os.scandir(at) as entries:
            yield from (e.name for e in entries if e.is_file())
    else:
        yield from (e.base_name for e in system.get_file_info(fs.FileSelector(at)) if e.is_file)


def _shares(spark: SparkSession, uri: str, glob: str) -> DataFrame:
    """``file_name, content`` of the files in a folder that are not hidden and not empty.

    Every task goes through the names and reads those whose hash is its own, so no one holds the list.
    """
    shares = SHARES_A_CORE * spark.sparkContext.defaultParallelism

    def wanted(name: str) -> bool:
        return not (name.startswith(".") or name.startswith("_") and "=" not in name) and fnmatchcase(name, glob)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, at = _open(uri)

        def batch(names: list[str], texts: list[bytes]) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(texts, pa.binary())], ["file_name", "content"])

        for own in (k for b in batches for k in b.column(0).to_pylist()):
            names, texts, held = [], [], 0
            for name in _names(system, at):
                if zlib.crc32(os.fsencode(name)) % shares != own or not wanted(name):
                    continue
                with system.open_input_stream(f"{at}/{name}", compression=None) as file:
                    text = file.read()
                if text:
                    names.append(_shown(name))
                    texts.append(text)
                    held += len(text)
                if len(names) == ROWS_AT_ONCE or held > BYTES_AT_ONCE:
                    yield batch(names, texts)
                    names, texts, held = [], [], 0
            if names:
                yield batch(names, texts)

    return spark.range(0, shares, numPartitions=shares).mapInArrow(read, "file_name string, content binary")

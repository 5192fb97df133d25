"""Uploaded projects: single .tex files and archives, unpacked to project files."""

from __future__ import annotations

import io
import posixpath
import tarfile
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bytes of an upload, and of its files when unpacked.
MAX_BYTES, MAX_UNPACKED = 50 * 1024 * 1024, 512 * 1024 * 1024
SUFFIXES = (".tex", ".zip", ".tar", ".tgz", ".tar.gz")


class UnsafeArchiveError(ValueError):
    """A member would land outside the project."""


def safe_path(member: str) -> str:
    path = posixpath.normpath(member.replace("\\", "/"))
    if path.startswith("/") or path == ".." or path.startswith("../") or (len(path) > 1 and path[1] == ":"):
        raise UnsafeArchiveError(f"the member {member!r} would be written outside of its project")
    return path


def members(name: str, content: bytes) -> Iterator[tuple[str, bytes]]:
    """(path, bytes) of the files of an upload; all paths and sizes are checked before the first is given out."""
    low = name.lower()
    if len(content) > MAX_BYTES:
        raise ValueError(f"{name}: more than {MAX_BYTES} bytes")
    if low.endswith(".tex"):
        yield posixpath.basename(name), content
    elif low.endswith(".zip"):
        with zipfile.ZipFile(io.BytesIO(content)) as archive:
            found = [(m, safe_path(m.filename)) for m in archive.infolist()]
            _check_unpacked(name, sum(m.file_size for m, _ in found))
            for m, p in found:
                if not m.is_dir():
                    with archive.open(m) as f:
                        yield p, f.read(m.file_size)
    elif low.endswith((".tar", ".tgz", ".tar.gz")):
        with tarfile.open(fileobj=io.BytesIO(content), mode="r:*") as archive:
            found = [(m, safe_path(m.name)) for m in archive.getmembers()]
            _check_unpacked(name, sum(m.size for m, _ in found))
            for m, p in found:
                if m.isfile() and (f := archive.extractfile(m)):
                    yield p, f.read()
    else:
        raise ValueError(f"{name}: neither a .tex file nor an archive of a known kind")


def _check_unpacked(name: str, size: int) -> None:
    if size > MAX_UNPACKED:
        raise ValueError(f"{name}: its files have more than {MAX_UNPACKED} bytes")


def decoded(content: bytes) -> str:
    try:
        return content.decode("utf-8")
    except UnicodeDecodeError:
        return content.decode("latin-1")


def unpack_uploads(uploads: DataFrame) -> DataFrame:
    """(doc_id, path, text) of the .tex files of uploads (doc_id, name, content). One upload is one row, so a task holds
    one archive of at most MAX_BYTES at a time."""
    kind = uploads.schema["doc_id"].dataType.simpleString()

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for r in part.itertuples():
                files = [(r.doc_id, p, decoded(b)) for p, b in members(r.name, bytes(r.content)) if p.lower().endswith(".tex")]
                if not files:
                    raise ValueError(f"{r.name}: holds no .tex file")
                yield pd.DataFrame(files, columns=["doc_id", "path", "text"])

    return uploads.select("doc_id", "name", "content").mapInPandas(run, f"doc_id {kind}, path string, text string")


def _refusal(path: Column, length: Column) -> Column:
    """Why a file is no upload; null for one that is."""
    supported = F.lit(False)
    for s in SUFFIXES:
        supported |= F.lower(path).endswith(s)
    return F.when(~supported, F.concat(path, F.lit(": neither a .tex file nor an archive of a known kind"))).when(length > MAX_BYTES, F.concat(path, F.lit(f": more than {MAX_BYTES} bytes")))


def _files(spark: SparkSession, path: str) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.withColumn("reason", _refusal(F.col("path"), F.col("length")))


def refused_uploads(spark: SparkSession, path: str) -> DataFrame:
    """(path, reason) of the files in a folder that are no uploads: too large, or of an unknown kind."""
    return _files(spark, path).where("reason is not null").select("path", "reason")


def read_uploads(spark: SparkSession, path: str, skip_refused: bool = False) -> DataFrame:
    """(doc_id, name, content) of the files in a folder, doc_id being a file's path. A file that is no upload is an error,
    unless skip_refused; refused_uploads() names such files. Contents are not read before that is settled."""
    if not skip_refused and (bad := refused_uploads(spark, path).limit(20).collect()):
        raise ValueError("; ".join(r.reason for r in bad))
    files = _files(spark, path).where("reason is null")
    return files.select(F.col("path").alias("doc_id"), F.element_at(F.split("path", "/"), -1).alias("name"), "content")

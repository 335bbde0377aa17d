"""Listings of Hadoop file systems, by glob, walk and filter."""

from __future__ import annotations

from collections.abc import Callable, Iterator

from pyspark.sql import SparkSession

Filter = Callable[[str], bool]


def name_of(path: str) -> str:
    return path.rstrip("/").rpartition("/")[2]


def visible(path: str) -> bool:
    return not name_of(path).startswith((".", "_"))


def anything(path: str) -> bool:
    return True


def all_of(*filters: Filter) -> Filter:
    return lambda path: all(f(path) for f in filters)


def suffix(*ends: str) -> Filter:
    return lambda path: path.endswith(ends)


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def expand(spark: SparkSession, *globs: str) -> list[str]:
    """Paths that match; a glob without matches adds nothing."""
    out = []
    for g in globs:
        at, fs = _fs(spark, g)
        out += [s.getPath().toString() for s in fs.globStatus(at) or []]
    return out


def walk(spark: SparkSession, path: str, keep: Filter = visible, recursive: bool = True, folders: bool = False) -> Iterator[str]:
    """Files below path that the filter keeps, and folders if asked for; a folder that it doesn't keep isn't entered."""
    at, fs = _fs(spark, path)
    for s in fs.listStatus(at):
        p = s.getPath().toString()
        if not keep(p) and not (s.isDirectory() and visible(p) and keep is not visible):
            continue
        if s.isDirectory():
            if folders and keep(p):
                yield p
            if recursive:
                yield from walk(spark, p, keep, True, folders)
        else:
            yield p


def size(spark: SparkSession, path: str, keep: Filter = visible) -> int:
    """Bytes of the files that the filter keeps."""
    total = 0
    for p in walk(spark, path, keep):
        at, fs = _fs(spark, p)
        total += fs.getFileStatus(at).getLen()
    return total

"""Versioned folders: what is published goes into a folder of its own, and a pointer then names it in one step.

The pointer is the name of an empty file, so a reader sees either the version before or the whole new one, and
never one version's data with another's description. Writers that meet take numbers of their own; the highest holds.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import SparkSession

POINTERS, ABOUT = "pointers", "about.json"


def storage(spark: SparkSession, path: str):
    """Hadoop's file system of a path, and its paths' class."""
    of = spark._jvm.org.apache.hadoop.fs.Path
    return of(path).getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()), of


def pointers(spark: SparkSession, base: str) -> list[str]:
    """Names of the pointers, oldest first."""
    files, of = storage(spark, base)
    folder = of(f"{base}/{POINTERS}")
    return sorted(s.getPath().getName() for s in files.listStatus(folder)) if files.exists(folder) else []


def new_version(spark: SparkSession, base: str) -> str:
    """A folder for a version that nobody sees before commit."""
    return f"{base}/version-{uuid.uuid4().hex}"


def commit(spark: SparkSession, base: str, version: str, about: dict) -> None:
    """Describe the version, then let the pointer name it."""
    files, of = storage(spark, base)
    out = files.create(of(f"{version}/{ABOUT}"), True)
    try:
        out.write(bytearray(json.dumps(about, sort_keys=True).encode()))
    finally:
        out.close()
    known = pointers(spark, base)
    number = int(known[-1].split(".")[0]) + 1 if known else 1
    files.create(of(f"{base}/{POINTERS}/{number:010d}.{version.rsplit('/', 1)[1]}"), True).close()


def current(spark: SparkSession, base: str) -> tuple[str, dict] | None:
    """Folder and description of the version that holds; None before the first."""
    known = pointers(spark, base)
    if not known:
        return None
    version = f"{base}/{known[-1].split('.', 1)[1]}"
    files, of = storage(spark, base)
    stream = files.open(of(f"{version}/{ABOUT}"))
    try:
        text = spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()
    return version, json.loads(text)


def expire(spark: SparkSession, base: str, keep: int = 2) -> int:
    """Delete all versions but the newest keep, pointers first; how many went. Readers of older ones must have ended."""
    files, of = storage(spark, base)
    old = pointers(spark, base)[:-keep]
    for name in old:
        files.delete(of(f"{base}/{POINTERS}/{name}"), False)
        files.delete(of(f"{base}/{name.split('.', 1)[1]}"), True)
    return len(old)

"""Folders that grow by whole commits.

Data are written to a folder that readers don't look at (its name begins with ``_``) and then renamed to the next number,
``v=0``, ``v=1``, ... Renaming is atomic and fails where the target exists, so of two writers one is first, and the other
looks at what the first has added before it tries the next number. A writer that dies leaves nothing that readers see.
Object stores without atomic renames aren't supported."""

from __future__ import annotations

import os
import uuid
from collections.abc import Callable
from urllib.parse import unquote, urlparse

from pyspark.sql import DataFrame, SparkSession


def _local(path: str) -> str | None:
    parts = urlparse(path)
    return unquote(parts.path) if parts.scheme in ("", "file") else None


def _hadoop(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    return jvm.org.apache.hadoop.fs.Path(path), jvm, spark.sparkContext._jsc.hadoopConfiguration()


def publish(spark: SparkSession, written: str, target: str) -> bool:
    """Rename the folder ``written`` to ``target``; False if that exists."""
    here, there = _local(written), _local(target)
    if here is not None and there is not None:
        os.makedirs(os.path.dirname(there), exist_ok=True)
        if os.path.exists(there):
            return False
        try:
            os.rename(here, there)
        except OSError:  # the target has come into being since
            if os.path.exists(there):
                return False
            raise
        return True
    (source, jvm, conf), (goal, _, _) = _hadoop(spark, written), _hadoop(spark, target)
    fs = goal.getFileSystem(conf)
    fs.mkdirs(goal.getParent())
    if fs.exists(goal):
        return False
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(goal.toUri(), conf)
    none = spark.sparkContext._gateway.new_array(jvm.org.apache.hadoop.fs.Options.Rename, 0)
    try:
        context.rename(source, goal, none)
    except Exception:
        if fs.exists(goal):
            return False
        raise
    return True


def exists(spark: SparkSession, path: str) -> bool:
    found, _, conf = _hadoop(spark, path)
    return found.getFileSystem(conf).exists(found)


def version(spark: SparkSession, path: str) -> int:
    """The number that comes next."""
    root, _, conf = _hadoop(spark, path)
    fs = root.getFileSystem(conf)
    if not fs.exists(root):
        return 0
    names = [s.getPath().getName() for s in fs.listStatus(root)]
    return 1 + max((int(n[2:]) for n in names if n.startswith("v=") and n[2:].isdigit()), default=-1)


def staged(path: str) -> str:
    """A fresh folder within ``path`` that readers don't look at."""
    return f"{path.rstrip('/')}/_staged-{uuid.uuid4().hex}"


def _dropped(spark: SparkSession, path: str) -> None:
    found, _, conf = _hadoop(spark, path)
    found.getFileSystem(conf).delete(found, True)


def append(spark: SparkSession, path: str, fresh: Callable[[], DataFrame], attempts: int = 100) -> int:
    """Write what ``fresh`` gives as the next commit; its number. ``fresh`` is asked again whenever another writer was
    first, and sees that one's commit then."""
    for _ in range(attempts):
        number, place = version(spark, path), staged(path)
        try:
            fresh().write.json(place)
            if publish(spark, place, f"{path.rstrip('/')}/v={number}"):
                return number
        except BaseException:
            _dropped(spark, place)
            raise
        _dropped(spark, place)
    raise RuntimeError(f"{attempts} attempts to append to {path} have failed")

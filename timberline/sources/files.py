"""Files of day-partitioned tables: staged batches, markers and replacements that survive a stop."""

from __future__ import annotations

import json
import re
from collections.abc import Iterable

from pyspark.sql import SparkSession

from timberline.schema import DAY

#: Beside the staged files of a replacement: which files go and which come.
_PLAN = "_plan.json"
_DONE = "_done-"
#: In file names, before the name of the promoted attributes the file has as columns.
TAG = "attr_"


class Files:
    """The file system a path is on."""

    def __init__(self, spark: SparkSession, path: str):
        jvm = spark.sparkContext._jvm
        self._new = jvm.org.apache.hadoop.fs.Path
        self._io = jvm.org.apache.commons.io.IOUtils
        self._fs = self.at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def at(self, path: str):
        return self._new(path)

    def found(self, pattern: str) -> list[str]:
        return sorted(f.getPath().toString() for f in self._fs.globStatus(self.at(pattern)) or [])

    def exists(self, path: str) -> bool:
        return self._fs.exists(self.at(path))

    def move(self, source: str, target: str) -> None:
        self._fs.mkdirs(self.at(target).getParent())
        if not self._fs.rename(self.at(source), self.at(target)):
            raise OSError(f"could not move {source} to {target}")

    def delete(self, path: str) -> None:
        self._fs.delete(self.at(path), True)

    def write(self, path: str, text: str) -> None:
        """The whole text or no file of that name."""
        made = f"{path}.new"
        out = self._fs.create(self.at(made), True)
        try:
            out.write(bytearray(text.encode()))
        finally:
            out.close()
        self.delete(path)
        self.move(made, path)

    def read(self, path: str) -> str:
        source = self._fs.open(self.at(path))
        try:
            return self._io.toString(source, "UTF-8")
        finally:
            source.close()


def same_path(path: str) -> str:
    """One spelling of a path: no doubled slashes and none at the end."""
    return re.sub(r"(?<!:)/+", "/", path).rstrip("/") or "/"


def publish(spark: SparkSession, staging: str, target: str, name: str, tag: str = "") -> None:
    """Move the files of a staged batch into the table, by days where it has them.

    What the batch left there before is replaced, whatever its tag.
    """
    files = Files(spark, target)
    for old in files.found(f"{target}/{name}-*") + files.found(f"{target}/{DAY}=*/{name}-*"):
        files.delete(old)
    for part in files.found(f"{staging}/*.parquet"):
        files.move(part, f"{target}/{name}-{tag}{part.split('/')[-1]}")
    for part in files.found(f"{staging}/{DAY}=*/*.parquet"):
        folder, file = part.split("/")[-2:]
        files.move(part, f"{target}/{folder}/{name}-{tag}{file}")
    files.delete(staging)


def batch_names(spark: SparkSession, path: str) -> dict[str, set[str]]:
    """Names of the batches with files in each day folder of a table; from file names alone."""
    out: dict[str, set[str]] = {}
    for file in Files(spark, path).found(f"{path}/{DAY}=*/*.parquet"):
        folder, name = file.split("/")[-2:]
        batch = re.sub(rf"-?{TAG}[0-9a-f]+-$", "", name.rsplit("part-", 1)[0])
        out.setdefault(folder, set()).add(batch.rstrip("-"))
    return out


def mark_done(spark: SparkSession, path: str, folders: Iterable[str], name: str) -> None:
    """Leave word in day folders that a batch is complete there, also where it has no rows."""
    files = Files(spark, path)
    for folder in folders:
        files.write(f"{path}/{folder}/{_DONE}{name}", "")


def done_names(spark: SparkSession, path: str) -> dict[str, set[str]]:
    out: dict[str, set[str]] = {}
    for file in Files(spark, path).found(f"{path}/{DAY}=*/{_DONE}*"):
        folder, name = file.split("/")[-2:]
        out.setdefault(folder, set()).add(name.removeprefix(_DONE))
    return out


def replace(
    spark: SparkSession, staging: str, folder: str, old: list[str], name: str, tag: str = ""
) -> None:
    """Put the staged files of a day folder in place of ``old`` ones.

    The plan is written before anything moves. A run that stops leaves it, and
    :func:`finish_replacements` carries it out; without a plan the old files are untouched.
    """
    files = Files(spark, folder)
    staged = files.found(f"{staging}/{DAY}=*/*.parquet")
    moves = {s: f"{folder}/{name}-{tag}{s.split('/')[-1]}" for s in staged}
    files.write(f"{staging}/{_PLAN}", json.dumps({"moves": moves, "old": old}))
    _carry_out(files, staging)


def _carry_out(files: Files, staging: str) -> None:
    plan = json.loads(files.read(f"{staging}/{_PLAN}"))
    for source, target in plan["moves"].items():
        if files.exists(source):
            files.move(source, target)
        elif not files.exists(target):
            raise OSError(f"{source} is gone and {target} is not there; the old files are kept")
    for old in plan["old"]:
        files.delete(old)
    files.delete(staging)


def finish_replacements(spark: SparkSession, path: str) -> int:
    """Finish what a stopped replacement planned, discard what had no plan yet; how many there were."""
    files = Files(spark, path)
    left = files.found(f"{path}/_staging/compact-*")
    for staging in left:
        if files.exists(f"{staging}/{_PLAN}"):
            _carry_out(files, staging)
        else:
            files.delete(staging)
    return len(left)

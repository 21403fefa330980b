"""Changing the files of a table so that a crash leaves it as it was or as it should be.

New files are written under ``_staged-<id>`` inside the table, which no reader
looks at. A change is decided once ``_pending-<id>`` is there, a list of the
files that it replaces; from then on it can be carried out again and again.
``finish`` does so for what a crash left half done, and may be called by readers;
``recover`` also forgets what was not decided, which only the table's one writer
may do. While files move, a reader may see some of them old and some new, as with any table that is a folder.
"""

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import SparkSession


class Folder:
    """A table's folder through the file system that Spark uses for it."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")
        self.fs = self.at("").getFileSystem(spark._jsc.hadoopConfiguration())

    def at(self, name: str):
        return self.spark._jvm.org.apache.hadoop.fs.Path(f"{self.path}/{name}" if name else self.path)

    def exists(self, name: str = "") -> bool:
        return self.fs.exists(self.at(name))

    def names(self, name: str = "") -> list[str]:
        """What lies directly in a folder, hidden names too."""
        return sorted(s.getPath().getName() for s in self.fs.listStatus(self.at(name))) if self.exists(name) else []

    def files(self, name: str = "") -> dict[str, int]:
        """Data files below a folder with their bytes, by their path in the table."""
        if not self.exists(name):
            return {}
        root = str(self.fs.makeQualified(self.at("")).toString()).rstrip("/") + "/"
        out, found = {}, self.fs.listFiles(self.at(name), True)
        while found.hasNext():
            s = found.next()
            short = s.getPath().toString()[len(root) :]
            inside = short[len(name) :].split("/") if name else short.split("/")
            if not any(x.startswith(("_", ".")) and "=" not in x for x in inside):
                out[short] = s.getLen()
        return out

    def delete(self, name: str) -> None:
        self.fs.delete(self.at(name), True)

    def move(self, a: str, b: str) -> None:
        target = self.at(b)
        self.fs.mkdirs(target.getParent())
        try:
            moved = self.fs.rename(self.at(a), target)
        except Py4JJavaError:
            moved = False
        if not moved and (self.exists(a) or not self.exists(b)):  # else another one has carried it out
            raise OSError(f"{a} can't be moved to {b} in {self.path}")

    def write(self, name: str, lines: list[str]) -> None:
        """A small file, there as a whole or not at all."""
        out = self.fs.create(self.at(f"_new{name}"), True)
        out.write(bytearray("\n".join(lines).encode()))
        out.close()
        self.move(f"_new{name}", name)

    def read(self, name: str) -> list[str]:
        stream = self.fs.open(self.at(name))
        try:
            return [x for x in self.spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").split("\n") if x]
        finally:
            stream.close()


def staging(spark: SparkSession, path: str) -> tuple[str, str]:
    """(id of a change, folder to write its files to)."""
    change = uuid.uuid4().hex
    return change, f"{path.rstrip('/')}/_staged-{change}"


def publish(spark: SparkSession, path: str, change: str, replaced: list[str]) -> None:
    """Put the staged files of a change in place of ``replaced``, files or folders by their path in the table."""
    folder = Folder(spark, path)
    if not folder.exists(f"_staged-{change}"):
        raise OSError(f"nothing is staged for {change} in {path}")
    folder.write(f"_pending-{change}", replaced or ["."])
    _carry_out(folder, change)


def _carry_out(folder: Folder, change: str) -> None:
    staged, pending = f"_staged-{change}", f"_pending-{change}"
    new = {f: f[len(staged) + 1 :] for f in folder.files(staged)}
    for name in folder.read(pending):
        if name == ".":
            continue
        for old in [name] if "/" in name or "=" not in name else folder.files(name):
            if change not in old:  # one that was moved here before
                folder.delete(old)
    for old, name in new.items():
        head, _, tail = name.rpartition("/")
        folder.move(old, f"{head}/{change}-{tail}" if head else f"{change}-{tail}")
    folder.delete(staged)
    folder.delete(pending)


def finish(spark: SparkSession, path: str) -> int:
    """Carry out what was decided and not finished; returns how many changes that were."""
    folder, done = Folder(spark, path), 0
    for name in folder.names():
        if name.startswith("_pending-"):
            _carry_out(folder, name.removeprefix("_pending-"))
            done += 1
    return done


def recover(spark: SparkSession, path: str) -> int:
    """``finish``, and forget what was not decided. For the writer, before it begins: a change that is being staged would be lost."""
    done, folder = finish(spark, path), Folder(spark, path)
    for name in folder.names():
        if name.startswith(("_staged-", "_new_pending-")):
            folder.delete(name)
    return done

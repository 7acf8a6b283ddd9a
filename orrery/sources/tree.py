"""A directory tree on a mount as a data source: every entry, with the reason that one is passed over.

``spark.read.format("orrery_tree")`` lists a tree as :func:`files.entries`
cannot: links, irregular and vanished files are told apart, and with
``contents`` a picture is read through the handle that was judged. The
directories are dealt to tasks; the mount must be one that all executors share.
"""

from __future__ import annotations

import errno
import os
import stat
from collections.abc import Iterator
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from orrery.scratch import ship

#: Suffixes of pictures, the most bytes of a sidecar, and why an entry is passed over or a sidecar refused.
SUFFIXES = ("jpg", "jpeg", "png", "webp")
SIDECAR_BYTES = 16 * 1024
LINK, IRREGULAR, NO_PICTURE, VANISHED, UNREADABLE = "a symbolic link", "not a regular file", "not named like a picture", "it vanished during the walk", "it could not be opened"
TOO_LARGE = f"larger than the {SIDECAR_BYTES} bytes a sidecar may have"

SCHEMA = "place array<string>, path string, size_bytes long, modified timestamp, reason string"
CONTENTS = f"{SCHEMA}, content binary, sidecar binary, refusal string"
#: Files are opened without following a link, and without waiting for the other end of a pipe.
_FLAGS = os.O_RDONLY | os.O_NOFOLLOW | os.O_NONBLOCK


class Subtree(InputPartition):
    """Directories below the root, each alone or with all that is under it."""

    def __init__(self, folders: list[tuple[str, bool]]):
        super().__init__(None)
        self.folders = folders


def _why(error: OSError) -> str:
    return {errno.ELOOP: LINK, errno.ENOENT: VANISHED}.get(error.errno, UNREADABLE)


def _opened(path: str) -> tuple[int | None, str | None, os.stat_result | None]:
    """A handle of a regular file, or why there is none."""
    try:
        handle = os.open(path, _FLAGS)
    except OSError as error:
        return None, _why(error), None
    try:
        facts = os.fstat(handle)
    except OSError as error:
        os.close(handle)
        return None, _why(error), None
    if not stat.S_ISREG(facts.st_mode):
        os.close(handle)
        return None, IRREGULAR, None
    return handle, None, facts


def _read(handle: int, most: int = -1) -> bytes:
    with open(handle, "rb") as file:
        return file.read(most)


class TreeReader(DataSourceReader):
    def __init__(self, root: str, recursive: bool, contents: bool, tasks: int):
        self.root, self.recursive, self.contents, self.tasks = root, recursive, contents, tasks

    def partitions(self) -> list[Subtree]:
        """Subtrees, at least as many as tasks where the tree has so many directories; the driver lists no more than it takes."""
        if not os.path.isdir(self.root):
            raise ValueError(f"not a directory: {self.root}")
        if not self.recursive:
            return [Subtree([("", False)])]
        whole, done = [""], []
        while whole and len(whole) + len(done) < self.tasks:
            below = [os.path.join(f, name) for f in whole for name in self._folders(f)]
            done += [(f, False) for f in whole]
            whole = below
        listed = done + [(f, True) for f in whole]
        return [Subtree(listed[i :: self.tasks]) for i in range(min(self.tasks, len(listed)))]

    def _folders(self, folder: str) -> list[str]:
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                return [e.name for e in found if e.is_dir(follow_symlinks=False)]
        except OSError:
            return []  # its own row tells, where it is walked

    def read(self, partition: Subtree) -> Iterator[tuple]:
        for folder, deep in partition.folders:
            yield from self._walk(folder, deep)

    def _walk(self, folder: str, deep: bool) -> Iterator[tuple]:
        pending = [folder]
        while pending:
            at = pending.pop()
            below = yield from self._entries(at)
            if deep:
                pending += below

    def _entries(self, folder: str) -> Iterator[tuple]:
        """The rows of one directory; gives the directories in it."""
        links, folders, names = [], [], []
        try:
            with os.scandir(os.path.join(self.root, folder)) as found:
                for entry in found:
                    if entry.is_dir(follow_symlinks=False):
                        folders.append(entry.name)
                    elif entry.is_symlink() and entry.is_dir():
                        links.append(entry.name)
                    else:
                        names.append(entry.name)
        except OSError as error:
            if folder:
                yield self._row(folder, "0", "", None, _why(error))
                return []
            raise
        if self.recursive:
            for name in links:
                yield self._row(folder, "0", name, None, LINK)
        here = set(names)
        stems = {os.path.splitext(n)[0] for n in names if _suffix(n) in SUFFIXES}
        for name in names:
            stem, extension = os.path.splitext(name)
            if extension == ".json" and stem in stems:
                continue  # it belongs to a picture
            if _suffix(name) not in SUFFIXES:
                yield self._row(folder, "1", name, None, NO_PICTURE)
                continue
            handle, reason, facts = _opened(os.path.join(self.root, folder, name))
            if reason:
                yield self._row(folder, "1", name, None, reason)
                continue
            if not self.contents:
                os.close(handle)
                yield self._row(folder, "1", name, facts, None)
                continue
            said, refusal = self._sidecar(folder, f"{stem}.json") if f"{stem}.json" in here else (None, None)
            yield self._row(folder, "1", name, facts, None, _read(handle), said, refusal)
        return [os.path.join(folder, name) for name in folders] if self.recursive else []

    def _sidecar(self, folder: str, name: str) -> tuple[bytes | None, str | None]:
        handle, reason, _ = _opened(os.path.join(self.root, folder, name))
        if reason:
            return None, reason
        raw = _read(handle, SIDECAR_BYTES + 1)
        return (None, TOO_LARGE) if len(raw) > SIDECAR_BYTES else (raw, None)

    def _row(self, folder: str, kind: str, name: str, facts: os.stat_result | None, reason: str | None, *contents: object) -> tuple:
        # Sorted by place, a directory's links come first, then its files, then what is below it.
        place = [*(p for p in folder.split(os.sep) if p), f"\0{kind}{name}"]
        modified = None if facts is None else datetime.fromtimestamp(facts.st_mtime, UTC)
        row = (place, os.path.join(folder, name) if name else folder, None if facts is None else facts.st_size, modified, reason)
        return row + (tuple(contents) or (None, None, None)) if self.contents else row


def _suffix(name: str) -> str:
    return os.path.splitext(name)[1][1:].lower()


class Tree(DataSource):
    """Options: ``path``, ``recursive``, ``contents`` (both ``false``), ``tasks`` (64)."""

    @classmethod
    def name(cls) -> str:
        return "orrery_tree"

    def _is(self, option: str) -> bool:
        return str(self.options.get(option, "false")).lower() == "true"

    def schema(self) -> str:
        return CONTENTS if self._is("contents") else SCHEMA

    def reader(self, schema) -> TreeReader:
        return TreeReader(self.options["path"].removeprefix("file://"), self._is("recursive"), self._is("contents"), int(self.options.get("tasks", 64)))


def walk(spark: SparkSession, path: str, *, recursive: bool = False, contents: bool = False, tasks: int = 64) -> DataFrame:
    """The entries of a tree on a shared mount: place, path (from the root), size_bytes, modified, reason.

    A reason is null for a picture; an entry that is passed over has no size.
    With ``contents`` come a picture's ``content``, its ``sidecar`` and the
    ``refusal`` of one that cannot be read. Rows come in any order; that of
    ``place`` is the order of a walk. A sidecar beside its picture is no entry.
    Links to directories are entries of a recursive walk only; none is followed.
    """
    ship(spark)
    spark.dataSource.register(Tree)
    options = {"path": path, "recursive": str(recursive).lower(), "contents": str(contents).lower(), "tasks": tasks}
    return spark.read.format(Tree.name()).options(**options).load()


def count_entries(spark: SparkSession, path: str, *, recursive: bool = False) -> DataFrame:
    """One row: the entries that :func:`walk` lists."""
    return walk(spark, path, recursive=recursive).agg(F.count("*").alias("n"))


def ordered(entries: DataFrame) -> DataFrame:
    """Entries in the order of a walk."""
    return entries.orderBy("place")

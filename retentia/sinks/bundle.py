"""Report bundles that appear whole or not at all.

Members are written to a staging folder inside the target, whose name begins
with an underscore, so that no reader of files takes it for data.  Only when all
of them stand are the previous members moved aside and the new ones moved in;
the manifest, which names the bundle, comes last and commits it.  If a writer or
a move fails, what was moved goes back.  If the driver dies between two moves,
``recover`` (which every later ``commit`` calls first) finishes or undoes the
swap from what lies in the folder.  One driver at a time writes to a folder.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Callable, Mapping

from pyspark.sql import SparkSession

MANIFEST, STAGED, PREVIOUS = "_MANIFEST.json", "_staged-", "_previous-"


class Folder:
    """Moves and small files below one folder, on whatever file system its path names."""

    def __init__(self, spark: SparkSession, path: str):
        self._jvm = spark._jvm
        self.root = path.rstrip("/")
        self._fs = self._path("").getFileSystem(spark._jsc.hadoopConfiguration())

    def _path(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def names(self, name: str = "") -> list[str]:
        if not self.exists(name):
            return []
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name)))

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def move(self, source: str, target: str) -> None:
        if not self._fs.rename(self._path(source), self._path(target)):
            raise OSError(f"cannot move {source} to {target} in {self.root}")

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def write(self, name: str, text: str) -> None:
        out = self._fs.create(self._path(name), True)
        try:
            out.write(bytearray(text, "utf-8"))
        finally:
            out.close()

    def read(self, name: str) -> str:
        size = self._fs.getFileStatus(self._path(name)).getLen()
        data = self._fs.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(data, int(size))).decode("utf-8")
        finally:
            data.close()


def manifest(spark: SparkSession, out_dir: str) -> dict | None:
    """The committed bundle's ``{"bundle": id, "members": {name: file}}``, None if there is none."""
    folder = Folder(spark, out_dir)
    return json.loads(folder.read(MANIFEST)) if folder.exists(MANIFEST) else None


def _undo(folder: Folder, bundle: str) -> None:
    """Take the members of ``bundle`` out again and put the previous ones back; may be repeated."""
    plan = json.loads(folder.read(f"{STAGED}{bundle}/{MANIFEST}"))
    waiting, old = set(folder.names(f"{STAGED}{bundle}")), set(folder.names(f"{PREVIOUS}{bundle}"))
    for file in plan["members"].values():
        if file not in waiting and folder.exists(file):  # moved in
            folder.move(file, f"{STAGED}{bundle}/{file}")
        if file in old:
            folder.move(f"{PREVIOUS}{bundle}/{file}", file)
    if MANIFEST in old:
        folder.move(f"{PREVIOUS}{bundle}/{MANIFEST}", MANIFEST)


def recover(spark: SparkSession, out_dir: str) -> None:
    """Bring a folder whose writer died back to the last committed bundle, and clear what it left."""
    folder = Folder(spark, out_dir)
    names = folder.names()
    done = (manifest(spark, out_dir) or {}).get("bundle") if MANIFEST in names else None
    for name in names:
        if name.startswith(PREVIOUS) and name[len(PREVIOUS):] != done:
            _undo(folder, name[len(PREVIOUS):])
    for name in names:
        if name.startswith((STAGED, PREVIOUS)):
            folder.delete(name)


def commit(spark: SparkSession, out_dir: str, members: Mapping[str, tuple[str, Callable[[str], object]]]) -> dict[str, str]:
    """Write ``members`` (name -> (file, writer of a path)) as one bundle; their paths by name.

    Other files in ``out_dir`` stay.  Raises what the failing writer or move raised, after which the folder
    holds the previous bundle unchanged.
    """
    recover(spark, out_dir)
    folder, bundle = Folder(spark, out_dir), uuid.uuid4().hex
    staged, previous = f"{STAGED}{bundle}", f"{PREVIOUS}{bundle}"
    plan = {"bundle": bundle, "members": {name: file for name, (file, _) in members.items()}}
    try:
        folder.make(staged)
        for file, write in members.values():
            write(f"{folder.root}/{staged}/{file}")
        folder.write(f"{staged}/{MANIFEST}", json.dumps(plan))
    except BaseException:
        folder.delete(staged)
        raise
    try:
        folder.make(previous)
        # The old manifest goes first: while files are being moved the folder names no bundle as committed.
        for file in (MANIFEST, *plan["members"].values()):
            if folder.exists(file):
                folder.move(file, f"{previous}/{file}")
        for file in plan["members"].values():
            folder.move(f"{staged}/{file}", file)
        folder.move(f"{staged}/{MANIFEST}", MANIFEST)
    except BaseException:
        _undo(folder, bundle)
        folder.delete(previous)
        folder.delete(staged)
        raise
    folder.delete(previous)
    folder.delete(staged)
    return {name: f"{folder.root}/{file}" for name, (file, _) in members.items()}

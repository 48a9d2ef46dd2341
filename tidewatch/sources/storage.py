"""Small files on the driver's disk or, for paths with a scheme, on any of the cluster's file systems."""

from __future__ import annotations

import os
import re
import uuid
from pathlib import Path

from pyspark.sql import SparkSession


def is_uri(path: str | Path) -> bool:
    """Whether a path names its file system, as ``file:/x`` and ``hdfs://host/x`` do."""
    return re.match(r"[A-Za-z][A-Za-z0-9+.-]+:/", str(path)) is not None


class Folder:
    """A folder whose files are written whole or not at all: each under a hidden name first, then renamed."""

    def __init__(self, spark: SparkSession, path: str | Path) -> None:
        if not is_uri(path):
            path = Path(path).absolute().as_uri()
        self._jvm = spark._jvm
        self._gateway = spark.sparkContext._gateway
        self._conf = spark._jsc.hadoopConfiguration()
        self._path = self._jvm.org.apache.hadoop.fs.Path(str(path).rstrip("/") or "/")
        self._fs = self._path.getFileSystem(self._conf)

    def _of(self, name: str):
        return self._jvm.org.apache.hadoop.fs.Path(self._path, name)

    def names(self) -> list[str]:
        """The files' names in order, without hidden ones; none where there is no folder."""
        if not self._fs.exists(self._path):
            return []
        found = [s.getPath().getName() for s in self._fs.listStatus(self._path) if s.isFile()]
        return sorted(n for n in found if not n.startswith((".", "_")))

    def read(self, name: str) -> bytes:
        stream = self._fs.open(self._of(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream))
        finally:
            stream.close()

    def write(self, texts: dict[str, str]) -> None:
        """All of the files: they are staged first, and none is in its place before the last one is written."""
        turn = uuid.uuid4().hex
        staged = {name: self._of(f".{turn}-{name}") for name in texts}
        try:
            for name, text in texts.items():
                stream = self._fs.create(staged[name], True)
                try:
                    stream.write(bytearray(text.encode("utf-8")))
                finally:
                    stream.close()
            self._place(staged)
        finally:
            for path in staged.values():
                if self._fs.exists(path):
                    self._fs.delete(path, False)

    def _place(self, staged: dict) -> None:
        rename = self._jvm.org.apache.hadoop.fs.Options.Rename
        over = self._gateway.new_array(rename, 1)
        over[0] = rename.OVERWRITE
        context = self._jvm.org.apache.hadoop.fs.FileContext.getFileContext(self._fs.getUri(), self._conf)
        for name, path in staged.items():
            context.rename(self._fs.makeQualified(path), self._fs.makeQualified(self._of(name)), over)


def write_texts(spark: SparkSession, folder: str | Path, texts: dict[str, str]) -> dict[str, str]:
    """The files of a folder, staged and renamed; name: where it is."""
    if is_uri(folder):
        Folder(spark, folder).write(texts)
    else:
        _write_local(Path(folder), texts)
    return {name: f"{str(folder).rstrip('/')}/{name}" for name in texts}


def _write_local(folder: Path, texts: dict[str, str]) -> None:
    folder.mkdir(parents=True, exist_ok=True)
    staged = {name: folder / f".{uuid.uuid4().hex}-{name}" for name in texts}
    try:
        for name, text in texts.items():
            staged[name].write_text(text, encoding="utf-8")
        for name, path in staged.items():
            path.replace(folder / name)
    finally:
        for path in staged.values():
            path.unlink(missing_ok=True)


def append_line(path: Path, line: str) -> None:
    """One line at the end of a local file, in one write, so that lines of several writers stay whole."""
    path.parent.mkdir(parents=True, exist_ok=True)
    handle = os.open(path, os.O_WRONLY | os.O_APPEND | os.O_CREAT, 0o644)
    try:
        data = f"{line}\n".encode()
        if os.write(handle, data) != len(data):
            raise OSError(f"the line did not fit on {path}")
    finally:
        os.close(handle)

"""A folder of files that tasks write side by side and that appears, or is replaced, at once.

Each task writes a file of its own into a staging folder. On commit the files move into the folder and the list `_current` is replaced in one
rename: readers see the old list or the new one. An aborted write removes its staging folder and leaves the list as it was; files
of tasks that ran twice are in no list and go with the staging folder. The folder must be one that the driver and all executors share.
"""

from __future__ import annotations

import json
import os
import shutil
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

LIST = "_current"


def local(path: str) -> str:
    """The path of a shared folder as the operating system has it."""
    for prefix in ("file://", "file:"):
        if path.startswith(prefix):
            return path.removeprefix(prefix)
    if "://" in path:
        raise ValueError(f"{path}: a folder that driver and executors have mounted is needed")
    return path


def listed(path: str, suffixes: tuple[str, ...]) -> list[str]:
    """The files of a path: itself, those of its list, or, for other folders, all below it with one of the suffixes, in order of name."""
    path = local(path)
    if os.path.isfile(path):
        return [path]
    if os.path.exists(f"{path}/{LIST}"):
        with open(f"{path}/{LIST}") as f:
            return [f"{path}/{name}" for name in json.load(f)]
    if not os.path.isdir(path):
        raise FileNotFoundError(path)
    return sorted(f"{d}/{n}" for d, _, names in os.walk(path) for n in names if n.lower().endswith(suffixes) and not n.startswith((".", "~", "_")))


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class PartsWriter(DataSourceArrowWriter):
    suffix = ""

    def __init__(self, path: str, overwrite: bool) -> None:
        self.path, self.overwrite, self.job = local(path), overwrite, uuid.uuid4().hex
        self.staging = f"{self.path}/.staging-{self.job}"

    def fill(self, file: str, batches: Iterable[pa.RecordBatch]) -> None:
        raise NotImplementedError

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        first = next((b for b in iterator if b.num_rows), None)
        if first is None:
            return Written(None)
        os.makedirs(self.staging, exist_ok=True)
        name = f"part-{uuid.uuid4().hex}{self.suffix}"

        def batches() -> Iterator[pa.RecordBatch]:
            yield first
            yield from iterator

        self.fill(f"{self.staging}/{name}", batches())
        return Written(name)

    def blank(self) -> str | None:
        """Called where no task had rows: may stage one file without rows and name it."""
        return None

    def commit(self, messages: list[Written | None]) -> None:
        names = sorted(m.name for m in messages if m and m.name)
        os.makedirs(self.staging, exist_ok=True)
        if not names and (self.overwrite or not os.path.exists(f"{self.path}/{LIST}")):
            names = [n for n in [self.blank()] if n]
        for name in names:
            os.replace(f"{self.staging}/{name}", f"{self.path}/{name}")
        before = []
        if os.path.exists(f"{self.path}/{LIST}"):
            with open(f"{self.path}/{LIST}") as f:
                before = json.load(f)
        with open(f"{self.staging}/{LIST}", "w") as f:
            json.dump(names if self.overwrite else before + names, f)
        os.replace(f"{self.staging}/{LIST}", f"{self.path}/{LIST}")
        if self.overwrite:
            for name in before:
                os.remove(f"{self.path}/{name}")
        shutil.rmtree(self.staging)

    def abort(self, messages: list[Written | None]) -> None:
        shutil.rmtree(self.staging, ignore_errors=True)

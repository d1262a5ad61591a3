"""Files that tasks read in ranges and write under a commit: any store that Arrow's file systems know.

A writing job has a staging folder beside its files. Tasks write whole files there under names of
their own; the commit moves the files of the tasks that counted and marks the folder with
``_SUCCESS``, an abort removes the staging folder. So a task that fails, or that runs twice, leaves nothing.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.sql.datasource import DataSourceArrowWriter, WriterCommitMessage

STAGING, MARK = "_staging", "_SUCCESS"


def store_of(path: str):
    """(file system, path in it) of a URI, or of a path of the machine or a mounted share."""
    from pyarrow import fs

    if "://" in path or path.startswith("file:"):
        return fs.FileSystem.from_uri(path)
    return fs.LocalFileSystem(), path


def listed(path: str, glob: str | None = None) -> list[tuple[str, int]]:
    """(path, bytes) of a file, or of the files below a folder, in order; hidden names are passed over."""
    from fnmatch import fnmatch

    from pyarrow import fs

    store, base = store_of(path)
    info = store.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    if info.type == fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = store.get_file_info(fs.FileSelector(base, recursive=True))
    inner = lambda f: posixpath.relpath(f.path, base).split("/")
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and not any(p[0] in "._" for p in inner(f)) and (glob is None or fnmatch(f.base_name, glob)))


@dataclass
class Written(WriterCommitMessage):
    """The files that a task wrote: (name in staging, final name), both relative, and how many rows they hold."""

    files: list[tuple[str, str]] = field(default_factory=list)
    rows: int = 0


class StagedWriter(DataSourceArrowWriter):
    """Writes files of a format. ``parts(batches, task)`` of a subclass gives (final name, bytes, rows) of each file."""

    def __init__(self, path: str, overwrite: bool, job: str | None = None):
        self.path, self.overwrite, self.job = path.rstrip("/"), overwrite, job or uuid.uuid4().hex
        store_of(self.path)[0].create_dir(self.staging, recursive=True)  # in the driver: a task can't bring it back after an abort

    def parts(self, batches: Iterator, task: int) -> Iterator[tuple[str, bytes, int]]:
        raise NotImplementedError

    @property
    def staging(self) -> str:
        return f"{store_of(self.path)[1]}/{STAGING}/{self.job}"

    def write(self, iterator: Iterator) -> Written:
        from pyspark import TaskContext

        store, _ = store_of(self.path)
        context = TaskContext.get()
        attempt = f"{context.partitionId():05d}-{context.taskAttemptId()}"
        out = Written()
        store.create_dir(f"{self.staging}/{attempt}", recursive=False)
        for k, (name, data, rows) in enumerate(self.parts(iterator, context.partitionId())):
            if name.startswith("/") or ".." in name.split("/") or "\0" in name:
                raise ValueError(f"unsafe file name {name!r}")
            staged = f"{attempt}/{k:06d}"
            with store.open_output_stream(f"{self.staging}/{staged}") as f:
                f.write(data)
            out.files.append((staged, name))
            out.rows += rows
        return out

    def commit(self, messages: list[Written | None]) -> None:
        from pyarrow import fs

        store, base = store_of(self.path)
        files = [f for m in messages if m is not None for f in m.files]
        names = [n for _, n in files]
        if len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError("two rows have the same file name")
        if self.overwrite:
            for f in store.get_file_info(fs.FileSelector(base, allow_not_found=True)):
                if f.base_name != STAGING:
                    (store.delete_file if f.type == fs.FileType.File else store.delete_dir)(f.path)
        else:
            taken = {f.path for f in store.get_file_info([f"{base}/{n}" for n in names]) if f.type != fs.FileType.NotFound}
            if taken:
                self.abort(messages)
                raise FileExistsError(sorted(taken)[0])
        for folder in sorted({posixpath.dirname(f"{base}/{n}") for n in names} | {base}):
            store.create_dir(folder, recursive=True)
        for staged, name in files:
            store.move(f"{self.staging}/{staged}", f"{base}/{name}")
        self._clear(store, base)
        with store.open_output_stream(f"{base}/{MARK}") as f:
            f.write(b"")

    def abort(self, messages: list[Written | None]) -> None:
        store, base = store_of(self.path)
        self._clear(store, base)

    def _clear(self, store, base: str) -> None:
        from pyarrow import fs

        if store.get_file_info(self.staging).type == fs.FileType.Directory:
            store.delete_dir(self.staging)
        rest = fs.FileSelector(f"{base}/{STAGING}", allow_not_found=True)
        if store.get_file_info(f"{base}/{STAGING}").type == fs.FileType.Directory and not store.get_file_info(rest):
            store.delete_dir(f"{base}/{STAGING}")

"""A Spark data source for trees of HTML files, ``format("html_tree")``.

Reading plans its partitions from a listing that stops at the depth, so no
directory below it is ever listed, and reads bytes: a file that is not UTF-8 is
marked, not a reason to fail.  Writing puts one file per row at its relative
path with a commit protocol: tasks write into a staging folder of their own
below the target, the driver moves complete tasks' files into place when all
tasks are done, and a failed job removes its staging folder and leaves nothing.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

FORMAT = "html_tree"
MAX_DEPTH = 5
#: A partition takes files of so many bytes together, and so many at most.
PARTITION_BYTES, PARTITION_FILES = 32 << 20, 10_000
SUFFIXES = (".html", ".htm")


def file_system(uri: str) -> tuple[pafs.FileSystem, str]:
    """The file system and plain path of a URI or a local path."""
    if uri.startswith("file:") and "://" not in uri:
        uri = "file://" + uri[len("file:") :]
    if "://" in uri:
        return pafs.FileSystem.from_uri(uri)
    return pafs.LocalFileSystem(), uri


def listed(root: str, max_depth: int, entries: Callable[[str], list]) -> Iterator[tuple[str, int]]:
    """(relative path, size) of the HTML files at most ``max_depth`` names below ``root``, in order.

    ``entries`` lists one directory.  A directory whose files would lie deeper
    is not listed.
    """
    level, depth = [root], 1
    while level and depth <= max_depth:
        below = []
        for directory in level:
            for e in sorted(entries(directory), key=lambda e: e.path):
                if e.type == pafs.FileType.Directory:
                    below.append(e.path)
                elif e.type == pafs.FileType.File and e.path.endswith(SUFFIXES):
                    yield posixpath.relpath(e.path, root), e.size or 0
        level, depth = below, depth + 1


@dataclass
class Files(InputPartition):
    paths: list[str]


class HtmlTreeReader(DataSourceReader):
    def __init__(self, root: str, max_depth: int):
        self.root, self.max_depth = root, max_depth

    def partitions(self) -> list[Files]:
        fs, root = file_system(self.root)
        entries = lambda d: fs.get_file_info(pafs.FileSelector(d))
        out, held, size = [], [], 0
        for path, n in listed(root.rstrip("/"), self.max_depth, entries):
            if held and (size + n > PARTITION_BYTES or len(held) >= PARTITION_FILES):
                out.append(Files(held))
                held, size = [], 0
            held.append(path)
            size += n
        return [*out, Files(held)]

    def read(self, partition: Files) -> Iterator[tuple[str, str, bool]]:
        fs, root = file_system(self.root)
        for path in partition.paths:
            with fs.open_input_stream(f"{root.rstrip('/')}/{path}") as f:
                data = f.read()
            try:
                yield path, data.decode("utf-8"), True
            except UnicodeDecodeError:
                yield path, data.decode("utf-8", "replace"), False


@dataclass
class Staged(WriterCommitMessage):
    folder: str


def checked_path(path: str | None) -> str:
    """A path that stays below the target."""
    if not path or path.startswith("/") or any(p in ("", ".", "..") for p in path.split("/")):
        raise ValueError(f"not a relative file path: {path!r}")
    return path


class HtmlTreeWriter(DataSourceWriter):
    def __init__(self, target: str, columns: list[str], overwrite: bool):
        self.target, self.overwrite = target.rstrip("/"), overwrite
        self.staging = f"_staging-{uuid.uuid4().hex[:12]}"
        self.path_at, self.html_at = columns.index("path"), columns.index("html")
        fs, root = file_system(self.target)
        fs.create_dir(f"{root}/{self.staging}", recursive=True)  # there as long as the job goes on

    def write(self, rows: Iterator) -> Staged:
        fs, target = file_system(self.target)
        task = TaskContext.get()
        folder = f"{self.staging}/{task.partitionId():06d}-{task.taskAttemptId()}"
        made: set[str] = set()
        for row in rows:
            path = f"{target}/{folder}/{checked_path(row[self.path_at])}"
            parent = posixpath.dirname(path)
            if parent not in made:
                # a task that outlives its job must not bring the folder back
                if fs.get_file_info(f"{target}/{self.staging}").type != pafs.FileType.Directory:
                    raise RuntimeError("the job was aborted")
                fs.create_dir(parent, recursive=True)
                made.add(parent)
            with fs.open_output_stream(path) as out:
                out.write((row[self.html_at] or "").encode("utf-8"))
        return Staged(folder)

    def commit(self, messages: list) -> None:
        """Move the files of each complete task; of two tasks with one path the later partition's stays."""
        fs, target = file_system(self.target)
        if self.overwrite and fs.get_file_info(target).type == pafs.FileType.Directory:
            for e in fs.get_file_info(pafs.FileSelector(target)):
                if e.base_name != self.staging:
                    (fs.delete_dir if e.type == pafs.FileType.Directory else fs.delete_file)(e.path)
        made: set[str] = set()
        for folder in sorted(m.folder for m in messages if m is not None):
            staged = f"{target}/{folder}"
            for e in fs.get_file_info(pafs.FileSelector(staged, recursive=True, allow_not_found=True)):
                if e.type == pafs.FileType.File:
                    path = f"{target}/{posixpath.relpath(e.path, staged)}"
                    if posixpath.dirname(path) not in made:
                        fs.create_dir(posixpath.dirname(path), recursive=True)
                        made.add(posixpath.dirname(path))
                    fs.move(e.path, path)
        self._clean(fs, target)

    def abort(self, messages: list) -> None:
        self._clean(*file_system(self.target))

    def _clean(self, fs: pafs.FileSystem, target: str) -> None:
        if fs.get_file_info(f"{target}/{self.staging}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{target}/{self.staging}")


class HtmlTree(DataSource):
    """``path`` names the tree; ``max_depth`` bounds how deep it is read."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return "path string, html string, is_valid_utf8 boolean"

    def reader(self, schema: StructType) -> HtmlTreeReader:
        return HtmlTreeReader(self.options["path"], int(self.options.get("max_depth", MAX_DEPTH)))

    def writer(self, schema: StructType, overwrite: bool) -> HtmlTreeWriter:
        return HtmlTreeWriter(self.options["path"], schema.fieldNames(), overwrite)


def read_tree(spark: SparkSession, root: str, max_depth: int = MAX_DEPTH) -> DataFrame:
    """``path, html, is_valid_utf8`` of every HTML file at most ``max_depth`` names below ``root``."""
    spark.dataSource.register(HtmlTree)
    return spark.read.format(FORMAT).option("max_depth", max_depth).load(root)


def file_path(url: Column) -> Column:
    """Where a page's file belongs: its path below the root for a scanned file, else host and URL path.

    A path that ends in ``/`` gets ``index.html``, one without an HTML suffix
    ``.html``; a query or fragment adds its hash, so that URLs do not meet.
    """
    host, path = F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#]*)", 1), F.regexp_extract(url, "^[a-zA-Z][a-zA-Z0-9+.-]*://[^/?#]*/([^?#]*)", 1)
    rest = F.regexp_extract(url, "[?#].*$", 0)
    name = F.when(path.rlike("(^|/)$"), F.concat(path, F.lit("index.html"))).otherwise(path)
    name = F.when(name.rlike(r"\.html?$"), name).otherwise(F.concat(name, F.lit(".html")))
    name = F.when(rest != "", F.concat(F.regexp_replace(name, r"\.html?$", "-"), F.hex(F.xxhash64(rest)), F.lit(".html"))).otherwise(name)
    clean = F.regexp_replace(F.regexp_replace(name, "/{2,}", "/"), r"(^|/)\.{1,2}(?=/)", "$1_")
    return F.when(F.startswith(url, F.lit("file:")), path).otherwise(F.concat_ws("/", host, clean))


def write_tree(pages: DataFrame, target: str, mode: str = "overwrite") -> None:
    """One file per row of ``pages(path, html)`` below ``target``."""
    pages.sparkSession.dataSource.register(HtmlTree)
    pages.select("path", "html").write.format(FORMAT).mode(mode).save(target)

"""Trees of files: listed, read and written by tasks that take directories and files, never whole repositories."""

from __future__ import annotations

import os
from collections import deque
from collections.abc import Iterable, Iterator
from itertools import batched

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from auditloom.operators import fixed_values as V
from auditloom.session import materialize

#: Directories below a frontier directory that its task lists itself before it hands on the rest.
DIRS_PER_ROW = 64
#: Bytes of text that a task hands on at once, but for a longer single file.
READ_PORTION_BYTES = 32 * 1024 * 1024
#: Bytes of files that one task reads.
TASK_BYTES = 256 * 1024 * 1024
#: A row holds one text, and Spark's texts end here.
MOST_BYTES = (1 << 31) - 64
ROWS = 10_000

LISTING = pa.schema([("dir", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("error", pa.string())])
FILES = pa.schema([("repo_id", pa.string()), ("path", pa.string()), ("length", pa.int64()), ("content", pa.string())])


def open_root(root: str) -> tuple[pafs.FileSystem, str]:
    """The file system of a path or URI, and the root's path in it."""
    if "://" in root:
        filesystem, base = pafs.FileSystem.from_uri(root)
    else:
        filesystem, base = pafs.LocalFileSystem(), os.path.abspath(root.removeprefix("file:"))
    return filesystem, base.rstrip("/")


def hidden(name: str) -> bool:
    return name.startswith((".", "_"))


def _entered(path: str, prune: frozenset[str]) -> bool:
    """Whether a directory is looked into: hidden ones are not where they are, or lie in, a default ignored one."""
    parts = path.split("/")
    if parts[-1] in prune:
        return False
    return not (hidden(parts[-1]) and any(p in V.DEFAULT_IGNORED for p in parts))


def _kept(path: str) -> bool:
    """Hidden files of default ignored directories are left out, other files of any directory are not."""
    parts = path.split("/")
    return not (any(map(hidden, parts)) and any(p in V.DEFAULT_IGNORED for p in parts[:-1]))


def walk(filesystem: pafs.FileSystem, base: str, start: str, prune: frozenset[str], budget: int) -> Iterator[tuple[str | None, str | None, int | None, str | None]]:
    """(dir, path, length, error) of files below ``start``; directories beyond ``budget`` come back as dir alone, unlisted.

    Links to directories are not followed, so a walk ends. A directory that cannot be
    listed gives its path and the error.
    """
    local = isinstance(filesystem, pafs.LocalFileSystem)
    pending = deque([start])
    while pending:
        here = pending.popleft()
        if budget <= 0:
            yield here, None, None, None
            continue
        budget -= 1
        try:
            entries = filesystem.get_file_info(pafs.FileSelector(f"{base}/{here}".rstrip("/")))
        except OSError as error:
            yield None, here, None, str(error)
            continue
        for info in entries:
            path = f"{here}/{info.base_name}".lstrip("/")
            if info.type == pafs.FileType.Directory:
                if _entered(path, prune) and not (local and os.path.islink(info.path)):
                    pending.append(path)
            elif info.type == pafs.FileType.File and here and _kept(path):
                yield None, path, info.size, None


def list_tree(spark: SparkSession, root: str, prune: Iterable[str] = (), dirs_per_row: int = DIRS_PER_ROW) -> DataFrame:
    """(repo_id, path, length, error): every file below ``root/<repo_id>/``, without its content.

    The frontier is a table of directories. A task lists the directories dealt to it and
    some below each; what it does not reach is the next frontier, dealt anew, so a large
    repository spreads over all tasks and the driver never sees a name. Rounds grow with
    the depth of the tree and shrink with ``dirs_per_row``. Directories named in ``prune``
    are never entered. ``error`` is set for a directory that cannot be listed.
    """
    filesystem, base = open_root(root)
    if filesystem.get_file_info(base).type != pafs.FileType.Directory:
        raise FileNotFoundError(f"no such directory: {root}")
    pruned = frozenset(prune)
    parts = spark.sparkContext.defaultParallelism

    def listing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for start in batch.column("dir").to_pylist():
                for rows in batched(walk(filesystem, base, start, pruned, dirs_per_row), ROWS):
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), LISTING, strict=True)], schema=LISTING)

    frontier, found = spark.createDataFrame([("",)], "dir string"), []
    while True:
        listed = materialize(frontier.repartition(parts, "dir").mapInArrow(listing, "dir string, path string, length long, error string"))
        found.append(listed.where("path is not null"))
        frontier = listed.where("dir is not null").select("dir")
        if frontier.isEmpty():
            break
    every = found[0]
    for more in found[1:]:
        every = every.unionByName(more)
    repo = F.substring_index("path", "/", 1)
    return every.select(repo.alias("repo_id"), F.substring("path", F.length(repo) + 2, F.length("path")).alias("path"), "length", "error")


def read_listed(listed: DataFrame, root: str) -> DataFrame:
    """(repo_id, path, length, content) of the listed files; what cannot be read any more is left out.

    Files are dealt by their names over as many tasks as their bytes need. Bytes that are
    no UTF-8 become replacement characters. Files beyond ``MOST_BYTES`` fit no row and are left out, see :func:`unread`.
    """
    filesystem, base = open_root(root)
    wanted = listed.where(F.col("error").isNull() & (F.col("length") <= MOST_BYTES)).select("repo_id", "path", "length")
    total = wanted.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    parts = max(listed.sparkSession.sparkContext.defaultParallelism, -(-total // TASK_BYTES))

    def text(repo_id: str, path: str) -> str | None:
        try:
            with filesystem.open_input_stream(f"{base}/{repo_id}/{path}") as f:
                return f.read().decode("utf-8", errors="replace")
        except OSError:
            return None

    def reading(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[tuple] = []
            size = 0
            for repo_id, path, length in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and size + length > READ_PORTION_BYTES:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FILES, strict=True)], schema=FILES)
                    rows, size = [], 0
                content = text(repo_id, path)
                if content is not None:
                    rows.append((repo_id, path, length, content))
                    size += length
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), FILES, strict=True)], schema=FILES)

    dealt = wanted.repartition(parts, "repo_id", "path")
    return dealt.mapInArrow(reading, "repo_id string, path string, length long, content string")


def unread(listed: DataFrame) -> DataFrame:
    """(repo_id, path, reason) of directories that could not be listed and files too long for a row."""
    too_long = F.when(F.col("length") > MOST_BYTES, F.lit("longer than a text may be"))
    return listed.select("repo_id", "path", F.coalesce("error", too_long).alias("reason")).where("reason is not null")


def write_tree(files: DataFrame, root: str) -> None:
    """Writes a files table as ``root/<repo_id>/<path>``, each file by the task that holds its row.

    Rows must name each (repo_id, path) once; null contents are written empty. Paths that
    would leave their repository are refused before anything of their task is written.
    """
    filesystem, base = open_root(root)

    def writing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names = [f"{r}/{p}" for r, p in zip(batch.column("repo_id").to_pylist(), batch.column("path").to_pylist(), strict=True)]
            outside = [n for n in names if n.startswith("/") or ".." in n.split("/")]
            if outside:
                raise ValueError(f"paths leave their repository: {outside[:3]}")
            for folder in {n.rpartition("/")[0] for n in names}:
                filesystem.create_dir(f"{base}/{folder}", recursive=True)
            for name, content in zip(names, batch.column("content"), strict=True):
                with filesystem.open_output_stream(f"{base}/{name}") as f:
                    f.write((content.as_py() or "").encode())
            yield pa.RecordBatch.from_arrays([pa.array([len(names)], pa.int64())], ["n"])

    written = files.select("repo_id", "path", "content").mapInArrow(writing, "n long")
    written.agg(F.sum("n")).collect()

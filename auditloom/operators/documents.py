"""One document a repository, of any size, as ordered pieces of text.

A document is a layout: fixed text, objects of one row a repository, and lists of entries
of any number. Every piece carries its place, so pieces are made by as many tasks as there is
work, and whoever writes a document reads its pieces in order and holds one at a time.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from urllib.parse import quote

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from auditloom.functions.text import strip_ansi
from auditloom.sources.tree import open_root

#: Place of a piece: position in the layout, key of the entry, then parts of the entry and their items.
ORDER = ["repo_id", "position", "key", "sub", "item"]
PIECES = [*ORDER, "section", "entry", "text"]


def clean(df: DataFrame) -> DataFrame:
    """Strip terminal colour codes from every text column."""
    text = {n: strip_ansi(F.col(n)) for n, t in df.dtypes if t == "string"}
    return df.withColumns(text) if text else df


def object_json(df: DataFrame, *leave_out: str) -> Column:
    return F.to_json(F.struct(*[c for c in df.columns if c not in ("repo_id", *leave_out)]))


def one(df: DataFrame) -> DataFrame:
    """(repo_id, entry): the row of each repository as a JSON object."""
    df = clean(df)
    return df.select("repo_id", object_json(df).alias("entry"))


def entries(df: DataFrame, section: str, key: Column) -> DataFrame:
    """A JSON object for each row, as list entries in the order of ``key``, which is unique within a repository."""
    df = clean(df).withColumn("__key", key)
    whole = object_json(df, "__key")
    return df.select(
        "repo_id", F.col("__key").alias("key"), F.lit(0).alias("sub"), F.lit("").alias("item"), F.lit(section).alias("section"),
        whole.alias("entry"), whole.alias("text"),
    )


def _listed(rows: DataFrame, position: int) -> DataFrame:
    """Entries with a comma in front of all but a repository's first."""
    least = rows.groupBy("repo_id").agg(F.min("key").alias("least"))
    comma = F.when((F.col("sub") == 0) & (F.col("key") > F.col("least")), F.lit(",")).otherwise(F.lit(""))
    return rows.join(least, "repo_id").withColumns({"text": F.concat(comma, "text"), "position": F.lit(position)}).select(*PIECES)


def pieces(repos: DataFrame, layout: Sequence[str | tuple[str, DataFrame] | DataFrame]) -> DataFrame:
    """The pieces of one document for each of ``repos``.

    The layout holds fixed texts, (section, frame from :func:`one`) for objects, null
    where a repository has none, and frames from :func:`entries` for lists.
    """
    fixed = [F.struct(F.lit(i).alias("position"), F.lit(part).alias("text")) for i, part in enumerate(layout) if isinstance(part, str)]
    nothing = {c: F.lit("") for c in ("key", "item", "section")} | {"sub": F.lit(0), "entry": F.lit(None).cast("string")}
    out = repos.select("repo_id", F.explode(F.array(*fixed)).alias("f")).select("repo_id", "f.*").withColumns(nothing).select(*PIECES)
    for position, part in enumerate(layout):
        if isinstance(part, tuple):
            section, rows = part
            single = repos.join(rows, "repo_id", "left").withColumns(
                {**{c: nothing[c] for c in ("key", "item", "sub")}, "section": F.lit(section), "position": F.lit(position), "text": F.coalesce("entry", F.lit("null"))}
            )
            out = out.unionByName(single.select(*PIECES))
        elif isinstance(part, DataFrame):
            out = out.unionByName(_listed(part, position))
    return out


def flat(document: DataFrame) -> DataFrame:
    """(repo_id, section, key, item, field, value): every field of every object in the pieces, fields without a value left out."""
    fields = F.explode(F.from_json("entry", "map<string,string>")).alias("field", "value")
    return document.where("entry is not null").select("repo_id", "section", "key", "item", fields).where("value is not null")


def write_documents(document: DataFrame, folder: str, suffix: str = ".json") -> DataFrame:
    """Writes each repository's pieces as ``folder/<repo_id><suffix>`` and returns (repo_id, file, bytes).

    Spark sorts the pieces; the task that has a repository passes them on to its file one by
    one. A file takes its name when it is complete, so a lost task leaves no half document.
    """
    filesystem, base = open_root(folder)
    filesystem.create_dir(base, recursive=True)

    def writing(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        attempt, here, out, size = TaskContext.get().taskAttemptId(), None, None, 0
        done: list[tuple[str, str, int]] = []

        def close() -> None:
            out.close()
            file = f"{quote(here, safe=' ')}{suffix}"
            filesystem.move(f"{base}/.{attempt}.part", f"{base}/{file}")
            done.append((here, file, size))

        for batch in batches:
            for repo_id, text in zip(batch.column("repo_id").to_pylist(), batch.column("text"), strict=True):
                if repo_id != here:
                    if out:
                        close()
                    here, size = repo_id, 0
                    out = filesystem.open_output_stream(f"{base}/.{attempt}.part")
                size += out.write((text.as_py() or "").encode())
            yield _written(done)
            done = []
        if out:
            close()
        yield _written(done)

    ordered = document.select(*ORDER, "text").repartition("repo_id").sortWithinPartitions(*ORDER).select("repo_id", "text")
    rows = ordered.mapInArrow(writing, "repo_id string, file string, bytes long").collect()
    return document.sparkSession.createDataFrame(rows, "repo_id string, file string, bytes long")


def _written(rows: list[tuple[str, str, int]]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else ([], [], [])
    kinds = (pa.string(), pa.string(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["repo_id", "file", "bytes"])

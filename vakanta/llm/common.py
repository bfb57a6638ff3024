"""Helpers shared by the corpus operators."""

from __future__ import annotations

import sys
import tempfile
import uuid
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

LEAST_LONG = -(2**63)
SLICE_ROWS = 512


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors share: ``spark.checkpoint.dir``. Local sessions without the setting get one of their own."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(tempfile.mkdtemp(prefix="vakanta-shared-"))
    return context.getCheckpointDir().rstrip("/")


def fresh_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def checkpointed(df: DataFrame) -> DataFrame:
    """Write ``df`` once to the shared folder and go on from there."""
    context = df.sparkSession.sparkContext
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint(eager=True)


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write ``df`` once as Parquet in the shared folder, smaller than a checkpoint, and go on from there."""
    path = fresh_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def kept_in_worker(name: str, version: str, make: Callable):
    """An object that a Python worker makes once and keeps for its later tasks, until another version is asked for.

    It hangs on the interpreter, since modules shipped by value do not outlive a task.
    """
    held = sys.__dict__.setdefault("_vakanta_llm", {})
    if name not in held or held[name][0] != version:
        held.pop(name, None)
        held[name] = (version, make())
    return held[name][1]


def forget_kept() -> None:
    """For tasks that keep nothing: let go of what an earlier stage has left in their worker."""
    sys.__dict__.pop("_vakanta_llm", None)


def slices(batches: Iterator[pa.RecordBatch], rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """The batches in short runs, so that what is made of one stays small."""
    for batch in batches:
        for start in range(0, batch.num_rows, rows):
            yield batch.slice(start, rows)


def plain_text(name: str = "text") -> Column:
    """The text, the empty one for null."""
    return F.coalesce(F.col(name).cast("string"), F.lit(""))


def sort_key(name: str) -> Column:
    """An integer key for ordering; null counts as the smallest."""
    return F.coalesce(F.col(name).cast("long"), F.lit(LEAST_LONG))


def free_name(df: DataFrame, name: str) -> str:
    """``name``, made longer until the table has no such column."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def split_points(df: DataFrame, key: str, parts: int) -> list[int]:
    """At most ``parts - 1`` ascending values of an integer column that cut the rows into nearly equal parts."""
    if parts < 2:
        return []
    found = df.select(key).approxQuantile(key, [i / parts for i in range(1, parts)], 1 / (4 * parts))
    return sorted({int(x) for x in found})


def part_of(key: Column, points: list[int]) -> Column:
    """How many of the points are not above the key: 0 to ``len(points)``; searched in two steps of about the root of that."""
    if not points:
        return F.lit(0)
    step = max(1, int(len(points) ** 0.5))
    heads = F.lit(points[::step])
    groups = F.array(*[F.lit(points[i : i + step]) for i in range(0, len(points), step)])
    group = F.size(F.filter(heads, lambda p: p <= key))
    inside = F.size(F.filter(F.element_at(groups, F.greatest(group, F.lit(1))), lambda p: p <= key))
    return F.when(group == 0, F.lit(0)).otherwise((group - 1) * step + inside)


def file_system(folder: str):
    """The file system that a folder's address names, and the path in it."""
    from pyarrow import fs

    if folder.startswith("file:"):
        return fs.LocalFileSystem(), "/" + folder.removeprefix("file:").lstrip("/")
    return fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)


def publish(folder: str, name: str, chunks) -> None:
    """Write a file under a name of this attempt, then rename, so that a file of the final name is always whole.

    Attempts write the same bytes; where the store does not replace files, the first one stays.
    """
    from pyarrow import fs

    files, root = file_system(folder)
    own, final = f"{root}/.{name}.{uuid.uuid4().hex}", f"{root}/{name}"
    with files.open_output_stream(own, compression=None) as out:
        for chunk in chunks:
            out.write(chunk)
    try:
        files.move(own, final)
    except OSError:
        if files.get_file_info(final).type == fs.FileType.NotFound:
            raise
        files.delete_file(own)

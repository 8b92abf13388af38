"""What the operators share: the cluster's shared folder, written tables, blobs and packed text."""

from __future__ import annotations

import atexit
import contextlib
import ctypes
import gc
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import urlparse

import numpy as np
from pyspark.sql import DataFrame, SparkSession

_OWN: list[str] = []


def shared_root(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir, else the one given to setCheckpointDir. Only a session that runs in this
    very process may name none: it gets a local one. On a cluster that is an error, as executors share no local folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        given = spark.sparkContext._jsc.sc().getCheckpointDir()
        root = given.get() if given.isDefined() else None
    if not root:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise RuntimeError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        root = tempfile.mkdtemp(prefix="lodestrand-")
        spark.sparkContext.setCheckpointDir(root)
        spark.conf.set("spark.checkpoint.dir", root)
    return root.rstrip("/")


def work_dir(spark: SparkSession, tag: str) -> str:
    path = f"{shared_root(spark)}/lodestrand/{tag}-{uuid.uuid4().hex}"
    _OWN.append(path)
    return path


def _delete(uri: str) -> None:
    with contextlib.suppress(Exception):  # leftovers never matter
        fs, path = file_system(uri)
        fs.delete_dir(path)


@atexit.register
def _clear() -> None:
    """Drop what this driver wrote in the shared folder once it ends."""
    for uri in _OWN:
        _delete(uri)


def materialize(df: DataFrame, tag: str, replaces: tuple[DataFrame, ...] | list[DataFrame] = ()) -> DataFrame:
    """Write df as Parquet in the shared folder and read it again: cuts lineage and survives lost executors. Tables
    written here before that nothing else reads from now on (``replaces``) are deleted once this one is complete."""
    path = work_dir(df.sparkSession, tag)
    df.write.mode("overwrite").parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._written = path
    forget(*replaces)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete written tables that nothing reads any more; other DataFrames are left alone."""
    for table in tables:
        if (path := getattr(table, "_written", None)) in _OWN:
            _OWN.remove(path)
            _delete(path)


def file_system(uri: str):
    """(pyarrow file system, path) of a URI, for drivers and executors alike."""
    from pyarrow import fs

    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), parts.path
    return fs.FileSystem.from_uri(uri)


def write_blob(uri: str, *pieces) -> None:
    """Write a file whole or not at all, so that a task that runs again replaces it by an equal one."""
    fs, path = file_system(uri)
    fs.create_dir(os.path.dirname(path), recursive=True)
    with fs.open_output_stream(temp := f"{path}.{uuid.uuid4().hex}") as out:
        for piece in pieces:
            out.write(piece)
    try:
        fs.move(temp, path)
    except OSError:  # stores that refuse to replace
        fs.delete_file(path)
        fs.move(temp, path)


def read_range(uri: str, offset: int = 0, length: int | None = None) -> bytes:
    fs, path = file_system(uri)
    with fs.open_input_file(path) as f:
        return f.read_at(f.size() - offset if length is None else length, offset)


def utf8_column(column) -> tuple[np.ndarray, np.ndarray]:
    """(bytes of all values, offsets with one more entry than rows) of an Arrow string column; null is empty."""
    import pyarrow as pa
    import pyarrow.compute as pc

    column = pc.fill_null(column.cast(pa.large_string()), "")
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    _, at, data = column.buffers()
    at = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1] if at else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8) if data else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


_KEPT: dict[str, Callable[[], None]] = {}


def keeps(owner: str, drop: Callable[[], None]) -> None:
    """Say how to drop what an operator keeps between the tasks of a worker process."""
    _KEPT[owner] = drop


def _libc():
    with contextlib.suppress(OSError, AttributeError):
        return ctypes.CDLL("libc.so.6")
    return None


def lean(run: Callable[[Iterator], Iterator], owner: str = "", large: int = 1, spare: int = 1) -> Callable[[Iterator], Iterator]:
    """run for mapInArrow, in a worker process that lives on between stages: what other operators kept there goes first,
    arrays of over ``large`` MB are taken from the system one by one, at most ``spare`` MB are held back, and what is free
    at the end is given back. Larger numbers are faster and cost memory."""

    def wrapped(batches: Iterator) -> Iterator:
        import pyarrow as pa

        for name, drop in _KEPT.items():
            if name != owner:
                drop()
        if libc := _libc():
            libc.mallopt(-3, large << 20)  # M_MMAP_THRESHOLD, which else grows to 32 MB
            libc.mallopt(-1, spare << 20)  # M_TRIM_THRESHOLD
        try:
            yield from run(batches)
        finally:
            gc.collect()
            pa.default_memory_pool().release_unused()
            if libc:
                libc.malloc_trim(0)

    return wrapped


def parts(batch, place: int, rows: int, size: int = 2 << 20):
    """Stretches of an Arrow batch of at most ``rows`` rows, cut before the texts in the column exceed ``size`` bytes; a
    longer text is a stretch by itself."""
    import pyarrow as pa
    import pyarrow.compute as pc

    text = batch.column(place)
    kinds = (pa.types.is_string, pa.types.is_large_string, pa.types.is_binary, pa.types.is_large_binary)
    lengths = pc.fill_null(pc.binary_length(text if any(is_(text.type) for is_ in kinds) else text.cast(pa.string())), 0)
    ends = np.cumsum(np.r_[0, lengths.to_numpy(zero_copy_only=False)])
    lo = 0
    while lo < batch.num_rows:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(ends, ends[lo] + size, side="right")) - 1), batch.num_rows)
        yield batch.slice(lo, hi - lo)
        lo = hi


def table(spark: SparkSession, sf_dir: str, name: str, *columns: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet").select(*columns)


def slim_batches(spark: SparkSession, rows: int = 2000) -> None:
    """Send Python at most ``rows`` rows at a time, as texts may be long; a smaller setting of the session stays. Plans
    read it when they run, so it is left set for the session."""
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(key)) <= rows:
        spark.conf.set(key, str(rows))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))

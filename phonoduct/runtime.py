"""Session helpers shared by all operators."""

from __future__ import annotations

import os
import re
import tempfile
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession


def session(app: str = "phonoduct", cpus: int | str = "*", **conf: str) -> SparkSession:
    """A local session with the settings the tests and the benchmark share."""
    base = {
        "spark.sql.session.timeZone": "UTC",
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.driver.memory": "8g",
    }
    builder = SparkSession.builder.master(f"local[{cpus}]").appName(app)
    for k, v in (base | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def shared_folder(spark: SparkSession) -> None:
    """Make sure that the session has a checkpoint folder.

    It is ``spark.checkpoint.dir``. Where the session names none a temporary one is set on a local
    master, where no second machine is involved; on a cluster, whose machines would each write to their own disk, it raises.
    """
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        shared = sc.getConf().get("spark.checkpoint.dir")
        if not shared and not re.fullmatch(r"local(\[.*\])?", sc.master):
            raise ValueError(f"set spark.checkpoint.dir to a folder that all machines of {sc.master} share")
        sc.setCheckpointDir(shared or os.path.join(tempfile.gettempdir(), f"checkpoints-{os.getpid()}"))


def cut_lineage(df: DataFrame) -> DataFrame:
    """Write ``df`` to the shared checkpoint folder and read it back."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def changes(t: pa.Table, keys: Sequence[str]) -> np.ndarray:
    """True at each row of a sorted table whose key differs from the row before; the first row is True.

    Two nulls count as the same key.
    """
    n = t.num_rows
    out = np.zeros(n, bool)
    if n:
        out[0] = True
    for k in keys:
        c = t.column(k).combine_chunks()
        if isinstance(c, pa.ChunkedArray):
            c = pa.concat_arrays(c.chunks)
        a, b = c.slice(1), c.slice(0, n - 1)
        if c.null_count:
            differ = pc.fill_null(pc.not_equal(a, b), False)
            differ = pc.or_(differ, pc.xor(pc.is_null(a), pc.is_null(b)))
        else:
            differ = pc.not_equal(a, b)
        out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def whole_groups(batches: Iterator[pa.RecordBatch], keys: Sequence[str], rows: int = 250_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Join sorted Arrow batches to tables of about ``rows`` rows that never cut a key in two.

    Yields each table with the rows at which a key begins. The caller bounds the size of one key.
    """
    kept: list[pa.RecordBatch] = []
    count = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        kept.append(batch)
        count += batch.num_rows
        if count < rows:
            continue
        t = pa.Table.from_batches(kept).combine_chunks()
        at = np.flatnonzero(changes(t, keys))
        if len(at) > 1:
            yield t.slice(0, at[-1]), at[:-1]
            rest = t.slice(at[-1])
            kept, count = rest.combine_chunks().to_batches(), rest.num_rows
        else:  # one key fills the table: look again only when it has doubled
            kept, count, rows = t.to_batches(), t.num_rows, max(rows, 2 * t.num_rows)
    if count:
        t = pa.Table.from_batches(kept).combine_chunks()
        yield t, np.flatnonzero(changes(t, keys))


def per_groups(fn: Callable[[pa.Table, np.ndarray], pa.Table | None], keys: Sequence[str], schema: pa.Schema, rows: int = 250_000):
    """A function for ``mapInArrow`` that calls ``fn(table, group_starts)`` on whole groups."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t, at in whole_groups(batches, keys, rows):
            out = fn(t, at)
            if out is not None and out.num_rows:
                yield from out.cast(schema).to_batches(max_chunksize=50_000)

    return run

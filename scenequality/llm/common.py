"""Small helpers that the operators of this subpackage share."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scenequality.session import checkpoint_folder


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def new_folder(spark: SparkSession, kind: str) -> str:
    """A fresh folder below the shared checkpoint folder, for files that tasks write and later tasks read."""
    return f"{checkpoint_folder(spark).rstrip('/')}/scenequality/{kind}-{uuid.uuid4().hex}"


def place(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of ``uri``; plain paths are local or mounted."""
    return fs.FileSystem.from_uri(uri)


def attempt_file(folder: str, part: int, suffix: str) -> str:
    """A name of its own for each attempt of a task: only the manifest row that Spark commits makes a file count,
    so a repeated or lost attempt leaves an unlisted file and never a half-read one."""
    return f"{folder}/part-{part:06d}-{uuid.uuid4().hex}{suffix}"


def slices(batch: pa.RecordBatch, column: str, limit: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """``batch`` in consecutive slices of about ``limit`` bytes of ``column``; a longer value is a slice of its own."""
    total = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    start = 0
    while start < batch.num_rows:
        before = total[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(total, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def hash_sample(ids: DataFrame, total: int, n: int) -> list:
    """At most ``n`` values of the one column of ``ids``, those of smallest hash, out of about ``total``.

    A bound on the hash lets about 2n + 64 rows through, so what tasks send to the driver doesn't grow with the
    table; in the all but impossible case that fewer than n pass, the sample is that much smaller.
    """
    (name,) = ids.columns
    hashed = F.xxhash64(name)
    share = (2 * n + 64) / max(total, 1)
    few = ids if share >= 1 else ids.where(hashed <= F.lit(int(share * 2.0**64) - 2**63))
    return [r[0] for r in few.orderBy(hashed, name).limit(n).collect() if r[0] is not None]


def strings(batch: pa.RecordBatch, column: str) -> list[str]:
    """Values of a text column, null as empty."""
    return [value or "" for value in batch.column(column).to_pylist()]

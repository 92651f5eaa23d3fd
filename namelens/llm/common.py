"""Small helpers that the training-data operators share."""

from __future__ import annotations

import contextlib
import re
import tempfile
import uuid
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


SPACE = re.compile(rb"[\x20\x09-\x0d]")


def shared_root(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where it is unset, a local session gets a folder of its own; on a cluster that is an error, as executors don't share one.
    """
    context = spark.sparkContext
    root = context.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not re.fullmatch(r"local(\[.*\])?", context.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="spark-")
        spark.conf.set("spark.checkpoint.dir", root)
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(root)
    return root.rstrip("/")


def shared_path(spark: SparkSession, label: str) -> str:
    return f"{shared_root(spark)}/{label}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is written meanwhile leaves no shuffle files, which else stay until the driver happens to collect its garbage."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before) if before is not None else spark.conf.unset(key)


def written(df: DataFrame, label: str) -> DataFrame:
    """``df`` as a table in the shared folder: later readers neither recompute it nor lose it with an executor."""
    path = shared_path(df.sparkSession, label)
    with shuffles_removed(df.sparkSession):
        df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def crc_of(column: str) -> Column:
    """crc32 of a column's text; a null counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")))


def text_parts(texts: pa.Array, most: int = 4 << 20) -> Iterator[tuple[np.ndarray, pa.Array]]:
    """(rows, parts): the texts in order, about ``most`` bytes at once, and which text each part belongs to.

    A text longer than that comes in several parts, cut before white space; a null counts as the empty text.
    """
    texts = pc.fill_null(texts.cast(pa.large_binary()), b"")
    ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = int(ends[at - 1]) if at else 0
        stop = max(at + 1, int(np.searchsorted(ends, before + most, "right")))
        if stop == at + 1 and ends[at] - before > 2 * most:
            text, start = texts[at].as_buffer().to_pybytes(), 0
            while start < len(text):
                gap = SPACE.search(text, start + most)
                end = gap.start() if gap else len(text)
                yield np.array([at]), pa.array([text[start:end]], pa.large_binary())
                start = end
        else:
            yield np.arange(at, stop), texts.slice(at, stop - at)
        at = stop


def chunks_of(parts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(offsets, codes, distinct): each part's chunks between ASCII white space, one at least, as codes of the distinct ones."""
    split = pc.ascii_split_whitespace(parts.cast(pa.large_string(), safe=False) if pa.types.is_large_binary(parts.type) else parts)
    coded = split.values.dictionary_encode()
    return split.offsets.to_numpy(), coded.indices.to_numpy(), coded.dictionary.cast(pa.large_binary())


#: Rows that pass between Spark and Python at once, where rows hold texts: what both sides hold of a batch stays small.
BATCH_ROWS = 1000


def map_in_python(df: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: str | T.StructType) -> DataFrame:
    """``mapInArrow`` in batches of ``BATCH_ROWS`` at most, which is set in the session; at a task's end free memory goes back."""
    conf, key = df.sparkSession.conf, "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(conf.get(key)) <= BATCH_ROWS:
        conf.set(key, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from function(batches)
        finally:
            pa.default_memory_pool().release_unused()

    return df.mapInArrow(run, schema)


def with_columns_from_python(
    df: DataFrame,
    inputs: list[str],
    outputs: list[T.StructField],
    make: Callable[[], Callable[..., list]],
) -> DataFrame:
    """Appends columns that a Python function derives batch by batch, and keeps the others as they are.

    ``make`` runs once a task and gives a function from the input columns to the output columns, as Arrow arrays or
    lists. A column of ``df`` that has the name of an output is replaced.
    """
    names = [f.name for f in outputs]
    kept = [f for f in df.schema.fields if f.name not in names]
    schema = T.StructType(kept + outputs)
    kept_names = [f.name for f in kept]
    safe = df.select(*[F.col(f"`{n}`") for n in kept_names], *[F.col(f"`{n}`").alias(f"__in_{k}") for k, n in enumerate(inputs)])
    width = len(kept_names)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        function = make()
        kinds = [to_arrow_type(f.dataType) for f in outputs]
        for batch in batches:
            made = function(*[batch.column(width + k) for k in range(len(inputs))])
            arrays = [batch.column(k) for k in range(width)] + [pa.array(v, kind) for v, kind in zip(made, kinds, strict=True)]
            yield pa.RecordBatch.from_arrays(arrays, names=kept_names + names)

    return map_in_python(safe, run, schema)


def bounded_fraction(rows: int, bound: int) -> float:
    return 1.0 if rows <= bound else bound / rows


def sampled(df: DataFrame, key: str, fraction: float, seed: int) -> DataFrame:
    """Rows whose seeded hash of ``key`` is in the first ``fraction`` of its range; the same rows in every run."""
    if fraction >= 1.0:
        return df
    return df.where(F.pmod(F.xxhash64(F.lit(seed), F.col(key)), F.lit(1_000_000)) < int(fraction * 1_000_000))


def crc32(data: bytes) -> int:
    return zlib.crc32(data) & 0xFFFFFFFF

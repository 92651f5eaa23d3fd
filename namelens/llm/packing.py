"""Harmonic packing of documents into sequences of a fixed capacity.

Piece lengths fall into reciprocal-capacity classes: a class of length s holds floor(capacity / s) pieces in each of
its sequences. Documents are cut so that their pieces lie exactly on class lengths: full sequences, powers of two from
``tail`` up, and one tail shorter than that. Each task numbers its pieces per class on its own; only the counts by task
and class are summed up front, which gives every piece its sequence and offset without moving it. What is left over in
each class's last sequence is a bounded number of pieces, placed by next fit from long to short.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import crc32, map_in_python, written
from .word_tokens import ChunkTokenizer


def cuts(n: int, capacity: int, tail: int) -> list[int]:
    """The lengths, each a class length, into which a document of ``n`` ids is cut, in order."""
    out, rest, size = [capacity] * (n // capacity), n % capacity, capacity // 2
    while size >= tail:
        if rest >= size:
            out.append(size)
            rest -= size
        size //= 2
    return out + [rest] * bool(rest)


def left_over(counts: dict[int, int], capacity: int, first_sequence: int) -> list[tuple[int, int, int, int]]:
    """(length, ordinal in class, sequence, offset) of the pieces after each class's last whole sequence."""
    out, sequence, used = [], first_sequence, 0
    for size in sorted(counts, reverse=True):
        per = capacity // size
        for ordinal in range(counts[size] // per * per, counts[size]):
            if used + size > capacity:
                sequence, used = sequence + 1, 0
            out.append((size, ordinal, sequence, used))
            used += size
    return out


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", capacity: int = 2048, tail: int = 128, end_id: int = 1, tokenizer_path: str | None = None, keep_ids: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset, and ids if ``keep_ids``.

    ``capacity`` and ``tail`` are powers of two. A null or empty text is the end id alone. Repeated rows and rows with
    a null id are packed like any other; other columns are ignored; an empty table gives an empty table.
    """
    if capacity & (capacity - 1) or tail & (tail - 1) or not 1 < tail <= capacity:
        raise ValueError("capacity and tail must be powers of two, tail not above capacity")
    kinds = "task int, size int, ordinal long, doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<long>" * keep_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, task = ChunkTokenizer(tokenizer_path), TaskContext.get().partitionId()
        end, seen = np.array([end_id], "<u4"), {}
        names = [k.split()[0] for k in kinds.split(", ")]
        types = [pa.int32(), pa.int32()] + [pa.int64()] * 6 + [pa.list_(pa.int64())] * keep_ids

        def rows_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [()] * len(names)
            return pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, types, strict=True)], names=names)

        for batch in batches:
            rows: list[tuple] = []
            for doc, ids in zip(batch.column(0).to_pylist(), tokens.ids_of(batch.column(1)), strict=True):
                ids, start = np.concatenate((ids, end)), 0
                data, n = ids.astype("<u4", copy=False).data.cast("B"), len(ids)
                for size in cuts(n, capacity, tail):
                    own = data[4 * start : 4 * (start + size)]
                    ordinal = seen[size] = seen.get(size, -1) + 1
                    rows.append((task, size, ordinal, doc, start, size, crc32(own), n, *([np.frombuffer(own, "<u4").astype(np.int64)] * keep_ids)))
                    start += size
                if len(rows) >= 20_000:
                    yield rows_of(rows)
                    rows = []
            yield rows_of(rows)

    pieces = written(map_in_python(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), cut, kinds), "pieces")
    by_task = pieces.groupBy("task", "size").agg((F.max("ordinal") + 1).alias("n"))
    earlier = F.coalesce(F.sum("n").over(Window.partitionBy("size").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    bases = by_task.withColumn("base", earlier).drop("n")
    counts = {r["size"]: r.n for r in by_task.groupBy("size").agg(F.sum("n").alias("n")).collect()}  # a row for each class at most
    plan, sequence = [], 0
    for size in sorted(counts, reverse=True):
        per = capacity // size
        plan.append((size, per, counts[size] // per * per, sequence))
        sequence += counts[size] // per
    spark = docs.sparkSession
    classes = spark.createDataFrame(plan, "size int, per int, whole long, first long")
    rest = spark.createDataFrame(left_over(counts, capacity, sequence), "size int, number long, rest_sequence long, rest_offset long")
    placed = pieces.join(bases, ["task", "size"]).join(F.broadcast(classes), "size").withColumn("number", F.col("base") + F.col("ordinal")).join(F.broadcast(rest), ["size", "number"], "left")
    whole = F.col("number") < F.col("whole")
    sequence_id = F.when(whole, F.col("first") + F.floor(F.col("number") / F.col("per"))).otherwise(F.col("rest_sequence"))
    offset = F.when(whole, F.col("number") % F.col("per") * F.col("size")).otherwise(F.col("rest_offset"))
    return placed.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", sequence_id.cast("long").alias("sequence_id"), offset.cast("long").alias("offset"), *["ids"] * keep_ids)

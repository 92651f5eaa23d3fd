"""Token counts of the documents in flat token files that have no index, by a separator scan.

A file is a run of unsigned 16- or 32-bit ids in which every document ends with one separator id. Files are read in
blocks; each block is searched for separators at once. Where a block's first document began, and which number it has,
depends on all blocks before it: a prefix scan over the blocks' counts and last separators tells, without the data.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import map_in_python, shared_path, written
from .files import new_file, opened, read_range
from .word_tokens import ChunkTokenizer

SEPARATOR = 49407


def write_token_files(docs: DataFrame, folder: str, id_col: str = "doc_id", text_col: str = "text", separator: int = SEPARATOR, tokenizer_path: str | None = None, file_bytes: int = 256 << 20) -> DataFrame:
    """Writes flat little-endian 16-bit token files into ``folder``; (file, doc_index, doc_id) in the order written.

    Special tokens' strings in a text are ordinary text, so the separator occurs after each document only. A null or
    empty text is the separator alone. A task begins another file once one has ``file_bytes``. Rows with a null id and
    repeated rows are written like any other; other columns are ignored; an empty table gives no file.
    """

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens, end = ChunkTokenizer(tokenizer_path, literal=True), np.array([separator], "<u2").tobytes()
        name, out, size, count = None, None, 0, 0
        for batch in batches:
            files, numbers = [], []
            for ids in tokens.ids_of(batch.column(1)):
                if out is None or size >= file_bytes:
                    if out is not None:
                        out.close()
                    name, size, count = new_file(folder, ".tok"), 0, 0
                    fs, path = opened(name)
                    out = fs.open_output_stream(path)
                data = ids.astype("<u2").tobytes() + end
                out.write(data)
                files.append(name), numbers.append(count)
                size, count = size + len(data), count + 1
            if batch is not None and len(batch):
                yield pa.RecordBatch.from_arrays([pa.array(files, pa.string()), pa.array(numbers, pa.int64()), batch.column(0)], names=["file", "doc_index", "doc_id"])
        if out is not None:
            out.close()

    return map_in_python(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), write, "file string, doc_index long, doc_id long")


def scan(files: DataFrame, separator: int = SEPARATOR, width: int = 2, block_tokens: int = 2 << 20, tasks: int | None = None) -> DataFrame:
    """(file, doc_index, start, n_tokens, closed) of every document in the files that ``files.file`` names.

    ``n_tokens`` leaves the separator out. Ids after a file's last separator are a document that isn't closed. An
    empty document has no tokens; an empty file has no document; a file named twice is read once; null names and other
    columns are ignored; without files there are no rows. Blocks are dealt out to as many ``tasks`` as there are blocks,
    4096 at most, unless another number is given: their descriptions are too small for Spark to tell what they cost.
    Only what the prefix scan tells of a block is broadcast, never its separators.
    """

    def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, numbers, lengths = [], [], []
            for name in batch.column(0).to_pylist():
                fs, path = opened(name)
                total = fs.get_file_info(path).size // width
                for k in range(-(-total // block_tokens)):
                    names.append(name), numbers.append(k), lengths.append(min(block_tokens, total - k * block_tokens))
            yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array(numbers, pa.int64()), pa.array(lengths, pa.int64())], names=["file", "block", "n"])

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for name, k, n in zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True):
                fs, path = opened(name)
                with fs.open_input_file(path) as f:
                    ids = np.frombuffer(read_range(f, k * block_tokens * width, n * width), f"<u{width}")
                at = np.flatnonzero(ids == separator).astype(np.int64) + k * block_tokens
                last = int(at[-1]) if len(at) else None
                yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([k], pa.int64()), pa.array([k * block_tokens + n], pa.int64()), pa.array([len(at)], pa.int64()), pa.array([last], pa.int64()), pa.array([at], pa.list_(pa.int64()))], names=["file", "block", "until", "found", "last", "at"])

    named = written(files.select("file").distinct().where("file is not null").mapInArrow(blocks, "file string, block long, n long"), "blocks")
    tasks = tasks or max(1, min(4096, named.count()))
    searched = written(named.repartition(tasks, F.col("file"), F.col("block")).mapInArrow(find, "file string, block long, until long, found long, last long, at array<long>"), "separators")
    order = Window.partitionBy("file").orderBy("block")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    summary = searched.select("file", "block", "until", "found", "last")
    stitched = summary.select("file", "block", F.coalesce(F.sum("found").over(before), F.lit(0)).alias("number"), (F.coalesce(F.max("last").over(before), F.lit(-1)) + 1).alias("begin"))
    ends = searched.join(F.broadcast(stitched), ["file", "block"]).select("file", "number", "begin", F.col("at"), F.posexplode("at").alias("k", "end"))
    begin = F.when(F.col("k") == 0, F.col("begin")).otherwise(F.get("at", F.col("k") - 1) + 1)
    closed = ends.select("file", (F.col("number") + F.col("k")).alias("doc_index"), begin.alias("start"), (F.col("end") - begin).alias("n_tokens"), F.lit(True).alias("closed"))
    tails = summary.groupBy("file").agg(F.sum("found").alias("doc_index"), (F.coalesce(F.max("last"), F.lit(-1)) + 1).alias("start"), F.max("until").alias("until"))
    open_ = tails.where("until > start").select("file", "doc_index", "start", (F.col("until") - F.col("start")).alias("n_tokens"), F.lit(False).alias("closed"))
    return closed.union(open_)


def token_counts(docs: DataFrame, **settings) -> DataFrame:
    """(doc_id, file, doc_index, start, n_tokens): writes ``docs`` to flat files, scans them, names the documents.

    A row for each row of ``docs``, those with a null id included; an empty table gives an empty table. The order's files
    are a fiftieth of its rows in memory, so the planner isn't left to broadcast it by their size.
    """
    folder = shared_path(docs.sparkSession, "tokens")
    order = written(write_token_files(docs, folder, **settings), "order")
    return scan(order).hint("merge").join(order.hint("merge"), ["file", "doc_index"]).select("doc_id", F.element_at(F.split("file", "/"), -1).alias("file"), "doc_index", "start", "n_tokens")

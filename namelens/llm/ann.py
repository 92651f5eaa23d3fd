"""Approximate nearest neighbours by largest inner product: probed lists with an adaptive dimension scan.

Vectors get one more coordinate so that the largest inner product becomes the smallest distance, are rotated at random
and kept in column blocks. Each belongs to the list of its nearest centre; a query probes the lists nearest to it, as many
as a bounded sample needs for the recall aimed at. In a list, distances build up block by block, and after each block a
hypothesis test abandons the candidates whose partial distance already says that they can't be among the nearest. What
survives is scored exactly on the original vectors. The nearest few lists are searched first; the others then only return
what beats the best found there, and those that can't hold such a vector are left out.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import bounded_fraction, sampled, written
from .vectors import matrix, usable


def centres_of(sample: np.ndarray, lists: int, rounds: int, seed: int) -> np.ndarray:
    """Lloyd's algorithm on a bounded sample; an empty centre stays where it was."""
    rng = np.random.default_rng(seed)
    centres = sample[rng.choice(len(sample), lists, replace=False)].copy()
    for _ in range(rounds):
        owner = np.concatenate([(centres @ part.T - 0.5 * np.einsum("ij,ij->i", centres, centres)[:, None]).argmax(axis=0) for part in np.array_split(sample, max(1, len(sample) // 4096))])
        sums = np.zeros_like(centres)
        np.add.at(sums, owner, sample)
        n = np.bincount(owner, minlength=lists)
        centres[n > 0] = sums[n > 0] / n[n > 0][:, None]
    return centres


def probes_for(sample: np.ndarray, lifted: Callable[[np.ndarray], np.ndarray], centres: np.ndarray, k: int, aim: float, seed: int, most: int = 512) -> int:
    """How many lists hold the share ``aim`` of the ``k`` nearest of up to ``most`` vectors of the sample within it."""
    asked = np.random.default_rng(seed).choice(len(sample), min(most, len(sample)), replace=False)
    k = min(k, len(sample) - 1)
    if k < 1:
        return len(centres)
    scores = sample[asked] @ sample.T
    scores[np.arange(len(asked)), asked] = -np.inf
    near = np.argpartition(-scores, k - 1, axis=1)[:, :k]
    half = 0.5 * np.einsum("ij,ij->i", centres, centres)
    own = np.concatenate([(lifted(part) @ centres.T - half).argmax(axis=1) for part in np.array_split(sample, max(1, len(sample) // 4096))])
    rank = np.argsort(np.argsort(half - np.hstack([sample[asked], np.zeros((len(asked), 1))]) @ centres.T, axis=1), axis=1)
    ranks = np.sort(rank[np.arange(len(asked))[:, None], own[near]].ravel())
    return int(ranks[min(len(ranks) - 1, math.ceil(aim * len(ranks)) - 1)]) + 1


def scan(q: np.ndarray, c: np.ndarray, k: int, columns: int, epsilon: float, limit: np.ndarray, chunk: int = 1024) -> list[np.ndarray]:
    """For each rotated query the rows of ``c`` that survive: all within its ``limit`` that can be among its k nearest, ties included.

    After d of D columns a candidate's expected distance is D / d times the partial one; it is abandoned when even
    with the deviation epsilon / sqrt(d) allows for, that is beyond the k-th smallest distance so far.
    """
    size = q.shape[1]
    edges = [*range(0, size, columns), size]
    found = [(np.empty(0, np.int64), np.empty(0)) for _ in q]
    limit = limit.copy()
    for at in range(0, len(c), chunk):
        part = c[at : at + chunk]
        who, which, dist = None, None, None
        for lo, hi in zip(edges, edges[1:], strict=False):
            if who is None:
                d = np.einsum("ij,ij->i", q[:, lo:hi], q[:, lo:hi])[:, None] + np.einsum("ij,ij->i", part[:, lo:hi], part[:, lo:hi])[None, :] - 2 * q[:, lo:hi] @ part[:, lo:hi].T
            elif len(who) > 0.3 * len(q) * len(part):  # most still stand: one product is cheaper than single rows
                full = np.einsum("ij,ij->i", q[:, lo:hi], q[:, lo:hi])[:, None] + np.einsum("ij,ij->i", part[:, lo:hi], part[:, lo:hi])[None, :] - 2 * q[:, lo:hi] @ part[:, lo:hi].T
                dist = dist + full[who, which]
            else:
                step = q[who, lo:hi] - part[which, lo:hi]
                dist = dist + np.einsum("ij,ij->i", step, step)
            bound = limit * (hi / size) * (1 + epsilon / math.sqrt(hi)) ** 2 if hi < size else limit
            if who is None:
                who, which = np.nonzero(d <= bound[:, None] + 1e-9)
                dist = d[who, which]
            else:
                keep = dist <= bound[who] + 1e-9
                who, which, dist = who[keep], which[keep], dist[keep]
        starts = np.searchsorted(who, np.arange(len(q) + 1))
        for r in range(len(q)):
            s, e = starts[r], starts[r + 1]
            if s == e:
                continue
            rows, ds = np.concatenate((found[r][0], at + which[s:e])), np.concatenate((found[r][1], dist[s:e]))
            if len(ds) > k:
                limit[r] = min(limit[r], np.partition(ds, k - 1)[k - 1])
                keep = ds <= limit[r] + 1e-9
                rows, ds = rows[keep], ds[keep]
            elif len(ds) == k:
                limit[r] = min(limit[r], ds.max())
            found[r] = (rows, ds)
    return [f[0] for f in found]


def search(embeddings: DataFrame, query_rule: str = "vec_id % 20 = 0", k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding", lists_per_root: float = 0.6, most_lists: int = 4096, aim: float = 0.95, sample_rows: int = 20_000, block: int = 16_384, query_block: int = 16_384, columns: int = 16, epsilon: float = 2.1, seed: int = 9) -> DataFrame:
    """(query_id, rank, vec_id, score): for each row that ``query_rule`` picks, the ``k`` largest inner products.

    There are sqrt(n) * ``lists_per_root`` lists. The centres come from about ``sample_rows`` vectors at most, and so does
    the number of lists that a query probes: as many as hold the share ``aim`` of the nearest in that sample. Where
    vectors lie in groups these are few; where they lie evenly in many dimensions, a fixed share of all. Every vector is
    in a list, and every row but the query's own is a candidate, rows with its vec_id too. Equal vectors: only those with
    the k + 1 smallest ids can ever be returned, so only these are scanned; equal queries are searched once. Ties go to
    the smaller vec_id. Vectors that are null, zero, of another length than most, or hold null or non-finite components
    take no part; other columns are ignored; an empty table gives an empty table.
    """
    rows = written(usable(embeddings, id_col, vector_col).withColumn("row", F.monotonically_increasing_id()), "vectors")
    copies = Window.partitionBy("v").orderBy("vec_id", "row")
    kept = rows.withColumn("copy", F.row_number().over(copies)).where(F.col("copy") <= k + 1).select("row", "vec_id", "v")
    asked = rows.where(query_rule).select("row", "vec_id", "v")
    queries = written(asked.groupBy("v").agg(F.min("row").alias("q")), "queries")
    total = rows.count()
    schema = "query_id long, rank int, vec_id long, score double"
    if not total:
        return rows.sparkSession.createDataFrame([], schema)
    top = rows.agg(F.max(F.expr("aggregate(v, 0D, (s, x) -> s + x * x)"))).first()[0]
    sample = np.array([r.v for r in sampled(rows, "vec_id", bounded_fraction(total, sample_rows), seed).select("v").collect()] or [rows.first().v])
    lists = max(1, min(most_lists, round(lists_per_root * math.sqrt(total)), len(sample)))
    lifted = lambda x: np.hstack([x, np.sqrt(np.maximum(top - np.einsum("ij,ij->i", x, x), 0))[:, None]])
    flat = lambda x: np.hstack([x, np.zeros((len(x), 1))])
    size = sample.shape[1] + 1
    turn = np.linalg.qr(np.random.default_rng(seed).standard_normal((size, size)))[0]
    centres = centres_of(lifted(sample), lists, 8, seed)
    probes = min(lists, probes_for(sample, lifted, centres, k, aim, seed))
    first = max(1, probes // 8)
    context = rows.sparkSession.sparkContext
    index = context.broadcast((centres, 0.5 * np.einsum("ij,ij->i", centres, centres)))
    as_bytes = lambda x: pa.array([r.tobytes() for r in np.ascontiguousarray(x, "<f8")], pa.binary())

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, h = index.value
        for batch in (b.slice(at, 4096) for b in batches for at in range(0, len(b), 4096)):
            x = matrix(batch.column(2))
            y = lifted(x)
            near = y @ c.T - h
            own = near.argmax(axis=1)
            away = np.sqrt(np.maximum(np.einsum("ij,ij->i", y, y) - 2 * near[np.arange(len(y)), own], 0))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), as_bytes(x), pa.array(own.astype(np.int32)), pa.array(away)], names=["row", "vec_id", "x", "list", "away"])

    placed = written(kept.mapInArrow(place, "row long, vec_id long, x binary, list int, away double"), "lists")
    shape = written(placed.groupBy("list").agg(F.ceil(F.count("*") / block).cast("int").alias("blocks"), F.max("away").alias("away")), "shape")
    reach = np.full(lists, -np.inf)
    for r in shape.collect():  # a row for each list, most_lists at most
        reach[r.list] = r.away
    radii = context.broadcast(reach)

    def to_lists(low: int, high: int):
        """The lists number ``low`` up to ``high`` by nearness to a query, less those beyond its bound."""

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            c, h = index.value
            for batch in (b.slice(at, 4096) for b in batches for at in range(0, len(b), 4096)):
                x, bound = matrix(batch.column(1)), batch.column(2).to_numpy(zero_copy_only=False)
                near = h - flat(x) @ c.T
                order = np.argsort(near, axis=1, kind="stable")[:, low:high]
                norms = np.einsum("ij,ij->i", x, x)
                far = np.sqrt(np.maximum(norms[:, None] + 2 * np.take_along_axis(near, order, axis=1), 0))
                limit = np.sqrt(np.maximum(norms + top - 2 * bound, 0))
                may = far - radii.value[order] <= (limit + 1e-6)[:, None]
                chosen = pa.array([o[m] for o, m in zip(order.astype(np.int32), may, strict=True)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), as_bytes(x), batch.column(2), chosen], names=["q", "x", "bound", "lists"])

        return run

    def look(group: pa.Table) -> pa.Table:
        is_query = group.column("query").to_numpy()
        ids, vec, bound, x = group.column("row").to_numpy(), group.column("vec_id").to_numpy(), group.column("bound").to_numpy(), matrix(group.column("x"))
        qi, ci = np.flatnonzero(is_query), np.flatnonzero(~is_query)
        ci = ci[np.lexsort((ids[ci], vec[ci]))]
        out: tuple[list, list, list, list] = ([], [], [], [])
        if len(qi) and len(ci):
            c = lifted(x[ci]) @ turn
            for at in range(0, len(qi), 64):
                part = qi[at : at + 64]
                limit = np.einsum("ij,ij->i", x[part], x[part]) + top - 2 * bound[part] + 1e-9
                for r, found in zip(part, scan(flat(x[part]) @ turn, c, k + 1, columns, epsilon, limit), strict=True):
                    score = x[ci[found]] @ x[r]
                    order = np.lexsort((ids[ci[found]], vec[ci[found]], -score))[: k + 1]
                    order = order[score[order] >= bound[r]]
                    out[0].append(np.full(len(order), ids[r]))
                    out[1].append(ids[ci[found[order]]])
                    out[2].append(vec[ci[found[order]]])
                    out[3].append(score[order])
        cat = [np.concatenate(o) if o else np.empty(0) for o in out]
        return pa.table({"q": pa.array(cat[0].astype(np.int64)), "row": pa.array(cat[1].astype(np.int64)), "vec_id": pa.array(cat[2].astype(np.int64)), "score": pa.array(cat[3].astype(np.float64))})

    best = Window.partitionBy("q").orderBy(F.desc("score"), "vec_id", "row")
    nearest = lambda df: df.withColumn("r", F.row_number().over(best)).where(F.col("r") <= k + 1)

    def searched(bounded: DataFrame, low: int, high: int) -> DataFrame:
        """The k + 1 best of those lists for each query, as far as they reach its bound."""
        ask = written(bounded.mapInArrow(to_lists(low, high), "q long, x binary, bound double, lists array<int>").select("q", "x", "bound", F.explode("lists").alias("list")), "asks")
        asks = ask.groupBy("list").agg(F.ceil(F.count("*") / query_block).cast("int").alias("ask_blocks"))
        both = F.broadcast(shape.join(asks, "list"))  # a row for each list, most_lists at most
        columns_ = ["list", "block", "ask", "row", "vec_id", "x", "bound", "query"]
        candidate = placed.join(both, "list").withColumn("block", F.pmod(F.xxhash64("row"), F.col("blocks")).cast("int")).withColumn("ask", F.explode(F.sequence(F.lit(0), F.col("ask_blocks") - 1)))
        candidate = candidate.withColumns({"bound": F.lit(0.0), "query": F.lit(False)}).select(*columns_)
        question = ask.join(both, "list").withColumn("ask", F.pmod(F.xxhash64("q"), F.col("ask_blocks")).cast("int")).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        question = question.withColumns({"row": F.col("q"), "vec_id": F.lit(0).cast("long"), "query": F.lit(True)}).select(*columns_)
        return nearest(candidate.union(question).groupBy("list", "block", "ask").applyInArrow(look, "q long, row long, vec_id long, score double"))

    near = written(searched(queries.select("q", "v", F.lit(float("-inf")).alias("bound")), 0, first), "nearest")
    bounds = near.where(F.col("r") == k + 1).select("q", "score")
    bounded = queries.join(bounds, "q", "left").select("q", "v", F.coalesce("score", F.lit(float("-inf"))).alias("bound"))
    found = near.drop("r")
    if first < probes:
        found = nearest(found.union(searched(bounded, first, probes).drop("r"))).drop("r")
    each = asked.join(queries, "v").select(F.col("row").alias("own"), F.col("vec_id").alias("query_id"), "q")
    answer = each.join(found, "q").where("own != row")
    mine = Window.partitionBy("own").orderBy(F.desc("score"), "vec_id", "row")
    return answer.withColumn("rank", F.row_number().over(mine)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")

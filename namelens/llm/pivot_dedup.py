"""Embedding near-duplicates through a pivot-permutation index.

Every vector is described by its nearest reference points, nearest first. Inverted lists name the vectors described by
each pivot. Two vectors that share at least ``shared`` pivots are candidates and are verified by their exact cosine.
As two such descriptions must also meet in their first nearest - shared + 1 pivots under any common order, a vector is
posted under those only, in the order rare pivots first, and a pair is counted in the list of its first shared pivot.
Lists longer than a block are worked off as pairs of blocks, so no list of any length comes to one task.

That finds sparse vectors. Members of a large group of near copies would have pivots out of the group itself and seldom
share any, so dense regions take an exact way. With t the angle of the wanted cosine, pivots within 2t of another are
dropped, those with most drawn neighbours staying, and a vector within 2t of a remaining pivot has its home there. A
partner of a vector at home with a pivot is at most t farther from that pivot than the farthest vector at home there,
so every vector within that bound visits the pivot's list, and homes are compared with homes and visitors. Only pairs
of two vectors without a home are left to the shared pivots.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import written
from .components import connected_components
from .vectors import matrix, usable


#: Bytes of cosines that a task holds at once, and of pivots that every worker holds.
COSINE_BYTES, PIVOT_BYTES = 64 << 20, 128 << 20


def rows_at_once(pivots: int, most: int) -> int:
    return max(1, min(most, COSINE_BYTES // (8 * max(1, pivots))))


def thinned(points: np.ndarray, angle: float, block: int = 256) -> np.ndarray:
    """The unit vectors of which none is within twice the angle of another; those with most others within it stay."""
    within, spacing = math.cos(angle), math.cos(min(math.pi, 2 * angle))
    crowd = np.concatenate([(points[at : at + block] @ points.T >= within).sum(axis=1) for at in range(0, len(points), block)])
    points = points[np.argsort(-crowd, kind="stable")]
    kept = points[:0]
    for at in range(0, len(points), block):
        part = points[at : at + block]
        part = part[~(part @ kept.T >= spacing).any(axis=1)]
        own, stays = part @ part.T >= spacing, []
        for r in range(len(part)):
            if not own[r, stays].any():
                stays.append(r)
        kept = np.concatenate([kept, part[stays]])
    return kept


def near_duplicates(embeddings: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", cosine: float = 0.95, nearest: int = 10, shared: int = 2, pivots_per_root: float = 6.0, most_pivots: int = 65_536, block: int = 2048, seed: int = 3) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for every row.

    Pivots are a hashed, then thinned sample of sqrt(n) * ``pivots_per_root`` vectors, ``most_pivots`` and 128 MB of doubles at
    most (collected and broadcast, a vector each); every vector is indexed, and a task holds 64 MB of cosines at once. Links are exact where an end has a home. Equal vectors are one entry with a count. Vectors that are null, zero, of another length than most, or
    hold null or non-finite components link with nothing and are their own component. A row with a null id is
    returned with no links, a null component and kept false. Repeated rows count as vectors of their own. Other
    columns are ignored; an empty table gives an empty table.
    """
    everything = embeddings.select(F.col(id_col).cast("long").alias("vec_id"))
    rows = written(usable(embeddings, id_col, vector_col), "vectors")
    classes = written(rows.groupBy("v").agg(F.min("vec_id").alias("rep"), F.count("*").alias("n")), "classes")
    total = classes.count()
    width = classes.select(F.size("v")).limit(1).collect()
    affordable = PIVOT_BYTES // (8 * max(1, width[0][0])) if width else 1
    wanted = max(1, min(most_pivots, affordable, total, round(pivots_per_root * math.sqrt(total))))
    drawn = classes.select("v", "rep", F.xxhash64(F.lit(seed), "rep").alias("h")).orderBy("h", "rep").limit(wanted).collect()  # bounded by most_pivots
    spark = embeddings.sparkSession
    if not drawn:
        return everything.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.col("vec_id").isNotNull().alias("kept"))
    points = np.array([r.v for r in drawn])
    points /= np.linalg.norm(points, axis=1)[:, None]
    angle = math.acos(max(-1.0, min(1.0, cosine)))
    points = thinned(points, angle)
    wanted = len(points)
    at_home = math.cos(min(math.pi, 2 * angle))
    k = min(nearest, wanted)
    need = min(shared, k)
    reference = spark.sparkContext.broadcast(points)

    def describe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = rows_at_once(wanted, 2048)
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                x = matrix(part.column(0))
                near = (x / np.linalg.norm(x, axis=1)[:, None]) @ reference.value.T
                top = np.argpartition(-near, k - 1, axis=1)[:, :k]
                order = np.take_along_axis(top, np.argsort(-np.take_along_axis(near, top, 1), axis=1, kind="stable"), 1)
                bytes_of = [r.tobytes() for r in np.ascontiguousarray(x, "<f8")]
                close = near[np.arange(len(part)), order[:, 0]]
                home = np.where(close >= at_home, order[:, 0], -1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(1), part.column(2), pa.array(bytes_of, pa.binary()), pa.array(list(order.astype(np.int32)), pa.list_(pa.int32())), pa.array(home), pa.array(close)], names=["rep", "n", "x", "pivots", "home", "close"])

    everyone = written(classes.select("v", "rep", "n").mapInArrow(describe, "rep long, n long, x binary, pivots array<int>, home int, close double"), "described")
    at_pivot = {r.home: r for r in everyone.where("home >= 0").groupBy("home").agg(F.min("close").alias("close"), F.count("*").alias("n")).collect()}  # a row for each pivot
    bounds = np.full(wanted, np.inf)
    for p, r in at_pivot.items():
        bounds[p] = math.cos(min(math.pi, math.acos(max(-1.0, min(1.0, r.close))) + angle)) - 1e-9
    reach = spark.sparkContext.broadcast(bounds)

    def visit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            size = rows_at_once(wanted, 1024)
            for at in range(0, len(batch), size):
                part = batch.slice(at, size)
                x, home = matrix(part.column(2)), part.column(3).to_numpy()
                near = (x / np.linalg.norm(x, axis=1)[:, None]) @ reference.value.T
                row, p = np.nonzero(near >= reach.value)
                ok = (home[row] < 0) | (p < home[row])  # two vectors with homes meet at the first of them
                row, p = row[ok], p[ok]
                chosen = part.take(pa.array(row, pa.int64()))
                yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), chosen.column(0), chosen.column(1), chosen.column(2)], names=["p", "rep", "n", "x"])

    visits = written(everyone.select("rep", "n", "x", "home").mapInArrow(visit, "p int, rep long, n long, x binary"), "visits")
    visitors = {r.p: r["count"] for r in visits.groupBy("p").count().collect()}  # a number for each pivot
    lists = [(p, -(-r.n // block), -(-visitors.get(p, 0) // block)) for p, r in at_pivot.items() if r.n + visitors.get(p, 0) > 1]
    cells = F.broadcast(spark.createDataFrame(lists, "p int, homes int, guests int"))  # most_pivots rows at most
    mixed_in = lambda count: F.pmod(F.xxhash64("rep"), count).cast("int")
    inside = everyone.where("home >= 0").select(F.col("home").alias("p"), "rep", "n", "x").join(cells, "p").withColumn("side", mixed_in(F.col("homes")))
    inside = inside.withColumn("o", F.explode(F.sequence(F.lit(0), F.col("homes") + F.col("guests") - 1))).withColumn("low", F.least("side", "o")).withColumn("high", F.greatest("side", "o"))
    outside = visits.join(cells, "p").withColumn("side", F.col("homes") + mixed_in(F.col("guests")))
    outside = outside.withColumn("low", F.explode(F.sequence(F.lit(0), F.col("homes") - 1))).withColumn("high", F.col("side"))
    dense = inside.select("p", "low", "high", "side", "rep", "n", "x").union(outside.select("p", "low", "high", "side", "rep", "n", "x"))
    described = everyone.where("home < 0")
    use = {r.p: r["count"] for r in described.select(F.explode("pivots").alias("p")).groupBy("p").count().collect()}  # a number for each pivot
    rank = np.full(wanted, 0, np.int64)
    rank[sorted(range(wanted), key=lambda p: (use.get(p, 0), p))] = np.arange(wanted)
    by_rank = np.zeros(wanted, np.int64)
    for p, c in use.items():
        by_rank[rank[p]] = c
    plan = spark.sparkContext.broadcast((rank, np.maximum(1, -(-by_rank // block))))
    prefix = k - need + 1

    def post(batches: Iterator[pa.RecordBatch], most: int = 8192) -> Iterator[pa.RecordBatch]:
        ranks, blocks = plan.value
        for batch in batches:
            own = np.sort(ranks[np.array(batch.column("pivots").to_pylist(), np.int64).reshape(len(batch), k)], axis=1).astype("<i4")
            mixed = (batch.column("rep").to_numpy() * np.int64(-7046029254386353131)) >> 20
            lists = own[:, :prefix].ravel()
            row, n = np.repeat(np.arange(len(batch)), prefix), blocks[lists]
            mine, ends = mixed[row] % n, np.cumsum(n)
            for low in range(0, int(ends[-1]) if len(ends) else 0, most):  # so many copies of vectors at once
                copy = np.arange(low, min(low + most, int(ends[-1])))
                at = np.searchsorted(ends, copy, "right")
                other, side = copy - (ends[at] - n[at]), mine[at]
                chosen, of = batch.take(pa.array(row[at], pa.int64())), own[row[at]]
                described_by = pa.array([o.tobytes() for o in of], pa.binary())
                yield pa.RecordBatch.from_arrays([pa.array(lists[at], pa.int32()), pa.array(np.minimum(side, other).astype(np.int32)), pa.array(np.maximum(side, other).astype(np.int32)), pa.array(side.astype(np.int32)), chosen.column(0), chosen.column(1), chosen.column(2), described_by], names=["list", "low", "high", "side", "rep", "n", "x", "own"])

    def verify(group: pa.Table) -> pa.Table:
        here, low, high = group.column("list")[0].as_py(), group.column("low")[0].as_py(), group.column("high")[0].as_py()
        side, reps, n = (group.column(c).to_numpy() for c in ("side", "rep", "n"))
        x, own = matrix(group.column("x")), np.frombuffer(b"".join(group.column("own").to_pylist()), "<i4").reshape(len(reps), -1)
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
        found_i, found_j = [], []
        for s in range(0, len(a), 512):
            rows_ = a[s : s + 512]
            near = (x[rows_] @ x[b].T) / (norm[rows_][:, None] * norm[b][None, :]) >= cosine
            i, j = np.nonzero(near)
            i, j = rows_[i], b[j]
            if low == high:
                i, j = i[i < j], j[i < j]
            for t in range(0, len(i), 50_000):
                ii, jj = i[t : t + 50_000], j[t : t + 50_000]
                both = (own[ii][:, :, None] == own[jj][:, None, :]).any(axis=2)
                first = np.where(both, own[ii], np.iinfo(np.int32).max).min(axis=1)
                ok = (both.sum(axis=1) >= need) & (first == here)
                found_i.append(ii[ok]), found_j.append(jj[ok])
        i, j = (np.concatenate(f).astype(np.int64) if f else np.empty(0, np.int64) for f in (found_i, found_j))
        links = np.bincount(i, n[j], len(reps)) + np.bincount(j, n[i], len(reps)) if len(i) else np.zeros(len(reps))
        lab = reps.copy()
        while len(i):
            new = lab.copy()
            np.minimum.at(new, i, lab[j])
            np.minimum.at(new, j, lab[i])
            if (new == lab).all():
                break
            lab = new
        touched = links > 0
        return pa.table({"rep": pa.array(reps[touched], pa.int64()), "links": pa.array(links[touched].astype(np.int64)), "root": pa.array(lab[touched], pa.int64())})

    def verify_all(group: pa.Table) -> pa.Table:
        low, high = group.column("low")[0].as_py(), group.column("high")[0].as_py()
        side, reps, n = (group.column(c).to_numpy() for c in ("side", "rep", "n"))
        x = matrix(group.column("x"))
        norm = np.sqrt(np.einsum("ij,ij->i", x, x))
        a, b = np.flatnonzero(side == low), np.flatnonzero(side == high)
        near = np.zeros((len(a), len(b)), bool)
        links = np.zeros(len(reps))
        for s in range(0, len(a), 512):
            rows_ = a[s : s + 512]
            part = (x[rows_] @ x[b].T) / (norm[rows_][:, None] * norm[b][None, :]) >= cosine
            if low == high:
                part[np.arange(len(rows_)), np.arange(s, s + len(rows_))] = False
            near[s : s + 512] = part
            links[rows_] += part @ n[b].astype(float)
            if low != high:
                links[b] += n[rows_].astype(float) @ part
        lab = reps.copy()
        while near.any():
            before, most = lab.copy(), np.iinfo(np.int64).max
            for s in range(0, len(a), 512):
                rows_, part = a[s : s + 512], near[s : s + 512]
                lab[rows_] = np.minimum(lab[rows_], np.where(part, lab[b][None, :], most).min(axis=1))
                lab[b] = np.minimum(lab[b], np.where(part, lab[rows_][:, None], most).min(axis=0))
            if (lab == before).all():
                break
        touched = links > 0
        return pa.table({"rep": pa.array(reps[touched], pa.int64()), "links": pa.array(links[touched].astype(np.int64)), "root": pa.array(lab[touched], pa.int64())})

    posted = described.mapInArrow(post, "list int, low int, high int, side int, rep long, n long, x binary, own binary")
    sparse_links = posted.groupBy("list", "low", "high").applyInArrow(verify, "rep long, links long, root long")
    dense_links = dense.groupBy("p", "low", "high").applyInArrow(verify_all, "rep long, links long, root long")
    found = written(sparse_links.union(dense_links), "links")
    comps = connected_components(found.where("root < rep").select(F.col("root").alias("a"), F.col("rep").alias("b")))
    counts = found.groupBy("rep").agg(F.sum("links").alias("links"))
    summary = classes.join(counts, "rep", "left").join(comps.withColumnRenamed("node", "rep"), "rep", "left")
    summary = summary.select("v", (F.coalesce("links", F.lit(0)) + F.col("n") - 1).alias("links"), F.coalesce("component", "rep").alias("comp"))
    linked = rows.join(summary, "v").select("vec_id", "links", "comp").where("links > 0")
    # A vec_id given to several vectors: the links of each row are its own vector's.
    alone = rows.join(summary.where("links = 0").select("v"), "v", "left_semi").select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("comp"))
    invalid = embeddings.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"))
    size = points.shape[1]
    good = F.expr(f"vec_id is not null and size(v) = {size} and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x != 0)")
    rest = invalid.where(~F.coalesce(good, F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("links"), F.col("vec_id").alias("comp"))
    out = linked.union(alone).union(rest)
    return out.select("vec_id", F.col("links").cast("long").alias("n_links"), F.col("comp").alias("component_id"), F.coalesce(F.col("vec_id") == F.col("comp"), F.lit(False)).alias("kept"))

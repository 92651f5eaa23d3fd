"""SimHash near-duplicates by covering locality-sensitive hashing.

A document's fingerprint has 64 bits, each the majority of that bit over the hashes of its word shingles. To find all
pairs within ``radius`` bits, every bit position gets a non-zero vector of radius + 1 bits; table v (one for each
non-zero vector) masks the positions whose vector has an odd product with v. Two fingerprints that differ in at most
``radius`` positions agree under at least one mask, since at most ``radius`` linear conditions leave a non-zero v.
So no pair within the radius is ever missed, and candidates only have to be verified.

Documents that share four fifths of their shingles differ in some ten bits, which no number of masks that is of use can
cover. Where such near copies are wanted too, a document is cut by its own content into segments of some shingles, each
with a fingerprint of its own; near copies share most of them. Of the documents that share a segment, those that share
most of all their segments stand in the middle of a group, so each document is compared with these, by the exact
similarity of the shingle sets.
"""

from __future__ import annotations

import random
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SPACE, map_in_python, written
from .components import connected_components

BITS = 64


def covering_masks(radius: int, seed: int = 7) -> list[int]:
    """The 2**(radius + 1) - 1 masks, as unsigned 64-bit numbers."""
    size = 1 << (radius + 1)
    vectors = [1 + k % (size - 1) for k in range(BITS)]
    random.Random(seed).shuffle(vectors)
    return [sum(1 << i for i, m in enumerate(vectors) if bin(v & m).count("1") % 2) for v in range(1, size)]


def signed(x: int) -> int:
    return x - (1 << 64) if x >= 1 << 63 else x


def word_runs(data: bytes, words: int, most: int = 1 << 20) -> Iterator[tuple[list[bytes], int]]:
    """(words, shingles that begin in them) of a text in runs of about ``most`` bytes that overlap by ``words`` - 1 words."""
    at, before = 0, []
    while at < len(data):
        gap = SPACE.search(data, at + most)
        end = gap.start() if gap else len(data)
        run = before + data[at:end].split()
        before, at = run[-(words - 1) :] if words > 1 else [], end
        if run:
            yield run, len(run) - words + 1


def shingle_hashes(text: str | None, words: int, seed: int) -> Iterator[np.ndarray]:
    """XXH64 of every shingle of a text in order, a run of the text at a time; of all words if they are too few."""
    from xxhash import xxh64_intdigest

    data, few = (text or "").encode("utf-8", "surrogatepass").lower(), []  # bytes: A-Z only, and ASCII white space below
    for few, shingles in word_runs(data, words):
        if shingles <= 0:
            continue
        joined = b" ".join(few)
        ends = np.cumsum(np.fromiter(map(len, few), np.int64, len(few)) + 1) - 1
        starts = np.concatenate(([0], ends[:-1] + 1))
        yield np.array([xxh64_intdigest(joined[i:j], seed) for i, j in zip(starts[:shingles].tolist(), ends[words - 1 :].tolist(), strict=True)], "<u8")
    if 0 < len(few) < words:
        yield np.array([xxh64_intdigest(b" ".join(few), seed)], "<u8")


def bits_of(hashes: np.ndarray) -> np.ndarray:
    return np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def majority(sums: np.ndarray, n: np.ndarray | int) -> np.ndarray:
    """The fingerprints of sums of bits over ``n`` hashes."""
    return np.packbits(2 * sums > np.asarray(n)[..., None], axis=-1, bitorder="little").view("<u8")[..., 0]


def described(text: str | None, words: int, seed: int, length: int | None = None) -> tuple[int, dict[int, int], int]:
    """(unsigned fingerprint, shingles by fingerprint of a segment, shingles in all) of a text, hashed run by run.

    A segment begins where a hash is divisible by ``length``; without one there are none. The fingerprint is zero for
    null or a text without words.
    """
    total, n, found = np.zeros(BITS, np.int64), 0, {}
    for h in shingle_hashes(text, words, seed):
        for at in range(0, len(h), 1 << 15):
            part = h[at : at + (1 << 15)]
            bits = bits_of(part)
            n += len(part)
            if length is None:
                total += bits.sum(axis=0, dtype=np.int64)
                continue
            starts = np.unique(np.concatenate(([0], np.flatnonzero(part % np.uint64(length) == 0))))
            sizes, sums = np.diff(np.append(starts, len(part))), np.add.reduceat(bits, starts, axis=0, dtype=np.int64)
            total += sums.sum(axis=0)
            for key, size in zip(majority(sums, sizes).tolist(), sizes.tolist(), strict=True):
                found[key] = found.get(key, 0) + size
    return int(majority(total, n)) if n else 0, found, n


def fingerprint(text: str | None, words: int = 3, seed: int = 42) -> int:
    return described(text, words, seed)[0]


def similarity_of(a: str | None, b: str | None, words: int, seed: int) -> float:
    """Shared part of the shingles of two texts."""
    x, y = (set().union(*(h.tolist() for h in shingle_hashes(t, words, seed))) for t in (a, b))
    return len(x & y) / len(x | y) if x or y else 1.0


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, seed: int = 42, length: int | None = None) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed long; a row for each row, nulls and repeats included.

    With a ``length``, also ``n``, the text's shingles, and ``segments`` of about that many, as (key, w).
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [described(t.as_py(), words, seed, length) for t in batch.column(1)]
            columns = {"doc_id": batch.column(0), "fp": pa.array([signed(g[0]) for g in got], pa.int64())}
            if length is not None:
                columns["n"] = pa.array([g[2] for g in got], pa.int64())
                columns["segments"] = pa.array([[{"key": signed(k), "w": w} for k, w in g[1].items()] for g in got], pa.list_(pa.struct([("key", pa.int64()), ("w", pa.int64())])))
            yield pa.RecordBatch.from_pydict(columns)

    schema = "doc_id long, fp long" + ", n long, segments array<struct<key:long,w:long>>" * (length is not None)
    return map_in_python(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, schema)


def near_copies(segments: DataFrame, texts: DataFrame, words: int = 5, similarity: float = 0.8, hubs: int = 4, least_shared: float = 0.15, seed: int = 42) -> DataFrame:
    """Links (a, b) between texts (node, text) whose shingle sets are alike by ``similarity`` or more.

    ``segments`` has (node, key, w, n), each node and key once. Every text is compared with the ``hubs`` texts of each of
    its segments that share most of their own segments, the smallest nodes first, if they share ``least_shared`` of its
    shingles in such segments and sizes allow the similarity. So the work is linear in the texts, however many share a
    segment. A link is always true; one is missed where two texts share no whole segment, or where more than ``hubs`` other
    texts stand before both in all that they share, and then the group holds together if they are linked with one of
    those. Of several texts of a node the least counts.
    """
    # Written tables on one side let Spark split a frequent key of the other side when it joins.
    shared = written(segments.groupBy("key").agg(F.count("*").alias("c")).where("c > 1").select("key"), "shared-keys")
    met = written(segments.join(shared, "key"), "shared-segments")
    covered = met.groupBy("node").agg((F.sum("w") / F.max("n")).alias("covered"))
    best = Window.partitionBy("key").orderBy(F.desc("covered"), "hub")
    middle = met.select(F.col("node").alias("hub"), "key", F.col("n").alias("m")).join(covered.withColumnRenamed("node", "hub"), "hub")
    middle = written(middle.withColumn("r", F.row_number().over(best)).where(F.col("r") <= hubs).select("key", "hub", "m"), "hubs")
    pairs = met.join(middle, "key").where((F.col("node") != F.col("hub")) & (F.least("n", "m") >= F.greatest("n", "m") * similarity * 0.9))  # repeated shingles count in n
    pairs = pairs.groupBy(F.least("node", "hub").alias("a"), F.greatest("node", "hub").alias("b"), "key").agg(F.min("w").alias("w"), F.max("n").alias("n"))
    pairs = written(pairs.groupBy("a", "b").agg(F.sum("w").alias("w"), F.max("n").alias("n")).where(F.col("w") >= least_shared * F.col("n")).select("a", "b"), "candidates")
    wanted = pairs.select(F.col("a").alias("node")).union(pairs.select("b")).distinct()
    own = written(texts.join(wanted, "node", "left_semi").groupBy("node").agg(F.min("text").alias("text")), "texts")
    both = pairs.join(own.select(F.col("node").alias("a"), F.col("text").alias("x")), "a").join(own.select(F.col("node").alias("b"), F.col("text").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = [similarity_of(x.as_py(), y.as_py(), words, seed) >= similarity for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return map_in_python(both.select("a", "b", "x", "y"), verify, "a long, b long")


def close_pairs(classes: DataFrame, radius: int = 2, pair_limit: int = 64) -> DataFrame:
    """Links (a, b) that connect all distinct fingerprints at most ``radius`` bits apart; ``classes`` is (node, fp).

    Buckets of up to ``pair_limit`` fingerprints are joined with themselves and verified. In a larger bucket the
    fingerprints differ in its unmasked bits only; there each one stands under every value that half the radius away
    flips of those bits give, and those that meet under a value are within the radius, so each is linked to the least
    of them. Pairs at an odd distance over an odd radius would not meet halfway, so only radius 2 and 0 take that way;
    others join buckets of any size. The work is linear in the size of a large bucket and loses nothing.
    """
    tables = [F.struct(F.lit(t).alias("t"), F.col("fp").bitwiseAND(F.lit(signed(m))).alias("key"), F.lit(signed(m)).alias("mask")) for t, m in enumerate(covering_masks(radius))]
    placed = classes.select("node", "fp", F.explode(F.array(*tables)).alias("x")).select("node", "fp", "x.*")
    sizes = placed.groupBy("t", "key").agg(F.count("*").alias("n")).where("n > 1")
    met = placed.join(sizes, ["t", "key"])
    small = met if radius not in (0, 2) else met.where(F.col("n") <= pair_limit)
    left, right = small.select("t", "key", F.col("node").alias("a"), F.col("fp").alias("fa")), small.select("t", "key", F.col("node").alias("b"), F.col("fp").alias("fb"))
    pairs = left.join(right, ["t", "key"]).where((F.col("a") < F.col("b")) & (F.bit_count(F.col("fa").bitwiseXOR(F.col("fb"))) <= radius)).select("a", "b")
    if radius != 2:
        return pairs.distinct()
    flips = [F.when(F.col("mask").bitwiseAND(F.lit(signed(1 << i))) == 0, F.col("fp").bitwiseXOR(F.lit(signed(1 << i)))) for i in range(BITS)]
    balls = met.where(F.col("n") > pair_limit).select("node", "t", F.explode(F.array(F.col("fp"), *flips)).alias("z")).where("z is not null")
    least = balls.groupBy("t", "z").agg(F.min("node").alias("a"), F.count("*").alias("n")).where("n > 1").drop("n")
    stars = balls.join(least, ["t", "z"]).where("a < node").select("a", F.col("node").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 3, radius: int = 2, pair_limit: int = 64, similarity: float | None = None, length: int = 16) -> DataFrame:
    """(doc_id, fp, component_id) for every row: the smallest doc_id reachable over links of at most ``radius`` bits.

    With a ``similarity``, links of ``near_copies`` between texts of different fingerprints count too, found by segments of
    about ``length`` shingles.

    Null texts and texts without words have fingerprint zero and are linked like any other; rows with a null doc_id
    take the component of their fingerprint, null if only such rows have it; repeated rows are returned as often as
    they occur; other columns are ignored; an empty table gives an empty table.
    """
    fps = written(fingerprints(docs, id_col, text_col, words, length=None if similarity is None else length), "simhash")
    classes = fps.where("doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("node"))
    # A doc_id given to different texts can stand for several fingerprints; such classes belong together.
    reps = classes.select("node", "fp")
    shared = fps.where("doc_id is not null").groupBy("doc_id").agg(F.min("fp").alias("lo"), F.max("fp").alias("hi")).where("lo < hi").select("doc_id")
    links = close_pairs(reps, radius, pair_limit)
    same = fps.join(shared, "doc_id").join(classes, "fp").where("node < doc_id").select(F.col("node").alias("a"), F.col("doc_id").alias("b"))
    links = links.union(same)
    if similarity is not None:
        text = docs.select(F.col(id_col).cast("long").alias("node"), F.col(text_col).cast("string").alias("text"))
        first = fps.select(F.col("doc_id").alias("node"), "fp", "n", "segments").join(reps, ["node", "fp"], "left_semi")
        rows = first.select("node", "n", F.inline("segments")).groupBy("node", "key").agg(F.max("w").alias("w"), F.max("n").alias("n"))
        links = links.union(near_copies(written(rows, "segments"), text, words, similarity))
    comps = connected_components(links)
    labels = classes.join(comps, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    return fps.join(labels, "fp", "left").select("doc_id", "fp", "component_id")

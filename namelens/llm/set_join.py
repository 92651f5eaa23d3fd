"""All pairs of texts whose shingle sets are alike, by prefixes of rare shingles, between groups that are known already.

Two sets of n and m shingles whose Jaccard similarity is s or more share at least s * n and s * m of them. So if each
set is put in one order, the first n - ceil(s * n) + 1 of one and the first of the other have a member in common. Any
order that all sets keep will do; here it is by how many shingles of all texts fall into a shingle's slot, a table of
fixed size, so that passages which very many texts share come last and the prefixes seldom hold them. Where copies are
many, they are grouped beforehand, and a prefix shingle that only one group has is left out, so that copies aren't
compared with each other. Only prefixes are shuffled.

What more than ``crowd`` texts still have in their prefixes is put last in the order, and the prefixes that held it are made
anew, as long as that helps; the others stay as they are, since nothing in them has moved. Where most of a text is frequent, as in
many copies of a text with some edits each, more than ``crowd`` texts of like size still meet. They aren't compared with
each other then but with one of them, the pivot: see ``crowded_pairs``.

Of a pair of candidates, sketches are compared first: how many
shingles of each set fall into each bucket, by which two sets have at most so many in common as the smaller counts add up
to. Whole sets are shuffled only of texts with a candidate that this bound leaves.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import map_in_python, written
from .components import connected_components
from .simhash import near_duplicates, shingle_hashes


def distinct_shingles(text: str | None, words: int, seed: int) -> np.ndarray:
    """The distinct XXH64 of a text's shingles in ascending order."""
    return np.unique(np.concatenate([np.zeros(0, "<u8"), *shingle_hashes(text, words, seed)]))


def digest_of(hashes: np.ndarray) -> bytes:
    return hashlib.sha256(hashes.tobytes()).digest()[:16]


def slot_counts(docs: DataFrame, words: int, seed: int, slots: int) -> np.ndarray:
    """How many shingles of all texts (doc_id, text) fall into each of ``slots`` slots; that many longs come to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(slots, np.int64)
        for batch in batches:
            for t in batch.column(1):
                for h in shingle_hashes(t.as_py(), words, seed):
                    total += np.bincount((h % np.uint64(slots)).astype(np.int64), minlength=slots)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_pydict({"slot": pa.array(some, pa.int64()), "c": pa.array(total[some], pa.int64())})

    out = np.zeros(slots, np.int64)
    for slot, c in map_in_python(docs, run, "slot long, c long").groupBy("slot").agg(F.sum("c")).collect():
        out[slot] = c
    return out


def sketch_of(hashes: np.ndarray) -> bytes:
    """How many hashes fall into each of a power of two of buckets, half as many as hashes or more; 255 stands for more too."""
    buckets = 1 << max(4, int(len(hashes) - 1).bit_length() - 1)
    counts = np.bincount((hashes & np.uint64(buckets - 1)).astype(np.int64), minlength=buckets)
    return np.minimum(counts, 255).astype(np.uint8).tobytes()


def most_common(a: bytes, b: bytes) -> int | None:
    """A number that the common hashes of two sets with these sketches can't exceed; None if a count was cut."""
    x, y = (np.frombuffer(t, np.uint8) for t in (a, b))
    if max(x.max(), y.max()) == 255:
        return None
    x, y = (t.astype(np.int64).reshape(-1, min(len(x), len(y))).sum(axis=0) for t in (x, y))
    return int(np.minimum(x, y).sum())


def code_of(h: Column) -> Column:
    """The first 24 bits of a shingle, by which it is called frequent."""
    return F.shiftrightunsigned(h, 40)


def frequent_bits(codes: DataFrame) -> np.ndarray:
    """The bits of a table of ``code``; at most 2**18 rows come to the driver, however many codes there are."""
    words = np.zeros(1 << 18, "<u8")
    bit = F.expr("shiftleft(1L, cast(code & 63 as int))")
    for word, bits in codes.groupBy(F.shiftright("code", 6)).agg(F.bit_or(bit)).collect():
        words[word] = bits % (1 << 64)
    return words


def first_of(s: np.ndarray, counts: np.ndarray, frequent: np.ndarray, similarity: float) -> np.ndarray:
    """The prefix of a set: frequent shingles are last in the order, the others by their slots' counts."""
    length = len(s) - int(np.ceil(len(s) * similarity - 1e-9)) + 1
    last = frequent[(s >> np.uint64(46)).astype(np.int64)] >> (s >> np.uint64(40) & np.uint64(63)) & np.uint64(1)
    return s[np.lexsort((s, counts[(s % np.uint64(len(counts))).astype(np.int64)], last))[:length]]


def prefixes(docs: DataFrame, counts: np.ndarray, words: int, similarity: float, seed: int, frequent: np.ndarray | None = None) -> DataFrame:
    """(doc_id, digest, n, prefix, sketch) of every text with a word: a digest, the size, the prefix and the sketch of its shingle set."""
    bits = np.zeros(1 << 18, "<u8") if frequent is None else frequent

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for at, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                s = distinct_shingles(t.as_py(), words, seed)
                if len(s):
                    rows.append((at, digest_of(s), len(s), first_of(s, counts, bits, similarity).view("<i8"), sketch_of(s)))
            columns = list(zip(*rows, strict=True)) or [(), (), (), (), ()]
            kinds = (pa.int64(), pa.binary(), pa.int64(), pa.list_(pa.int64()), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["doc_id", "digest", "n", "prefix", "sketch"])

    return map_in_python(docs, run, "doc_id long, digest binary, n long, prefix array<long>, sketch binary")


def rare_places(docs: DataFrame, own: DataFrame, reps: DataFrame, counts: np.ndarray, words: int, similarity: float, seed: int, crowd: int) -> tuple[DataFrame, DataFrame]:
    """(doc_id, grp, h), the prefixes of the texts that take part, in an order that puts last what crowds them, and the
    shingles that several groups have in them, (h, large); it goes on while each time at most half as many texts move."""
    groups = reps.select(F.col("node").alias("doc_id"), "grp")
    spread = lambda p: p.join(groups, "doc_id").select("doc_id", "grp", F.explode("prefix").alias("h"))
    placed, codes, bits, before = written(spread(own), "prefixes"), None, None, None
    while True:
        keys = placed.groupBy("h").agg(F.count("*").alias("c"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi")
        keys = written(keys.select("h", (F.col("c") > crowd).alias("large")), "open-prefixes")
        new = keys.where("large").select(code_of(F.col("h")).alias("code")).distinct()
        new = written(new if codes is None else new.join(codes, "code", "left_anti"), "frequent")
        moved = written(placed.withColumn("code", code_of(F.col("h"))).join(new, "code", "left_semi").select("doc_id").distinct(), "moved")
        count = moved.count()
        if not count or before is not None and count > before / 2:
            return placed, keys
        before = count
        codes = new if codes is None else codes.union(new)
        bits = frequent_bits(new) if bits is None else bits | frequent_bits(new)
        again = spread(prefixes(docs.join(moved, "doc_id", "left_semi"), counts, words, similarity, seed, bits))
        placed = written(placed.join(moved, "doc_id", "left_anti").union(again), "prefixes")


def whole_sets(docs: DataFrame, words: int, seed: int) -> DataFrame:
    """(doc_id, digest, hashes): the set of every text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [distinct_shingles(t.as_py(), words, seed) for t in batch.column(1)]
            columns = [batch.column(0), pa.array(map(digest_of, sets), pa.binary()), pa.array([x.view("<i8") for x in sets], pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "digest", "hashes"])

    return map_in_python(docs, run, "doc_id long, digest binary, hashes array<long>")


def within_bound(pairs: DataFrame, own: DataFrame, similarity: float) -> DataFrame:
    """The ``pairs`` (node_a, node_b, grp_a, grp_b) whose sets can be alike by ``similarity`` as far as their sketches tell."""
    x, y = (own.select(F.col("doc_id").alias(f"node_{s}"), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"sketch_{s}")) for s in "ab")
    both = pairs.join(x, "node_a").join(y, "node_b").select("node_a", "node_b", "grp_a", "grp_b", "n_a", "n_b", "sketch_a", "sketch_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for n, m, a, b in zip(*(batch.column(k).to_pylist() for k in range(4, 8)), strict=True):
                most = most_common(a, b)
                ok.append(most is None or most >= (n + m) * similarity / (1 + similarity) - 1e-6)
            yield batch.select([0, 1, 2, 3]).filter(pa.array(ok, pa.bool_()))

    return map_in_python(both, run, "node_a long, node_b long, grp_a long, grp_b long").distinct()


def crowded_pairs(members: DataFrame, sets: DataFrame, similarity: float) -> tuple[DataFrame, DataFrame]:
    """(links, pairs): links (a, b) of groups that are alike, and what else must be compared, (node_a, node_b, grp_a, grp_b).

    ``members``: pivot, node, grp, where the pivot is one of its nodes. ``sets``: doc_id, digest, hashes of all nodes. Sets A
    and B are alike if at most c * (|A| + |B|) shingles are in one of them only, c = (1 - s) / (1 + s). Let D(A) be what is
    in only one of A and the pivot, and x(A) = |D(A)| - c * |A|. What A and B don't share is what D(A) and D(B) don't share,
    so they are alike if D(A) and D(B) share (x(A) + x(B)) / 2 or more. Where that is 0 or less, both are alike to the
    pivot, since sizes differ by |D| at most: so links to the pivot hold all of these together. Others share a member of
    the first |D| - t + 1 of D(A) and of D(B) with that t, rarest first, which are few: edits, not what copies have in common.
    """
    c, eps = (1 - similarity) / (1 + similarity), 1e-9
    one = sets.groupBy(F.col("doc_id").alias("pivot")).agg(F.min("hashes").alias("p"))
    rows = members.join(sets.withColumnRenamed("doc_id", "node"), "node").join(one, "pivot")
    rows = rows.withColumn("delta", F.concat(F.array_except("hashes", "p"), F.array_except("p", "hashes")))
    rows = rows.withColumns({"n": F.size("hashes"), "m": F.size("p"), "d": F.size("delta")})
    rows = written(rows.select("pivot", "node", "grp", "digest", "n", "m", "d", (F.col("d") - c * F.col("n")).alias("x"), "delta"), "deltas")
    common = (F.col("n") + F.col("m") - F.col("d")) / 2
    near = rows.where((common > 0) & (common / ((F.col("n") + F.col("m") + F.col("d")) / 2) >= similarity)).select("pivot", "grp")
    pivots = members.where("pivot = node").select("pivot", F.col("grp").alias("b")).distinct()
    links = written(near.join(pivots, "pivot").where("grp != b").select(F.col("grp").alias("a"), "b").distinct(), "pivot-links")
    joined = written(connected_components(links), "pivot-groups")
    rows = rows.join(joined.withColumnRenamed("node", "grp"), "grp", "left").withColumn("grp", F.coalesce("component", "grp"))
    tokens = written(rows.select("pivot", "node", "grp", "digest", "m", "d", "x", F.explode("delta").alias("h")), "delta-places")
    counts = tokens.groupBy("pivot", "h").agg(F.count("*").alias("f"), F.min("grp").alias("lo"), F.max("grp").alias("hi"))
    tokens = tokens.join(counts, ["pivot", "h"]).withColumn("at", F.row_number().over(Window.partitionBy("pivot", "node", "digest").orderBy("f", "h")))
    least = F.greatest(F.lit(1), F.ceil((F.col("x") - c * F.col("m")) / 2 - eps))
    tokens = tokens.where((F.col("at") <= F.col("d") - least + 1) & (F.col("lo") < F.col("hi")))
    tokens = written(tokens.select("pivot", "h", "node", "grp", "x", (F.col("d") - F.col("at") + 1).alias("left")), "delta-prefixes")
    a, b = (tokens.select("pivot", "h", *[F.col(k).alias(f"{k}_{s}") for k in ("node", "grp", "x", "left")]) for s in "ab")
    t = F.ceil((F.col("x_a") + F.col("x_b")) / 2 - eps)
    meet = (F.col("grp_a") < F.col("grp_b")) & (t >= 1) & (F.least("left_a", "left_b") >= t)
    return links, a.join(b, ["pivot", "h"]).where(meet).select("node_a", "node_b", "grp_a", "grp_b").distinct()


def similar_pairs(docs: DataFrame, own: DataFrame, reps: DataFrame, counts: np.ndarray, words: int, similarity: float, seed: int, crowd: int = 16) -> DataFrame:
    """(a, b) groups that links between texts whose sets are alike by ``similarity`` or more connect, and no others.

    ``docs``: doc_id, text. ``own``: their ``prefixes``. ``reps``: node, grp, lo_n, hi_n, the texts that take part by their
    doc_id, their group, and the least and largest size of a set under that id. A shingle in more than ``crowd`` prefixes is
    dealt by sizes, so that sets that can be alike meet in one part; parts with more than ``crowd`` texts have pivots. So
    all other joins make at most ``crowd`` rows for each row of a prefix.
    """
    placed, open_keys = rare_places(docs, own, reps, counts, words, similarity, seed, crowd)
    met = placed.join(open_keys, "h").select("h", "large", F.col("doc_id").alias("node")).distinct().join(reps, "node")
    step = max(float(-np.log(similarity)), 0.01) * 1.001  # sizes of like sets are less than one step apart
    part = lambda n: F.floor(F.log(n) / step)
    parts = F.when(F.col("large"), F.sequence(part("lo_n") - 1, part("hi_n"))).otherwise(F.array(F.lit(-9).cast("long")))
    met = written(met.select("h", F.explode(parts).alias("part"), "node", "grp", "lo_n", "hi_n"), "open-places")
    sizes = met.groupBy("h", "part").agg(F.count("*").alias("c"), F.min("grp").alias("lo"), F.max("grp").alias("hi")).where("lo < hi")
    sizes = written(sizes.select("h", "part", (F.col("c") > crowd).alias("crowded")), "open-parts")

    few = met.join(sizes.where("not crowded"), ["h", "part"])
    a, b = (few.select("h", "part", *[F.col(c).alias(f"{c}_{s}") for c in ("node", "grp", "lo_n", "hi_n")]) for s in "ab")
    fits = (F.col("grp_a") < F.col("grp_b")) & (F.col("hi_n_a") >= F.col("lo_n_b") * similarity - 1e-9) & (F.col("hi_n_b") >= F.col("lo_n_a") * similarity - 1e-9)
    met_pairs = a.join(b, ["h", "part"]).where(fits).select("node_a", "node_b", "grp_a", "grp_b")

    many = written(met.join(sizes.where("crowded"), ["h", "part"]).select("h", "part", "node", "grp"), "crowded-places")
    weight = many.groupBy("node").agg(F.count("*").alias("w"))  # texts in the middle have nothing rare in their prefixes
    pivot = many.join(weight, "node").groupBy("h", "part").agg((-F.max(F.struct("w", (-F.col("node")).alias("node"))).node).alias("pivot"))
    members = written(many.join(pivot, ["h", "part"]).select("pivot", "node", "grp").distinct(), "pivots")
    wanted = members.select(F.col("node").alias("doc_id")).distinct()
    sets = written(whole_sets(docs.join(wanted, "doc_id", "left_semi").distinct(), words, seed).where("size(hashes) > 0"), "crowded-sets")
    links, more = crowded_pairs(members, sets, similarity)

    met = written(met_pairs.union(more).distinct(), "set-pairs")
    pairs = written(within_bound(met, own, similarity), "close-set-pairs")
    wanted = pairs.select(F.col("node_a").alias("doc_id")).union(pairs.select("node_b")).distinct()
    sets = written(whole_sets(docs.join(wanted, "doc_id", "left_semi").distinct(), words, seed), "sets")
    x, y = (sets.select(F.col("doc_id").alias(f"node_{s}"), F.col("hashes").alias(f"hashes_{s}")) for s in "ab")
    both = pairs.join(x, "node_a").join(y, "node_b").withColumn("common", F.size(F.array_intersect("hashes_a", "hashes_b")))
    alike = F.col("common") / (F.size("hashes_a") + F.size("hashes_b") - F.col("common")) >= similarity
    return both.where((F.col("common") > 0) & alike).select(F.col("grp_a").alias("a"), F.col("grp_b").alias("b")).union(links).distinct()


def all_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, radius: int = 2, similarity: float = 0.8, seed: int = 42, slots: int = 1 << 16, crowd: int = 16) -> DataFrame:
    """(doc_id, component_id) for every row, as ``near_duplicates`` with a ``similarity``, but with no link missed.

    Its groups are found first; then all pairs of different groups are found whose texts' shingle sets are alike by
    ``similarity`` or more, and their groups united. Every distinct set takes part, also of texts with one fingerprint.
    ``slots`` only orders shingles, and ``crowd`` only says from how many texts on pivots are used: neither changes a result.

    Null texts and texts without words are one group, by their fingerprint of zero; rows with a null doc_id take the
    component of their fingerprint, null if only such rows have it; repeated rows are returned as often as they occur;
    other columns are ignored; an empty table gives an empty table.
    """
    found = written(near_duplicates(docs, id_col, text_col, words, radius, similarity=similarity), "groups")
    plain = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("doc_id is not null")
    counts = slot_counts(plain, words, seed, slots)
    own = written(prefixes(plain, counts, words, similarity, seed), "shingle-prefixes")
    groups = found.where("doc_id is not null").groupBy("doc_id").agg(F.min("component_id").alias("grp"))
    placed = written(own.select("doc_id", "digest", "n").distinct().join(groups, "doc_id"), "placed-sets")
    least = placed.groupBy("digest").agg(F.min("grp").alias("lo"), F.max("grp").alias("hi"), F.min("doc_id").alias("node"), F.first("n").alias("n"))
    same = placed.join(least.where("lo < hi"), "digest").where("lo < grp").select(F.col("lo").alias("a"), F.col("grp").alias("b"))
    reps = written(least.groupBy("node").agg(F.min("lo").alias("grp"), F.min("n").alias("lo_n"), F.max("n").alias("hi_n")), "sets-of-groups")
    joined = connected_components(same.union(similar_pairs(plain, own, reps, counts, words, similarity, seed, crowd)))
    out = found.join(joined.select(F.col("node").alias("component_id"), "component"), "component_id", "left")
    return out.select("doc_id", F.coalesce("component", "component_id").alias("component_id"))

"""Manifests and exact copies against plain Python, and their SQL."""

import hashlib
import math
import random
import re
import zlib
from collections import defaultdict

import duckdb
import pytest
from pyspark.sql import functions as F

from namelens.llm import exact_dedup, merkle, queries

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def encoded(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def tree(hashes):
    """All levels of a tree, its root's last."""
    levels = [hashes]
    while len(levels[-1]) > 1:
        levels.append([sha("".join(levels[-1][k : k + 8])) for k in range(0, len(levels[-1]), 8)])
    return levels


def path(levels, i):
    for level in levels[:-1]:
        begin = i // 8 * 8
        yield "".join(level[begin:i]), "".join(level[i + 1 : begin + 8])
        i //= 8


def proved(rows):
    """What the manifest holds of documents, by brute force."""
    lower = lambda t: None if t is None else re.sub("[A-Z]", lambda m: m.group().lower(), t)
    leaf = lambda r, text: sha("".join(map(encoded, (r[0], r[3], r[2], r[4], text))))
    trees = defaultdict(list)
    for r in rows:
        trees[r[2]].append((r[0] is not None, r[0] or 0, leaf(r, r[1]), r))
    names = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    built = {n: tree([x[2] for x in sorted(trees[n], key=lambda x: x[:3])]) for n in names}
    over = tree([built[n][-1][0] for n in names])
    out = []
    for k, n in enumerate(names):
        for i, (_, _, own, r) in enumerate(sorted(trees[n], key=lambda x: x[:3])):
            steps = [*path(built[n], i), *path(over, k)]
            h = leaf(r, lower(r[1])) if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 3 == 0 else own
            for left, right in steps:
                h = sha(left + h + right)
            out.append((r[0], own, built[n][-1][0], over[-1][0], sha("".join(a + b for a, b in steps)), h, h == over[-1][0]))
    return out


def some_rows():
    rng = random.Random(2)
    text = lambda k: None if k % 17 == 3 else "" if k % 19 == 4 else " ".join(rng.choices(["The", "été", "b", "\n", "Ä"], k=k % 30))
    rows = [(k * 7919 % 5000, text(k), ["en", "fr", None, "é", "EN"][min(4, k % 11)] if k % 2 else "en", None if k % 5 == 0 else "s", k if k % 3 else None) for k in range(1300)]
    return rows + [rows[4]] * 3 + [(None, "x", "en", None, 1), (None, None, None, None, None), (9999, "alone A", "zz", "s", 7)]


def write(spark, rows, where):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("row", "tree", "digest", "n", "kept", "salt", "rank", "hash", "item"):
        df = df.withColumn(name, F.lit(name))
    df.repartition(5).write.parquet(f"{where}/documents.parquet")
    return str(where)


def same(spark, name, where, want):
    got = sorted(map(repr, map(tuple, queries.QUERIES[name](spark, where).collect())))
    assert got == sorted(map(repr, want))
    return got


@pytest.mark.parametrize("n_trees", [1, 9, 70])
def test_op12(spark, tmp_path, n_trees):
    rows = some_rows() if n_trees == 9 else [(k, f"T{k}", f"lang {k % n_trees}", "s", 2) for k in range(n_trees * 9)]
    same(spark, "op12_merkle_manifest", write(spark, rows, tmp_path), proved(rows))


def test_op12_of_a_tree_of_many_blocks(spark, monkeypatch):
    monkeypatch.setattr(merkle, "HEIGHT", 1)
    rows = [(k, f"T{k}", "en" if k % 9 else "fr", "s", 2) for k in range(700)]
    leaves = spark.createDataFrame([(r[2], r[0], *[sha("".join(map(encoded, (r[0], r[3], r[2], r[4], r[1]))))] * 2) for r in rows], "tree string, id long, leaf string, altered string")
    got = sorted((r.id, r.leaf, r.subroot, r.root, r.proof) for r in merkle.manifest(leaves).collect())
    assert got == sorted(x[:5] for x in proved(rows)) and merkle.manifest(leaves).where("folded != root").count() == 0


def test_op12_of_few_rows(spark, tmp_path):
    assert queries.op12_merkle_manifest(spark, write(spark, [], tmp_path / "none")).count() == 0
    one = [(5, None, None, None, None)]
    same(spark, "op12_merkle_manifest", write(spark, one, tmp_path / "one"), proved(one))


def test_digests_stand_for_bytes(spark):
    assert spark.range(1).select(merkle.leaf(F.lit("é"), F.lit(None).cast("string"), F.lit(12))).first()[0] == sha("2:é-2:12")


def groups(rows):
    held = defaultdict(list)
    for k, r in enumerate(rows):
        held[re.sub(r"[\x20\x09-\x0d]", "", r[1] or "")].append((-len(r[1] or ""), r[0] is None, r[0] or 0, k, r[0]))
    return [(m[4], min(g)[4], len(g), m is min(g), sha(plain)) for plain, g in held.items() for m in g]


def copied_rows():
    rng = random.Random(6)
    base = [" ".join(rng.choices(["a", "bé", "C", "𝒳"], k=rng.randrange(1, 6))) for _ in range(150)]
    rows = [(k, t + " " * rng.randrange(3), "en", "s", 1) for k, t in enumerate(rng.choices(base, k=600))]
    rows += [(1000 + k, "hot \t copy" + "\n" * (k % 4), "en", None, 1) for k in range(900)] + [(3000 + k, None if k % 2 else " \x0b", None, None, None) for k in range(40)]
    return rows + [(None, "hot copy", "en", "s", 1), (None, "only", "en", "s", 1), (7000, "bé" * 40_000, "en", "s", 1), (7001, "bé " * 40_000, "en", "s", 1)]


@pytest.mark.parametrize("digest", [exact_dedup.sha256, lambda c: F.substring(exact_dedup.sha256(c), 1, 1) == F.unhex(F.lit("00")), lambda c: F.lit(b"x")])
def test_op13(spark, tmp_path, digest):
    """Also with digests that agree by chance, often or always."""
    rows = copied_rows()
    docs = spark.read.parquet(write(spark, rows, tmp_path) + "/documents.parquet")
    as_binary = lambda c: digest(c).cast("string").cast("binary") if digest is not exact_dedup.sha256 else digest(c)
    got = exact_dedup.copies(docs, digest=as_binary)
    want = groups(rows)
    assert sorted(map(repr, map(tuple, got.drop("digest").collect()))) == sorted(repr(w[:4]) for w in want)
    if digest is exact_dedup.sha256:
        same(spark, "op13_exact_dedup", str(tmp_path), want)


def test_op13_keeps_one_of_repeated_rows(spark, tmp_path):
    got = queries.op13_exact_dedup(spark, write(spark, [(1, "a b", "en", "s", 1)] * 30 + [(2, "ab", "en", "s", 1)], tmp_path)).collect()
    assert len(got) == 31 and sum(r.kept for r in got) == 1 and {(r.keep_id, r.group_size) for r in got} == {(1, 31)}


def test_op13_of_an_empty_table(spark, tmp_path):
    assert queries.op13_exact_dedup(spark, write(spark, [], tmp_path)).count() == 0


@pytest.mark.parametrize("name", ["op12_merkle_manifest", "op13_exact_dedup"])
def test_sql(spark, name):
    con = duckdb.connect()
    con.execute("create view documents as select * from '/root/testdata/sf0.001/documents.parquet'")
    cur = con.execute(queries.ORACLE_SQL[name])
    columns = [d[0] for d in cur.description]
    df = queries.QUERIES[name](spark, "/root/testdata/sf0.001")
    assert sorted(columns) == sorted(df.columns) and math.isclose(df.count(), 200)
    assert sorted(map(repr, map(tuple, df.select(columns).collect()))) == sorted(map(repr, cur.fetchall()))

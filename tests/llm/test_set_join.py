"""Groups by shingle sets with no link missed, against all pairs."""

import random
import time

import numpy as np
from pyspark.sql import functions as F

from namelens.llm.common import shuffles_removed, written
from namelens.llm import set_join
from namelens.llm.set_join import all_near_duplicates, most_common, prefixes, rare_places, sketch_of, within_bound
from namelens.llm.simhash import near_duplicates, similarity_of


def groups(rows):
    of = {}
    for r in rows:
        of.setdefault(r.component_id, set()).add(r.doc_id)
    return sorted(sorted(g) for g in of.values())


def brute(texts, start, similarity=0.8):
    root = {i: i for i, _ in texts}

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    def unite(a, b):
        a, b = sorted((top(a), top(b)))
        root[b] = a

    for g in start:
        for i in g:
            unite(g[0], i)
    for k, (i, x) in enumerate(texts):
        for j, y in texts[:k]:
            if similarity_of(x, y, 5, 42) >= similarity:
                unite(i, j)
    return sorted(sorted(i for i, _ in texts if top(i) == r) for r in {top(i) for i, _ in texts})


def edited(rng, words, edits):
    words = list(words)
    for _ in range(edits):
        words[rng.randrange(len(words))] = rng.choice("red blue green grey pink".split()) + str(rng.randrange(99))
    return words


def test_no_link_is_missed(spark):
    rng = random.Random(5)
    vocab = [f"w{k}" for k in range(400)]
    passage = rng.choices(vocab, k=60)
    texts = []
    for g in range(30):
        base = rng.choices(vocab, k=rng.randrange(20, 140))
        if g % 3 == 0:
            base = passage + base  # a passage that many texts share and that alone makes no copies
        for _ in range(rng.randrange(1, 7)):
            texts.append((len(texts), " ".join(edited(rng, base, rng.randrange(0, 3)))))
    df = spark.createDataFrame(texts, "doc_id long, text string")
    quick = groups(near_duplicates(df, words=5, similarity=0.8).collect())
    whole = groups(all_near_duplicates(df).collect())
    assert whole == brute(texts, quick)
    assert len(whole) < len(quick)  # some of these short texts have no whole segment in common


def test_chains_and_one_large_group(spark):
    rng = random.Random(6)
    base = [f"v{k}" for k in range(300)]
    texts, now = [], base
    for i in range(25):
        now = edited(rng, now, 2)
        texts.append((1000 - i, " ".join(now)))
    texts += [(2000 + i, " ".join(edited(rng, base, 3))) for i in range(60)]
    df = spark.createDataFrame(texts, "doc_id long, text string").repartition(7)
    quick = groups(near_duplicates(df, words=5, similarity=0.8).collect())
    assert groups(all_near_duplicates(df, slots=3).collect()) == brute(texts, quick)


def test_nulls_repeats_short_texts_and_other_columns(spark):
    a = " ".join(f"a{k}" for k in range(50))
    rows = [(1, a, 0), (1, a, 0), (2, a + " end", 0), (3, None, 1), (4, "", 1), (5, " \t", 1), (6, "one two", 1), (7, "ONE two", 1), (None, a, 2), (None, "nowhere else", 2), (8, "a0 a1", 3), (9, a.upper(), 3), (10, a + " " + a, 3)]
    df = spark.createDataFrame(rows, "doc_id long, text string, component_id int").selectExpr("*", "1 as h", "2 as node", "3 as grp")
    got = sorted(((r.doc_id, r.component_id) for r in all_near_duplicates(df).collect()), key=str)
    assert got == sorted([(1, 1), (1, 1), (2, 1), (3, 3), (4, 3), (5, 3), (6, 6), (7, 6), (None, 1), (None, None), (8, 8), (9, 1), (10, 1)], key=str)


def test_empty_table(spark):
    assert all_near_duplicates(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_sketches_bound_what_sets_have_in_common():
    rng = np.random.default_rng(3)
    for n, m, shared in [(40, 45, 38), (300, 310, 290), (1000, 1200, 900), (5000, 5100, 0), (1, 1, 1), (700, 2000, 650)]:
        drawn = np.unique(rng.integers(0, 1 << 64, 2 * (n + m), dtype=np.uint64))
        rng.shuffle(drawn)
        a, b = np.sort(drawn[:n]), np.sort(np.concatenate([drawn[:shared], drawn[n : n + m - shared]]))
        most = most_common(sketch_of(a), sketch_of(b))
        assert len(np.intersect1d(a, b)) <= most <= min(n, m)
    assert most < 700 and most_common(sketch_of(drawn[:1000]), sketch_of(drawn[1000:2000])) < 880  # 889 in common would be alike by 0.8
    assert most_common(sketch_of(np.arange(1000, dtype=np.uint64) << np.uint64(20)), sketch_of(drawn[:1000])) is None  # a cut count tells nothing


def test_whole_sets_only_of_pairs_that_sketches_leave(spark):
    rng = random.Random(8)
    vocab, passage = [f"w{k}" for k in range(4000)], [f"p{k}" for k in range(30)]
    texts = [(k, " ".join(passage + rng.choices(vocab, k=90))) for k in range(40)] + [(100, " ".join(vocab[:120])), (101, " ".join(vocab[:117] + ["x"]))]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    own = prefixes(docs, np.ones(16, np.int64), 5, 0.8, 42)
    pairs = spark.createDataFrame([(a, b, a, b) for a, _ in texts for b, _ in texts if a < b], "node_a long, node_b long, grp_a long, grp_b long")
    assert [(r.node_a, r.node_b) for r in within_bound(pairs, own, 0.8).collect()] == [(100, 101)]


def test_written_tables_leave_no_shuffle_files(spark):
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before, seen = spark.conf.get(key), []
    with shuffles_removed(spark):
        seen.append(spark.conf.get(key))
    assert seen == ["true"] and spark.conf.get(key) == before
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
    held = lambda: {x.rsplit("/", 1)[-1] for x in blocks.getAllFiles().mkString("\n").split("\n") if "/shuffle_" in x}
    old = held()
    table = written(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "counts")
    for _ in range(50):  # files go a little later
        if not held() - old:
            break
        time.sleep(0.1)
    assert not held() - old
    assert sum(r["count"] for r in table.collect()) == 1000


def compared(spark, monkeypatch, texts, **how):
    """(groups, pairs of texts that were compared by their sketches) of texts that are each a group at first."""
    rows = {}

    def noted(df, label):
        rows[label] = (out := written(df, label)).count()
        return out

    monkeypatch.setattr(set_join, "written", noted)
    monkeypatch.setattr(set_join, "near_duplicates", lambda docs, *a, **k: docs.selectExpr("doc_id", "doc_id as component_id"))
    got = groups(all_near_duplicates(spark.createDataFrame(texts, "doc_id long, text string"), **how).collect())
    return got, rows["set-pairs"]


def test_many_edited_copies_are_compared_with_a_pivot(spark, monkeypatch):
    rng = random.Random(12)
    base = [f"v{k}" for k in range(150)]
    texts = [(k, " ".join(edited(rng, base, rng.choice((0, 1, 2, 3, 4, 4, 5, 6))))) for k in range(240)]
    got, pairs = compared(spark, monkeypatch, texts)
    assert got == brute(texts, []) and len(got) > 1
    assert pairs < 3000  # of 28,680; those with few edits are linked to the pivot, and others share an edit or are not alike


def test_crowds_change_no_result(spark, monkeypatch):
    rng = random.Random(13)
    vocab, passages = [f"w{k}" for k in range(300)], [[f"p{j}.{k}" for k in range(40)] for j in range(4)]
    texts = []
    for k in range(90):
        parts = rng.sample(passages, rng.randrange(1, 4)) + [rng.choices(vocab, k=rng.randrange(0, 12))]
        texts.append((k, " ".join(edited(rng, sum(parts, []), rng.randrange(0, 5)))))
    want = brute(texts, [])
    assert 1 < len(want) < 90
    for crowd in (1, 3, 1000):
        assert compared(spark, monkeypatch, texts, crowd=crowd)[0] == want


def test_passages_of_many_texts_leave_prefixes(spark):
    rng = random.Random(14)
    passage = [f"p{k}" for k in range(40)]
    texts = [(k, " ".join([f"t{k}.{j}" for j in range(60)] + passage + rng.choices("abc", k=3))) for k in range(50)]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    flat = np.ones(16, np.int64)  # an order that knows nothing of frequencies
    own = prefixes(docs, flat, 5, 0.8, 42)
    placed, keys = rare_places(docs, own, docs.selectExpr("doc_id as node", "doc_id as grp"), flat, 5, 0.8, 42, 16)
    crowded = lambda p: p.groupBy("h").count().where("count > 16").agg(F.sum("count")).first()[0] or 0
    assert crowded(placed) <= crowded(own.select(F.explode("prefix").alias("h"))) / 2
    assert sorted(r["count"] for r in placed.groupBy("doc_id").count().collect()) == sorted(len(r.prefix) for r in own.collect())

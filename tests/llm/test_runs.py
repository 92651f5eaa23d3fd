"""Runs of words against a search over all periods."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from namelens.llm import queries, runs


def by_search(words):
    """All runs of a list of words, by trying every period."""
    found = {}
    for q in range(1, len(words) // 4 + 1):
        at = 0
        while at < len(words) - q:
            end = at
            while end < len(words) - q and words[end] == words[end + q]:
                end += 1
            length = end + q - at
            if length >= max(6, 4 * q):
                found.setdefault((at, length), q)
            at = max(end, at + 1)
    return sorted((s, n, q) for (s, n), q in found.items())


def some_texts():
    rng = random.Random(3)
    texts = [[], ["a"], ["a"] * 5, ["a"] * 6, ["a"] * 1000, list("abababab"), list("abababa"), list("ab" * 700 + "c" + "ab" * 9)]
    for size in (2, 3, 5, 40):
        texts += [[str(rng.randrange(size)) for _ in range(rng.randrange(200))] for _ in range(60)]
    for _ in range(120):
        parts = []
        for _ in range(rng.randrange(1, 5)):
            unit = [str(rng.randrange(rng.choice([2, 4, 30]))) for _ in range(rng.randrange(1, 12))]
            copies = unit * rng.randrange(1, 12)
            parts += copies[: len(copies) - rng.randrange(len(unit))] + [str(rng.randrange(3)) for _ in range(rng.randrange(4))]
        texts.append(parts * rng.choice([1, 1, 4, 6]))
    return texts


def found_in(texts, ids=None):
    ids = {w: k for k, w in enumerate(sorted({w for t in texts for w in t}))}
    words = np.array([ids[w] for t in texts for w in t], np.int64)
    offsets = np.append(0, np.cumsum([len(t) for t in texts]))
    out = [[] for _ in texts]
    for s, e, q in zip(*runs.runs_in(words, offsets), strict=True):
        k = int(np.searchsorted(offsets, s, "right")) - 1
        out[k].append((int(s - offsets[k]), int(e - s), int(q)))
    return out


def test_runs_equal_a_search_over_all_periods():
    texts = some_texts()
    assert found_in(texts) == [by_search(t) for t in texts]
    for t in texts[:100]:
        assert found_in([t]) == [by_search(t)]


def test_candidates_in_small_portions(monkeypatch):
    monkeypatch.setattr(runs, "AT_ONCE", 7)
    texts = some_texts()[:80]
    assert found_in(texts) == [by_search(t) for t in texts]


def test_agreement_by_chance_is_noticed(monkeypatch):
    """Fingerprints that always agree are drawn again."""
    right, calls = runs.Extensions.agree, []

    def wrong(self, x, y, length):
        calls.append(1)
        return np.ones(len(x), bool) if len(calls) < 8 else right(self, x, y, length)

    monkeypatch.setattr(runs.Extensions, "agree", wrong)
    text = list("abcabcabcabcxyzabcabc")
    assert found_in([text]) == [by_search(text)] and len(calls) > 8


def test_grammar_shrinks_a_long_period():
    rng = np.random.default_rng(1)
    unit = np.arange(3000)
    rng.shuffle(unit)
    words = np.tile(unit, 5)
    grammar = runs.Grammar(words, np.zeros(len(words), np.int64))
    assert (grammar.end - grammar.at).max() >= 2000 and len(grammar.loose) < 40
    assert [tuple(map(int, x)) for x in zip(*runs.runs_in(words, np.array([0, len(words)])), strict=True)] == [(0, 15000, 3000)]


def brute(text, doc_id):
    words = [w for w in "".join(" " if c in "\t\n\v\f\r " else c for c in text or "").split(" ") if w]
    h = zlib.crc32(("" if doc_id is None else str(doc_id)).encode())
    if h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
    found = by_search(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = min(found, key=lambda r: (-r[1] / r[2], r[0], r[2]), default=None)
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    told = (best[0], best[1], best[2], 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *told, sha("".join(f"{s},{n},{q}\n" for s, n, q in found)), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_op11(spark, tmp_path):
    rng = random.Random(8)
    texts = [None, "", " \t\n ", "é " * 40, "a b " * 9, "x\x0by\x0cz\rx y\tz " * 5, "one"] + [rng.choice([" ", "\n ", "\t"]).join(t) for t in some_texts() if t]
    rows = [(k, t, "en") for k, t in enumerate(texts)] + [(3, texts[3], "en")] * 2 + [(None, "b a " * 8, None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("runs", F.lit(1)).withColumn("start", F.lit("s")).repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_periodic_runs(spark, str(tmp_path))
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(repr(brute(t, k)) for k, t, _ in rows)


@pytest.mark.parametrize("size", ["sf0.001"])
def test_op11_on_given_documents(spark, size):
    docs = spark.read.parquet(f"/root/testdata/{size}/documents.parquet").collect()
    short = [d for d in docs if len(d.text) < 20_000]
    got = {r.doc_id: tuple(r) for r in queries.op11_periodic_runs(spark, f"/root/testdata/{size}").collect()}
    assert len(got) == len(docs) and all(got[d.doc_id] == brute(d.text, d.doc_id) for d in short)


def test_op11_of_an_empty_table(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op11_periodic_runs(spark, str(tmp_path)).count() == 0

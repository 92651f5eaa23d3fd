"""A table of vectors with links: one jittered group of a third of it, pairs and copies, against all cosines."""

import duckdb
import numpy as np
import pytest

from namelens.llm import pivot_dedup, queries


def vectors():
    gen = np.random.default_rng(9)
    x = gen.standard_normal((900, 32))
    x[:300] = x[0] + 0.14 * gen.standard_normal((300, 32)) * np.linalg.norm(x[0]) / np.sqrt(32)
    x[500:520] = x[400:420] + 0.05 * gen.standard_normal((20, 32))
    x[600:606] = x[599]
    return x


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    where = tmp_path_factory.mktemp("links")
    odd = [(2000, None), (2001, [0.0] * 32), (2002, [float("nan")] + [1.0] * 31), (2003, [None] + [1.0] * 31), (2004, [float("inf")] + [1.0] * 31), (2005, [1.0] * 7), (None, vectors()[3].tolist())]
    rows = [(k, v.tolist()) for k, v in enumerate(vectors())] + odd
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3).write.parquet(f"{where}/embeddings.parquet")
    return str(where)


@pytest.mark.parametrize("cosine_bytes", [64 << 20, 4096])
def test_all_links_are_found(spark, folder, monkeypatch, cosine_bytes):
    monkeypatch.setattr(pivot_dedup, "COSINE_BYTES", cosine_bytes)
    x = vectors() / np.linalg.norm(vectors(), axis=1)[:, None]
    near = (x @ x.T >= 0.95) & ~np.eye(len(x), dtype=bool)
    got = {r.vec_id: r for r in queries.op2_embedding_dedup(spark, folder).collect() if r.vec_id is not None}
    assert near.sum() > 20_000 and sum(got[k].n_links for k in range(300)) == near[:300].sum()
    wrong = [k for k in range(900) if got[k].n_links != near[k].sum()]
    assert len(wrong) <= 1 and all(got[k].n_links == 0 and got[k].kept for k in range(2000, 2006))


def test_op2_equals_its_sql(spark, folder):
    con = duckdb.connect()
    con.execute(f"create view embeddings as select * from '{folder}/embeddings.parquet/*.parquet'")
    cur = con.execute(queries.ORACLE_SQL["op2_embedding_dedup"])
    names = [d[0] for d in cur.description]
    want = sorted(map(repr, cur.fetchall()))
    got = sorted(map(repr, map(tuple, queries.op2_embedding_dedup(spark, folder).select(names).collect())))
    assert sum(a != b for a, b in zip(got, want, strict=True)) <= 2 and len(got) == 907

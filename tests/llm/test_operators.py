"""The training-data operators against brute force, and on nulls, empty tables, ties, repeats and clashing columns."""

import io
import random
import struct
import zipfile
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from namelens.llm import ann, components, html_text, langid, mixing, packing, pivot_dedup, simhash, token_counts, toxicity, warc_zip
from namelens.llm.word_tokens import ChunkTokenizer

DOCS = "doc_id long, text string, lang string, source string, n_chars long, size int, score double, fp long"
ODD = ["", None, " \t\n", "!!! 123", "one", "ß Straße ÉÉ x", "a b c d e f g " * 400, "a b c d e f g " * 400, "idiot    word", "<|endoftext|> x"]


def docs(spark, rows=ODD):
    return spark.createDataFrame([(k if k != 3 else None, t, "en", None if k % 3 == 0 else f"s{k % 3}", 1, 9, 0.5, 4) for k, t in enumerate(rows)], DOCS)


def test_components(spark):
    rng = random.Random(1)
    links = [(rng.randrange(300), rng.randrange(300)) for _ in range(220)] + [(k, k + 1) for k in range(1000, 1100)] + [(5, 5)]
    label = {x: x for e in links for x in e if e[0] != e[1]}
    for _ in label:
        for a, b in links:
            if a != b:
                label[a] = label[b] = min(label[a], label[b])
    got = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert {r.node: r.component for r in got} == label
    assert components.connected_components(spark.createDataFrame([], "a long, b long")).count() == 0


@pytest.mark.parametrize("limit", [2, 64])
def test_simhash_links_are_exact(spark, limit):
    rng = random.Random(2)
    base = [rng.getrandbits(64) for _ in range(40)]
    fps = sorted({b ^ sum(1 << i for i in rng.sample(range(64), rng.randrange(4))) for b in base for _ in range(12)})
    rows = spark.createDataFrame([(k, simhash.signed(f)) for k, f in enumerate(fps)], "node long, fp long")
    got = components.connected_components(simhash.close_pairs(rows, 2, limit)).collect()
    want = {k: k for k in range(len(fps))}
    for _ in range(20):
        for a in range(len(fps)):
            for b in range(a):
                if bin(fps[a] ^ fps[b]).count("1") <= 2:
                    want[a] = want[b] = min(want[a], want[b])
    assert {k: v for k, v in want.items() if k != v} == {r.node: r.component for r in got if r.node != r.component}
    assert all(any((f ^ g) & m == 0 for m in simhash.covering_masks(2)) for f, g in [(1, 2), (0, 3 << 40), (7, 4)])


def test_simhash_edges(spark):
    got = {(r.doc_id, r.fp, r.component_id) for r in simhash.near_duplicates(docs(spark)).collect()}
    assert {(0, 0, 0), (1, 0, 0), (2, 0, 0)} <= got and len({c for d, _, c in got if d in (6, 7)}) == 1
    assert simhash.near_duplicates(docs(spark).limit(0)).count() == 0


def test_packing(spark):
    rng = random.Random(3)
    rows = docs(spark, ODD + [" ".join(rng.choice(["ab", "Tiger", "x-y", "été"]) for _ in range(n)) for n in (5, 700, 3000, 127, 128)])
    got = packing.pack(rows, keep_ids=True).collect()
    tokens = ChunkTokenizer().tokenizer
    for doc, text in [(r.doc_id, r.text) for r in rows.collect() if r.doc_id is not None]:
        ids = tokens.encode(text or "", add_special_tokens=False).ids + [1]
        own = sorted((r for r in got if r.doc_id == doc), key=lambda r: r.start)
        assert [i for r in own for i in r.ids] == ids and {r.doc_tokens for r in own} == {len(ids)}
        assert all(zlib.crc32(struct.pack(f"<{r.length}I", *r.ids)) == r.ids_crc32 for r in own)
    by = {}
    for r in got:
        by.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert packing.pack(rows.limit(0)).count() == 0


def test_mixing(spark):
    rng = random.Random(4)
    rows = spark.createDataFrame([(k, " ".join("w" * 3 for _ in range(rng.randrange(1, 400))), rng.choice(["a", "b", "b", "b", None, "tiny"]) if k > 3 else "tiny", 1) for k in range(400)], "doc_id long, text string, source string, size int")
    got = mixing.mix(rows).collect()
    sizes = {}
    for r in got:
        sizes.setdefault((r.source_size, r.target), []).append(r)
        assert 0 <= r.taken <= 3 * r.size
    assert abs(sum(t for _, t in sizes) - sum(r.size for r in got)) < 1e-6
    for (size, target), own in sizes.items():
        assert target <= 3 * size + 1e-9 and abs(sum(r.taken for r in own) - target) <= 64
    assert sorted(got) == sorted(mixing.mix(rows.repartition(7)).collect())
    edge = mixing.mix(docs(spark)).collect()
    assert len(edge) == len(ODD) and all(r.taken == 0 for r in edge if r.size == 0)
    assert mixing.mix(docs(spark).limit(0)).count() == 0
    mixed = mixing.mixed_documents(rows.withColumn("n_chars", F.length("text")))
    assert mixed.columns == rows.columns + ["n_chars"]
    assert mixed.agg(F.sum(F.size(F.split("text", " ")))).first()[0] == sum(r.taken for r in got)


def test_sainte_lague(spark):
    votes = [53000, 24000, 23000, 700, 1]
    df = spark.createDataFrame(list(enumerate(votes)), "party int, v long").withColumn("one", F.lit(0))
    for seats in (1, 7, 100, 1003):
        want = [0] * len(votes)
        for _ in range(seats):
            best = max(range(len(votes)), key=lambda k: (votes[k] / (2 * want[k] + 1), -k))
            want[best] += 1
        got = mixing.apportioned(df, F.col("v"), F.lit(seats), ["one"], ["party"]).orderBy("party").collect()
        assert [r.quota for r in got] == want


def test_near_vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.standard_normal((400, 16))
    x[100:130] = x[0] + 0.05 * rng.standard_normal((30, 16))
    x[200:205] = x[1]
    rows = [(k, [float(v) for v in r], 1) for k, r in enumerate(x)] + [(900, None, 1), (901, [0.0] * 16, 1), (902, [float("nan")] * 16, 1), (903, [None] * 16, 1), (904, [1.0], 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, label int")
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(400, dtype=bool)
    for block in (2048, 16):
        got = {r.vec_id: r for r in pivot_dedup.near_duplicates(df, block=block).collect()}
        assert len(got) == 405 and [got[k].n_links for k in range(400)] == near.sum(axis=1).tolist()
        assert got[204].component_id == 1 and got[100].component_id == 0 and got[900].kept and not got[204].kept
    found = ann.search(df, k=5, lists_per_root=0.5, block=64).collect()
    hit = total = 0
    for query in range(0, 400, 20):
        own = sorted((r for r in found if r.query_id == query), key=lambda r: r.rank)
        s = x @ x[query]
        s[query] = -np.inf
        best = np.lexsort((np.arange(400), -s))[:5]
        hit, total = hit + len({r.vec_id for r in own} & set(best.tolist())), total + 5
        assert [r.rank for r in own] == [1, 2, 3, 4, 5] and all(abs(r.score - x[query] @ x[r.vec_id]) < 1e-12 for r in own)
    assert hit / total >= 0.9
    assert pivot_dedup.near_duplicates(df.limit(0)).count() == 0 and ann.search(df.limit(0)).count() == 0


def test_near_vectors_in_a_large_group(spark):
    rng = np.random.default_rng(8)
    x = rng.standard_normal((6000, 64))
    x[:2000] = x[0] + 0.22 * np.linalg.norm(x[0]) / 8 * rng.standard_normal((2000, 64))
    x[3000:3300] = x[3000] + 0.1 * rng.standard_normal((300, 64))
    for k in range(4000, 4400, 2):
        x[k + 1] = x[k] + 0.1 * rng.standard_normal(64)
    u = x / np.linalg.norm(x, axis=1)[:, None]
    near = (u @ u.T >= 0.95) & ~np.eye(6000, dtype=bool)
    df = spark.createDataFrame([(k, r.tolist()) for k, r in enumerate(x)], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.n_links for r in pivot_dedup.near_duplicates(df, block=512).collect()}
    want = near.sum(axis=1)
    assert 0.2 < near[:2000, :2000].mean() < 0.99 and [got[k] for k in range(2000)] == want[:2000].tolist()
    assert all(got[k] <= want[k] for k in got) and sum(got.values()) >= 0.999 * near.sum()


def test_toxicity(spark):
    rng = random.Random(6)
    clean = ["the", "tree", "is", "green", "and", "quiet", "water", "runs"]
    rows = [(k, " ".join(rng.choices(clean, k=30) + (["moron", "1d10t"] if k % 5 == 0 else []))) for k in range(600)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(k, int(k % 5 == 0)) for k in range(500)], "doc_id long, toxic int")
    model = toxicity.train(d, labels)
    assert model.score("you are a mоrоn and an idiot") > 0.5 > model.score("the water is quiet") and model.score(None) < 0.5
    assert toxicity.fold("M0r0n​ ID1OT") == " moron idiot ".replace("l", "i")
    got = toxicity.score(docs(spark), model)
    assert got.count() == len(ODD) and set(got.columns) == set(DOCS.replace(",", "").split()[::2])
    assert toxicity.train(d.limit(0), labels.limit(0)).score("x") < 0.5


def test_language(spark):
    en, fr = "the of and thing water house people".split(), "le la maison est un peuple eau avec".split()
    rng = random.Random(7)
    rows = [(k, " ".join(rng.choices(en if k % 2 else fr, k=20)), "en" if k % 2 else "fr") for k in range(200)]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    word, pieces = "house", model.pieces
    logp = np.exp(model.logp[:, 0])
    full = "▁" + word
    total = [1.0] + [0.0] * len(full)
    for e in range(1, len(full) + 1):
        for s in range(max(0, e - 12), e):
            total[e] += total[s] * (logp[pieces[full[s:e]]] if full[s:e] in pieces else logp[-1] if e - s == 1 else 0.0)
    assert abs(np.log(total[-1]) - model.word_scores([word])[0, 0]) < 1e-9
    got = {r.doc_id: r for r in langid.predict(docs(spark), model).collect()}
    assert got[0].lang_pred == got[1].lang_pred == got[2].lang_pred == "und" and got[6].lang_pred in ("en", "fr")
    assert {r.lang_pred for r in langid.predict(spark.createDataFrame([(1, "the house of people " * 5)], "doc_id long, text string"), model).collect()} == {"en"}


def test_language_takes_long_pieces_and_long_runs(spark):
    run = "ab" * 32 + "house" * 12
    rows = [(1, "international", "en"), (2, "nation", "fr"), (3, run, "en")]
    model = langid.train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))
    assert model.piece_limit == max(map(len, model.pieces)) > 12
    whole = model.logp[model.pieces["▁international"], 0]
    assert model.word_scores(["international"])[0, 0] >= whole - 1e-9
    learnt = model.logp[[k for p, k in model.pieces.items() if p.endswith("house")], 0]
    assert learnt.max() > model.logp[model.pieces["▁understanding"], 0] + 1


def test_token_files(spark):
    rows = docs(spark)
    got = {r.doc_id: r.n_tokens for r in token_counts.token_counts(rows).collect()}
    tokens = ChunkTokenizer(literal=True).tokenizer
    assert got == {r.doc_id: len(tokens.encode(r.text or "", add_special_tokens=False).ids) for r in rows.collect()}


def test_scan_stitches_blocks(spark, tmp_path):
    ids = [1, 2, 9, 9, 3, 4, 5, 6, 9, 7]
    (tmp_path / "a.tok").write_bytes(struct.pack("<10H", *ids))
    (tmp_path / "b.tok").write_bytes(b"")
    files = spark.createDataFrame([(str(tmp_path / n),) for n in ("a.tok", "b.tok")], "file string")
    for block in (1, 3, 100):
        got = sorted((r.doc_index, r.start, r.n_tokens, r.closed) for r in token_counts.scan(files, separator=9, block_tokens=block).collect())
        assert got == [(0, 0, 2, True), (1, 3, 0, True), (2, 4, 4, True), (3, 9, 1, False)]


def test_token_counts_broadcast_neither_order_nor_separators(spark):
    """Their files are far smaller than their rows, so the planner would take them for small ones."""
    rows = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("some words").alias("text"))
    plan = token_counts.token_counts(rows)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastExchange") == 1 and "SortMergeJoin" in plan
    sent = plan[plan.index("BroadcastExchange") :]
    assert "Window" in sent[: sent.index("FileScan")]


def test_html(spark):
    page = lambda t: f"<html><head><title>x</title><script>a</script></head><body><nav>Menu</nav><div>Shared line of the site</div><div>{t}</div><footer>f</footer></body></html>"
    rows = [(1, "http://h.org/a/1", page("First &amp; text<br>goes&nbsp;on" + " and on" * 9)), (2, "http://h.org/a/2", page("Second <b>te</b>xt is another" + " long one" * 9)), (3, None, None), (4, "http://h.org/z", "<article><h1>T</h1><p>One<p>Two<aside>no</aside></article><div class='ad'>ad</div>"), (5, "x", "")]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "First & text goes on" + " and on" * 9, 2: "Second text is another" + " long one" * 9, 3: "", 4: "T One Two", 5: ""}
    assert html_text.shared_lines([1, 2, 3, 4, 2], [2, 9, 3, 2]) == {1, 2, 4}


def test_html_neighbours_on_a_large_host(spark):
    page = lambda k: f"<body><div>Notice of block {k // 2}</div><div>Text of page {k}{' and on' * 9}</div></body>"
    rows = [(k, None if k % 3 == 0 else f"http://hot.org/a/{k:04}" if k < 600 else f"http://hot.org/index.php?id={k:04}", page(k)) for k in range(900)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    whole = {r.page_id: r.text for r in html_text.extract(df, part_pages=10_000).collect()}
    got = {r.page_id: r.text for r in html_text.extract(df, part_pages=40).collect()}
    assert got == whole and len(got) == 900
    # Ids 3n + 1 and 3n + 2 are neighbours; they share a notice if n is odd, whatever range they are in.
    assert all(got[k] == f"Text of page {k}{' and on' * 9}" for n in range(1, 300, 2) for k in (3 * n + 1, 3 * n + 2) if (3 * n + 1) // 2 == (3 * n + 2) // 2)


def test_html_long_template_and_copies(spark):
    menu = "".join(f"<div>Menu entry {k} of the whole site</div>" for k in range(12))
    body = lambda k: "".join(f"<p>Line {j} of story {k} is here to be read.</p>" for j in range(9))
    short = [(k, f"http://a.org/{k:02}", f"<body>{menu}<p>Short text {k}</p></body>") for k in range(10)]
    copied = [(20 + k, f"http://b.org/{k:02}", f"<body><div>Notice of the site</div>{body(k // 3)}<p>{k if k % 3 == 1 else ''}</p></body>") for k in range(15)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(short + copied, "page_id long, url string, html string")).collect()}
    assert all(got[k] == f"Short text {k}" for k in range(10))
    assert all("Notice" not in got[20 + k] and got[20 + k].count("of story") == 9 for k in range(15))


def test_warc(spark, tmp_path):
    big = "é" * 900
    rows = [(1, "u", big), (2, "u", big), (3, None, "x"), (4, "u", "x"), (5, "u", None), (None, "u", big)]
    got = {r.page_id: r for r in warc_zip.archived(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert (got[1].record_type, got[1].refers_to, got[1].payload_bytes, got[2].record_type) == ("revisit", 2, 1800, "response")
    assert {got[k].record_type for k in (3, 4, 5)} == {"response"} and got[1].payload_digest == got[2].payload_digest
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        for name in ("a", "b/c"):
            with z.open(name, "w", force_zip64=True) as f:
                f.write(name.encode() * 5)
    members = warc_zip.members_of(data, len(data.getvalue()))
    assert {n: data.getvalue()[m.start : m.start + m.size] for n, m in members.items()} == {"a": b"a" * 5, "b/c": b"b/c" * 5}

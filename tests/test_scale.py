"""What the library leaves out of its work, or deals out, changes no result."""

import random

import pytest
from pyspark.sql import functions as F

from namelens.functions.distance import bounded_cost, least_cost, letters_of, skeleton_distance, skeleton_way
from namelens.operators import names, screening
from namelens.operators.provenance import provenance_states
from namelens.streaming import screening as streams

ENTRY = "idx long, id string, source string, type string, program string, name string, aliases array<string>, dob string, sex string, nationality string"
PERSON = "query_id long, fullName string, dob string, sex string, nationality string"


def skeletons(rng):
    letters = "".join(rng.choice("BFMNLRHKJGDZTSX") for _ in range(rng.randrange(9)))
    if letters and rng.random() < 0.2:
        letters = rng.choice("WY") + letters[1:]
    return letters, [rng.random() < 0.15 for _ in letters]


def test_bounded_costs_equal_the_whole_table(spark):
    rng = random.Random(1)
    rows = [(*skeletons(rng), *skeletons(rng)) for _ in range(700)]
    for _ in range(700):
        s, w = skeletons(rng)
        t = [rng.choice("BFMNLRHKJGDZTSX") if rng.random() < 0.2 else c for c in s if rng.random() > 0.1]
        rows.append((s, w, "".join(t), [rng.random() < 0.15 for _ in t]))
    df = spark.createDataFrame(rows, "a string, wa array<boolean>, b string, wb array<boolean>").repartition(4)
    c = F.col
    df = df.select("*", letters_of(c("a"), c("wa")).alias("x"), letters_of(c("b"), c("wb")).alias("y"))
    got = df.select(skeleton_distance(c("a"), c("b"), c("wa"), c("wb")).cost.alias("cost"), least_cost(c("x"), c("y")).alias("least"), bounded_cost(c("x"), c("y"), F.lit(999)).alias("whole"), bounded_cost(c("x"), c("y"), F.lit(8)).alias("upto")).collect()
    assert all(r.least <= r.cost == r.whole and r.upto == (r.cost if r.cost <= 8 else None) for r in got)
    assert sum(r.least > 8 for r in got) > 200


def test_similar_tokens_miss_nothing(spark, monkeypatch):
    monkeypatch.setattr(names, "TILE", 7)
    words = "mohammad muhammed khaled khalid shadid shadeed hadad haddad chalil khalil a omar umar bashir bachir nasser naser smith smyth يوسف יוסף yousef fadala fadela kafala qafala".split()
    tokens = spark.createDataFrame([(w,) for w in words], "token string")
    for least in (45, 60, 75, 100):
        every = names.compare_tokens(tokens.withColumnRenamed("token", "a").crossJoin(tokens.withColumnRenamed("token", "b")))
        want = {(r.a, r.b, r.cents) for r in every.where(f"cents >= {least}").collect()}
        assert {tuple(r) for r in names.similar_tokens(tokens, tokens, least).collect()} == want


@pytest.fixture
def listed(spark):
    rows = [(0, "PEP", "Mohammad Al-Farsi", []), (1, None, "Muhammed Elfarsi", []), (2, "", "Karim Shadid", ["Mohammad Alfarsi"]), (3, "Sanction", "Karim Shadeed", []), (4, "pep", "Abdullah Fadala", [])]
    return spark.createDataFrame([(k, f"E{k}", "s", t, "p", n, a, "1970-01-02" if k % 2 else None, "M", None) for k, t, n, a in rows], ENTRY)


@pytest.fixture
def people(spark):
    rows = ["Mohammad Al-Farsi", "Karim Shadid", "Abd Allah Fadala", "Jonathan Smith", None, "", "Kareem Shadid Mohammad"]
    return spark.createDataFrame([(k, n, "1970-01-02" if k % 2 else "1971-01-01", "M" if k % 3 else None, None) for k, n in enumerate(rows)], PERSON)


def test_types_are_folded_and_hits_carry_their_pairs(spark, people, listed):
    got = {(r.query_id, r.idx): r for r in screening.screen(people, listed).collect()}
    assert {k[1]: (r.list_type, "SCR-6" in r.rules) for k, r in got.items() if k[0] == 0} == {0: ("pep", True), 1: ("sanction", False), 2: ("sanction", False)}
    assert got[1, 3].list_type == "sanction" and [(p.a, p.b, p.role, p.score) for p in got[0, 2].pairs] == [("mohammad", "mohammad", "given", 100), ("farsi", "farsi", "family", 100)]
    assert got[0, 2].matched_name == "Mohammad Alfarsi" and got[0, 2].pairs[0].rules == ["LEX-1"]


def test_sweep_equals_screening_at_each_threshold(spark, people, listed):
    swept = {(r.query_id, r.hit): tuple(r) for r in screening.sweep(people, screening.screen(people, listed, hit=50)).select("query_id", "hit", "hits", "strong", "potential", "discounted", "disposition", "rules", "reason").collect()}
    assert len(swept) == people.count() * 51
    for hit in (50, 73, 92, 100):
        once = screening.dispositions(people, screening.screen(people, listed, hit=hit), hit=hit).collect()
        assert all(swept[r.query_id, hit] == (r.query_id, hit, r.hits, r.strong, r.potential, r.discounted, r.disposition, r.rules, r.reason) for r in once)


def test_blocking_report_tells_what_is_missed(spark, people, listed):
    got = {r.blocking: r for r in screening.blocking_report(people.where("query_id = 2"), listed.where("idx = 4").withColumn("name", F.lit("Abdullah"))).collect()}
    assert got == {} or got["exhaustive"].missed == 0
    alone = spark.createDataFrame([(0, "Abd Allah", None, None, None)], PERSON)
    missed = {r.blocking: (r.pairs, r.hits, r.missed) for r in screening.blocking_report(alone, listed.withColumn("name", F.lit("Abdullah")).withColumn("aliases", F.array().cast("array<string>")).limit(1)).collect()}
    assert missed == {"wide": (1, 1, 0), "exhaustive": (1, 1, 0)}


def test_names_that_many_share_are_dealt_out(spark, people, listed, monkeypatch):
    want = sorted(map(str, screening.screen(people, listed).collect()))
    monkeypatch.setattr(screening, "SHARES", 2)
    many = people.crossJoin(spark.range(40).withColumnRenamed("id", "copy"))
    asked = many.where("query_id = 0 or copy = 0").withColumn("query_id", F.col("query_id") + F.col("copy") * 100).drop("copy")
    got = screening.screen(asked, listed).collect()
    assert sorted(str(r) for r in got if r.query_id < 100) == want and len(got) == len(want) + 39 * sum("query_id=0" in x for x in want)
    assert {r.query_id % 100 for r in got if r.query_id >= 100} == {0}


EVENTS = "record_id long, side string, field string, seq long, event string, value string, validated boolean, at timestamp"


def test_late_events_of_a_stream(spark, tmp_path):
    """Events in micro-batches out of order give the states of the batch form."""
    rng = random.Random(3)
    kinds = ["proposal", "edit", "clear", "confirm", "restore"]
    rows = [(k % 12, "a", "dob", k, rng.choice(kinds), rng.choice(["x", "y", None]), rng.random() < 0.4, 1_700_000_000 + 60 * k) for k in range(300)]
    late = sorted(rows, key=lambda r: r[3] + rng.randrange(60))
    schema = EVENTS.replace("at timestamp", "secs long")
    timed = lambda part: spark.createDataFrame(part, schema).withColumn("at", F.timestamp_seconds("secs")).drop("secs")
    for k in range(0, 300, 100):
        timed(late[k : k + 100]).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    streams.latest_states(streams.late_provenance_stream(stream, "2 hours"), str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    last = spark.read.parquet(str(tmp_path / "out")).groupBy("record_id").agg(F.max_by(F.struct("state", "value"), "batch").alias("s"))
    assert {r.record_id: tuple(r.s) for r in last.collect()} == {r.record_id: (r.state, r.value) for r in provenance_states(timed(rows)).collect()}
    assert spark.read.parquet(str(tmp_path / "out")).select("batch").distinct().count() >= 3


class Kept:
    """A state variable, or the handle that gives it, in memory."""

    def __init__(self):
        self.value, self.timers = None, []

    getValueState = getListState = lambda self, name, schema: Kept()  # noqa: E731, N815
    exists = lambda self: self.value is not None
    get = lambda self: self.value

    def update(self, value):
        self.value = value

    put = update

    def clear(self):
        self.value = None

    def registerTimer(self, at):  # noqa: N802
        self.timers.append(at)


def test_events_behind_the_watermark_are_forgotten():
    states, handle = streams.FieldStates(), Kept()
    states.init(handle)
    events = [(10, 1, "proposal", "x", False), (30, 3, "confirm", None, None), (20, 2, "edit", "x", None)]
    assert states.settle(events, 0) == (streams.START, events) and len(states.held()) == 3 and handle.timers == [31]
    now, rest = states.settle(states.held(), 25)
    assert now == ("typed", "x", "x", False) and rest == [events[1]] and states.held() == [events[1]]
    assert states.settle(states.held(), 40)[0] == ("confirmed", "x", "x", False) and states.held() == []


def test_scores_from_a_threshold_miss_nothing(spark):
    rng = random.Random(5)
    parts = "mohammad muhammed محمد khaled khalil chalil خليل חליל shadid shadeed hadad omar umar bashira nasser naser smith smyth ali bin abu al-farsi elfarsi فارسي a".split()
    made = lambda: " ".join(rng.choice(parts) for _ in range(rng.choice((1, 2, 2, 3, 3, 4))))
    names_ = [made() for _ in range(70)]
    near = [" ".join(w if rng.random() < 0.7 else rng.choice(parts) for w in n.split()) for n in names_]
    swapped = [" ".join(reversed(n.split())) for n in names_[:20]]
    pairs = spark.createDataFrame([(a, b) for a in names_ for b in rng.sample(names_, 12)] + list(zip(names_, near, strict=True)) + list(zip(names_, swapped, strict=False)) + [(None, "omar"), ("", "omar")], "a string, b string")
    told = lambda df: {(r.a, r.b): (r.score, str(r.pairs), r.unmatched_middles) for r in df.collect()}
    every = told(names.name_scores(pairs))
    for least in (30, 60, 75, 92):
        assert told(names.name_scores(pairs, least=least)) == {k: v for k, v in every.items() if v[0] >= least}


def test_letters_alone_leave_out_most_pairs(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice(("ba", "da", "fa", "ka", "la", "ma", "na", "ra", "sa", "za", "sha")) for _ in range(4))
    rows = spark.createDataFrame([(f"{word()} {word()}",) for _ in range(60)], "name string").select("name", names.tokens_in("name").alias("p"))
    traits = names.with_traits(rows, names.token_attributes(rows.select(F.explode("p.tokens").alias("token"))))
    both = traits.select(F.col("traits").alias("x")).crossJoin(traits.select(F.col("traits").alias("y")))
    assert 60 <= both.where(names.can_reach("x", "y", 75)).count() < 60 * 60 / 3


def test_ways_by_batches_are_those_of_the_folded_table(spark):
    rng = random.Random(4)
    word = lambda: "".join(rng.choices("BFMNLRHKJGDZTSXWYA", k=rng.choice((0, 1, 2, 3, 4, 5, 7, 11))))
    weak = lambda t: [rng.random() < 0.3 for _ in t]
    rows = [(a, b, weak(a), weak(b)) for a, b in ((word(), word()) for _ in range(700))]
    rows += [(a, a[1:] + "X", weak(a), weak(a)) for a, *_ in rows[:200] if a] + [("K" * 90 + "S", "H" * 70, [False] * 91, [True] * 70), (None, "K", [], [False]), ("K", None, [False], [])]
    df = spark.createDataFrame(rows, "a string, b string, wa array<boolean>, wb array<boolean>").repartition(3)
    c = F.col
    got = df.select(skeleton_distance(c("a"), c("b"), c("wa"), c("wb")).alias("x"), skeleton_way(c("a"), c("b"), c("wa"), c("wb")).alias("y"), letters_of(c("a"), c("wa")).alias("p"), letters_of(c("b"), c("wb")).alias("q"), "a", "b")
    got = got.withColumn("z", bounded_cost(c("p"), c("q"), F.lit(1 << 20))).collect()
    assert len(got) == len(rows)
    for r in got:
        if r.a is None or r.b is None:
            assert r.y is None
        else:
            assert r.x == r.y and r.z == r.x.cost, (r.a, r.b)


def test_scores_fold_no_table_of_each_token_pair(spark):
    pairs = spark.createDataFrame([("x", "y")], "a string, b string").select(F.struct(F.col("a").alias("token")).alias("x"), F.struct(F.col("b").alias("token")).alias("y"))
    tokens = lambda out: names.token_attributes(pairs.select(F.col(f"{out}.token").alias("token"))).select(F.struct(*names.SCORING).alias(out))
    plan = tokens("x").crossJoin(tokens("y")).select(bounded_cost(F.col("x.letters"), F.col("y.letters"), F.lit(9)))
    assert "ArrowEvalPython" in plan._jdf.queryExecution().executedPlan().toString()


def test_tiles_score_as_names_do(spark):
    """Each name against each, by the kernel of a tile and by joins; a list's best name counts, the first at a tie."""
    rng = random.Random(8)
    parts = "mohammad muhammed محمد khaled khalil chalil خليل חליל shadid shadeed hadad omar umar bashira nasser naser smith smyth ali bin abu al-farsi elfarsi فارسي a و wael".split()
    names_ = sorted({" ".join(rng.choice(parts) for _ in range(rng.choice((1, 2, 2, 3, 3, 4, 5)))) for _ in range(60)})
    people = spark.createDataFrame(list(enumerate(names_)), "qid long, fullName string")
    lists = spark.createDataFrame([(k, [names_[k], names_[-k - 1], names_[k]]) for k in range(0, len(names_), 2)], "lid long, names array<string>")
    every = {(r.a, r.b): r.score for r in names.name_scores(people.select(F.col("fullName").alias("a")).crossJoin(people.select(F.col("fullName").alias("b"))), rows=False).collect()}
    keys = [df.select(df.columns[0], F.array(F.lit("k")).alias("keys")) for df in (people, lists)]
    by_list = {r.lid: r.names for r in lists.collect()}
    for hit in (1, 50, 75, 92):
        want = {(q, k): max((every[n, own[p]], -p) for p in range(3)) for q, n in enumerate(names_) for k, own in by_list.items()}
        got = screening.best_names(keys, people, lists, hit, rows=False).collect()
        assert {(r.qid, r.lid): (r.best.score, r.best.at) for r in got} == {k: v for k, v in want.items() if v[0] >= hit}
        assert all(r.best.name == by_list[r.lid][-r.best.at] for r in got)


def test_candidates_are_no_rows(spark, people, listed, monkeypatch):
    """What screening writes has rows for persons, lists and hits, also with tiles of two names, and the hits are the same."""
    rows, write = {}, screening.written
    want = sorted(map(str, screening.screen(people, listed).collect()))

    def noted(df, label):
        rows[label] = (out := write(df, label)).count()
        return out

    monkeypatch.setattr(screening, "TILE", 2)
    monkeypatch.setattr(screening, "written", noted)
    assert sorted(map(str, screening.screen(people, listed).collect())) == want
    assert rows["found"] == len(want) and "candidates" not in rows


def test_sweep_makes_no_row_of_a_hit(spark, people, listed, monkeypatch):
    """Counts by tiles are those of the hits; blanks, swapped dates and queries and entries that are alike included."""
    asked = people.unionByName(people.withColumn("query_id", F.col("query_id") + 20)).unionByName(people.select((F.col("query_id") + 50).alias("query_id"), "fullName", F.lit("1970-02-01").alias("dob"), F.lit(" f").alias("sex"), F.lit("sy").alias("nationality")))
    held = listed.unionByName(listed.withColumn("idx", F.col("idx") + 9)).unionByName(listed.select((F.col("idx") + 30).alias("idx"), "id", "source", "type", "program", "name", "aliases", F.lit(None).cast("string").alias("dob"), F.lit("").alias("sex"), F.lit("SY ").alias("nationality")))
    want = sorted(map(str, screening.sweep(asked, screening.screen(asked, held, hit=50, rows=False)).collect()))
    monkeypatch.setattr(screening, "screen", None)
    monkeypatch.setattr(screening, "TILE", 3)
    monkeypatch.setattr(screening, "SHARES", 4)
    assert sorted(map(str, screening.swept(asked, held).collect())) == want


def test_blocking_report_writes_no_candidates(spark, people, listed, monkeypatch):
    """Its counts are those of the pairs that share a key, which are never rows; tokens too long for small numbers are compared."""
    labels, write = [], screening.written
    monkeypatch.setattr(screening, "written", lambda df, label: labels.append(label) or write(df, label))
    got = {r.blocking: r for r in screening.blocking_report(people, listed).collect()}
    assert "blocked" not in labels and "candidates" not in labels
    lists = listed.select("idx", screening.names_of().alias("names"))
    for mode in ("reference", "wide"):
        keys = screening.name_keys(people, "fullName", mode).join(people, "fullName").select("query_id", "block_key")
        held = lists.select("idx", F.explode("names").alias("name"))
        held = held.join(screening.name_keys(held, "name", mode), "name").select("idx", "block_key")
        assert got[mode].candidates == keys.join(held, "block_key").select("query_id", "idx").distinct().count()
    tokens = spark.createDataFrame([("kasima" * 40,), ("kasima" * 39 + "dasima",), ("b",)], "token string")
    assert names.similar_tokens(tokens, tokens, 1).where("a != b and a != 'b' and b != 'b'").count() == 2

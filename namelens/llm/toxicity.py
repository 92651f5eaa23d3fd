"""Toxicity by a weighted lexicon, matched with Aho-Corasick on folded text.

Folding maps homoglyphs and digit substitutions to one letter each, drops invisible characters and leaves words parted
by single spaces. The lexicon holds words and beginnings of words that labelled toxic texts have far more often, each
with its log ratio as weight; phrases in which a word is harmless are exceptions. A text's score is a logistic
function of the weight it matches and of that weight by its length.

A beginning stands for words that no labelled text had, so it is judged by the different words that have it: toxic texts
must have many such words and clean ones few. That a single toxic word is frequent says nothing of others that begin alike.
"""

from __future__ import annotations

import math
import re
import unicodedata
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bounded_fraction, map_in_python, sampled, with_columns_from_python, written

# Letters of other scripts that look like a Latin letter.
HOMOGLYPHS = {
    "а": "a", "в": "b", "е": "e", "ё": "e", "з": "e", "и": "u", "і": "i", "ї": "i", "ј": "j", "к": "k", "м": "m", "н": "h", "о": "o", "р": "p", "с": "c",
    "ѕ": "s", "т": "t", "у": "y", "х": "x", "ԁ": "d", "ԛ": "q", "ԝ": "w", "α": "a", "β": "b", "γ": "y", "ε": "e", "η": "n", "ι": "i", "κ": "k",
    "ν": "v", "ο": "o", "ρ": "p", "σ": "o", "τ": "t", "υ": "u", "χ": "x", "ω": "w", "ı": "i", "ɑ": "a", "ɡ": "g", "ʟ": "l", "ո": "n", "ս": "u", "օ": "o",
}
#: l, 1 and i can't be told apart once they stand for each other, so all fold to i.
SUBSTITUTES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "8": "b", "@": "a", "$": "s", "!": "i", "|": "i"}
INVISIBLE = dict.fromkeys([0xAD, 0x200B, 0x200C, 0x200D, 0x2060, 0xFEFF])
FOLD = str.maketrans(HOMOGLYPHS | {"l": "i"}) | INVISIBLE
#: Substitutes count inside a word, or at its start if two letters follow.
SUBSTITUTED = re.compile(r"(?<=[^\W\d_])[013-578@$!|]+(?=[^\W\d_])|(?<![\w@$!|])[013-578@$|](?=[^\W\d_]{2})")
GAP = re.compile(r"[\W\d_]+")
#: How many letters a beginning has.
BEGINNINGS = (3, 4, 5, 6)


def fold(text: str | None) -> str:
    """The folded words with a space before and after each; one space if there are none."""
    if not text:
        return " "
    if not text.isascii():
        text = unicodedata.normalize("NFKC", text)
    text = text.lower().translate(FOLD)
    text = SUBSTITUTED.sub(lambda m: "".join(SUBSTITUTES.get(c, c) for c in m[0]), text)
    return f" {GAP.sub(' ', text).strip()} " if text else " "


@dataclass
class ToxicityModel:
    """lexicon: folded word (" word ") or beginning (" begin") to weight; exceptions: folded phrases (" two words ") in
    which a word is harmless; logistic: weights of 1, total, density."""

    lexicon: dict[str, float]
    exceptions: tuple[str, ...] = ()
    logistic: list[float] = field(default_factory=lambda: [-2.0, 0.5, 0.5])
    _automaton: object = None

    def automaton(self):
        if self._automaton is None:
            import ahocorasick

            a = ahocorasick.Automaton()
            for pattern, weight in self.lexicon.items():
                a.add_word(pattern, (len(pattern), weight, False))
            for phrase in self.exceptions:
                a.add_word(phrase, (len(phrase), 0.0, True))
            if len(a):
                a.make_automaton()
            self._automaton = a
        return self._automaton

    def __getstate__(self):
        return self.__dict__ | {"_automaton": None}

    def features(self, text: str | None) -> tuple[float, float, int]:
        """log(1 + weight of the distinct words matched), log(1 + that weight in a thousand words), words matched."""
        folded = fold(text)
        best = self.matches(folded)
        distinct: dict[str, float] = {}
        for start, weight in best.items():
            distinct[folded[start : folded.find(" ", start + 1)]] = weight
        total, words = sum(distinct.values()), max(1, folded.count(" ") - 1)
        return math.log1p(total), math.log1p(1000 * total / words), len(best)

    def matches(self, folded: str) -> dict[int, float]:
        """By the place before a word, the largest weight that matches there, unless a phrase excuses it."""
        a = self.automaton()
        best: dict[int, float] = {}
        if not len(a):
            return best
        excused: list[tuple[int, int]] = []
        for end, (size, weight, exception) in a.iter(folded):
            start = end - size + 1
            if exception:
                excused.append((start, end))
            elif weight > best.get(start, 0.0):
                best[start] = weight
        for s, e in excused:
            k = s  # the phrase's words begin at its blanks
            while k < e:
                best.pop(k, None)
                k = folded.find(" ", k + 1)
        return best

    def score(self, text: str | None) -> float:
        x1, x2, _ = self.features(text)
        z = self.logistic[0] + self.logistic[1] * x1 + self.logistic[2] * x2
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def terms_of(folded: str) -> set[str]:
    """The words of a folded text and their beginnings."""
    words = set(folded.split())
    return {f" {w} " for w in words} | {f" {w[:k]}" for w in words for k in BEGINNINGS if len(w) > k}


def phrases_at(folded: str, places: dict[int, float], lexicon: dict[str, float]) -> set[str]:
    """The words of a folded text that the lexicon holds whole, each with the word before and with the word after it."""
    out = set()
    for at in places:
        end = folded.find(" ", at + 1)
        if folded[at : end + 1] not in lexicon:
            continue
        before, after = folded.rfind(" ", 0, at), folded.find(" ", end + 1)
        if before >= 0:
            out.add(folded[before : end + 1])
        if after >= 0:
            out.add(folded[at : after + 1])
    return out


def counted(batches: Iterator[pa.RecordBatch], terms: Callable[[str], set[str]], most_bytes: int = 32 << 20) -> Iterator[pa.RecordBatch]:
    """(term, clean, toxic): in how many of the texts of each label a term stands, summed as far as ``most_bytes`` allow."""
    found, held = (Counter(), Counter()), 0

    def flush() -> pa.RecordBatch:
        keys = list(found[0].keys() | found[1].keys())
        out = pa.RecordBatch.from_arrays([pa.array(keys, pa.string()), *(pa.array([c[k] for k in keys], pa.int64()) for c in found)], names=["term", "clean", "toxic"])
        found[0].clear(), found[1].clear()
        return out

    for batch in batches:
        for text, y in zip(batch.column(0), batch.column(1), strict=True):
            counter = found[int(y.as_py() > 0)]
            before = len(counter)
            own = terms(fold(text.as_py()))
            counter.update(own)
            held += (len(counter) - before) * 120 + sum(map(len, own)) // 4
            if held > most_bytes:
                yield flush()
                held = 0
    yield flush()


def passing(counts: DataFrame, a: str, b: str, n0: int, n1: int, least_gain: float, least_ratio: float) -> DataFrame:
    """Rows of ``counts`` that ``b`` of ``n1`` have so much more often than ``a`` of ``n0``, with ``gain`` and the log ratio ``weight``."""
    p = n1 / max(1, n0 + n1)
    gain = F.expr(f"2 * ({b} * ln(greatest({b}, 1e-9) / (({a} + {b}) * {p!r}D)) + {a} * ln(greatest({a}, 1e-9) / (({a} + {b}) * {1 - p!r}D)))")
    ratio = F.expr(f"ln(({b} + 0.5D) / {n1 + 1}D) - ln(({a} + 0.5D) / {n0 + 1}D)")
    return counts.withColumn("gain", gain).withColumn("weight", ratio).where(f"gain >= {least_gain} and weight >= {math.log(least_ratio)}")


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", sample_rows: int = 30_000, least_gain: float = 20.0, least_ratio: float = 12.0, lexicon_size: int = 20_000, exceptions_size: int = 2_000, seed: int = 5) -> ToxicityModel:
    """Learns lexicon and logistic weights from at most about ``sample_rows`` labelled rows, chosen by a seeded hash.

    The chosen labels are few enough to broadcast, so no text is shuffled. A fifth of them weighs the features and the
    rest make the lexicon, which keeps terms whose log-likelihood gain is at least ``least_gain``
    and which toxic texts have ``least_ratio`` times as often; of more than ``lexicon_size``, those with the largest
    gain. A beginning has to pass the same test once more with different words in place of texts, those that toxic texts
    have more often against the others, and weighs as little as the lesser of the two ratios. A phrase of a word that the
    lexicon holds whole and a word beside it is an exception if at least three clean texts have it and it is no likelier in a toxic
    text than in a clean one; of more than ``exceptions_size``, those in most clean texts. Rows with a null id or label
    teach nothing; an id with several labels counts with the largest, and repeated rows count as often as they stand;
    without labels, or with an empty text table, the lexicon is empty.
    """
    known = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id is not null and y is not null").groupBy("id").agg(F.max("y").alias("y"))
    chosen = sampled(known, "id", bounded_fraction(known.count(), sample_rows), seed)
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).join(F.broadcast(chosen), "id").select("text", "y", (F.pmod(F.xxhash64(F.lit(seed + 1), "id"), F.lit(5)) == 1).alias("weigh"))

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from counted(batches, terms_of)

    counts = written(map_in_python(rows.where("not weigh").select("text", "y"), terms, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b")), "terms")
    totals = rows.where("not weigh").groupBy().agg(F.sum(F.expr("int(y <= 0)")), F.sum(F.expr("int(y > 0)"))).first()
    n0, n1 = totals[0] or 0, totals[1] or 0
    model = ToxicityModel({})
    if n0 and n1:
        told = F.col("term").endswith(" ")
        words = counts.where(told).select(F.expr("substring(term, 1, length(term) - 1)").alias("word"), F.expr(f"int(b * {n0} > a * {n1})").alias("more"))
        m0, m1 = words.agg(F.sum(1 - F.col("more")), F.sum("more")).first()
        stems = words.select("more", F.explode(F.expr(f"transform(filter(array({', '.join(map(str, BEGINNINGS))}), k -> length(word) > k + 1), k -> substring(word, 1, k + 1))")).alias("term"))
        stems = stems.groupBy("term").agg(F.sum(1 - F.col("more")).alias("words_a"), F.sum("more").alias("words_b"))
        lexicon = passing(counts.where("term != '' and b >= 3"), "a", "b", n0, n1, least_gain, least_ratio)
        stems = passing(stems, "words_a", "words_b", m0, m1, least_gain, least_ratio).select("term", F.col("weight").alias("words_weight"))
        lexicon = lexicon.where(told).unionByName(lexicon.where(~told).join(stems, "term").withColumn("weight", F.least("weight", "words_weight")).drop("words_weight"))
        model.lexicon = {r.term: r.weight for r in lexicon.orderBy(F.desc("gain"), "term").limit(lexicon_size).collect()}

        def phrases(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            yield from counted(batches, lambda folded: phrases_at(folded, model.matches(folded), model.lexicon))

        met = map_in_python(rows.where("not weigh").select("text", "y"), phrases, "term string, clean long, toxic long").groupBy("term").agg(F.sum("clean").alias("a"), F.sum("toxic").alias("b"))
        harmless = met.where(f"a >= 3 and b * {n0} <= a * {n1}").orderBy(F.desc("a"), "term").limit(exceptions_size)
        model = ToxicityModel(model.lexicon, tuple(r.term for r in harmless.collect()))

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            got = [model.features(t.as_py()) for t in batch.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array([g[0] for g in got], pa.float64()), pa.array([g[1] for g in got], pa.float64()), batch.column(1)], names=["x1", "x2", "y"])

    fitted = map_in_python(rows.where("weigh").select("text", "y"), measure, "x1 double, x2 double, y int").collect()
    if len({r.y > 0 for r in fitted}) == 2:
        model.logistic = logistic_fit(np.array([[1.0, r.x1, r.x2] for r in fitted]), np.array([float(r.y > 0) for r in fitted]))
    return model


def logistic_fit(x: np.ndarray, y: np.ndarray, ridge: float = 0.05, rounds: int = 100) -> list[float]:
    """Newton's method on the likelihood with a small ridge on all but the intercept; steps are halved until they help."""
    w, keep = np.zeros(x.shape[1]), np.diag([1e-6] + [ridge] * (x.shape[1] - 1))

    def loss(v: np.ndarray) -> float:
        return float(np.logaddexp(0, x @ v).sum() - y @ (x @ v) + v @ keep @ v / 2)

    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        slope = x.T @ (y - p) - keep @ w
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + keep, slope)
        size, now = 1.0, loss(w)
        while size > 1e-6 and loss(w + size * step) > now:
            size /= 2
        w = w + size * step
        if np.abs(size * step).max() < 1e-7:
            break
    return [float(v) for v in w]


def score(docs: DataFrame, model: ToxicityModel, text_col: str = "text", score_out: str = "score") -> DataFrame:
    """Appends the score of every whole text; null and empty texts get that of a text that matches nothing.

    All columns stay, except that one named as the output is replaced.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make():
        m = shared.value
        return lambda texts: [[m.score(t.as_py()) for t in texts]]

    return with_columns_from_python(docs, [text_col], [T.StructField(score_out, T.DoubleType())], make)

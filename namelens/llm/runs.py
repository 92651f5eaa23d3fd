"""Periodic runs of words in whole texts, found on a grammar of each text.

Re-Pair over word ids: in every round pairs of neighbouring symbols that stand often enough in their text are replaced by
a nonterminal. Where frequent pairs overlap, the more frequent one is replaced, so many pairs go in one round, and the
rounds grow with the logarithm of a period, not with the number of rules. Texts share no symbol; a batch of them is worked
on as one array.

A run of at least four periods holds every pair of its neighbouring words three times, so pairs that are rarer in their
text are never replaced, and no run crosses them. Any other boundary of a run lies within the derivation of a nonterminal,
or between two symbols of what is left of the text. The smallest such node that holds the whole run is split by it, so the
runs across each nonterminal's split are computed once, on one of its derivations, and hold at all of them.
"""

from __future__ import annotations

import itertools
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_in_python

#: A run has at least so many words and so many periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: How often a pair stands in its text at least to be replaced.
LEAST_PAIRS = LEAST_PERIODS - 1
#: Candidate periods that are looked at together.
AT_ONCE = 1 << 20

#: From a row's key and its number of words to the numbers of the words to take instead, or None for all as they are.
Rewrite = Callable[[int, int], np.ndarray | None]


class Grammar:
    """What Re-Pair makes of a batch of texts.

    ``pair``: at each word, which frequent pair it ends, or -1. ``rule``, ``at``, ``cut``, ``end``: a derivation of a
    nonterminal each, with the words at which it begins, splits and ends. ``loose``: the words before which two symbols
    of what is left meet, where the words' pair is frequent.
    """

    def __init__(self, words: np.ndarray, text: np.ndarray) -> None:
        n, base = len(words), int(words.max(initial=0)) + 1
        symbol, at, end = text * base + words, np.arange(n), np.arange(1, n + 1)
        linked = np.append(text[1:] == text[:-1], False)[:n]
        fresh = int(symbol.max(initial=0)) + 1
        self.pair, loose, nodes = np.full(n, -1), [], []
        known, numbers = np.empty(0, np.int64), np.empty(0, np.int64)
        for turn in itertools.count():
            k = np.flatnonzero(linked)
            if not len(k):
                break
            pairs, which, counts = np.unique((symbol[k] << 32) | symbol[k + 1], return_inverse=True, return_counts=True)
            frequent = counts[which] >= LEAST_PAIRS
            if turn:
                loose.append(at[k[~frequent] + 1])
            else:
                self.pair[k[frequent] + 1] = which[frequent]
            linked[k[~frequent]] = False
            k, which = k[frequent], which[frequent]
            chosen = k[self.winners(k, which, self.ranks(pairs, counts), len(symbol))]
            new, rule = np.unique((symbol[chosen] << 32) | symbol[chosen + 1], return_inverse=True)
            found = np.searchsorted(known, new)
            old = (found < len(known)) & (np.append(known, -1)[found] == new)
            number = np.where(old, np.append(numbers, -1)[found], fresh + np.cumsum(~old) - 1)
            known, numbers = np.insert(known, found[~old], new[~old]), np.insert(numbers, found[~old], number[~old])
            fresh += int((~old).sum())
            nodes.append((number[rule], at[chosen], at[chosen + 1], end[chosen + 1]))
            symbol[chosen], end[chosen], linked[chosen] = number[rule], end[chosen + 1], linked[chosen + 1]
            stays = linked | np.append(False, linked[:-1])
            stays[chosen + 1] = False
            symbol, at, end, linked = symbol[stays], at[stays], end[stays], linked[stays]
        empty = np.empty(0, np.int64)
        self.rule, self.at, self.cut, self.end = (np.concatenate(x) for x in zip(*nodes, strict=True)) if nodes else (empty,) * 4
        self.loose = np.concatenate(loose) if loose else empty

    @staticmethod
    def ranks(pairs: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """More frequent pairs rank higher; at a tie a hash decides, lest ranks rise along a text."""
        mixed = pairs.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        mixed = (mixed ^ (mixed >> np.uint64(29))) * np.uint64(0xBF58476D1CE4E5B9)
        ranks = np.empty(len(pairs), np.int64)
        ranks[np.lexsort((mixed, counts))] = np.arange(len(pairs))
        return ranks

    @staticmethod
    def winners(k: np.ndarray, which: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
        """Which pairs, at the symbols ``k``, outrank both pairs they overlap; of a pair that overlaps itself, every second."""
        around = np.full(n + 2, -1)
        around[k + 1] = ranks[which]
        left, own, right = around[k], around[k + 1], around[k + 2]
        place = np.arange(len(k))
        first = np.maximum.accumulate(np.where(left == own, 0, place))
        return (left <= own) & (right <= own) & ((place - first) % 2 == 0)


class Extensions:
    """How far two places of the texts agree, by fingerprints of beginnings; never less than the truth."""

    def __init__(self, words: np.ndarray, seed: int) -> None:
        rng = np.random.default_rng(seed)
        values = rng.integers(0, 1 << 63, int(words.max(initial=0)) + 1, np.uint64) * np.uint64(2) + np.uint64(1)
        base = rng.integers(0, 1 << 63, 1, np.uint64) * np.uint64(2) + np.uint64(1)
        self.powers = np.cumprod(np.append(np.uint64(1), np.repeat(base, len(words))))
        self.sums = np.append(np.uint64(0), np.cumsum(values[words] * self.powers[: len(words)]))

    def agree(self, x: np.ndarray, y: np.ndarray, length: np.ndarray) -> np.ndarray:
        return (self.sums[x + length] - self.sums[x]) * self.powers[y - x] == self.sums[y + length] - self.sums[y]

    def longest(self, most: np.ndarray, test: Callable[[np.ndarray], np.ndarray]) -> np.ndarray:
        low, high = np.zeros_like(most), most.copy()
        while (low < high).any():
            middle = (low + high + 1) // 2
            fits = test(middle)
            low, high = np.where(fits, middle, low), np.where(fits, high, middle - 1)
        return low

    def around(self, x: np.ndarray, q: np.ndarray, first: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The widest stretch around ``x`` and ``x + q`` with period ``q`` between ``first`` and ``last``."""
        right = self.longest(last - x - q, lambda n: self.agree(x, x + q, n))
        left = self.longest(x - first, lambda n: self.agree(x - n, x + q - n, n))
        return x - left, x + q + right


def least_periods(owner: np.ndarray, start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, ...]:
    """Each stretch of an owner once, with its smallest period."""
    order = np.lexsort((period, end, start, owner))
    owner, start, end, period = owner[order], start[order], end[order], period[order]
    again = (owner[1:] == owner[:-1]) & (start[1:] == start[:-1]) & (end[1:] == end[:-1])
    first = np.append(True, ~again)[: len(owner)]
    return owner[first], start[first], end[first], period[first]


def across(grammar: Grammar, ways: Extensions, owner: np.ndarray, first: np.ndarray, cut: np.ndarray, last: np.ndarray) -> tuple[np.ndarray, ...]:
    """(owner, start, end, period) of all runs between ``first`` and ``last`` that cross ``cut``, maximal there.

    A run across a cut holds the pair of words at the cut three times, a period apart, so its period is a distance of
    that pair to another of its places.
    """
    n = len(grammar.pair)
    places = np.flatnonzero(grammar.pair >= 0)
    places = places[np.argsort(grammar.pair[places], kind="stable")]
    keys = grammar.pair[places] * (n + 1) + places
    own, most = grammar.pair[cut] * (n + 1), (last - first) // LEAST_PERIODS
    begin = np.searchsorted(keys, own + np.maximum(first + 1, cut - most))
    stop = np.maximum(begin, np.searchsorted(keys, own + np.minimum(last - 1, cut + most), "right"))
    total, found, at = np.cumsum(stop - begin), [], 0
    while at < len(cut):
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, "right")))
        size = (stop - begin)[at:upto]
        which = np.repeat(np.arange(at, upto), size)
        other = places[np.arange(len(which)) - np.repeat(np.cumsum(size) - size, size) + begin[which]]
        at = upto
        x, q = np.minimum(other, cut[which]), np.abs(other - cut[which])
        pair, held = grammar.pair[cut[which]], np.append(grammar.pair, -1)
        thrice = (held[np.minimum(x + 2 * q, n)] == pair) | (held[np.maximum(x - q, -1)] == pair)
        keep = (q > 0) & thrice
        which, x, q = which[keep], x[keep], q[keep]
        start, end = ways.around(x, q, first[which], last[which])
        keep = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        found.append(least_periods(owner[which[keep]], start[keep], end[keep], q[keep]))
    return least_periods(*(np.concatenate(x) for x in zip(*found, strict=True))) if found else (np.empty(0, np.int64),) * 4


def maximal(start: np.ndarray, end: np.ndarray, period: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The stretches that no other of their period holds, each with its smallest period, by start and period."""
    order = np.lexsort((-end, start, period))
    start, end, period = start[order], end[order], period[order]
    group = np.cumsum(np.append(False, period[1:] != period[:-1])[: len(period)])
    reach = end + group * (int(end.max(initial=0)) + 1)
    held = np.append(False, np.maximum.accumulate(reach)[:-1] >= reach[1:])[: len(reach)]
    _, start, end, period = least_periods(np.zeros((~held).sum(), np.int64), start[~held], end[~held], period[~held])
    order = np.lexsort((period, start))
    return start[order], end[order], period[order]


def runs_in(words: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, period) of all runs of a batch of texts, the texts' word ids one after another.

    Extensions go by fingerprints; in the end every run is held against the words themselves, and should two fingerprints
    ever agree by chance, others are drawn.
    """
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    grammar = Grammar(words, text)
    order = np.argsort(grammar.rule, kind="stable")
    rules, first, count = np.unique(grammar.rule[order], return_index=True, return_counts=True)
    one = order[first]
    long = grammar.end[one] - grammar.at[one] >= LEAST_WORDS
    within = np.flatnonzero(long)
    one = one[long]
    inside = text[grammar.loose]
    for seed in itertools.count():
        ways = Extensions(words, seed)
        owner, start, end, period = across(grammar, ways, within, grammar.at[one], grammar.cut[one], grammar.end[one])
        again = np.repeat(np.arange(len(owner)), count[owner])
        turn = np.arange(len(again)) - np.repeat(np.cumsum(count[owner]) - count[owner], count[owner])
        moved = grammar.at[order[first[owner[again]] + turn]] - grammar.at[order[first[owner[again]]]]
        _, loose_start, loose_end, loose_period = across(grammar, ways, inside, offsets[inside], grammar.loose, offsets[inside + 1])
        start, end, period = maximal(np.append(start[again] + moved, loose_start), np.append(end[again] + moved, loose_end), np.append(period[again], loose_period))
        if all(exact(words, offsets[text[s]], offsets[text[s] + 1], s, e, q) for s, e, q in zip(start, end, period, strict=True)):
            return start, end, period


def exact(words: np.ndarray, first: int, last: int, start: int, end: int, period: int) -> bool:
    """Whether a stretch has the period and can't be extended."""
    before = start > first and words[start - 1] == words[start - 1 + period]
    after = end < last and words[end] == words[end - period]
    return not before and not after and np.array_equal(words[start : end - period], words[start + period : end])


def words_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """(ids, offsets, distinct): the words between ASCII white space of each text, as ids of the distinct ones."""
    split = pc.ascii_split_whitespace(pc.fill_null(texts.cast(pa.large_binary()), b"").cast(pa.large_string(), safe=False))
    coded = split.values.dictionary_encode()
    ids, offsets = coded.indices.to_numpy().astype(np.int64), split.offsets.to_numpy().astype(np.int64)
    blank = pc.fill_null(pc.index_in(pa.scalar("", pa.large_string()), value_set=coded.dictionary), -1).as_py()
    real = ids != blank
    return ids[real], np.append(0, np.cumsum(real))[offsets], coded.dictionary


def rewritten(ids: np.ndarray, offsets: np.ndarray, keys: list, rewrite: Rewrite) -> np.ndarray:
    taken = np.arange(len(ids))
    for k, key in enumerate(keys):
        chosen = rewrite(key, int(offsets[k + 1] - offsets[k]))
        if chosen is not None:
            taken[offsets[k] : offsets[k + 1]] = offsets[k] + chosen
    return ids[taken]


def batches_of(texts: pa.Array, most: int) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about ``most`` bytes; a longer one stands alone."""
    ends = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, "right")))
        yield at, stop
        at = stop


def with_runs(docs: DataFrame, text: str = "text", key: str | None = None, rewrite: Rewrite | None = None, most_bytes: int = 2 << 20) -> DataFrame:
    """``docs`` with ``runs`` (array of start, length, period by start and period) and ``collapsed`` in place of the text.

    Words are what stands between ASCII white space, numbered from 0. A run is a stretch of consecutive words with smallest
    period q, of at least 6 words and four periods, that no neighbouring word extends. ``collapsed`` joins, by one space,
    the words that aren't in a run after its first q words. ``rewrite`` takes, for a row's value in ``key`` and its number of
    words, other words of that row first. A null or empty text has no runs and an empty ``collapsed``; every row has its
    own result, so repeated rows, ties and null ids need no care; columns named as an output are replaced, others stay, and
    an empty table gives an empty table. A task holds about ``most_bytes`` of texts at once, or one longer text.
    """
    outputs = [T.StructField("runs", T.ArrayType(T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")]))), T.StructField("collapsed", T.StringType())]
    kept = [f for f in docs.schema.fields if f.name not in ("runs", "collapsed", text)]
    given = docs.select(*[F.col(f"`{f.name}`") for f in kept], F.col(f"`{text}`").alias("__text"), (F.col(f"`{key}`") if key else F.lit(None).cast("long")).alias("__key"))
    struct = pa.struct([(n, pa.int64()) for n in ("start", "length", "period")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, stop in batches_of(batch.column(len(kept)), most_bytes):
                rows = batch.slice(at, stop - at)
                ids, offsets, distinct = words_of(rows.column(len(kept)))
                if rewrite:
                    ids = rewritten(ids, offsets, rows.column(len(kept) + 1).to_pylist(), rewrite)
                start, end, period = runs_in(ids, offsets)
                change = np.zeros(len(ids) + 1, np.int64)
                np.add.at(change, start + period, 1)
                np.add.at(change, end, -1)
                stay = np.cumsum(change)[:-1] == 0
                lines = pa.LargeListArray.from_arrays(pa.array(np.append(0, np.cumsum(stay))[offsets]), distinct.take(pa.array(ids[stay])))
                at_text = np.searchsorted(offsets, start, "right") - 1
                spans = pa.StructArray.from_arrays([pa.array(x) for x in (start - offsets[at_text], end - start, period)], fields=list(struct))
                runs = pa.ListArray.from_arrays(pa.array(np.searchsorted(start, offsets).astype(np.int32)), spans)
                arrays = [*rows.columns[: len(kept)], runs, pc.binary_join(lines, pa.scalar(" ", pa.large_string())).cast(pa.string())]
                yield pa.RecordBatch.from_arrays(arrays, names=[*[f.name for f in kept], "runs", "collapsed"])

    return map_in_python(given, run, T.StructType(kept + outputs))


def digests(found: DataFrame, *others: str) -> DataFrame:
    """One row for each of ``with_runs``: how many runs, the one with the most periods, and digests of runs and collapsed text.

    Periods are compared as doubles, which tell apart any two ratios of texts of up to 67 million words.
    """
    better = lambda x: F.struct((-(x.length / x.period)).alias("ratio"), x.start.alias("start"), x.period.alias("period"), x.length.alias("length"))
    lines = F.concat_ws("", F.transform("runs", lambda x: F.concat_ws("", F.concat_ws(",", x.start, x.length, x.period), F.lit("\n"))))
    best = found.withColumn("best", F.array_min(F.transform("runs", better)))
    return best.select(
        *others, F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("best.length * 1000 div best.period").alias("exponent_milli"), F.sha2(lines, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


def looped(h: int, n: int) -> np.ndarray | None:
    """The word numbers of a text whose tail repeats: ``h`` picks the texts, where the tail begins and how long its period is."""
    if h % 10 or not n:
        return None
    g = h // 10
    begin = g % n
    period = 1 + (n - begin) // (3 + g % 8)
    i = np.arange(n)
    return np.where(i < begin, i, begin + (i - begin) % period)

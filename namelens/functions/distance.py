"""Weighted edit distance of sound skeletons, in quarters of a letter, with the rules that it used."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import lexicon as lx
from . import edits
from .edits import CHEAP, CLASSES, FULL, near_classes
from .text import let, remembered

STEP = "struct<cost:int,path:array<struct<rule:string,note:string>>>"


def step(cost: Column, rule: Column, note: Column) -> Column:
    return F.struct(cost.cast("int").alias("cost"), F.struct(rule.alias("rule"), note.alias("note")).alias("edit"))


def substitution(x: Column, y: Column, uncertain: Column) -> Column:
    near = F.concat(x, y).isin(*lx.NEAR, *[p[::-1] for p in lx.NEAR])
    weak = x.isin(*lx.WEAK) & y.isin(*lx.WEAK)
    cost = F.when(x == y, 0).when(near & uncertain, 1).when(near, 2).when(weak, 1).otherwise(4)
    rule = F.when(x == y, "CLS-1").when(near & uncertain, "LAT-1").when(near, "CLS-2").when(weak, "WEAK-1").otherwise("SKEL-3")
    return step(cost, rule, F.when(x == y, "").otherwise(F.concat(x, F.lit("/"), y)))


def indel(x: Column, uncertain: Column, sign: str) -> Column:
    weak = x.isin(*lx.WEAK)
    cost = F.when(uncertain | weak, 1).otherwise(4)
    rule = F.when(uncertain, "HEB-2").when(weak, "WEAK-1").otherwise("SKEL-3")
    return step(cost, rule, F.concat(F.lit(sign), x))


def skeleton_distance(s1: Column, s2: Column, w1: Column, w2: Column) -> Column:
    """struct<cost, rules, notes> for two skeletons with their uncertain letters.

    A row of the edit table is folded from the one above it. Each cell carries its cheapest way; at equal cost a
    substitution goes before a deletion, and that before an insertion. Rules come in the order of a walk from the end.
    """
    def at(text: Column, k: Column) -> Column:
        return F.substring(text, k, F.lit(1))

    def add(cell: Column, s: Column) -> Column:
        return let(F.struct(cell.alias("c"), s.alias("s")), lambda x: F.struct((x.c.cost + x.s.cost).cast("int").alias("cost"), F.concat(x.c.path, F.array(x.s.edit)).alias("path")))

    zero = F.struct(F.lit(0).alias("cost"), F.array().cast("array<struct<rule:string,note:string>>").alias("path"))
    upto = lambda n: F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
    sure = lambda w, k: F.coalesce(F.get(w, k - 1), F.lit(False))
    n, m = F.length(s1), F.length(s2)
    cells = f"array<{STEP}>"
    first = F.aggregate(upto(m), F.array(zero).cast(cells), lambda row, j: F.concat(row, F.array(add(F.element_at(row, -1), indel(at(s2, j), sure(w2, j), "+")))).cast(cells))

    def next_row(above: Column, i: Column) -> Column:
        x, wx = at(s1, i), sure(w1, i)
        start = F.array(add(F.element_at(above, 1), indel(x, wx, "-"))).cast(cells)

        def cell(row: Column, j: Column) -> Column:
            y, wy = at(s2, j), sure(w2, j)
            sub = add(F.element_at(above, j), substitution(x, y, wx | wy))
            dele = add(F.element_at(above, j + 1), indel(x, wx, "-"))
            ins = add(F.element_at(row, j), indel(y, wy, "+"))
            best = let(F.struct(sub.alias("s"), dele.alias("d"), ins.alias("i")), lambda c: F.when((c.s.cost <= c.d.cost) & (c.s.cost <= c.i.cost), c.s).when(c.d.cost <= c.i.cost, c.d).otherwise(c.i))
            return F.concat(row, F.array(best)).cast(cells)

        return F.aggregate(upto(m), start, cell)


    def told(final: Column) -> Column:
        rules = F.array_distinct(F.transform(F.reverse(final.path), lambda e: e.rule))
        notes = F.filter(F.transform(final.path, lambda e: e.note), lambda t: t != "")
        return F.struct(final.cost.alias("cost"), rules.alias("rules"), notes.alias("notes"))

    return let(F.element_at(F.aggregate(upto(n), first, next_row), -1), told)


def letters_of(cons: Column, weak: Column) -> Column:
    """struct<at, drop, unsure, cheap, held, near, firm> of a skeleton.

    ``at`` numbers its ``many`` classes, ``drop`` is what each costs to insert or delete, ``cheap`` counts the cheap ones.
    ``held``, ``near`` and ``firm`` are sets of classes as bits: those it has, these and what is near them, and those that
    aren't cheap.
    """
    bits = lambda xs: F.aggregate(xs, F.lit(0), lambda acc, x: acc.bitwiseOR(x))
    around = F.expr("array(" + ", ".join(str(sum(1 << CLASSES.index(y) for y in x + near_classes(x))) for x in CLASSES) + ")")
    one = lambda k: F.call_function("shiftleft", F.lit(1), k)

    def told(x: Column) -> Column:
        firm = F.zip_with(x.at, x.drop, lambda k, d: F.when(d == FULL, one(k)).otherwise(0))
        return F.struct(
            x.at.alias("at"), F.size(x.at).alias("many"), x.drop.alias("drop"), x.weak.alias("unsure"), F.size(F.filter(x.drop, lambda d: d == CHEAP)).alias("cheap"),
            bits(F.transform(x.at, one)).alias("held"), bits(F.transform(x.at, lambda k: F.get(around, k))).alias("near"), bits(firm).alias("firm"),
        )

    at = F.transform(F.filter(F.split(cons, ""), lambda c: c != ""), lambda c: F.instr(F.lit(CLASSES), c) - 1)
    weak_ones = [CLASSES.index(c) for c in lx.WEAK]
    drop = lambda x: F.zip_with(x.at, x.weak, lambda k, w: F.when(w | k.isin(*weak_ones), CHEAP).otherwise(FULL))
    return let(let(F.struct(at.alias("at"), weak.alias("weak")), lambda x: F.struct(x.at.alias("at"), x.weak.alias("weak"), drop(x).alias("drop"))), told)


def least_cost(x: Column, y: Column) -> Column:
    """A bound that the cost of two skeletons' letters never falls below, from their lengths and the classes they have.

    The longer one loses letters, the cheap ones first. Each class that isn't cheap and that the other hasn't costs a
    quarter at least, and a whole letter where nothing near it is there either.
    """
    n, m = x.many, y.many
    surplus, cheap = F.abs(n - m), F.when(n > m, x.cheap).otherwise(y.cheap)
    lengths = F.least(surplus, cheap) * CHEAP + F.greatest(surplus - cheap, F.lit(0)) * FULL
    count = lambda a, b: F.bit_count(a.bitwiseAND(F.bitwise_not(b)))
    missing = lambda a, b: count(a.firm, b.near) * (FULL - 1) + count(a.firm, b.held)
    return F.greatest(lengths, missing(x, y), missing(y, x))


@remembered
def in_batches(name: str, kind: str):
    """A function of ``edits`` for columns."""
    return F.arrow_udf(getattr(edits, name), kind)


def skeleton_way(s1: Column, s2: Column, w1: Column, w2: Column) -> Column:
    """As ``skeleton_distance``, by batches; null where a skeleton is null. It can't stand within a function of an array's elements."""
    return in_batches("edit_ways", "struct<cost:int,rules:array<string>,notes:array<string>>")(s1, s2, w1, w2)


def bounded_cost(x: Column, y: Column, limit: Column) -> Column:
    """The cost of two skeletons' letters by batches, or null if it is beyond ``limit``; tables of those that must be aren't begun."""
    asked = least_cost(x, y) <= limit
    sides = [F.when(asked, s.at) if c == "at" else s[c] for s in (x, y) for c in ("at", "drop", "unsure")]
    cost = in_batches("edit_costs", "int")(*sides)
    return F.when(cost <= limit, cost)

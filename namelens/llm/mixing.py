"""Mixing sources to target weights by Sainte-Laguë apportionment, with DataFrame functions only.

Sources get target sizes by weight, stopped at ``most`` times what they hold. The mix is divided into blocks of equal
token counts; sources, and within each source its shards, get whole numbers of blocks by highest quotients
v / (2 s + 1). A shard's documents stand in a seeded order, which is divided into blocks. A shard is read whole as often
as its quota allows; for the rest of its quota blocks are drawn in a seeded order, the last one in part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import written

WORD = r"[^\x20\x09-\x0D]+"


def sized(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int, row_col: str | None = None) -> DataFrame:
    """(doc_id, source, size, draw, row): ``row`` tells rows apart that agree in all else, where ``row_col`` names such a column."""
    words = F.regexp_count(F.coalesce(F.col(text_col).cast("string"), F.lit("")), F.lit(WORD)).cast("long")
    doc = F.col(id_col).cast("long")
    return docs.select(doc.alias("doc_id"), F.col(source_col).cast("string").alias("source"), words.alias("size"), F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(doc.cast("string"), F.lit("")))).alias("draw"), (F.col(row_col) if row_col else F.lit(0)).cast("long").alias("row"))


def targets(rows: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """(source, place, source_size, target, total, parties): a row for each source, ``place`` its rank by code point."""
    by_name, everything = Window.orderBy(F.col("source").asc_nulls_last()), Window.partitionBy()
    s = rows.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("place", F.row_number().over(by_name) - 1)
    s = s.withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("place") % len(weights) + 1).cast("int")))
    s = s.withColumn("total", F.sum("source_size").over(everything)).withColumn("top", most * F.col("source_size"))
    # Sources reach their stop in the order of top / weight; level is the share of one weight if all before are stopped.
    by_stop = Window.orderBy(F.col("top") / F.col("weight"), "place")
    before, after = by_stop.rowsBetween(Window.unboundedPreceding, -1), by_stop.rowsBetween(0, Window.unboundedFollowing)
    level = (F.col("total") - F.coalesce(F.sum("top").over(before), F.lit(0))) / F.sum("weight").over(after)
    s = s.withColumn("level", level)
    final = F.max(F.when(F.col("level") <= F.col("top") / F.col("weight"), F.col("level"))).over(everything)
    s = s.withColumn("final", final)
    target = F.when(F.col("final").isNull(), F.col("top").cast("double")).otherwise(F.least(F.col("top").cast("double"), F.col("final") * F.col("weight")))
    return s.select("source", "place", "source_size", target.alias("target"), "total")


def apportioned(parties: DataFrame, votes: Column, seats: Column, within: list[str], order: list[str]) -> DataFrame:
    """Adds ``quota``: Sainte-Laguë seats by highest quotients, apart for each value of ``within``.

    With p parties and n seats, the divisor lies between V / (n + p / 2) and V / (n - p / 2); only the quotients that
    these bounds leave open are made and ranked, about two for each party.
    """
    group = Window.partitionBy(*within)
    p = parties.withColumn("votes", votes.cast("double")).withColumn("seats", seats.cast("long"))
    p = p.withColumn("all_votes", F.sum("votes").over(group)).withColumn("n_parties", F.count("*").over(group))
    share = F.when(F.col("all_votes") > 0, F.col("votes") / F.col("all_votes")).otherwise(F.lit(0.0))
    low = F.greatest(F.lit(0), F.floor(share * (F.col("seats") - F.col("n_parties") / 2) - 0.5)).cast("long")
    high = F.greatest(low, F.floor(share * (F.col("seats") + F.col("n_parties") / 2) + 1.5)).cast("long")
    p = p.withColumn("low", low).withColumn("high", high).withColumn("open", F.col("seats") - F.sum("low").over(group))
    q = p.withColumn("s", F.explode(F.sequence("low", "high"))).withColumn("quotient", F.col("votes") / (2 * F.col("s") + 1))
    q = q.withColumn("rank", F.row_number().over(Window.partitionBy(*within).orderBy(F.desc("quotient"), *order)))
    won = (F.col("rank") <= F.col("open")) & (F.col("votes") > 0)
    kept = [c for c in parties.columns]
    return q.groupBy(*kept).agg((F.min("low") + F.sum(won.cast("long"))).alias("quota"))


def drawn(rows: DataFrame, weights: tuple[int, ...], most: int, block_words: int, shard_words: int, seed: int) -> DataFrame:
    """``rows`` of ``sized`` with source_size, target and taken."""
    block = F.greatest(F.lit(1), F.least(F.lit(block_words), F.floor(F.col("total") / 4096))).cast("long")
    sources = targets(rows, weights, most).withColumn("block", block).withColumn("n_shards", F.greatest(F.lit(1), F.ceil(F.col("source_size") / shard_words)).cast("long"))
    sources = apportioned(sources.withColumn("one", F.lit(0)), F.col("target"), F.round(F.col("total") / F.col("block")), ["one"], ["place"])
    by_source = sources.select(F.col("source").alias("name"), "place", "source_size", "target", "block", "n_shards", "quota")
    placed = rows.join(by_source, rows.source.eqNullSafe(by_source.name)).withColumn("shard", F.conv(F.substring("draw", 1, 8), 16, 10).cast("long") % F.col("n_shards"))
    placed = placed.select("doc_id", "size", "draw", "row", "place", "shard", "source_size", "target", "block", "quota")
    shards = placed.groupBy("place", "shard").agg(F.sum("size").alias("shard_size"), F.first("quota").alias("source_quota"), F.first("block").alias("block_size"))
    shards = apportioned(shards, F.col("shard_size"), F.col("source_quota"), ["place"], ["shard"])
    words = F.least(F.col("quota") * F.col("block_size"), most * F.col("shard_size"))
    whole = F.expr("case when shard_size > 0 then words div shard_size else 0 end")
    rest = F.expr("case when shard_size > 0 then words % shard_size else 0 end")
    shards = written(shards.withColumn("words", words).select("place", "shard", "shard_size", "block_size", whole.alias("whole"), rest.alias("rest")), "shards")
    # The blocks of each shard that has a rest, in the order in which they are drawn, and how many of their first words are taken.
    blocks = shards.where("rest > 0").select("*", F.explode(F.expr("sequence(0L, (shard_size - 1) div block_size)")).alias("b"))
    blocks = blocks.withColumn("words", F.least(F.col("block_size"), F.col("shard_size") - F.col("b") * F.col("block_size")))
    lot = F.md5(F.concat_ws(":", F.lit(str(seed)), "place", "shard", "b"))
    before = Window.partitionBy("place", "shard").orderBy(lot, "b").rowsBetween(Window.unboundedPreceding, -1)
    blocks = blocks.withColumn("part", F.least(F.col("words"), F.col("rest") - F.coalesce(F.sum("words").over(before), F.lit(0)))).where("part > 0").select("place", "shard", "b", "part")
    start = F.coalesce(F.sum("size").over(Window.partitionBy("place", "shard").orderBy("draw", "doc_id", "size", "row").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    lined = written(placed.withColumn("start", start).join(shards, ["place", "shard"]).drop("quota", "block", "draw"), "lined")
    spread = lined.where("size > 0 and rest > 0").select("place", "shard", "start", "size", "block_size", F.explode(F.expr("sequence(start div block_size, (start + size - 1) div block_size)")).alias("b"))
    low, high = F.greatest(F.col("start"), F.col("b") * F.col("block_size")), F.least(F.col("start") + F.col("size"), F.col("b") * F.col("block_size") + F.col("part"))
    # Spark takes the exploded blocks for as small as their shards and would broadcast them.
    more = spread.join(blocks.hint("merge"), ["place", "shard", "b"]).where(high > low).groupBy("place", "shard", "start").agg(F.sum(high - low).alias("more"))
    # Only a document that has words begins where it begins; the others take nothing.
    out = lined.join(more.hint("merge"), ["place", "shard", "start"], "left")
    taken = F.when(F.col("size") > 0, F.col("whole") * F.col("size") + F.coalesce("more", F.lit(0))).otherwise(0)
    return out.select("doc_id", "row", "size", "source_size", "target", taken.cast("long").alias("taken"))


def mix(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 64, shard_words: int = 400_000, seed: int = 1) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row.

    Blocks have ``block_words`` words, fewer where the total is under 4096 such blocks. Null texts have size 0 and are
    never taken; a null source is a source of its own, last in order; a null id counts as the empty id; repeated rows
    count as often as they occur; other columns are ignored; an empty table gives an empty table. Rows that agree in
    id and size may be taken in either's place. A row for each source passes through one task, which its few allow.
    """
    rows = written(sized(docs, id_col, text_col, source_col, seed), "sizes")
    return drawn(rows, weights, most, block_words, shard_words, seed).drop("row")


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", chars_col: str | None = "n_chars", weights: tuple[int, ...] = (5, 2, 1), most: int = 3, block_words: int = 64, shard_words: int = 400_000, seed: int = 1) -> DataFrame:
    """The rows of ``docs`` as the mix takes them: whole copies, and one cut to its first words where blocks end.

    A cut text keeps the white space between its words. Rows of which nothing is taken are dropped. Rows are numbered in
    a table written first, so rows that share id and size are told apart. Null texts, ids and sources and repeated rows
    are as in ``mix``; the columns of ``docs`` stay; an empty table gives an empty table.
    """
    numbered = written(docs.withColumn("__row", F.monotonically_increasing_id()), "numbered")
    rows = written(sized(numbered, id_col, text_col, source_col, seed, "__row"), "sizes")
    taken = drawn(rows, weights, most, block_words, shard_words, seed).where("taken > 0").select(F.col("row").alias("__row"), F.col("size").alias("__size"), F.col("taken").alias("__taken"))
    joined = numbered.join(taken.hint("merge"), "__row")
    text, part = F.col(text_col).cast("string"), F.expr("__taken % __size")
    cut = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0)), F.lit(1), part.cast("int")), "")
    texts = F.concat(F.array_repeat(text, F.expr("int(__taken div __size)")), F.when(part > 0, F.array(cut)).otherwise(F.array().cast("array<string>")))
    out = joined.withColumn("__text", F.explode(texts))
    chosen = [F.col("__text").alias(c) if c == text_col else F.length("__text").cast(docs.schema[c].dataType).alias(c) if c == chars_col else F.col(f"`{c}`") for c in docs.columns]
    return out.select(*chosen)

"""Watchlist ingest from consolidated CSV files."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import written

COLUMNS = ("id", "schema", "name", "aliases", "birth_date", "countries", "sanctions", "dataset")
ALIASES = 12


def multi(c: Column) -> Column:
    """The parts of a list separated by semicolons, trimmed, without blanks."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), ";"), lambda x: F.trim(x)), lambda x: x != "")


def full_iso_date(c: Column) -> Column:
    return F.when(F.trim(c).rlike("^[0-9]{4}-[0-9]{2}-[0-9]{2}$"), F.trim(c))


#: A stretch in quotes, two of which stand for one; the last may be left open.
QUOTED = '"[^"]*+(?:""[^"]*+)*+(?:"|$)'
BLOCK = ("file", "block")


def unquoted(field: Column) -> Column:
    """A field without the quotes around any part of it."""
    parts = F.regexp_extract_all(field, F.lit(f'{QUOTED}|[^"]++'), F.lit(0))
    closed = lambda x: F.length(F.regexp_replace(x, '[^"]+', "")) % 2 == 0
    body = lambda x: F.substring(x, F.lit(2), F.length(x) - F.when(closed(x), 2).otherwise(1))
    inner = lambda x: F.replace(body(x), F.lit('""'), F.lit('"'))
    return F.array_join(F.transform(parts, lambda x: F.when(x.startswith('"'), inner(x)).otherwise(x)), "")


def csv_lines(spark: SparkSession, path: str) -> DataFrame:
    """(file, size, block, at, line, odd): the lines of text files, by the block that each was read in and in order of ``at`` in it."""
    lines = spark.read.text(path, lineSep="\n").select("value", "_metadata.file_path", "_metadata.file_size", "_metadata.file_block_start")
    odd = F.length(F.regexp_replace("value", '[^"]+', "")) % 2 == 1
    return lines.select(F.col("file_path").alias("file"), F.col("file_size").alias("size"), F.col("file_block_start").alias("block"), F.monotonically_increasing_id().alias("at"), F.col("value").alias("line"), odd.alias("odd"))


def csv_records(spark: SparkSession, path: str) -> DataFrame:
    """(file, row_order, fields): the records of CSV files in their order, the header among them.

    Files are read in blocks. A line end is within quotes if an odd number of quotes stands before it in its file; so each
    block's quotes are counted, the counts of the blocks before it summed, and a record begins at each line with an even
    number before it. Records of several lines are put together, also across blocks. Lines are written to the shared folder
    with their blocks, since the counts and the records both need them.
    """
    lines = written(csv_lines(spark, path), "csv-lines")
    ends = lines.groupBy("file", "size").agg(F.sum(F.octet_length("line") + 1).alias("bytes"), F.max(F.struct("block", "at")).alias("last")).where("bytes = size")
    after = ends.select("file", "last.block", (F.col("last.at") + 1).alias("at"), F.lit("").alias("line"), F.lit(False).alias("odd"))
    lines = lines.drop("size").unionByName(after)  # what follows a file's last line end, which may be within quotes
    of_file, in_order = Window.partitionBy("file").orderBy("block"), Window.orderBy(*BLOCK)
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    counts = lines.groupBy(*BLOCK).agg(F.count_if("odd").alias("odds"), F.min("at").alias("first"), F.count("*").alias("n"))
    blocks = counts.select(*BLOCK, "first", before("odds", of_file).alias("odds_before"), before("n", in_order).alias("lines_before"))
    within = Window.partitionBy(*BLOCK).orderBy("at")
    open_ = (F.col("odds_before") + F.coalesce(F.count_if("odd").over(within.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))) % 2 == 1
    placed = lines.join(blocks, list(BLOCK)).withColumn("row_order", F.col("lines_before") + F.col("at") - F.col("first")).withColumn("open", open_)
    placed = written(placed.withColumn("start", F.max(F.when(~F.col("open"), F.col("row_order"))).over(within)).select("file", "block", "row_order", "line", "odd", "open", "start"), "csv-placed")
    starts = placed.groupBy(*BLOCK).agg(F.max("start").alias("last"))
    starts = starts.select(*BLOCK, F.max("last").over(of_file.rowsBetween(Window.unboundedPreceding, -1)).alias("carried"))
    whole = placed.where("not open and not odd").select("file", "row_order", F.col("line").alias("text"))
    parts = placed.where("open or odd").join(starts, list(BLOCK)).withColumn("start", F.coalesce("start", "carried"))
    joined = parts.groupBy("file", "start").agg(F.array_sort(F.collect_list(F.struct("row_order", "line"))).alias("ls"))
    texts = whole.unionByName(joined.select("file", F.col("start").alias("row_order"), F.array_join(F.transform("ls", lambda x: x.line), "\n").alias("text")))
    pieces = texts.select("file", "row_order", F.posexplode(F.regexp_extract_all("text", F.lit(f'(?:[^"\\r]++|{QUOTED})++'), F.lit(0))).alias("piece", "text"))
    fields = F.transform(F.regexp_extract_all(F.concat(F.lit(","), "text"), F.lit(f',((?:[^",]++|{QUOTED})*+)'), F.lit(1)), unquoted)
    rows = pieces.select("file", "row_order", "piece", fields.alias("fields")).where((F.size("fields") > 1) | (F.get("fields", F.lit(0)) != ""))
    return rows


def read_csv(spark: SparkSession, path: str) -> DataFrame:
    """COLUMNS by each file's header, and ``row_order``; a missing field is empty, of columns with one name the last counts.

    A quote opens or closes a quoted stretch anywhere in a field. Lines end in LF, CR or both; blank ones are no records.
    """
    rows = written(csv_records(spark, path), "csv-records")
    first = rows.groupBy("file").agg(F.min_by("fields", F.struct("row_order", "piece")).alias("header"), F.min(F.struct("row_order", "piece")).alias("top"))
    body = rows.join(first, "file").where(F.struct("row_order", "piece") > F.col("top"))
    place = lambda name: F.size("header") - F.array_position(F.reverse("header"), name)
    value = lambda name: F.when(F.array_contains("header", name), F.get("fields", place(name).cast("int")))
    return body.select(F.col("row_order"), *[F.coalesce(value(c), F.lit("")).alias(c) for c in COLUMNS])


def to_entries(rows: DataFrame, kind: str, most_aliases: int | None = ALIASES) -> DataFrame:
    """Persons with a name, as entries of ``kind``; keeps ``row_order``.

    An entry has its first ``most_aliases`` aliases other than its name; None keeps all of them.
    """
    people = rows.where((F.coalesce(F.nullif(F.trim("schema"), F.lit("")), F.lit("Person")) == "Person") & (F.trim("name") != ""))
    aliases = F.filter(multi(F.col("aliases")), lambda x: x != F.trim("name"))
    aliases = aliases if most_aliases is None else F.slice(aliases, 1, most_aliases)
    first = lambda c: F.get(multi(F.col(c)), F.lit(0))
    return people.select("row_order", F.trim("id").alias("id"), F.col("dataset").alias("source"), F.lit(kind).alias("type"), F.coalesce(first("sanctions"), F.trim("dataset")).alias("program"), F.trim("name").alias("name"), aliases.alias("aliases"), full_iso_date(first("birth_date")).alias("dob"), F.lit(None).cast("string").alias("sex"), F.upper(first("countries")).alias("nationality"))


def first_of_each(sanctions: DataFrame, peps: DataFrame | None = None, stretch: int = 1 << 16) -> DataFrame:
    """The first row of each id, sanctions before PEPs, in order of position as ``idx``.

    Rows are numbered within stretches of ``row_order``; only the stretches' counts are summed in one order.
    """
    both = sanctions.withColumn("part", F.lit(0))
    both = both if peps is None else both.unionByName(peps.withColumn("part", F.lit(1)))
    first = both.withColumn("k", F.row_number().over(Window.partitionBy("id").orderBy("part", "row_order"))).where("k = 1").drop("k")
    first = written(first.withColumn("stretch", F.floor(F.col("row_order") / stretch)), "entries")
    counts = first.groupBy("part", "stretch").agg(F.count("*").alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("part", "stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    numbered = first.join(counts.select("part", "stretch", before.alias("before")), ["part", "stretch"])
    place = F.row_number().over(Window.partitionBy("part", "stretch").orderBy("row_order"))
    return numbered.withColumn("idx", F.col("before") + place - 1).drop("part", "stretch", "before", "row_order")


def write_entries(entries: DataFrame, path: str) -> None:
    """The list as JSON lines, one entry a line, in files by kind."""
    entries.write.partitionBy("type").json(path)


def chosen(live: DataFrame | None, sample: DataFrame) -> DataFrame:
    """The live list if it has an entry, else the sample."""
    return sample if live is None or live.isEmpty() else live


def load_watchlist(spark: SparkSession, sanctions_path: str, peps_path: str | None = None, most_aliases: int | None = ALIASES) -> DataFrame:
    """(idx, id, source, type, program, name, aliases, dob, sex, nationality) from one or two CSV files with a header.

    Rows are taken in the order of the files.
    """
    peps = to_entries(read_csv(spark, peps_path), "pep", most_aliases) if peps_path else None
    return first_of_each(to_entries(read_csv(spark, sanctions_path), "sanction", most_aliases), peps)

"""Where a record's field values came from: a state for each field, folded from events of capture and typing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

TYPED, CONFIRMED, VALIDATED, UNCONFIRMED = "typed", "confirmed", "mrz-validated", "ocr-unconfirmed"
KEYS = ("record_id", "side", "field")
#: Events that set the state whatever it was.
ANCHORS = ("proposal", "edit", "clear")


def read_state(validated: Column) -> Column:
    return F.when(F.coalesce(validated, F.lit(False)), VALIDATED).otherwise(UNCONFIRMED)


def provenance_states(events: DataFrame) -> DataFrame:
    """(record_id, side, field, state, value) after all events of each field.

    ``events``: record_id, side, field, seq (its order within the field), event, value, validated. A ``proposal`` puts
    in a value that was read; an ``edit`` a typed one; ``clear`` empties the field; ``confirm`` accepts an unconfirmed
    value, or a typed one that equals the value last proposed since the last clear; ``restore`` puts a proposal back
    over a typed value that differs. Other events, and a restore or confirm that doesn't apply, change nothing.
    Events of equal ``seq`` are taken as anchors first, then by name and value.

    No group is collected: the last anchor decides all but what a confirm or restore after it can change, so two
    aggregations with partial results suffice, however many events a field has.
    """
    order = F.struct(F.col("seq"), F.when(F.col("event").isin(*ANCHORS), 0).otherwise(1).alias("later"), F.col("event").alias("name"), F.coalesce("value", F.lit("")).alias("text"))
    said = F.struct("event", "value", "validated")
    ordered = events.select(*KEYS, "event", "value", "validated", order.alias("at"))
    is_ = lambda *names: F.col("event").isin(*names)
    anchors = ordered.groupBy(*KEYS).agg(
        F.max_by(F.when(is_(*ANCHORS), said), F.when(is_(*ANCHORS), F.col("at"))).alias("anchor"),
        F.max(F.when(is_(*ANCHORS), F.col("at"))).alias("anchored"),
        F.max_by(F.when(is_("proposal"), said), F.when(is_("proposal"), F.col("at"))).alias("read"),
        F.max(F.when(is_("proposal"), F.col("at"))).alias("read_at"),
        F.max(F.when(is_("clear"), F.col("at"))).alias("cleared"),
    )
    later = ordered.where(is_("confirm", "restore")).join(anchors.select(*[F.col(k).alias(f"k_{k}") for k in KEYS], "anchored"), [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in KEYS])
    later = later.where(F.col("anchored").isNull() | (F.col("at") > F.col("anchored"))).groupBy(*KEYS).agg(
        F.max(F.when(is_("confirm"), F.col("at"))).alias("confirmed"), F.min(F.when(is_("restore"), F.col("at"))).alias("restored")
    )
    rows = anchors.join(later.select(*[F.col(k).alias(f"k_{k}") for k in KEYS], "confirmed", "restored"), [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in KEYS], "left")
    readable = F.coalesce(F.col("read_at") > F.col("cleared"), F.col("read_at").isNotNull())
    read_value = F.when(readable, F.coalesce("read.value", F.lit("")))
    value = F.coalesce(F.when(F.col("anchor.event") != "clear", F.col("anchor.value")), F.lit(""))
    state = F.when(F.col("anchor.event") == "proposal", read_state(F.col("anchor.validated"))).otherwise(TYPED)
    rows = rows.select(*KEYS, value.alias("v"), state.alias("s"), read_value.alias("r"), read_state(F.col("read.validated")).alias("rs"), "confirmed", "restored")
    confirmed = F.col("confirmed").isNotNull()
    after = confirmed & (F.col("confirmed") > F.col("restored"))
    put_back = (F.col("s") == TYPED) & (F.col("v") != F.col("r")) & F.col("restored").isNotNull()
    accepted = confirmed & ((F.col("s") == UNCONFIRMED) | ((F.col("s") == TYPED) & (F.col("v") == F.col("r"))))
    final = F.when(put_back & after & (F.col("rs") == UNCONFIRMED), CONFIRMED).when(put_back, F.col("rs")).when(accepted, CONFIRMED).otherwise(F.col("s"))
    return rows.select(*KEYS, final.alias("state"), F.when(put_back, F.col("r")).otherwise(F.col("v")).alias("value"))


def provenance_maps(states: DataFrame) -> DataFrame:
    """(record_id, side, provenance): a record's machine-read fields and their states, as the field checks take them."""
    read = states.where(F.col("state") != TYPED).groupBy("record_id", "side")
    return read.agg(F.map_from_entries(F.array_sort(F.collect_set(F.struct("field", "state")))).alias("provenance"))

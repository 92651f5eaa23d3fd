"""Screening people as they arrive, and field states kept as events arrive."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ..operators.provenance import ANCHORS, CONFIRMED, KEYS, TYPED, UNCONFIRMED, VALIDATED
from ..operators.screening import HIT, screen
from ..sources.shared import written


def screen_stream(people: DataFrame, entries: DataFrame, out: str, checkpoint: str, hit: int = HIT, blocking: str = "reference", index: DataFrame | None = None, available_now: bool = False, rows: bool = True) -> StreamingQuery:
    """Writes the hits of every micro-batch of ``people`` below ``out``, one folder for each batch.

    A batch that is run again after a failure overwrites its own folder, so each hit is there once. A query's ranking
    is within its batch: a query_id must come in one row. ``rows`` is that of ``screen``. Screening reads people and entries
    several times, so each batch is written first, and the entries once.
    """
    entries = written(entries, "entries")

    def write(batch: DataFrame, number: int) -> None:
        screen(written(batch, "batch"), entries, hit, blocking, index, rows).write.mode("overwrite").parquet(f"{out}/batch={number}")

    writer = people.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer).start()


def advance(state: tuple[str, str, str | None, bool], event: str, value: str | None, validated: bool | None) -> tuple[str, str, str | None, bool]:
    """(state, value, value read, whether that is validated) after one event of a field."""
    now, held, read, sure = state
    if event == "proposal":
        return VALIDATED if validated else UNCONFIRMED, value or "", value or "", bool(validated)
    if event == "edit":
        return TYPED, value or "", read, sure
    if event == "clear":
        return TYPED, "", None, False
    if event == "confirm" and (now == UNCONFIRMED or (now == TYPED and held == read)):
        return CONFIRMED, held, read, sure
    if event == "restore" and now == TYPED and read is not None and held != read:
        return VALIDATED if sure else UNCONFIRMED, read, read, sure
    return state


def provenance_stream(events: DataFrame) -> DataFrame:
    """(record_id, side, field, state, value) of each field that a micro-batch touches, in update mode.

    The columns of ``events`` are those of ``provenance_states``. Events of a batch are taken by ``seq``, so the result
    equals the batch form's where no event comes after a later one's batch. One small state is kept for each field.
    """

    def fold(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        now = state.get if state.exists else (TYPED, "", None, False)
        rows = pd.concat(list(batches)).assign(later=lambda d: ~d["event"].isin(ANCHORS), text=lambda d: d["value"].fillna("")).sort_values(["seq", "later", "event", "text"])
        for event, value, validated in rows[["event", "value", "validated"]].itertuples(index=False):
            now = advance(now, event, None if pd.isna(value) else value, None if pd.isna(validated) else bool(validated))
        state.update(now)
        yield pd.DataFrame([(*key, now[0], now[1])], columns=[*KEYS, "state", "value"])

    return events.groupBy(*KEYS).applyInPandasWithState(fold, "record_id long, side string, field string, state string, value string", "state string, value string, read string, sure boolean", "update", GroupStateTimeout.NoTimeout)


STATE = "record_id long, side string, field string, state string, value string"
EVENT = "at long, seq long, event string, value string, validated boolean"
START = (TYPED, "", None, False)
#: Neighbouring records, as a power of two, whose fields are kept as one state.
BLOCK = 8
ROCKS = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def in_order(e: tuple) -> tuple:
    """Where an event stands among others: by ``seq``, anchors first, then by name and value."""
    return e[1], e[2] not in ANCHORS, e[2], e[3] or ""


def ripened(now: tuple, events: list[tuple], watermark: int) -> tuple[tuple, list[tuple]]:
    """The state after all events up to the watermark, and the later events."""
    for e in sorted((e for e in events if e[0] <= watermark), key=in_order):
        now = advance(now, *e[2:])
    return now, [e for e in events if e[0] > watermark]


class FieldStates(StatefulProcessor):
    """A field's state behind the watermark, and the events after it in any order.

    Events that no late one can precede any more are folded into the state and forgotten, when the field has new events or
    by a timer; so a field holds its events of one delay at most.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "state string, value string, read string, sure boolean")
        self.recent = handle.getListState("recent", EVENT)

    def settle(self, events: list[tuple], watermark: int) -> tuple[tuple, list[tuple]]:
        """The state after all events up to the watermark, which is kept, and the later events, which are kept too."""
        before = tuple(self.settled.get()) if self.settled.exists() else START
        now, rest = ripened(before, events, watermark)
        if len(rest) < len(events):
            self.settled.update(now)
        if rest:
            self.recent.put(rest)
            self.handle.registerTimer(max(e[0] for e in rest) + 1)
        elif self.recent.exists():
            self.recent.clear()
        return now, rest

    def held(self) -> list[tuple]:
        return [tuple(e) for e in self.recent.get()] if self.recent.exists() else []

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new = []
        for frame in rows:
            for at, seq, event, value, validated in frame[["millis", "seq", "event", "value", "validated"]].itertuples(index=False):
                new.append((int(at), int(seq), event, None if pd.isna(value) else value, None if pd.isna(validated) else bool(validated)))
        now, rest = self.settle(self.held() + new, timerValues.getCurrentWatermarkInMs())
        for e in sorted(rest, key=in_order):
            now = advance(now, *e[2:])
        yield pd.DataFrame([(*key, now[0], now[1])], columns=[*KEYS, "state", "value"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.settle(self.held(), timerValues.getCurrentWatermarkInMs())
        return iter(())

    def close(self) -> None:
        pass


class BlockStates(FieldStates):
    """``FieldStates`` of all fields of a block of records: one group and two values of state for these, not one for each field.

    Each is a JSON text, a map of fields (record_id, side, field) to a state or to later events.
    """

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.settled = handle.getValueState("settled", "fields string")
        self.recent = handle.getValueState("recent", "fields string")

    def kept(self, variable) -> dict[tuple, list]:
        return {tuple(k): v for k, v in json.loads(variable.get()[0])} if variable.exists() else {}

    def settle_all(self, new: dict[tuple, list[tuple]], watermark: int) -> tuple[dict[tuple, tuple], dict[tuple, list[tuple]]]:
        """Each field's state after its events up to the watermark, and its later events; both are kept."""
        states, events = self.kept(self.settled), {k: [tuple(e) for e in es] for k, es in self.kept(self.recent).items()}
        for k, es in new.items():
            events.setdefault(k, []).extend(es)
        changed, rest = False, {}
        for k, es in events.items():
            now, later = ripened(tuple(states.get(k, START)), es, watermark)
            if len(later) < len(es):
                states[k], changed = now, True
            if later:
                rest[k] = later
        if changed:
            self.settled.update((json.dumps(list(states.items())),))
        if rest:
            self.recent.update((json.dumps(list(rest.items())),))
            self.handle.registerTimer(max(e[0] for es in rest.values() for e in es) + 1)
        elif self.recent.exists():
            self.recent.clear()
        return states, rest

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        new: dict[tuple, list[tuple]] = {}
        given = lambda x: None if pd.isna(x) else x
        for frame in rows:
            for record, side, field, at, seq, event, value, validated in frame[["record", "side", "field", "millis", "seq", "event", "value", "validated"]].itertuples(index=False):
                field_key = (None if pd.isna(record) else int(record), given(side), given(field))
                new.setdefault(field_key, []).append((int(at), int(seq), event, given(value), None if pd.isna(validated) else bool(validated)))
        states, rest = self.settle_all(new, timerValues.getCurrentWatermarkInMs())
        out = []
        for k in new:
            now = tuple(states.get(k, START))
            for e in sorted(rest.get(k, ()), key=in_order):
                now = advance(now, *e[2:])
            out.append((*k, now[0], now[1]))
        yield pd.DataFrame(out, columns=[*KEYS, "state", "value"])

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        self.settle_all({}, timerValues.getCurrentWatermarkInMs())
        return iter(())


def late_provenance_stream(events: DataFrame, delay: str) -> DataFrame:
    """(record_id, side, field, state, value) of each field that a micro-batch touches, in update mode.

    Beside the columns of ``provenance_states`` ``events`` has ``at``, a timestamp that rises with ``seq`` within a field.
    Events may come in any order, up to ``delay`` behind the latest; later ones are left out. After each batch a field's state
    is that of the batch form over all its events so far. Needs the RocksDB state store, which is set in the session. Fields are
    kept in blocks of 2**BLOCK neighbouring record_ids, since calls to Python and to the state cost far more than an event does.
    """
    events.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", ROCKS)
    timed = events.withColumn("millis", F.unix_millis("at")).withColumn("record", F.col("record_id").cast("string")).withColumn("block", F.shiftright("record_id", BLOCK)).withWatermark("at", delay)
    return timed.groupBy("block").transformWithStateInPandas(BlockStates(), STATE, "update", "eventTime")


def latest_states(stream: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Writes each micro-batch's states below ``out``, one folder for each batch, until all that is there has been read."""

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).outputMode("update").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()

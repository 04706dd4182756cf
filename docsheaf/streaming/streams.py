"""Structured Streaming forms of the progress throttle, the live view of turns and the upsert of traces."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

_STATE = "state string"


def _load(state: GroupState, fresh: dict) -> dict:
    return json.loads(state.get[0]) if state.exists else fresh


def _stateful(stream: DataFrame, key: str, step, schema: str, quiet_ms: int | None, unfinished=None) -> DataFrame:
    """step(state dict, rows of a batch by seq) -> output rows. The state is a small JSON document.

    It goes when step() marks it as over, or when the key has been quiet for quiet_ms; unfinished(state) then gives last
    output rows. Set quiet_ms on streams that don't end, so that no state stays for ever; with it a query with the
    availableNow trigger doesn't end by itself, since Spark keeps looking for keys whose time is over.
    """
    kind = stream.schema[key].dataType.simpleString()
    names = [x.split()[0] for x in schema.split(", ")]

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        kept = _load(state, {})
        if state.hasTimedOut:
            state.remove()
            out = unfinished(kept) if unfinished else []
        else:
            rows = pd.concat(list(frames)).sort_values("seq")
            out = step(kept, rows.astype(object).where(rows.notna(), None).to_dict("records"))
            if kept.get("over"):
                state.remove()
            else:
                state.update((json.dumps(kept),))
                if quiet_ms:
                    state.setTimeoutDuration(quiet_ms)
        yield pd.DataFrame([{key: keys[0], **o} for o in out], columns=[key, *names])

    return stream.groupBy(key).applyInPandasWithState(run, f"{key} {kind}, {schema}", _STATE, "append", GroupStateTimeout.ProcessingTimeTimeout if quiet_ms else GroupStateTimeout.NoTimeout)


def _row_by_row(step):
    return lambda kept, rows: [o for row in rows for o in step(kept, row)]


def throttle_stream(events: DataFrame, seconds: float = 1.0, quiet_ms: int | None = None) -> DataFrame:
    """(call_id, seq, at): at most one row every `seconds` for each call. events: call_id, seq, at (seconds)."""

    def step(kept: dict, row: dict) -> list[dict]:
        if "at" in kept and row["at"] - kept["at"] < seconds:
            return []
        kept["at"] = float(row["at"])
        return [{"seq": int(row["seq"]), "at": float(row["at"])}]

    return _stateful(events, "call_id", _row_by_row(step), "seq long, at double", quiet_ms)


def live_turns(events: DataFrame) -> DataFrame:
    """(turn, started_ms, last_ms, open_spans) of turns without an end event, over a table of events."""
    open_ = F.sum(F.when(F.col("status") == "running", 1).otherwise(0))
    g = events.groupBy("turn").agg(F.min("started_ms").alias("started_ms"), F.max("started_ms").alias("last_ms"), open_.alias("open_spans"), F.max(F.col("kind") == "end").alias("ended"))
    return g.filter("not ended").drop("ended")


def live_turn_updates(events: DataFrame, quiet_ms: int | None = None) -> DataFrame:
    """(turn, update_no, started_ms, last_ms, open_spans, ended): what each batch of a stream makes of a turn.

    events: turn, seq, kind, status, started_ms. The state of a turn goes with its end event, or
    when it has been quiet for quiet_ms.
    """

    def step(kept: dict, rows: list[dict]) -> list[dict]:
        for row in rows:
            at = int(row["started_ms"])
            kept["started"], kept["last"] = min(kept.get("started", at), at), max(kept.get("last", at), at)
            kept["open"] = kept.get("open", 0) + (row["status"] == "running")
            kept["over"] = kept.get("over", False) or row["kind"] == "end"
        kept["n"] = kept.get("n", 0) + 1
        return [{"update_no": kept["n"], "started_ms": kept["started"], "last_ms": kept["last"], "open_spans": kept["open"], "ended": kept["over"]}]

    gone = lambda kept: [{"update_no": kept["n"] + 1, "started_ms": kept["started"], "last_ms": kept["last"], "open_spans": kept["open"], "ended": True}]
    return _stateful(events, "turn", step, "update_no long, started_ms long, last_ms long, open_spans long, ended boolean", quiet_ms, gone)


def live_now(updates: DataFrame) -> DataFrame:
    """(turn, started_ms, last_ms, open_spans): the newest update of each turn that hasn't ended."""
    newest = updates.groupBy("turn").agg(F.max_by(F.struct("started_ms", "last_ms", "open_spans", "ended"), "update_no").alias("u"))
    return newest.filter("not u.ended").select("turn", "u.started_ms", "u.last_ms", "u.open_spans")


def _newest(rows: DataFrame) -> DataFrame:
    return rows.groupBy("turn").agg(F.max("version").alias("version"), F.max_by("document", "version").alias("document"))


def upsert_trace_stream(events: DataFrame, path: str, checkpoint: str, available_now: bool = False) -> StreamingQuery:
    """Writes the newest document of each turn of every micro-batch (0.25 s apart) to the table at path, partitioned by
    batch. events: turn, version, document.

    A batch that is run again replaces its own partition. latest_traces() picks the newest version of each turn, so older
    versions never win whenever they come. Merging partitions is left to the table's maintenance.
    """

    def write(batch: DataFrame, number: int) -> None:
        _newest(batch.select("turn", "version", "document")).write.mode("overwrite").parquet(f"{path}/batch={number}")

    writer = events.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="250 milliseconds")).start()


def latest_traces(spark: SparkSession, path: str) -> DataFrame:
    """(turn, version, document) of the table that upsert_trace_stream() writes."""
    return _newest(spark.read.schema("turn string, version int, document string, batch long").parquet(path))

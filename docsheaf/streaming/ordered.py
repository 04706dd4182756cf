"""Streams of call chunks by event time: splitter, monitor and assembler as chained operators on typed state.

Chunks of a call are numbered 0, 1, ... and may arrive in any order and any micro-batch. Every operator takes them in order
of their number: one that comes early waits in a list state until those before it are there, one that comes again is
dropped. A call is over with its last chunk, or when the watermark has passed its newest chunk by quiet_ms; what waits is
then taken without the missing ones, numbered on over them. Its state goes at that time, so none stays.

Every state access is a round trip between Python and the JVM, so a call costs a few of them for each micro-batch, however
many chunks it has: early chunks of a micro-batch are one entry and are read only once the chunk before the first of them is
there, and a timer that fires too soon is set anew instead of being moved with each micro-batch. Columns are costly too, since Python
reads them value by value: what a chunk holds comes as one JSON text without its nulls.

Operators that stand alone (split_think_stream, watch_calls, answer_calls, in_order) run the same classes without these round
trips: the states of all calls of a bucket (a hash of the call) come to Python with the rows as one value and go back with the
output, since Spark hands each group to Python at a price of its own. A micro-batch so rewrites the state of the buckets that
it has rows of. No stateful operator may follow them; split_chunks, watch_chunks and assemble_chunks can be chained, as
answer_stream does.

The stream that is given needs a watermark on `at`. State is kept by RocksDB, which these operators require.
"""

from __future__ import annotations

import json
import pickle
import re
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone
from operator import itemgetter

import pandas as pd
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle
from pyspark.sql.streaming.state import GroupState
from pyspark.sql.types import ArrayType, BinaryType, DataType, MapType, StructType, TimestampType, VariantType

from docsheaf.functions.text import strip
from docsheaf.session import ship
from docsheaf.settings import DEFAULTS, Settings
from docsheaf.streaming.calls import tool_json

QUIET_MS = 600_000
#: Buckets of calls that share a state. A checkpoint is bound to their number.
BUCKETS = 4096
#: What a chunk of a model call may hold; columns that a stream lacks are null. silent marks the end that an operator puts
#: to a call that fell silent.
CHUNK = "content string, reasoning string, tool_index int, tool_id string, tool_name string, tool_args string, finish string, tokens long, last boolean, silent boolean"
SPLIT = f"{CHUNK}, held_content string, held_reasoning string"
WATCHED = f"{SPLIT}, verdict string, reasoning_tokens long"
ANSWER = "text string, reasoning string, finish string, tokens long, tools array<struct<tool_index int, name string, id string, args string>>, verdict string, reasoning_tokens long, chunks long, complete boolean"
_PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)
_TAGS = {False: "<think>", True: "</think>"}
#: Found in the text itself: its lower case may have more characters.
_IN_TEXT = {inside: re.compile(tag, re.ASCII | re.IGNORECASE) for inside, tag in _TAGS.items()}


def _names(columns: str) -> list[str]:
    return StructType.fromDDL(columns).fieldNames()


class OrderedChunks(StatefulProcessor):
    """Takes the rows of a call in order; subclasses say what a row does.

    load() reads the own state before the rows of a micro-batch, step() gives the output rows of one row, store() writes
    the state, flush() gives the output of a call that fell silent, clear() drops the state. `fresh` tells that a call has no
    state yet, so that none need be asked for.
    """

    columns = CHUNK

    def __init__(self, key: str, out: list[str], quiet_ms: int):
        self.key, self.out, self.quiet_ms = key, out, quiet_ms
        self.types = {f.name: f.dataType.simpleString() for f in StructType.fromDDL(self.columns)}
        self.names = list(self.types)
        self.fields = ["seq", "at_ms", *self.names]
        self.values = itemgetter(*self.fields)
        self.empty = dict.fromkeys(self.names)

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.place = handle.getValueState("place", "next long, newest long, first long, over boolean")
        self.early = handle.getListState("early", "chunks binary")
        self.declare(handle)

    def _rows(self, key: tuple, rows: list[dict], watermark: int) -> Iterator[Row]:
        make = Row(*self.out)
        for row in rows:
            row[self.key] = key[0]
            # An operator may not send on what is older than the watermark.
            row["at"] = _EPOCH + timedelta(milliseconds=max(row["at_ms"], watermark))
            yield make(*[row[c] for c in self.out])

    def _held(self) -> dict[int, dict]:
        """The chunks that wait, by their number; of equal numbers the first that came."""
        held: dict[int, dict] = {}
        for (chunks,) in self.early.get():
            for values in pickle.loads(chunks):
                held.setdefault(values[0], dict(zip(self.fields, values, strict=True)))
        return held

    def _entry(self, rows: list[dict]) -> tuple[bytes]:
        return (pickle.dumps([self.values(row) for row in rows]),)

    def handleInputRows(self, key: tuple, rows: Iterator[Row], timerValues) -> Iterator[Row]:
        out = self.taken(self.read(row) for row in rows)
        yield from self._rows(key, out, timerValues.getCurrentWatermarkInMs())

    def taken(self, rows: Iterable[dict]) -> list[dict]:
        """The output of a micro-batch's rows of a call."""
        place = self.place.get()
        self.fresh = place is None
        # first is the least number that waits.
        seq, newest, first, over = place or (0, None, None, False)
        arrived: dict[int, dict] = {}
        for row in rows:
            arrived.setdefault(row["seq"], row)
        at = max(row["at_ms"] for row in arrived.values())
        out: list[dict] = []
        if not over:
            held: dict[int, dict] | None = None
            moved = seq in arrived
            if moved:
                self.load()
            while not over:
                if held is None and first is not None and first <= seq:
                    held = self._held()
                row = (held or {}).get(seq) or arrived.get(seq)
                if row is None:
                    break
                out += self.step(row)
                over, seq = bool(row["last"]) or self.ended(), seq + 1
            if over:
                if not self.fresh:
                    self.clear()
                if first is not None:
                    self.early.clear()
                first = None
            else:
                if moved:
                    self.store()
                new = [arrived[k] for k in sorted(arrived) if k > seq and k not in (held or {})]
                if held is None:
                    if new:
                        self.early.appendValue(self._entry(new))
                        first = new[0]["seq"] if first is None else min(first, new[0]["seq"])
                else:
                    left = sorted([*(row for k, row in held.items() if k > seq), *new], key=lambda row: row["seq"])
                    self.early.put([self._entry(left)]) if left else self.early.clear()
                    first = left[0]["seq"] if left else None
        if newest is None:
            self.handle.registerTimer(at + self.quiet_ms)
        self.place.update((seq, at if newest is None else max(at, newest), first, over))
        return out

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[Row]:
        watermark = timerValues.getCurrentWatermarkInMs()
        yield from self._rows(key, self.expired(max(watermark, expiredTimerInfo.getExpiryTimeInMs())), watermark)

    def expired(self, now: int) -> list[dict]:
        """The output of a call whose timer fired: what waits, if it fell silent, and nothing if the timer is set anew."""
        seq, newest, first, over = self.place.get() or (0, 0, None, True)
        if newest + self.quiet_ms > now:
            self.handle.registerTimer(newest + self.quiet_ms)
            return []
        out: list[dict] = []
        self.fresh = False
        if not over:
            self.load()
            for _, row in sorted(self._held().items()) if first is not None else []:
                # Numbered on over the gap, so that an operator behind this one doesn't wait for what is lost.
                out += self.step({**row, "seq": seq})
                seq += 1
                if row["last"] or self.ended():
                    break
            else:
                out += self.flush({"seq": seq, "at_ms": newest, **dict.fromkeys(self.names)})
            self.clear()
            self.early.clear()
        self.place.clear()
        return out

    def parsed(self, chunks: Iterable[str]) -> list[dict]:
        """The rows of chunks, read as one JSON text, which takes half the time."""
        return [{**self.empty, **row} for row in json.loads(f"[{','.join(chunks)}]")]

    def read(self, row: Row) -> dict:
        return {"seq": row["seq"], **self.parsed([row["chunk"]])[0]}

    def declare(self, handle: StatefulProcessorHandle) -> None: ...

    def load(self) -> None: ...

    def step(self, row: dict) -> list[dict]: ...

    def ended(self) -> bool:
        return False

    def store(self) -> None: ...

    def flush(self, row: dict) -> list[dict]: ...

    def clear(self) -> None: ...

    def close(self) -> None: ...


class ThinkSplitter(OrderedChunks):
    """Moves what stands inside <think> tags from content to reasoning. A tail that may begin a tag waits for the next
    chunk; held_content and held_reasoning tell what the call would still have if it ended here."""

    def declare(self, handle: StatefulProcessorHandle) -> None:
        self.tail = handle.getValueState("tail", "held string, inside boolean")

    def load(self) -> None:
        self.held, self.inside = (None if self.fresh else self.tail.get()) or ("", False)

    def store(self) -> None:
        self.tail.update((self.held, self.inside))

    def clear(self) -> None:
        self.tail.clear()

    def step(self, row: dict) -> list[dict]:
        text, parts, hold = self.held + (row["content"] or ""), {True: [], False: []}, 0
        if "<" in text:
            while tag := _IN_TEXT[self.inside].search(text):
                parts[self.inside].append(text[: tag.start()])
                text, self.inside = text[tag.end() :], not self.inside
            hold = 0 if row["last"] else next((n for n in range(min(7, len(text)), 0, -1) if _TAGS[self.inside].startswith(text[-n:].lower())), 0)
        parts[self.inside].append(text[: len(text) - hold])
        self.held = text[len(text) - hold :]
        held = {"held_reasoning": self.held if self.inside else "", "held_content": "" if self.inside else self.held}
        return [{**row, **held, "content": "".join(parts[False]), "reasoning": (row["reasoning"] or "") + "".join(parts[True])}]

    def flush(self, row: dict) -> list[dict]:
        """The tail as one more chunk, which is the call's last."""
        kind = "reasoning" if self.inside else "content"
        return [{**row, kind: self.held, "last": True, "silent": True, "held_content": "", "held_reasoning": ""}]


class CallMonitor(OrderedChunks):
    """Adds verdict and reasoning_tokens: the chunk at which reasoning repeats itself or exceeds the budget gets the
    verdict and is the call's last. A repeat is tested before the budget; a budget of 0 is none."""

    columns = SPLIT

    def __init__(self, key: str, out: list[str], quiet_ms: int, budget: int, settings: Settings, verdicts_only: bool = False):
        super().__init__(key, out, quiet_ms)
        self.budget, self.settings, self.verdicts_only = budget, settings, verdicts_only

    def declare(self, handle: StatefulProcessorHandle) -> None:
        self.counts = handle.getValueState("counts", "chunks long, chars long, open string, kept long")
        self.last_lines = handle.getListState("lines", "line string")

    def load(self) -> None:
        self.chunks, self.chars, self.open, kept = (None if self.fresh else self.counts.get()) or (0, 0, "", 0)
        self.lines, self.verdict = [x[0] for x in self.last_lines.get()] if kept else [], ""
        self.changed = False

    def store(self) -> None:
        self.counts.update((self.chunks, self.chars, self.open, len(self.lines)))
        if self.changed:
            self.last_lines.put([(x,) for x in self.lines])

    def clear(self) -> None:
        self.counts.clear()
        self.last_lines.clear()

    def ended(self) -> bool:
        return bool(self.verdict)

    def _repeats(self) -> bool:
        lines, times = self.lines, self.settings.repeat_count
        for n in range(1, min(self.settings.repeat_lines, len(lines) // times) + 1):
            block = lines[-n:]
            if sum(map(len, block)) >= self.settings.repeat_min_chars and lines[-n * times :] == block * times:
                return True
        return False

    def step(self, row: dict) -> list[dict]:
        piece = row["reasoning"] or ""
        if piece:
            self.chunks, self.chars = self.chunks + 1, self.chars + len(piece)
            *ended, self.open = (self.open + piece).split("\n")
            for line in ended:
                if squeezed := " ".join(line.split()):
                    self.lines = [*self.lines, squeezed][-(self.settings.repeat_lines * self.settings.repeat_count + 1) :]
                    self.changed = True
                    if self._repeats():
                        self.verdict = "repeat"
                        break
        tokens = max(self.chunks, self.chars // 4)
        if piece and not self.verdict and self.budget and tokens > self.budget:
            self.verdict = "budget"
        if self.verdict:
            row = {**row, "last": True, "content": (row["content"] or "") + (row["held_content"] or ""), "reasoning": piece + (row["held_reasoning"] or "")}
        elif self.verdicts_only:
            return []
        return [{**row, "verdict": self.verdict, "reasoning_tokens": tokens if self.chunks else None}]

    def flush(self, row: dict) -> list[dict]:
        if self.verdicts_only:
            return []
        return [{**row, "last": True, "silent": True, "verdict": "", "reasoning_tokens": max(self.chunks, self.chars // 4) if self.chunks else None}]


class CallAssembler(OrderedChunks):
    """One row for each call: texts joined in order, tool calls by their index, the last finish and token count."""

    columns = WATCHED

    def declare(self, handle: StatefulProcessorHandle) -> None:
        self.texts = handle.getListState("texts", "text string, reasoning string")
        self.arguments = handle.getListState("arguments", "tool_index int, part string")
        self.tools = handle.getMapState("tools", "tool_index int", "name string, id string")
        self.end = handle.getValueState("end", "finish string, tokens long, verdict string, reasoning_tokens long, chunks long")

    def load(self) -> None:
        self.parts, self.args, self.named = ([], []), [], {}
        self.finish, self.tokens, self.verdict, self.reasoning_tokens, self.chunks = (None if self.fresh else self.end.get()) or (None, None, "", None, 0)

    def store(self) -> None:
        if any(self.parts):
            self.texts.appendValue(("".join(self.parts[0]), "".join(self.parts[1])))
        if self.args:
            self.arguments.appendList(self.args)
        for index, tool in self.named.items():
            self.tools.updateValue((index,), tool)
        self.end.update((self.finish, self.tokens, self.verdict, self.reasoning_tokens, self.chunks))

    def clear(self) -> None:
        self.texts.clear()
        self.arguments.clear()
        self.tools.clear()
        self.end.clear()

    def _tool(self, index: int) -> tuple[str | None, str | None]:
        if index not in self.named:
            self.named[index] = (self.tools.getValue((index,)) if not self.fresh and self.tools.containsKey((index,)) else None) or (None, None)
        return self.named[index]

    def step(self, row: dict) -> list[dict]:
        self.chunks += not row["silent"]
        for parts, text in zip(self.parts, (row["content"], row["reasoning"]), strict=True):
            if text:
                parts.append(text)
        if row["tool_index"] is not None:
            index = int(row["tool_index"])
            name, tool_id = self._tool(index)
            self.named[index] = (name or row["tool_name"] or None, row["tool_id"] or tool_id)
            if row["tool_args"]:
                self.args.append((index, row["tool_args"]))
        self.finish = row["finish"] or self.finish
        self.tokens = self.tokens if row["tokens"] is None else int(row["tokens"])
        self.verdict = row["verdict"] or self.verdict
        self.reasoning_tokens = self.reasoning_tokens if row["reasoning_tokens"] is None else int(row["reasoning_tokens"])
        return self._whole(row, not row["silent"]) if row["last"] else []

    def flush(self, row: dict) -> list[dict]:
        return self._whole(row, False)

    def _whole(self, row: dict, complete: bool) -> list[dict]:
        before = [] if self.fresh else list(self.texts.get())
        named = ({} if self.fresh else {k[0]: (v[0], v[1]) for k, v in self.tools.iterator()}) | self.named
        spelled: dict[int, list[str]] = {}
        for index, part in [*((x[0], x[1]) for x in ([] if self.fresh else self.arguments.get())), *self.args]:
            spelled.setdefault(index, []).append(part)
        tools = [{"tool_index": k, "name": name, "id": tool_id, "args": "".join(spelled.get(k, []))} for k, (name, tool_id) in sorted(named.items())]
        text, reasoning = "".join([*(x[0] for x in before), *self.parts[0]]), "".join([*(x[1] for x in before), *self.parts[1]])
        return [
            {
                "seq": row["seq"], "at_ms": row["at_ms"], "text": text, "reasoning": reasoning, "finish": self.finish, "tokens": self.tokens, "tools": tools, "verdict": self.verdict,
                "reasoning_tokens": self.reasoning_tokens, "chunks": self.chunks, "complete": complete,
            }
        ]


class CallAnswers(OrderedChunks):
    """Splitter, monitor and assembler as one: each chunk of a call passes through all three, which so need no order, place
    and timer of their own."""

    def __init__(self, key: str, out: list[str], quiet_ms: int, budget: int, settings: Settings):
        super().__init__(key, out, quiet_ms)
        self.splitter, self.monitor, self.assembler = ThinkSplitter(key, [], quiet_ms), CallMonitor(key, [], quiet_ms, budget, settings), CallAssembler(key, [], quiet_ms)
        self.parts = (self.splitter, self.monitor, self.assembler)

    def declare(self, handle: StatefulProcessorHandle) -> None:
        for part in self.parts:
            part.declare(handle)

    def load(self) -> None:
        for part in self.parts:
            part.fresh = self.fresh
            part.load()

    def store(self) -> None:
        for part in self.parts:
            part.store()

    def clear(self) -> None:
        for part in self.parts:
            part.clear()

    def ended(self) -> bool:
        return self.monitor.ended()

    def _passed_on(self, chunks: list[dict]) -> list[dict]:
        return [answer for chunk in chunks for watched in self.monitor.step(chunk) for answer in self.assembler.step(watched)]

    def step(self, row: dict) -> list[dict]:
        return self._passed_on(self.splitter.step(row))

    def flush(self, row: dict) -> list[dict]:
        return self._passed_on(self.splitter.flush(row))


class InOrder(OrderedChunks):
    """Passes rows on as they are, in order."""

    def __init__(self, key: str, out: list[str], quiet_ms: int, columns: str):
        self.columns = columns
        super().__init__(key, out, quiet_ms)

    def read(self, row: Row) -> dict:
        return row.asDict()

    def step(self, row: dict) -> list[dict]:
        return [row]

    def flush(self, row: dict) -> list[dict]:
        return []


class _KeptValue:
    """A value or list state within KeptStates."""

    def __init__(self, kept: KeptStates, name: str, empty):
        self.kept, self.name, self.empty = kept, name, empty

    def get(self):
        return self.kept.values.get(self.name, self.empty)

    def update(self, value) -> None:
        self.kept.values[self.name] = value

    put = update

    def appendValue(self, value) -> None:  # noqa: N802
        self.kept.values.setdefault(self.name, []).append(value)

    def appendList(self, values) -> None:  # noqa: N802
        self.kept.values.setdefault(self.name, []).extend(values)

    def clear(self) -> None:
        self.kept.values.pop(self.name, None)


class _KeptMap(_KeptValue):
    """A map state within KeptStates."""

    def containsKey(self, key) -> bool:  # noqa: N802
        return key in self.get()

    def getValue(self, key):  # noqa: N802
        return self.get().get(key)

    def updateValue(self, key, value) -> None:  # noqa: N802
        self.kept.values.setdefault(self.name, {})[key] = value

    def iterator(self) -> Iterator[tuple]:
        return iter(self.get().items())


class KeptStates:
    """Stands for the handle of a processor: the states of one call, and its timer, as one dictionary."""

    def __init__(self):
        self.values: dict = {}

    def getValueState(self, name: str, schema: str) -> _KeptValue:  # noqa: N802
        return _KeptValue(self, name, None)

    def getListState(self, name: str, schema: str) -> _KeptValue:  # noqa: N802
        return _KeptValue(self, name, ())

    def getMapState(self, name: str, key: str, schema: str) -> _KeptMap:  # noqa: N802
        return _KeptMap(self, name, {})

    def registerTimer(self, at: int) -> None:  # noqa: N802
        self.values["timer"] = at


def _as_text(column: str, kind: DataType) -> Column:
    """A value of no nested type as a text from which _from_text() gives exactly that value."""
    return F.base64(column) if isinstance(kind, BinaryType) else F.unix_micros(column).cast("string") if isinstance(kind, TimestampType) else F.col(column).cast("string")


def _from_text(text: Column, kind: DataType) -> Column:
    return F.unbase64(text) if isinstance(kind, BinaryType) else F.timestamp_micros(text.cast("long")) if isinstance(kind, TimestampType) else text.cast(kind)


def _run_alone(rows: DataFrame, key: str, processor: OrderedChunks, out: str, **given: Column) -> DataFrame:
    """(key, seq, at, out) of a processor that no other stateful operator follows. rows: key (of no nested type), seq, at and
    the processor's columns, where `given` doesn't have them."""
    _use_rocksdb(ship(rows.sparkSession))
    kind, names, kept = rows.schema[key].dataType, ["seq", "at_ms", *_names(out)], KeptStates()
    processor.init(kept)
    chunk = _chunk(rows, ", ".join(f"{n} {t}" for n, t in processor.types.items()), key=_as_text(key, kind), **given)
    dealt = rows.select(F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int").alias("bucket"), "at", chunk)

    def run(_: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        calls: dict[str | None, dict] = pickle.loads(state.get[0]) if state.exists else {}
        watermark, texts = state.getCurrentWatermarkMs(), []

        def take(own: str | None, action, *given) -> None:
            kept.values = calls.setdefault(own, {})
            # An operator may not send on what is older than the watermark.
            made = [{"key": own, **{c: row[c] for c in names}, "at_ms": max(row["at_ms"], watermark)} for row in action(*given)]
            if made:
                texts.append(json.dumps(made))
            if "place" not in kept.values:
                del calls[own]

        arrived: dict[str | None, list[dict]] = {}
        for frame in frames:
            for row in processor.parsed(frame["chunk"]):
                arrived.setdefault(row.pop("key", None), []).append(row)
        for own, its in arrived.items():
            take(own, processor.taken, its)
        for own in [k for k, values in calls.items() if values["timer"] < watermark]:
            take(own, processor.expired, watermark)
        if calls:
            state.update((pickle.dumps(calls),))
            state.setTimeoutTimestamp(max(min(values["timer"] for values in calls.values()), watermark + 1))
        else:
            state.remove()
        if texts:
            yield pd.DataFrame({"rows": texts})

    done = dealt.groupBy("bucket").applyInPandasWithState(run, "rows string", "kept binary", "append", "EventTimeTimeout")
    each = done.select(F.inline(F.from_json("rows", f"array<struct<key: string, seq: long, at_ms: long, {', '.join(f'{f.name}: {f.dataType.simpleString()}' for f in StructType.fromDDL(out))}>>")))
    return each.select(_from_text(F.col("key"), kind).alias(key), "seq", F.timestamp_millis("at_ms").alias("at"), *_names(out))


def in_order(rows: DataFrame, key: str, columns: str, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(key, seq, at, columns): the rows of each key in order of seq over all micro-batches, each when those before it have
    come. rows: key, seq (0, 1, ... within a key), at (with a watermark), `columns` as DDL, and last where it is known.
    Columns of nested types go to Python value by value, others as one text that is only passed on."""
    fields = StructType.fromDDL(columns).fields
    last = (F.col("last") if "last" in rows.columns else F.lit(False)).alias("last")
    seq = F.col("seq").cast("long").alias("seq")
    if not any(isinstance(f.dataType, (ArrayType, MapType, StructType, VariantType)) for f in fields):
        texts = F.to_json(F.struct(*[_as_text(f.name, f.dataType).alias(f"c{n}") for n, f in enumerate(fields)]))
        found = _run_alone(rows.select(key, seq, "at", texts.alias("row"), last), key, InOrder(key, [], quiet_ms, "row string, last boolean"), "row string")
        own = found.withColumn("row", F.from_json("row", ", ".join(f"c{n} string" for n in range(len(fields)))))
        return own.select(key, "seq", "at", *[_from_text(F.col("row")[f"c{n}"], f.dataType).alias(f.name) for n, f in enumerate(fields)])
    _use_rocksdb(ship(rows.sparkSession))
    names, kind = _names(columns), rows.schema[key].dataType.simpleString()
    given = rows.select(key, seq, "at", F.unix_millis("at").alias("at_ms"), *names, last)
    state = InOrder(key, [key, "seq", "at", *names], quiet_ms, f"{columns}, last boolean")
    return given.groupBy(key).transformWithState(state, f"{key} {kind}, seq long, at timestamp, {columns}", "Append", "EventTime", eventTimeColumnName="at")


def _use_rocksdb(spark: SparkSession) -> None:
    if "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass"):
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", _PROVIDER)


def _chunk(chunks: DataFrame, columns: str, **given: Column) -> Column:
    """The columns of an operator's input, those named in `given`, else its own, else null, as JSON, with seq and at_ms."""
    known = {"seq": F.col("seq").cast("long"), "at_ms": F.unix_millis("at"), **given}
    made = [(known.pop(f.name) if f.name in known else F.col(f.name) if f.name in chunks.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in StructType.fromDDL(columns)]
    return F.to_json(F.struct(*[value.alias(name) for name, value in known.items()], *made)).alias("chunk")


def _rows(chunks: DataFrame, columns: str) -> DataFrame:
    """(call_id, seq, at, chunk): the rows of an operator's input."""
    return chunks.select("call_id", F.col("seq").cast("long").alias("seq"), "at", _chunk(chunks, columns))


def _run(rows: DataFrame, make, out: str) -> DataFrame:
    _use_rocksdb(ship(rows.sparkSession))
    key = rows.schema["call_id"].dataType.simpleString()
    schema = f"call_id {key}, seq long, at timestamp, {out}"
    names = ["call_id", "seq", "at", *_names(out)]
    return rows.groupBy("call_id").transformWithState(make("call_id", names), schema, "Append", "EventTime", eventTimeColumnName="at")


def split_chunks(chunks: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """The chunks with reasoning and content told apart, in order: see ThinkSplitter. chunks: call_id, seq, at and columns of CHUNK."""
    return _run(_rows(chunks, CHUNK), lambda key, names: ThinkSplitter(key, names, quiet_ms), SPLIT)


def watch_chunks(chunks: DataFrame, budget: int, settings: Settings = DEFAULTS, quiet_ms: int = QUIET_MS) -> DataFrame:
    """The chunks up to the one at which a call's reasoning is stopped, in order, with verdict and reasoning_tokens."""
    return _run(_rows(chunks, SPLIT), lambda key, names: CallMonitor(key, names, quiet_ms, budget, settings), WATCHED)


def assemble_chunks(chunks: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(call_id, at, text, reasoning, finish, tokens, tool_calls, verdict, reasoning_tokens, chunks, complete) of each
    call once, when it is over. A call that fell silent without a last chunk isn't complete."""
    return _answers(_run(_rows(chunks, WATCHED), lambda key, names: CallAssembler(key, names, quiet_ms), ANSWER))


def _answers(found: DataFrame) -> DataFrame:
    return found.select("call_id", "at", strip(F.col("text")).alias("text"), strip(F.col("reasoning")).alias("reasoning"), "finish", "tokens", tool_json(F.col("tools")).alias("tool_calls"), "verdict", "reasoning_tokens", "chunks", "complete")


def answer_stream(chunks: DataFrame, budget: int = 0, settings: Settings = DEFAULTS, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Whole answers of a stream of raw chunks: split, watched and assembled, three stateful operators in a row. Each waits
    quiet_ms for calls without a last chunk. answer_calls() costs far less, where no stateful operator follows."""
    return assemble_chunks(watch_chunks(split_chunks(chunks, quiet_ms), budget, settings, quiet_ms), quiet_ms)


def answer_calls(chunks: DataFrame, budget: int = 0, settings: Settings = DEFAULTS, quiet_ms: int = QUIET_MS) -> DataFrame:
    """Whole answers of a stream of raw chunks: split, watched and assembled in one stateful operator. The columns are those
    of assemble_chunks()."""
    return _answers(_run_alone(chunks, "call_id", CallAnswers("call_id", [], quiet_ms, budget, settings), ANSWER))


def split_think_stream(chunks: DataFrame, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(call_id, seq, at, reasoning, content) for each chunk. chunks: call_id, seq, at, piece, last."""
    found = _run_alone(chunks, "call_id", ThinkSplitter("call_id", [], quiet_ms), "reasoning string, content string", content=F.col("piece"), reasoning=F.lit(None))
    return found.select("call_id", "seq", "at", F.coalesce("reasoning", F.lit("")).alias("reasoning"), F.coalesce("content", F.lit("")).alias("content"))


def watch_calls(chunks: DataFrame, budget: int, settings: Settings = DEFAULTS, quiet_ms: int = QUIET_MS) -> DataFrame:
    """(call_id, seq, at, verdict, tokens): the chunk at which a call's reasoning is stopped. chunks: call_id, seq, at,
    piece, last."""
    monitor = CallMonitor("call_id", [], quiet_ms, budget, settings, verdicts_only=True)
    found = _run_alone(chunks, "call_id", monitor, "verdict string, reasoning_tokens long", reasoning=F.col("piece"), content=F.lit(None))
    return found.select("call_id", "seq", "at", "verdict", F.col("reasoning_tokens").alias("tokens"))

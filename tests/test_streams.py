"""Stream forms against the batch forms, with chunks in any order over several micro-batches."""

import json
import random
from datetime import datetime, timedelta, timezone
from decimal import Decimal

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from docsheaf.plans import sources, telemetry
from docsheaf.streaming import calls, ordered, streams
from tests.conftest import SF

START = datetime(2024, 1, 1, tzinfo=timezone.utc)
COLUMNS = "call_id string, seq long, at timestamp, content string, reasoning string, tool_index int, tool_id string, tool_name string, tool_args string, finish string, tokens long, last boolean"
WORDS = "call_id string, seq long, at timestamp, piece string, last boolean"


def run(spark, tmp_path, batches, schema, transform, delay="1 hour"):
    """The rows that transform gives for batches of rows, one micro-batch each."""
    names = [c.split()[0] for c in schema.split(", ")]
    whole = [{**dict.fromkeys(names), **r} for batch in batches for r in batch]
    at = 0
    for k, batch in enumerate(batches):
        spark.createDataFrame([tuple(r[n] for n in names) for r in whole[at : at + len(batch)]], schema).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
        at += len(batch)
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", True).parquet(f"{tmp_path}/in").withWatermark("at", delay)
    out = transform(stream)
    query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/state").trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{tmp_path}/out").collect()


def at(seconds):
    return START + timedelta(seconds=seconds)


def words(call, text, size, start=0):
    parts = [text[k : k + size] for k in range(0, len(text), size)]
    return [{"call_id": call, "seq": k, "at": at(start + k), "piece": p, "last": k == len(parts) - 1} for k, p in enumerate(parts)]


def shuffled(rows, n, seed):
    rng, batches = random.Random(seed), [[] for _ in range(n)]
    for row in rows:
        rng.choice(batches).append(row)
    for batch in batches:
        rng.shuffle(batch)
    return [b for b in batches if b]


LOOP = [f"Look at part {k} of the drawing again." for k in range(4)]


def test_watched_calls_equal_batch(spark, tmp_path):
    rows = words("budget", "ab" * 11, 2)
    rows += words("large", "x" * 100, 100) + words("loop", "start\n" + "\n".join(LOOP * 4) + "\n", 3) + words("short lines", "Okay.\n" * 3, 6)
    rows += words("no end of line", "\n".join(LOOP * 3), 700) + words("within", "word " * 8, 5)
    got = {(r.call_id, r.seq, r.verdict) for r in run(spark, tmp_path, shuffled(rows, 4, 1), WORDS, lambda s: ordered.watch_calls(s, 10))}
    assert {c: (k, v) for c, k, v in got if v == "budget"}["budget"] == (10, "budget")
    assert ("large", 0, "budget") in got and not {c for c, *_ in got} & {"short lines", "within"}
    batch = spark.createDataFrame([(r["call_id"], r["seq"], r["piece"]) for r in rows], "call_id string, seq long, piece string")
    over = {r.call_id: r.seq for r in calls.reasoning_budget(batch, 10).collect()}
    assert all(over[c] >= k for c, k, _ in got) and {c for c, *_ in got} == set(over)


def test_repeats_equal_batch(spark, tmp_path):
    rng, rows = random.Random(3), []
    for k in range(12):
        lines = [rng.choice(LOOP) if rng.random() < 0.1 else f"own line number {n} of {k}" for n in range(rng.randint(0, 5))] + LOOP[: rng.randint(1, 4)] * rng.randint(1, 4)
        rows += words(f"c{k}", "\n".join(lines) + "\n", rng.choice([3, 17, 40]))
    batch = spark.createDataFrame([(r["call_id"], r["seq"], r["piece"]) for r in rows], "call_id string, seq long, piece string")
    lines = calls.complete_lines(batch)
    texts = {c: "".join(r["piece"] for r in rows if r["call_id"] == c) for c in {r["call_id"] for r in rows}}
    want = {}
    for r in calls.repetition(lines).collect():
        kept = [x for x in lines.filter(F.col("call_id") == r.call_id).collect() if x.pos <= r.pos]
        text, seen, end = texts[r.call_id], 0, 0
        while seen < len(kept):
            end = text.index("\n", end) + 1
            seen += bool(text[:end].split("\n")[-2].strip())
        size = len(next(x for x in rows if x["call_id"] == r.call_id)["piece"])
        want[r.call_id] = (end - 1) // size
    assert {r.call_id: r.seq for r in run(spark, tmp_path, shuffled(rows, 3, 4), WORDS, lambda s: ordered.watch_calls(s, 0))} == want and want


@pytest.mark.parametrize("size", [1, 3, 1000])
def test_think_tags_cut_anywhere(spark, tmp_path, size):
    texts = {"a": "before <THINK>why\nnot</think> after <think>open", "b": "a < b and c > d <", "c": "<think>still thinking <", "d": "</think>x<think></think>"}
    rows = [r for c, t in texts.items() for r in words(c, t, size)]
    batch = {r.call_id: (r.reasoning, r.content) for r in calls.split_think(spark.createDataFrame([(r["call_id"], r["seq"], r["piece"]) for r in rows], "call_id string, seq long, piece string")).collect()}
    assert batch["a"] == ("why\nnotopen", "before  after ") and batch["c"] == ("still thinking <", "")
    out = sorted(run(spark, tmp_path, shuffled(rows, 3, 2), WORDS, ordered.split_think_stream), key=lambda r: r.seq)
    for call in texts:
        assert ("".join(r.reasoning for r in out if r.call_id == call), "".join(r.content for r in out if r.call_id == call)) == batch[call]


def test_think_tags_behind_letters_that_grow_in_lower_case(spark, tmp_path):
    texts = {"a": "\u0130\u0130<think>why\u0130</THINK>so", "b": "<think>\u0130\u0130</thin\u212a></think>end", "c": "<\u0130think> \u0130<thi"}
    rows = [r for c, t in texts.items() for r in words(c, t, 1000)]
    batch = {r.call_id: (r.reasoning, r.content) for r in calls.split_think(spark.createDataFrame([(r["call_id"], r["seq"], r["piece"]) for r in rows], "call_id string, seq long, piece string")).collect()}
    assert batch["a"] == ("why\u0130", "\u0130\u0130so")
    assert {r.call_id: (r.reasoning, r.content) for r in run(spark, tmp_path, [rows], WORDS, ordered.split_think_stream)} == batch


class CountedStates:
    """Stands in for a call's states and counts how often they are asked."""

    def __init__(self):
        self.values, self.asked = {}, 0

    def state(self, name, *_):
        outer = self

        class State:
            def __getattr__(self, action):
                def ask(*given):
                    outer.asked += 1
                    if action == "get":
                        return outer.values.get(name)
                    if action == "clear":
                        return outer.values.pop(name, None)
                    held = outer.values.get(name) or []
                    outer.values[name] = given[0] if action in ("update", "put") else [*held, given[0]]

                return ask

        return State()

    getValueState = getListState = getMapState = state  # noqa: N815

    def registerTimer(self, at):  # noqa: N802
        self.asked += 1

    deleteTimer = registerTimer  # noqa: N815


@pytest.mark.parametrize("size", [10, 1000])
def test_state_is_asked_as_often_whatever_the_number_of_chunks(spark, size):
    states, Clock = CountedStates(), type("Clock", (), {"getCurrentWatermarkInMs": lambda self: 0})  # noqa: N806
    splitter = ordered.ThinkSplitter("call_id", ["call_id", "seq", "at", "content", "reasoning"], 1000)
    splitter.init(states)
    row = Row("call_id", "seq", "at", "chunk")
    numbers = [[*range(1, size, 2)], [*range(2, size, 2)], [0]]
    out = [[r.content for r in splitter.handleInputRows(("a",), iter([row("a", k, at(k), json.dumps({"at_ms": k, "content": f"{k} ", "last": k == size - 1})) for k in own]), Clock())] for own in numbers]
    assert out == [[], [], [f"{k} " for k in range(size)]] and states.asked == 13


def answers(n, seed):
    """Chunks of calls with text, reasoning (given apart or within tags), tool calls and counts of tokens."""
    rng, rows = random.Random(seed), []
    for k in range(n):
        call, tagged, seq = f"call {k}", k % 3 == 0, 0
        parts = [{"content": c} for c in ("<thi", "nk>so ", f"and so {k}</thi", "nk>", "Answer ", f"{k} ")] if tagged else [{"reasoning": f"why {k} "}, {"content": " Ans"}, {"content": "wer "}]
        for index in rng.sample(range(3), rng.randint(0, 3)):
            text = rng.choice(['{"q": "a b", "n": "%d"}' % k, '{"q": ', "", "[1]"])
            parts += [{"tool_index": index, "tool_name": rng.choice(["search", ""]), "tool_id": f"id{index}"}, *({"tool_index": index, "tool_args": text[j : j + 4]} for j in range(0, len(text), 4)), {"tool_index": index, "tool_id": rng.choice([None, "", f"late{index}"])}]
        parts += [{"content": "end.\n"}, {"finish": rng.choice(["stop", "length"])}, {"tokens": rng.randint(1, 99)}]
        for part in parts:
            rows.append({"call_id": call, "seq": seq, "at": at(60 * k + seq), "last": seq == len(parts) - 1, **part})
            seq += 1
    return rows


def batch_answers(spark, rows):
    """assemble_calls() over the chunks, with tagged content told apart before."""
    names = [c.split()[0] for c in COLUMNS.split(", ")]
    df = spark.createDataFrame([tuple(r.get(n) for n in names) for r in rows], COLUMNS)
    whole = calls.split_think(df.select("call_id", "seq", F.coalesce("content", F.lit("")).alias("piece"))).select("call_id", F.col("content").alias("own"), F.col("reasoning").alias("thought"))
    first = df.join(whole, "call_id").select("call_id", "seq", F.when(F.col("seq") == 0, F.col("own")).alias("content"), F.when(F.col("seq") == 0, F.concat("thought", F.coalesce("reasoning", F.lit("")))).otherwise(F.col("reasoning")).alias("reasoning"), *names[5:11])
    return {r.call_id: (r.text, r.reasoning, r.finish, r.tokens, json.loads(r.tool_calls)) for r in calls.assemble_calls(first).collect()}


def test_shuffled_and_late_chunks_give_whole_answers(spark, tmp_path):
    """Every chunk is in a random micro-batch, so many come after later ones, within the watermark's hour; some come twice."""
    rows = answers(20, 5)
    batches = shuffled(rows + random.Random(1).sample(rows, 30), 5, 6)
    got = run(spark, tmp_path, batches, COLUMNS, ordered.answer_stream)
    assert {r.call_id: (r.text, r.reasoning, r.finish, r.tokens, json.loads(r.tool_calls)) for r in got} == batch_answers(spark, rows)
    assert len(got) == 20 and all(r.complete and not r.verdict for r in got)
    assert all(any(r["call_id"] == c for b in batches[1:] for r in b) for c in ("call 0", "call 19"))


def test_answers_that_are_stopped_or_fall_silent(spark, tmp_path):
    """A call over its budget ends there, tags or not; one without a last chunk ends when the watermark has passed it, and
    then no state is left of any call but the newest."""
    long = [{"call_id": "long", "seq": k, "at": at(k), "content": c} for k, c in enumerate(["<think>a", "b", "c", "d</th", "ink>e"])]
    open_ = [{"call_id": "open", "seq": 0, "at": at(0), "content": "half an ans"}, {"call_id": "open", "seq": 1, "at": at(1), "content": "wer <thi"}, {"call_id": "open", "seq": 3, "at": at(2), "content": " after a gap"}]
    late = [{"call_id": "late", "seq": 0, "at": at(5), "content": "too late", "last": True}]
    clock = [[{"call_id": "clock", "seq": k, "at": at(10_000 * (k + 1)), "content": "tick"}] for k in range(4)]
    got = {r.call_id: r for r in run(spark, tmp_path, [open_ + long, *clock, late, [{"call_id": "clock", "seq": 4, "at": at(90_000), "content": "tick"}]], COLUMNS, lambda s: ordered.answer_stream(s, budget=3), delay="10 seconds")}
    assert got["long"].verdict == "budget" and got["long"].reasoning == "abcd</th" and got["long"].text == "" and got["long"].reasoning_tokens == 4
    assert got["open"].text == "half an answer <thi after a gap" and not got["open"].complete and "late" not in got
    for operator in (0, 1, 2):
        left = spark.read.format("statestore").option("operatorId", operator).option("stateVarName", "place").load(f"{tmp_path}/state").select("key.*").distinct().collect()
        assert [r.call_id for r in left] == ["clock"]
    assert spark.read.format("statestore").option("operatorId", 0).option("stateVarName", "texts").option("flattenCollectionTypes", True).load(f"{tmp_path}/state").filter("key.call_id <> 'clock'").count() == 0


def test_calls_of_a_bucket_share_a_state(spark, tmp_path, monkeypatch):
    """Calls that end, that fall silent and that lose a chunk, four buckets of them; what is silent leaves no state."""
    monkeypatch.setattr(ordered, "BUCKETS", 4)
    rows = [r for k in range(30) for r in words(f"c{k}", f"a{k} <think>why {k}</think> b", 4)]
    rows = [{**r, "last": r["last"] and r["call_id"] > "c2"} for r in rows if (r["call_id"], r["seq"]) != ("c5", 2)]
    clock = [[{"call_id": "clock", "seq": k, "at": at(10_000 * (k + 1)), "piece": "tick", "last": False}] for k in range(3)]
    out = sorted(run(spark, tmp_path, [*shuffled(rows, 3, 8), *clock], WORDS, ordered.split_think_stream, delay="10 seconds"), key=lambda r: r.seq)
    for k in range(30):
        text = "a5 <thiny 5</think> b" if k == 5 else f"a{k}  b"
        own = [r for r in out if r.call_id == f"c{k}"]
        assert ("".join(r.reasoning for r in own), "".join(r.content for r in own)) == ("" if k == 5 else f"why {k}", text) and [r.seq for r in own] == list(range(len(own)))
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() == 1  # the bucket of the clock


def test_assembled_calls_share_states(spark, tmp_path, monkeypatch):
    """The query keeps a state for each bucket, not several for each call in each of three operators."""
    monkeypatch.setattr(ordered, "BUCKETS", 4)
    monkeypatch.setattr(sources, "shared_folder", lambda _: f"{tmp_path}/js4")
    got, batch = sources.js4_assemble_stream(spark, SF), telemetry.j4_assemble_calls(spark, SF)
    assert sorted(map(str, got.collect())) == sorted(map(str, batch.collect()))
    assert spark.read.format("statestore").load(f"{tmp_path}/js4/state").count() == 4


def test_answers_of_one_operator_equal_batch(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ordered, "BUCKETS", 3)
    rows = answers(20, 7)
    batches = shuffled(rows + random.Random(2).sample(rows, 30), 4, 8)
    got = run(spark, tmp_path, batches, COLUMNS, ordered.answer_calls)
    assert {r.call_id: (r.text, r.reasoning, r.finish, r.tokens, json.loads(r.tool_calls)) for r in got} == batch_answers(spark, rows)
    assert len(got) == 20 and all(r.complete and not r.verdict for r in got)
    assert {r.call_id: r.chunks for r in got} == {c: sum(r["call_id"] == c for r in rows) for c in {r["call_id"] for r in rows}}


def test_answers_of_one_operator_that_are_stopped_or_fall_silent(spark, tmp_path):
    """Each call is answered once: stopped by its budget, fallen silent, or late as a whole but never silent for long."""
    long = [{"call_id": "long", "seq": k, "at": at(k), "content": c} for k, c in enumerate(["<think>a", "b", "c", "d</th", "ink>e"])]
    open_ = [{"call_id": "open", "seq": k, "at": at(k), **c} for k, c in ((0, {"content": "half an ans"}), (1, {"content": "wer <thi"}), (2, {"tool_index": 0, "tool_name": "look"}), (4, {"content": " after a gap"}))]
    slow = [{"call_id": "slow", "seq": k, "at": at(t), "content": c, "last": k == 3} for k, t, c in ((0, 0, "one "), (2, 540, "three "), (1, 1000, "two "), (3, 1001, "four"))]
    late = [{"call_id": "open", "seq": 3, "at": at(3), "content": "too late", "last": True}]
    clock = [[{"call_id": "clock", "seq": k, "at": at(t), "content": "tick"}] for k, t in enumerate((800, 900, 10_000, 20_000, 30_000))]
    rows = run(spark, tmp_path, [open_ + long + slow[:2], *clock[:2], slow[2:], *clock[2:4], late, clock[4]], COLUMNS, lambda s: ordered.answer_calls(s, budget=3), delay="10 seconds")
    got = {r.call_id: r for r in rows}
    assert len(rows) == 3 and set(got) == {"long", "open", "slow"}
    assert got["long"].verdict == "budget" and got["long"].reasoning == "abcd</th" and got["long"].text == "" and got["long"].reasoning_tokens == 4
    assert got["open"].text == "half an answer <thi after a gap" and not got["open"].complete and got["open"].chunks == 4 and json.loads(got["open"].tool_calls)[0]["name"] == "look"
    assert got["slow"].text == "one two three four" and got["slow"].complete and got["slow"].chunks == 4
    assert spark.read.format("statestore").load(f"{tmp_path}/state").count() == 1  # the bucket of the clock


def test_rows_in_order_keep_their_values(spark, tmp_path):
    schema = "turn long, seq long, at timestamp, n long, x double, t timestamp, d decimal(30,2), b binary, ok boolean, s string"
    values = [(2**53 + 1, float("nan"), at(0.000001), Decimal("1e20"), b"\x00\xff", True, 'a "b"\n\\'), (None,) * 7, (-1, 0.1 + 0.2, at(5), Decimal("-0.01"), b"", False, "")]
    names = [c.split()[0] for c in schema.split(", ")]
    rows = [{**dict(zip(names, (turn, k, at(k), *v), strict=True))} for turn in (1, None) for k, v in enumerate(values)]
    got = run(spark, tmp_path, [rows[::-1][:4], rows[::-1][4:]], schema, lambda s: ordered.in_order(s, "turn", ", ".join(schema.split(", ")[3:])))
    assert sorted(map(str, got)) == sorted(map(str, spark.createDataFrame([tuple(r[n] for n in names) for r in rows], schema).collect()))


def test_newest_trace_wins(spark, tmp_path):
    rows = [("t1", 2, "new"), ("t1", 1, "old"), ("t2", 5, "five"), ("t3", 1, "a"), ("t3", 3, "c"), ("t3", 2, "b")]
    spark.createDataFrame(rows, "turn string, version int, document string").repartition(5).write.parquet(f"{tmp_path}/in")
    source = spark.readStream.schema("turn string, version int, document string").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    for _ in range(2):  # the second time nothing is new
        streams.upsert_trace_stream(source, f"{tmp_path}/out", f"{tmp_path}/state", available_now=True).awaitTermination()
        assert {tuple(r) for r in streams.latest_traces(spark, f"{tmp_path}/out").collect()} == {("t1", 2, "new"), ("t2", 5, "five"), ("t3", 3, "c")}


def test_equal_times_are_taken_in_order(spark):
    rows = [("a", 1.0, 3), ("a", 1.0, 1), ("a", 1.0, 2), ("a", 5.0, 9), ("a", 5.0, 4)]
    got = calls.throttle_progress(spark.createDataFrame(rows, "call_id string, at double, seq int"), 2.0).collect()
    assert sorted((r.at, r.seq) for r in got) == [(1.0, 1), (5.0, 4)]

"""Telemetry: trace documents, span trees, turn summaries, counters and checks of model calls."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsheaf.session import stored
from docsheaf.settings import DEFAULTS, Settings

MODEL_KINDS = ("llm", "ocr", "grounding")


def export_traces(events: DataFrame, turn: str = "turn", order: str = "seq") -> DataFrame:
    """(turn, document): one JSON document per turn with its events in order."""
    fields = [c for c in events.columns if c != turn]
    ordered = F.sort_array(F.collect_list(F.struct(F.col(order).alias("_o"), F.struct(*fields).alias("e"))))
    return events.groupBy(turn).agg(F.to_json(F.struct(F.transform(ordered, lambda x: x["e"]).alias("events"))).alias("document"))


def explode_traces(traces: DataFrame, schema: str, turn: str = "turn", document: str = "document") -> DataFrame:
    """Event rows of trace documents; a document that isn't JSON has none."""
    parsed = traces.select(turn, F.from_json(document, f"struct<events:array<struct<{schema}>>>").alias("d"))
    return parsed.select(turn, F.explode("d.events").alias("e")).select(turn, "e.*")


def repaired(events: DataFrame, turn: str = "turn", key: str = "seq") -> DataFrame:
    """Events with parents that the turn doesn't have set to null."""
    known = events.select(turn, F.col(key).alias("parent"), F.lit(True).alias("known"))
    return events.join(known, [turn, "parent"], "left").withColumn("parent", F.when(F.col("known"), F.col("parent"))).drop("known")


def span_tree(events: DataFrame, turn: str = "turn", key: str = "seq") -> DataFrame:
    """(turn, key, parent, depth, path, children); unknown parents count as none, rows whose parents go in a circle are left out.

    Every row knows some ancestor and the path from it. In each round it takes over what that ancestor knows, so the
    distance doubles: a tree of depth d takes about log2(d) joins over all turns at once, however deep it is.
    """
    rows = stored(repaired(events, turn, key).select(turn, key, "parent"))
    known = stored(rows.select(turn, key, "parent", F.col("parent").alias("above"), F.when(F.col("parent").isNull(), 0).otherwise(1).alias("depth"), F.col(key).cast("string").alias("path")))
    most, reach = rows.groupBy(turn).agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0, 1
    while reach < most and not known.filter("above is not null").isEmpty():
        upper = known.select(turn, F.col(key).alias("above"), F.col("above").alias("next"), F.col("depth").alias("more"), F.col("path").alias("head"))
        open_ = known.filter("above is not null").join(upper, [turn, "above"])
        further = open_.select(turn, key, "parent", F.col("next").alias("above"), (F.col("depth") + F.col("more")).alias("depth"), F.concat("head", F.lit("/"), "path").alias("path"))
        known, reach = stored(known.filter("above is null").unionByName(further)), reach * 2
    children = rows.filter("parent is not null").groupBy(turn, F.col("parent").alias(key)).agg(F.count(F.lit(1)).alias("children"))
    return known.filter("above is null").select(turn, key, "parent", "depth", "path").join(children, [turn, key], "left").na.fill(0, ["children"])


def classify_calls(events: DataFrame, turn: str = "turn", key: str = "seq") -> DataFrame:
    """Adds call_kind of model calls: by their parent a transcription, a tool's call, or an answer."""
    parents = events.select(turn, F.col(key).alias("parent"), F.col("kind").alias("parent_kind"), F.col("label").alias("parent_label"))
    tool = F.when(F.col("parent_label") == "inspect_visual", "grounding").when(F.col("parent_label") == "analyze_pages", "analysis").otherwise(F.concat(F.lit("tool:"), "parent_label"))
    kind = F.when(F.col("parent_kind") == "ocr", "ocr").when(F.col("parent_kind") == "tool", tool).otherwise("answer")
    return events.filter("kind = 'llm'").join(parents, [turn, "parent"], "left").withColumn("call_kind", kind).drop("parent_kind", "parent_label")


def number_calls(calls: DataFrame, turn: str = "turn", order: str = "seq") -> DataFrame:
    """Adds number: the running number per turn and kind of call."""
    return calls.withColumn("number", F.row_number().over(W.partitionBy(turn, "call_kind").orderBy(order)))


def turn_summary(events: DataFrame, turn: str = "turn") -> DataFrame:
    """Per turn: model calls by kind, tool runs, model time, tokens, cut calls by reason, failed and cancelled events."""
    model = F.col("kind").isin(*MODEL_KINDS)
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    total = lambda c: F.sum(F.when(model, F.coalesce(c, F.lit(0))).otherwise(0)).cast("long")
    kinds = [n(F.col("kind") == k).alias(f"{k}_calls") for k in MODEL_KINDS]
    cut = [n(model & (F.col("finish") == r)).alias(f"cut_{r}") for r in ("length", "reasoning_budget")]
    tokens = [total(f"{k}_tokens").alias(f"{k}_tokens") for k in ("prompt", "completion", "reasoning")]
    return events.groupBy(turn).agg(*kinds, n(F.col("kind") == "tool").alias("tool_runs"), total("elapsed_ms").alias("model_ms"), *tokens, *cut, n(F.col("status").isin("failed", "cancelled")).alias("failed"))


def slowest_calls(events: DataFrame, k: int = 3, turn: str = "turn") -> DataFrame:
    """The k slowest model calls of each turn that has more than k, with rank."""
    calls = events.filter(F.col("kind").isin(*MODEL_KINDS))
    ranked = calls.withColumns({
        "rank": F.row_number().over(W.partitionBy(turn).orderBy(F.desc("elapsed_ms"), "seq")), "calls": F.count(F.lit(1)).over(W.partitionBy(turn)),
    })
    return ranked.filter((F.col("rank") <= k) & (F.col("calls") > k) & (F.col("elapsed_ms") > 0)).select(turn, "rank", "seq", "label", "elapsed_ms", "reasoning_tokens")


def usage_counters(calls: DataFrame, turn: str = "turn") -> DataFrame:
    """Per turn the usage counters. calls: call_kind (answer, ocr, grounding, analysis), length_stop, forced, stopped,
    reasoning_tokens, and tiles and blank of the image that a row stands for (null for none)."""
    n = lambda c: F.sum(F.when(c, 1).otherwise(0)).cast("long")
    out = [n(F.col("call_kind") == k).alias(f"{k}_calls") for k in ("ocr", "grounding", "answer", "analysis")]
    out += [n(F.col("tiles").isNotNull()).alias("tiled_images"), F.coalesce(F.sum("tiles"), F.lit(0)).cast("long").alias("tiles"), F.coalesce(F.sum("blank"), F.lit(0)).cast("long").alias("blank_tiles")]
    out += [n((F.col("call_kind") == k) & F.col("length_stop")).alias(f"{k}_length_stops") for k in ("ocr", "grounding", "analysis")]
    out += [n((F.col("call_kind") == k) & F.col(c)).alias(f"{k}_reasoning_{c}") for c in ("forced", "stopped") for k in ("answer", "grounding", "ocr", "analysis")]
    return calls.groupBy(turn).agg(*out, F.sum("reasoning_tokens").cast("long").alias("reasoning_tokens"))


def action_summary(actions: DataFrame, turn: str = "turn", shown: int = 6, settings: Settings = DEFAULTS) -> DataFrame:
    """Per kind, stopped and reason: the first images named, and how many more. At most max_actions of a turn count."""
    own = W.partitionBy(turn).orderBy("seq")
    first = actions.withColumn("rn", F.row_number().over(own)).filter(F.col("rn") <= settings.max_actions)
    short = F.when(F.contains("image", F.lit(" · tile ")), F.split("image", " · tile ")[1]).otherwise(F.element_at(F.split("image", " · "), -1))
    named = F.transform(F.sort_array(F.collect_list(F.when(short != "", F.struct("seq", short.alias("n"))))), lambda x: x["n"])
    groups = first.groupBy(turn, "kind", "stopped", "reason").agg(named.alias("names"))
    return groups.select(turn, "kind", "stopped", "reason", F.array_join(F.slice("names", 1, shown), ", ").alias("images"), F.greatest(F.size("names") - shown, F.lit(0)).alias("more"))


def retried_after_limit(calls: DataFrame, keys: list[str]) -> DataFrame:
    """Images called again although a call had hit the output limit: there must be none."""
    g = calls.groupBy(*keys).agg(F.count(F.lit(1)).alias("calls"), F.max(F.col("finish") == "length").alias("cut"))
    return g.filter("cut and calls > 1").select(*keys, "calls")


def close_turns(events: DataFrame, turns: DataFrame, turn: str = "turn") -> DataFrame:
    """Open events get the end, status and reason of their turn. turns: turn, ended_ms, turn_status, reason."""
    both = events.join(turns, turn)
    open_ = F.col("status") == "running"
    return both.select(
        *[c for c in events.columns if c not in ("status", "end_ms")], F.when(open_, F.col("ended_ms")).otherwise(F.col("end_ms")).alias("end_ms"),
        F.when(open_, F.col("turn_status")).otherwise(F.col("status")).alias("status"), F.when(open_ & (F.col("reason") != ""), F.col("reason")).alias("reason"),
    )


INTERRUPTED = "the server was restarted"


def interrupt_stale(traces: DataFrame, events: DataFrame, live: DataFrame, turn: str = "turn") -> tuple[DataFrame, DataFrame]:
    """(traces, events): running turns that aren't live become interrupted; their open events end no earlier than they start."""
    stale = traces.filter("status = 'running'").join(live.select(turn), turn, "left_anti").select(turn, "elapsed_ms", F.lit(True).alias("stale"))
    marked = traces.join(stale.select(turn, "stale"), turn, "left")
    new = marked.select(turn, "elapsed_ms", F.when(F.col("stale"), "interrupted").otherwise(F.col("status")).alias("status"), F.when(F.col("stale"), INTERRUPTED).alias("reason"))
    both = events.join(stale.withColumnRenamed("elapsed_ms", "turn_ms"), turn, "left")
    open_ = F.coalesce("stale", F.lit(False)) & (F.col("status") == "running")
    closed = both.withColumns({"end_ms": F.when(open_, F.greatest("turn_ms", "started_ms")).otherwise(F.col("end_ms")), "status": F.when(open_, "interrupted").otherwise(F.col("status"))})
    return new, closed.select(*events.columns)


def orphan_traces(traces: DataFrame, messages: DataFrame) -> DataFrame:
    """Traces that no answer refers to. messages: trace_id."""
    return traces.join(messages.filter("trace_id is not null").select("trace_id").distinct(), "trace_id", "left_anti")


def compare_modes(runs: DataFrame, measures: list[str]) -> DataFrame:
    """Per attempt the measures of both modes side by side, and a last row (attempt null) with their means."""
    first = [F.first(F.when(F.col("mode") == m, F.col(c)), ignorenulls=True).alias(f"{m}_{c}") for m in ("whole", "tile") for c in measures]
    side = runs.groupBy("attempt").agg(*first)
    mean = side.agg(*[F.round(F.avg(c), 6).alias(c) for c in side.columns[1:]]).select(F.lit(None).cast(side.schema["attempt"].dataType).alias("attempt"), "*")
    return side.select("attempt", *[F.round(F.col(c).cast("double"), 6).alias(c) for c in side.columns[1:]]).unionByName(mean)


def level_effect(calls: DataFrame, key: str = "model") -> DataFrame:
    """Per model and level: tokens of the prompt, whether the level was refused, and whether levels have no effect.

    A model ignores levels if all its accepted levels, more than one, have equal prompt tokens.
    """
    levels = calls.groupBy(key, "level").agg(F.min("prompt_tokens").alias("prompt_tokens"), F.min("refused").alias("refused"))
    accepted = levels.filter(~F.col("refused")).groupBy(key).agg(F.count_distinct("prompt_tokens").alias("kinds"), F.count(F.lit(1)).alias("accepted"))
    return levels.join(accepted, key, "left").select(key, "level", "prompt_tokens", "refused", F.coalesce((F.col("kinds") == 1) & (F.col("accepted") > 1), F.lit(False)).alias("ignored"))


def clipping_audit(available: DataFrame, sent: DataFrame, keys: list[str]) -> DataFrame:
    """Characters available and sent per document, whether it was clipped, and its share of the conversation's budget."""
    both = available.join(sent, keys)
    total = F.sum("sent_chars").over(W.partitionBy(keys[0]))
    return both.withColumns({"clipped": F.col("sent_chars") < F.col("chars"), "share": F.when(total > 0, F.round(F.col("sent_chars") / total, 6)).otherwise(0.0)})


def check_gates(results: DataFrame, gates: DataFrame) -> DataFrame:
    """Per criterion: runs, pass rate, and whether it reaches its threshold. gates: criterion, threshold; small."""
    rates = results.groupBy("criterion").agg(F.count(F.lit(1)).alias("runs"), F.avg(F.col("passed").cast("double")).alias("rate"))
    return rates.join(gates, "criterion").select("criterion", "runs", F.round("rate", 6).alias("rate"), "threshold", (F.col("rate") >= F.col("threshold")).alias("met"))


def link_images(images: DataFrame, attachments: DataFrame) -> DataFrame:
    """Images named in calls with attachment id and size; a tile resolves through its root name.

    images: conversation_id, name, is_tile, row, col, x0, y0, x1, y1, width, height. attachments: conversation_id, name, id, width, height.
    """
    root = F.when(F.col("is_tile"), F.split("name", " · tile ", 2)[0]).otherwise(F.col("name"))
    known = attachments.select("conversation_id", F.col("name").alias("root"), F.col("id").alias("attachment_id"), F.col("width").alias("own_width"), F.col("height").alias("own_height"))
    both = images.withColumn("root", root).join(known, ["conversation_id", "root"], "left")
    tile = lambda c: F.when(F.col("is_tile"), F.col(c)).alias(c)
    box = [F.when(F.col("is_tile"), F.round(c, 4)).alias(c) for c in ("x0", "y0", "x1", "y1")]
    return both.select("conversation_id", "name", "attachment_id", F.coalesce("width", "own_width").alias("width"), F.coalesce("height", "own_height").alias("height"), tile("row"), tile("col"), *box)


def _clipped(text: Column, most: int) -> Column:
    half = max(1, (most - 60) // 2)
    note = F.concat(F.lit("\n…["), F.format_number(F.length(text) - 2 * half, 0), F.lit("자 생략]…\n"))
    return F.when(F.length(text) <= most, text).otherwise(F.concat(F.substring(text, 1, half), note, F.right(text, F.lit(half))))


def clip_trace_text(df: DataFrame, text: str = "text", settings: Settings = DEFAULTS, limit: int | None = None) -> DataFrame:
    """Adds chars; long texts keep head and tail with a note of what is left out."""
    return df.withColumns({"chars": F.length(text), text: _clipped(F.col(text), limit or settings.trace_text)})


def describe_messages(messages: Column, settings: Settings = DEFAULTS, limit: int | None = None) -> Column:
    """A call's messages as a trace keeps them: role, clipped content, chars, tool calls; name and call id of tool results.

    messages: array of role, content, tool_calls (array of name, arguments, id), name, tool_call_id, images_anchor. Null
    messages are left out.
    """

    def one(m: Column) -> Column:
        content, tool = F.coalesce(m["content"], F.lit("")), F.coalesce(m["role"] == "tool", F.lit(False))
        return F.struct(
            F.coalesce(m["role"], F.lit("")).alias("role"), _clipped(content, limit or settings.trace_text).alias("content"), F.length(content).alias("chars"), F.when(F.size(m["tool_calls"]) > 0, m["tool_calls"]).alias("toolCalls"),
            F.when(tool, F.coalesce(m["name"], F.lit(""))).alias("name"), F.when(tool, F.coalesce(m["tool_call_id"], F.lit(""))).alias("toolCallId"), F.when(m["images_anchor"], F.lit(True)).alias("imagesAnchor"),
        )

    return F.coalesce(F.transform(F.filter(messages, lambda m: m.isNotNull()), one), F.array().cast("array<struct<role:string,content:string,chars:int,toolCalls:array<struct<name:string,arguments:string,id:string>>,name:string,toolCallId:string,imagesAnchor:boolean>>"))


# What servers say when a prompt is too long or tools aren't supported.
CONTEXT_ERROR = (
    r"(?i)context.?window|maximum context length|context length|context size|too many tokens|input tokens|"
    r"prompt is too long|exceeds? the (?:available )?context|n_ctx|token limit"
)
TOOLS_ERROR = r"(?i)tool|function.?call|chat template|jinja"


def classify_errors(calls: DataFrame) -> DataFrame:
    """Adds error_kind. calls: status_code, message, finish."""
    m = F.coalesce("message", F.lit(""))
    kind = (
        F.when(F.lower("finish").isin("length", "max_tokens", "max_output_tokens"), "output-limit").when(F.col("finish") == "reasoning_runaway", "unfinished-reasoning")
        .when(m.rlike(CONTEXT_ERROR), "context-overflow").when(F.col("status_code").isin(400, 404, 422, 501) | m.rlike(TOOLS_ERROR), "tools-unsupported").otherwise("other")
    )
    return calls.withColumn("error_kind", kind)


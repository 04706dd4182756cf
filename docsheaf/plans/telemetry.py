"""Registered queries of telemetry and of the batch forms of the stream operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsheaf import fixtures as X
from docsheaf.fixtures import oracle
from docsheaf.operators import telemetry as T
from docsheaf.streaming import calls as S

_FIELDS = ("turn", "seq", "kind", "label", "status", "started_ms", "elapsed_ms", "parent")


def _events(spark, sf_dir):
    return X.trace_events(spark, sf_dir)


def a7_export_traces(spark, sf_dir):
    return T.export_traces(_events(spark, sf_dir).select("turn", "seq", "kind", "elapsed_ms"))


def i1_explode_traces(spark, sf_dir):
    docs = T.export_traces(_events(spark, sf_dir).select(*_FIELDS))
    return T.explode_traces(docs, "seq:int,kind:string,label:string,status:string,started_ms:bigint,elapsed_ms:bigint,parent:int")


def i2_span_tree(spark, sf_dir):
    return T.span_tree(_events(spark, sf_dir).withColumn("parent", F.when(F.col("seq") % 8 == 0, F.lit(9_999_999)).when(F.col("seq") % 8 == 1, F.lit(None)).otherwise(F.greatest(F.col("parent"), F.col("seq") - F.col("seq") % 8))))


def i3_classify_calls(spark, sf_dir):
    return T.classify_calls(_tools(spark, sf_dir)).select("turn", "seq", "call_kind")


def _tools(spark, sf_dir):
    e = _events(spark, sf_dir)
    return e.withColumn("label", F.when((F.col("kind") == "tool") & (F.col("prompt_tokens") % 2 == 0), "inspect_visual").when((F.col("kind") == "tool") & (F.col("prompt_tokens") % 3 == 0), "analyze_pages").otherwise(F.col("label")))


def i4_number_calls(spark, sf_dir):
    return T.number_calls(T.classify_calls(_tools(spark, sf_dir))).select("turn", "seq", "call_kind", "number")


def i5_turn_summary(spark, sf_dir):
    return T.turn_summary(_events(spark, sf_dir))


def i6_slowest_calls(spark, sf_dir):
    return T.slowest_calls(_events(spark, sf_dir))


def i7_usage_counters(spark, sf_dir):
    k = F.col("prompt_tokens")
    e = _events(spark, sf_dir).select(
        "turn", F.when(k % 4 == 0, "ocr").when(k % 4 == 1, "grounding").when(k % 4 == 2, "analysis").otherwise("answer").alias("call_kind"), (F.col("finish") == "length").alias("length_stop"), (k % 7 == 0).alias("forced"),
        (k % 14 == 0).alias("stopped"), "reasoning_tokens", F.when(k % 6 == 0, k % 20).alias("tiles"), F.when(k % 6 == 0, k % 3).alias("blank"),
    )
    return T.usage_counters(e)


def i8_action_summary(spark, sf_dir):
    e = _events(spark, sf_dir).select(
        "turn", "seq", "kind", (F.col("prompt_tokens") % 2 == 0).alias("stopped"), F.when(F.col("prompt_tokens") % 4 < 2, "repeat").otherwise("budget").alias("reason"),
        F.concat(F.lit("plan.pdf · page 1 · tile r"), F.col("image").cast("string"), F.lit("c1")).alias("image"))
    return T.action_summary(e)


def i9_retried_after_limit(spark, sf_dir):
    return T.retried_after_limit(_events(spark, sf_dir).filter("kind <> 'tool'"), ["turn", "image"])


def i10_close_turns(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("end_ms", F.when(F.col("status") != "running", F.col("started_ms") + F.col("elapsed_ms"))).select("turn", "seq", "status", "end_ms")
    turns = _events(spark, sf_dir).groupBy("turn").agg((F.max("started_ms") + 1000).alias("ended_ms")).select("turn", "ended_ms", F.when(F.col("turn") % 3 == 0, "failed").otherwise("done").alias("turn_status"), F.when(F.col("turn") % 3 == 0, "timeout").otherwise("").alias("reason"))
    return T.close_turns(e, turns)


def i11_interrupt_stale(spark, sf_dir):
    e = _events(spark, sf_dir).withColumn("end_ms", F.when(F.col("status") != "running", F.col("started_ms") + F.col("elapsed_ms"))).select("turn", "seq", "status", "started_ms", "end_ms")
    traces = e.groupBy("turn").agg((F.max("started_ms") - 500).alias("elapsed_ms")).withColumn("status", F.when(F.col("turn") % 2 == 0, "running").otherwise("done"))
    return T.interrupt_stale(traces, e, traces.filter("turn % 6 = 0"))[1]


def i12_orphan_traces(spark, sf_dir):
    traces = X.conversations(spark, sf_dir).select(F.concat(F.lit("t-"), "id").alias("trace_id"))
    m = X.messages(spark, sf_dir).filter("role = 'assistant'").select(F.when(F.col("position") % 3 == 1, F.concat(F.lit("t-"), "conversation_id")).alias("trace_id"))
    return T.orphan_traces(traces, m)


def i13_compare_modes(spark, sf_dir):
    e = _events(spark, sf_dir).groupBy((F.col("seq") % 20).alias("attempt"), F.when(F.col("turn") % 2 == 0, "whole").otherwise("tile").alias("mode")).agg(F.count(F.lit(1)).alias("calls"), F.sum("elapsed_ms").alias("time_ms"))
    return T.compare_modes(e, ["calls", "time_ms"])


def i14_level_effect(spark, sf_dir):
    e = _events(spark, sf_dir).select(F.col("turn").alias("model"), (F.col("prompt_tokens") % 4).alias("level"), F.when(F.col("turn") % 3 == 0, F.lit(68)).otherwise(60 + F.col("prompt_tokens") % 4).alias("prompt_tokens"), (F.col("prompt_tokens") % 4 == 3).alias("refused"))
    return T.level_effect(e)


def i15_clipping_audit(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select(F.col("source").alias("conversation_id"), "doc_id", F.length("text").cast("long").alias("chars"))
    return T.clipping_audit(d, d.select("conversation_id", "doc_id", F.least(F.col("chars"), F.lit(1500)).cast("long").alias("sent_chars")), ["conversation_id", "doc_id"])


def i16_check_gates(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").join(X.table(spark, sf_dir, "labels"), "doc_id").select(F.col("source").alias("criterion"), (F.col("quality") == 1).alias("passed"))
    return T.check_gates(d, d.select("criterion").distinct().withColumn("threshold", F.lit(0.9)))


def i17_link_images(spark, sf_dir):
    a = X.attachments(spark, sf_dir).filter("kind = 'image'")
    tile = F.col("id") % 2 == 0
    images = a.select("conversation_id", F.when(tile, F.concat("name", F.lit(" · tile r1c2"))).otherwise(F.col("name")).alias("name"), tile.alias("is_tile"), F.lit(1).alias("row"), F.lit(2).alias("col"), *[F.lit(v).alias(c) for c, v in (("x0", 0.123456), ("y0", 0.0), ("x1", 0.5), ("y1", 0.75))], F.when(F.col("id") % 3 == 0, 640).alias("width"), F.when(F.col("id") % 3 == 0, 480).alias("height"))
    return T.link_images(images, a.filter("id % 5 <> 4").select("conversation_id", "name", "id", F.lit(1000).alias("width"), F.lit(800).alias("height")))


def i18_clip_trace_text(spark, sf_dir):
    return T.clip_trace_text(X.table(spark, sf_dir, "documents").select("doc_id", "text"), limit=1000)


def i18_describe_messages(spark, sf_dir):
    """The messages of a conversation as one call's list, every third one a tool result."""
    n = F.length("content")
    call = F.struct(F.lit("search").alias("name"), F.lit("{}").alias("arguments"), F.concat(F.lit("c"), n.cast("string")).alias("id"))
    none = F.array().cast("array<struct<name:string,arguments:string,id:string>>")
    message = F.struct(
        F.when(n % 3 == 0, "tool").otherwise(F.col("role")).alias("role"), F.when(n % 5 > 0, F.col("content")).alias("content"), F.when(n % 4 == 0, F.array(call)).otherwise(none).alias("tool_calls"), F.when(n % 2 == 0, "search").alias("name"),
        F.concat(F.lit("c"), n.cast("string")).alias("tool_call_id"), (n % 7 == 0).alias("images_anchor"),
    )
    m = X.messages(spark, sf_dir).groupBy("conversation_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("position", message.alias("m")))), lambda x: x["m"]).alias("messages"))
    return m.select("conversation_id", F.to_json(T.describe_messages(F.col("messages"), limit=100)).alias("described"))


def i19_classify_errors(spark, sf_dir):
    m = X.messages(spark, sf_dir)
    n = F.length("content")
    text = F.when(n % 5 == 0, F.concat(F.lit("Prompt is too long: "), "content")).when(n % 5 == 1, F.concat(F.lit("no Function-Call here: "), "content")).otherwise(F.col("content"))
    return T.classify_errors(m.select("conversation_id", "position", text.alias("message"), F.when(n % 7 == 0, 400).otherwise(500).alias("status_code"), F.when(n % 11 == 0, "MAX_TOKENS").when(n % 13 == 0, "reasoning_runaway").otherwise("").alias("finish"))).select("conversation_id", "position", "error_kind")


def j1_reasoning_budget(spark, sf_dir):
    return S.reasoning_budget(X.chunks(spark, sf_dir), 100)


def call_lines(spark, sf_dir):
    return X.lines(spark, sf_dir).filter("trim(line) <> ''").select(F.col("doc_id").alias("call_id"), F.row_number().over(S.W.partitionBy("doc_id").orderBy("line_no")).alias("pos"), F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("thinking about part "), (F.col("line_no") % (1 + F.col("doc_id") % 5)).cast("string"))).otherwise(S.squeeze(F.col("line"))).alias("line"))


def j2_repetition(spark, sf_dir):
    return S.repetition(call_lines(spark, sf_dir))


def j3_split_think(spark, sf_dir):
    text = F.concat(F.lit("<thi"), F.lit("nk>"), "piece", F.lit("</th"), F.lit("ink> "), "piece")
    cut = X.chunks(spark, sf_dir).select("call_id", F.explode(F.array(*[F.struct((F.col("seq") * 10 + k).alias("seq"), F.substring(text, 1 + 7 * k, 7 if k < 9 else 100_000).alias("piece")) for k in range(10)])).alias("c"))
    return S.split_think(cut.select("call_id", "c.*"))


def chunk_rows(spark, sf_dir):
    """The words of a message in turn as content, reasoning and parts of two tool calls, the second of which has no name."""
    k = F.col("seq") % 4
    return X.chunks(spark, sf_dir).select(
        "call_id", "seq", F.when(k == 0, F.concat("piece", F.lit(" "))).alias("content"), F.when(k == 1, F.concat("piece", F.lit(" "))).alias("reasoning"), F.when(k >= 2, (F.col("seq") % 2)).alias("tool_index"),
        F.when(k == 2, F.concat(F.lit("id"), F.col("seq").cast("string"))).alias("tool_id"), F.when(F.col("seq") % 12 == 2, F.lit("search")).alias("tool_name"),
        F.when(F.col("seq") == 2, '{"n": ').when(F.col("seq") == 6, '"7"}').when(k == 3, F.col("piece")).alias("tool_args"),
        F.when(F.col("seq") % 9 == 8, F.when(F.col("seq") % 2 == 0, "stop").otherwise("length")).alias("finish"), F.when(F.col("seq") % 5 == 4, F.col("seq").cast("long")).alias("tokens"),
    )


def j4_assemble_calls(spark, sf_dir):
    return S.assemble_calls(chunk_rows(spark, sf_dir))


def j5_throttle_progress(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"), "event_id")
    return S.throttle_progress(e, 3600.0, tie="event_id")


def j6_reasoning_outcomes(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("event_id").alias("call_id"), "user_id", F.floor("value").cast("long").alias("v"))
    first = e.select("call_id", F.when(F.col("call_id") % 3 == 0, "budget").when(F.col("call_id") % 3 == 1, "repeat").otherwise("").alias("verdict"), F.col("v").alias("tokens"))
    second = e.select("call_id", F.when(F.col("user_id") % 7 == 0, "HTTP 400").alias("error"), (F.col("v") * 5).alias("tokens"), (F.col("user_id") % 11 == 0).alias("repeated"), (F.col("user_id") % 5 > 0).alias("answered"))
    return S.reasoning_outcomes(first, second)


_TOOLS = """, e AS (SELECT * REPLACE (CASE WHEN kind = 'tool' AND prompt_tokens % 2 = 0 THEN 'inspect_visual' WHEN kind = 'tool' AND prompt_tokens % 3 = 0 THEN 'analyze_pages' ELSE label END AS label) FROM v_event),
c AS (SELECT e.turn, e.seq, CASE WHEN p.kind = 'ocr' THEN 'ocr' WHEN p.kind = 'tool' THEN CASE p.label WHEN 'inspect_visual' THEN 'grounding' WHEN 'analyze_pages' THEN 'analysis' ELSE 'tool:' || p.label END ELSE 'answer' END AS call_kind FROM e LEFT JOIN e p ON e.turn = p.turn AND e.parent = p.seq WHERE e.kind = 'llm')
"""
#: Ends of blocks of k lines that have come three times in a row.
REPETITION = r""", l AS (SELECT doc_id AS call_id, row_number() OVER (PARTITION BY doc_id ORDER BY line_no) AS pos, CASE WHEN doc_id % 3 = 0 THEN 'thinking about part ' || line_no % (1 + doc_id % 5) ELSE trim(regexp_replace(line, '\s+', ' ', 'g')) END AS line FROM v_line WHERE trim(line) <> ''),
 n AS (SELECT call_id, list(line ORDER BY pos) AS ls FROM l GROUP BY call_id), p AS (SELECT call_id, pos, k, ls[pos-k+1:pos] AS b, ls[pos-2*k+1:pos-k] AS c, ls[pos-3*k+1:pos-2*k] AS d FROM (SELECT l.call_id, l.pos, ls, unnest(range(1, 9)) AS k FROM l JOIN n ON l.call_id = n.call_id) WHERE pos >= 3 * k),
 hits AS (SELECT * FROM p WHERE b = c AND c = d AND list_sum(list_transform(b, lambda x: length(x))) >= 24)
 """
J4_ROWS = r"""SELECT call_id, regexp_replace(coalesce(string_agg(piece || ' ', '' ORDER BY seq) FILTER (seq % 4 = 0), ''), '^\s+|\s+$', '', 'g') AS text,
 regexp_replace(coalesce(string_agg(piece || ' ', '' ORDER BY seq) FILTER (seq % 4 = 1), ''), '^\s+|\s+$', '', 'g') AS reasoning, arg_max(CASE WHEN seq % 2 = 0 THEN 'stop' ELSE 'length' END, seq) FILTER (seq % 9 = 8) AS finish,
 CAST(max(seq) FILTER (seq % 5 = 4) AS BIGINT) AS tokens, CASE WHEN max(seq) < 2 THEN '[]' ELSE '[{"name":"search","id":"id' || max(seq) FILTER (seq % 4 = 2) || '","arguments":"' || CASE WHEN max(seq) >= 6 THEN '{\"n\":\"7\"}' ELSE '{}' END || '"}]' END AS tool_calls
 FROM v_chunk GROUP BY call_id"""
_M = "kind IN ('llm', 'ocr', 'grounding')"
ORACLES = {
    "i1_explode_traces": oracle("v_event", "SELECT " + ", ".join(_FIELDS) + " FROM v_event"),
    "i2_span_tree": oracle("v_event", """, e AS (SELECT turn, seq, CASE WHEN seq % 8 IN (0, 1) OR greatest(parent, seq - seq % 8) < 1 THEN NULL ELSE greatest(parent, seq - seq % 8) END AS parent FROM v_event),
 t AS (WITH RECURSIVE w AS (SELECT turn, seq, parent, 0 AS depth, seq::VARCHAR AS path FROM e WHERE parent IS NULL UNION ALL SELECT e.turn, e.seq, e.parent, w.depth + 1, w.path || '/' || e.seq FROM e JOIN w ON e.turn = w.turn AND e.parent = w.seq) SELECT * FROM w)
 SELECT t.*, coalesce(n, 0) AS children FROM t LEFT JOIN (SELECT turn, parent AS p, count(*) AS n FROM e GROUP BY ALL) x ON x.turn = t.turn AND x.p = t.seq"""),
    "i3_classify_calls": oracle("v_event", _TOOLS + "SELECT * FROM c"),
    "i4_number_calls": oracle("v_event", _TOOLS + "SELECT *, row_number() OVER (PARTITION BY turn, call_kind ORDER BY seq) AS number FROM c"),
    "i5_turn_summary": oracle("v_event", f"SELECT turn, count(*) FILTER (kind = 'llm') AS llm_calls, count(*) FILTER (kind = 'ocr') AS ocr_calls, count(*) FILTER (kind = 'grounding') AS grounding_calls, count(*) FILTER (kind = 'tool') AS tool_runs, coalesce(sum(elapsed_ms) FILTER ({_M}), 0) AS model_ms, coalesce(sum(prompt_tokens) FILTER ({_M}), 0) AS prompt_tokens, coalesce(sum(completion_tokens) FILTER ({_M}), 0) AS completion_tokens, coalesce(sum(reasoning_tokens) FILTER ({_M}), 0) AS reasoning_tokens, count(*) FILTER ({_M} AND finish = 'length') AS cut_length, count(*) FILTER ({_M} AND finish = 'reasoning_budget') AS cut_reasoning_budget, count(*) FILTER (status IN ('failed', 'cancelled')) AS failed FROM v_event GROUP BY turn"),
    "i6_slowest_calls": oracle("v_event", f"SELECT turn, rank, seq, label, elapsed_ms, reasoning_tokens FROM (SELECT *, row_number() OVER (PARTITION BY turn ORDER BY elapsed_ms DESC, seq) AS rank, count(*) OVER (PARTITION BY turn) AS n FROM v_event WHERE {_M}) WHERE rank <= 3 AND n > 3 AND elapsed_ms > 0"),
    "a7_export_traces": oracle("v_event", """SELECT turn, '{"events":[' || string_agg('{"seq":' || seq || ',"kind":"' || kind || '","elapsed_ms":' || elapsed_ms || '}', ',' ORDER BY seq) || ']}' AS document FROM v_event GROUP BY turn"""),
    "j4_assemble_calls": oracle("v_chunk", J4_ROWS),
    "j5_throttle_progress": """WITH RECURSIVE e AS (SELECT user_id AS call_id, epoch_us(ts::TIMESTAMP) / 1e6 AS t, event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 k AS (SELECT call_id, t, event_id, n FROM e WHERE n = 1 UNION ALL SELECT call_id, t, event_id, n FROM (SELECT e.*, min(e.n) OVER (PARTITION BY e.call_id) AS first FROM k JOIN e ON e.call_id = k.call_id AND e.n > k.n AND e.t - k.t >= 3600) WHERE n = first)
 SELECT call_id, t AS "at", event_id FROM k""",
    "i7_usage_counters": oracle("v_event", ", c AS (SELECT turn, CASE prompt_tokens % 4 WHEN 0 THEN 'ocr' WHEN 1 THEN 'grounding' WHEN 2 THEN 'analysis' ELSE 'answer' END AS k, finish = 'length' AS l, prompt_tokens % 7 = 0 AS f, prompt_tokens % 14 = 0 AS s, reasoning_tokens AS r, CASE WHEN prompt_tokens % 6 = 0 THEN prompt_tokens % 20 END AS t, CASE WHEN prompt_tokens % 6 = 0 THEN prompt_tokens % 3 END AS b FROM v_event) SELECT turn, " + ", ".join(f"count(*) FILTER (k = '{k}') AS {k}_calls" for k in ("ocr", "grounding", "answer", "analysis")) + ", count(t) AS tiled_images, coalesce(sum(t), 0) AS tiles, coalesce(sum(b), 0) AS blank_tiles, " + ", ".join(f"count(*) FILTER (k = '{k}' AND l) AS {k}_length_stops" for k in ("ocr", "grounding", "analysis")) + ", " + ", ".join(f"count(*) FILTER (k = '{k}' AND {c[0]}) AS {k}_reasoning_{c}" for c in ("forced", "stopped") for k in ("answer", "grounding", "ocr", "analysis")) + ", sum(r) AS reasoning_tokens FROM c GROUP BY turn"),
    "i8_action_summary": oracle("v_event", ", a AS (SELECT turn, seq, kind, prompt_tokens % 2 = 0 AS stopped, CASE WHEN prompt_tokens % 4 < 2 THEN 'repeat' ELSE 'budget' END AS reason, 'r' || image || 'c1' AS n, row_number() OVER (PARTITION BY turn ORDER BY seq) AS rn FROM v_event) SELECT turn, kind, stopped, reason, array_to_string(list(n ORDER BY seq)[1:6], ', ') AS images, greatest(count(*) - 6, 0) AS more FROM a WHERE rn <= 60 GROUP BY turn, kind, stopped, reason"),
    "i9_retried_after_limit": oracle("v_event", "SELECT turn, image, count(*) AS calls FROM v_event WHERE kind <> 'tool' GROUP BY turn, image HAVING bool_or(finish = 'length') AND count(*) > 1"),
    "i10_close_turns": oracle("v_event", ", t AS (SELECT turn, max(started_ms) + 1000 AS e FROM v_event GROUP BY turn) SELECT v.turn, seq, CASE WHEN status = 'running' THEN e ELSE started_ms + elapsed_ms END AS end_ms, CASE WHEN status <> 'running' THEN status WHEN v.turn % 3 = 0 THEN 'failed' ELSE 'done' END AS status, CASE WHEN status = 'running' AND v.turn % 3 = 0 THEN 'timeout' END AS reason FROM v_event v JOIN t ON v.turn = t.turn"),
    "i11_interrupt_stale": oracle("v_event", ", t AS (SELECT turn, max(started_ms) - 500 AS e FROM v_event GROUP BY turn) SELECT v.turn, seq, CASE WHEN v.turn % 2 = 0 AND v.turn % 6 <> 0 AND status = 'running' THEN 'interrupted' ELSE status END AS status, started_ms, CASE WHEN status <> 'running' THEN started_ms + elapsed_ms WHEN v.turn % 2 = 0 AND v.turn % 6 <> 0 THEN greatest(e, started_ms) END AS end_ms FROM v_event v JOIN t ON v.turn = t.turn"),
    "i12_orphan_traces": oracle("v_conv v_msg", "SELECT 't-' || id AS trace_id FROM v_conv WHERE id NOT IN (SELECT conversation_id FROM v_msg WHERE role = 'assistant' AND position % 3 = 1)"),
    "i13_compare_modes": oracle("v_event", ", r AS (SELECT seq % 20 AS attempt, CASE WHEN turn % 2 = 0 THEN 'whole' ELSE 'tile' END AS mode, count(*) AS c, sum(elapsed_ms) AS t FROM v_event GROUP BY ALL), s AS (SELECT attempt, max(c) FILTER (mode = 'whole')::DOUBLE AS whole_calls, max(t) FILTER (mode = 'whole')::DOUBLE AS whole_time_ms, max(c) FILTER (mode = 'tile')::DOUBLE AS tile_calls, max(t) FILTER (mode = 'tile')::DOUBLE AS tile_time_ms FROM r GROUP BY attempt) SELECT * FROM s UNION ALL SELECT NULL, round(avg(whole_calls), 6), round(avg(whole_time_ms), 6), round(avg(tile_calls), 6), round(avg(tile_time_ms), 6) FROM s"),
    "i14_level_effect": oracle("v_event", ", l AS (SELECT DISTINCT turn AS model, prompt_tokens % 4 AS level, CASE WHEN turn % 3 = 0 THEN 68 ELSE 60 + prompt_tokens % 4 END AS prompt_tokens, prompt_tokens % 4 = 3 AS refused FROM v_event), a AS (SELECT model, count(DISTINCT prompt_tokens) AS k, count(*) AS n FROM l WHERE NOT refused GROUP BY model) SELECT l.*, coalesce(k = 1 AND n > 1, false) AS ignored FROM l LEFT JOIN a ON l.model = a.model"),
    "i15_clipping_audit": "SELECT source AS conversation_id, doc_id, length(text) AS chars, least(length(text), 1500) AS sent_chars, length(text) > 1500 AS clipped, round(least(length(text), 1500) / sum(least(length(text), 1500)) OVER (PARTITION BY source), 6) AS share FROM documents",
    "i16_check_gates": "SELECT source AS criterion, count(*) AS runs, round(avg((quality = 1)::INT), 6) AS rate, 0.9::DOUBLE AS threshold, avg((quality = 1)::INT) >= 0.9 AS met FROM documents JOIN labels USING (doc_id) GROUP BY source",
    "i17_link_images": oracle("v_att", "SELECT conversation_id, CASE WHEN id % 2 = 0 THEN name || ' · tile r1c2' ELSE name END AS name, CASE WHEN id % 5 <> 4 THEN id END AS attachment_id, CASE WHEN id % 3 = 0 THEN 640 WHEN id % 5 <> 4 THEN 1000 END AS width, CASE WHEN id % 3 = 0 THEN 480 WHEN id % 5 <> 4 THEN 800 END AS height, CASE WHEN id % 2 = 0 THEN 1 END AS row, CASE WHEN id % 2 = 0 THEN 2 END AS col, CASE WHEN id % 2 = 0 THEN 0.1235::DOUBLE END AS x0, CASE WHEN id % 2 = 0 THEN 0.0::DOUBLE END AS y0, CASE WHEN id % 2 = 0 THEN 0.5::DOUBLE END AS x1, CASE WHEN id % 2 = 0 THEN 0.75::DOUBLE END AS y1 FROM v_att WHERE kind = 'image'"),
    "i18_clip_trace_text": "SELECT doc_id, length(text) AS chars, CASE WHEN length(text) <= 1000 THEN text ELSE substr(text, 1, 470) || chr(10) || '…[' || format('{:,}', length(text) - 940) || '자 생략]…' || chr(10) || right(text, 470) END AS text FROM documents",
    "i18_describe_messages": oracle("v_msg", """, d AS (SELECT conversation_id, position, length(content) AS n, CASE WHEN length(content) % 3 = 0 THEN 'tool' ELSE role END AS role, CASE WHEN length(content) % 5 > 0 THEN content ELSE '' END AS c FROM v_msg),
 j AS (SELECT conversation_id, position, '{"role":"' || role || '","content":' || to_json(CASE WHEN length(c) <= 100 THEN c ELSE substr(c, 1, 20) || chr(10) || '…[' || format('{:,}', length(c) - 40) || '자 생략]…' || chr(10) || right(c, 20) END) || ',"chars":' || length(c) || CASE WHEN n % 4 = 0 THEN ',"toolCalls":[{"name":"search","arguments":"{}","id":"c' || n || '"}]' ELSE '' END
 || CASE WHEN role = 'tool' THEN ',"name":"' || CASE WHEN n % 2 = 0 THEN 'search' ELSE '' END || '","toolCallId":"c' || n || '"' ELSE '' END || CASE WHEN n % 7 = 0 THEN ',"imagesAnchor":true' ELSE '' END || '}' AS t FROM d) SELECT conversation_id, '[' || string_agg(t, ',' ORDER BY position) || ']' AS described FROM j GROUP BY conversation_id"""),
    "i19_classify_errors": oracle("v_msg", "SELECT conversation_id, position, CASE WHEN n % 11 = 0 THEN 'output-limit' WHEN n % 13 = 0 THEN 'unfinished-reasoning' WHEN regexp_matches(m, '" + T.CONTEXT_ERROR + "') THEN 'context-overflow' WHEN n % 7 = 0 OR regexp_matches(m, '" + T.TOOLS_ERROR + "') THEN 'tools-unsupported' ELSE 'other' END AS error_kind FROM (SELECT *, length(content) AS n, CASE length(content) % 5 WHEN 0 THEN 'Prompt is too long: ' || content WHEN 1 THEN 'no Function-Call here: ' || content ELSE content END AS m FROM v_msg)"),
    "j1_reasoning_budget": oracle("v_chunk", ", r AS (SELECT call_id, seq, piece, greatest(sum((length(piece) > 0)::INT) OVER w, sum(length(piece)) OVER w // 4) AS tokens FROM v_chunk WINDOW w AS (PARTITION BY call_id ORDER BY seq)) SELECT call_id, min(seq) AS seq, arg_min(tokens, seq) AS tokens FROM r WHERE tokens > 100 AND length(piece) > 0 GROUP BY call_id"),
    "j2_repetition": oracle("v_line", REPETITION + "SELECT call_id, arg_min(pos, pos * 10 + k) AS pos, arg_min(k, pos * 10 + k) AS length FROM hits GROUP BY call_id"),
    "j3_split_think": oracle("v_chunk", "SELECT call_id, string_agg(piece, '' ORDER BY seq) AS reasoning, string_agg(' ' || piece, '' ORDER BY seq) AS content FROM v_chunk GROUP BY call_id"),
    "j6_reasoning_outcomes": "SELECT event_id AS call_id, CASE WHEN event_id % 3 = 0 THEN 'budget' ELSE 'repeat' END AS forced, f AS runaway, CAST(floor(value) * 6 AS BIGINT) AS reasoning_tokens, f IS NULL AS answer_kept FROM (SELECT *, CASE WHEN user_id % 7 = 0 THEN 'rejected' WHEN user_id % 11 = 0 THEN 'repeat' WHEN floor(value) * 5 > 512 THEN 'budget' WHEN user_id % 5 = 0 THEN 'empty' END AS f FROM events WHERE event_id % 3 <> 2)",
}
QUERIES = {k: v for k, v in dict(globals()).items() if k[:1] in "aij" and k[1:2].isdigit()}

"""Registered queries of dialogue analytics."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsheaf import fixtures as X
from docsheaf.fixtures import oracle
from docsheaf.operators import dialogue as D

_TOOLS = ["search", "view_page"]


def _msg(spark, sf_dir):
    n = F.length("content")
    text = (
        F.when(n % 7 == 0, F.concat(F.lit("한글 "), "content")).when(n % 7 == 1, F.concat(F.lit("かな "), "content")).when(n % 7 == 2, F.concat(F.lit("漢字 "), "content"))
        .when(n % 7 == 3, F.concat(F.lit("I cannot directly View the file. "), "content")).when(n % 7 == 4, F.concat(F.lit(" ERROR : "), "content")).otherwise(F.col("content"))
    )
    return X.messages(spark, sf_dir).withColumn("content", text)


def h1_detect_script(spark, sf_dir):
    return D.detect_script(_msg(spark, sf_dir)).select("conversation_id", "position", "script")


def h2_flag_false_refusals(spark, sf_dir):
    return D.flag_false_refusals(_msg(spark, sf_dir), X.attachments(spark, sf_dir)).select("conversation_id", "position")


def h3_flag_error_replies(spark, sf_dir):
    return D.flag_error_replies(_msg(spark, sf_dir)).select("conversation_id", "position")


def _calls(spark, sf_dir):
    m = X.messages(spark, sf_dir).select(F.concat_ws("-", "conversation_id", F.col("position").cast("string")).alias("reply"), "content")
    n = F.length("content")
    call = F.format_string('{"name": "%s", "arguments": {"q": %d}}', F.when(n % 3 == 0, "search").when(n % 3 == 1, "view_page").otherwise("other"), n)
    text = (
        F.when(n % 5 == 0, F.concat("content", F.lit("\n<tool_call>"), call, F.lit("</tool_call>"))).when(n % 5 == 1, F.concat(F.lit("```json\n"), call, F.lit("\n```")))
        .when(n % 5 == 2, F.concat(F.lit('{"tool_calls": ['), F.regexp_replace(call, r"\}$", ""), F.lit("]}"))).when(n % 5 == 3, F.concat(F.lit('{"tool_calls" "'), F.lit('search" broken'))).otherwise(F.col("content"))
    )
    return m.withColumn("content", text)


def h4_extract_tool_calls(spark, sf_dir):
    out = D.extract_tool_calls(_calls(spark, sf_dir), _TOOLS, "reply")
    return out.select("reply", F.size("calls").alias("n"), F.get("calls", F.lit(0))["name"].alias("name"), F.get("calls", F.lit(0))["arguments"].alias("arguments"))


def h5_flag_malformed_envelopes(spark, sf_dir):
    return D.flag_malformed_envelopes(_calls(spark, sf_dir), _TOOLS, "reply").select("reply")


def h6_repeated_calls(spark, sf_dir):
    e = X.trace_events(spark, sf_dir).select(F.concat_ws("-", F.col("turn").cast("string"), F.floor(F.col("seq") / 12).cast("string")).alias("turn"), (F.col("seq") % 12 + 1).alias("step"), F.floor(F.col("prompt_tokens") / 40).cast("string").alias("signature"))
    return D.repeated_calls(e)


def h7_flatten_transcript(spark, sf_dir):
    m = X.messages(spark, sf_dir)
    role = F.when(F.col("position") % 4 == 2, "tool").when(F.col("position") % 5 == 3, "user").otherwise(F.col("role"))
    return D.flatten_transcript(m.select("conversation_id", "position", role.alias("role"), "content", F.when(F.col("position") % 4 == 2, "search").alias("tool_name"), F.when(F.col("position") % 3 == 1, "search({})").alias("calls")))


def h8_stitch_continuations(spark, sf_dir):
    m = X.messages(spark, sf_dir)
    return D.stitch_continuations(m.select("conversation_id", F.col("position").alias("n"), F.when(F.length("content") % 9 == 0, "").otherwise(F.col("content")).alias("text"), F.when(F.length("content") % 4 > 0, "length").otherwise("stop").alias("finish")), "conversation_id")


def h9_answer_outcomes(spark, sf_dir):
    e = X.trace_events(spark, sf_dir)
    k = F.col("prompt_tokens")
    return D.answer_outcomes(e.select(F.when(k % 9 == 0, "max_steps").when(k % 9 == 1, "repeated_tool_call").otherwise("").alias("stopped"), (k % 8).alias("steps"), (k % 8 + 1).alias("model_calls"), (k % 3 == 0).alias("fallback"), (k % 2).alias("forced"), (k % 4 == 1).cast("int").alias("reasoning_stops")))


_MSG = ", m AS (SELECT conversation_id, position, role, CASE length(content) % 7 WHEN 0 THEN '한글 ' || content WHEN 1 THEN 'かな ' || content WHEN 2 THEN '漢字 ' || content WHEN 3 THEN 'I cannot directly View the file. ' || content WHEN 4 THEN ' ERROR : ' || content ELSE content END AS content FROM v_msg)\n"
ORACLES = {
    "h1_detect_script": oracle("v_msg", _MSG + "SELECT conversation_id, position, CASE WHEN regexp_matches(content, '[가-힣]') THEN 'ko' WHEN regexp_matches(content, '[぀-ヿ]') THEN 'ja' WHEN regexp_matches(content, '[一-鿿]') THEN 'zh' END AS script FROM m"),
    "h2_flag_false_refusals": oracle("v_msg v_att", _MSG + "SELECT conversation_id, position FROM m WHERE role = 'assistant' AND length(content) < 1500 AND regexp_matches(content, '(?i)" + "|".join(D.FALSE_REFUSAL).replace("'", "''") + "') AND conversation_id IN (SELECT conversation_id FROM v_att WHERE text <> '' OR kind = 'image')"),
    "h3_flag_error_replies": oracle("v_msg", _MSG + r"SELECT conversation_id, position FROM m WHERE role = 'assistant' AND regexp_matches(trim(content), '(?i)^(?:오류|error)\s*:')"),
    "h4_extract_tool_calls": oracle("v_msg", """, c AS (SELECT conversation_id || '-' || position AS reply, length(content) AS n FROM v_msg), k AS (SELECT *, n % 5 IN (0, 1, 2) AND n % 3 < 2 AS ok FROM c)
 SELECT reply, ok::INT AS n, CASE WHEN ok THEN CASE n % 3 WHEN 0 THEN 'search' ELSE 'view_page' END END AS name, CASE WHEN ok THEN '{"q":' || n || '}' END AS arguments FROM k"""),
    "h5_flag_malformed_envelopes": oracle("v_msg", "SELECT conversation_id || '-' || position AS reply FROM v_msg WHERE length(content) % 5 = 3"),
    "h8_stitch_continuations": oracle("v_msg", """, m AS (SELECT conversation_id, row_number() OVER (PARTITION BY conversation_id ORDER BY position) AS k, CASE WHEN length(content) % 9 = 0 THEN '' ELSE content END AS t, length(content) % 4 > 0 AS cut FROM v_msg),
 h AS (WITH RECURSIVE w AS (SELECT conversation_id, k, t AS text, cut AS open, 1 AS pieces FROM m WHERE k = 1 UNION ALL SELECT m.conversation_id, m.k, CASE WHEN m.t = '' OR ends_with(w.text, m.t) THEN w.text ELSE w.text || chr(10) || chr(10) || m.t END, m.t <> '' AND NOT ends_with(w.text, m.t) AND m.cut, w.pieces + (m.t <> '' AND NOT ends_with(w.text, m.t))::INT FROM w JOIN m ON m.conversation_id = w.conversation_id AND m.k = w.k + 1 WHERE w.open AND w.k <= 8) SELECT * FROM w)
 SELECT conversation_id, arg_max(text, k) AS text, max(pieces) AS pieces FROM h GROUP BY conversation_id"""),
    "h6_repeated_calls": oracle("v_event", ", e AS (SELECT turn || '-' || seq // 12 AS turn, seq % 12 + 1 AS step, prompt_tokens // 40 AS s FROM v_event), f AS (SELECT *, lag(s) OVER w AS a, lag(s, 2) OVER w AS b FROM e WINDOW w AS (PARTITION BY turn ORDER BY step)), g AS (SELECT turn, step, CASE WHEN s = a AND s = b THEN 'repeated_tool_call' WHEN step > 8 THEN 'max_steps' END AS why FROM f) SELECT turn, coalesce(min(step) FILTER (why IS NOT NULL) - 1, max(step)) AS steps, coalesce(arg_min(why, step) FILTER (why IS NOT NULL), '') AS stopped FROM g GROUP BY turn"),
    "h7_flatten_transcript": oracle("v_msg", r", r AS (SELECT conversation_id, position, CASE WHEN position % 4 = 2 THEN 'tool' WHEN position % 5 = 3 THEN 'user' ELSE role END AS role, content FROM v_msg), t AS (SELECT conversation_id, position, CASE WHEN role = 'tool' THEN 'user' ELSE role END AS role, CASE WHEN role = 'tool' THEN 'TOOL RESULT (search):' || chr(10) || content WHEN role = 'assistant' AND position % 3 = 1 THEN trim(content) || chr(10) || '[called tools: search({})]' ELSE content END AS content FROM r), i AS (SELECT *, sum(CASE WHEN role = 'user' AND p = 'user' THEN 0 ELSE 1 END) OVER (PARTITION BY conversation_id ORDER BY position) AS n FROM (SELECT *, lag(role) OVER (PARTITION BY conversation_id ORDER BY position) AS p FROM t)) SELECT conversation_id, n, min(role) AS role, string_agg(content, chr(10) || chr(10) ORDER BY position) AS content FROM i GROUP BY conversation_id, n"),
    "h9_answer_outcomes": oracle("v_event", "SELECT CASE prompt_tokens % 9 WHEN 0 THEN 'max_steps' WHEN 1 THEN 'repeated_tool_call' ELSE '' END AS stopped, count(*) AS turns, round(avg(prompt_tokens % 8), 6) AS mean_steps, sum(prompt_tokens % 8 + 1) AS model_calls, count(*) FILTER (prompt_tokens % 3 = 0) AS fallback, sum(prompt_tokens % 2) AS forced, count(*) FILTER (prompt_tokens % 4 = 1) AS reasoning_stops FROM v_event GROUP BY 1"),
}
QUERIES = {k: v for k, v in dict(globals()).items() if k[:1] == "h" and k[1:2].isdigit()}

"""Registered queries of evidence selection and retrieval."""

from __future__ import annotations

import dataclasses

from pyspark.sql import functions as F

from docsheaf import fixtures as X
from docsheaf.fixtures import oracle
from docsheaf.functions.text import clip
from docsheaf.operators import evidence as E
from docsheaf.operators import search_index as I
from docsheaf.session import shared_folder


def _att(spark, sf_dir):
    return X.attachments(spark, sf_dir)


def g1_with_root(spark, sf_dir):
    return E.with_root(_att(spark, sf_dir)).select("id", "root")


def g2_attachment_manifest(spark, sf_dir):
    return E.attachment_manifest(_att(spark, sf_dir))


def g3_clip_text(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", clip(F.col("text"), (F.col("doc_id") % 2000 + 50).cast("int")).alias("text"))


def g4_coverage_preview(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("[VISUAL SOURCE: a · page 1]\n"), "text", F.lit("\n\n[VISUAL SOURCE: a · page 2]\n"), "text").alias("text"))
    return d.select("doc_id", E.coverage_preview(F.col("text"), F.lit(1000)).alias("text"))


def g5_narrow_by_mention(spark, sf_dir):
    a = _att(spark, sf_dir)
    p = a.groupBy("conversation_id").agg(F.max("id").alias("k"), F.min("name").alias("n")).select("conversation_id", F.when(F.col("k") % 20 < 10, F.concat(F.lit("see "), F.upper("n"), F.lit(" now"))).otherwise("nothing").alias("prompt"))
    return E.narrow_by_mention(p, a).select("id")


def g6_fair_text_budget(spark, sf_dir):
    return E.fair_text_budget(_att(spark, sf_dir), 9000).select("id", "share", "text")


def g7_answer_image_candidates(spark, sf_dir):
    return E.answer_image_candidates(_att(spark, sf_dir), "whole")


def g8_round_robin(spark, sf_dir):
    return E.round_robin(g7_answer_image_candidates(spark, sf_dir), 6).select("conversation_id", "name", "place", "candidates")


def g9_context_budgets(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 4 > 0).alias("local"), (F.col("event_id") * 37 % 200_000 - 500).cast("int").alias("context_tokens"))
    return E.context_budgets(e)


def g10_compact_history(spark, sf_dir):
    m = X.messages(spark, sf_dir).withColumn("content", F.when((F.col("role") == "assistant") & (F.length("content") % 6 == 0), F.concat(F.lit("Error: "), "content")).otherwise(F.col("content")))
    return E.compact_history(m, 2500)


def g11_compact_overflow(spark, sf_dir):
    m = X.messages(spark, sf_dir).withColumn("role", F.when(F.col("position") % 4 == 2, "tool").when(F.col("position") == 0, "system").otherwise(F.col("role")))
    return E.compact_overflow(m, 2)


def g12_assemble_prompts(spark, sf_dir):
    a = _att(spark, sf_dir)
    p = a.select("conversation_id").distinct().withColumn("prompt", F.when(F.substring("conversation_id", -1, 1) == "3", "").otherwise(F.concat(F.lit("ask "), "conversation_id")))
    images = a.filter("kind = 'image'").select("conversation_id", F.col("position").alias("place"), "name", F.col("page_number").isNotNull().alias("is_page"))
    return E.assemble_prompts(p, a.filter("kind <> 'image'"), images)


def _searched(spark, sf_dir):
    q = X.table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.concat(F.lit(" "), "text").alias("query"))
    return q, X.table(spark, sf_dir, "documents").select(F.col("source").alias("conversation_id"), F.col("doc_id").alias("position"), F.col("doc_id").alias("doc"), "text")


def g13_search_documents(spark, sf_dir):
    return E.search_documents(*_searched(spark, sf_dir))


def g13_search_index(spark, sf_dir):
    q, d = _searched(spark, sf_dir)
    path = shared_folder(spark)
    I.write_index(d, path)
    return I.search_index(q, d, path)


def g14_read_window(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("doc"), "text")
    r = d.select((F.col("doc") * 2).alias("request_id"), "doc", (F.col("doc") * 13 % 3000 - 100).alias("start"), F.when(F.col("doc") % 3 > 0, F.col("doc") % 4000).alias("max_chars"))
    return E.read_window(r, d)


def g15_resolve_names(spark, sf_dir):
    a = _att(spark, sf_dir)
    wanted = F.when(F.col("id") % 4 == 0, F.col("name")).when(F.col("id") % 4 == 1, F.upper("name")).when(F.col("id") % 4 == 2, F.regexp_replace("name", r"\.[^.]*$", "")).otherwise(F.concat(F.lit("'"), "name", F.lit("'x")))
    return E.resolve_names(a.select(F.col("id").alias("request_id"), "conversation_id", wanted.alias("wanted")), a)


def _requests(spark, sf_dir):
    e = X.trace_events(spark, sf_dir)
    return e.select("turn", F.floor(F.col("seq") / 20).alias("call"), (F.col("prompt_tokens") % 40 + 1).alias("page"), F.when(F.col("seq") % 60 < 40, "q1").otherwise("q2").alias("question"), F.lit(35).alias("total_pages")).distinct()


_LIMITS = dataclasses.replace(E.DEFAULTS, analyze_pages_per_call=5, max_analyzed_pages=8)


def g16_plan_page_analysis(spark, sf_dir):
    return E.plan_page_analysis(_requests(spark, sf_dir), _LIMITS)


def g16_plan_fixed_ranges(spark, sf_dir):
    return E.plan_page_analysis(_requests(spark, sf_dir).filter("call % 2 = 0"), _LIMITS, fixed=True)


def g17_group_pages(spark, sf_dir):
    return E.group_pages(_requests(spark, sf_dir), ["turn", "call"], 3).select("turn", "call", "page", "chunk")


def g18_split_page_answers(spark, sf_dir):
    m = X.messages(spark, sf_dir).select(F.concat_ws("-", "conversation_id", F.col("position").cast("string")).alias("reply"), "content", "position")
    text = F.when(F.col("position") % 2 == 0, F.concat(F.lit("[Page 1]: "), "content", F.lit("\n [ page 2 ] two "), "content")).otherwise(F.concat(F.lit("[page 1] "), "content"))
    return E.split_page_answers(m.select("reply", text.alias("text"), F.array(F.lit(1), F.lit(2)).alias("pages")), "reply")


def g19_collate_answers(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents").select("source", F.col("doc_id").alias("page"), F.when(F.col("doc_id") % 10 < 5, "pages 1-5").otherwise(F.concat(F.lit("page "), F.col("doc_id").cast("string"))).alias("marker"), F.when(F.col("doc_id") % 10 < 5, "same").otherwise(F.col("text")).alias("answer"))
    return E.collate_answers(d, "source")


def g20_viewed_pages(spark, sf_dir):
    e = X.trace_events(spark, sf_dir).select("turn", F.col("seq").alias("n"), F.when(F.col("prompt_tokens") % 25 == 0, "analysis").otherwise("view").alias("kind"), (F.col("prompt_tokens") % 30).alias("page"))
    return E.viewed_pages(e)


def g21_resolve_page_answers(spark, sf_dir):
    m = X.messages(spark, sf_dir)
    n = F.length("content")
    calls = m.select(
        F.concat_ws("-", "conversation_id", F.col("position").cast("string")).alias("call"), F.col("conversation_id").alias("turn"), F.when(n % 6 == 0, "").when(n % 6 == 1, F.concat(F.lit("x</think>"), "content")).otherwise(F.col("content")).alias("text"),
        F.when(n % 4 == 0, "length").otherwise("stop").alias("finish"), F.when(n % 11 == 0, "budget").alias("runaway"), F.when(F.col("conversation_id").endswith("7"), "timeout").alias("error"), (n % 5 == 0).alias("local"), F.lit(False).alias("separated"), F.lit(False).alias("thinking_off"),
    )
    return E.resolve_page_answers(calls, "call", "turn")


_CLIP = "CASE WHEN length({t}) <= {m} THEN {t} ELSE substr({t}, 1, greatest(1, ({m} - 80) // 2)) || chr(10) || chr(10) || '...[truncated ' || (length({t}) - 2 * greatest(1, ({m} - 80) // 2)) || ' chars]...' || chr(10) || chr(10) || right({t}, greatest(1, ({m} - 80) // 2)) END"
_ROOT = "regexp_replace(name, ' · (page [0-9]+|visual OCR)$', '')"
_CAND = f""", u AS (SELECT conversation_id, {_ROOT} AS grp, position::BIGINT AS slot, name, id, false AS pending FROM v_att WHERE kind = 'image' AND send_to_model),
p AS (SELECT conversation_id, name AS root, unnest(range(1, total_pages + 1)) AS pn FROM v_att WHERE kind = 'pdf'),
c AS (SELECT * FROM u UNION ALL SELECT p.conversation_id, p.root, pn + 1000000, coalesce(i.name, p.root || ' · page ' || pn), i.id, i.id IS NULL FROM p LEFT JOIN v_att i ON i.conversation_id = p.conversation_id AND i.kind = 'image' AND i.page_number = pn AND i.name = p.root || ' · page ' || pn)
"""
_REQ = ", q AS (SELECT DISTINCT turn, seq // 20 AS call, prompt_tokens % 40 + 1 AS page, CASE WHEN seq % 60 < 40 THEN 'q1' ELSE 'q2' END AS question FROM v_event)\n"
_PLAN = """, a AS (SELECT *, page > 35 AS b, row_number() OVER (PARTITION BY turn, call, page > 35 ORDER BY page) > 5 AS d FROM q), l AS (SELECT *, NOT b AND NOT d AND row_number() OVER (PARTITION BY turn, page, question, NOT b AND NOT d ORDER BY call) = 1 AS f FROM a),
 u AS (SELECT *, sum(f::INT) OVER (PARTITION BY turn ORDER BY call, page) AS n, coalesce(sum(f::INT) OVER (PARTITION BY turn ORDER BY call RANGE BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS p FROM l),
 k AS (SELECT *, bool_or(f AND n <= 8) OVER (PARTITION BY turn, page, question, NOT b AND NOT d) AS ok FROM u), r AS (SELECT *, p >= 8 AND bool_or(NOT b AND NOT d AND (f OR NOT ok)) OVER (PARTITION BY turn, call) AS c FROM k)
 SELECT turn, call, page, question, CASE WHEN b THEN 'beyond' WHEN d THEN 'deferred' WHEN c OR NOT ok THEN 'refused' WHEN f THEN 'allowed' ELSE 'cached' END AS state, c AS call_refused FROM r"""
ORACLES = {
    "g1_with_root": oracle("v_att", f"SELECT id, {_ROOT} AS root FROM v_att"),
    "g2_attachment_manifest": oracle("v_att", f"""SELECT conversation_id, string_agg('"' || root || '": parts=' || parts || coalesce(', pages=' || pages, '') || ', images=' || images || ', parsedText=' || t || ' chars, visualOcr=' || o || ' chars, pendingVision=' || p, '; ' ORDER BY f) AS manifest
 FROM (SELECT conversation_id, {_ROOT} AS root, min(position) AS f, count(*) AS parts, max(total_pages) AS pages, count(*) FILTER (kind = 'image') AS images, sum(length(text)) AS t, sum(CASE WHEN name LIKE '%visual OCR' THEN length(text) ELSE 0 END) AS o, sum(ocr_required::INT) AS p FROM v_att GROUP BY conversation_id, root) GROUP BY conversation_id"""),
    "g3_clip_text": "SELECT doc_id, " + _CLIP.format(t="text", m="(doc_id % 2000 + 50)") + " AS text FROM documents",
    "g4_coverage_preview": "WITH d AS (SELECT doc_id, text AS t, '[VISUAL SOURCE: a · page 1]' || chr(10) || text || chr(10) || chr(10) || '[VISUAL SOURCE: a · page 2]' || chr(10) || text AS w FROM documents), b AS (SELECT doc_id, w, '[VISUAL SOURCE: a · page 1]' || chr(10) || trim(t, ' ' || chr(10)) AS x, '[VISUAL SOURCE: a · page 2]' || chr(10) || trim(t, ' ' || chr(10)) AS y FROM d) SELECT doc_id, CASE WHEN length(w) <= 1000 THEN w ELSE substr('[COVERAGE PREVIEW: all 2 visual sources are represented; call read_attachment for the complete text.]' || chr(10) || chr(10) || " + _CLIP.format(t="x", m="425") + " || chr(10) || chr(10) || " + _CLIP.format(t="y", m="425") + ", 1, 1000) END AS text FROM b",
    "g6_fair_text_budget": oracle("v_att", ", s AS (SELECT id, text, greatest(1000, 9000 // greatest(1, count(*) FILTER (text <> '') OVER (PARTITION BY conversation_id)))::INT AS share FROM v_att WHERE kind <> 'image') SELECT id, share, " + _CLIP.format(t="text", m="share") + " AS text FROM s"),
    "g21_resolve_page_answers": oracle("v_msg", r""", c AS (SELECT conversation_id || '-' || position AS call, conversation_id AS turn, length(content) AS n, content, CASE WHEN conversation_id LIKE '%7' THEN 'timeout' END AS error FROM v_msg),
 t AS (SELECT *, n % 4 = 0 AS cut, CASE WHEN n % 6 = 0 THEN '' WHEN n % 6 = 1 AND n % 4 <> 0 THEN 'x</think>' || content WHEN n % 6 <> 1 AND n % 4 = 0 AND n % 5 = 0 THEN '' ELSE content END AS x FROM c),
 k AS (SELECT *, trim(regexp_replace(regexp_replace(x, '[ ]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS clean FROM t),
 a AS (SELECT turn, call, CASE WHEN error IS NOT NULL THEN 'ERROR: ' || error WHEN n % 11 = 0 THEN '(not analyzed: the model''s reasoning did not finish and was stopped; the call was not retried)' WHEN cut AND clean <> '' THEN clean || chr(10) || '[cut off at the output limit of 4096 tokens; the rest of this answer is missing]' WHEN cut THEN '(not analyzed: the model reached the output limit of 4096 tokens before answering; the call was not retried)' WHEN clean = '' THEN '(the vision model returned no answer for this page)' ELSE clean END AS answer FROM k)
 SELECT turn, call, answer, bool_and(answer LIKE 'ERROR: %') OVER (PARTITION BY turn) AS all_failed FROM a"""),
    "g5_narrow_by_mention": oracle("v_att", f", p AS (SELECT conversation_id, max(id) AS k, min(name) AS n FROM v_att GROUP BY conversation_id) SELECT id FROM v_att v JOIN p ON v.conversation_id = p.conversation_id WHERE k % 20 >= 10 OR {_ROOT.replace('name', 'v.name')} = {_ROOT.replace('name', 'p.n')}"),
    "g7_answer_image_candidates": oracle("v_att", _CAND + "SELECT * FROM c"),
    "g8_round_robin": oracle("v_att", _CAND + ", r AS (SELECT *, row_number() OVER (PARTITION BY conversation_id, grp ORDER BY slot, name) AS rd, min(slot) OVER (PARTITION BY conversation_id, grp) AS gf, count(*) OVER (PARTITION BY conversation_id) AS candidates FROM c) SELECT conversation_id, name, place, candidates FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY rd, gf, grp) AS place FROM r) WHERE place <= 6"),
    "g9_context_budgets": ("WITH r AS (SELECT event_id, event_id % 4 > 0 AS local, CAST(event_id * 37 % 200000 - 500 AS INT) AS context_tokens FROM events), b AS (SELECT *, greatest(4000, least(200000, floor(CASE WHEN context_tokens > 0 THEN context_tokens ELSE 8192 END * 3.3::DOUBLE * 0.65::DOUBLE)))::INT AS c FROM r) SELECT event_id, local, context_tokens, CASE WHEN local THEN c ELSE 600000 END AS char_budget, CASE WHEN local THEN greatest(6000, floor(c * 0.42::DOUBLE))::INT ELSE 180000 END AS attachment_budget, CASE WHEN local THEN greatest(3500, floor(c * 0.35::DOUBLE))::INT ELSE 300000 END AS history_budget FROM b"),
    "g10_compact_history": oracle("v_msg", ", m AS (SELECT conversation_id, position, role, CASE WHEN role = 'assistant' AND length(content) % 6 = 0 THEN 'Error: ' || content ELSE content END AS content FROM v_msg), n AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY position DESC) AS k FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY position DESC) AS rn FROM m) WHERE rn <= 30 AND NOT (role = 'assistant' AND content LIKE 'Error: %')), h AS (WITH RECURSIVE w AS (SELECT conversation_id, k, position, role, 2500 AS had, " + _CLIP.format(t="content", m="least(2500, 1125)") + " AS content FROM n WHERE k = 1 UNION ALL SELECT n.conversation_id, n.k, n.position, n.role, w.had - length(w.content) - 40, " + _CLIP.format(t="n.content", m="least(w.had - length(w.content) - 40, 1125)") + " FROM w JOIN n ON n.conversation_id = w.conversation_id AND n.k = w.k + 1 WHERE w.had - length(w.content) - 40 > 0) SELECT * FROM w) SELECT conversation_id, position, role, content FROM (SELECT *, min(CASE WHEN role <> 'assistant' THEN position END) OVER (PARTITION BY conversation_id) AS f FROM h) WHERE position >= f"),
    "g11_compact_overflow": oracle("v_msg", ", m AS (SELECT * REPLACE (CASE WHEN position % 4 = 2 THEN 'tool' WHEN position = 0 THEN 'system' ELSE role END AS role) FROM v_msg), s AS (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY position) AS rn FROM m WHERE role = 'system'), t AS (SELECT *, min(CASE WHEN role <> 'tool' THEN position END) OVER (PARTITION BY conversation_id) AS h FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY position DESC) AS rn FROM m WHERE role <> 'system') WHERE rn <= 3) SELECT conversation_id, position, role, " + _CLIP.format(t="content", m="1800") + " AS content, created_at FROM s WHERE rn = 1 UNION ALL SELECT conversation_id, position, role, " + _CLIP.format(t="content", m="(CASE WHEN role = 'tool' THEN 2000 ELSE 1000 END)") + " AS content, created_at FROM t WHERE position >= h"),
    "g12_assemble_prompts": oracle("v_att", ", d AS (SELECT conversation_id, string_agg('[Attachment: ' || name || ']' || chr(10) || text, chr(10) || chr(10) ORDER BY position) FILTER (text <> '') AS b, bool_or(name LIKE '%visual OCR') AS o FROM v_att WHERE kind <> 'image' GROUP BY conversation_id), i AS (SELECT conversation_id, string_agg(position || ': ' || name, '; ' ORDER BY position) AS l, bool_or(page_number IS NOT NULL) AS p FROM v_att WHERE kind = 'image' GROUP BY conversation_id) SELECT d.conversation_id, concat_ws(chr(10) || chr(10), CASE WHEN right(d.conversation_id, 1) = '3' THEN 'Please analyze the attached files.' ELSE 'ask ' || d.conversation_id END, b, CASE WHEN o THEN '" + E.EVIDENCE_NOTE + "' END, CASE WHEN p THEN '[PAGE IMAGES: attached to this message in this order - ' || l || '. They show the drawings, symbols and layout that the extracted text cannot convey.]' END) AS prompt FROM d LEFT JOIN i ON i.conversation_id = d.conversation_id"),
    "g13_search_documents": r""", h AS (SELECT 1), q AS (SELECT item_id AS query_id, lower(trim(text, ' ' || chr(10))) AS needle FROM benchmark), m AS (SELECT query_id, needle, source AS conversation_id, doc_id AS doc, text, string_split(lower(text), needle) AS ps FROM documents JOIN q ON contains(lower(text), needle)),
 o AS (SELECT *, list_sum(list_transform(ps[1:k], lambda x: length(x))) + (k - 1) * length(needle) AS off FROM (SELECT *, unnest(range(1, len(ps))) AS k FROM m)), r AS (SELECT *, row_number() OVER (PARTITION BY query_id, conversation_id ORDER BY doc, off) AS rn FROM o)
 SELECT query_id, conversation_id, doc, CAST(off AS INT) AS offset, trim(regexp_replace(substr(text, CAST(greatest(0, off - 240) + 1 AS BIGINT), CAST(off + length(needle) + 520 - greatest(0, off - 240) AS BIGINT)), '\s+', ' ', 'g')) AS excerpt FROM r WHERE rn <= 12""".replace(", h AS (SELECT 1), q AS", "WITH q AS", 1),
    "g14_read_window": 'SELECT doc * 2 AS request_id, doc, s AS start, least(s + z, length(text)) AS "end", length(text) AS total_characters, s + z < length(text) AS has_more, substr(text, s + 1, z) AS content FROM (SELECT doc_id AS doc, text, CAST(CASE WHEN doc_id * 13 % 3000 - 100 >= 0 THEN least(doc_id * 13 % 3000 - 100, length(text)) ELSE 0 END AS INT) AS s, CAST(CASE WHEN doc_id % 3 > 0 THEN greatest(1000, least(50000, doc_id % 4000)) ELSE 8000 END AS INT) AS z FROM documents)',
    "g15_resolve_names": oracle("v_att", r", r AS (SELECT id AS request_id, conversation_id, CASE id % 4 WHEN 0 THEN name WHEN 1 THEN upper(name) WHEN 2 THEN regexp_replace(name, '\.[^.]*$', '') ELSE '''' || name || '''x' END AS w FROM v_att), x AS (SELECT request_id, trim(w, ' ''') AS w, a.id, CASE WHEN a.name = trim(w, ' ''') THEN 0 WHEN lower(a.name) = lower(trim(w, ' ''')) THEN 1 ELSE 2 END AS k FROM r JOIN v_att a ON a.conversation_id = r.conversation_id AND (lower(a.name) = lower(trim(w, ' ''')) OR lower(regexp_replace(a.name, '\.[^.]*$', '')) = lower(trim(w, ' '''))))," " b AS (SELECT request_id, arg_min(id, k * 1000000 + id) AS id, min(k) AS k, count(DISTINCT CASE WHEN k = 2 THEN id END) AS n FROM x GROUP BY request_id) SELECT r.request_id, CASE WHEN b.k < 2 OR n = 1 THEN b.id END AS id FROM r LEFT JOIN b ON r.request_id = b.request_id"),
    "g16_plan_page_analysis": oracle("v_event", _REQ + _PLAN),
    "g16_plan_fixed_ranges": oracle("v_event", _REQ.replace("q AS", "q0 AS") + """, s AS (SELECT turn, call, any_value(question) AS question, min(page) FILTER (page <= 35) AS f FROM q0 WHERE call % 2 = 0 GROUP BY turn, call),
 q AS (SELECT turn, call, unnest(range(f, 36)) AS page, question FROM s WHERE f IS NOT NULL UNION ALL SELECT q0.turn, q0.call, page, q0.question FROM q0 JOIN s ON s.turn = q0.turn AND s.call = q0.call AND f IS NULL)
""" + _PLAN),
    "g17_group_pages": oracle("v_event", _REQ + "SELECT turn, call, page, (row_number() OVER (PARTITION BY turn, call ORDER BY page) - 1) // 3 AS chunk FROM q"),
    "g18_split_page_answers": oracle("v_msg", ", r AS (SELECT conversation_id || '-' || position AS reply, position % 2 = 0 AS two, content FROM v_msg) SELECT reply, CAST(1 AS INT) AS page, trim(content) AS answer FROM r WHERE two UNION ALL SELECT reply, 2, trim('two ' || content) FROM r WHERE two UNION ALL SELECT reply, NULL, '[page 1] ' || content FROM r WHERE NOT two"),
    "g19_collate_answers": "WITH a AS (SELECT source, doc_id AS page, CASE WHEN doc_id % 10 < 5 THEN 'pages 1-5' ELSE 'page ' || doc_id END AS marker, CASE WHEN doc_id % 10 < 5 THEN 'same' ELSE text END AS answer FROM documents), b AS (SELECT *, lag(marker) OVER w AS pm FROM a WINDOW w AS (PARTITION BY source ORDER BY page)) SELECT source, string_agg('[' || marker || '] ' || answer, chr(10) ORDER BY page) AS text, count(*) AS n FROM b WHERE NOT coalesce(pm = marker AND marker = 'pages 1-5', false) GROUP BY source",
    "g20_viewed_pages": oracle("v_event", ", q AS (SELECT turn, seq AS n, prompt_tokens % 25 = 0 AS an, prompt_tokens % 30 AS page, sum((prompt_tokens % 25 = 0)::INT) OVER (PARTITION BY turn ORDER BY seq) AS e FROM v_event), l AS (SELECT turn, max(e) AS le FROM q GROUP BY turn), f AS (SELECT *, (row_number() OVER (PARTITION BY turn, e, page ORDER BY n) = 1)::INT AS f FROM q WHERE NOT an), u AS (SELECT *, sum(f) OVER (PARTITION BY turn, e ORDER BY n) AS u FROM f), t AS (SELECT *, bool_or(u <= 12) FILTER (f = 1) OVER (PARTITION BY turn, e, page) AS t FROM u) SELECT t.turn, n, page, CASE WHEN NOT t THEN 'refused' WHEN f = 1 THEN 'attached' ELSE 'repeat' END AS state, e < le AND t AND f = 1 AS dropped FROM t JOIN l ON t.turn = l.turn"),
}
ORACLES["g13_search_index"] = ORACLES["g13_search_documents"]
QUERIES = {k: v for k, v in dict(globals()).items() if k[:1] == "g" and k[1:2].isdigit()}

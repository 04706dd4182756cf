"""Registered queries of transcription post-processing."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsheaf import fixtures as X
from docsheaf.fixtures import oracle
from docsheaf.operators import transcripts as T


def _docs(spark, sf_dir):
    return X.table(spark, sf_dir, "documents").select("doc_id", "text", "source")


def _replies(spark, sf_dir):
    """Messages as replies: every fifth refuses, every third thinks aloud."""
    m = X.messages(spark, sf_dir).select(F.concat_ws("-", "conversation_id", F.col("position").cast("string")).alias("reply"), "conversation_id", "position", "content")
    k = F.length("content") % 15
    text = (
        F.when(k % 5 == 0, F.concat(F.lit("Sorry, "), "content")).when(k == 1, "").when(k == 3, F.concat(F.lit("<think>why\nnot</think>\n"), "content"))
        .when(k == 6, F.concat(F.lit("thoughts</think> "), "content")).when(k == 9, F.concat("content", F.lit(" <think>open"))).when(k == 2, "[NO TEXT]").otherwise(F.col("content"))
    )
    return m.withColumn("text", text)


def e1_filter_transcripts(spark, sf_dir):
    return T.filter_transcripts(_replies(spark, sf_dir)).select("reply")


def e2_strip_reasoning(spark, sf_dir):
    return T.strip_reasoning(_replies(spark, sf_dir)).select("reply", "text")


def e3_clean_transcripts(spark, sf_dir):
    d = _docs(spark, sf_dir)
    loop = F.when(F.col("doc_id") % 4 == 0, F.concat("text", F.repeat(F.lit("\n[UNCLEAR]\n"), (F.col("doc_id") % 5).cast("int")))).when(F.col("doc_id") % 4 == 1, F.concat(F.repeat(F.lit("  row x\n"), (F.col("doc_id") % 30).cast("int")), "text", F.lit("<bos>"))).otherwise(F.col("text"))
    return T.clean_transcripts(d.withColumn("text", loop), "doc_id")


def e4_salvage_cutoff(spark, sf_dir):
    calls = _replies(spark, sf_dir).select("reply", "text", F.when(F.col("position") % 2 == 0, "length").otherwise("stop").alias("finish"), (F.col("position") % 3 == 0).alias("local"), (F.col("position") % 4 == 0).alias("separated"), F.lit(False).alias("thinking_off"))
    return T.salvage_cutoff(calls, "reply")


def _attempts(spark, sf_dir):
    n = F.length("content")
    return _replies(spark, sf_dir).select(
        F.col("conversation_id").alias("image"), (F.col("position") + 1).alias("attempt"), F.col("text").alias("clean"), F.when(n % 4 == 0, F.col("content")).otherwise("").alias("partial"),
        F.when(n % 7 == 0, "length").otherwise("stop").alias("finish"), F.when(n % 11 == 0, "budget: 4000").alias("runaway"), (n % 2 == 0).alias("tile"), F.when(n % 13 == 0, "timeout").alias("error"),
    )


def e5_resolve_attempts(spark, sf_dir):
    return T.resolve_attempts(_attempts(spark, sf_dir), "image")


def _tiles(spark, sf_dir):
    d = _docs(spark, sf_dir)
    r, c = F.floor(F.col("doc_id") % 4 / 2).cast("int"), (F.col("doc_id") % 2).cast("int")
    status = F.when(F.col("doc_id") % 11 == 0, "failed").when(F.col("doc_id") % 7 == 0, "empty").otherwise("ok")
    return d.select(
        F.floor(F.col("doc_id") / 4).cast("long").alias("page"), (r + 1).alias("row"), (c + 1).alias("col"), (c * 0.4).alias("x0"), (r * 0.4).alias("y0"), (c * 0.4 + 0.6).alias("x1"), (r * 0.4 + 0.6).alias("y1"),
        F.when(status == "failed", "[OCR FAILED AFTER 3 ATTEMPTS: x]").when(status == "empty", "").otherwise(F.concat(F.lit("GENERAL NOTES\n"), "text")).alias("text"), status.alias("status"),
    )


def e6_drop_overlap_lines(spark, sf_dir):
    return T.drop_overlap_lines(_tiles(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("x0", "y0", "x1", "y1")})


def _grid(df):
    return df.withColumns({"grid_rows": F.lit(2), "grid_cols": F.lit(2), "blank": (F.col("page") % 3).cast("int")})


def e7_merge_tile_transcripts(spark, sf_dir):
    return T.merge_tile_transcripts(_grid(_tiles(spark, sf_dir)))


def e8_variant_label(spark, sf_dir):
    e = X.trace_events(spark, sf_dir).select(F.when(F.col("prompt_tokens") % 2 == 0, "tile").otherwise("whole").alias("mode"), (F.col("prompt_tokens") % 3 == 0).alias("thinking"), (F.col("prompt_tokens") % 4 * 1000).alias("budget"), F.when(F.col("prompt_tokens") % 5 == 0, "low").otherwise("").alias("effort"))
    return T.variant_label(e.distinct())


def _keyed(spark, sf_dir):
    key = T.content_key(F.col("lang"), F.lit("text/plain"), F.lit(""), F.col("text").cast("binary"))
    return X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("page_id"), key.alias("content_key"), "text")


def e9_transcription_plan(spark, sf_dir):
    pages = _keyed(spark, sf_dir)
    cache = pages.filter("page_id % 10 = 0").groupBy("content_key").agg(F.min("page_id").alias("p")).select("content_key", F.when(F.col("p") % 20 == 0, F.concat(F.lit("read "), F.col("p").cast("string"))).otherwise("[ocr failed: x]").alias("text"))
    return T.transcription_plan(pages.select("page_id", "content_key"), cache).drop("content_key")


def e10_trim_cache(spark, sf_dir):
    used = X.table(spark, sf_dir, "documents").select(F.col("doc_id").alias("content_key"), "source", (F.col("n_chars") * 7919 % 10007).alias("last_used"))
    return T.trim_cache(used, 16, ("source",))


def e11_pending_pages(spark, sf_dir):
    cite = F.when(F.col("name").endswith(" · visual OCR") & (F.col("id") % 2 == 0), F.concat(F.lit("[VISUAL SOURCE: "), F.replace("name", F.lit(" · visual OCR"), F.lit(" · page 3")), F.lit("]\n"), "text")).otherwise(F.col("text"))
    return T.pending_pages(X.attachments(spark, sf_dir).withColumn("text", cite), "tile").select("id", "read_as")


def e12_assemble_visual_evidence(spark, sf_dir):
    a = X.attachments(spark, sf_dir).filter("kind <> 'image'").select("conversation_id", F.concat(F.split("name", r"\.")[0], F.lit(".pdf · page "), (F.col("position") + 1).cast("string")).alias("name"), F.when(F.col("id") % 3 == 0, "unknown").alias("classification"), "text", F.col("position").alias("n"))
    return T.assemble_visual_evidence(a, ["conversation_id"])


def e13_content_lines(spark, sf_dir):
    return T.content_lines(T.merge_tile_transcripts(_grid(_tiles(spark, sf_dir))), ["page"])


def e14_expectation_report(spark, sf_dir):
    return T.expectation_report(_docs(spark, sf_dir).select("doc_id", "text"), X.table(spark, sf_dir, "benchmark").select(F.col("text").alias("item")), "doc_id")


def e14_unrelated_lines(spark, sf_dir):
    m = X.messages(spark, sf_dir).select(F.concat_ws("-", "conversation_id", F.col("position").cast("string")).alias("reply"), F.col("content").alias("text"))
    return T.unrelated_lines(m, X.table(spark, sf_dir, "benchmark").select(F.col("text").alias("item")), "reply")


def e15_mode_line_diff(spark, sf_dir):
    lines = X.lines(spark, sf_dir)
    return T.mode_line_diff(lines.filter("doc_id % 2 = 0").selectExpr("floor(doc_id / 2) AS pair", "line"), lines.filter("doc_id % 2 = 1").selectExpr("floor(doc_id / 2) AS pair", "line"), ["pair", "line"])


_Q = lambda s: s.replace("'", "''")
_REPLIES = """, rp AS (SELECT conversation_id || '-' || position AS reply, conversation_id, position, content, CASE WHEN k % 5 = 0 THEN 'Sorry, ' || content WHEN k = 1 THEN '' WHEN k = 3 THEN '<think>why' || chr(10) || 'not</think>' || chr(10) || content
 WHEN k = 6 THEN 'thoughts</think> ' || content WHEN k = 9 THEN content || ' <think>open' WHEN k = 2 THEN '[NO TEXT]' ELSE content END AS text FROM (SELECT *, length(content) % 15 AS k FROM v_msg))
"""
_USABLE = "(trim({0}, ' ' || chr(10)) <> '' AND NOT regexp_matches({0}, '" + _Q(T.NOT_A_TRANSCRIPTION) + "'))"
_TILES = """, tl AS (SELECT doc_id // 4 AS page, CAST(doc_id % 4 // 2 + 1 AS INT) AS row, CAST(doc_id % 2 + 1 AS INT) AS col, CASE WHEN doc_id % 11 = 0 THEN 'failed' WHEN doc_id % 7 = 0 THEN 'empty' ELSE 'ok' END AS status,
 CASE WHEN doc_id % 11 = 0 THEN '[OCR FAILED AFTER 3 ATTEMPTS: x]' WHEN doc_id % 7 = 0 THEN '' ELSE 'GENERAL NOTES' || chr(10) || text END AS text FROM documents),
mg AS (SELECT page, CASE WHEN o = 0 AND f > 0 THEN ff ELSE '[TILED TRANSCRIPTION: this page was read as 2 rows x 2 columns of overlapping tiles, listed left to right and top to bottom. ' || o || ' tiles contain text, ' || (n - o - f + page % 3) || ' contain none' || CASE WHEN f > 0 THEN ', ' || f || ' could not be read' ELSE '' END || '. Text lying on a tile border may be cut off or appear in two tiles.]' || coalesce(chr(10) || body, '') END AS text
 FROM (SELECT page, count(*) FILTER (status = 'ok') AS o, count(*) FILTER (status = 'failed') AS f, count(*) AS n, arg_min(text, row * 10 + col) FILTER (status = 'failed') AS ff,
  string_agg('[TILE r' || row || 'c' || col || ']' || chr(10) || text, chr(10) ORDER BY row, col) FILTER (status <> 'empty') AS body FROM tl GROUP BY page))
"""
_LINES = "(SELECT page, CAST(i - 1 AS INT) AS line_no, trim(ls[i], ' ' || chr(9)) AS line FROM (SELECT page, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT page, string_split(text, chr(10)) AS ls FROM mg)))"
ORACLES = {
    "e1_filter_transcripts": oracle("v_msg", _REPLIES + "SELECT reply FROM rp WHERE " + _USABLE.format("text")),
    "e2_strip_reasoning": oracle("v_msg", _REPLIES + r"SELECT reply, trim(regexp_replace(regexp_replace(regexp_replace(text, '(?is)<think\b[^>]*>.*?</think>', '', 'g'), '(?is)^.*</think\s*>', ''), '(?is)<think\b.*$', ''), ' ' || chr(10)) AS text FROM rp"),
    "e3_clean_transcripts": r"""WITH t AS (SELECT doc_id, replace(CASE doc_id % 4 WHEN 0 THEN text || repeat(chr(10) || '[UNCLEAR]' || chr(10), doc_id % 5) WHEN 1 THEN repeat('  row x' || chr(10), doc_id % 30) || text ELSE text END, chr(13), '') AS x FROM documents),
 l AS (SELECT doc_id, i AS n, ls[i] AS line, trim(ls[i], ' ' || chr(9)) AS k FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(x, chr(10)) AS ls FROM t))),
 f AS (SELECT *, CASE WHEN k <> '' AND k IS DISTINCT FROM lag(k) OVER (PARTITION BY doc_id, k <> '' ORDER BY n) THEN 1 ELSE 0 END AS new FROM l),
 r AS (SELECT *, sum(new) OVER (PARTITION BY doc_id ORDER BY n) AS run FROM f),
 s AS (SELECT *, count(*) FILTER (k <> '') OVER (PARTITION BY doc_id, run) AS size, min(n) FILTER (k <> '') OVER (PARTITION BY doc_id, run) AS head, max(n) FILTER (k <> '') OVER (PARTITION BY doc_id, run) AS tail, max(k) OVER (PARTITION BY doc_id, run) AS rk FROM r),
 o AS (SELECT doc_id, n, CASE WHEN head IS NULL OR n > tail OR NOT (upper(rk) = '[UNCLEAR]' AND size > 1 OR size > 12) THEN rtrim(line) WHEN n = head AND upper(rk) = '[UNCLEAR]' THEN rtrim(line)
  WHEN n = head THEN rtrim(line) || chr(10) || rtrim(line) || chr(10) || rtrim(line) || chr(10) || '[REPEATED LINE OMITTED x' || (size - 3) || ': likely a model repetition loop]' END AS line FROM s)
 SELECT doc_id, trim(regexp_replace(string_agg(line, chr(10) ORDER BY n), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS text FROM o WHERE line IS NOT NULL GROUP BY doc_id""",
    "e4_salvage_cutoff": oracle("v_msg", _REPLIES + r""", a AS (SELECT reply, CASE WHEN contains(text, '</think>') THEN regexp_replace(text, '(?s)^.*</think>', '') WHEN contains(text, '<think') OR position % 3 = 0 AND position % 4 <> 0 THEN '' ELSE text END AS t FROM rp WHERE position % 2 = 0),
 c AS (SELECT reply, trim(regexp_replace(regexp_replace(t, '[ \t]+(\n|$)', '\1', 'g'), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS x FROM a) SELECT reply, CASE WHEN """ + _USABLE.format("x") + " THEN x ELSE '' END AS text FROM c"),
    "e5_resolve_attempts": oracle("v_msg", _REPLIES + ", a AS (SELECT conversation_id AS image, position + 1 AS attempt, text AS clean, CASE WHEN length(content) % 4 = 0 THEN content ELSE '' END AS partial, length(content) AS n FROM rp WHERE position < 3), d AS (SELECT *, CASE WHEN n % 13 = 0 THEN NULL WHEN n % 11 = 0 THEN 'failed' WHEN n % 7 = 0 AND partial <> '' THEN 'ok' WHEN n % 7 = 0 THEN 'failed' WHEN n % 2 = 0 AND regexp_matches(clean, '" + T.NO_TEXT + "') THEN 'empty' WHEN " + _USABLE.format("clean") + " THEN 'ok' END AS status FROM a), t AS (SELECT *, CASE WHEN n % 11 = 0 THEN '[OCR FAILED: the model''s reasoning did not finish (budget) and was stopped before producing a transcription. Not retried.]' WHEN n % 7 = 0 AND partial <> '' THEN partial || chr(10) || '[TRANSCRIPTION INCOMPLETE: the model reached the output limit of 4096 tokens here. Text after this point was not transcribed.]' WHEN n % 7 = 0 THEN '[OCR FAILED: the model reached the output limit of 4096 tokens without producing a transcription. Not retried.]' WHEN status = 'empty' THEN '' ELSE clean END AS result FROM d) SELECT image, coalesce(arg_min(status, attempt) FILTER (status IS NOT NULL), 'failed') AS status, CASE WHEN count(status) = 0 THEN '[OCR FAILED AFTER 3 ATTEMPTS: ' || arg_max(CASE WHEN n % 13 = 0 THEN 'timeout' ELSE 'empty or non-transcription OCR response' END, attempt) || ']' ELSE arg_min(result, attempt) FILTER (status IS NOT NULL) END AS text FROM t GROUP BY image"),
    "e6_drop_overlap_lines": "WITH x AS (SELECT 1)" + _TILES + r""", ln AS (SELECT page, row, col, i, ls[i] AS line, trim(regexp_replace(ls[i], '\s+', ' ', 'g')) AS k FROM (SELECT *, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT *, string_split(text, chr(10)) AS ls FROM tl WHERE status = 'ok'))),
 n AS (SELECT page, row, col, k FROM ln WHERE length(replace(k, ' ', '')) >= 6 AND regexp_matches(k, '\p{L}') AND NOT regexp_full_match(k, '\[.*\]') GROUP BY ALL HAVING count(*) = 1),
 gone AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY page, k ORDER BY row, col) AS rn FROM n) WHERE rn > 1),
 new AS (SELECT ln.page, ln.row, ln.col, trim(regexp_replace(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (gone.k IS NULL), ''), '\n{3,}', chr(10) || chr(10), 'g'), chr(10)) AS text FROM ln LEFT JOIN gone ON gone.page = ln.page AND gone.row = ln.row AND gone.col = ln.col AND gone.k = ln.k GROUP BY ALL)
 SELECT tl.page, tl.row, tl.col, round((tl.col - 1) * 0.4, 6) AS x0, round((tl.row - 1) * 0.4, 6) AS y0, round((tl.col - 1) * 0.4 + 0.6, 6) AS x1, round((tl.row - 1) * 0.4 + 0.6, 6) AS y1, coalesce(new.text, tl.text) AS text, status FROM tl LEFT JOIN new ON new.page = tl.page AND new.row = tl.row AND new.col = tl.col""",
    "e7_merge_tile_transcripts": "WITH x AS (SELECT 1)" + _TILES + "SELECT * FROM mg",
    "e8_variant_label": oracle("v_event", "SELECT DISTINCT mode, thinking, budget, effort, CASE WHEN mode = 'tile' THEN 'tile:1536:0.125:200:2048:48:2e-05:24:6' ELSE 'whole' END || CASE WHEN thinking THEN '+thinking' || CASE WHEN budget > 0 THEN ':b' || budget ELSE '' END || CASE WHEN effort <> '' THEN ':e' || effort ELSE '' END ELSE '' END AS variant FROM (SELECT CASE WHEN prompt_tokens % 2 = 0 THEN 'tile' ELSE 'whole' END AS mode, prompt_tokens % 3 = 0 AS thinking, prompt_tokens % 4 * 1000 AS budget, CASE WHEN prompt_tokens % 5 = 0 THEN 'low' ELSE '' END AS effort FROM v_event)"),
    "e9_transcription_plan": "WITH k AS (SELECT doc_id AS page_id, lang || chr(1) || text AS c FROM documents), h AS (SELECT c, min(page_id) AS p FROM k WHERE page_id % 10 = 0 GROUP BY c), f AS (SELECT c, min(page_id) AS first FROM k GROUP BY c) SELECT page_id, coalesce(p % 20 = 0, false) AS hit, CASE WHEN p % 20 = 0 THEN 'read ' || p END AS text, NOT coalesce(p % 20 = 0, false) AND page_id = first AS to_read FROM k LEFT JOIN h ON k.c = h.c JOIN f ON k.c = f.c",
    "e10_trim_cache": "SELECT content_key, source, last_used FROM (SELECT *, row_number() OVER (PARTITION BY source ORDER BY last_used DESC, content_key) AS rn FROM (SELECT doc_id AS content_key, source, n_chars * 7919 % 10007 AS last_used FROM documents)) WHERE rn <= 16",
    "e11_pending_pages": oracle("v_att", "SELECT i.id, coalesce(i.ocr_variant, CASE WHEN i.page_number = 3 AND e.id % 2 = 0 THEN 'whole' END) AS read_as FROM v_att i LEFT JOIN v_att e ON e.conversation_id = i.conversation_id AND e.name = regexp_replace(i.name, ' · page [0-9]+', '') || ' · visual OCR' WHERE i.kind = 'image' AND (i.ocr_required OR coalesce(i.ocr_variant, CASE WHEN i.page_number = 3 AND e.id % 2 = 0 THEN 'whole' END) <> 'tile')"),
    "e12_assemble_visual_evidence": oracle("v_att", "SELECT conversation_id, name, text, strlen(text) AS size FROM (SELECT conversation_id, r || ' · visual OCR' AS name, string_agg('[VISUAL SOURCE: ' || r || ' · page ' || (position + 1) || ']' || chr(10) || CASE WHEN id % 3 = 0 THEN '[CLASSIFICATION: unknown]' || chr(10) ELSE '' END || text, chr(10) || chr(10) ORDER BY position) AS text FROM (SELECT *, string_split(name, '.')[1] || '.pdf' AS r FROM v_att WHERE kind <> 'image') GROUP BY conversation_id, r)"),
    "e13_content_lines": "WITH x AS (SELECT 1)" + _TILES + "SELECT * FROM " + _LINES + " WHERE line <> '' AND NOT regexp_matches(line, '" + T.MARKER_LINE + "')",
    "e14_expectation_report": r"WITH t AS (SELECT doc_id, text, lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS hay FROM documents), b AS (SELECT lower(trim(regexp_replace(text, '\s+', ' ', 'g'))) AS target FROM benchmark), f AS (SELECT doc_id, count(*) AS found FROM t JOIN b ON contains(hay, target) GROUP BY doc_id), l AS (SELECT doc_id, lower(trim(regexp_replace(x, '\s+', ' ', 'g'))) AS k, trim(x) AS line FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM documents)), g AS (SELECT doc_id, count(*) AS lines, sum(CASE WHEN EXISTS (SELECT 1 FROM b WHERE contains(k, target)) THEN 1 ELSE 0 END) AS exact FROM l WHERE line <> '' AND NOT regexp_matches(line, '" + T.MARKER_LINE + r"') GROUP BY doc_id) SELECT t.doc_id, coalesce(found, 0) AS found, coalesce(lines, 0) AS lines, CAST(coalesce(exact, 0) AS BIGINT) AS exact, (SELECT count(*) FROM b) AS expected FROM t LEFT JOIN f ON t.doc_id = f.doc_id LEFT JOIN g ON t.doc_id = g.doc_id",
    "e15_mode_line_diff": oracle("v_line", ", a AS (SELECT doc_id // 2 AS pair, line FROM v_line WHERE doc_id % 2 = 0), b AS (SELECT doc_id // 2 AS pair, line FROM v_line WHERE doc_id % 2 = 1) SELECT *, 'a' AS side FROM (SELECT * FROM a EXCEPT ALL SELECT * FROM b) UNION ALL SELECT *, 'b' AS side FROM (SELECT * FROM b EXCEPT ALL SELECT * FROM a)"),
}
QUERIES = {k: v for k, v in dict(globals()).items() if k[:1] == "e" and k[1:2].isdigit()}

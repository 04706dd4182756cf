"""Registered queries of the store."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsheaf import fixtures as X
from docsheaf.fixtures import oracle
from docsheaf.operators import store as S
from docsheaf.session import shared_folder

_STAMP = 1_800_000_000_000


def _stored(spark, sf_dir):
    """The four tables of a store with JSON columns, one value in three of them broken or of the wrong kind, read again."""
    path = shared_folder(spark)
    m = X.messages(spark, sf_dir)
    files = F.when(F.col("position") % 3 == 0, F.concat(F.lit('[{"name":"f'), F.col("position").cast("string"), F.lit('","kind":"pdf","size":3}]'))).when(F.col("position") % 3 == 1, "{broken").otherwise("[]")
    meta = F.when(F.length("content") % 3 == 0, F.format_string('{"imageMode":"tile","elapsedMs":%d}', F.length("content"))).when(F.length("content") % 3 == 1, "[]").otherwise("{}")
    m.withColumns({"files_json": files, "artifacts_json": F.lit(None).cast("string"), "meta_json": meta}).write.parquet(f"{path}/messages")
    X.conversations(spark, sf_dir).write.parquet(f"{path}/conversations")
    a, page = X.attachments(spark, sf_dir), F.format_string('{"page":%d,"classification":"vector","chars":3,"raster":1,"rasterArea":0.5,"vector":2,"vlm":true}', F.col("position"))
    told = F.concat(F.format_string('{"width":%d,"height":4,"pageNumber":%s,"totalPages":%s,"ocrRequired":%s,"ocrVariant":"whole","pageAnalysis":[', F.col("id"), F.coalesce(F.col("page_number").cast("string"), F.lit("null")), F.coalesce(F.col("total_pages").cast("string"), F.lit("0")), F.col("ocr_required").cast("string")), page, F.lit(',7,{"page":"x"}],"other":1}'))
    a.select("id", "conversation_id", "position", "name", "mime", "kind", "size", F.col("text").alias("text_content"), F.lit(None).cast("binary").alias("data"), F.when(F.col("id") % 3 < 2, told).otherwise("oops").alias("metadata_json"), F.lit(None).cast("string").alias("file_path"), F.lit(None).cast("string").alias("source_path")).write.parquet(f"{path}/attachments")
    e = X.trace_events(spark, sf_dir).select("turn", "seq", F.struct(F.col("seq").cast("string").alias("id"), "kind", "label", "status", F.col("started_ms").alias("startedMs"), F.col("elapsed_ms").alias("elapsedMs"), F.col("parent").cast("string").alias("parent"), F.struct("prompt_tokens").alias("data")).alias("e"))
    document = F.to_json(F.struct(F.transform(F.sort_array(F.collect_list(F.struct("seq", "e"))), lambda x: x["e"]).alias("events")))
    turn = F.col("turn").cast("string").alias("id")
    e.groupBy("turn").agg(document.alias("events_json")).select(turn, turn.alias("conversation_id"), F.lit(1).cast("long").alias("created_at"), F.lit(2).cast("long").alias("updated_at"), F.lit("done").alias("status"), F.when(F.col("turn") % 3 < 2, F.col("events_json")).otherwise("[1]").alias("events_json")).write.parquet(f"{path}/traces")
    return S.load_store(spark, path)


def a4_load_store(spark, sf_dir):
    out = _stored(spark, sf_dir)["messages"]
    return out.select("conversation_id", "position", F.size("files").alias("n_files"), F.size("artifacts").alias("n_artifacts"), F.get("files", F.lit(0))["name"].alias("first"), "meta.imageMode", "meta.elapsedMs")


def a4_load_attachments(spark, sf_dir):
    a = _stored(spark, sf_dir)["attachments"]
    return a.select("id", "name", "width", "height", "source_width", "page_number", "total_pages", "visual_pages", "ocr_required", "send_to_model", "ocr_variant", F.to_json("page_analysis").alias("page_analysis"))


def a4_load_traces(spark, sf_dir):
    t = _stored(spark, sf_dir)["traces"].select("id", F.size("events").alias("events"), F.explode_outer("events").alias("e"))
    return t.select("id", "events", F.col("e.id").alias("event"), "e.kind", "e.startedMs", "e.elapsedMs", "e.parent", F.try_variant_get(F.col("e.data"), "$.prompt_tokens", "long").alias("prompt_tokens"))


def a4_rejected_json(spark, sf_dir):
    return _stored(spark, sf_dir)["rejected"].groupBy("table", "column").agg(F.count(F.lit(1)).alias("n"), F.min("row").alias("first"))


def a5_evolve_schema(spark, sf_dir):
    target = X.messages(spark, sf_dir).withColumn("meta_json", F.lit("{}"))
    return S.evolve_schema(X.messages(spark, sf_dir).drop("created_at"), target, {"meta_json": "{}", "created_at": 0})


def _incoming(spark, sf_dir):
    c = X.conversations(spark, sf_dir)
    n = F.col("created_at") % 6
    known = c.filter(n < 3).select("id", F.when(n == 0, " New  title ").alias("title"), F.lit("derived").alias("derived"), F.lit("local").alias("provider"), F.lit("m2").alias("model"), F.lit(_STAMP).alias("stamp"))
    new = c.filter(n == 5).select(F.concat(F.lit("new-"), "id").alias("id"), F.lit(None).cast("string").alias("title"), F.lit("  ").alias("derived"), F.lit("local").alias("provider"), F.lit("m2").alias("model"), F.lit(_STAMP).alias("stamp"))
    return known.unionByName(new)


def b1_upsert_conversations(spark, sf_dir):
    current = X.conversations(spark, sf_dir).withColumn("title", F.when(F.col("created_at") % 2 == 0, S.DEFAULT_TITLE).otherwise(F.col("title")))
    return S.upsert_conversations(current, _incoming(spark, sf_dir))


def b2_replace_messages(spark, sf_dir):
    m = X.messages(spark, sf_dir)
    return S.replace_messages(m, m.filter("created_at % 5 = 0").withColumn("content", F.upper("role")))


def _uploads(spark, sf_dir):
    return X.attachments(spark, sf_dir).filter("id % 4 < 2").withColumns({"id": F.col("id") + 1_000_000, "text": F.lit("new"), "name": F.when(F.col("id") % 4 == 0, F.concat(F.lit("x"), "name")).otherwise(F.col("name"))})


def b3_upsert_attachments(spark, sf_dir):
    return S.upsert_attachments(X.attachments(spark, sf_dir), _uploads(spark, sf_dir)).select("id", "conversation_id", "position", "name", "text")


def b4_replace_reuploads(spark, sf_dir):
    a = X.attachments(spark, sf_dir)
    merged, removed = S.replace_reuploads(a, a.filter("id % 20 = 0").withColumn("id", F.col("id") + 1_000_000))
    return merged.select("id", "name", F.lit(False).alias("removed")).unionByName(removed.select("id", "name", F.lit(True).alias("removed")))


def b5_delete_conversations(spark, sf_dir):
    c, m, a = X.conversations(spark, sf_dir), X.messages(spark, sf_dir), X.attachments(spark, sf_dir)
    ids = c.filter("created_at % 3 = 0").select("id").unionByName(c.filter("created_at % 3 = 1").select(F.lit("bad id!").alias("id")))
    left = S.delete_conversations({"conversations": (c, "id"), "messages": (m, "conversation_id"), "attachments": (a, "conversation_id")}, ids)
    n = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in left.items()]
    return n[0].unionByName(n[1]).unionByName(n[2]).unionByName(S.deleted_count(c, ids).select(F.lit("deleted").alias("what"), F.col("deleted").alias("n")))


def b5_delete_all(spark, sf_dir):
    c, m, a = X.conversations(spark, sf_dir), X.messages(spark, sf_dir), X.attachments(spark, sf_dir)
    left, deleted = S.delete_all({"conversations": c, "messages": m, "attachments": a})
    rows = [df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("what"), "n") for name, df in left.items()]
    return rows[0].unionByName(rows[1]).unionByName(rows[2]).unionByName(deleted.select(F.lit("deleted").alias("what"), F.col("deleted").alias("n")))


def b5_delete_attachments(spark, sf_dir):
    a = X.attachments(spark, sf_dir)
    gone = a.filter("id % 4 = 0").select("id", F.when(F.col("id") % 8 == 0, F.col("conversation_id")).otherwise("another-conversation").alias("conversation_id"))
    return S.delete_attachments(a, gone.unionByName(gone)).select("conversation_id", "id", "name")


def b6_session_list(spark, sf_dir):
    return S.session_list(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), X.attachments(spark, sf_dir), 200)


def b7_session_detail(spark, sf_dir):
    d = S.session_detail(X.conversations(spark, sf_dir), X.messages(spark, sf_dir), X.attachments(spark, sf_dir))
    return d.select("id", "title", F.array_join(F.transform("messages", lambda m: F.concat(m["role"], F.lit(":"), m["content"])), "|").alias("messages"), F.coalesce(F.array_join(F.transform("attachments", lambda a: F.concat_ws(":", a["name"], a["kind"], a["parsed_characters"].cast("string"), a["page_number"].cast("string"), a["url"])), "|"), F.lit("")).alias("attachments"))


def b8_attachment_listing(spark, sf_dir):
    return S.public_attachments(X.attachments(spark, sf_dir))


def b9_trace_listing(spark, sf_dir):
    return S.trace_listing(X.messages(spark, sf_dir).select(F.concat_ws("-", "conversation_id", F.col("position").cast("string")).alias("id"), "conversation_id", (F.col("created_at") - F.col("created_at") % 4).alias("created_at")))


def b10_sanitize_messages(spark, sf_dir):
    m = X.messages(spark, sf_dir).withColumns({"meta": F.lit('{"a":1}'), "created_at": F.when(F.col("position") % 4 == 0, -1).otherwise(F.col("created_at")), "content": F.when(F.col("position") % 5 == 3, None).otherwise(F.col("content"))})
    return S.sanitize_messages(m, F.lit(_STAMP), 6, 40)


def _json(spark, sf_dir):
    return X.messages(spark, sf_dir).select("conversation_id", "position", F.length("content").alias("n"))


def b11_sanitize_artifacts(spark, sf_dir):
    box = F.format_string('{"x":%d,"y":1,"w":2%s,"label":" a  b ","confidence":%d}', F.col("n") % 9, F.when(F.col("n") % 2 == 0, ',"h":3').otherwise(""), F.col("n") % 5 - 1)
    raw = F.concat(F.lit('[{"name":"","view":"image","boxes":['), box, F.lit(","), box, F.lit("]}]"))
    out = _json(spark, sf_dir).withColumn("a", S.sanitize_artifacts(F.when(F.col("n") % 7 == 0, "oops").otherwise(raw)))
    first = F.get("a", F.lit(0))
    return out.select("conversation_id", "position", F.size("a").alias("artifacts"), first["name"].alias("name"), first["mime"].alias("mime"), F.when(first["boxes"].isNotNull(), F.size(first["boxes"])).alias("boxes"), first["boxes"][0]["label"].alias("label"), first["boxes"][0]["confidence"].alias("confidence"))


def b12_sanitize_files(spark, sf_dir):
    raw = F.concat(F.lit("["), F.array_join(F.transform(F.sequence(F.lit(1), F.col("n") % 30 + 1), lambda i: F.concat(F.lit('{"name":"f'), i.cast("string"), F.lit('","size":'), (i - 3).cast("string"), F.lit("}"))), ","), F.lit("]"))
    out = _json(spark, sf_dir).withColumn("f", S.sanitize_files(raw))
    return out.select("conversation_id", "position", F.size("f").alias("files"), F.aggregate("f", F.lit(0).cast("long"), lambda t, x: t + x["size"]).alias("bytes"), F.get("f", F.lit(0))["kind"].alias("kind"))


def b13_sanitize_meta(spark, sf_dir):
    n = F.col("n")
    raw = F.format_string(
        '{"tiling":{"tileSize":%d,"overlap":-2},"imageMode":"%s","elapsedMs":%d,"vision":{%s},"reasoning":{"repeatLines":8,"repeatCount":3%s,"budget":{"answer":1,"grounding":2,"ocr":3}},"viewedPages":{"limit":12,"refused":%d,"names":["a","b"]}}',
        n, F.when(n % 3 == 0, "tile").otherwise("odd"), n - 100, F.when(n % 4 == 0, '"ocrCalls":2').otherwise(""), F.when(n % 2 == 0, ',"repeatMinChars":24').otherwise(""), n % 5,
    )
    out = _json(spark, sf_dir).withColumn("m", S.sanitize_meta(raw))
    return out.select("conversation_id", "position", "m.tiling.tileSize", "m.tiling.overlap", "m.imageMode", "m.elapsedMs", "m.vision.ocrCalls", F.col("m.reasoning.budget.ocr").alias("budget"), F.col("m.viewedPages.refused").alias("refused"), F.size("m.viewedPages.names").alias("names"))


def b14_derive_titles(spark, sf_dir):
    return S.derive_titles(X.messages(spark, sf_dir))


def b15_monotone_stamps(spark, sf_dir):
    e = X.trace_events(spark, sf_dir).select("turn", "seq", (F.col("prompt_tokens") + F.floor(F.col("seq") / 3)).alias("ts"))
    return S.monotone_stamps(e, ["turn"], "seq")


def b16_valid_ids(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    return S.valid_ids(d.select(F.when(F.col("doc_id") % 3 == 0, F.concat(F.lit("id-"), F.col("doc_id").cast("string"))).when(F.col("doc_id") % 3 == 1, F.concat(F.lit("conversation-"), F.col("doc_id").cast("string"))).otherwise(F.concat(F.lit("bad id "), F.col("doc_id").cast("string"))).alias("id")))


def b17_link_uploaded_files(spark, sf_dir):
    a = X.attachments(spark, sf_dir).filter("kind <> 'document'").withColumn("n", F.col("position"))
    m = a.groupBy("conversation_id").agg(F.lit(0).alias("position"), F.array(F.struct(F.min("name").alias("name"), F.lit("?").alias("kind"), F.lit(1).cast("long").alias("size"))).alias("files"))
    out = S.link_uploaded_files(m, a)
    return out.select("conversation_id", F.size("files").alias("files"), F.array_join(F.transform("files", lambda f: F.concat_ws("=", f["name"], f["attachmentId"].cast("string"))), ";").alias("listing"))


def b18_upsert_artifacts(spark, sf_dir):
    e = X.trace_events(spark, sf_dir).select("turn", F.concat(F.lit("a"), F.col("image").cast("string")).alias("name"), F.col("seq").alias("n"), "elapsed_ms")
    return S.upsert_artifacts(e, "turn")


def b19_resolve_content(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    a = d.select(F.col("doc_id").alias("id"), F.when(F.col("doc_id") % 3 > 0, F.concat(F.lit("f"), F.col("doc_id").cast("string"))).alias("file_path"), F.when(F.col("doc_id") % 5 == 0, F.concat(F.lit("s"), F.col("doc_id").cast("string"))).alias("source_path"))
    files = d.filter("doc_id % 7 > 0").select(F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("path"), F.encode(F.lit("primary"), "utf-8").alias("content")).unionByName(d.filter("doc_id % 2 = 0").select(F.concat(F.lit("s"), F.col("doc_id").cast("string")).alias("path"), F.encode(F.lit("source"), "utf-8").alias("content")))
    blobs = d.filter("doc_id % 4 = 0").select(F.col("doc_id").alias("id"), F.encode(F.lit("blob"), "utf-8").alias("data"))
    return S.resolve_content(a, files, blobs).select("id", F.decode("content", "utf-8").alias("content"))


_NEXT = "1800000000000"
ORACLES = {
    "a4_load_store": oracle("v_msg", "SELECT conversation_id, position, CASE WHEN position % 3 = 0 THEN 1 ELSE 0 END AS n_files, 0 AS n_artifacts, CASE WHEN position % 3 = 0 THEN 'f' || position END AS first, CASE WHEN length(content) % 3 = 0 THEN 'tile' END AS imageMode, CASE WHEN length(content) % 3 = 0 THEN length(content) END AS elapsedMs FROM v_msg"),
    "a4_load_attachments": oracle("v_att", """, m AS (SELECT *, id % 3 < 2 AS ok FROM v_att) SELECT id, name, CASE WHEN ok THEN id END AS width, CASE WHEN ok THEN 4 END AS height, NULL::BIGINT AS source_width, CASE WHEN ok THEN page_number END AS page_number, CASE WHEN ok THEN coalesce(total_pages, 0) ELSE 0 END AS total_pages, 0 AS visual_pages,
 ok AND ocr_required AS ocr_required, false AS send_to_model, CASE WHEN ok THEN 'whole' END AS ocr_variant, CASE WHEN ok THEN '[{"page":' || position || ',"classification":"vector","chars":3,"raster":1,"raster_area":0.5,"vector":2,"vlm":true},{}]' END AS page_analysis FROM m"""),
    "a4_load_traces": oracle("v_event", "SELECT turn::VARCHAR AS id, count(*) OVER (PARTITION BY turn) AS events, seq::VARCHAR AS event, kind, started_ms AS startedMs, elapsed_ms AS elapsedMs, parent::VARCHAR AS parent, prompt_tokens FROM v_event WHERE turn % 3 < 2 UNION ALL SELECT DISTINCT turn::VARCHAR, 0, NULL, NULL, NULL, NULL, NULL, NULL FROM v_event WHERE turn % 3 = 2"),
    "a4_rejected_json": oracle("v_msg v_att v_event", """, r AS (SELECT 'messages' AS "table", 'files_json' AS "column", position::VARCHAR AS r FROM v_msg WHERE position % 3 = 1 UNION ALL SELECT 'messages', 'meta_json', position::VARCHAR FROM v_msg WHERE length(content) % 3 = 1
 UNION ALL SELECT 'attachments', 'metadata_json', id::VARCHAR FROM v_att WHERE id % 3 = 2 UNION ALL SELECT DISTINCT 'traces', 'events_json', turn::VARCHAR FROM v_event WHERE turn % 3 = 2) SELECT "table", "column", count(*) AS n, min(r) AS first FROM r GROUP BY ALL"""),
    "a5_evolve_schema": oracle("v_msg", "SELECT conversation_id, position, role, content, 0 AS created_at, '{}' AS meta_json FROM v_msg"),
    "b1_upsert_conversations": oracle("v_conv", f", c AS (SELECT * REPLACE (CASE WHEN created_at % 2 = 0 THEN '새 채팅' ELSE title END AS title) FROM v_conv) SELECT id, CASE WHEN created_at % 6 = 0 THEN 'New title' WHEN created_at % 6 < 3 AND title = '새 채팅' THEN 'derived' ELSE title END AS title, CASE WHEN created_at % 6 < 3 THEN 'local' ELSE provider END AS provider, CASE WHEN created_at % 6 < 3 THEN 'm2' ELSE model END AS model, created_at, CASE WHEN created_at % 6 < 3 THEN {_NEXT} ELSE updated_at END AS updated_at FROM c UNION ALL SELECT 'new-' || id, '새 채팅', 'local', 'm2', {_NEXT}, {_NEXT} FROM c WHERE created_at % 6 = 5"),
    "b2_replace_messages": oracle("v_msg", ", n AS (SELECT conversation_id, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY position) - 1 AS INT) AS position, role, upper(role) AS content, created_at FROM v_msg WHERE created_at % 5 = 0) SELECT * FROM n UNION ALL SELECT * FROM v_msg WHERE conversation_id NOT IN (SELECT conversation_id FROM n)"),
    "b3_upsert_attachments": oracle("v_att", ", n AS (SELECT conversation_id, id + 1000000 AS id, CASE WHEN id % 4 = 0 THEN 'x' || name ELSE name END AS name, CAST(row_number() OVER (PARTITION BY conversation_id ORDER BY position) - 1 AS INT) AS position FROM v_att WHERE id % 4 < 2) SELECT coalesce(o.id, n.id) AS id, n.conversation_id, n.position, n.name, 'new' AS text FROM n LEFT JOIN v_att o ON o.conversation_id = n.conversation_id AND o.name = n.name UNION ALL SELECT id, conversation_id, position, name, text FROM v_att o WHERE NOT EXISTS (SELECT 1 FROM n WHERE n.conversation_id = o.conversation_id AND n.name = o.name)"),
    "b4_replace_reuploads": oracle("v_att", ", r AS (SELECT conversation_id, name FROM v_att WHERE id % 20 = 0), o AS (SELECT v.id, v.name, r.name IS NOT NULL AS removed FROM v_att v LEFT JOIN r ON r.conversation_id = v.conversation_id AND r.name = regexp_replace(v.name, ' · (page [0-9]+|visual OCR)$', '')) SELECT * FROM o UNION ALL SELECT id + 1000000, name, false FROM v_att WHERE id % 20 = 0"),
    "b5_delete_conversations": oracle("v_conv v_msg v_att", ", g AS (SELECT id FROM v_conv WHERE created_at % 3 = 0) SELECT 'conversations' AS what, count(*) AS n FROM v_conv WHERE id NOT IN (SELECT id FROM g) UNION ALL SELECT 'messages', count(*) FROM v_msg WHERE conversation_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'attachments', count(*) FROM v_att WHERE conversation_id NOT IN (SELECT id FROM g) UNION ALL SELECT 'deleted', count(*) FROM g"),
    "b5_delete_all": oracle("v_conv", "SELECT 'conversations' AS what, 0 AS n UNION ALL SELECT 'messages', 0 UNION ALL SELECT 'attachments', 0 UNION ALL SELECT 'deleted', count(*) FROM v_conv"),
    "b5_delete_attachments": oracle("v_att", "SELECT conversation_id, id, name FROM v_att WHERE id % 8 <> 0"),
    "b6_session_list": oracle("v_conv v_msg v_att", "SELECT c.*, (SELECT count(*) FROM v_msg m WHERE m.conversation_id = c.id) AS message_count, (SELECT count(*) FROM v_att a WHERE a.conversation_id = c.id AND a.kind <> 'document' AND a.name NOT LIKE '% · page %') AS file_count FROM v_conv c ORDER BY updated_at DESC, id DESC LIMIT 200"),
    "b7_session_detail": oracle("v_conv v_msg v_att", "SELECT id, title, (SELECT string_agg(role || ':' || content, '|' ORDER BY position) FROM v_msg m WHERE m.conversation_id = c.id) AS messages, coalesce((SELECT string_agg(concat_ws(':', name, kind, length(text), page_number, CASE WHEN has_data THEN '/api/attachments/' || a.id || '/content' END), '|' ORDER BY position, a.id) FROM v_att a WHERE a.conversation_id = c.id), '') AS attachments FROM v_conv c"),
    "b8_attachment_listing": oracle("v_att", "SELECT conversation_id, position, id, name, mime, kind, size, length(text) AS parsed_characters, has_data, page_number, total_pages, CASE WHEN has_data THEN '/api/attachments/' || id || '/content' END AS url FROM v_att"),
    "b9_trace_listing": oracle("v_msg", "SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY created_at, id) AS number FROM (SELECT conversation_id || '-' || position AS id, conversation_id, created_at - created_at % 4 AS created_at FROM v_msg)"),
    "b10_sanitize_messages": oracle("v_msg", f"SELECT conversation_id, position, CASE WHEN role = 'assistant' THEN 'assistant' ELSE 'user' END AS role, CASE WHEN position % 5 = 3 THEN '' ELSE substr(content, 1, 40) END AS content, CASE WHEN role = 'assistant' THEN '{{\"a\":1}}' END AS meta, CASE WHEN position % 4 = 0 THEN {_NEXT} ELSE created_at END AS created_at FROM (SELECT *, row_number() OVER (PARTITION BY conversation_id ORDER BY position) AS rn FROM v_msg) WHERE rn <= 6"),
    "b11_sanitize_artifacts": oracle("v_msg", "SELECT conversation_id, position, CASE WHEN n % 7 = 0 THEN 0 ELSE 1 END AS artifacts, CASE WHEN n % 7 > 0 THEN 'artifact' END AS name, CASE WHEN n % 7 > 0 THEN 'application/octet-stream' END AS mime, CASE WHEN n % 7 > 0 AND n % 2 = 0 THEN 2 END AS boxes, CASE WHEN n % 7 > 0 AND n % 2 = 0 THEN 'a  b' END AS label, CASE WHEN n % 7 > 0 AND n % 2 = 0 THEN greatest(0, least(1, n % 5 - 1))::DOUBLE END AS confidence FROM (SELECT *, length(content) AS n FROM v_msg)"),
    "b12_sanitize_files": oracle("v_msg", "SELECT conversation_id, position, least(n % 30 + 1, 24) AS files, list_sum(list_transform(range(1, least(n % 30 + 1, 24) + 1), lambda i: greatest(0, i - 3)))::BIGINT AS bytes, 'binary' AS kind FROM (SELECT *, length(content) AS n FROM v_msg)"),
    "b13_sanitize_meta": oracle("v_msg", "SELECT conversation_id, position, n::DOUBLE AS tileSize, 0.0::DOUBLE AS overlap, CASE WHEN n % 3 = 0 THEN 'tile' END AS imageMode, greatest(0, n - 100) AS elapsedMs, CASE WHEN n % 4 = 0 THEN 2.0::DOUBLE END AS ocrCalls, CASE WHEN n % 2 = 0 THEN 3 END AS budget, n % 5 AS refused, 2 AS names FROM (SELECT *, length(content) AS n FROM v_msg)"),
    "b14_derive_titles": oracle("v_msg", r"SELECT conversation_id, coalesce(substr(trim(regexp_replace(arg_min(content, position) FILTER (role = 'user' AND trim(content) <> ''), '\s+', ' ', 'g')), 1, 80), '새 채팅') AS title FROM v_msg GROUP BY conversation_id"),
    "b15_monotone_stamps": oracle("v_event", ", e AS (SELECT turn, seq, prompt_tokens + seq // 3 AS ts FROM v_event) SELECT turn, seq, ts, seq + max(ts - seq) OVER (PARTITION BY turn ORDER BY seq) AS stamp FROM e"),
    "b16_valid_ids": "SELECT CASE doc_id % 3 WHEN 0 THEN 'id-' || doc_id ELSE 'conversation-' || doc_id END AS id FROM documents WHERE doc_id % 3 = 1 OR doc_id % 3 = 0 AND length('id-' || doc_id) >= 8",
    "b17_link_uploaded_files": X.oracle("v_att", """, a AS (SELECT conversation_id, id, name, mime, kind, position, min(name) OVER (PARTITION BY conversation_id) AS told, regexp_replace(name, ' · (page [0-9]+|visual OCR)$', '') AS root FROM v_att WHERE kind <> 'document'),
 s AS (SELECT conversation_id, root, arg_max(id, position) AS id FROM a GROUP BY conversation_id, root), f AS (SELECT DISTINCT conversation_id, told AS name, -1 AS n FROM a UNION ALL SELECT conversation_id, name, position FROM a WHERE name <> told)
 SELECT f.conversation_id, count(*)::INT AS files, string_agg(f.name || coalesce('=' || s.id, ''), ';' ORDER BY n) AS listing FROM f LEFT JOIN s ON s.conversation_id = f.conversation_id AND s.root = f.name GROUP BY f.conversation_id"""),
    "b18_upsert_artifacts": oracle("v_event", ", g AS (SELECT turn, 'a' || image AS name, arg_max(elapsed_ms, seq) AS elapsed_ms, min(seq) AS f FROM v_event GROUP BY turn, image) SELECT turn, name, elapsed_ms, row_number() OVER (PARTITION BY turn ORDER BY f) AS slot FROM g"),
    "b19_resolve_content": "SELECT doc_id AS id, CASE WHEN doc_id % 5 = 0 AND doc_id % 2 = 0 THEN 'source' WHEN doc_id % 3 > 0 AND doc_id % 7 > 0 THEN 'primary' WHEN doc_id % 4 = 0 THEN 'blob' END AS content FROM documents",
}
QUERIES = {k: v for k, v in dict(globals()).items() if k[:1] in "ab" and k[1:2].isdigit()}

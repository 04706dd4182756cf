"""Views of the given tables in the shapes that the operators read, in Spark and, for the oracles, in DuckDB SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsheaf.session import ship


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return ship(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def _conversation(number: Column) -> Column:
    return F.concat(F.lit("conversation-"), F.lpad(number.cast("string"), 7, "0"))


def pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """root, page_number, native_text, raster, raster_area, vector of every page. A document is the pages of a host among
    1000 page ids, so no host, however large, is one document."""
    host = F.regexp_extract("url", "^https?://([^/]+)", 1)
    raw = table(spark, sf_dir, "pages").select("page_id", F.concat(host, F.lit("/"), F.floor(F.col("page_id") / 1000).cast("string")).alias("root"), "html")
    stripped = F.regexp_replace("html", "<[^>]*>", " ")
    return raw.select(
        "page_id",
        "root",
        F.row_number().over(W.partitionBy("root").orderBy("page_id")).alias("page_number"),
        stripped.alias("native_text"),
        (F.col("page_id") % 3).cast("int").alias("raster"),
        F.when(F.col("page_id") % 3 > 0, (F.col("page_id") % 5) * 0.01).otherwise(0.0).alias("raster_area"),
        F.when(F.col("page_id") % 7 == 0, 0).otherwise((F.length("html") - F.length(F.replace("html", F.lit("<li"), F.lit("")))) / 3).cast("int").alias("vector"),
    )


def attachments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Families of attachments: a document in five is a PDF, its page image and its transcription follow, then an
    uploaded picture and a text file."""
    m, base = F.col("doc_id") % 5, F.col("doc_id") - F.col("doc_id") % 5
    pdf = F.concat(F.lit("d"), base.cast("string"), F.lit(".pdf"))
    page = (1 + base % 3).cast("int")
    name = (
        F.when(m == 0, pdf).when(m == 1, F.concat(pdf, F.lit(" · page "), page.cast("string"))).when(m == 2, F.concat(pdf, F.lit(" · visual OCR")))
        .when(m == 3, F.concat(F.lit("u"), F.col("doc_id").cast("string"), F.lit(".png"))).otherwise(F.concat(F.lit("n"), F.col("doc_id").cast("string"), F.lit(".txt")))
    )
    return table(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("id"),
        _conversation(F.floor(F.col("doc_id") / 10)).alias("conversation_id"),
        (F.col("doc_id") % 10).cast("int").alias("position"),
        name.alias("name"),
        F.when(m == 0, "application/pdf").when(m.isin(1, 3), "image/png").otherwise("text/plain").alias("mime"),
        F.when(m == 0, "pdf").when(m.isin(1, 3), "image").otherwise("document").alias("kind"),
        F.octet_length("text").cast("long").alias("size"),
        F.when(m.isin(1, 3), "").otherwise(F.col("text")).alias("text"),
        F.when(m == 1, page).alias("page_number"),
        F.when(m == 0, (1 + base % 9).cast("int")).alias("total_pages"),
        ((m == 1) & (base % 2 == 0)).alias("ocr_required"),
        (m == 3).alias("send_to_model"),
        m.isin(0, 1, 3).alias("has_data"),
        F.when((m == 1) & (base % 3 == 0), "whole").when((m == 1) & (base % 3 == 1), "tile").alias("ocr_variant"),
    )


def messages(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    return c.select(
        _conversation(F.col("conv_id")).alias("conversation_id"), F.col("turn").cast("int").alias("position"), "role", F.col("text").alias("content"),
        (F.lit(1_700_000_000_000) + F.col("conv_id") * 1000 + F.col("turn")).alias("created_at"),
    )


def conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(F.max("turn").alias("last"))
    return c.select(
        _conversation(F.col("conv_id")).alias("id"), F.concat(F.lit("title "), F.col("conv_id").cast("string")).alias("title"), F.lit("openai").alias("provider"),
        F.lit("model").alias("model"), (F.lit(1_700_000_000_000) + F.col("conv_id")).alias("created_at"), (F.lit(1_700_000_000_000) + F.col("last") * 7 + F.col("conv_id") % 11).alias("updated_at"),
    )


def lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))


def boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tile boxes of pages: (page, tile, box_no) orders them."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    order = W.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity", "l_shipdate")
    return l.select(
        F.col("l_orderkey").alias("page"), F.col("l_linenumber").cast("int").alias("tile"), F.row_number().over(order).alias("box_no"), F.col("l_returnflag").alias("type"),
        (F.col("l_partkey") % 7 * 0.05).alias("x"), (F.col("l_suppkey") % 5 * 0.05).alias("y"), (0.1 + F.col("l_quantity").cast("int") % 6 * 0.05).alias("w"),
        (0.1 + F.col("l_partkey") % 11 * 0.03).alias("h"), (F.col("l_discount") * 10).alias("confidence"), F.concat(F.lit("L"), F.col("l_partkey").cast("string")).alias("label"),
    )


def images(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("image_id"), (500 + F.col("p_size") * 160).cast("long").alias("width"), (400 + F.col("p_partkey") % 97 * 110).cast("long").alias("height")
    )


def trace_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trace events of turns: four kinds of model call, tool and note rows, with parents among earlier rows."""
    e = table(spark, sf_dir, "events")
    order = W.partitionBy("user_id").orderBy("ts", "event_id")
    k = F.get_json_object("props", "$.k").cast("long")
    seq = F.row_number().over(order)
    base = e.select("event_id", "user_id", seq.alias("seq"), "event_type", "value", k.alias("k"))
    kind = F.when(F.col("k") % 5 == 0, "tool").when(F.col("k") % 5 == 1, "grounding").when(F.col("k") % 5 == 2, "ocr").otherwise("llm")
    return base.select(
        F.col("user_id").alias("turn"), F.col("seq").cast("int").alias("seq"), kind.alias("kind"), F.col("event_type").alias("label"),
        F.when(F.col("k") % 13 == 0, "failed").when(F.col("k") % 17 == 0, "cancelled").when(F.col("k") % 29 == 0, "running").otherwise("ok").alias("status"),
        (F.col("seq") * 100).cast("long").alias("started_ms"), F.floor(F.col("value") * 10).cast("long").alias("elapsed_ms"),
        F.when((F.col("seq") > 1) & (F.col("k") % 4 != 0), (F.col("seq") - 1 - F.col("k") % F.least(F.col("seq") - 1, F.lit(7))).cast("int")).alias("parent"),
        F.col("k").alias("prompt_tokens"), (F.col("k") * 3).alias("completion_tokens"), (F.col("k") % 50).alias("reasoning_tokens"),
        F.when(F.col("k") < 10, "length").when(F.col("k") < 15, "reasoning_budget").otherwise("stop").alias("finish"), (F.col("event_id") % 40).cast("int").alias("image"),
    )


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every message as the chunks of a model call."""
    c = table(spark, sf_dir, "conversations")
    call = F.concat_ws("-", F.col("conv_id").cast("string"), F.col("turn").cast("string"))
    return c.select(call.alias("call_id"), F.posexplode(F.split("text", " ")).alias("seq", "piece"))


_CONV = "'conversation-' || lpad(CAST({0} AS VARCHAR), 7, '0')"
SQL = {
    "v_page": """SELECT page_id, root, row_number() OVER (PARTITION BY root ORDER BY page_id) AS page_number,
 regexp_replace(html, '<[^>]*>', ' ', 'g') AS native_text, CAST(page_id % 3 AS INT) AS raster,
 CASE WHEN page_id % 3 > 0 THEN (page_id % 5) * 0.01::DOUBLE ELSE 0.0 END AS raster_area,
 CASE WHEN page_id % 7 = 0 THEN 0 ELSE CAST((length(html) - length(replace(html, '<li', ''))) // 3 AS INT) END AS vector
 FROM (SELECT page_id, html, regexp_extract(url, '^https?://([^/]+)', 1) || '/' || page_id // 1000 AS root FROM pages)""",
    "v_att": """SELECT doc_id AS id, """ + _CONV.format("doc_id // 10") + """ AS conversation_id, CAST(doc_id % 10 AS INT) AS position,
 CASE doc_id % 5 WHEN 0 THEN 'd' || (doc_id - doc_id % 5) || '.pdf' WHEN 1 THEN 'd' || (doc_id - doc_id % 5) || '.pdf · page ' || (1 + (doc_id - doc_id % 5) % 3)
 WHEN 2 THEN 'd' || (doc_id - doc_id % 5) || '.pdf · visual OCR' WHEN 3 THEN 'u' || doc_id || '.png' ELSE 'n' || doc_id || '.txt' END AS name,
 CASE WHEN doc_id % 5 = 0 THEN 'application/pdf' WHEN doc_id % 5 IN (1, 3) THEN 'image/png' ELSE 'text/plain' END AS mime,
 CASE WHEN doc_id % 5 = 0 THEN 'pdf' WHEN doc_id % 5 IN (1, 3) THEN 'image' ELSE 'document' END AS kind, strlen(text) AS size,
 CASE WHEN doc_id % 5 IN (1, 3) THEN '' ELSE text END AS text, CASE WHEN doc_id % 5 = 1 THEN CAST(1 + (doc_id - doc_id % 5) % 3 AS INT) END AS page_number,
 CASE WHEN doc_id % 5 = 0 THEN CAST(1 + (doc_id - doc_id % 5) % 9 AS INT) END AS total_pages, doc_id % 5 = 1 AND (doc_id - doc_id % 5) % 2 = 0 AS ocr_required,
 doc_id % 5 = 3 AS send_to_model, doc_id % 5 IN (0, 1, 3) AS has_data,
 CASE WHEN doc_id % 5 = 1 AND (doc_id - doc_id % 5) % 3 = 0 THEN 'whole' WHEN doc_id % 5 = 1 AND (doc_id - doc_id % 5) % 3 = 1 THEN 'tile' END AS ocr_variant FROM documents""",
    "v_msg": "SELECT " + _CONV.format("conv_id") + " AS conversation_id, CAST(turn AS INT) AS position, role, text AS content, 1700000000000 + conv_id * 1000 + turn AS created_at FROM conversations",
    "v_conv": "SELECT " + _CONV.format("conv_id") + """ AS id, 'title ' || conv_id AS title, 'openai' AS provider, 'model' AS model, 1700000000000 + conv_id AS created_at,
 1700000000000 + max(turn) * 7 + conv_id % 11 AS updated_at FROM conversations GROUP BY conv_id""",
    "v_line": "SELECT doc_id, CAST(i - 1 AS INT) AS line_no, ls[i] AS line FROM (SELECT doc_id, ls, unnest(range(1, len(ls) + 1)) AS i FROM (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents))",
    "v_box": """SELECT l_orderkey AS page, CAST(l_linenumber AS INT) AS tile,
 CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity, l_shipdate) AS INT) AS box_no, l_returnflag AS type,
 l_partkey % 7 * 0.05::DOUBLE AS x, l_suppkey % 5 * 0.05::DOUBLE AS y, 0.1::DOUBLE + CAST(trunc(l_quantity) AS INT) % 6 * 0.05::DOUBLE AS w, 0.1::DOUBLE + l_partkey % 11 * 0.03::DOUBLE AS h,
 l_discount * 10 AS confidence, 'L' || l_partkey AS label FROM lineitem""",
    "v_image": "SELECT p_partkey AS image_id, CAST(500 + p_size * 160 AS BIGINT) AS width, CAST(400 + p_partkey % 97 * 110 AS BIGINT) AS height FROM part",
    "v_event": """SELECT user_id AS turn, CAST(seq AS INT) AS seq, CASE k % 5 WHEN 0 THEN 'tool' WHEN 1 THEN 'grounding' WHEN 2 THEN 'ocr' ELSE 'llm' END AS kind, event_type AS label,
 CASE WHEN k % 13 = 0 THEN 'failed' WHEN k % 17 = 0 THEN 'cancelled' WHEN k % 29 = 0 THEN 'running' ELSE 'ok' END AS status, seq * 100 AS started_ms, CAST(floor(value * 10) AS BIGINT) AS elapsed_ms,
 CASE WHEN seq > 1 AND k % 4 <> 0 THEN CAST(seq - 1 - k % least(seq - 1, 7) AS INT) END AS parent, k AS prompt_tokens, k * 3 AS completion_tokens, k % 50 AS reasoning_tokens,
 CASE WHEN k < 10 THEN 'length' WHEN k < 15 THEN 'reasoning_budget' ELSE 'stop' END AS finish, CAST(event_id % 40 AS INT) AS image
 FROM (SELECT event_id, user_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq, event_type, value, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events)""",
    "v_chunk": "SELECT call_id, CAST(i - 1 AS INT) AS seq, ws[i] AS piece FROM (SELECT call_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM (SELECT conv_id || '-' || turn AS call_id, string_split(text, ' ') AS ws FROM conversations))",
}


def oracle(views: str, body: str) -> str:
    """DuckDB SQL of body over the named views (separated by spaces)."""
    return "WITH " + ",\n".join(f"{v} AS ({SQL[v]})" for v in views.split()) + ("" if body.lstrip().startswith(",") else "\n") + body

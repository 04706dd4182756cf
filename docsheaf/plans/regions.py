"""Registered queries of regions."""

from __future__ import annotations

from pyspark.sql import functions as F

from docsheaf import fixtures as X
from docsheaf.fixtures import oracle
from docsheaf.operators import regions as R


def f1_parse_regions(spark, sf_dir):
    c = X.messages(spark, sf_dir).select(F.concat_ws("-", "conversation_id", F.col("position").cast("string")).alias("reply_id"), "content", "position")
    n = F.length("content")
    region = F.format_string('{"bbox":[%d,%d,%d,%d],"label":"a","type":"text"}', n % 300, n % 200, n % 300 + 50, n % 200 + 40)
    body = F.concat(F.lit('{"text":"seen","regions":['), region, F.lit("]}"))
    reply = (
        F.when(n % 5 == 0, body).when(n % 5 == 1, F.concat(F.lit("```json\n"), body, F.lit("\n```"))).when(n % 5 == 2, F.concat(F.lit("Here it is: ["), region, F.lit("] done")))
        .when(n % 5 == 3, "3600").otherwise(F.concat(F.lit("<think>{}</think>"), body))
    )
    out = R.parse_regions(c.withColumn("reply", reply), "reply_id")
    return out.select("reply_id", "structured", F.size("regions").alias("n"), F.coalesce(F.get("regions", F.lit(0))["bbox"][0], F.lit(-1.0)).alias("x"))


def _raw(spark, sf_dir):
    b = X.boxes(spark, sf_dir)
    k = F.col("box_no") + F.col("page")
    q = F.when(k % 4 == 0, 1.0).when(k % 4 == 1, 1000.0).otherwise(2000.0)
    four = [F.col("x") * q, F.col("y") * q, (F.col("x") + F.col("w")) * q, (F.col("y") + F.col("h")) * q]
    coords = lambda i: F.array(*[four[j] for j in i])
    none = F.lit(None).cast("array<double>")
    return b.select(
        "page", F.col("box_no").alias("n"), F.when(k % 3 == 0, coords((0, 1, 2, 3))).otherwise(none).alias("bbox"), F.when(k % 3 == 1, coords((0, 1, 2, 3))).otherwise(none).alias("bbox_2d"),
        F.when(k % 3 == 2, coords((1, 0, 3, 2))).otherwise(none).alias("box_2d"), F.lit(1800.0).alias("image_width"), F.lit(1500.0).alias("image_height"),
    )


def f2_normalize_coords(spark, sf_dir):
    return R.normalize_coords(_raw(spark, sf_dir), ["page"]).select("page", "n", *[F.round(c, 6).alias(c) for c in "xywh"])


def f3_normalize_region_types(spark, sf_dir):
    p = X.table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"), F.when(F.col("p_partkey") % 3 == 0, "Text|table").when(F.col("p_partkey") % 3 == 1, F.concat(F.lit("x / "), F.lit("STAMP"))).otherwise(F.col("p_type")).alias("type"),
        F.concat_ws(" ", "p_name", "p_name", "p_name", "p_name").alias("label"), (F.col("p_size") / 25.0 - 0.5).alias("confidence"),
    )
    return R.normalize_region_types(p).withColumn("confidence", F.round("confidence", 6))


def f4_valid_boxes(spark, sf_dir):
    b = X.boxes(spark, sf_dir).withColumns({"x": F.round(F.col("x") + F.col("page") % 10 * 0.06, 6), "w": F.round("w", 6), "h": F.round("h", 6), "y": F.round("y", 6)})
    return R.valid_boxes(b).select("page", "box_no")


def f5_overlap_pairs(spark, sf_dir):
    return R.overlap_pairs(X.boxes(spark, sf_dir)).select("page", "type", "first", "second", F.round("iou", 6).alias("iou"), F.round("contained", 6).alias("contained"))


def f6_merge_tile_boxes(spark, sf_dir):
    out = R.merge_tile_boxes(X.boxes(spark, sf_dir))
    return out.select("page", "type", "label", "first", "boxes", F.round("confidence", 6).alias("confidence"), *[F.round(c, 6).alias(c) for c in "xywh"])


def f7_page_region_summary(spark, sf_dir):
    r = X.trace_events(spark, sf_dir).select(
        F.col("turn").alias("page"), F.col("seq").alias("tile"), (F.col("prompt_tokens") % 3 > 0).alias("structured"), (F.col("prompt_tokens") % 30 == 0).alias("cut_off"),
        (F.col("prompt_tokens") % 45 == 3).alias("runaway"), F.when(F.col("prompt_tokens") % 2 == 0, F.concat("label", F.lit(" "), (F.col("prompt_tokens") % 4).cast("string"))).otherwise("").alias("text"), (F.col("prompt_tokens") % 2).alias("n_boxes"),
    )
    return R.page_region_summary(r)


def _scored(spark, sf_dir):
    b = X.boxes(spark, sf_dir).select(F.col("page").alias("run"), "box_no", *[F.round(c, 6).alias(c) for c in "xywh"])
    return b.filter("box_no % 2 = 1"), b.filter("box_no % 2 = 0").withColumnRenamed("box_no", "target")


def f8_score_boxes(spark, sf_dir):
    predicted, truth = _scored(spark, sf_dir)
    return R.score_summary(R.score_boxes(predicted, truth), predicted)


def f9_distractor_hits(spark, sf_dir):
    return R.distractor_hits(*_scored(spark, sf_dir))


_PAIR = """, p AS (SELECT a.page, a.type, a.box_no AS first, b.box_no AS second, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x) AS ow, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y) AS oh, a.w * a.h AS aa, b.w * b.h AS ba
 FROM v_box a JOIN v_box b ON a.page = b.page AND a.type = b.type AND a.box_no < b.box_no AND a.tile <> b.tile)
"""
ORACLES = {
    "f1_parse_regions": oracle("v_msg", "SELECT conversation_id || '-' || position AS reply_id, length(content) % 5 <> 3 AS structured, (length(content) % 5 <> 3)::INT AS n, CASE WHEN length(content) % 5 = 3 THEN -1.0::DOUBLE ELSE (length(content) % 300)::DOUBLE END AS x FROM v_msg"),
    "f2_normalize_coords": oracle("v_box", """, r AS (SELECT page, box_no AS n, (box_no + page) % 4 AS k, x, y, x + w AS u, y + h AS v FROM v_box), m AS (SELECT *, CASE k WHEN 0 THEN 1.0 WHEN 1 THEN 1000.0 ELSE 2000.0 END AS q, greatest(x, y, u, v) AS g FROM r),
 s AS (SELECT page, n, CASE WHEN g * q <= 1 THEN 1000.0 * q WHEN g * q > 1000 THEN q * 1000.0 / 1800.0 ELSE q END AS sx, CASE WHEN g * q <= 1 THEN 1000.0 * q WHEN g * q > 1000 THEN q * 1000.0 / 1500.0 ELSE q END AS sy, x, y, u, v FROM m),
 c AS (SELECT page, n, greatest(0, least(1000, x * sx::DOUBLE)) AS x, greatest(0, least(1000, y * sy::DOUBLE)) AS y, greatest(0, least(1000, u * sx::DOUBLE)) AS u, greatest(0, least(1000, v * sy::DOUBLE)) AS v FROM s)
 SELECT page, n, round(x / 1000, 6) AS x, round(y / 1000, 6) AS y, round((u - x) / 1000, 6) AS w, round((v - y) / 1000, 6) AS h FROM c WHERE u > x AND v > y"""),
    "f3_normalize_region_types": "SELECT p_partkey AS id, CASE p_partkey % 3 WHEN 0 THEN 'text' WHEN 1 THEN 'stamp' ELSE 'other' END AS type, substr(p_name || ' ' || p_name || ' ' || p_name || ' ' || p_name, 1, 80) AS label, round(greatest(0, least(1, p_size / 25.0::DOUBLE - 0.5)), 6) AS confidence FROM part",
    "f4_valid_boxes": oracle("v_box", "SELECT page, box_no FROM (SELECT page, box_no, round(x + page % 10 * 0.06::DOUBLE, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM v_box) WHERE x + w <= 1 + 1e-6 AND y + h <= 1 + 1e-6"),
    "f5_overlap_pairs": oracle("v_box", _PAIR + "SELECT page, type, first, second, round(ow * oh / (aa + ba - ow * oh), 6) AS iou, round(ow * oh / least(aa, ba), 6) AS contained FROM p WHERE ow > 0 AND oh > 0"),
    "f7_page_region_summary": oracle("v_event", """, r AS (SELECT turn AS page, seq AS tile, prompt_tokens % 3 > 0 AS st, prompt_tokens % 30 = 0 AS cu, prompt_tokens % 45 = 3 AS lo, CASE WHEN prompt_tokens % 2 = 0 THEN label || ' ' || prompt_tokens % 4 ELSE '' END AS t, prompt_tokens % 2 AS b FROM v_event),
 f AS (SELECT page, t, min(tile) FILTER (st AND b > 0) AS hit, min(tile) AS tile FROM r WHERE t <> '' GROUP BY page, t), n AS (SELECT page, string_agg(t, chr(10) ORDER BY hit) FILTER (hit IS NOT NULL) AS hits, array_to_string(list(t ORDER BY tile)[1:3], chr(10)) AS three FROM f GROUP BY page),
 g AS (SELECT page, count(*) AS tiles, sum(st::INT) AS ok, sum(cu::INT) AS cut, sum(lo::INT) AS looped, sum(b) AS boxes FROM r GROUP BY page)
 SELECT g.page, tiles, tiles - ok AS unreadable, cut, looped, boxes, coalesce(CASE WHEN ok > 0 THEN hits ELSE three END, '') AS notes,
 CASE WHEN ok > 0 AND tiles > ok THEN (tiles - ok) || ' of ' || tiles || ' tiles did not return structured regions, so targets inside those tiles may be missing.' WHEN ok = 0 AND (cut > 0 OR looped > 0) THEN 'The vision model did not return structured regions for any tile; no boxes could be measured.' ELSE '' END
 || CASE WHEN cut > 0 THEN ' ' || cut || ' of ' || tiles || ' tiles stopped at the output limit of 4096 tokens before answering and were not retried.' ELSE '' END
 || CASE WHEN looped > 0 THEN ' ' || looped || ' of ' || tiles || ' tiles were stopped because the model''s reasoning did not finish (it repeated itself or exceeded its budget) and were not retried.' ELSE '' END AS warning FROM g LEFT JOIN n ON g.page = n.page"""),
    "f8_score_boxes": oracle("v_box", """, b AS (SELECT page AS run, box_no, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM v_box),
 o AS (SELECT a.run, t.box_no AS t, a.box_no AS p, least(a.x + a.w, t.x + t.w) - greatest(a.x, t.x) AS ow, least(a.y + a.h, t.y + t.h) - greatest(a.y, t.y) AS oh, a.w * a.h AS aa, t.w * t.h AS ta FROM b a JOIN b t ON a.run = t.run AND a.box_no % 2 = 1 AND t.box_no % 2 = 0),
 r AS (SELECT run, t, p, iou, row_number() OVER (PARTITION BY run ORDER BY iou DESC, t DESC, p DESC) AS n FROM (SELECT *, ow * oh / (aa + ta - ow * oh) AS iou FROM o WHERE ow > 0 AND oh > 0)),
 k AS (WITH RECURSIVE w AS (SELECT run, n, t, p, iou, true AS ok, [t] AS ts, [p] AS ps FROM r WHERE n = 1 UNION ALL SELECT r.run, r.n, r.t, r.p, r.iou, NOT list_contains(ts, r.t) AND NOT list_contains(ps, r.p),
  CASE WHEN list_contains(ts, r.t) OR list_contains(ps, r.p) THEN ts ELSE list_append(ts, r.t) END, CASE WHEN list_contains(ts, r.t) OR list_contains(ps, r.p) THEN ps ELSE list_append(ps, r.p) END FROM w JOIN r ON r.run = w.run AND r.n = w.n + 1) SELECT * FROM w WHERE ok),
 s AS (SELECT b.run, round(coalesce(k.iou, 0), 3) AS iou FROM b LEFT JOIN k ON k.run = b.run AND k.t = b.box_no WHERE b.box_no % 2 = 0), n AS (SELECT run, count(*) AS predictions FROM b WHERE box_no % 2 = 1 GROUP BY run)
 SELECT s.run, count(*) AS targets, floor((2 * sum(round(iou * 1000)::BIGINT) + count(*)) / (2 * count(*))) / 1000 AS mean_iou, count(*) FILTER (iou >= 0.5) AS hits, any_value(predictions) AS predictions, any_value(predictions) - count(*) FILTER (iou >= 0.5) AS unmatched FROM s JOIN n ON s.run = n.run GROUP BY s.run"""),
    "f9_distractor_hits": oracle("v_box", ", b AS (SELECT page AS run, box_no, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM v_box), p AS (SELECT a.run, a.box_no, greatest(0, least(a.x + a.w, d.x + d.w) - greatest(a.x, d.x)) * greatest(0, least(a.y + a.h, d.y + d.h) - greatest(a.y, d.y)) AS s, a.w * a.h + d.w * d.h AS t FROM b a JOIN b d ON a.run = d.run AND a.box_no % 2 = 1 AND d.box_no % 2 = 0) SELECT run, count(DISTINCT box_no) AS on_distractor FROM p WHERE s / (t - s) >= 0.3 GROUP BY run"),
}
QUERIES = {k: v for k, v in dict(globals()).items() if k[:1] == "f" and k[1:2].isdigit()}

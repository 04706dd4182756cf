"""Page inspection and routing: text measures, classes, drawings, document bodies and page lists."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsheaf.settings import DEFAULTS, Settings


def page_text_stats(pages: DataFrame, text: str = "native_text") -> DataFrame:
    """Adds clean_text (blanks squeezed and trimmed in each line, at most one empty line in a row) and chars (letters and digits)."""
    line = lambda x: F.regexp_replace(F.regexp_replace(x, r"[ \t ]+", " "), r"(?U)^\s+|\s+$", "")
    joined = F.array_join(F.transform(F.split(F.replace(text, F.lit("\r"), F.lit("")), "\n"), line), "\n")
    clean = F.regexp_replace(F.regexp_replace(joined, r"\n{3,}", "\n\n"), r"(?U)^\s+|\s+$", "")
    return pages.withColumns({"clean_text": clean, "chars": F.length(F.regexp_replace(clean, r"[^\p{L}\p{N}]", ""))})


def classify_pages(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds classification and needs_vlm from chars, raster and vector."""
    usable = F.col("chars") >= settings.native_min_chars
    sparse = (F.col("raster") > 0) & (F.col("chars") < settings.sparse_overlay_chars)
    kind = (
        F.when(usable & (F.col("raster") == 0), "native-vector").when(usable & sparse, "mixed-needs-vision").when(usable, "mixed-native")
        .when(F.col("raster") > 0, "scanned-raster").when(F.col("vector") > 0, "vector-outlines").otherwise("unknown")
    )
    return pages.withColumns({"classification": kind, "needs_vlm": ~usable | sparse})


def raster_coverage(placements: DataFrame, pages: DataFrame, keys: list[str]) -> DataFrame:
    """Share of the page under embedded images: sum of the placed sizes over the page area, at most 1.

    placements: keys, a, b, c, d (the first four numbers of the transform); rows with a null among them don't count.
    """
    placed = F.hypot("a", "b") * F.hypot("c", "d")
    covered = placements.groupBy(*keys).agg(F.sum(placed).alias("covered"))
    area = F.abs(F.col("page_width") * F.col("page_height"))
    ratio = F.coalesce("covered", F.lit(0.0)) / F.when(area == 0, 1.0).otherwise(area)
    return pages.join(covered, keys, "left").withColumn("raster_area", F.greatest(F.lit(0.0), F.least(F.lit(1.0), ratio))).drop("covered")


# Path-painting operators of page content, its string literals, and how much of it is read.
PAINT = r"(?:^|(?<=\s))(?:B\*?|b\*?|f\*?|F|S|s|sh)(?=\s|$)"
STRING_LITERAL = r"(?d)\((?:\\.|[^\\()])*+\)"
SCAN_CHARS = 64 * 1024 * 1024


def count_paint_ops(streams: DataFrame, keys: list[str], order: str = "stream_no", content: str = "content", scan_chars: int | None = SCAN_CHARS) -> DataFrame:
    """vector per page: path-painting operators outside string literals in the first scan_chars characters of its content
    streams (64 MB, as in the analysed system), or in all of them if that is None, without sorting a page's streams."""
    if scan_chars is None:
        return _painted(streams.select(*keys, F.col(content).alias("part")), keys)
    own = W.partitionBy(*keys).orderBy(order)
    before = F.coalesce(F.sum(F.length(content)).over(own.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    left = F.greatest(F.lit(0), F.lit(scan_chars) - before).cast("int")
    return _painted(streams.select(*keys, F.substring(F.col(content), F.lit(1), left).alias("part")), keys)


def _painted(parts: DataFrame, keys: list[str]) -> DataFrame:
    found = F.size(F.regexp_extract_all(F.regexp_replace("part", STRING_LITERAL, "()"), F.lit(PAINT), F.lit(0)))
    return parts.select(*keys, found.alias("n")).groupBy(*keys).agg(F.sum("n").alias("vector"))


def flag_drawings(pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds drawing: a picture or line drawing is on the page."""
    drawn = F.col("classification").isin("vector-outlines", "scanned-raster") | (F.col("raster_area") >= settings.drawing_min_raster_area)
    return pages.withColumn("drawing", drawn | (F.col("vector") >= settings.drawing_min_vector_operations))


def tile_dpi(pages: DataFrame, placements: DataFrame, keys: list[str], settings: Settings = DEFAULTS) -> DataFrame:
    """Adds dpi: the render resolution, capped on scanned pages by the best resolution of their images.

    placements: keys, pixel_width, pixel_height, width_points, height_points; images of under 1 % of the page don't count.
    """
    sized = placements.join(pages.select(*keys, (F.col("page_width") * F.col("page_height")).alias("page_area")), keys)
    large = sized.filter((F.col("width_points") > 0) & (F.col("height_points") > 0) & (F.col("width_points") * F.col("height_points") >= 0.01 * F.col("page_area")))
    own = F.greatest(F.col("pixel_width") / (F.col("width_points") / 72), F.col("pixel_height") / (F.col("height_points") / 72))
    best = large.groupBy(*keys).agg(F.max(own).alias("image_dpi"))
    capped = F.when((F.col("classification") == "scanned-raster") & F.col("image_dpi").isNotNull(), F.least(F.col("image_dpi"), F.lit(float(settings.render_dpi)))).otherwise(F.lit(float(settings.render_dpi)))
    return pages.join(best, keys, "left").withColumn("dpi", capped)


def inspect_documents(pages: DataFrame, limit: int | None = None, settings: Settings = DEFAULTS) -> DataFrame:
    """Per root: total, processed (the first `limit` pages), visual, truncated, and the text of its native pages."""
    most = min(limit or settings.visual_pages, settings.max_visual_pages)
    counted = pages.withColumn("total", F.count(F.lit(1)).over(W.partitionBy("root"))).filter(F.col("page_number") <= most)
    block = F.when((F.col("clean_text") != "") & ~F.col("needs_vlm"), F.struct("page_number", F.concat(F.lit("[PAGE "), F.col("page_number").cast("string"), F.lit("]\n"), "clean_text").alias("t")))
    return counted.groupBy("root").agg(
        F.max("total").alias("total_pages"), F.count(F.lit(1)).alias("processed_pages"), F.sum(F.col("needs_vlm").cast("long")).alias("visual_pages"),
        (F.max("total") > most).alias("truncated"), F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["t"]), "\n\n").alias("native_text"),
    )


def analysis_line() -> Column:
    return F.format_string(
        "Page %d: %s; native characters=%d; raster images=%d; vector operations=%d; vision OCR=%s",
        "page_number", "classification", "chars", "raster", "vector", F.when(F.col("needs_vlm"), "required").otherwise("skipped"),
    )


def document_body(docs: DataFrame, pages: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Per root: a metadata block, a [PAGE ANALYSIS] block with a line for each page, then the text, cut at the limit."""
    analysed = pages.groupBy("root").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("page_number", analysis_line().alias("t")))), lambda x: x["t"]), "\n").alias("analysis"))
    head = F.format_string("[PDF METADATA]\nPages: %d\nProcessed: %d", "total_pages", "processed_pages")
    body = F.concat(head, F.lit("\n\n[PAGE ANALYSIS]\n"), "analysis", F.when(F.col("native_text") != "", F.concat(F.lit("\n\n"), "native_text")).otherwise(""))
    return docs.join(analysed, "root").select("root", F.substring(body, 1, settings.max_document_chars).alias("body"))


#: Fixed value: the line that analysis_line() writes.
_ANALYSIS = r"(?m)^Page (\d+): ([\w-]+); native characters=(\d+); raster images=(\d+); vector operations=(\d+); vision OCR=(required|skipped)$"


def parse_page_analysis(docs: DataFrame, body: str = "body") -> DataFrame:
    """One row per analysed page of a body. The raster area isn't in the text: 1 if there are images."""
    line = docs.withColumn("line", F.explode(F.regexp_extract_all(body, F.lit(_ANALYSIS), F.lit(0))))
    field = lambda k: F.regexp_extract("line", _ANALYSIS, k)
    return line.select(
        "root", field(1).cast("int").alias("page_number"), field(2).alias("classification"), field(3).cast("int").alias("chars"), field(4).cast("int").alias("raster"),
        F.when(field(4).cast("int") > 0, 1.0).otherwise(0.0).alias("raster_area"), field(5).cast("int").alias("vector"), (field(6) == "required").alias("needs_vlm"),
    )


def page_ranges(df: DataFrame, keys: list[str], page: str = "page_number", name: str = "ranges") -> DataFrame:
    """Per key: pages as "1-3, 5, 7-8"."""
    one = df.select(*keys, F.col(page).alias("p")).distinct()
    islands = one.withColumn("g", F.col("p") - F.row_number().over(W.partitionBy(*keys).orderBy("p"))).groupBy(*keys, "g").agg(F.min("p").alias("a"), F.max("p").alias("b"))
    text = F.when(F.col("a") == F.col("b"), F.col("a").cast("string")).otherwise(F.concat(F.col("a").cast("string"), F.lit("-"), F.col("b").cast("string")))
    ordered = F.sort_array(F.collect_list(F.struct("a", text.alias("t"))))
    return islands.groupBy(*keys).agg(F.array_join(F.transform(ordered, lambda x: x["t"]), ", ").alias(name))


# Sentences of the report.
_NOT_IN_TEXT = (
    "What is drawn - the shapes, their positions and counts, and which label or dimension belongs to which feature - is NOT in the text of any page"
)
_BASIS = "file check (embedded images and vector strokes in the file, not a visual inspection)"


def drawing_report(pages: DataFrame, totals: DataFrame) -> DataFrame:
    """Per root: counts and page lists of drawings found, none found, no text layer and not checked, and the sentence.

    pages: root, page_number, classification, needs_vlm, drawing of the checked pages. totals: root, total_pages.
    """
    checked = pages.select("root", "page_number", "classification", "needs_vlm", "drawing")
    every = totals.select("root", F.explode(F.sequence(F.lit(1), F.col("total_pages").cast("int"))).alias("page_number"))
    unchecked = every.join(checked.select("root", "page_number"), ["root", "page_number"], "left_anti")
    report = totals.join(
        checked.groupBy("root").agg(
            F.count(F.lit(1)).alias("checked"), F.sum(F.col("drawing").cast("long")).alias("drawn"), F.sum((~F.col("drawing")).cast("long")).alias("none_detected"),
            F.sum((F.col("drawing") & F.col("needs_vlm")).cast("long")).alias("no_text"), F.min(F.col("classification") == "scanned-raster").alias("all_scanned"),
        ), "root",
    )
    parts = {"drawn_pages": checked.filter("drawing"), "none_pages": checked.filter("not drawing"), "no_text_pages": checked.filter("drawing and needs_vlm"), "unchecked_pages": unchecked}
    for name, rows in parts.items():
        report = report.join(page_ranges(rows, ["root"], name=name), "root", "left")
    report = report.join(unchecked.groupBy("root").agg(F.count(F.lit(1)).alias("unchecked")), "root", "left").na.fill(0, ["unchecked"])
    phrase = lambda n, ranges: F.concat(F.when(F.col(n) == 1, "page ").otherwise("pages "), F.col(ranges))
    text = lambda *x: F.concat(*[F.lit(y) if isinstance(y, str) else y for y in x])
    tail = F.when(F.col("unchecked") > 0, text("; ", phrase("unchecked", "unchecked_pages"), " were not checked (page limit)")).otherwise("")
    total = F.col("total_pages").cast("string")
    scanned = text("file check: all ", total, " pages are full-page scans with no text layer; their text is only a transcription of the visible labels. ", _NOT_IN_TEXT)
    empty = text(_BASIS, ": no embedded images or vector strokes detected on any page - drawings stored in another way would not be detected", tail, ". ", _NOT_IN_TEXT)
    whole = (F.col("none_detected") == 0) & (F.col("unchecked") == 0)
    found = F.when(whole, text("all ", total, " pages contain them")).otherwise(text(F.col("drawn").cast("string"), " of ", total, " pages contain them - ", F.col("drawn_pages")))
    none = F.when(F.col("none_detected") > 0, text(F.col("none_detected").cast("string"), F.when(F.col("none_detected") == 1, " page has").otherwise(" pages have"), " none detected - ", F.col("none_pages")))
    bare = F.when(F.col("no_text") > 0, text(phrase("no_text", "no_text_pages"), F.when(F.col("no_text") == 1, " has").otherwise(" have"), " no text layer, so ", F.when(F.col("no_text") == 1, "its").otherwise("their"), " text is only a transcription of the visible labels"))
    some = text(_BASIS, ": ", F.concat_ws("; ", found, none, bare), tail, ". ", _NOT_IN_TEXT)
    sentence = F.when(F.col("all_scanned") & (F.col("unchecked") == 0), scanned).when(F.col("drawn") == 0, empty).otherwise(some)
    return report.withColumn("sentence", sentence).drop("all_scanned")


def expand_page_specs(requests: DataFrame, keys: list[str], spec: str = "spec", most: int = 2000) -> DataFrame:
    """Per key: the sorted distinct pages of "7", "1-10", "2,5,7-9" (also – and ~), or an error."""
    tokens = F.filter(F.split(F.regexp_replace(F.col(spec), r"\s*[-–~]\s*", "-"), r"[,;\s]+"), lambda t: t != "")
    good = r"^[0-9]{1,9}(?:-[0-9]{1,9})?$"
    low = lambda t: F.split(t, "-")[0].cast("long")
    high = lambda t: F.element_at(F.split(t, "-"), -1).cast("long")
    wrong = F.exists(tokens, lambda t: ~t.rlike(good)) | (F.size(tokens) == 0) | F.col(spec).isNull()
    parsed = requests.withColumns({"tokens": tokens, "wrong": wrong})
    bad_span = F.when(~F.col("wrong"), F.exists("tokens", lambda t: (low(t) < 1) | (high(t) < low(t)) | (high(t) - low(t) >= most)))
    error = F.when(F.col("wrong"), "not a page list").when(bad_span, "bad range")
    pages = F.array_sort(F.array_distinct(F.flatten(F.transform("tokens", lambda t: F.sequence(low(t), high(t))))))
    return parsed.withColumn("error", error).select(*keys, F.when(F.col("error").isNull(), pages).alias("pages"), "error")

"""Evidence selection and retrieval: manifests, budgets, fair shares, search, windows, and page plans of turns."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsheaf.functions.containment import containing
from docsheaf.functions.text import clip, is_visual_ocr, ordered_join, root_name, squeeze, strip
from docsheaf.operators.pages import page_ranges
from docsheaf.operators.transcripts import LENGTH_STOPS, clean_transcripts, cut_answers
from docsheaf.settings import DEFAULTS, Settings


def with_root(df: DataFrame, name: str = "name") -> DataFrame:
    return df.withColumn("root", root_name(F.col(name)))


def attachment_manifest(attachments: DataFrame, cues: DataFrame | None = None) -> DataFrame:
    """(conversation_id, manifest): a line for each upload, first seen first. cues: conversation_id, root, cue."""
    a = with_root(attachments)
    chars = F.length(F.coalesce("text", F.lit("")))
    groups = a.groupBy("conversation_id", "root").agg(
        F.min("position").alias("first"), F.count(F.lit(1)).alias("parts"), F.sum((F.col("kind") == "image").cast("long")).alias("images"), F.sum(chars).alias("text"),
        F.sum(F.when(is_visual_ocr(F.col("name")), chars).otherwise(0)).alias("ocr"), F.sum(F.col("ocr_required").cast("long")).alias("pending"), F.max(F.when(F.col("kind") == "pdf", F.col("total_pages"))).alias("pages"),
    )
    if cues is not None:
        groups = groups.join(cues, ["conversation_id", "root"], "left")
    cue = F.when(F.coalesce(F.col("cue"), F.lit("")) != "", F.concat(F.lit("; "), "cue")).otherwise("") if cues is not None else F.lit("")
    pages = F.when(F.col("pages") > 0, F.concat(F.lit(", pages="), F.col("pages").cast("string"))).otherwise("")
    line = F.concat(F.format_string('"%s": parts=%d', "root", "parts"), pages, F.format_string(", images=%d, parsedText=%d chars, visualOcr=%d chars, pendingVision=%d", "images", "text", "ocr", "pending"), cue)
    return groups.groupBy("conversation_id").agg(ordered_join("first", line, "; ").alias("manifest"))


def coverage_preview(text: Column, most: Column) -> Column:
    """Visual-OCR text cut so that every source block keeps a share; texts without blocks keep head and tail."""
    found = F.regexp_extract_all(text, F.lit(r"(?m)^\[VISUAL SOURCE: .+\]$"), F.lit(0))
    n = F.size(found)
    blocks = F.transform(F.slice(F.split(text, r"(?m)(?=^\[VISUAL SOURCE: .+\]$)"), F.when(text.rlike(r"\A\[VISUAL SOURCE: .+\](?:\n|\z)"), 1).otherwise(2), n), strip)
    budget = F.greatest(F.lit(160), F.floor((most - 150) / F.greatest(n, F.lit(1)))).cast("int")
    header = F.concat(F.lit("[COVERAGE PREVIEW: all "), n.cast("string"), F.lit(" visual sources are represented; call read_attachment for the complete text.]"))
    preview = F.concat(header, F.lit("\n\n"), F.array_join(F.transform(blocks, lambda b: clip(b, budget)), "\n\n"))
    return F.when(F.length(text) <= most, text).when(n == 0, clip(text, most)).otherwise(F.substring(preview, F.lit(1), most))


def narrow_by_mention(prompts: DataFrame, attachments: DataFrame) -> DataFrame:
    """Attachments of the uploads that the prompt names; all of a conversation's if it names none."""
    a = with_root(attachments)
    hits = a.join(prompts, "conversation_id").filter(F.contains(F.lower("prompt"), F.lower("name"))).select("conversation_id", "root").distinct()
    named = a.join(hits, ["conversation_id", "root"], "left_semi")
    rest = a.join(prompts.select("conversation_id"), "conversation_id", "left_semi").join(hits.select("conversation_id").distinct(), "conversation_id", "left_anti")
    return named.select(*attachments.columns).unionByName(rest.select(*attachments.columns))


def fair_text_budget(docs: DataFrame, total: int) -> DataFrame:
    """Documents (not images) cut to an equal share of the budget among those of a conversation that have text."""
    own = docs.filter("kind <> 'image'")
    n = F.sum((F.coalesce("text", F.lit("")) != "").cast("int")).over(W.partitionBy("conversation_id"))
    share = F.greatest(F.lit(1000), F.floor(F.lit(total) / F.greatest(n, F.lit(1)))).cast("int")
    shared = own.withColumn("share", share)
    text = F.coalesce("text", F.lit(""))
    return shared.withColumn("text", F.when(is_visual_ocr(F.col("name")), coverage_preview(text, F.col("share"))).otherwise(clip(text, F.col("share"))))


def answer_image_candidates(attachments: DataFrame, mode: str) -> DataFrame:
    """(conversation_id, grp, slot, name, id, pending): images that an answer may carry, grouped by upload.

    off: none; uploads and auto: uploaded pictures; whole: also every page of each PDF, as rendered or as a placeholder.
    """
    a = with_root(attachments)
    uploads = a.filter((F.col("kind") == "image") & F.col("send_to_model")).select("conversation_id", F.col("root").alias("grp"), F.col("position").cast("long").alias("slot"), "name", "id", F.lit(False).alias("pending"))
    if mode == "off":
        return uploads.limit(0)
    if mode != "whole":
        return uploads
    rendered = a.filter((F.col("kind") == "image") & F.col("page_number").isNotNull() & F.col("has_data")).groupBy("conversation_id", "root", "page_number").agg(F.max_by(F.struct("name", "id"), "position").alias("r"))
    most = rendered.groupBy("conversation_id", "root").agg(F.max("page_number").alias("most"))
    pdfs = a.filter("kind = 'pdf'").select("conversation_id", F.col("name").alias("root"), "total_pages").join(most, ["conversation_id", "root"], "left")
    total = F.coalesce(F.when(F.col("total_pages") > 0, F.col("total_pages")), "most", F.lit(0)).cast("int")
    pages = pdfs.withColumn("total", total).filter("total > 0").select("conversation_id", "root", F.explode(F.sequence(F.lit(1), F.col("total"))).alias("page_number"))
    both = pages.join(rendered, ["conversation_id", "root", "page_number"], "left")
    name = F.coalesce("r.name", F.concat("root", F.lit(" · page "), F.col("page_number").cast("string")))
    return uploads.unionByName(both.select("conversation_id", F.col("root").alias("grp"), (F.col("page_number") + 1_000_000).cast("long").alias("slot"), name.alias("name"), F.col("r.id").alias("id"), F.col("r").isNull().alias("pending")))


def round_robin(images: DataFrame, n: int = DEFAULTS.max_images) -> DataFrame:
    """One image of each group in turn until n; adds place and candidates. images: conversation_id, grp, slot."""
    own = W.partitionBy("conversation_id", "grp")
    turn = images.withColumns({"round": F.row_number().over(own.orderBy("slot", "name")), "grp_first": F.min("slot").over(own)})
    place = F.row_number().over(W.partitionBy("conversation_id").orderBy("round", "grp_first", "grp"))
    return turn.withColumns({"place": place, "candidates": F.count(F.lit(1)).over(W.partitionBy("conversation_id"))}).filter(F.col("place") <= n).drop("round", "grp_first")


def context_budgets(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds char_budget, attachment_budget, history_budget. requests: local, context_tokens."""
    tokens = F.least(F.when(F.col("context_tokens") > 0, F.col("context_tokens")).otherwise(settings.context_tokens), F.lit(1_048_576))
    chars = F.greatest(F.lit(4000), F.least(F.lit(200_000), F.floor(tokens * F.lit(3.3) * F.lit(0.65)).cast("int")))
    pick = lambda local, cloud: F.when(F.col("local"), local).otherwise(F.lit(cloud)).cast("int")
    return requests.withColumns({
        "char_budget": pick(chars, settings.cloud_chars), "attachment_budget": pick(F.greatest(F.lit(6000), F.floor(chars * F.lit(0.42))), settings.cloud_attachment_chars),
        "history_budget": pick(F.greatest(F.lit(3500), F.floor(chars * F.lit(0.35))), settings.cloud_chars // 2),
    })


#: Fixed value: how stored replies of failed calls begin.
STORED_ERROR = r"(?i)^(?:오류|error)\s*:"


def compact_history(messages: DataFrame, budget: int, settings: Settings = DEFAULTS) -> DataFrame:
    """(conversation_id, position, role, content): the newest messages that fit the budget, clipped, oldest first.

    Stored error replies go. Each message may take the larger of 600 and 45 % of the budget, and costs 40 more than its
    clipped length. Assistant messages at the head go.
    """
    newest = messages.withColumn("_rn", F.row_number().over(W.partitionBy("conversation_id").orderBy(F.desc("position")))).filter(F.col("_rn") <= settings.max_history)
    useful = newest.filter(~((F.col("role") == "assistant") & strip(F.col("content")).rlike(STORED_ERROR)))
    rows = useful.groupBy("conversation_id").agg(F.sort_array(F.collect_list(F.struct("position", "role", "content")), asc=False).alias("ms"))
    kind = "array<struct<position:int,role:string,content:string>>"
    start = F.struct(F.lit(max(1000, budget)).alias("left"), F.array().cast(kind).alias("out"))
    most = max(600, int(budget * 0.45))

    def step(acc: Column, m: Column) -> Column:
        cut = clip(m["content"], F.least(acc["left"], F.lit(most)))
        taken = F.struct((acc["left"] - F.length(cut) - 40).alias("left"), F.concat(acc["out"], F.array(F.struct(m["position"].alias("position"), m["role"].alias("role"), cut.alias("content")))).alias("out"))
        return F.when(acc["left"] > 0, taken).otherwise(acc)

    picked = rows.select("conversation_id", F.inline(F.aggregate("ms", start, step, lambda acc: acc["out"])))
    first = F.min(F.when(F.col("role") != "assistant", F.col("position"))).over(W.partitionBy("conversation_id"))
    return picked.withColumn("_first", first).filter(F.col("position") >= F.col("_first")).drop("_first")


def compact_overflow(messages: DataFrame, level: int = 1) -> DataFrame:
    """The system message and the last few others, clipped, for another try after a context overflow."""
    system, content, keep = (1800, 1000, 3) if level >= 2 else (3200, 1800, 5)
    own = W.partitionBy("conversation_id")
    is_system = F.col("role") == "system"
    first = messages.filter(is_system).withColumn("_rn", F.row_number().over(own.orderBy("position"))).filter("_rn = 1").drop("_rn")
    tail = messages.filter(~is_system).withColumn("_rn", F.row_number().over(own.orderBy(F.desc("position")))).filter(F.col("_rn") <= keep).drop("_rn")
    head = F.min(F.when(F.col("role") != "tool", F.col("position"))).over(own)
    tail = tail.withColumn("_head", head).filter(F.col("position") >= F.col("_head")).drop("_head")
    limit = F.when(F.col("role") == "tool", content * 2).otherwise(content)
    return first.withColumn("content", clip(F.col("content"), system)).unionByName(tail.withColumn("content", clip(F.col("content"), limit)))


EVIDENCE_NOTE = (
    '[EVIDENCE NOTE: pages without enough native text were transcribed from whole-page images; see the "visual OCR" attachment. '
    "Account for every visual source, keep the page order, and do not invent values that are unreadable.]"
)


def assemble_prompts(prompts: DataFrame, docs: DataFrame, images: DataFrame) -> DataFrame:
    """(conversation_id, prompt): question, document blocks, evidence note, listing of page images.

    docs: conversation_id, position, name, text. images: conversation_id, place, name, is_page.
    """
    block = F.when(F.coalesce("text", F.lit("")) != "", F.struct("position", F.concat(F.lit("[Attachment: "), "name", F.lit("]\n"), "text").alias("t")))
    d = docs.groupBy("conversation_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(block)), lambda x: x["t"]), "\n\n").alias("blocks"), F.max(is_visual_ocr(F.col("name"))).alias("ocr"))
    i = images.groupBy("conversation_id").agg(ordered_join("place", F.concat(F.col("place").cast("string"), F.lit(": "), "name"), "; ").alias("listing"), F.max("is_page").alias("pages"))
    both = prompts.join(d, "conversation_id", "left").join(i, "conversation_id", "left")
    ask = F.when(F.coalesce("prompt", F.lit("")) == "", "Please analyze the attached files.").otherwise(F.col("prompt"))
    shown = F.when(F.col("pages"), F.concat(F.lit("[PAGE IMAGES: attached to this message in this order - "), "listing", F.lit(". They show the drawings, symbols and layout that the extracted text cannot convey.]")))
    return both.select("conversation_id", F.concat_ws("\n\n", ask, F.when(F.col("blocks") != "", F.col("blocks")), F.when(F.col("ocr"), EVIDENCE_NOTE), shown).alias("prompt"))


def search_documents(queries: DataFrame, docs: DataFrame, limit: int = 12) -> DataFrame:
    """(query_id, conversation_id, doc, offset, excerpt): case-insensitive, non-overlapping occurrences in document
    order, at most `limit` for each query and conversation. queries: query_id, query (at least 2 characters).
    docs: conversation_id, position, doc, text. Offsets are those in the lower-cased text.

    Candidates come from the rarest inner word of each query, or from runs of three characters; places and excerpts are
    found in one row for each text, so a text isn't copied for each query. search_index() does the same by a stored index.
    """
    asked = asked_needles(queries)
    lowered = docs.select("conversation_id", "position", "doc", "text", F.lower("text").alias("low")).filter("low is not null")
    hits = containing(lowered, ["conversation_id", "position", "doc"], "low", asked, "needle")
    return found_spots(hits, asked, limit)


def asked_needles(queries: DataFrame) -> DataFrame:
    """(query_id, needle): lower-case queries of at least two characters."""
    return queries.select("query_id", F.lower(strip(F.col("query"))).alias("needle")).filter(F.length("needle") >= 2)


def found_spots(hits: DataFrame, asked: DataFrame, limit: int) -> DataFrame:
    """The rows of search_documents() in texts that hold needles. hits: conversation_id, position, doc, text, low (its lower
    case), held (the needles)."""

    def places(needle: Column) -> Column:
        size = F.length(needle)
        quoted = F.regexp_replace(needle, r"([\\.\[\]{}()*+?^$|])", r"\\$1")
        gaps = F.transform(F.split("low", quoted, -1), lambda x: F.length(x))
        first = F.slice(gaps, F.lit(1), F.least(F.size(gaps) - 1, F.lit(limit)))
        start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
        step = lambda acc, g: F.struct((acc["at"] + g + size).alias("at"), F.concat(acc["out"], F.array(acc["at"] + g)).alias("out"))
        return F.aggregate(first, start, step, lambda acc: acc["out"])

    def shown(needle: Column, offset: Column) -> Column:
        from_, to = F.greatest(F.lit(0), offset - 240), offset + F.length(needle) + 520
        return squeeze(F.substring("text", from_ + 1, to - from_))

    spots = F.flatten(F.transform("held", lambda s: F.transform(places(s), lambda at: F.struct(s.alias("needle"), at.alias("offset"), shown(s, at).alias("excerpt")))))
    rows = hits.select("conversation_id", "position", "doc", F.inline(spots)).join(asked, "needle")
    rn = F.row_number().over(W.partitionBy("query_id", "conversation_id").orderBy("position", "doc", "offset"))
    return rows.withColumn("rn", rn).filter(F.col("rn") <= limit).select("query_id", "conversation_id", "doc", "offset", "excerpt")


def read_window(requests: DataFrame, docs: DataFrame, default: int = 8000) -> DataFrame:
    """A window of a document's text. requests: request_id, doc, start, max_chars. docs: doc, text."""
    both = requests.join(docs, "doc")
    n = F.length("text")
    start = F.when(F.col("start") >= 0, F.least(F.col("start"), n)).otherwise(0).cast("int")
    size = F.when(F.col("max_chars").isNotNull(), F.greatest(F.lit(1000), F.least(F.lit(50_000), F.col("max_chars")))).otherwise(default).cast("int")
    content = F.substring("text", start + 1, size)
    end = start + F.length(content)
    return both.select("request_id", "doc", start.alias("start"), end.alias("end"), n.alias("total_characters"), (end < n).alias("has_more"), content.alias("content"))


def resolve_names(requests: DataFrame, attachments: DataFrame) -> DataFrame:
    """(request_id, id): the attachment by exact name, else by name whatever its case, else by a stem that is unique.

    requests: request_id, conversation_id, wanted. Of several equal matches the first by position counts.
    """
    asked = requests.select("request_id", "conversation_id", strip(F.regexp_replace("wanted", r"^[\s\"']+|[\s\"']+$", "")).alias("wanted"))
    a = attachments.select("conversation_id", "id", "name", "position")
    stem = F.when(F.contains("name", F.lit(".")), F.regexp_replace("name", r"\.[^.]*$", "")).otherwise("")
    keyed = a.select("*", F.explode(F.array(F.lower("name"), F.lower(stem))).alias("k"))
    both = asked.join(keyed, (asked["conversation_id"] == keyed["conversation_id"]) & (F.lower("wanted") == F.col("k")))
    rank = F.when(F.col("name") == F.col("wanted"), 0).when(F.lower("name") == F.lower("wanted"), 1).otherwise(2)
    ranked = both.select("request_id", "id", "position", "wanted", rank.alias("rank"))
    best = ranked.groupBy("request_id").agg(F.min(F.struct("rank", "position", "id")).alias("b"), F.count_distinct(F.when(F.col("rank") == 2, F.col("id"))).alias("stems"))
    found = best.filter((F.col("b.rank") < 2) | (F.col("stems") == 1)).select("request_id", F.col("b.id").alias("id"))
    return requests.select("request_id").join(found, "request_id", "left")


def plan_page_analysis(requests: DataFrame, settings: Settings = DEFAULTS, fixed: bool = False) -> DataFrame:
    """What becomes of each requested page: beyond, deferred, cached, allowed or refused, in request order.

    requests: turn, call, page, question, total_pages (null if unknown). A call takes its first pages; a (page, question)
    that an earlier call of the turn was allowed is free; the turn takes a bounded number of new ones. A call that has
    something new when the turn has used these up is refused as a whole, cached pages too: call_refused. Plans don't
    depend on outcomes.

    With fixed a call takes all pages from its first existing one up to what a call takes, whatever else was asked for,
    and the rest of the document is deferred.
    """
    asked = requests.select("turn", "call", "page", "question", "total_pages")
    if fixed:
        exists = F.col("total_pages").isNull() | (F.col("page") <= F.col("total_pages"))
        calls = asked.groupBy("turn", "call").agg(F.min(F.when(exists, F.col("page"))).alias("start"), F.first("question").alias("question"), F.max("total_pages").alias("total_pages"))
        last = F.coalesce("total_pages", F.col("start") + (settings.analyze_pages_per_call - 1)).cast("long")
        whole = calls.filter("start is not null").select("turn", "call", F.explode(F.sequence(F.col("start").cast("long"), last)).alias("page"), "question", "total_pages").withColumn("page", F.col("page").cast(requests.schema["page"].dataType))
        asked = whole.unionByName(asked.join(calls.filter("start is null").select("turn", "call"), ["turn", "call"], "left_semi"))
    page = asked.withColumn("beyond", F.coalesce(F.col("page") > F.col("total_pages"), F.lit(False)))
    place = F.row_number().over(W.partitionBy("turn", "call", "beyond").orderBy("page"))
    page = page.withColumn("deferred", ~F.col("beyond") & (place > settings.analyze_pages_per_call))
    live = page.withColumn("live", ~F.col("beyond") & ~F.col("deferred"))
    same = W.partitionBy("turn", "page", "question", "live").orderBy("call")
    first = live.withColumn("fresh", F.col("live") & (F.row_number().over(same) == 1))
    turn = W.partitionBy("turn").orderBy("call", "page")
    ranked = first.withColumn("used", F.sum(F.col("fresh").cast("int")).over(turn.rowsBetween(W.unboundedPreceding, 0)))
    granted = ranked.withColumn("ok", F.max((F.col("fresh") & (F.col("used") <= settings.max_analyzed_pages)).cast("int")).over(W.partitionBy("turn", "page", "question", "live")) == 1)
    before = F.coalesce(F.sum(F.col("fresh").cast("int")).over(W.partitionBy("turn").orderBy("call").rangeBetween(W.unboundedPreceding, -1)), F.lit(0))
    new = F.max(F.col("live") & (F.col("fresh") | ~F.col("ok"))).over(W.partitionBy("turn", "call"))
    planned = granted.withColumn("call_refused", new & (before >= settings.max_analyzed_pages))
    state = F.when(F.col("beyond"), "beyond").when(F.col("deferred"), "deferred").when(F.col("call_refused") | ~F.col("ok"), "refused").when(F.col("fresh"), "allowed").otherwise("cached")
    return planned.select("turn", "call", "page", "question", state.alias("state"), "call_refused")


def group_pages(pages: DataFrame, keys: list[str], k: int, settings: Settings = DEFAULTS) -> DataFrame:
    """Adds chunk: pages in chunks of k (1 to the limit) per call."""
    size = max(1, min(k, settings.analyze_group_max))
    return pages.withColumn("chunk", F.floor((F.row_number().over(W.partitionBy(*keys).orderBy("page")) - 1) / size))


_MARK = r"(?im)^[ \t]*\[\s*page\s+(\d+)\s*\][ \t]*:?[ \t]*"


def split_page_answers(replies: DataFrame, key: str) -> DataFrame:
    """(key, page, answer): a grouped reply cut at its [page n] marks; one row with page null if any page is missing.

    replies: key, text, pages array<int>. Of a repeated mark the first counts.
    """
    marks = F.transform(F.regexp_extract_all("text", F.lit(_MARK), F.lit(1)), lambda x: x.cast("int"))
    parts = F.slice(F.split("text", _MARK, -1), F.lit(2), F.greatest(F.size(marks), F.lit(0)))
    cut = replies.withColumns({"marks": marks, "parts": parts})
    found = F.transform("pages", lambda p: F.struct(p.alias("page"), strip(F.get("parts", F.array_position("marks", p).cast("int") - 1)).alias("answer")))
    whole = F.size(F.array_except("pages", "marks")) == 0
    rows = F.when(whole, found).otherwise(F.array(F.struct(F.lit(None).cast("int").alias("page"), F.col("text").alias("answer"))))
    return cut.select(key, F.inline(rows))


def collate_answers(answers: DataFrame, key: str) -> DataFrame:
    """(key, text, n): answers in page order; equal neighbours that answer a block of pages are listed once.

    answers: key, page, marker, answer.
    """
    own = W.partitionBy(key).orderBy("page")
    same = (F.lag("marker").over(own) == F.col("marker")) & (F.lag("answer").over(own) == F.col("answer")) & F.col("marker").startswith("pages ")
    kept = answers.withColumn("same", F.coalesce(same, F.lit(False))).filter(~F.col("same"))
    return kept.groupBy(key).agg(ordered_join("page", F.concat(F.lit("["), "marker", F.lit("] "), "answer"), "\n").alias("text"), F.count(F.lit(1)).alias("n"))


def viewed_pages(requests: DataFrame, settings: Settings = DEFAULTS) -> DataFrame:
    """What becomes of each view request: attached, repeat or refused, and dropped for pages that an analysis clears.

    requests: turn, n, kind ("view" or "analysis"), page. An analysis that runs empties the set of viewed pages.
    """
    epoch = F.sum((F.col("kind") == "analysis").cast("int")).over(W.partitionBy("turn").orderBy("n").rowsBetween(W.unboundedPreceding, 0))
    rows = requests.withColumn("epoch", epoch)
    views = rows.filter("kind = 'view'")
    first = views.withColumn("fresh", (F.row_number().over(W.partitionBy("turn", "epoch", "page").orderBy("n")) == 1).cast("int"))
    used = first.withColumn("used", F.sum("fresh").over(W.partitionBy("turn", "epoch").orderBy("n").rowsBetween(W.unboundedPreceding, 0)))
    taken = used.withColumn("taken", F.max(F.when(F.col("fresh") == 1, F.col("used") <= settings.max_viewed_pages)).over(W.partitionBy("turn", "epoch", "page")))
    last = rows.groupBy("turn").agg(F.max("epoch").alias("last_epoch"))
    state = F.when(~F.col("taken"), "refused").when(F.col("fresh") == 1, "attached").otherwise("repeat")
    return taken.join(last, "turn").select("turn", "n", "page", state.alias("state"), ((F.col("epoch") < F.col("last_epoch")) & (state == "attached")).alias("dropped"))


def resolve_page_answers(calls: DataFrame, key: str, turn: str, settings: Settings = DEFAULTS) -> DataFrame:
    """(turn, key, answer, all_failed): one answer for each page-analysis call.

    calls: key, turn, text, finish, runaway, error, local, separated, thinking_off.
    """
    cut = F.lower("finish").isin(*LENGTH_STOPS)
    answers = cut_answers(calls).select(key, F.when(F.lower("finish").isin(*LENGTH_STOPS), F.col("answer")).otherwise(F.coalesce("text", F.lit(""))).alias("text"))
    clean = clean_transcripts(answers, key).withColumnRenamed("text", "clean")
    limit = f"the output limit of {settings.vision_max_tokens} tokens"
    answer = (
        F.when(F.col("error").isNotNull(), F.concat(F.lit("ERROR: "), "error"))
        .when(F.col("runaway").isNotNull(), "(not analyzed: the model's reasoning did not finish and was stopped; the call was not retried)")
        .when(cut & (F.col("clean") != ""), F.concat("clean", F.lit(f"\n[cut off at {limit}; the rest of this answer is missing]")))
        .when(cut, f"(not analyzed: the model reached {limit} before answering; the call was not retried)")
        .when(F.col("clean") == "", "(the vision model returned no answer for this page)").otherwise(F.col("clean"))
    )
    both = calls.join(clean, key).withColumn("answer", answer)
    return both.select(turn, key, "answer", (F.min(F.col("error").isNotNull().cast("int")).over(W.partitionBy(turn)) == 1).alias("all_failed"))


def deferred_ranges(plan: DataFrame) -> DataFrame:
    """Per turn and call the deferred pages as ranges."""
    return page_ranges(plan.filter("state = 'deferred'"), ["turn", "call"], page="page")

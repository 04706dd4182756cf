"""Store maintenance and session queries over conversations, messages, attachments and traces."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from docsheaf.functions.embedded import as_text, fields, items
from docsheaf.functions.text import let, root_name, squeeze, strip

DEFAULT_TITLE = "새 채팅"
ID_PATTERN = r"^[a-zA-Z0-9-]{8,80}$"
ARTIFACT = "struct<name:string,mime:string,view:string,title:string,task:string,text:string,attachmentId:long,boxes:array<struct<x:double,y:double,w:double,h:double,label:string,type:string,confidence:double>>>"
FILE = "struct<name:string,kind:string,size:double,attachmentId:long,mime:string>"
# The white list of an answer's meta.
COUNTERS = (
    "ocrCalls", "groundingCalls", "answerCalls", "analysisCalls", "tiledImages", "tiles", "blankTiles", "ocrLengthStops", "groundingLengthStops", "analysisLengthStops", "answerReasoningForced",
    "groundingReasoningForced", "ocrReasoningForced", "analysisReasoningForced", "answerReasoningStops", "groundingReasoningStops", "ocrReasoningStops", "analysisReasoningStops", "reasoningTokens",
)
TILE_SETTINGS = ("tileSize", "overlap", "renderDpi", "minSourceEdge", "maxTiles")
CALL_KINDS = ("answer", "grounding", "ocr")
REPEAT_SETTINGS = ("repeatLines", "repeatCount", "repeatMinChars")
EFFORT = r"^[a-z0-9][a-z0-9_-]{0,23}$"


def clean_field(text: Column, most: int) -> Column:
    return F.substring(strip(text), 1, most)


def clean_title(text: Column) -> Column:
    title = F.substring(squeeze(F.coalesce(text, F.lit(""))), 1, 80)
    return F.when(title == "", DEFAULT_TITLE).otherwise(title)


def valid_ids(df: DataFrame, column: str = "id") -> DataFrame:
    return df.filter(F.col(column).rlike(ID_PATTERN))


def parse_json_list(text: Column, element: str) -> Column:
    """Bad JSON, and JSON that isn't a list, is an empty list."""
    return F.coalesce(F.from_json(text, f"array<{element}>"), F.array().cast(f"array<{element}>"))


#: Columns of the four stored tables; what ends in _json holds JSON text.
TABLES = {
    "conversations": "id string, title string, provider string, model string, created_at long, updated_at long",
    "messages": "conversation_id string, position int, role string, content string, artifacts_json string, files_json string, created_at long, meta_json string",
    "attachments": "id long, conversation_id string, position int, name string, mime string, kind string, size long, text_content string, data binary, metadata_json string, file_path string, source_path string",
    "traces": "id string, conversation_id string, created_at long, updated_at long, status string, events_json string",
}
#: Each JSON column, its table, the column that names a row in a report, and whether it holds a list or an object.
JSON_COLUMNS = (
    ("messages", "artifacts_json", "list"), ("messages", "files_json", "list"), ("messages", "meta_json", "object"), ("attachments", "metadata_json", "object"), ("traces", "events_json", "object"),
)
EVENT = "struct<id:string,kind:string,label:string,status:string,startedMs:long,endedMs:long,elapsedMs:long,parent:string,data:variant>"


def _truth(value: Column) -> Column:
    """Whether a JSON value counts as true: not null, false, 0, or an empty text."""
    return ~F.coalesce(as_text(value), F.lit("")).isin("", "false", "0", "0.0", "null")


def typed_metadata(text: Column) -> Column:
    """An attachment's metadata: its thirteen keys with their types; bad JSON has none of them."""
    empty = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>"))
    page = lambda v: F.struct(
        *[F.try_variant_get(v, f"$.{k}", kind).alias(name) for k, kind, name in (("page", "int", "page"), ("classification", "string", "classification"), ("chars", "long", "chars"), ("raster", "int", "raster"), ("rasterArea", "double", "raster_area"), ("vector", "int", "vector"), ("vlm", "boolean", "vlm"))]
    )

    def of(m: Column) -> Column:
        value = lambda k, kind: F.try_variant_get(m[k], "$", kind)
        numbers = [value(k, "long").alias(name) for k, name in (("width", "width"), ("height", "height"), ("sourceWidth", "source_width"), ("sourceHeight", "source_height"), ("pageNumber", "page_number"))]
        texts = [as_text(m[k]).alias(name) for k, name in (("pageClassification", "page_classification"), ("sourceMime", "source_mime"), ("ocrVariant", "ocr_variant"))]
        flags = [_truth(m[k]).alias(name) for k, name in (("ocrRequired", "ocr_required"), ("sendToModel", "send_to_model"))]
        counts = [F.coalesce(value(k, "long"), F.lit(0)).alias(name) for k, name in (("visualPages", "visual_pages"), ("totalPages", "total_pages"))]
        pages = F.transform(F.filter(items(m["pageAnalysis"]), lambda v: fields(v).isNotNull()), page).alias("page_analysis")
        return F.struct(*numbers, *texts, *flags, *counts, pages)

    return let(F.coalesce(fields(F.try_parse_json(text)), empty), of)


def typed_messages(messages: DataFrame) -> DataFrame:
    """Messages with their JSON columns typed: artifacts, files, and where there is a meta_json the bounded meta."""
    typed = messages.withColumns({"artifacts": parse_json_list(F.col("artifacts_json"), ARTIFACT), "files": parse_json_list(F.col("files_json"), FILE)}).drop("artifacts_json", "files_json")
    return typed.withColumn("meta", sanitize_meta(F.col("meta_json"))).drop("meta_json") if "meta_json" in messages.columns else typed


def typed_attachments(attachments: DataFrame) -> DataFrame:
    """Attachments with the keys of their metadata as columns."""
    return attachments.withColumn("m", typed_metadata(F.col("metadata_json"))).select(*[c for c in attachments.columns if c != "metadata_json"], "m.*")


def typed_traces(traces: DataFrame) -> DataFrame:
    """Traces with their events, an array that is empty where the document has none or isn't JSON."""
    event = lambda v: F.struct(*[F.try_variant_get(v, f"$.{f.split(':')[0]}", f.split(":")[1]).alias(f.split(":")[0]) for f in EVENT.removeprefix("struct<").removesuffix(">").split(",")])
    listed = F.filter(items(fields(F.try_parse_json("events_json"))["events"]), lambda v: fields(v).isNotNull())
    return traces.withColumn("events", F.coalesce(F.transform(listed, event), F.array().cast(f"array<{EVENT}>"))).drop("events_json")


def rejected_json(tables: dict[str, DataFrame]) -> DataFrame:
    """(table, conversation_id, row, column, value): stored JSON that isn't JSON or not of the kind that its column holds.
    row is a message's position, or the id of an attachment or trace. Null and empty values aren't reported."""
    out = None
    for table, column, kind in JSON_COLUMNS:
        if table in tables:
            shape = items if kind == "list" else fields
            row = F.col("position" if table == "messages" else "id").cast("string")
            bad = tables[table].filter((strip(F.col(column)) != "") & shape(F.try_parse_json(column)).isNull())
            found = bad.select(F.lit(table).alias("table"), "conversation_id", row.alias("row"), F.lit(column).alias("column"), F.col(column).alias("value"))
            out = found if out is None else out.unionByName(found)
    return out


def load_store(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """The four tables below path (Parquet, a folder each) as typed frames, and `rejected`, see rejected_json().

    Bad JSON never ends the job: it counts as empty in the typed frames. A listing that selects no `data` reads no bytes.
    """
    raw = {name: spark.read.schema(columns).parquet(f"{path}/{name}") for name, columns in TABLES.items()}
    return {
        "conversations": raw["conversations"], "messages": typed_messages(raw["messages"]), "attachments": typed_attachments(raw["attachments"]), "traces": typed_traces(raw["traces"]), "rejected": rejected_json(raw),
    }


def evolve_schema(df: DataFrame, target: DataFrame, defaults: dict) -> DataFrame:
    """df with the columns it lacks of target, filled with defaults (null where none is given)."""
    missing = [f for f in target.schema if f.name not in df.columns]
    return df.select("*", *[F.lit(defaults.get(f.name)).cast(f.dataType).alias(f.name) for f in missing]).select(*target.columns)


def derive_titles(messages: DataFrame) -> DataFrame:
    """(conversation_id, title): the first user message that isn't blank, squeezed to 80 characters."""
    said = messages.groupBy("conversation_id").agg(F.min_by(F.when((F.col("role") == "user") & (strip(F.col("content")) != ""), F.col("content")), F.when((F.col("role") == "user") & (strip(F.col("content")) != ""), F.col("position"))).alias("first"))
    return said.select("conversation_id", clean_title(F.col("first")).alias("title"))


def upsert_conversations(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """incoming: id, title (explicit or null), derived, provider, model, stamp. created_at stays; the rest is overwritten.

    Title: the explicit one, else the existing one unless it is the default, else the derived one.
    """
    old = current.select("id", F.col("title").alias("old_title"), "created_at", F.col("updated_at").alias("old_at"), F.col("provider").alias("old_provider"), F.col("model").alias("old_model"))
    both = old.join(incoming, "id", "full")
    explicit = F.when(strip(F.coalesce("title", F.lit(""))) != "", clean_title(F.col("title")))
    kept = F.when(F.col("old_title") != DEFAULT_TITLE, F.col("old_title"))
    touched = F.col("stamp").isNotNull()
    return both.select(
        "id", F.when(touched, F.coalesce(explicit, kept, clean_title(F.col("derived")))).otherwise(F.col("old_title")).alias("title"),
        F.when(touched, F.substring("provider", 1, 80)).otherwise(F.col("old_provider")).alias("provider"), F.when(touched, F.substring("model", 1, 240)).otherwise(F.col("old_model")).alias("model"),
        F.coalesce("created_at", "stamp").alias("created_at"), F.coalesce("stamp", "old_at").alias("updated_at"),
    )


def replace_messages(current: DataFrame, incoming: DataFrame, order: str = "position") -> DataFrame:
    """Conversations with incoming messages get just these, renumbered from 0; the others keep theirs."""
    kept = current.join(incoming.select("conversation_id").distinct(), "conversation_id", "left_anti")
    number = F.row_number().over(W.partitionBy("conversation_id").orderBy(order)) - 1
    return kept.unionByName(incoming.withColumn("position", number.cast(current.schema["position"].dataType)).select(*current.columns))


def upsert_attachments(current: DataFrame, incoming: DataFrame) -> DataFrame:
    """Conflicts on (conversation, name) update in place and keep the old id; positions follow the incoming list."""
    new = incoming.withColumn("position", (F.row_number().over(W.partitionBy("conversation_id").orderBy("position")) - 1).cast(current.schema["position"].dataType))
    both = current.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    own = W.partitionBy("conversation_id", "name")
    ranked = both.withColumns({"_rn": F.row_number().over(own.orderBy(F.desc("_new"), F.desc("id"))), "id": F.coalesce(F.min(F.when(F.col("_new") == 0, F.col("id"))).over(own), F.col("id"))})
    return ranked.filter("_rn = 1").select(*current.columns)


def touch_conversations(conversations: DataFrame, touched: DataFrame) -> DataFrame:
    """updated_at of the conversations in touched (id, stamp) is set to their stamp."""
    return conversations.join(touched, "id", "left").withColumn("updated_at", F.coalesce("stamp", "updated_at")).drop("stamp")


def replace_reuploads(previous: DataFrame, incoming: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(merged, removed): a new upload evicts the whole family of attachments derived from the old one."""
    roots = incoming.select("conversation_id", root_name(F.col("name")).alias("root")).distinct()
    old = previous.withColumn("root", root_name(F.col("name")))
    kept, removed = (old.join(roots, ["conversation_id", "root"], how).select(*previous.columns) for how in ("left_anti", "left_semi"))
    return kept.unionByName(incoming.select(*previous.columns)), removed


def delete_conversations(tables: dict[str, tuple[DataFrame, str]], ids: DataFrame) -> dict[str, DataFrame]:
    """Every table (frame, id column) without the given conversations; malformed ids are skipped."""
    gone = valid_ids(ids, "id").select("id").distinct()
    return {name: df.join(gone.withColumnRenamed("id", column), column, "left_anti") for name, (df, column) in tables.items()}


def deleted_count(conversations: DataFrame, ids: DataFrame) -> DataFrame:
    return conversations.join(valid_ids(ids, "id").select("id").distinct(), "id", "left_semi").agg(F.count(F.lit(1)).alias("deleted"))


def delete_all(tables: dict[str, DataFrame]) -> tuple[dict[str, DataFrame], DataFrame]:
    """Every table empty, and (deleted): how many conversations there were."""
    return {name: df.limit(0) for name, df in tables.items()}, tables["conversations"].agg(F.count(F.lit(1)).alias("deleted"))


def delete_attachments(attachments: DataFrame, gone: DataFrame) -> DataFrame:
    """Attachments without those named by gone: conversation_id, id. An id of another conversation deletes nothing."""
    return attachments.join(gone.select("conversation_id", "id").distinct(), ["conversation_id", "id"], "left_anti").select(*attachments.columns)


def session_list(conversations: DataFrame, messages: DataFrame, attachments: DataFrame, limit: int = 100) -> DataFrame:
    """The latest conversations with counts of messages and of attachments other than documents and page images."""
    m = messages.groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("message_count"))
    files = attachments.filter((F.col("kind") != "document") & ~F.col("name").like("% · page %"))
    f = files.groupBy(F.col("conversation_id").alias("id")).agg(F.count(F.lit(1)).alias("file_count"))
    rows = conversations.join(m, "id", "left").join(f, "id", "left").na.fill(0, ["message_count", "file_count"])
    return rows.orderBy(F.desc("updated_at"), F.desc("id")).limit(max(1, min(500, limit)))


def public_attachments(attachments: DataFrame) -> DataFrame:
    """Listing without bytes: what a client may see of each attachment."""
    a = attachments
    return a.select(
        "conversation_id", "position", "id", "name", "mime", "kind", "size", F.length(F.coalesce("text", F.lit(""))).alias("parsed_characters"), "has_data",
        F.when(F.col("page_number") > 0, F.col("page_number")).alias("page_number"), F.when(F.col("total_pages") > 0, F.col("total_pages")).alias("total_pages"),
        F.when(F.col("has_data"), F.concat(F.lit("/api/attachments/"), F.col("id").cast("string"), F.lit("/content"))).alias("url"),
    )


def session_detail(conversations: DataFrame, messages: DataFrame, attachments: DataFrame) -> DataFrame:
    """Conversations with their messages in order and what a client may see of their attachments in order.

    A message has role and content, and of created_at, artifacts, files and meta those that messages has.
    """
    said = ["role", "content", *[c for c in ("created_at", "artifacts", "files", "meta") if c in messages.columns]]
    ordered = lambda order, own: F.transform(F.sort_array(F.collect_list(F.struct(*order, F.struct(*own).alias("own")))), lambda x: x["own"])
    m = messages.groupBy(F.col("conversation_id").alias("id")).agg(ordered(["position"], said).alias("messages"))
    public = public_attachments(attachments)
    shown = [c for c in public.columns if c not in ("conversation_id", "position")]
    a = public.groupBy(F.col("conversation_id").alias("id")).agg(ordered(["position", F.col("id").alias("number")], shown).alias("attachments"))
    return conversations.join(m, "id", "left").join(a, "id", "left")


def trace_listing(traces: DataFrame, conversation_id: str | None = None) -> DataFrame:
    """Traces by conversation, creation and insertion, with their number in that order."""
    own = traces if conversation_id is None else traces.filter(F.col("conversation_id") == conversation_id)
    return own.withColumn("number", F.row_number().over(W.partitionBy("conversation_id").orderBy("created_at", "id")))


def sanitize_messages(raw: DataFrame, now: Column, most: int = 500, most_chars: int = 4_000_000) -> DataFrame:
    """The first messages of each conversation with known roles, bounded content and a positive time; meta for assistants only."""
    first = raw.withColumn("_rn", F.row_number().over(W.partitionBy("conversation_id").orderBy("position"))).filter(F.col("_rn") <= most)
    assistant = F.coalesce(F.col("role") == "assistant", F.lit(False))
    return first.select(
        "conversation_id", "position", F.when(assistant, "assistant").otherwise("user").alias("role"), F.substring(F.coalesce("content", F.lit("")), 1, most_chars).alias("content"),
        F.when(assistant, F.col("meta")).alias("meta"), F.when(F.col("created_at") > 0, F.col("created_at")).otherwise(now).alias("created_at"),
    )


def _some(text: Column, most: int) -> Column:
    return F.when(F.coalesce(text, F.lit("")) != "", clean_field(text, most))


def sanitize_artifacts(raw: Column) -> Column:
    """At most 12 artifacts of a JSON list with bounded fields and at most 200 boxes that have all four numbers."""
    def box(b: Column) -> Column:
        return F.struct(b["x"].alias("x"), b["y"].alias("y"), b["w"].alias("w"), b["h"].alias("h"), _some(b["label"], 80).alias("label"), _some(b["type"], 24).alias("type"),
                        F.when(b["confidence"].isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), b["confidence"]))).alias("confidence"))

    def clean(a: Column) -> Column:
        boxes = F.filter(F.slice(F.coalesce(a["boxes"], F.array().cast("array<struct<x:double,y:double,w:double,h:double,label:string,type:string,confidence:double>>")), 1, 200), lambda b: b["x"].isNotNull() & b["y"].isNotNull() & b["w"].isNotNull() & b["h"].isNotNull())
        either = lambda c, default, most: clean_field(F.coalesce(F.when(a[c] != "", a[c]), F.lit(default)), most).alias(c)
        return F.struct(either("name", "artifact", 240), either("mime", "application/octet-stream", 160), F.when(a["view"] == "image", "image").alias("view"), _some(a["title"], 240).alias("title"), _some(a["task"], 500).alias("task"),
                        F.when(a["text"] != "", F.substring(a["text"], 1, 20_000)).alias("text"), a["attachmentId"].alias("attachmentId"), F.when(F.size(boxes) > 0, F.transform(boxes, box)).alias("boxes"))

    return F.transform(F.filter(F.slice(parse_json_list(raw, ARTIFACT), 1, 12), lambda a: a.isNotNull()), clean)


def sanitize_files(raw: Column) -> Column:
    """At most 24 files of a JSON list with bounded fields and sizes of at least 0."""
    def clean(f: Column) -> Column:
        either = lambda c, default, most: clean_field(F.coalesce(F.when(f[c] != "", f[c]), F.lit(default)), most).alias(c)
        return F.struct(either("name", "attachment", 240), either("kind", "binary", 24), F.greatest(F.lit(0), F.coalesce(f["size"], F.lit(0.0)).cast("long")).alias("size"), f["attachmentId"].alias("attachmentId"), _some(f["mime"], 160).alias("mime"))

    return F.transform(F.filter(F.slice(parse_json_list(raw, FILE), 1, 24), lambda f: f.isNotNull()), clean)


def _fields(names: tuple[str, ...], kind: str) -> str:
    return ",".join(f"{n}:{kind}" for n in names)


META = (
    f"struct<imageMode:string,tiling:struct<{_fields(TILE_SETTINGS, 'double')}>,vision:struct<{_fields(COUNTERS, 'double')}>,elapsedMs:double,"
    f"thinkingDisabled:struct<{_fields(CALL_KINDS, 'boolean')}>,visionMaxTokens:double,reasoning:struct<budget:struct<{_fields(CALL_KINDS, 'double')}>,{_fields(REPEAT_SETTINGS, 'double')}>,"
    f"reasoningEffort:struct<{_fields(CALL_KINDS, 'string')}>,reasoningActions:array<struct<kind:string,image:string,reason:string,stopped:boolean>>,answerImageMode:string,"
    "answerImages:struct<sent:double,candidates:double,names:array<string>>,viewedPages:struct<limit:double,refused:double,dropped:double,names:array<string>>,"
    "analyzedPages:struct<enabled:boolean,calls:double,limit:double,refused:double,names:array<string>,group:string,range:string>,traceId:string>"
)


def sanitize_meta(raw: Column) -> Column:
    """The white list of an answer's meta. Numbers are clamped; a group appears only with the members it needs."""
    m = F.from_json(raw, META)
    held = lambda c, high: F.when(c.isNotNull() & ~F.isnan(c), F.greatest(F.lit(0.0), F.least(F.lit(float(high)), c)))
    whole = lambda c, high: held(c, high).cast("long")
    every = lambda cs: sum_true([c.isNotNull() for c in cs]) == len(cs)
    some = lambda cs: sum_true([c.isNotNull() for c in cs]) > 0
    part = lambda group, names, high: [held(m[group][n], high).alias(n) for n in names]
    names = lambda group, most: F.transform(F.slice(F.filter(F.coalesce(m[group]["names"], F.array().cast("array<string>")), lambda x: x.isNotNull()), 1, most), lambda x: F.substring(x, 1, 300)).alias("names")
    counts = lambda group, keys, high: [whole(m[group][k], high).alias(k) for k in keys]
    needed = lambda group, keys: every([m[group][k] for k in keys])
    level = lambda k: F.when(F.lower(strip(m["reasoningEffort"][k])).rlike(EFFORT), F.lower(strip(m["reasoningEffort"][k]))).alias(k)
    actions = F.filter(F.slice(F.coalesce(m["reasoningActions"], F.array().cast("array<struct<kind:string,image:string,reason:string,stopped:boolean>>")), 1, 60), lambda a: F.coalesce(a["kind"].isin(*CALL_KINDS), F.lit(False)))
    cut = F.transform(actions, lambda a: F.struct(a["kind"].alias("kind"), F.substring(F.coalesce(a["image"], F.lit("")), 1, 300).alias("image"), F.substring(F.coalesce(a["reason"], F.lit("")), 1, 40).alias("reason"), F.coalesce(a["stopped"], F.lit(False)).alias("stopped")))
    budget = m["reasoning"]["budget"]
    reasoning = F.when(every([m["reasoning"][n] for n in REPEAT_SETTINGS]) & (budget.isNull() | every([budget[k] for k in CALL_KINDS])), F.struct(
        F.struct(*[whole(budget[k], 10_000_000).alias(k) for k in CALL_KINDS]).alias("budget"), *[whole(m["reasoning"][n], 10_000).alias(n) for n in REPEAT_SETTINGS]))
    group = m["analyzedPages"]["group"]
    size = F.when(group == "auto", group).when(group.rlike(r"^[0-9]{1,9}$") & (group.cast("long") >= 1), F.least(group.cast("long"), F.lit(1000)).cast("string"))
    return F.struct(
        F.when(m["imageMode"].isin("whole", "tile"), m["imageMode"]).alias("imageMode"), F.when(some([m["tiling"][n] for n in TILE_SETTINGS]), F.struct(*part("tiling", TILE_SETTINGS, 1_000_000))).alias("tiling"),
        F.when(some([m["vision"][n] for n in COUNTERS]), F.struct(*part("vision", COUNTERS, 1_000_000_000))).alias("vision"), whole(m["elapsedMs"], 86_400_000).alias("elapsedMs"),
        F.when(some([m["thinkingDisabled"][k] for k in CALL_KINDS]), m["thinkingDisabled"]).alias("thinkingDisabled"), F.when(held(m["visionMaxTokens"], 1_000_000) > 0, whole(m["visionMaxTokens"], 1_000_000)).alias("visionMaxTokens"),
        reasoning.alias("reasoning"), F.when(m["reasoningEffort"].isNotNull(), F.struct(*map(level, CALL_KINDS))).alias("reasoningEffort"), F.when(F.size(cut) > 0, cut).alias("reasoningActions"),
        F.when(m["answerImageMode"].isin("off", "uploads", "whole", "auto"), m["answerImageMode"]).alias("answerImageMode"),
        F.when(needed("answerImages", ("sent", "candidates")), F.struct(*counts("answerImages", ("sent", "candidates"), 1_000_000), names("answerImages", 200))).alias("answerImages"),
        F.when(needed("viewedPages", ("limit", "refused", "names")), F.struct(names("viewedPages", 200), *counts("viewedPages", ("limit", "refused", "dropped"), 100_000))).alias("viewedPages"),
        F.when(needed("analyzedPages", ("enabled", "calls", "limit", "refused", "names")), F.struct(m["analyzedPages"]["enabled"].alias("enabled"), names("analyzedPages", 1000), *counts("analyzedPages", ("calls", "limit", "refused"), 100_000),
            size.alias("group"), F.when(m["analyzedPages"]["range"].isin("free", "fixed"), m["analyzedPages"]["range"]).alias("range"))).alias("analyzedPages"),
        F.when(m["traceId"].rlike(ID_PATTERN), m["traceId"]).alias("traceId"),
    )


def sum_true(conditions: list[Column]) -> Column:
    total = F.lit(0)
    for c in conditions:
        total = total + c.cast("int")
    return total


def monotone_stamps(df: DataFrame, keys: list[str], order: str, ts: str = "ts") -> DataFrame:
    """Adds stamp = max(ts, previous stamp + 1) in order within the keys."""
    own = W.partitionBy(*keys).orderBy(order)
    i = F.row_number().over(own)
    numbered = df.withColumn("_i", i)
    return numbered.withColumn("stamp", F.col("_i") + F.max(F.col(ts) - F.col("_i")).over(own.rowsBetween(W.unboundedPreceding, 0))).drop("_i")


def link_uploaded_files(messages: DataFrame, uploads: DataFrame) -> DataFrame:
    """(conversation_id, position, files): files of the message, uploads it lacks added, linked to attachments by root.

    messages: conversation_id, position, files array<struct<name, kind, size>>. uploads: conversation_id, id, name, mime, kind, size, n.
    """
    own = messages.select("conversation_id", "position", F.posexplode_outer("files").alias("n", "f")).select("conversation_id", "position", "n", F.col("f.name").alias("name"), F.col("f.kind").alias("kind"), F.col("f.size").alias("size")).filter("name is not null")
    have = own.select("conversation_id", "position", "name").distinct()
    offered = messages.select("conversation_id", "position").join(uploads.select("conversation_id", "name", "kind", "size", (F.col("n") + 1000).alias("n")), "conversation_id")
    every = own.unionByName(offered.join(have, ["conversation_id", "position", "name"], "left_anti").select(*own.columns))
    saved = uploads.withColumn("root", root_name(F.col("name"))).groupBy("conversation_id", F.col("root").alias("name")).agg(F.max_by(F.struct("id", "mime", "kind"), "n").alias("s"))
    linked = every.join(saved, ["conversation_id", "name"], "left")
    item = F.struct("n", F.struct("name", F.coalesce("s.kind", "kind").alias("kind"), "size", F.col("s.id").alias("attachmentId"), F.col("s.mime").alias("mime")).alias("f"))
    return linked.groupBy("conversation_id", "position").agg(F.transform(F.sort_array(F.collect_list(item)), lambda x: x["f"]).alias("files"))


def upsert_artifacts(artifacts: DataFrame, turn: str, order: str = "n") -> DataFrame:
    """The last artifact of each name in a turn, in the slot of the first."""
    rest = [c for c in artifacts.columns if c not in (turn, "name", order)]
    g = artifacts.groupBy(turn, "name").agg(F.max_by(F.struct(*rest), order).alias("x"), F.min(order).alias("slot"))
    return g.select(turn, "name", "x.*", F.row_number().over(W.partitionBy(turn).orderBy("slot")).alias("slot"))


def resolve_content(attachments: DataFrame, files: DataFrame, blobs: DataFrame) -> DataFrame:
    """(id, content): the original upload's file if one is kept, else the primary file, else the bytes in the table.

    attachments: id, file_path, source_path. files: path, content (as the binaryFile reader gives them). blobs: id, data.
    """
    by = lambda path, name: files.select(F.col("path").alias(path), F.col("content").alias(name))
    both = attachments.join(by("source_path", "original"), "source_path", "left").join(by("file_path", "primary_content"), "file_path", "left").join(blobs, "id", "left")
    return both.select("id", F.coalesce("original", "primary_content", "data").alias("content"))

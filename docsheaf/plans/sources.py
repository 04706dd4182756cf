"""Registered queries of sources, sinks and plug points, and of the streaming forms."""

from __future__ import annotations

from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import functions as F

from docsheaf import fixtures as X
from docsheaf.functions.folds import fold_by_key
from docsheaf.functions.readers import batch_read, ledger_read, read_pages
from docsheaf.operators import transcripts as T
from docsheaf.session import shared_folder
from docsheaf.sources import uploads as U
from docsheaf.plans.telemetry import J4_ROWS, REPETITION, call_lines, chunk_rows
from docsheaf.streaming import calls as C
from docsheaf.streaming import ordered as O
from docsheaf.streaming import streams as S


def _files(spark, sf_dir):
    d = X.table(spark, sf_dir, "documents")
    name = F.concat(F.lit("dir\\"), F.when(F.col("doc_id") % 4 == 0, F.lit("Scan")).otherwise(F.lit("scan · x")), F.when(F.col("doc_id") % 7 == 0, ".txt").when(F.col("doc_id") % 2 == 0, ".pdf").otherwise(".PNG"))
    head = F.when(F.col("doc_id") % 6 == 0, "  %PDF-1.7").otherwise(F.substring("text", 1, 16))
    return d.select(F.floor(F.col("doc_id") / 15).alias("batch"), F.col("doc_id").alias("n"), name.alias("name"), F.lit("").alias("mime"), F.octet_length("text").cast("long").alias("size"), head.cast("binary").alias("head"))


def a1_check_uploads(spark, sf_dir):
    return U.check_uploads(_files(spark, sf_dir)).select("n", "name", "mime", "kind", "reason")


def _written_files(spark, sf_dir):
    """A folder with a file for each document, written by the tasks that have it; every eleventh file is empty."""
    folder = shared_folder(spark)
    local = folder.removeprefix("file://").removeprefix("file:")
    rows = _files(spark, sf_dir).select("batch", "n", F.regexp_replace("name", r"^dir\\", "").alias("name"), F.col("head").cast("string").alias("head"))

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                target = Path(local) / f"b{row['batch']:06}"
                target.mkdir(parents=True, exist_ok=True)
                (target / f"{row['n']:08} {row['name']}").write_bytes(b"" if row["n"] % 11 == 0 else row["head"].encode() + b" and what follows" * 100)
            yield pa.RecordBatch.from_arrays([pa.array([batch.num_rows])], names=["files"])

    rows.mapInArrow(write, "files long").agg(F.sum("files")).collect()
    return folder


def a1_scan_uploads(spark, sf_dir):
    accepted, rejected = U.scan_uploads(spark, _written_files(spark, sf_dir))
    columns = ["batch", "name", "mime", "kind", "size", "reason"]
    return accepted.select(*columns).unionByName(rejected.select(*columns))


def a2_uniquify_names(spark, sf_dir):
    return U.uniquify_names(U.check_uploads(_files(spark, sf_dir)).filter("reason is null").select("batch", "n", "name"), ["batch"], "n")


def a3_storage_layout(spark, sf_dir):
    a = X.attachments(spark, sf_dir).select("id", F.when(F.col("id") % 9 == 0, F.concat(F.lit("CON?"), "name")).otherwise(F.col("name")).alias("name"), "mime", (F.col("id") % 5 == 3).alias("resized"))
    return U.storage_layout(a).select("id", "file_name", "source_name")


def a6_write_events_ndjson(spark, sf_dir):
    folder = shared_folder(spark)
    e = X.trace_events(spark, sf_dir).select("turn", "seq", "kind", "status")
    U.write_events_ndjson(e, folder)
    return spark.read.schema(e.schema).json(folder)


def a6_stream_events_ndjson(spark, sf_dir):
    """Events that come in any order over three micro-batches, written in order of their turns."""
    e = X.trace_events(spark, sf_dir).select("turn", (F.col("seq") - 1).alias("seq"), "kind", "status", F.timestamp_millis(F.lit(1_700_000_000_000) + F.col("started_ms")).alias("at"))
    folder, stream = _in_three(spark, e, "turn", "seq")
    U.stream_events_ndjson(O.in_order(stream, "turn", "kind string, status string").drop("at"), f"{folder}/out", f"{folder}/state").awaitTermination()
    return spark.read.schema("turn long, seq int, kind string, status string").json(f"{folder}/out").select("turn", (F.col("seq") + 1).alias("seq"), "kind", "status")


def k1_ledger_read(spark, sf_dir):
    def reader(content, attempt: int) -> dict:
        return {"text": content if (len(content) + attempt) % 3 else "", "finish": "stop"}

    return ledger_read(X.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", reader, shared_folder(spark), flush=100)


def a8_read_truth(spark, sf_dir):
    b = X.boxes(spark, sf_dir)
    box = F.struct(F.col("label"), F.array(F.col("x") * 2000, F.col("y") * 1000, (F.col("x") + F.col("w")) * 2000, (F.col("y") + F.col("h")) * 1000).alias("bbox"))
    raw = b.groupBy(F.col("page").alias("path")).agg(F.transform(F.sort_array(F.collect_list(F.struct("box_no", box.alias("t")))), lambda x: x["t"]).alias("targets"))
    raw = raw.select("path", F.struct(F.lit(2000.0).alias("width"), F.lit(1000.0).alias("height")).alias("image"), "targets", F.slice("targets", 1, 1).alias("distractors"))
    return U.scaled_truth(raw).select("path", "role", "n", "label", *[F.round(c, 6).alias(c) for c in "xywh"])


def _read(spark, sf_dir, how):
    def reader(content, attempt: int) -> dict:
        return {"text": content if (len(content) + attempt) % 3 else "", "finish": "stop"}

    return how(X.table(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id", "text", reader)


def k1_batch_read(spark, sf_dir):
    return _read(spark, sf_dir, batch_read)


def k2_read_then_resolve(spark, sf_dir):
    def cleaned(a):
        fixed = (F.lit("").alias("partial"), F.lit(None).cast("string").alias("runaway"), F.lit(False).alias("tile"))
        return F.struct(a["attempt"].alias("attempt"), a["text"].alias("clean"), a["finish"].alias("finish"), a["error"].alias("error"), *fixed)

    read = _read(spark, sf_dir, read_pages)
    return T.resolve_pages(read.select("doc_id", F.transform("attempts", cleaned).alias("attempts")), "doc_id")


def k2_fold_by_key(spark, sf_dir):
    """Events of a user with the number of events since its value was last higher: a result that hangs on earlier ones."""

    def fold(own: Iterator[dict]) -> Iterator[dict]:
        peaks: list[tuple[float, int]] = []
        for n, row in enumerate(own, 1):
            while peaks and peaks[-1][0] <= row["value"]:
                peaks.pop()
            yield {"user_id": row["user_id"], "event_id": row["event_id"], "since_higher": n - peaks[-1][1] if peaks else n}
            peaks.append((row["value"], n))

    e = X.table(spark, sf_dir, "events").select("user_id", "ts", "event_id", "value")
    return fold_by_key(e, ["user_id"], ["ts", "event_id"], fold, "user_id long, event_id long, since_higher long")


def _streamed(spark, frame, transform, mode: str = "append"):
    """Writes frame as files, runs transform over them as a stream to its end and returns what came out."""
    folder = shared_folder(spark)
    frame.write.parquet(f"{folder}/in")
    out = transform(spark.readStream.schema(frame.schema).parquet(f"{folder}/in"))
    writer = out.writeStream.outputMode(mode).format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def _in_three(spark, frame, *keys):
    """frame as a stream of three micro-batches, each with rows of every key from all over it. They are written by as many
    tasks as a shuffle has, a third of the files for each."""
    folder = shared_folder(spark)
    files = -(-int(spark.conf.get("spark.sql.shuffle.partitions")) // 3)
    frame.repartition(3 * files, F.xxhash64(*keys)).write.parquet(f"{folder}/in")
    return folder, spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/in").withWatermark("at", "30 days")


def _chunk_stream(spark, rows, transform):
    """Runs transform over the chunks in three micro-batches."""
    last = F.max("seq").over(C.W.partitionBy("call_id"))
    at = F.timestamp_seconds(F.lit(1_700_000_000) + F.col("seq"))
    folder, stream = _in_three(spark, rows.withColumns({"seq": F.col("seq").cast("long"), "at": at, "last": F.col("seq") == last}), "call_id", "seq")
    out = transform(stream)
    writer = out.writeStream.outputMode("append").format("parquet").option("path", f"{folder}/out").option("checkpointLocation", f"{folder}/state")
    writer.trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(out.schema).parquet(f"{folder}/out")


def js1_watch_calls_stream(spark, sf_dir):
    return _chunk_stream(spark, X.chunks(spark, sf_dir), lambda s: O.watch_calls(s, 100)).drop("at")


def js2_repetition_stream(spark, sf_dir):
    lines = call_lines(spark, sf_dir).select("call_id", (F.col("pos") - 1).alias("seq"), F.concat("line", F.lit("\n")).alias("piece"))
    return _chunk_stream(spark, lines, lambda s: O.watch_calls(s, 0)).select("call_id", (F.col("seq") + 1).alias("pos"), "verdict")


def js3_split_think_stream(spark, sf_dir):
    piece = F.when(F.col("seq") % 20 == 5, F.concat("piece", F.lit("<thi"))).when(F.col("seq") % 20 == 6, F.concat(F.lit("nk>"), "piece")).when(F.col("seq") % 20 == 12, F.concat("piece", F.lit("</think>"))).otherwise(F.col("piece"))
    split = _chunk_stream(spark, X.chunks(spark, sf_dir).select("call_id", "seq", piece.alias("piece")), O.split_think_stream)
    return split.groupBy("call_id").agg(F.sum(F.length("reasoning")).alias("reasoning_chars"), F.sum(F.length("content")).alias("content_chars"))


def js5_throttle_stream(spark, sf_dir):
    e = X.table(spark, sf_dir, "events").select(F.col("user_id").alias("call_id"), F.row_number().over(C.W.partitionBy("user_id").orderBy("ts", "event_id")).cast("long").alias("seq"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("at"))
    return _streamed(spark, e, lambda s: S.throttle_stream(s, 3600.0))


def js4_assemble_stream(spark, sf_dir):
    """The calls of j4 through splitter, monitor and assembler: the same rows as of the batch form."""
    return _chunk_stream(spark, chunk_rows(spark, sf_dir), O.answer_calls).select("call_id", "text", "reasoning", "finish", "tokens", "tool_calls")


def js7_upsert_trace_stream(spark, sf_dir):
    folder = shared_folder(spark)
    e = X.trace_events(spark, sf_dir).select(F.col("turn").cast("string").alias("turn"), F.col("seq").alias("version"), F.concat_ws(":", "kind", "label", F.col("elapsed_ms").cast("string")).alias("document"))
    e.repartition(6, "version").write.parquet(f"{folder}/in")
    stream = spark.readStream.schema(e.schema).option("maxFilesPerTrigger", 1).parquet(f"{folder}/in")
    S.upsert_trace_stream(stream, f"{folder}/out", f"{folder}/state", available_now=True).awaitTermination()
    return S.latest_traces(spark, f"{folder}/out")


def js8_live_turns_stream(spark, sf_dir):
    e = X.trace_events(spark, sf_dir).select("turn", F.col("seq").cast("long").alias("seq"), F.when((F.col("turn") % 3 == 0) & (F.col("seq") % 50 == 49), "end").otherwise(F.col("kind")).alias("kind"), "status", "started_ms")
    return S.live_now(_streamed(spark, e, S.live_turn_updates))


ORACLES = {
    "a1_check_uploads": """SELECT n, name, mime, CASE WHEN mime = 'application/pdf' THEN 'pdf' ELSE 'image' END AS kind, CASE WHEN place > 12 THEN 'too many files' WHEN mime LIKE '%octet%' THEN 'type not allowed' WHEN size = 0 THEN 'empty file' WHEN mime = 'application/pdf' AND n % 6 <> 0 THEN 'not a PDF file' END AS reason FROM
 (SELECT doc_id AS n, strlen(text) AS size, row_number() OVER (PARTITION BY doc_id // 15 ORDER BY doc_id) AS place, CASE WHEN doc_id % 4 = 0 THEN 'Scan' ELSE 'scan - x' END || CASE WHEN doc_id % 7 = 0 THEN '.txt' WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.PNG' END AS name,
  CASE WHEN doc_id % 7 = 0 THEN 'application/octet-stream' WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE 'image/png' END AS mime FROM documents)""",
    "a1_scan_uploads": """WITH f AS (SELECT doc_id AS n, 'b' || lpad((doc_id // 15)::VARCHAR, 6, '0') AS batch, lpad(doc_id::VARCHAR, 8, '0') || CASE WHEN doc_id % 4 = 0 THEN ' Scan' ELSE ' scan - x' END || CASE WHEN doc_id % 7 = 0 THEN '.txt' WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.PNG' END AS name,
 CASE WHEN doc_id % 7 = 0 THEN 'application/octet-stream' WHEN doc_id % 2 = 0 THEN 'application/pdf' ELSE 'image/png' END AS mime, CASE WHEN doc_id % 11 = 0 THEN 0 ELSE 1700 + strlen(CASE WHEN doc_id % 6 = 0 THEN '  %PDF-1.7' ELSE substr(text, 1, 16) END) END AS size, row_number() OVER (PARTITION BY doc_id // 15 ORDER BY doc_id) AS place FROM documents)
 SELECT batch, name, mime, CASE WHEN mime = 'application/pdf' THEN 'pdf' ELSE 'image' END AS kind, size, CASE WHEN place > 12 THEN 'too many files' WHEN mime LIKE '%octet%' THEN 'type not allowed' WHEN size = 0 THEN 'empty file' WHEN mime = 'application/pdf' AND n % 6 <> 0 THEN 'not a PDF file' END AS reason FROM f""",
    "a2_uniquify_names": """WITH f AS (SELECT doc_id // 15 AS batch, doc_id AS n, row_number() OVER (PARTITION BY doc_id // 15 ORDER BY doc_id) AS place, CASE WHEN doc_id % 4 = 0 THEN 'Scan' ELSE 'scan - x' END AS stem, CASE WHEN doc_id % 7 = 0 THEN '.txt' WHEN doc_id % 2 = 0 THEN '.pdf' ELSE '.PNG' END AS ext, strlen(text) AS size FROM documents),
 a AS (SELECT *, row_number() OVER (PARTITION BY batch, stem, ext ORDER BY n) AS k FROM f WHERE place <= 12 AND ext <> '.txt' AND size > 0 AND (ext <> '.pdf' OR n % 6 = 0)) SELECT batch, n, stem || CASE WHEN k > 1 THEN ' (' || k || ')' ELSE '' END || ext AS name FROM a""",
    "k1_batch_read": "WITH d AS (SELECT doc_id, text, unnest([1, 2, 3]) AS attempt FROM documents), r AS (SELECT doc_id, attempt, CASE WHEN (length(text) + attempt) % 3 <> 0 THEN text ELSE '' END AS text FROM d), o AS (SELECT *, coalesce(bool_or(text <> '') OVER (PARTITION BY doc_id ORDER BY attempt ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS done FROM r) SELECT doc_id, attempt, text, 'stop' AS finish, CAST(NULL AS VARCHAR) AS error FROM o WHERE NOT done",
    "k2_fold_by_key": "WITH e AS (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events) SELECT a.user_id, a.event_id, a.n - coalesce(max(b.n), 0) AS since_higher FROM e a LEFT JOIN e b ON b.user_id = a.user_id AND b.n < a.n AND b.value > a.value GROUP BY a.user_id, a.event_id, a.n",
    "js3_split_think_stream": X.oracle("v_chunk", r""", p AS (SELECT call_id, string_agg(CASE seq % 20 WHEN 5 THEN piece || '<thi' WHEN 6 THEN 'nk>' || piece WHEN 12 THEN piece || '</think>' ELSE piece END, '' ORDER BY seq) AS u FROM v_chunk GROUP BY call_id),
 q AS (SELECT call_id, u AS t FROM p), r AS (SELECT call_id, regexp_replace(t, '(?s)<think>.*?(</think>|$)', '', 'g') AS content, list_sum(list_transform(regexp_extract_all(t, '(?s)<think>(.*?)(?:</think>|$)', 1), lambda x: length(x))) AS n FROM q) SELECT call_id, coalesce(n, 0)::BIGINT AS reasoning_chars, length(content) AS content_chars FROM r"""),
    "a3_storage_layout": X.oracle("v_att", """SELECT id, CASE WHEN page_number IS NOT NULL THEN p || regexp_replace(name, ' · page [0-9]+$', '') || '.page-' || lpad(page_number::VARCHAR, 4, '0') || '.png' WHEN id % 5 = 3 THEN p || 'u' || id || '.model.png'
 WHEN name LIKE '%visual OCR' THEN p || replace(name, ' · ', '.') ELSE p || name END AS file_name, CASE WHEN id % 5 = 3 THEN p || name END AS source_name FROM (SELECT *, CASE WHEN id % 9 = 0 THEN 'CON_' ELSE '' END AS p FROM v_att)"""),
    "a6_write_events_ndjson": X.oracle("v_event", "SELECT turn, seq, kind, status FROM v_event"),
    "a8_read_truth": X.oracle("v_box", "SELECT page AS path, 'target' AS role, box_no - 1 AS n, label, round(x, 6) AS x, round(y, 6) AS y, round(w, 6) AS w, round(h, 6) AS h FROM v_box UNION ALL SELECT page, 'distractor', 0, label, round(x, 6), round(y, 6), round(w, 6), round(h, 6) FROM v_box WHERE box_no = 1"),
    "js2_repetition_stream": X.oracle("v_line", REPETITION + "SELECT call_id, min(pos) AS pos, 'repeat' AS verdict FROM hits GROUP BY call_id"),
    "js4_assemble_stream": X.oracle("v_chunk", J4_ROWS),
    "js5_throttle_stream": """WITH RECURSIVE e AS (SELECT user_id AS call_id, epoch_us(ts::TIMESTAMP) / 1e6 AS t, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
 k AS (SELECT call_id, t, n FROM e WHERE n = 1 UNION ALL SELECT call_id, t, n FROM (SELECT e.*, min(e.n) OVER (PARTITION BY e.call_id) AS first FROM k JOIN e ON e.call_id = k.call_id AND e.n > k.n AND e.t - k.t >= 3600) WHERE n = first)
 SELECT call_id, n AS seq, t AS "at" FROM k""",
    "js7_upsert_trace_stream": X.oracle("v_event", "SELECT turn::VARCHAR AS turn, max(seq) AS version, arg_max(kind || ':' || label || ':' || elapsed_ms, seq) AS document FROM v_event GROUP BY turn"),
    "js8_live_turns_stream": X.oracle("v_event", "SELECT turn, min(started_ms) AS started_ms, max(started_ms) AS last_ms, count(*) FILTER (status = 'running') AS open_spans FROM v_event GROUP BY turn HAVING NOT bool_or(turn % 3 = 0 AND seq % 50 = 49)"),
    "js1_watch_calls_stream": X.oracle("v_chunk", ", r AS (SELECT call_id, seq, piece, greatest(sum((length(piece) > 0)::INT) OVER w, sum(length(piece)) OVER w // 4) AS tokens FROM v_chunk WINDOW w AS (PARTITION BY call_id ORDER BY seq)) SELECT call_id, min(seq)::BIGINT AS seq, 'budget' AS verdict, arg_min(tokens, seq) AS tokens FROM r WHERE tokens > 100 AND length(piece) > 0 GROUP BY call_id"),
}
ORACLES["k1_ledger_read"] = ORACLES["k1_batch_read"]
ORACLES["a6_stream_events_ndjson"] = ORACLES["a6_write_events_ndjson"]
QUERIES = {k: v for k, v in dict(globals()).items() if k[:2] in ("a1", "a2", "a3", "a6", "a8", "k1", "k2", "js")}

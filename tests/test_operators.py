"""Operators on literal rows with known results."""

import difflib
import random
import subprocess
import sys

import pytest
from pyspark.sql import functions as F
from pyspark.sql.classic.dataframe import DataFrame

from docsheaf.functions import containment
from docsheaf.functions.readers import batch_read, read_pages
from docsheaf.operators import dialogue, evidence, pages, regions, store, telemetry, tiles, transcripts
from docsheaf.plans import pages as page_plans
from docsheaf.plans import sources as source_plans
from docsheaf.sources import uploads
from docsheaf.streaming import calls, streams
from tests.conftest import SF


@pytest.mark.parametrize(
    ("chars", "raster", "vector", "kind", "vlm"),
    [
        (0, 0, 0, "unknown", True), (0, 0, 50, "vector-outlines", True), (0, 1, 0, "scanned-raster", True), (23, 0, 9, "vector-outlines", True), (24, 0, 0, "native-vector", False),
        (24, 1, 0, "mixed-needs-vision", True), (119, 2, 0, "mixed-needs-vision", True), (120, 2, 0, "mixed-native", False), (5000, 0, 900, "native-vector", False),
    ],
)
def test_classes_at_the_edges(spark, chars, raster, vector, kind, vlm):
    row = pages.classify_pages(spark.createDataFrame([(chars, raster, vector)], "chars int, raster int, vector int")).first()
    assert (row.classification, row.needs_vlm) == (kind, vlm)


def test_letters_and_digits(spark):
    df = spark.createDataFrame([("도면번호 A-1024,  수량: 4개!\r\n\n\n\nx ",)], "native_text string")
    row = pages.page_text_stats(df).first()
    assert row.clean_text == "도면번호 A-1024, 수량: 4개!\n\nx" and row.chars == 14


def test_paint_operators(spark):
    df = spark.createDataFrame([(1, 1, "0 0 m 5 5 l S (a S f) Tj\nB* f"), (1, 2, "S"), (2, 1, "q Q")], "page int, stream_no int, content string")
    assert {tuple(r) for r in pages.count_paint_ops(df, ["page"]).collect()} == {(1, 4), (2, 0)}


def test_page_lists(spark):
    df = spark.createDataFrame([(1, "7"), (2, "1-3"), (3, "2, 5,7–9"), (4, "3~4"), (5, "x"), (6, "5-2"), (7, ""), (8, None), (9, "0")], "k int, spec string")
    got = {r.k: (r.pages, r.error is None) for r in pages.expand_page_specs(df, ["k"]).collect()}
    assert got[1] == ([7], True) and got[2] == ([1, 2, 3], True) and got[3] == ([2, 5, 7, 8, 9], True) and got[4] == ([3, 4], True)
    assert all(not got[k][1] and got[k][0] is None for k in (5, 6, 7, 8, 9))


def test_plan_of_large_sheets(spark):
    df = spark.createDataFrame([(1, 6622, 4677), (2, 9362, 6622), (3, 2048, 100), (4, 3000, 40)], "image_id int, width int, height int")
    n = {r.image_id: r["count"] for r in tiles.plan_tiles(df).groupBy("image_id").count().collect()}
    assert n[1] == 20 and n[2] == 35 and 3 not in n and n[4] == 3


def test_blank_tile_takes_the_lowest_mode(spark):
    rows = [(1, 255, 1000), (1, 0, 0), (2, 255, 500), (2, 0, 500), (3, 10, 0)]
    got = {r.tile: (r.background, r.blank) for r in tiles.blank_tiles(spark.createDataFrame(rows, "tile int, bin int, count long"), ["tile"]).collect()}
    assert got[1] == (255, True) and got[2] == (0, False) and got[3][1]


def test_loops_are_cut(spark):
    rows = [(1, "a<start_of_image>\n" + "[UNCLEAR]\n\n" * 300), (2, "\n".join(["x"] * 8)), (3, "\n".join(["  row"] * 40)), (4, None)]
    got = {r.k: r.text for r in transcripts.clean_transcripts(spark.createDataFrame(rows, "k int, text string"), "k").collect()}
    assert got[1] == "a\n[UNCLEAR]" and got[2] == "\n".join(["x"] * 8) and got[4] == ""
    assert got[3] == "  row\n  row\n  row\n[REPEATED LINE OMITTED x37: likely a model repetition loop]"


def test_usable(spark):
    rows = [("Sorry, I cannot read this.",), ("[UNCLEAR]",), (" ",), ("이 이미지는 도면",), (None,), ("Sorrywell done",)]
    assert {r.text for r in transcripts.filter_transcripts(spark.createDataFrame(rows, "text string")).collect()} == {"[UNCLEAR]", "Sorrywell done"}


def test_cut_answers(spark):
    rows = [(1, "t</think>ans", True, False, False), (2, "<think>open", False, False, False), (3, "plain", True, False, False), (4, "plain", True, True, False), (5, "plain", False, False, False)]
    df = spark.createDataFrame(rows, "k int, text string, local boolean, separated boolean, thinking_off boolean").withColumn("finish", F.lit("Length"))
    assert {tuple(r) for r in transcripts.salvage_cutoff(df, "k").collect()} == {(1, "ans"), (2, ""), (3, ""), (4, "plain"), (5, "plain")}


def test_overlap_lines_do_not_cascade(spark):
    rows = [(1, 1, c, (c - 1) * 0.3, 0.0, (c - 1) * 0.3 + 0.4, 0.4, "GENERAL NOTES\n2\n[UNCLEAR]", "ok") for c in (1, 2, 3)]
    df = spark.createDataFrame(rows, "page long, row int, col int, x0 double, y0 double, x1 double, y1 double, text string, status string")
    got = {r.col: r.text for r in transcripts.drop_overlap_lines(df).collect()}
    assert got == {1: "GENERAL NOTES\n2\n[UNCLEAR]", 2: "2\n[UNCLEAR]", 3: "GENERAL NOTES\n2\n[UNCLEAR]"}


def test_boxes_merge_across_tiles_only(spark):
    rows = [(1, 1, 1, "stamp", 0.40, 0.10, 0.10, 0.10, 0.6, "a"), (1, 2, 2, "stamp", 0.41, 0.10, 0.10, 0.11, 0.9, "b"), (1, 2, 3, "stamp", 0.41, 0.10, 0.10, 0.11, 0.9, "c"), (1, 3, 4, "text", 0.41, 0.10, 0.10, 0.11, None, "d")]
    df = spark.createDataFrame(rows, "page long, tile int, box_no int, type string, x double, y double, w double, h double, confidence double, label string")
    got = sorted((r.type, r.label, round(r.w, 6), round(r.h, 6), r.boxes) for r in regions.merge_tile_boxes(df).collect())
    assert got == [("stamp", "b", 0.11, 0.11, 2), ("stamp", "c", 0.1, 0.11, 1), ("text", "d", 0.1, 0.11, 1)]


def test_scores(spark):
    box = "run long, {} int, x double, y double, w double, h double"
    predicted = spark.createDataFrame([(1, 0, 0.1, 0.1, 0.2, 0.3), (1, 1, 0.5, 0.5, 0.2, 0.2), (1, 2, 0.9, 0.9, 0.05, 0.05), (1, 3, 0.7, 0.1, 0.1, 0.1)], box.format("box_no"))
    truth = spark.createDataFrame([(1, 0, 0.1, 0.1, 0.2, 0.3), (1, 1, 0.5, 0.5, 0.2, 0.3), (1, 2, 0.3, 0.8, 0.1, 0.1)], box.format("target"))
    scores = regions.score_boxes(predicted, truth)
    assert sorted((r.target, r.iou) for r in scores.collect()) == [(0, 1.0), (1, 0.667), (2, 0.0)]
    s = regions.score_summary(scores, predicted).first()
    assert (s.hits, s.unmatched, s.mean_iou) == (2, 2, 0.556)
    assert regions.distractor_hits(predicted, spark.createDataFrame([(1, 0.7, 0.1, 0.1, 0.1)], "run long, x double, y double, w double, h double")).first().on_distractor == 1


def test_region_replies(spark):
    body = '{"text":"t","regions":[{"bbox":[0,0,10,10],"label":"a","type":"text"}]}'
    rows = [(1, body), (2, f"```json\n{body}\n```"), (3, f"Sure: {body} ok"), (4, "3600"), (5, '"none"'), (6, '[{"box_2d":[1,2,3,4]}]'), (7, f"<think>{{}}</think>{body}"), (8, None)]
    got = {r.k: (r.structured, len(r.regions)) for r in regions.parse_regions(spark.createDataFrame(rows, "k int, reply string"), "k").collect()}
    assert got == {1: (True, 1), 2: (True, 1), 3: (True, 1), 4: (False, 0), 5: (False, 0), 6: (True, 1), 7: (True, 1), 8: (False, 0)}


def test_tool_calls_in_text(spark):
    rows = [(1, '<tool_call>{"name":"search","arguments":{"q":"x"}}</tool_call> rest'), (2, '```json\n{"tool":"search","args":{}}\n```'), (3, '{"tool_calls": [{"name": "search", "arguments": {"a": 1} ]}'), (4, '{"name":"unknown","arguments":{}}'), (5, '{"tool_calls": "search"'), (6, '{"tool_calls": broken "search"')]
    df = spark.createDataFrame(rows, "k int, content string")
    got = {r.k: (len(r.calls), r.rest) for r in dialogue.extract_tool_calls(df, ["search"], "k").collect()}
    assert got[1] == (1, "rest") and got[2] == (1, "") and got[3] == (1, "") and got[4][0] == got[5][0] == got[6][0] == 0
    assert {r.k for r in dialogue.flag_malformed_envelopes(df, ["search"], "k").collect()} == {5, 6}


def test_odd_replies_do_not_end_the_job(spark):
    deep = "[" * 100_000
    rows = [(1, '{"name": ["search"], "x": "search"}'), (2, '{"tool_calls": [7, null, {"function": {"name": {"search": 1}}}, {"function": {"name": "search", "arguments": "{\\"q\\": 1}"}}]}'), (3, deep + '"search"'), (4, '"search" ' + '{"a":' * 100_000), (5, '{"name": "search", "arguments": ' + '{"a":' * 100_000), (6, '{"name": "search", "args": null}')]
    df = spark.createDataFrame(rows, "k int, content string")
    got = {r.k: [(c.name, c.arguments) for c in r.calls] for r in dialogue.extract_tool_calls(df, ["search"], "k").collect()}
    assert got == {1: [], 2: [("search", '{"q":1}')], 3: [], 4: [], 5: [], 6: [("search", "{}")]}
    replies = spark.createDataFrame([(1, deep), (2, '{"a":' * 100_000), (3, 'x [{"bbox":[0,0,1,1]}]'), (3, "none")], "k int, reply string")
    assert sorted((r.k, r.structured) for r in regions.parse_regions(replies, "k").collect()) == [(1, False), (2, False), (3, False), (3, True)]


def test_stitching_stops(spark):
    rows = [(1, 0, "a", "length"), (1, 1, "b", "length"), (1, 2, "b", "stop"), (2, 0, "a", "stop"), (2, 1, "b", "stop"), (3, 0, "a", "length"), (3, 1, "", "length"), (3, 2, "c", "stop")]
    got = {r.k: (r.text, r.pieces) for r in dialogue.stitch_continuations(spark.createDataFrame(rows, "k int, n int, text string, finish string"), "k").collect()}
    assert got == {1: ("a\n\nb", 2), 2: ("a", 1), 3: ("a", 1)}


def test_coverage_preview_keeps_every_block(spark):
    text = "\n\n".join(f"[VISUAL SOURCE: a.pdf · page {k}]\n" + "x" * 900 for k in range(1, 5))
    out = spark.createDataFrame([(text,)], "t string").select(evidence.coverage_preview(F.col("t"), F.lit(1200)).alias("o")).first().o
    assert out.startswith("[COVERAGE PREVIEW: all 4 visual sources") and all(f"page {k}]" in out for k in range(1, 5)) and len(out) <= 1200


def test_clip_keeps_both_ends(spark):
    out = spark.createDataFrame([("a" * 500 + "b" * 500,)], "t string").select(evidence.clip(F.col("t"), 280).alias("o")).first().o
    assert out == "a" * 100 + "\n\n...[truncated 800 chars]...\n\n" + "b" * 100


def sequential_repetition(lines, most=8, times=3, chars=24):
    for pos in range(1, len(lines) + 1):
        for n in range(1, most + 1):
            if n * times > pos:
                break
            block = lines[pos - n : pos]
            if sum(map(len, block)) >= chars and all(lines[pos - n * (k + 1) : pos - n * k] == block for k in range(1, times)):
                return pos, n
    return None


def test_repetition_equals_a_sequential_detector(spark):
    random.seed(3)
    data = {c: [random.choice(["alpha beta gamma", "x", "delta epsilon"]) for _ in range(random.randint(3, 40))] for c in range(120)}
    data[200] = ["Okay."] * 10
    data[201] = [f"line number {k % 8}" for k in range(-1, 320)]
    rows = [(c, k + 1, line) for c, lines in data.items() for k, line in enumerate(lines)]
    got = {r.call_id: (r.pos, r.length) for r in calls.repetition(spark.createDataFrame(rows, "call_id int, pos int, line string")).collect()}
    assert got == {c: found for c, lines in data.items() if (found := sequential_repetition(lines))}
    assert 200 not in got or got[200] == sequential_repetition(data[200])


def _stream(spark, tmp_path, frame, transform, files=3):
    frame.repartitionByRange(files, "seq").sortWithinPartitions("seq").write.parquet(f"{tmp_path}/in")
    out = transform(spark.readStream.schema(frame.schema).option("maxFilesPerTrigger", 100).parquet(f"{tmp_path}/in"))
    q = out.writeStream.format("memory").queryName("t" + str(abs(hash(str(tmp_path))))).trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.sql(f"SELECT * FROM {q.name}")


def test_live_turns_on_a_stream(spark, tmp_path):
    rows = [("a", 1, "llm", "running", 10), ("a", 2, "llm", "ok", 20), ("b", 1, "llm", "ok", 5), ("b", 2, "end", "ok", 9)]
    frame = spark.createDataFrame(rows, "turn string, seq long, kind string, status string, started_ms long")
    updates = _stream(spark, tmp_path, frame, streams.live_turn_updates)
    assert [tuple(r) for r in streams.live_now(updates).collect()] == [("a", 10, 20, 1)] == [tuple(r) for r in streams.live_turns(frame).collect()]


def test_expected_strings_are_counted_within_the_row_of_a_text(spark, tmp_path):
    rows = [(k, f"line {k}\r\n\u00a0needle  {k}\n\n[UNCLEAR]\rlast" if k % 50 == 0 else None if k == 3 else f"one\n two {k}") for k in range(200)]
    spark.createDataFrame(rows, "k int, text string").write.parquet(f"{tmp_path}/t")
    expected = spark.createDataFrame([("Needle 50",), ("needle 50",), ("needle\t1",), ("two 7",)], "item string")
    got = transcripts.expectation_report(spark.read.parquet(f"{tmp_path}/t"), expected, "k")
    found = {r.k: (r.found, r.lines, r.exact, r.expected) for r in got.collect()}
    assert found[50] == (2, 3, 1, 4) and found[100] == (1, 3, 1, 4) and found[0] == (0, 3, 0, 4) and found[3] == (0, 0, 0, 4) and found[7] == found[77] == (1, 2, 1, 4) and found[8] == (0, 2, 0, 4)
    assert len(found) == 200 and "Generate posexplode" not in got._jdf.queryExecution().executedPlan().toString()


def test_coordinates_are_columns(spark):
    """Null, infinite and missing numbers, images without a size, and no function of array items, which isn't compiled."""
    raw = [(1, [0.1, 0.2, 0.3, 0.4], None, None, 0.0), (2, [0.1, None, 0.3, 0.4], None, None, 10.0), (3, [0.1, 0.2, float("inf"), 0.4], None, None, 10.0), (4, [0.1, float("nan"), 0.3, 0.4], None, None, 10.0), (5, [1.0, 2.0], [100.0, 200.0, 300.0, 5000.0], None, 10000.0), (6, None, None, [200.0, 100.0, 400.0, 1200.0], None), (7, None, None, None, 5.0), (8, [0.5, 0.5, 0.5, 0.9], None, None, 1.0)]
    rows = spark.createDataFrame([("p", *r, r[-1]) for r in raw], "page string, n int, bbox array<double>, bbox_2d array<double>, box_2d array<double>, image_width double, image_height double")
    out = regions.normalize_coords(rows, ["page"])
    got = {r.n: tuple(round(v, 6) for v in (r.x, r.y, r.w, r.h)) for r in out.collect()}
    assert got == {1: (0.1, 0.2, 0.2, 0.2), 5: (0.01, 0.02, 0.02, 0.48), 6: (0.1, 0.2, 0.9, 0.2)}
    assert "lambda" not in out._jdf.queryExecution().optimizedPlan().toString()


def test_unrelated_lines(spark):
    texts = spark.createDataFrame([(1, "DRAWING NO A-1024\nDRAWNG NO A-1O24\n[TILE r1c1]\nA cat sits on a sofa\nno a")], "k int, text string")
    expected = spark.createDataFrame([("Drawing No  A-1024",)], "item string")
    assert [r.line for r in transcripts.unrelated_lines(texts, expected, "k").collect()] == ["A cat sits on a sofa"]


def test_lines_resemble_as_difflib_says():
    """Strings on both sides of 200 characters, from where difflib starts no block at a popular character; some only share a
    beginning of popular ones."""
    rng = random.Random(4)
    targets = ["".join(rng.choice("aaaabcd efghij") for _ in range(n)) for n in (*range(190, 210), 300, 301, 40, 3)] + ["ab" * 120 + "x", "ab" * 120]
    lines = ["ab" * 110, "ab" * 120 + "y", "b" + "ab" * 130]
    for k in range(300):
        line = list(rng.choice(targets))
        for _ in range(rng.randint(0, len(line) * 2 // 3)):
            line[rng.randrange(len(line))] = rng.choice("aab cxyz")
        lines.append("".join(line)[: rng.choice([60, 200, 400])])
    whole = transcripts.Resembled(targets, 0.6)
    want = [any(t in x or x in t or difflib.SequenceMatcher(None, x, t).ratio() >= 0.6 for t in targets) for x in lines]
    assert [whole.contained(x) or whole.any(x) for x in lines] == want and 20 < sum(want) < 290


def test_unrelated_lines_read_their_texts_twice_whatever_their_number(spark, tmp_path):
    """Strings that are null are none. The lines aren't searched for in blocks of them, each of which would read all texts."""
    spark.createDataFrame([(k, f"{k} of many lines {'x y ' * 2000}") for k in range(700)], "k int, text string").write.parquet(f"{tmp_path}/t")
    expected = spark.createDataFrame([("12 of",), (None,)], "item string")
    found = transcripts.unrelated_lines(spark.read.parquet(f"{tmp_path}/t"), expected, "k")
    assert found._jdf.queryExecution().executedPlan().toString().count("FileScan") <= 2
    assert {r.k for r in found.collect()} == {k for k in range(700) if "12 of" not in f"{k} of"}


def test_unrelated_lines_over_blocks(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choices("abcdef", k=rng.randint(3, 7)))
    items = [" ".join(word() for _ in range(rng.randint(1, 5))) for _ in range(60)]
    lines = [rng.choice([lambda: rng.choice(items), lambda: rng.choice(items)[1:], lambda: rng.choice(items)[:-3] + word(), lambda: word(), lambda: word() + " " + word(), lambda: "x " + rng.choice(items)])() for _ in range(200)]
    same = lambda x: " ".join(x.split()).lower()

    def unrelated(line):
        a = same(line)
        return not any(t in a or a in t or difflib.SequenceMatcher(None, a, t).ratio() >= 0.6 for t in map(same, items))

    texts = spark.createDataFrame([(k, "\n".join(lines[k * 10 : k * 10 + 10])) for k in range(20)], "k int, text string")
    expected = spark.createDataFrame([(i,) for i in items], "item string")
    want = sorted((k, n, x) for k in range(20) for n, x in enumerate(y.strip() for y in lines[k * 10 : k * 10 + 10]) if x and unrelated(x))
    for block in (7, 2000):
        assert sorted(tuple(r) for r in transcripts.unrelated_lines(texts, expected, "k", block=block).collect()) == want
    assert want and transcripts.unrelated_lines(texts, spark.createDataFrame([("",)], "item string"), "k").count() == 0


def test_containing_needs_no_nested_loop(spark):
    texts = spark.createDataFrame([(1, "the cat sat"), (2, "a dog"), (3, ""), (4, "ca" * 50), (5, "é😀中文")], "k int, t string")
    strings = spark.createDataFrame([("cat",), ("a",), ("og",), ("",), ("dog",), ("aca",), ("zzz",), ("😀中",)], "s string")
    want = {(1, "cat"), (1, "a"), (2, "a"), (2, "og"), (2, "dog"), (4, "a"), (4, "aca"), (5, "😀中")}
    for block in (2, 100):
        got = containment.containing(texts, ["k"], "t", strings, "s", block)
        assert {(r.k, s) for r in got.collect() for s in r.held} == want
    plan = evidence.search_documents(strings.selectExpr("1 AS query_id", "s AS query"), texts.selectExpr("1 AS conversation_id", "k AS position", "k AS doc", "t AS text"))._jdf.queryExecution().optimizedPlan().toString()
    assert "Cartesian" not in plan and all("contains(" not in line for line in plan.split("\n") if "Join" in line)


def test_search_places_and_excerpts(spark):
    docs = spark.createDataFrame([("c", 1, "d1", "Aa aA.aa x"), ("c", 2, "d2", "none"), ("c", 3, "d3", "y aa"), ("d", 1, "d4", "AAA"), ("d", 2, "d5", None)], "conversation_id string, position int, doc string, text string")
    asked = spark.createDataFrame([(1, " aa "), (2, "a.a"), (3, "x"), (4, "AA")], "query_id int, query string")
    got = sorted((r.query_id, r.conversation_id, r.doc, r.offset) for r in evidence.search_documents(asked, docs, limit=3).collect())
    hits = [("c", "d1", 0), ("c", "d1", 3), ("c", "d1", 6), ("d", "d4", 0)]
    assert got == [(1, *h) for h in hits] + [(2, "c", "d1", 4)] + [(4, *h) for h in hits]


def test_uploads_from_files(spark, tmp_path):
    folder = tmp_path / "batch1"
    folder.mkdir()
    for name, data in (("a.pdf", b"%PDF-1.7 x"), ("b.pdf", b"nope"), ("c.txt", b"x"), ("d.JPG", b"x"), ("e.png", b""), ("f.pdf", b"\n\r\t " * 60 + b"%PDF-1.4"), ("g.pdf", b"")):
        (folder / name).write_bytes(data)
    accepted, rejected = uploads.scan_uploads(spark, str(tmp_path))
    assert {(r.name, r.mime) for r in accepted.collect()} == {("a.pdf", "application/pdf"), ("d.JPG", "image/jpeg"), ("f.pdf", "application/pdf")}
    assert {(r.name, r.reason) for r in rejected.collect()} == {("b.pdf", "not a PDF file"), ("c.txt", "type not allowed"), ("e.png", "empty file"), ("g.pdf", "empty file")}


def test_names_within_a_batch(spark):
    names = {1: ["a.pdf", "A.PDF", "a.pdf", "b", "b"], 2: ["a.pdf", "a (2).pdf", "a.pdf", "A (2).pdf", "a (2) (2).pdf"], 3: [".png", ".png", "x.tar.gz", "X.tar.gz"]}
    rows = [(b, k, n) for b, own in names.items() for k, n in enumerate(own)]
    got = uploads.uniquify_names(spark.createDataFrame(rows, "batch int, n int, name string"), ["batch"], "n").collect()
    made = {b: [r.name for r in sorted(got, key=lambda r: r.n) if r.batch == b] for b in names}
    assert made[1] == ["a.pdf", "A (2).PDF", "a (3).pdf", "b", "b (2)"] and made[3] == [".png", " (2).png", "x.tar.gz", "X.tar (2).gz"]
    assert made[2] == ["a.pdf", "a (2).pdf", "a (3).pdf", "A (2) (2).pdf", "a (2) (2) (2).pdf"]


def test_safe_file_names(spark):
    names = ["e\u0301t\u00e9.pdf", "CON", "con.txt", " ..a:b?.pdf. ", "x" * 120 + ".jpeg", "a.b.c", "no_ext.12345678901", "...", "a  \t b .png", "\u1112\u1161\u11ab.png", "a · page 1.png", None]
    got = [r.f for r in spark.createDataFrame(list(enumerate(names)), "k int, n string").orderBy("k").select("k", uploads.safe_filename(F.col("n")).alias("f")).orderBy("k").collect()]
    assert got == ["\u00e9t\u00e9.pdf", "_CON", "_con.txt", "a_b_.pdf", "x" * 91 + ".jpeg", "a.b.c", "no_ext.12345678901", "file", "a _ b.png", "\ud55c.png", "a.page 1.png", "file"]


def test_truth_files(spark, tmp_path):
    (tmp_path / "t.json").write_text('{"image":{"width":2000,"height":1000},"targets":[{"label":"a","bbox":[200,100,600,400]}]}')
    row = uploads.read_truth(spark, str(tmp_path / "t.json")).first()
    assert (row.role, row.x, row.y, round(row.w, 6), round(row.h, 6)) == ("target", 0.1, 0.1, 0.2, 0.3)


def test_reader_is_tried_again(spark):
    def reader(content, attempt):
        if content == "bad":
            raise ValueError("no")
        return {"text": "read" if attempt == 2 else ""}

    rows = batch_read(spark.createDataFrame([(1, "ok"), (2, "bad")], "k int, c string"), "k", "c", reader).collect()
    assert [(r.k, r.attempt, r.text, r.error) for r in sorted(rows, key=lambda r: (r.k, r.attempt))] == [(1, 1, "", None), (1, 2, "read", None), (2, 1, None, "no"), (2, 2, None, "no"), (2, 3, None, "no")]


def test_unknown_parents_become_roots(spark):
    rows = [(1, 1, None), (1, 2, 1), (1, 3, 2), (1, 4, 99), (1, 5, 4)]
    got = {r.seq: (r.depth, r.path, r.children) for r in telemetry.span_tree(spark.createDataFrame(rows, "turn int, seq int, parent int")).collect()}
    assert got == {1: (0, "1", 1), 2: (1, "1/2", 1), 3: (2, "1/2/3", 0), 4: (0, "4", 1), 5: (1, "4/5", 0)}


def test_deep_span_trees_and_circles(spark):
    rows = [(1, k, k - 1 if k > 1 else None) for k in range(1, 301)] + [(2, 1, 2), (2, 2, 1), (2, 3, None), (2, 4, 3), (2, 5, 5)]
    got = {(r.turn, r.seq): (r.depth, r.path) for r in telemetry.span_tree(spark.createDataFrame(rows, "turn int, seq int, parent int")).collect()}
    assert len(got) == 302 and got[1, 300] == (299, "/".join(map(str, range(1, 301)))) and got[2, 4] == (1, "3/4") and (2, 1) not in got and (2, 5) not in got


def test_meta_groups_only_when_complete(spark):
    rows = [('{"tiling":{"overlap":-2},"imageMode":"tile","answerImages":{"sent":1}}',), ('{"reasoning":{"repeatLines":8}}',), ("broken",), (None,)]
    got = [r.m for r in spark.createDataFrame(rows, "j string").select(store.sanitize_meta(F.col("j")).alias("m")).collect()]
    assert got[0].tiling.overlap == 0 and got[0].imageMode == "tile" and got[0].answerImages is None
    assert got[1].reasoning is None and got[2].tiling is None and got[3].imageMode is None


def test_library_does_without_the_training_data_operators():
    code = "import sys; sys.modules['docsheaf.llm'] = None; import docsheaf.catalog as c; print(len(c.QUERIES))"
    assert int(subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout) > 100

def test_paint_operators_behind_the_scan_limit(spark, tmp_path, monkeypatch):
    """The query counts the whole of every page, as its SQL does, whatever the operator's own limit."""
    monkeypatch.setattr(pages, "SCAN_CHARS", 5)
    text = ["S (a S " + "b" * 50_000 + "\\) f) the f*", "sh B " * 3]
    spark.createDataFrame([(k, t, "a") for k, t in enumerate(text)], "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    assert [tuple(r) for r in page_plans.c4_count_paint_ops(spark, str(tmp_path)).collect()] == [("a", 9)]
    streams = spark.createDataFrame([("a", 0, "S f S f"), ("a", 1, "S")], "page string, stream_no long, content string")
    assert pages.count_paint_ops(streams, ["page"], scan_chars=3).collect()[0].vector == 2


def test_tiles_of_one_file_are_planned_by_all_tasks(spark, tmp_path):
    """And of the least power of 0.95 that fits, as a search from the first one on finds it."""
    sizes = [(k, 2000 + 7919 * k % 30_000, 500 + 104_729 * k % 20_000) for k in range(60)]
    spark.createDataFrame(sizes, "image_id long, width long, height long").coalesce(1).write.parquet(f"{tmp_path}/in")
    got = tiles.plan_tiles(spark.read.parquet(f"{tmp_path}/in"))
    assert got.rdd.getNumPartitions() == 4
    count = lambda n: 1 if n <= 1536 else -(-(n - 192) // 1344)
    want = {}
    for k, w, h in (s for s in sizes if max(s[1:]) > 2048):
        scale = 1.0
        while count(max(1, round(w * scale))) * count(max(1, round(h * scale))) > 48 and max(round(w * scale), round(h * scale)) > 1536:
            scale *= 0.95
        want[k] = scale
    assert {r.image_id: r.scale for r in got.collect()} == want


def test_tasks_grow_with_the_input(spark, tmp_path, monkeypatch):
    """Readers without a bound of their own take the parts of the scan; rounds of box matching deal pairs to more tasks."""
    spark.range(60).selectExpr("id as doc_id", "repeat('a', 10) as text").repartition(12).write.parquet(f"{tmp_path}/documents.parquet")
    monkeypatch.setattr(regions, "TASK_PAIRS", 2)
    conf, old = spark.conf, spark.conf.get("spark.sql.files.maxPartitionBytes")
    conf.set("spark.sql.files.maxPartitionBytes", "1k")
    try:
        assert source_plans.k1_batch_read(spark, str(tmp_path)).rdd.getNumPartitions() > 4
    finally:
        conf.set("spark.sql.files.maxPartitionBytes", old)
    dealt, whole = [], DataFrame.repartition
    monkeypatch.setattr(DataFrame, "repartition", lambda self, *by: dealt.append(by) or whole(self, *by))
    box = spark.range(30).selectExpr("id as run", "1 as box_no", "0.1 as x", "0.1 as y", "0.2 as w", "0.2 as h")
    got = regions.score_boxes(box, box.withColumnRenamed("box_no", "target")).collect()
    assert len(got) == 30 and all(r.iou == 1 for r in got) and (15, "run") in dealt


def test_attempts_are_resolved_where_they_were_read(spark):
    """As rows and with their pages: the same results, the latter without a shuffle of the texts."""
    rng, fields = random.Random(5), "attempt int, clean string, partial string, finish string, runaway string, tile boolean, error string"
    pick = lambda *some: rng.choice(some)
    one = lambda n: (n, pick("a text", "", None, "No text.", "Sorry, no"), pick("", None, "cut"), pick("stop", "LENGTH", None), pick(None, None, None, "loop: x"), pick(True, False, None), pick(None, None, "down"))
    tries = {k: [one(n) for n in rng.sample(range(1, 6), rng.randint(0, 4))] for k in range(300)}
    pages = spark.createDataFrame(list(tries.items()), f"key long, attempts array<struct<{fields.replace(' ', ':').replace(',:', ',')}>>")
    rows = spark.createDataFrame([(k, *a) for k, some in tries.items() for a in some], f"key long, {fields}")
    got = transcripts.resolve_pages(pages, "key")
    want = sorted(tuple(r) for r in transcripts.resolve_attempts(rows, "key").collect())
    assert sorted(tuple(r) for r in got.collect()) == want and {r[1] for r in want} == {"ok", "empty", "failed"} and len({r[2] for r in want}) > 7
    plan = source_plans.k2_read_then_resolve(spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "MapInPandas" in plan and "Exchange" not in plan


def test_pages_are_read_with_all_their_attempts(spark):
    def reader(content, attempt):
        if content == "bad" or attempt < 2:
            raise ValueError(f"{content} {attempt}")
        return {"text": content * attempt, "finish": "stop"}

    pages = spark.createDataFrame([("p", "bad"), ("q", "x"), (None, "y")], "page string, content string")
    bad = [(1, None, "", "bad 1"), (2, None, "", "bad 2"), (3, None, "", "bad 3")]
    want = {"p": bad, "q": [(1, None, "", "x 1"), (2, "xx", "stop", None)], None: [(1, None, "", "y 1"), (2, "yy", "stop", None)]}
    assert {r.page: [tuple(a) for a in r.attempts] for r in read_pages(pages, "page", "content", reader).collect()} == want
    rows = batch_read(pages, "page", "content", reader)
    assert rows.columns == ["page", "attempt", "text", "finish", "error"]
    assert {tuple(r) for r in rows.collect()} == {(k, *a) for k, some in want.items() for a in some}

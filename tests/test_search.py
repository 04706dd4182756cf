"""Searches by stored postings, by rare pieces and in blocks, against plain loops."""

import difflib
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from docsheaf.functions import containment
from docsheaf.functions.containment import containing
from docsheaf.operators import evidence, regions, search_index, transcripts

DOCS = "conversation_id string, position int, doc long, text string"
TEXTS = [
    "The quick brown fox; the quick brown dog.", "brown dog the quick", "THE QUICK BROWN FOX\njumps", None, "", "a--b -- c", "naïve Straße 東京 x", "the the the the quick", "fox", "quickbrown fox the", "x" * 50 + " the quick brown fox " + "y" * 900,
]
NEEDLES = [" quick brown ", "the quick brown fox", "ick bro", "fo", "--", "straße 東京", "the the", "no such words at all", "q", "x the quick brown fox y", "brown dog.", ". ", "京 x"]


def docs(spark, texts, first=0):
    return spark.createDataFrame([(f"c{k % 2}", k, k, t) for k, t in enumerate(texts, first)], DOCS)


def plain(texts, needles, limit=12):
    out = []
    for n, needle in enumerate(needles):
        small = needle.strip().lower()
        if len(small) < 2:
            continue
        for conv in ("c0", "c1"):
            found = []
            for k, text in enumerate(texts):
                if f"c{k % 2}" == conv and text is not None:
                    at = text.lower().find(small)
                    while at >= 0:
                        found.append((n, conv, k, at, " ".join(text[max(0, at - 240) : at + len(small) + 520].split())))
                        at = text.lower().find(small, at + len(small))
            out += found[:limit]
    return sorted(out)


def asked(spark):
    return spark.createDataFrame(list(enumerate(NEEDLES)), "query_id int, query string")


def test_index_finds_what_a_plain_search_finds(spark, tmp_path):
    all_docs, want = docs(spark, TEXTS), plain(TEXTS, NEEDLES)
    search_index.write_index(all_docs, f"{tmp_path}/i")
    assert sorted(tuple(r) for r in search_index.search_index(asked(spark), all_docs, f"{tmp_path}/i").collect()) == want
    assert sorted(tuple(r) for r in evidence.search_documents(asked(spark), all_docs).collect()) == want and len(want) > 20
    assert {r[2] for r in want if NEEDLES[r[0]] == "the quick brown fox"} == {0, 2, 10}


def test_refresh_indexes_new_and_changed_texts_only(spark, tmp_path):
    path, old = f"{tmp_path}/i", ["the old words here", "stays as it is here", None]
    new = ["the new words here", "stays as it is here", "no longer null here", "one more text here"]
    search_index.write_index(docs(spark, old), path)
    search_index.refresh_index(docs(spark, new), path)
    search_index.refresh_index(docs(spark, new), path)
    listed = spark.read.parquet(f"{path}/docs").groupBy("number").agg(F.sort_array(F.collect_list("doc")).alias("d")).collect()
    assert {r.number: r.d for r in listed} == {0: [0, 1], 1: [0, 2, 3]}
    needles = spark.createDataFrame([(0, "x old words y"), (1, "old words"), (2, "new words"), (3, "as it is"), (4, "longer null")], "query_id int, query string")
    got = search_index.search_index(needles, docs(spark, new), path).collect()
    assert sorted((r.query_id, r.doc) for r in got) == [(2, 0), (3, 1), (4, 2)]
    found = search_index.candidates(spark.createDataFrame([("the old words here",), ("the new words here",)], "string string"), docs(spark, new), path)
    assert sorted(tuple(r) for r in found.collect()) == [("the new words here", 0)]


def test_search_in_a_folder_of_many_equal_words(spark, tmp_path):
    rng = random.Random(2)
    texts = [" ".join(rng.choice("a b c".split()) for _ in range(rng.randint(0, 30))) for _ in range(60)]
    needles = [" ".join(rng.choice("a b c".split()) for _ in range(rng.randint(3, 5))) for _ in range(20)]
    ask = spark.createDataFrame(list(enumerate(needles)), "query_id int, query string")
    search_index.write_index(docs(spark, texts), f"{tmp_path}/i")
    assert sorted(tuple(r) for r in search_index.search_index(ask, docs(spark, texts), f"{tmp_path}/i").collect()) == plain(texts, needles)


def test_index_has_a_row_for_each_term_of_a_run(spark, tmp_path):
    """Not one for each word of a text; and the texts aren't shuffled to meet the few that are found."""
    some = docs(spark, TEXTS).coalesce(1)
    want = sorted((w, k, at) for k, t in enumerate(TEXTS) if t is not None for at, w in enumerate(re.split(r"[\W_]+", t.lower())) if w)
    for run_words, runs in ((10**6, 1), (3, 10)):
        path = f"{tmp_path}/{run_words}"
        search_index.write_index(some, path, run_words)
        rows = spark.read.parquet(f"{path}/terms").collect()
        assert sorted((r.term, d, at) for r in rows for d, at in zip(r.docs, r.ats, strict=True)) == want
        assert max(Counter(r.term for r in rows).values()) <= runs and all(r.n == len(r.docs) for r in rows)
        assert (len(rows) == len({w[0] for w in want})) == (runs == 1)
        found = search_index.search_index(asked(spark), some, path)
        assert sorted(tuple(r) for r in found.collect()) == plain(TEXTS, NEEDLES)
        assert "BroadcastHashJoin [doc" in found._jdf.queryExecution().executedPlan().toString()


def test_index_over_random_texts_after_a_refresh(spark, tmp_path):
    rng, path = random.Random(4), f"{tmp_path}/i"
    text = lambda: " ".join(rng.choice("a b c d ee".split()) for _ in range(rng.randint(0, 40)))
    old = [text() for _ in range(50)]
    new = [text() if k % 3 else t for k, t in enumerate(old)] + [text() for _ in range(10)]
    long = [t.split() for t in old + new if len(t.split()) > 9]
    needles = [" ".join(rng.choice(long)[:n]) for n in (2, 3, 3, 4, 4, 5, 5, 6, 6, 7, 7, 8, 8, 9)] + ["a b c d ee a b c d"]
    search_index.write_index(docs(spark, old), path, 20)
    search_index.refresh_index(docs(spark, new), path, 50)
    ask = spark.createDataFrame(list(enumerate(needles)), "query_id int, query string")
    got = sorted(tuple(r) for r in search_index.search_index(ask, docs(spark, new), path).collect())
    assert got == plain(new, needles) and len({r[0] for r in got}) > 8  # some stood in old texts alone
    in_a_row = lambda t, n: f" {' '.join(n.split()[1:-1])} " in f" {t} "
    want = sorted((n, k) for n in {n for n in needles if len(n.split()) > 2} for k, t in enumerate(new) if in_a_row(t, n))
    found = search_index.candidates(spark.createDataFrame([(n,) for n in needles if len(n.split()) > 2], "string string"), docs(spark, new), path)
    assert sorted(tuple(r) for r in found.collect()) == want


def test_strings_in_blocks_of_bytes(spark):
    texts = spark.createDataFrame([(k, t) for k, t in enumerate(TEXTS) if t], "k int, text string")
    strings = spark.createDataFrame([(n,) for n in NEEDLES], "s string")
    for size in (containment.BLOCK_BYTES, 60):
        got = {r.k: set(r.held) for r in containing(texts, ["k"], "text", strings, "s", size).collect()}
        assert got == {k: held for k, t in enumerate(TEXTS) if t and (held := {n for n in NEEDLES if n in t})}


def test_resembling_lines_equal_difflib(spark):
    rng = random.Random(9)
    words = "drawing number scale date tolerance steel plate section detail view a1 b2 1:50".split()
    items = {" ".join(rng.choice(words) for _ in range(rng.randint(1, 6))) for _ in range(40)} | {"x" * 300 + "y" * 40, "é"}
    lines = {"".join(c if rng.random() > 0.3 else rng.choice("abcxyz é") for c in rng.choice(sorted(items))) for _ in range(150)} | {"x" * 250, "", "zz"}
    frame = lambda x: spark.createDataFrame([(v,) for v in sorted(x)], "same string")
    want = {a for a in lines if any(difflib.SequenceMatcher(None, a, b).ratio() >= 0.6 for b in items)}
    for block in (2000, 7):
        assert {r.same for r in transcripts.resembling(frame(lines), frame(items), 0.6, block).collect()} == want
    assert 0 < len(want) < len(lines) and transcripts.resembling(frame(lines), frame(set()).limit(0)).count() == 0


def test_matching_in_rounds_equals_the_greedy_walk(spark):
    rng, predicted, truth = random.Random(6), [], []
    for run in range(6):
        predicted += [(run, k, rng.randint(0, 12) / 20, rng.randint(0, 12) / 20, rng.choice([0.2, 0.3]), 0.2) for k in range(25)]
        truth += [(run, k, rng.randint(0, 12) / 20, rng.randint(0, 12) / 20, 0.2, rng.choice([0.2, 0.3])) for k in range(15)]
    # A chain in which every pair waits for the one before it.
    x = [0.0]
    for k in range(9):
        x.append(x[-1] + 0.02 + 0.001 * k)
    predicted += [(9, k, v, 0.0, 0.1, 0.1) for k, v in enumerate(x[::2])]
    truth += [(9, k, v, 0.0, 0.1, 0.1) for k, v in enumerate(x[1::2])]
    p, t = spark.createDataFrame(predicted, "run long, box_no int, x double, y double, w double, h double"), spark.createDataFrame(truth, "run long, target int, x double, y double, w double, h double")
    pairs = sorted(((r.iou, r.b_target, r.a_box_no, r.run) for r in regions._meeting(p, t, ["run"]).collect()), reverse=True)
    used, want = set(), {}
    for iou, target, box, run in pairs:
        if not {("t", run, target), ("p", run, box)} & used:
            used |= {("t", run, target), ("p", run, box)}
            want[run, target] = (round(iou, 3), box)
    got = {(r.run, r.target): (round(r.iou, 3), r.prediction) for r in regions.score_boxes(p, t).collect()}
    assert got == {(r[0], r[1]): want.get((r[0], r[1]), (0.0, None)) for r in truth} and len(want) > 60
    assert all(r.iou == 0 for r in regions.score_boxes(p.limit(0), t).collect())

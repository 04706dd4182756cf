"""Registered queries that SQL can't express, row by row against plain Python over the same tables."""

import difflib
import json
import re
from collections import defaultdict

from docsheaf import catalog
from docsheaf import fixtures as X
from tests.conftest import SF

PLAIN = {"e14_unrelated_lines", "f6_merge_tile_boxes", "k2_read_then_resolve"}


def result(spark, name, *columns):
    return sorted((tuple(r) for r in catalog.QUERIES[name](spark, SF).select(*columns).collect()), key=str)


def table(spark, name):
    return X.table(spark, SF, name).collect()


def test_paint_operators(spark):
    want = defaultdict(int)
    for d in table(spark, "documents"):
        bare = re.sub(r"\((?:\\.|[^\\()])*\)", "()", d.text.replace("the", "S"))
        want[d.source] += len(re.findall(r"(?:^|(?<=[ \t\n\x0b\f\r]))(?:B\*?|b\*?|f\*?|F|S|s|sh)(?=[ \t\n\x0b\f\r]|$)", bare))
    assert result(spark, "c4_count_paint_ops", "page", "vector") == sorted(want.items(), key=str) and sum(want.values())


def replies(spark):
    for m in X.messages(spark, SF).collect():
        yield m, len(m.content)


def test_salvaged_answers(spark):
    want = []
    for m, n in replies(spark):
        k, c, p = n % 15, m.content, m.position
        if p % 2:
            continue
        text = f"Sorry, {c}" if k % 5 == 0 else "" if k == 1 else f"<think>why\nnot</think>\n{c}" if k == 3 else f"thoughts</think> {c}" if k == 6 else f"{c} <think>open" if k == 9 else "[NO TEXT]" if k == 2 else c
        if "</think>" in text:
            text = text.rpartition("</think>")[2]
        elif "<think" in text or (p % 3 == 0 and p % 4):
            text = ""
        text = re.sub(r"\n{3,}", "\n\n", "\n".join(x.rstrip() for x in text.split("\n"))).strip("\n")
        refused = text.lstrip().startswith("Sorry,") or not text.strip()
        want.append((f"{m.conversation_id}-{p}", "" if refused else text))
    assert result(spark, "e4_salvage_cutoff", "reply", "text") == sorted(want, key=str)


def test_unrelated_lines(spark):
    same = lambda x: " ".join(x.split()).lower()
    items = [same(b.text) for b in table(spark, "benchmark")]
    want = []
    for m, _ in replies(spark):
        for n, line in enumerate(m.content.split("\n")):
            a = same(line)
            if a and not any(t in a or a in t or difflib.SequenceMatcher(None, a, t).ratio() >= 0.6 for t in items):
                want.append((f"{m.conversation_id}-{m.position}", n, line.strip()))
    assert result(spark, "e14_unrelated_lines", "reply", "line_no", "line") == sorted(want, key=str) and want


def test_parsed_regions(spark):
    want = [(f"{m.conversation_id}-{m.position}", n % 5 != 3, int(n % 5 != 3), -1.0 if n % 5 == 3 else float(n % 300)) for m, n in replies(spark)]
    assert result(spark, "f1_parse_regions", "reply_id", "structured", "n", "x") == sorted(want, key=str)


def overlap(a, b):
    """(IoU, share of the smaller box) of (x, y, w, h)."""
    wide, high = min(a[0] + a[2], b[0] + b[2]) - max(a[0], b[0]), min(a[1] + a[3], b[1] + b[3]) - max(a[1], b[1])
    if wide <= 0 or high <= 0:
        return 0.0, 0.0
    s, p, q = wide * high, a[2] * a[3], b[2] * b[3]
    return s / (p + q - s), s / min(p, q)


def test_merged_boxes(spark):
    groups = defaultdict(list)
    for b in X.boxes(spark, SF).collect():
        groups[b.page, b.type].append(b)
    want = []
    for (page, kind), own in groups.items():
        merged = []
        for b in sorted(own, key=lambda b: (b.tile, b.box_no)):
            box = (b.x, b.y, b.w, b.h)
            for m in merged:
                iou, inside = overlap(m["box"], box)
                if b.tile not in m["tiles"] and (iou >= 0.5 or inside >= 0.8):
                    x0, y0, w, h = m["box"]
                    if (m["confidence"], w * h) < (b.confidence, b.w * b.h):
                        m["label"], m["confidence"] = b.label, b.confidence
                    x, y = min(x0, b.x), min(y0, b.y)
                    m["box"] = (x, y, max(x0 + w, b.x + b.w) - x, max(y0 + h, b.y + b.h) - y)
                    m["tiles"].add(b.tile)
                    break
            else:
                merged.append({"box": box, "tiles": {b.tile}, "label": b.label, "confidence": b.confidence, "first": b.box_no})
        want += [(page, kind, m["first"], m["label"], len(m["tiles"]), *(f"{v:.6f}" for v in m["box"])) for m in merged]
    got = catalog.QUERIES["f6_merge_tile_boxes"](spark, SF).collect()
    assert sorted((r.page, r.type, r["first"], r.label, r.boxes, *(f"{r[k]:.6f}" for k in "xywh")) for r in got) == sorted(want) and any(w[4] > 1 for w in want)


def test_scored_boxes(spark):
    predicted, truth = defaultdict(list), defaultdict(list)
    for b in X.boxes(spark, SF).collect():
        (predicted if b.box_no % 2 else truth)[b.page].append((b.box_no, tuple(round(v, 6) for v in (b.x, b.y, b.w, b.h))))
    want = []
    for page, targets in truth.items():
        pairs = sorted(((overlap(p, t)[0], tn, pn) for tn, t in targets for pn, p in predicted[page] if overlap(p, t)[0] > 0), reverse=True)
        best, used = {}, set()
        for iou, t, p in pairs:
            if t not in best and p not in used:
                best[t] = round(iou, 3)
                used.add(p)
        scores = [best.get(t, 0.0) for t, _ in targets]
        hits = sum(s >= 0.5 for s in scores)
        want.append((page, len(targets), sum(scores) / len(targets), hits, len(predicted[page]), len(predicted[page]) - hits))
    got = sorted(result(spark, "f8_score_boxes", "run", "targets", "mean_iou", "hits", "predictions", "unmatched"))
    assert [(g[0], g[1], *g[3:]) for g in got] == [(w[0], w[1], *w[3:]) for w in sorted(want)]
    assert all(abs(g[2] - w[2]) < 2e-3 for g, w in zip(got, sorted(want), strict=True))


def test_attempts_of_a_reader_are_resolved(spark):
    want = []
    for d in table(spark, "documents"):
        text = d.text if (len(d.text) + 1) % 3 or (len(d.text) + 2) % 3 else ""
        opening = re.match(r"\s*(?:sorry[,!.]|unable to|as an ai)", text, re.I)
        if text.strip() and not opening:
            want.append((d.doc_id, "ok", text))
    got = [r for r in result(spark, "k2_read_then_resolve", "doc_id", "status", "text") if r[1] == "ok"]
    assert got == sorted(want, key=str)

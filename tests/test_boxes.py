"""Merging of boxes on crowded pages."""

import random
import time
from collections import defaultdict

from docsheaf.functions.graph import components
from docsheaf.operators import regions
from tests.test_plain import overlap

BOX = "page long, type string, tile int, box_no int, x double, y double, w double, h double, confidence double, label string"


def plain(rows):
    groups = defaultdict(list)
    for r in rows:
        groups[r[0], r[1]].append(r)
    out = []
    for (page, kind), own in groups.items():
        merged = []
        for _, _, tile, n, x, y, w, h, sure, label in sorted(own, key=lambda r: (r[2], r[3])):
            b = (x, y, w, h)
            for m in merged:
                iou, inside = overlap(m["b"], b)
                if tile not in m["tiles"] and (iou >= 0.5 or inside >= 0.8):
                    old = m["b"]
                    better = (m["sure"] if m["sure"] is not None else -1.0, old[2] * old[3]) >= (sure if sure is not None else -1.0, w * h)
                    u, v = min(old[0], x), min(old[1], y)
                    m["b"] = (u, v, max(old[0] + old[2], x + w) - u, max(old[1] + old[3], y + h) - v)
                    m["tiles"].append(tile)
                    if not better:
                        m["sure"], m["label"] = sure, label
                    break
            else:
                merged.append({"b": b, "tiles": [tile], "first": n, "sure": sure, "label": label})
        out += [(page, kind, m["first"], m["label"], len(m["tiles"]), *(f"{v:.9f}" for v in m["b"])) for m in merged]
    return sorted(out)


def found(df):
    return sorted((r.page, r.type, r["first"], r.label, r.boxes, *(f"{r[k]:.9f}" for k in "xywh")) for r in df.collect())


def random_boxes(pages, n, seed, size):
    rng, rows = random.Random(seed), []
    for page in range(pages):
        for k in range(n):
            w, h = rng.uniform(0.2, 1) * size, rng.uniform(0.2, 1) * size
            rows.append((page, rng.choice("ab"), rng.randint(0, 5), k, rng.uniform(0, 1 - w), rng.uniform(0, 1 - h), w, h, rng.choice([None, 0.5, 0.9]), f"L{k}"))
    return rows


def test_neighbourhoods_change_nothing(spark):
    rows = random_boxes(3, 60, 1, 0.3) + [(9, *r[1:]) for r in random_boxes(1, 120, 2, 0.08)]
    df = spark.createDataFrame(rows, BOX)
    want = plain(rows)
    assert found(regions.merge_tile_boxes(df)) == want == found(regions.merge_tile_boxes(df, crowded=1)) == found(regions.merge_tile_boxes(df, crowded=50))
    assert any(w[4] > 1 for w in want)
    parts = regions.neighbourhoods(df.filter("page = 9")).select("type", "part").distinct().count()
    assert 2 < parts < 120


def test_a_box_that_only_a_merged_rectangle_meets(spark):
    """The third box overlaps neither of the first two, but the rectangle around them."""
    rows = [(1, "a", 0, 0, 0.0, 0.0, 0.2, 0.2, 0.9, "p"), (1, "a", 1, 1, 0.02, 0.02, 0.2, 0.2, 0.9, "q"), (1, "a", 2, 2, 0.201, 0.0, 0.018, 0.019, 0.9, "r"), (1, "a", 3, 3, 0.7, 0.7, 0.1, 0.1, 0.9, "s")]
    df = spark.createDataFrame(rows, BOX)
    want = plain(rows)
    assert found(regions.merge_tile_boxes(df, crowded=0)) == want and [w[4] for w in want] == [3, 1]


def test_one_crowded_page_takes_time_in_proportion(spark):
    rng, rows = random.Random(4), []
    for k in range(6000):
        x, y = (k % 80) / 80, (k // 80) / 80
        rows += [(1, "a", 0, 2 * k, x, y, 0.01, 0.01, 0.5, "p"), (1, "a", 1, 2 * k + 1, x + rng.uniform(0, 0.004), y, 0.008, 0.01, 0.4, "q")]
    began = time.time()
    got = regions.merge_tile_boxes(spark.createDataFrame(rows, BOX)).collect()
    assert len(got) == 6000 and all(r.boxes == 2 for r in got) and time.time() - began < 90


def test_components_of_long_chains(spark):
    edges = [(k, k + 1) for k in range(0, 300)] + [(1000 + k, 1001 + k) for k in range(0, 50, 2)] + [(2000, 2000)]
    random.Random(1).shuffle(edges)
    got = {r.node: r.comp for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert {got[k] for k in range(301)} == {0} and got[1000] == got[1001] == 1000 and got[1002] == 1002 and got[2000] == 2000

"""Near duplicates among documents whose ids aren't numbers."""

from docsheaf.llm import neardup
from tests.llm.helpers import near_classes

BASE = [" ".join(f"w{k}x{j}" for j in range(60)) for k in range(4)]
TEXTS = [BASE[0], BASE[0] + " more", BASE[1], BASE[2], BASE[1].replace("w1x59", "other"), None, BASE[3], "", None]


def test_classes_of_text_ids(spark):
    rows = [(f"doc/{chr(97 + (7 * k) % 9)}", t) for k, t in enumerate(TEXTS)]
    df = spark.createDataFrame([(i, t, 1, "x") for i, t in [*rows, (None, BASE[0]), rows[0]]], "url string, text string, doc_id int, name string")
    want = near_classes([(k, t) for k, (_, t) in enumerate(sorted(rows))])
    ids = sorted(i for i, _ in rows)
    got = {r.doc_id: r.class_id for r in neardup.classes(df, "url").collect()}
    assert got == {ids[k]: ids[c] for k, c in want.items()} and len(set(got.values())) == 7
    kept = [r.url for r in neardup.keep_one(df, "url").collect()]
    assert len(kept) == 8 and kept.count(None) == 1 and len({got[u] for u in kept if u}) == 7
    assert neardup.classes(df.limit(0), "url").count() == 0

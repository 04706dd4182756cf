import zlib

import numpy as np

import corpus_pipeline
from docsheaf.llm import decontaminate, packing, quality, tokens
from docsheaf.llm.common import table
from tests.llm.helpers import SF, near_classes


def test_stages_take_effect_and_match_plain_versions(spark):
    docs = table(spark, SF, "documents")
    kept = {r.doc_id for r in quality.judge(docs).filter("kept").collect()}
    good = corpus_pipeline.quality_rules(spark, docs, SF)
    assert {r.doc_id for r in good.select("doc_id").collect()} == kept and good.columns == docs.columns
    classes = near_classes([(r.doc_id, r.text) for r in good.collect()])
    one = corpus_pipeline.near_duplicates(spark, good, SF)
    assert {r.doc_id for r in one.select("doc_id").collect()} == set(classes.values())
    bad = {r.doc_id for r in decontaminate.overlaps(one, table(spark, SF, "benchmark")).collect()}
    clean = corpus_pipeline.decontamination(spark, one, SF)
    assert {r.doc_id for r in clean.select("doc_id").collect()} == set(classes.values()) - bad
    masked = corpus_pipeline.secret_masking(spark, clean, SF)
    assert masked.columns == docs.columns and masked.count() == clean.count()
    packed = corpus_pipeline.run(spark, SF)
    assert {r.doc_id for r in packed.select("doc_id").collect()} == set(classes.values()) - bad


def test_empty_input(spark):
    docs = table(spark, SF, "documents").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, SF)
        assert docs.count() == 0


def test_odd_rows_end_to_end(spark, tmp_path):
    """Null and repeated ids, null, empty and very long texts, and columns named like those that the operators make."""
    own = lambda k, n=60: [f"k{k}w{i}" for i in range(n)]
    item = " ".join(f"item{i}" for i in range(30))
    text = {1: " ".join(own(1)), 7: " ".join([*own(7), "token=abcdefgh", "end"]), 8: " ".join(own(8, 30_000)), 9: " ".join(own(9)), 10: " ".join(own(10))}
    rows = [
        (1, text[1]), (2, text[1]), (3, " ".join([*own(1)[:-1], "changed"])), (4, "too short"), (5, None), (6, " ".join(own(6)) + " " + item), (7, text[7]), (8, text[8]), (None, text[9]), (None, None),
        (10, text[10]), (10, text[10]), (11, ""), (12, "again and again " * 40),
    ]
    schema = "doc_id long, text string, lang string, source string, n_chars int, `__bad_id` string, `__first_id` long, row_key string, spans string, host string, m int, `row` string"
    frame = spark.createDataFrame([(i, t, "en", "s", 7, "x", 1, "k", "p", "h", 5, "r") for i, t in rows], schema)
    frame.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = table(spark, str(tmp_path), "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns
    known = tokens.ChunkIds.of(tokens.token_path("byte_bpe_50k.json")).tokenizer
    want = set()
    for i, t in text.items():
        ids = [*known.encode(t.replace("token=abcdefgh", "[SECRET]"), add_special_tokens=False).ids, packing.END_ID]
        for at, n in packing.binary_pieces(len(ids)):
            want.add((None if i == 9 else i, at, n, zlib.crc32(np.array(ids[at : at + n], "<u4").tobytes()), len(ids)))
    got = [(r.doc_id, r.start, r.length, r.ids_crc32, r.doc_tokens) for r in corpus_pipeline.run(spark, str(tmp_path)).collect()]
    assert set(got) == want and len(got) == len(want)

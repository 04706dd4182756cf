"""Language identification with error-correcting output codes.

Every language has a codeword of +1 and -1. For each bit a binary naive-Bayes classifier over hashed character trigrams
tells the languages with +1 from those with -1; its margins are decoded to the language whose codeword has the least
weighted logistic loss. The weights are each bit's accuracy for each language on a quarter of the sample that the bits
weren't fitted to. Texts whose two best languages are close are flagged as ambiguous.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsheaf.llm.common import saved

BUCKETS = 1 << 14
#: About so many documents of each language are drawn for training, by a hash of their id.
SAMPLE_PER_LANG = 4000
#: So many languages are learned at most, those with most documents: the model on the driver and in every worker has one
#: row of BUCKETS numbers for each. Labels beyond are spelling mistakes rather than languages.
MAX_LANGS = 500
#: Languages with fewer documents than this have their bits weighed on the documents they were fitted to.
HOLD_OUT_FROM = 100
SMOOTHING = 0.5
AMBIGUOUS_GAP = 0.2
UNKNOWN = "und"
PART_CHARS = 1_000_000


def trigram_buckets(text: str) -> Iterator[np.ndarray]:
    """Buckets of all character trigrams of the lower-cased text, in bounded parts."""
    low = f" {text.lower()} "
    for at in range(0, len(low) - 2, PART_CHARS):
        c = np.frombuffer(low[at : at + PART_CHARS + 2].encode("utf-32-le", "surrogatepass"), dtype="<u4")
        mixed = c[:-2] * np.uint32(2654435761) + c[1:-1] * np.uint32(2246822519) + c[2:] * np.uint32(3266489917)
        yield ((mixed ^ (mixed >> np.uint32(15))) * np.uint32(2654435761)) >> np.uint32(18)


def has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def codewords(n: int) -> np.ndarray:
    """n codewords of +1/-1. Up to 7 languages: the exhaustive code; beyond: the best of 64 seeded dense random codes."""
    if n == 1:
        return np.ones((1, 1), dtype=np.int8)
    if n <= 7:
        bits = [[1 if k == 0 or (b >> (n - 1 - k)) & 1 else -1 for k in range(n)] for b in range(2 ** (n - 1) - 1)]
        return np.array(bits, dtype=np.int8).T
    width, random = math.ceil(10 * math.log2(n)), np.random.default_rng(7)
    codes = [random.choice(np.array([-1, 1], dtype=np.int8), size=(n, width)) for _ in range(64)]
    codes = [c[:, np.abs(c.sum(axis=0, dtype=int)) < n] for c in codes]

    def distance(c: np.ndarray) -> int:
        away = (c.shape[1] - c.astype(int) @ c.T.astype(int)) // 2
        return int((away + np.eye(n, dtype=int) * c.shape[1]).min())

    return max(codes, key=distance)


@dataclass
class Model:
    langs: list[str]
    codes: np.ndarray  # languages x bits
    weights: np.ndarray  # buckets x bits, log odds
    trust: np.ndarray  # languages x bits, rows sum to 1

    def margins(self, text: str) -> np.ndarray:
        total, n = np.zeros(self.weights.shape[1]), 0
        for b in trigram_buckets(text):
            n += len(b)
            total += self.weights[b].sum(axis=0) if len(b) < 4096 else np.bincount(b, minlength=BUCKETS) @ self.weights
        return total / math.sqrt(max(n, 1))

    def decode(self, margins: np.ndarray) -> tuple[str, float, bool]:
        loss = (self.trust * np.logaddexp(0, -self.codes * margins)).sum(axis=1)
        p = np.exp(-(loss - loss.min()) * 4)
        p /= p.sum()
        best = int(p.argmax())
        second = float(np.partition(p, -2)[-2]) if len(p) > 1 else 0.0
        return self.langs[best], float(p[best]), float(p[best]) - second < AMBIGUOUS_GAP


def labelled_sample(docs: DataFrame, per_lang: int, max_langs: int = MAX_LANGS) -> DataFrame | None:
    """(text, lang, fits, weighs): about per_lang documents of each language (all where there are fewer), those with the
    least hashes; whether the bits are fitted to them and weighed on them. Saved; None if there is no language."""
    train = docs.filter((F.col("fold") != 2) & F.col("lang").isNotNull() & F.col("text").isNotNull())
    counted = train.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "lang").limit(max_langs)
    sizes = {r["lang"]: r["n"] for r in counted.collect()}  # max_langs rows
    if not sizes:
        return None
    known = F.create_map(*[x for k, n in sizes.items() for x in (F.lit(k), F.struct(F.lit(min(1.0, per_lang / n)).alias("rate"), F.lit(n < HOLD_OUT_FROM).alias("few")))])
    of_lang = train.withColumn("own", F.element_at(known, F.col("lang")))
    draw = lambda seed: F.shiftrightunsigned(F.xxhash64("doc_id", F.lit(seed)), 11) / F.lit(float(1 << 53))
    drawn = of_lang.filter(draw(11) <= F.col("own.rate")).withColumn("held", draw(12) < 0.25)
    return saved(drawn.select("text", "lang", (~F.col("held") | F.col("own.few")).alias("fits"), (F.col("held") | F.col("own.few")).alias("weighs")))


def fit(docs: DataFrame, per_lang: int = SAMPLE_PER_LANG) -> Model | None:
    """docs: doc_id, fold, text, lang. None if no row can be learned from."""
    sample = labelled_sample(docs, per_lang)
    if sample is None:
        return None

    def count(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums: dict[str, np.ndarray] = {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                if has_letter(text):
                    own = sums.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                    for b in trigram_buckets(text):
                        own += np.bincount(b, minlength=BUCKETS)
        for lang, own in sums.items():
            at = np.flatnonzero(own)
            yield pd.DataFrame({"lang": lang, "bucket": at.astype(np.int32), "n": own[at]})

    counts = sample.filter("fits").select("text", "lang").mapInPandas(count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()  # at most BUCKETS rows a language
    if counts.empty:
        return None
    langs = sorted(counts["lang"].unique())
    table = np.zeros((len(langs), BUCKETS))
    table[counts["lang"].map({k: i for i, k in enumerate(langs)}), counts["bucket"]] = counts["n"]
    table = (table + SMOOTHING) / (table + SMOOTHING).sum(axis=1, keepdims=True)  # languages weigh alike, however many rows they have
    codes = codewords(len(langs))
    side = lambda s: np.stack([table[codes[:, b] == s].mean(axis=0) if (codes[:, b] == s).any() else np.full(BUCKETS, 1 / BUCKETS) for b in range(codes.shape[1])], axis=1)
    model = Model(langs, codes, np.log(side(1)) - np.log(side(-1)), np.full(codes.shape, 1 / codes.shape[1]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def rate(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        m, right = shared.value, {}
        for frame in frames:
            for text, lang in zip(frame["text"], frame["lang"], strict=True):
                if has_letter(text) and lang in m.langs:
                    own = right.setdefault(lang, np.zeros(m.codes.shape[1] + 1))
                    own[:-1] += np.sign(m.margins(text)) == m.codes[m.langs.index(lang)]
                    own[-1] += 1
        for lang, own in right.items():
            yield pd.DataFrame({"lang": lang, "bit": np.arange(len(own), dtype=np.int32), "n": own})

    rated = sample.filter("weighs").select("text", "lang").mapInPandas(rate, "lang string, bit int, n double").groupBy("lang", "bit").agg(F.sum("n").alias("n")).toPandas()  # bits x languages rows
    for lang, own in rated.groupby("lang"):
        n = own.set_index("bit")["n"].sort_index().to_numpy()
        accuracy = (n[:-1] + 1) / (n[-1] + 2)
        model.trust[langs.index(lang)] = accuracy / accuracy.sum()
    return model


def predict(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_lang: int = SAMPLE_PER_LANG) -> DataFrame:
    """Per row of docs: doc_id, held_out, lang_pred, score, ambiguous.

    Texts that are null or have no letter are `und` with score 0; so is every text if no row can be learned from. Rows
    with a null id are predicted but not learned from. Repeated rows are predicted each; an empty table gives no rows;
    other columns are ignored, whatever their names.
    """
    ids = docs.select(id_col).schema[0].dataType.simpleString()
    fold = F.crc32(F.col(id_col).cast("string")) % 4
    rows = docs.select(F.col(id_col).alias("doc_id"), fold.alias("fold"), F.col(text_col).alias("text"), F.col(lang_col).alias("lang"))
    model = fit(rows, per_lang)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def tell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            found = [m.decode(m.margins(t)) if m and has_letter(t) else (UNKNOWN, 0.0, True) for t in map(pa.StringScalar.as_py, batch.column("text"))]
            columns = [pa.array([f[k] for f in found], kind) for k, kind in enumerate((pa.string(), pa.float64(), pa.bool_()))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), *columns], names=["doc_id", "held_out", "lang_pred", "score", "ambiguous"])

    source = rows.select("doc_id", F.coalesce(F.col("fold") == 2, F.lit(False)).alias("held_out"), "text")
    return source.mapInArrow(tell, f"doc_id {ids}, held_out boolean, lang_pred string, score double, ambiguous boolean")

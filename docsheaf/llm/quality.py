"""Host-level quality rules, in DataFrame functions only.

Every document is judged by rules on its own text. The failures of each rule are then counted by host, the failure
rates are shrunk towards the corpus with a beta prior fitted to all hosts (method of moments), and hosts whose shrunk
rate is too high are rejected with all their documents. Documents that fail a base rule are rejected whatever their host;
the other rules (many symbols, repeated lines) count for hosts alone.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsheaf.llm.common import SPACES, bind, joined_groups, saved, text_of, words_of

MIN_WORDS = 20
WINDOW = 8
MAX_REPEAT_PERCENT = 30
#: A text has many symbols if they are over this share of its word characters, and repeated lines over this share of lines.
MAX_SYMBOL_PERCENT = 10
MAX_DUP_LINE_PERCENT = 30
MAX_HOST_RATE = 0.5
#: Prior weight where the hosts' rates vary no more than chance makes them: every host gets the corpus rate.
POOLED_WEIGHT = 1e6
NO_HOST = "\x00"
#: Rejected hosts are broadcast up to this many, and shuffled beyond.
BROADCAST_HOSTS = 200_000


def _windows(words: Column) -> Column:
    """A hash for each window of 8 consecutive words."""
    window = lambda h: F.transform(
        F.slice(h, F.lit(1), F.greatest(F.size(h) - (WINDOW - 1), F.lit(0))), lambda x, i: F.xxhash64(x, *[F.get(h, i + k) for k in range(1, WINDOW)])
    )
    return bind(F.transform(words, lambda w: F.xxhash64(w)), window)


def _covered(windows: Column) -> Column:
    """Words in windows that occur twice or more: positions of equal hashes, then the union of their intervals."""
    ordered = F.sort_array(F.transform(windows, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
    repeated = bind(
        ordered,
        lambda s: F.filter(s, lambda x, i: F.coalesce(F.get(s, i - 1)["h"] == x["h"], F.lit(False)) | F.coalesce(F.get(s, i + 1)["h"] == x["h"], F.lit(False))),
    )
    starts = F.sort_array(F.transform(repeated, lambda x: x["i"]))
    steps = bind(starts, lambda p: F.transform(p, lambda x, i: F.least(F.lit(WINDOW), F.coalesce(F.get(p, i + 1) - x, F.lit(WINDOW)))))
    return F.aggregate(steps, F.lit(0), lambda total, x: total + x)


def repeat_words(words: Column) -> Column:
    return bind(_windows(words), lambda w: F.when(F.size(F.array_distinct(w)) == F.size(w), F.lit(0)).otherwise(_covered(w)))


def measures(text: Column) -> Column:
    """Struct of the base measures of one text."""
    lines = F.filter(F.split(text, "\n"), lambda x: F.btrim(x, F.lit(SPACES)) != "")
    counts = bind(
        words_of(text),
        lambda w: F.struct(
            F.size(w).cast("long").alias("n_words"), F.length(F.array_join(w, "")).cast("long").alias("word_chars"), repeat_words(w).cast("long").alias("n_repeat_words")
        ),
    )
    return F.struct(
        counts.alias("c"),
        F.length(F.regexp_replace(text, r"[^#*$%&|<>]+", "")).cast("long").alias("n_symbols"),
        bind(lines, lambda a: F.struct(F.size(a).cast("long").alias("n_lines"), (F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"))).alias("l"),
    )


BASE_RULES = ["short", "repetitive"]
RULES = [*BASE_RULES, "symbols", "dup_lines"]


def with_rules(rows: DataFrame) -> DataFrame:
    """Adds a column for each rule, true where it fails, to rows with m, a struct of measures()."""
    m = lambda k: F.col(f"m.{k}")
    return rows.withColumns({
        "short": m("c.n_words") < MIN_WORDS, "repetitive": 100 * m("c.n_repeat_words") > MAX_REPEAT_PERCENT * m("c.n_words"),
        "symbols": 100 * m("n_symbols") > MAX_SYMBOL_PERCENT * m("c.word_chars"), "dup_lines": 100 * m("l.n_dup_lines") > MAX_DUP_LINE_PERCENT * m("l.n_lines"),
    })


def _host(host_col: str) -> Column:
    return F.coalesce(F.col(host_col).cast("string"), F.lit(NO_HOST))


def host_counts(rows: DataFrame) -> DataFrame:
    """(host, docs, number of failures of each rule), saved. rows: host and a column for each rule."""
    return saved(rows.groupBy("host").agg(F.count(F.lit(1)).alias("docs"), *[F.sum(F.col(r).cast("long")).alias(r) for r in RULES]))


def host_rates(hosts: DataFrame, rules: list[str] = RULES) -> DataFrame:
    """Per host of host_counts(): docs, and the shrunk failure rate of each rule.

    The prior of a rule is Beta(m s, (1 - m) s). m and v are the mean and variance of the hosts' own rates. Of v, chance
    alone makes m (1 - m) a, where a is the mean of 1 / docs, so the hosts truly vary by u = (v - m (1 - m) a) / (1 - a),
    and s = m (1 - m) / u - 1. Where u is nothing, or every host has one document so that it can't be known, s is
    POOLED_WEIGHT; it is never below 0.
    """
    rate = lambda r: F.col(r) / F.col("docs")
    prior = hosts.agg(F.avg(1 / F.col("docs")).alias("a"), *[x for r in rules for x in (F.avg(rate(r)).alias(f"m_{r}"), F.var_pop(rate(r)).alias(f"v_{r}"))])
    joined = hosts.crossJoin(F.broadcast(prior))  # one row
    for r in rules:
        m, v, a = F.col(f"m_{r}"), F.col(f"v_{r}"), F.col("a")
        true = F.when(a < 1 - 1e-12, (v - m * (1 - m) * a) / (1 - a)).otherwise(0.0)
        weight = F.when(true > 1e-12, F.greatest(F.lit(0.0), F.least(F.lit(POOLED_WEIGHT), m * (1 - m) / true - 1))).otherwise(F.lit(POOLED_WEIGHT))
        joined = joined.withColumn(f"rate_{r}", (F.col(r) + m * weight) / (F.col("docs") + weight))
    return joined.select("host", "docs", *[f"rate_{r}" for r in rules])


def with_verdicts(rows: DataFrame, hosts: DataFrame, max_host_rate: float) -> DataFrame:
    """Adds host_ok to rows with host. A few rejected hosts are broadcast; otherwise hot hosts are, and the rest shuffled."""
    worst = F.greatest(*[F.col(f"rate_{r}") for r in RULES])
    verdicts = saved(host_rates(hosts).select("host", F.col("docs").alias("group_rows"), (worst <= max_host_rate).alias("host_ok")))
    rejected = verdicts.filter("not host_ok").select("host", "host_ok")
    if rejected.count() <= BROADCAST_HOSTS:
        return rows.join(F.broadcast(rejected), "host", "left").withColumn("host_ok", F.coalesce("host_ok", F.lit(True)))
    return joined_groups(rows, verdicts, ["host"], verdicts.agg(F.sum("group_rows")).first()[0])


def judge(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """One row per row of docs: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept.

    Null and empty texts have no words and fail; rows without a host are one host. Repeated rows are judged, and counted
    for their host, each on its own. An empty table gives no rows. Other columns of docs are ignored, whatever their names.
    """
    rows = saved(with_rules(docs.select(F.col(id_col).alias("doc_id"), _host(host_col).alias("host"), measures(text_of(text_col)).alias("m"))))
    judged = with_verdicts(rows, host_counts(rows), max_host_rate)
    base_failed = F.col("short") | F.col("repetitive")
    return judged.select(
        "doc_id", "m.c.n_words", "m.c.word_chars", "m.n_symbols", "m.l.n_dup_lines", "m.c.n_repeat_words", base_failed.alias("base_failed"), (~base_failed & F.col("host_ok")).alias("kept")
    )


def keep_good(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source", max_host_rate: float = MAX_HOST_RATE) -> DataFrame:
    """The rows of docs that judge() keeps, with all their columns, whatever their names.

    Rows are as judge() has them: null and empty texts go, repeated rows are each judged, an empty table stays empty.
    The texts are measured twice, once for the hosts and once where the rows are kept, so that no text is stored between.
    """
    flagged = with_rules(docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _host(host_col).alias("host"), measures(text_of(text_col)).alias("m")))
    hosts = host_counts(flagged.select("host", *RULES))
    return with_verdicts(flagged.filter("not short and not repetitive").select("row", "host"), hosts, max_host_rate).filter("host_ok").select("row.*")


ORACLE = r"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(source, chr(0)) AS host, coalesce(text, '') AS t FROM documents),
w AS (SELECT rid, doc_id, host, t, list_filter(regexp_split_to_array(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws,
  list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS ls FROM d),
win AS (SELECT rid, i, array_to_string(ws[i:i+7], ' ') AS k FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM w)),
rep AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, k) AS n FROM win) WHERE n > 1),
cov AS (SELECT rid, count(DISTINCT j) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS j FROM rep) GROUP BY rid),
m AS (SELECT w.rid, doc_id, host, len(ws) AS n_words, CAST(coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0) AS BIGINT) AS word_chars,
  length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(ls) AS n_lines, len(ls) - len(list_distinct(ls)) AS n_dup_lines, coalesce(cov.n, 0) AS n_repeat_words
  FROM w LEFT JOIN cov ON w.rid = cov.rid),
f AS (SELECT *, n_words < 20 AS short, 100 * n_repeat_words > 30 * n_words AS repetitive, 100 * n_symbols > 10 * word_chars AS symbols, 100 * n_dup_lines > 30 * n_lines AS dup FROM m),
h AS (SELECT host, r, count(*) AS docs, sum(bad::INT) AS n FROM (SELECT host, unnest([1, 2, 3, 4]) AS r, unnest([short, repetitive, symbols, dup]) AS bad FROM f) GROUP BY host, r),
p AS (SELECT r, avg(1 / docs) AS a, avg(n / docs) AS m, var_pop(n / docs) AS v FROM h GROUP BY r),
u AS (SELECT r, m, CASE WHEN a < 1 - 1e-12 THEN (v - m * (1 - m) * a) / (1 - a) ELSE 0 END AS u FROM p),
q AS (SELECT r, m, CASE WHEN u > 1e-12 THEN greatest(0.0, least(1e6, m * (1 - m) / u - 1)) ELSE 1e6 END AS w FROM u),
v AS (SELECT host, bool_and((n + m * w) / (docs + w) <= 0.5) AS ok FROM h JOIN q ON h.r = q.r GROUP BY host)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, short OR repetitive AS base_failed, NOT (short OR repetitive) AND ok AS kept
FROM f JOIN v ON f.host = v.host
"""

"""Secret scans over a trigram inverted index, in DataFrame functions only.

From each rule's regex a Boolean trigram query is derived: alternatives (OR) of trigrams that any match must hold (AND).
The mandatory trigrams of all rules are indexed over the corpus; the postings of a query's trigrams are intersected by
document, and only documents that satisfy the query are searched with the regex. Rules without mandatory trigrams scan
every document. The regex alone decides what a secret is, so the index changes no result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsheaf.llm.common import saved, text_of


@dataclass(frozen=True)
class Rule:
    kind: str
    pattern: str
    #: The group whose length counts, and the least length; shorter matches are dropped after matching.
    group: int
    least: int
    base: bool = False
    #: What a match goes on with, in Java's syntax and possessive, so that it needs no stack; the SQL leaves it out.
    tail: str = ""


#: The rest of a private key: all up to its END line, or without one the header fields and base64 runs of 16 characters
#: or more that follow, and a last shorter one that ends its line.
_GAP = r"(?:\\[nrt]|[^A-Za-z0-9+/=\\-]){0,12}+"
PEM_TAIL = (
    r"(?:(?:(?!-----)[\s\S])*+-----END [A-Z ]*PRIVATE KEY-----"
    rf"|(?:{_GAP}[A-Za-z][A-Za-z-]{{1,40}}+:[^\r\n\\]{{0,200}}+){{0,8}}+(?:{_GAP}[A-Za-z0-9+/=]{{16,}}+)++(?:{_GAP}[A-Za-z0-9+/=]{{1,15}}+(?=[\r\n\"'\\]|\z))?+)?+"
)

#: Fixed values of the result contract (the base rules, in their order), then the rules this scan adds.
RULES = (
    Rule("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6, True),
    Rule("access", r"AKIA[A-Z0-9]+", 0, 20, True),
    Rule("hex", r"[0-9a-f]{24,}", 0, 24, True),
    Rule("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1, tail=PEM_TAIL),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 40),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 15),
    Rule("gitlab", r"glpat-[A-Za-z0-9_-]{20,}", 0, 26),
    Rule("google", r"AIza[A-Za-z0-9_-]{35,}", 0, 39),
    Rule("stripe", r"[rs]k_live_[A-Za-z0-9]{16,}", 0, 24),
    Rule("sendgrid", r"SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}", 0, 1),
    Rule("npm", r"npm_[A-Za-z0-9]{36,}", 0, 40),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}", 0, 1),
    Rule("login", r"://[A-Za-z0-9._~%+-]{1,64}:[^\x20\x09-\x0D/@:]{3,128}@", 0, 1),
)
MASK = "[SECRET]"

Query = frozenset[frozenset[str]]
ANY: Query = frozenset([frozenset()])
#: A set of exact strings is kept up to this size; beyond it, its trigrams stand for it.
EXACT_STRINGS = 64
#: A character class up to this size is read as its letters, a larger one as any character.
CLASS_LETTERS = 6
#: Candidates, and the texts with spans, are broadcast up to this size, and shuffled beyond.
BROADCAST_BYTES = 64_000_000


def _absorbed(clauses) -> Query:
    """Without clauses that another one implies."""
    kept: list[frozenset[str]] = []
    for c in sorted(set(clauses), key=len):
        if not any(k <= c for k in kept):
            kept.append(c)
    return frozenset(kept)


def _all_of(a: Query, b: Query) -> Query:
    return _absorbed(x | y for x, y in product(a, b))


def _of_strings(strings: frozenset[str]) -> Query:
    return _absorbed(frozenset(s[i : i + 3] for i in range(len(s) - 2)) for s in strings)


#: What a part of a regex tells: the exact lower-case strings it can match, if they are few, and what every match must hold.
Part = tuple[frozenset[str] | None, Query]
ONE_OF_MANY: Part = (None, ANY)
NOTHING: Part = (frozenset([""]), ANY)


def _in_a_row(parts: list[Part]) -> Part:
    exact, query, whole = frozenset([""]), ANY, True
    for e, q in parts:
        if e is not None and len(exact) * len(e) <= EXACT_STRINGS:
            exact = frozenset(a + b for a, b in product(exact, e))
            continue
        whole = False
        query = _all_of(_all_of(query, _of_strings(exact)), q)
        exact = e if e is not None else frozenset([""])
    return (exact, ANY) if whole else (None, _all_of(query, _of_strings(exact)))


def _either(parts: list[Part]) -> Part:
    if len(parts) == 1:
        return parts[0]
    if all(e is not None for e, _ in parts):
        return frozenset().union(*(e for e, _ in parts)), ANY
    return None, _absorbed(c for e, q in parts for c in (_of_strings(e) if e is not None else q))


def _repeated(part: Part, least: int, most: int | None) -> Part:
    exact, query = part
    if (least, most) == (1, 1):
        return part
    if exact is not None and (least, most) == (0, 1):
        return exact | {""}, ANY
    if least >= 1:
        return None, _of_strings(exact) if exact is not None else query
    return ONE_OF_MANY


class _Reader:
    """Reads a regex (literals, escapes, classes, groups, look-arounds, alternatives, repeats) for its trigrams."""

    def __init__(self, pattern: str):
        self.pattern, self.at = pattern, 0

    def _next(self, text: str) -> bool:
        if self.pattern.startswith(text, self.at):
            self.at += len(text)
            return True
        return False

    def _escaped(self) -> str | None:
        """The character behind a backslash; None for a class such as \\d or a place such as \\b."""
        c = self.pattern[self.at]
        self.at += 1
        if c == "x":
            self.at += 2
            return chr(int(self.pattern[self.at - 2 : self.at], 16))
        return {"n": "\n", "t": "\t", "r": "\r"}.get(c) or (None if c.isalnum() else c)

    def _letter(self) -> str | None:
        if self._next("\\"):
            return self._escaped()
        self.at += 1
        return self.pattern[self.at - 1]

    def _class(self) -> Part:
        letters, many = set(), self._next("^")
        while not self._next("]"):
            first = last = self._letter()
            if self.pattern[self.at] == "-" and self.pattern[self.at + 1] != "]":
                self.at += 1
                last = self._letter()
            if first is None or last is None:
                many = True
            else:
                letters |= {chr(k) for k in range(ord(first), ord(last) + 1)}
        return ONE_OF_MANY if many or len(letters) > CLASS_LETTERS else (frozenset(c.lower() for c in letters), ANY)

    def _group(self) -> Part:
        aside = any(self._next(x) for x in ("?=", "?!", "?<=", "?<!"))
        if not aside and self._next("?"):
            self.at = self.pattern.index(":", self.at) + 1  # (?: or (?i:
        inner = self.read()
        self.at += 1
        return NOTHING if aside else inner

    def _one(self) -> Part:
        if self._next("("):
            return self._group()
        if self._next("["):
            return self._class()
        plain = self.pattern[self.at] != "\\"
        c = self._letter()
        if plain and c in "^$":
            return NOTHING
        return ONE_OF_MANY if c is None or plain and c == "." else (frozenset([c.lower()]), ANY)

    def _bounds(self) -> tuple[int, int | None]:
        bounds = {"?": (0, 1), "*": (0, None), "+": (1, None)}
        for mark, found in bounds.items():
            if self._next(mark):
                break
        else:
            if not self._next("{"):
                return 1, 1
            end = self.pattern.index("}", self.at)
            low, comma, high = self.pattern[self.at : end].partition(",")
            self.at, found = end + 1, (int(low), int(high) if high else None if comma else int(low))
        _ = self._next("?") or self._next("+")  # lazy or possessive: matches hold the same
        return found

    def read(self) -> Part:
        choices, row = [], []
        while self.at < len(self.pattern) and self.pattern[self.at] != ")":
            if self._next("|"):
                choices.append(_in_a_row(row))
                row = []
            else:
                part = self._one()
                row.append(_repeated(part, *self._bounds()))
        return _either([*choices, _in_a_row(row)])


def trigram_query(pattern: str) -> Query:
    """Alternatives of mandatory lower-case trigrams; ANY if the pattern has none."""
    exact, query = _Reader(pattern).read()
    return _of_strings(exact) if exact is not None else query


def trigram_index(docs: DataFrame, trigrams: list[str]) -> DataFrame:
    """Postings (trigram, doc_id, row_key) of the given trigrams over lower-cased texts."""
    low = docs.select("doc_id", "row_key", F.lower("text").alias("low"))
    present = F.array_compact(F.array(*[F.when(F.contains("low", F.lit(t)), F.lit(t)) for t in trigrams]))
    return low.select(F.explode(present).alias("trigram"), "doc_id", "row_key")


def candidates(index: DataFrame, queries: dict[str, Query]) -> DataFrame:
    """(doc_id, row_key, rules): the rules whose query the document's postings satisfy."""
    held = index.groupBy("doc_id", "row_key").agg(F.collect_set("trigram").alias("held"))
    clause = lambda c: F.size(F.array_intersect("held", F.array(*map(F.lit, sorted(c))))) == len(c)
    holds = lambda q: reduce(lambda a, b: a | b, map(clause, sorted(q, key=sorted)))
    rules = F.array_compact(F.array(*[F.when(holds(q), F.lit(k)) for k, q in queries.items()]))
    return held.select("doc_id", "row_key", rules.alias("rules")).filter(F.size("rules") > 0)


def _spans(text: Column, rule: Rule, order: int) -> Column:
    """The rule's spans in text order as array<struct<s, o, e, kind>>, in code points, end exclusive."""
    whole = rule.pattern + rule.tail
    p = F.lit(whole)
    parts = F.arrays_zip(
        F.split(text, whole, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("found"), F.regexp_extract_all(text, p, F.lit(rule.group)).alias("part")
    )
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        s = acc["at"] + F.length(x["gap"])
        e = s + F.coalesce(F.length(x["found"]), F.lit(0))
        span = F.struct(s.alias("s"), F.lit(order).alias("o"), e.alias("e"), F.lit(rule.kind).alias("kind"))
        kept = F.when(F.length(x["part"]) >= rule.least, F.array(span)).otherwise(F.array().cast("array<struct<s:int,o:int,e:int,kind:string>>"))
        return F.struct(e.alias("at"), F.concat(acc["out"], kept).alias("out"))

    return F.aggregate(parts, start, step, lambda acc: acc["out"])


SPANS = "array<struct<s:int,o:int,e:int,kind:string>>"


def _keyed(docs: DataFrame, id_col: str, text_col: str, *more: Column) -> DataFrame:
    """(doc_id, row_key, text, more): a row is known by its id and a hash of its text, so rows without an id are apart."""
    text = text_of(text_col)
    return docs.select(F.col(id_col).alias("doc_id"), F.xxhash64(text).alias("row_key"), text.alias("text"), *more)


def _meet(rows: DataFrame, found: DataFrame, how: str, bytes_each: int) -> DataFrame:
    """rows joined with a saved table on (doc_id, row_key), broadcast if it is small."""
    known = found.withColumnsRenamed({"doc_id": "found_id", "row_key": "found_key"})
    known = F.broadcast(known) if found.count() * bytes_each <= BROADCAST_BYTES else known.hint("shuffle_hash")
    return rows.join(known, F.col("doc_id").eqNullSafe(F.col("found_id")) & (F.col("row_key") == F.col("found_key")), how).drop("found_id", "found_key")


def _indexed_spans(keyed: DataFrame, rules: tuple[Rule, ...], queries: dict[str, Query]) -> DataFrame:
    """(doc_id, row_key, found), saved: the spans by rules with trigrams, of the texts that have any.

    Only texts whose postings satisfy a rule's query are read again and searched, each with those rules alone.
    """
    trigrams = sorted({t for q in queries.values() for c in q for t in c})
    named = saved(candidates(saved(trigram_index(keyed, trigrams)), queries))
    searched = _meet(keyed.select("doc_id", "row_key", "text"), named, "inner", 200)
    spans = [F.when(F.array_contains("rules", r.kind), _spans(F.col("text"), r, k)).otherwise(F.array().cast(SPANS)) for k, r in enumerate(rules) if r.kind in queries]
    found = searched.select("doc_id", "row_key", F.concat(*spans).alias("found")).filter(F.size("found") > 0)
    return saved(found.dropDuplicates(["doc_id", "row_key"]))


def _with_spans(keyed: DataFrame, rules: tuple[Rule, ...], keep: list[str]) -> DataFrame:
    """(doc_id, keep, spans): what each rule finds in each whole text, by start and then rule order.

    Rules without trigrams search every text where it is scanned; a text goes on only if it is among `keep`.
    """
    queries = {r.kind: q for r in rules if ANY != (q := trigram_query(r.pattern))}
    none = F.array().cast(SPANS)
    own = [F.when(F.col("text").rlike(r.pattern), _spans(F.col("text"), r, k)).otherwise(none) for k, r in enumerate(rules) if r.kind not in queries]
    rows = keyed.select("doc_id", "row_key", *keep, F.concat(none, *own).alias("own"))
    joined = _meet(rows, _indexed_spans(keyed, rules, queries), "left", 400)
    return joined.select("doc_id", *keep, F.sort_array(F.concat("own", F.coalesce("found", none))).alias("spans"))


def _listed(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", x["kind"], x["s"].cast("string"), x["e"].cast("string"))), ",")


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Per row of docs: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    Null and empty texts have no spans. Repeated rows, also of a null id, are each scanned; an empty table gives no
    rows; other columns are ignored whatever their names.
    """
    base = [r.kind for r in rules if r.base]
    rows = _with_spans(_keyed(docs, id_col, text_col), rules, []).withColumn("base", F.filter("spans", lambda x: x["kind"].isin(base)))
    of_kind = lambda kind: F.filter("base", lambda x: x["kind"] == kind)
    counts = [F.size(of_kind(k)).cast("long").alias(f"n_{k}") for k in base]
    return rows.select("doc_id", *counts, F.sha2(_listed(F.col("base")), 256).alias("base_sha256"), _listed(F.col("spans")).alias("spans"))


def redacted(text: Column, spans: Column) -> Column:
    """The text with each run of overlapping spans replaced by MASK."""
    start = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, x: Column) -> Column:
        fresh = F.concat(acc["out"], F.substring(text, acc["at"] + 1, x["s"] - acc["at"]), F.lit(MASK))
        return F.struct(F.greatest(acc["at"], x["e"]).alias("at"), F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"))

    whole = F.aggregate(spans, start, step, lambda acc: F.concat(acc["out"], F.substring(text, acc["at"] + 1, F.length(text) - acc["at"])))
    return F.when(F.size(spans) == 0, text).otherwise(whole)


def mask(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every secret replaced by MASK; all other columns, null texts and rows without secrets stay as they are.

    Repeated rows, also of a null id, are each masked; an empty table stays empty; column names may be any.
    """
    others = [c for c in docs.columns if c != text_col]
    keyed = _keyed(docs, id_col, text_col, F.col(text_col).isNull().alias("none"), F.struct(F.lit(0).alias("__"), *[F.col(f"`{c}`") for c in others]).alias("row"))
    rows = _with_spans(keyed, rules, ["text", "none", "row"])
    new = F.when(~F.col("none"), redacted(F.col("text"), F.col("spans")))
    return rows.select(*[new.alias(c) if c == text_col else F.col("row").getField(c).alias(c) for c in docs.columns])


def _sql_spans(order: int, rule: Rule) -> str:
    pattern = rule.pattern.replace("'", "''")
    length = lambda x: f"coalesce(list_sum(list_transform({x}, lambda y: length(y))), 0)"
    return f"""SELECT rid, s, {order} AS o, '{rule.kind}:' || s || ':' || (s + length(f)) AS label, {rule.base} AS base FROM (
  SELECT rid, {length("ps[1:i]")} + {length("ms[1:i-1]")} AS s, ms[i] AS f, gs[i] AS g FROM (
    SELECT rid, ps, ms, gs, unnest(range(1, len(ms) + 1)) AS i FROM (
      SELECT rid, regexp_split_to_array(t, '{pattern}') AS ps, regexp_extract_all(t, '{pattern}', 0) AS ms, regexp_extract_all(t, '{pattern}', {rule.group}) AS gs FROM d)))
  WHERE length(g) >= {rule.least}"""


ORACLE = f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
s AS ({" UNION ALL ".join(_sql_spans(k, r) for k, r in enumerate(RULES))}),
g AS (SELECT rid, count(*) FILTER (o = 0) AS n_assign, count(*) FILTER (o = 1) AS n_access, count(*) FILTER (o = 2) AS n_hex,
  string_agg(label, ',' ORDER BY s, o) FILTER (base) AS b, string_agg(label, ',' ORDER BY s, o) AS spans FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256,
  coalesce(spans, '') AS spans FROM d LEFT JOIN g ON d.rid = g.rid
"""

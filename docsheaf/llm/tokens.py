"""Token counts at every prefix of a text, by dynamic programming over a byte-pair vocabulary.

The last token of the encoding of a prefix is the one vocabulary entry that ends there, and whose seam to the encoding
of what precedes it no merge crosses. So with best[j] the number of tokens of the first j bytes of a word,
best[j] = best[j - length of that token] + 1: one pass finds the counts of all prefixes of a word, in time proportional
to its length. The counts of a text add up over its words; a truncation or budget question reads the stored counts.

Texts are first cut into chunks at places where the tokenizer never merges across: before a single space that stands
between two non-space characters, and around a single line feed between two. Chunks recur, so those of a run of texts
are dictionary-encoded by Arrow, each different one is worked out once, and a worker keeps what it used last.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: Texts with other white space than single spaces and line feeds between words, or with the mark used for cutting.
_ODD = r"[\x00\t\x0b-\r\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]|[ \n][ \n]|\A[ \n]|[ \n]\z"
_CUT = re.compile(r"(?<=\S)(?= \S)")
#: A word of Latin letters and the marks behind it: a pre-token each, whatever comes next. (A quote may begin a third.)
_SIMPLE = re.compile(r"( ?[A-Za-zÀ-ÖØ-öø-ɏ]+)([!-&(-/:-@\[-`{-~]*)")
#: White space of the tokenizer's pattern.
_BLANKS = re.compile("[\t-\r \x85\xa0  -     　]+")
#: Texts are handled in runs of about this many bytes, which bounds what a worker holds.
RUN_BYTES = 16_000_000
#: What a worker keeps of chunks seen before, in bytes.
KEPT_BYTES = 256_000_000
PAIRS_KEPT = 500_000


def _byte_letters() -> dict[int, str]:
    """How byte-level vocabularies write bytes: printable ones of Latin-1 as they are, all others in order from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + k) for k, b in enumerate(others)}


_LETTERS = _byte_letters()


def as_bytes(word: str) -> str:
    return word.encode().decode("latin-1").translate(_LETTERS)


def token_path(name: str) -> str:
    """Where a public vocabulary file lies on this machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Recent:
    """A map that keeps about `most` bytes of what was used last: when half is full, what wasn't used since goes."""

    def __init__(self, most: int = KEPT_BYTES):
        self.new, self.old, self.size, self.half = {}, {}, 0, most // 2

    def get(self, key: str) -> bytes | None:
        value = self.new.get(key)
        if value is None and (value := self.old.get(key)) is not None:
            self.put(key, value)
        return value

    def put(self, key: str, value: bytes) -> None:
        if self.size > self.half:
            self.old, self.new, self.size = self.new, {}, 0
        self.new[key] = value
        self.size += len(key) + len(value) + 180

    def all_of(self, keys: list[str], learn: Callable[[list[str]], Iterator[bytes]]) -> list[bytes]:
        """The values of keys, those unknown from learn()."""
        found = list(map(self.get, keys))
        missing = [k for k, value in enumerate(found) if value is None]
        for k, value in zip(missing, learn([keys[k] for k in missing]), strict=True):
            found[k] = value
            self.put(keys[k], value)
        return found


def _pieces(texts: pa.Array) -> pa.ListArray:
    """The chunks of each text: they join to the text, and their tokens in a row are those of the text."""
    odd = pc.match_substring_regex(texts, _ODD)
    marked = pc.replace_substring(pc.replace_substring(texts.filter(pc.invert(odd)), "\n", "\x00\n\x00"), " ", "\x00 ")
    plain = pc.split_pattern(marked, "\x00")
    rest = pa.array([_CUT.split(t) for t in texts.filter(odd).to_pylist()], pa.list_(pa.string()))
    if not len(rest):
        return plain
    is_odd = odd.to_numpy(zero_copy_only=False)
    place = np.where(is_odd, len(plain) + np.cumsum(is_odd) - 1, np.cumsum(~is_odd) - 1)
    return pa.concat_arrays([plain, rest]).take(pa.array(place))


class Run:
    """Some rows of a batch with their texts cut to chunks: chunk k of all is kinds[codes[k]], row i has codes[bounds[i]:bounds[i + 1]]."""

    def __init__(self, batch: pa.RecordBatch, text_col: str = "text"):
        self.batch = batch
        cut = _pieces(batch.column(text_col))
        coded = cut.flatten().dictionary_encode()
        self.kinds: list[str] = coded.dictionary.to_pylist()
        self.codes = coded.indices.to_numpy()
        self.bounds = np.concatenate([[0], np.cumsum(pc.list_value_length(cut).to_numpy())]).astype(np.int64)

    def per_row(self, each: np.ndarray) -> np.ndarray:
        """Sums over the chunks of each row; each has one number for a chunk."""
        total = np.concatenate([[0], np.cumsum(each, dtype=np.int64)])
        return total[self.bounds[1:]] - total[self.bounds[:-1]]


def runs(batches: Iterator[pa.RecordBatch], text_col: str = "text") -> Iterator[Run]:
    for batch in batches:
        start, size = 0, 0
        length = pc.binary_length(batch.column(text_col)).to_pylist()
        for i, n in enumerate(length):
            size += n
            if size >= RUN_BYTES or i == len(length) - 1:
                yield Run(batch.slice(start, i + 1 - start), text_col)
                start, size = i + 1, 0


class Prefixes:
    """Prefix token counts under a byte-level BPE vocabulary of the tokenizers library."""

    _loaded: dict[str, Prefixes] = {}

    def __init__(self, path: str):
        import ahocorasick
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or (spec["pre_tokenizer"] or {}).get("type") != "ByteLevel":
            raise ValueError(f"{path} isn't a byte-level BPE vocabulary")
        self.split = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        merges = [tuple(m.split(" ") if isinstance(m, str) else m) for m in spec["model"]["merges"]]
        number = spec["model"]["vocab"]
        self.rank = {(number[a], number[b]): r for r, (a, b) in reversed(list(enumerate(merges)))}
        #: Of a merged token: its two parts and the rank of the merge; single bytes have none.
        self.parts = {number[a + b]: (number[a], number[b], r) for r, (a, b) in reversed(list(enumerate(merges)))}
        self.ends = ahocorasick.Automaton()
        known = set(self.parts) | {number[c] for c in number if len(c) == 1}
        for text, n in number.items():
            if n in known:
                self.ends.add_word(text, (n, len(text)))
        self.ends.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.sides: dict[tuple[int, int], list[tuple[int, int, float]]] = {}
        self.done: tuple[str, list[int], list[int]] = ("", [0], [0])
        self.kept, self.tails = Recent(), {}

    @classmethod
    def of(cls, path: str) -> Prefixes:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _side(self, token: int, which: int) -> list[tuple[int, int, float]]:
        """What stands at the left (0) or right (1) end of a token while it is being merged: (piece, made at rank, gone at rank)."""
        out = self.sides.get((token, which))
        if out is None:
            out, gone, piece = [], float("inf"), token
            while True:
                part = self.parts.get(piece)
                out.append((piece, part[2] if part else -1, gone))
                if part is None:
                    break
                piece, gone = part[which], part[2]
            self.sides[token, which] = out
        return out

    def _apart(self, left: int, right: int) -> bool:
        """Whether left and right stay two tokens: no merge joins what stands at their seam at any time.

        Pieces meet if each is made before the merge and none is used up. Of equal merges the one further left is first:
        within the left token it comes before the seam's, within the right token after it.
        """
        rank = self.rank.get
        for a, a_made, a_gone in self._side(left, 1):
            for b, b_made, b_gone in self._side(right, 0):
                r = rank((a, b))
                if r is not None and a_made < r < a_gone and b_made < r <= b_gone:
                    return False
        return True

    def of_word(self, word: str) -> list[int]:
        """Tokens of the first 0, 1, ... bytes of one pre-token, given as the library writes bytes.

        What the word before had in common with this one is taken over, so words are best given in order.
        """
        before, old_best, old_last = self.done
        same, most = 0, min(len(word), len(before))
        while same < most and word[same] == before[same]:
            same += 1
        size = len(word)
        best, last = old_best[: same + 1] + [0] * (size - same), old_last[: same + 1] + [0] * (size - same)
        pairs = self.pairs
        for end, (token, length) in self.ends.iter(word):
            end += 1
            if not best[end]:
                start = end - length
                if start:
                    pair = last[start] << 20 | token
                    ok = pairs.get(pair)
                    if ok is None:
                        if len(pairs) >= PAIRS_KEPT:
                            pairs.clear()
                        ok = pairs[pair] = self._apart(last[start], token)
                    if not ok:
                        continue
                best[end], last[end] = best[start] + 1, token
        self.done = word, best, last
        return best

    def _plain(self, text: str) -> list[int]:
        """Tokens of the first 0, 1, ... code points of a text without special tokens."""
        counts, base = [0], 0
        for word, (start, stop) in self.split(text):
            best = self.of_word(word)
            if len(word) == stop - start:
                own = best[1:]
            else:
                sizes = np.cumsum([1 + (c > "\x7f") + (c > "߿") + (c > "￿") for c in text[start:stop]])
                own = [best[k] for k in sizes.tolist()]
            if word in ("'re", "'ve", "'ll"):
                own[1] = 2  # such a word exists only whole; before its last letter it is two
            counts += [base + n for n in own]
            base += best[-1]
        # A prefix that ends in blanks has them as one word, while of those before a word the last one stands apart.
        for run in _BLANKS.finditer(text):
            if len(run[0]) > 1 or run[0] != " ":
                (word, _), = self.split(run[0])
                best, size = self.of_word(word), np.cumsum([len(c.encode()) for c in run[0]]).tolist()
                counts[run.start() + 1 : run.end() + 1] = [counts[run.start()] + best[k] for k in size]
        return counts

    def of_chunk(self, chunk: str) -> bytes:
        """Little-endian 32-bit counts of the first 0, 1, ... code points of a chunk. A special token counts when it is whole."""
        if simple := _SIMPLE.fullmatch(chunk):
            word, tail = simple.groups()
            counts = self.of_word(as_bytes(word))
            if len(counts) > len(word) + 1:
                counts = [counts[k] for k in accumulate((1 + (c > "\x7f") for c in word), initial=0)]
            if tail:
                before = counts[-1]
                counts = counts + [before + n for n in self._tail(tail)]
            return array("i", counts).tobytes()
        counts, at = [0], 0
        for m in self.special.finditer(chunk) if self.special else ():
            before = counts[-1]
            counts += [before + n for n in self._plain(chunk[at : m.end() - 1])[1:]]
            counts.append(counts[len(counts) - len(m[0])] + 1)
            at = m.end()
        before = counts[-1]
        counts += [before + n for n in self._plain(chunk[at:])[1:]]
        return array("i", counts).tobytes()

    def _tail(self, marks: str) -> list[int]:
        known = self.tails.get(marks)
        if known is None:
            known = self._plain(marks)[1:]
            if len(marks) <= 4:
                self.tails[marks] = known
        return known

    def _learn(self, chunks: list[str]) -> Iterator[bytes]:
        order = sorted(range(len(chunks)), key=chunks.__getitem__)
        found = [b""] * len(chunks)
        for k in order:
            found[k] = self.of_chunk(chunks[k])
        return iter(found)

    def all_of(self, chunks: list[str]) -> list[bytes]:
        return self.kept.all_of(chunks, self._learn)


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = F.coalesce(F.col(text_col), F.lit(""))
    return docs.select(F.col(id_col).alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), text.alias("text"))


def prefix_counts(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, counts array<int>.

    counts[k] is the exact number of tokens of the first k code points, for k from 0 to the length of the text. It can
    fall: a word may have fewer tokens than its start. Null and empty texts have the counts [0]. Repeated rows and rows
    without an id are counted each on its own, an empty table gives no rows; other columns are ignored, whatever their
    names.
    """
    ids = docs.select(id_col).schema[0].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Prefixes.of(token_path(tokenizer))
        for run in runs(batches):
            found = known.all_of(run.kinds)
            totals = np.frombuffer(b"".join([x[-4:] for x in found]), "<i4")[run.codes]
            chars = np.fromiter(map(len, found), dtype=np.int64, count=len(found))[run.codes] // 4 - 1
            lists, bounds = [], [0]
            for i, (start, stop) in enumerate(zip(run.bounds[:-1].tolist(), run.bounds[1:].tolist(), strict=True)):
                own = np.frombuffer(b"".join([found[k][4:] for k in run.codes[start:stop].tolist()]), "<i4")
                before = np.cumsum(totals[start:stop]) - totals[start:stop]
                lists += [np.zeros(1, "<i4"), own + np.repeat(before, chars[start:stop]).astype("<i4")]
                bounds.append(bounds[i] + 1 + len(own))
            counts = pa.ListArray.from_arrays(pa.array(bounds, pa.int32()), pa.array(np.concatenate(lists)))
            yield pa.RecordBatch.from_arrays([run.batch.column("doc_id"), run.batch.column("n_bytes"), counts], names=["doc_id", "n_bytes", "counts"])

    return _source(docs, id_col, text_col).mapInArrow(count, f"doc_id {ids}, n_bytes long, counts array<int>")


def tokens_total(counts: Column) -> Column:
    return F.element_at(counts, -1).cast("long")


def cut_for_budget(prefixes: DataFrame, budget: Column | int) -> DataFrame:
    """Adds cut_chars and cut_tokens to rows with counts: the longest prefix of at most `budget` tokens. No text is read.

    Counts may fall within a word, so it is the last place that fits, not the first that doesn't. A budget below 0 counts
    as 0 and leaves nothing; a null one gives nulls.
    """
    limit = F.greatest(F.lit(budget) if isinstance(budget, int) else budget, F.when((F.lit(budget) if isinstance(budget, int) else budget).isNotNull(), 0))
    last = F.array_max(F.transform("counts", lambda n, k: F.when(n <= limit, k)))
    return prefixes.withColumn("cut_chars", last).withColumn("cut_tokens", F.element_at("counts", F.col("cut_chars") + 1))


def token_report(docs: DataFrame, limit: int = 1024, tokenizer: str = "byte_bpe_50k.json", id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, n_tokens, over_limit, cut_chars, cut_tokens.

    over_limit is n_tokens > limit; cut_chars is the longest prefix, in code points, of at most `limit` tokens, and
    cut_tokens its count: the answers of prefix_counts() and cut_for_budget() for one budget, from the same counts, but
    without sending the counts of every prefix on. Null and empty texts have 0 tokens. Repeated rows and rows without an
    id are counted each on its own, an empty table gives no rows; other columns are ignored, whatever their names.
    """
    ids = docs.select(id_col).schema[0].dataType.simpleString()

    def report(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Prefixes.of(token_path(tokenizer))
        for run in runs(batches):
            found = known.all_of(run.kinds)
            totals = np.frombuffer(b"".join([x[-4:] for x in found]), "<i4")[run.codes]
            chars = np.fromiter(map(len, found), dtype=np.int64, count=len(found))[run.codes] // 4 - 1
            n_tokens, cut_chars = run.per_row(totals), run.per_row(chars)
            cut_tokens = n_tokens.copy()
            for i in np.flatnonzero(n_tokens > limit).tolist():
                start, stop = run.bounds[i : i + 2].tolist()
                up_to = np.cumsum(totals[start:stop], dtype=np.int64)
                k = int(np.searchsorted(up_to, limit, side="right"))
                before = int(up_to[k - 1]) if k else 0
                inside = np.frombuffer(found[run.codes[start + k]], "<i4")
                at = int(np.flatnonzero(before + inside <= limit)[-1])
                cut_chars[i], cut_tokens[i] = chars[start : start + k].sum() + at, before + inside[at]
            columns = [pa.array(x, pa.int64()) for x in (n_tokens, cut_chars, cut_tokens)]
            yield pa.RecordBatch.from_arrays([run.batch.column("doc_id"), run.batch.column("n_bytes"), *columns], names=["doc_id", "n_bytes", "n_tokens", "cut_chars", "cut_tokens"])

    counted = _source(docs, id_col, text_col).mapInArrow(report, f"doc_id {ids}, n_bytes long, n_tokens long, cut_chars long, cut_tokens long")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "cut_chars", "cut_tokens")


class ChunkIds:
    """Token ids of chunks from the library, as little-endian unsigned 32-bit bytes."""

    _loaded: dict[str, ChunkIds] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer, self.kept = Tokenizer.from_file(path), Recent()

    @classmethod
    def of(cls, path: str) -> ChunkIds:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _of_word(self, word: str) -> bytes:
        value = self.kept.get(word)
        if value is None:
            value = array("I", [t.id for t in self.tokenizer.model.tokenize(as_bytes(word))]).tobytes()
            self.kept.put(word, value)
        return value

    def _learn(self, chunks: list[str]) -> Iterator[bytes]:
        for chunk in chunks:
            if simple := _SIMPLE.fullmatch(chunk):
                word, tail = simple.groups()
                yield self._of_word(word) + self._of_word(tail) if tail else self._of_word(word)
            else:
                yield array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def all_of(self, chunks: list[str]) -> list[bytes]:
        return self.kept.all_of(chunks, self._learn)

"""SentencePiece byte-pair encoding by backtracking, and decoding.

The encoding of a text is the one row of pieces in which every two neighbours stay apart when the two are merged alone.
So it can be searched for from the left: at each place the longest piece that an Aho-Corasick automaton finds there is
tried, then its next shorter prefix that is a piece, until one is compatible with the piece before it; a place from
which nothing goes on is marked in a bitfield and never entered again, and the search steps back one piece. Whether two
pieces are compatible is told by merging their characters once more, and kept.

Texts are cut into chunks at places that no piece of the vocabulary crosses (before a space behind another character,
and at line feeds); different chunks of a run of texts are encoded once, and a worker keeps what it used last.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docsheaf.llm.tokens import _SIMPLE, Recent, Run, runs, token_path
from docsheaf.session import ship

MODEL = "piece_bpe_32k.model"
#: How the vocabulary writes a space; fixed by the format of such models.
SPACE = "▁"
#: Kinds of pieces; fixed by the format of such models.
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
_CROSSED = re.compile(f"[^{SPACE}]{SPACE}|\n")
PAIRS_KEPT = 500_000
KEPT_BYTES = 128_000_000


class Pieces:
    """Encoder and decoder of one byte-pair model file of the sentencepiece library."""

    _loaded: dict[str, Pieces] = {}

    def __init__(self, path: str):
        import ahocorasick
        from sentencepiece import sentencepiece_model_pb2 as proto

        model = proto.ModelProto()
        with open(path, "rb") as file:
            model.ParseFromString(file.read())
        norm, train = model.normalizer_spec, model.trainer_spec
        plain = norm.add_dummy_prefix and norm.escape_whitespaces and not (norm.remove_extra_whitespaces or norm.precompiled_charsmap or train.treat_whitespace_as_suffix)
        if train.model_type != train.BPE or not train.byte_fallback or not plain or {p.type for p in model.pieces} - {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError(f"{path} isn't a byte-pair model with byte fallback that leaves texts as they are")
        self.text = [p.piece for p in model.pieces]
        self.kind = [p.type for p in model.pieces]
        self.unknown = train.unk_surface
        self.ids = {p.piece: k for k, p in enumerate(model.pieces) if p.type == NORMAL}
        if any(map(_CROSSED.search, self.ids)):
            raise ValueError(f"{path} has pieces across spaces or line feeds, at which texts are cut here")
        scores = sorted({p.score for p in model.pieces if p.type == NORMAL}, reverse=True)
        place = {score: k for k, score in enumerate(scores)}
        #: When a piece is merged: the higher its score the earlier.
        self.turn = {p.piece: place[p.score] for p in model.pieces if p.type == NORMAL}
        self.byte_ids = [0] * 256
        #: Id to byte, for byte pieces.
        self.bytes: dict[int, int] = {}
        for k, p in enumerate(model.pieces):
            if p.type == BYTE:
                self.byte_ids[int(p.piece[1:-1], 16)] = k
                self.bytes[k] = int(p.piece[1:-1], 16)
        #: Two characters in a row that some piece has; a text can be cut between any others.
        self.inside = {p[k : k + 2] for p in self.ids for k in range(len(p) - 1)}
        # A character without a piece can still be merged into one, so it takes part as itself.
        self.parts = sorted(self.ids.keys() | {c for p in self.ids for c in p})
        number = {p: k for k, p in enumerate(self.parts)}
        self.size = [len(p) for p in self.parts]
        #: The longest shorter part that a part begins with, or -1.
        self.shorter = [next((number[p[:n]] for n in range(len(p) - 1, 0, -1) if p[:n] in number), -1) for p in self.parts]
        self.automaton = ahocorasick.Automaton()
        for p, k in number.items():
            self.automaton.add_word(p, k)
        self.automaton.make_automaton()
        self.pairs: dict[int, bool] = {}
        self.reached: dict[int, bool] = {}
        self.kept = Recent(KEPT_BYTES)

    @classmethod
    def of(cls, path: str) -> Pieces:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text by merging: always the pair whose piece comes first, of equal ones that further left."""
        parts, turn = list(text), self.turn.get
        while len(parts) > 1:
            best = min(((t, k) for k in range(len(parts) - 1) if (t := turn(parts[k] + parts[k + 1])) is not None), default=None)
            if best is None:
                break
            k = best[1]
            parts[k : k + 2] = [parts[k] + parts[k + 1]]
        return parts

    def _compatible(self, left: int, right: int) -> bool:
        if len(self.pairs) >= PAIRS_KEPT:
            self.pairs.clear()
        both = [self.parts[left], self.parts[right]]
        known = self.pairs[left << 20 | right] = self.merged("".join(both)) == both
        return known

    def _reachable(self, part: int) -> bool:
        known = self.reached[part] = self.merged(self.parts[part]) == [self.parts[part]]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a text whose characters all occur in pieces; spaces are written as the vocabulary does."""
        size, shorter, pairs, reached = self.size, self.shorter, self.pairs, self.reached
        length = len(text)
        # Ends rise, so of the parts that begin at a place the longest is written last.
        longest = [-1] * (length + 1)
        for end, part in self.automaton.iter(text):
            longest[end - size[part] + 1] = part
        out: list[int] = []
        open_, at, part = (1 << (length + 1)) - 1, 0, longest[0]
        while at < length:
            while part >= 0:
                if open_ >> (at + size[part]) & 1:
                    if out:
                        fits = pairs.get(out[-1] << 20 | part)
                        if fits is None:
                            fits = self._compatible(out[-1], part)
                    else:
                        fits = reached.get(part)
                        if fits is None:
                            fits = self._reachable(part)
                    if fits:
                        break
                part = shorter[part]
            if part >= 0:
                out.append(part)
                at += size[part]
                part = longest[at]
            else:
                open_ &= ~(1 << at)
                part = out.pop()
                at -= size[part]
        return [self.parts[k] for k in out]

    def encode(self, text: str) -> list[int]:
        """Ids of a text in which the leading space, if there is one, has been written already."""
        out: list[int] = []
        for known, other in self._known.findall(text.replace(" ", SPACE)):
            for piece in self.split(known) if known else other:
                k = self.ids.get(piece)
                out += [k] if k is not None else [self.byte_ids[b] for b in piece.encode()]
        return out

    @property
    def _known(self) -> re.Pattern:
        """Runs of characters that occur in pieces, and runs of all others."""
        if not hasattr(self, "_runs"):
            inside = "".join(map(re.escape, sorted({c for p in self.ids for c in p})))
            self._runs = re.compile(f"([{inside}]+)|([^{inside}]+)")
        return self._runs

    def decode(self, ids: list[int], first: bool = True) -> str:
        """The text of ids; `first` tells that they begin a text, whose leading space goes. A byte that is no character
        is written as U+FFFD, control ids as nothing."""
        out, held, at_start = [], bytearray(), first
        for k in ids:
            if k in self.bytes:
                held.append(self.bytes[k])
                at_start = False
                continue
            if held:
                out.append(_characters(held))
                held = bytearray()
            if self.kind[k] == CONTROL:
                continue
            piece = self.unknown if self.kind[k] == UNKNOWN else self.text[k]
            out.append((piece.removeprefix(SPACE) if at_start else piece).replace(SPACE, " "))
            at_start = False
        return "".join(out) + _characters(held)

    def _learn(self, chunks: list[str]) -> Iterator[bytes]:
        """A word and the marks behind it are encoded apart, if no piece crosses their seam: words come with many marks."""
        for chunk in chunks:
            simple = _SIMPLE.fullmatch(chunk)
            if simple and simple[2] and simple[1][-1] + simple[2][0] not in self.inside:
                yield self._of_word(simple[1]) + self._of_word(simple[2])
            else:
                yield array("i", self.encode(chunk)).tobytes()

    def _of_word(self, word: str) -> bytes:
        value = self.kept.get(word)
        if value is None:
            value = array("i", self.encode(word)).tobytes()
            self.kept.put(word, value)
        return value

    def all_of(self, chunks: list[str]) -> list[bytes]:
        """Little-endian 32-bit ids of each chunk."""
        return self.kept.all_of(chunks, self._learn)


def _characters(held: bytearray) -> str:
    """Bytes as UTF-8; each byte that begins no character is one U+FFFD."""
    try:
        return held.decode()
    except UnicodeDecodeError:
        pass
    out, at = [], 0
    while at < len(held):
        for n in (1, 2, 3, 4):
            try:
                out.append(held[at : at + n].decode())
                at += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("�")
            at += 1
    return "".join(out)


def piece_runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """Runs of rows whose chunks are as the encoder wants them: the first of each non-empty text with a space before it."""

    def spaced(batch: pa.RecordBatch) -> pa.RecordBatch:
        k = batch.schema.get_field_index("text")
        return batch.set_column(k, "text", pc.replace_substring(batch.column(k), SPACE, " "))

    for run in runs(map(spaced, batches)):
        first = run.bounds[:-1]
        firsts, code = np.unique(run.codes[first], return_inverse=True)
        run.codes = run.codes.astype(np.int64)
        run.codes[first] = len(run.kinds) + code
        run.kinds = run.kinds + [" " + run.kinds[k] if run.kinds[k] else "" for k in firsts.tolist()]
        yield run


def _source(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    ship(docs.sparkSession)
    return docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col), F.lit("")).alias("text"))


def encode(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, ids array<int>, the ids that the library gives for the text without begin or end ids.

    Null and empty texts have no ids. Repeated rows and rows without an id are encoded each on its own, an empty table
    gives no rows; other columns are ignored, whatever their names.
    """
    ids = docs.select(id_col).schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces.of(token_path(model))
        for run in piece_runs(batches):
            found = known.all_of(run.kinds)
            own = np.fromiter(map(len, found), dtype=np.int64, count=len(found))[run.codes] // 4
            bounds = np.concatenate([[0], np.cumsum(run.per_row(own))]).astype(np.int32)
            flat = np.frombuffer(b"".join([found[k] for k in run.codes.tolist()]), "<i4")
            yield pa.RecordBatch.from_arrays([run.batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat))], names=["doc_id", "ids"])

    return _source(docs, id_col, text_col).mapInArrow(read, f"doc_id {ids}, ids array<int>")


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """Per row of encoded: doc_id, text, what the library decodes from the ids. Null ids give a null text, an id that the
    model doesn't have ends the job."""
    ids = encoded.select(id_col).schema[0].dataType.simpleString()
    ship(encoded.sparkSession)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces.of(token_path(model))
        for batch in batches:
            texts = [None if x is None else known.decode(x) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col(id_col).alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids")).mapInArrow(read, f"doc_id {ids}, text string")


def report(docs: DataFrame, model: str = MODEL, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_tokens, ids_sha256 and decoded_sha256, digests of encode() and of decode() of its ids.

    Ids are joined as decimals by commas. Chunks are decoded apart, since each holds whole characters. Null and empty
    texts have 0 tokens and the digests of nothing. Repeated rows and rows without an id give a row each, an empty table
    gives none; other columns are ignored, whatever their names.
    """
    ids = docs.select(id_col).schema[0].dataType.simpleString()

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = Pieces.of(token_path(model))
        for run in piece_runs(batches):
            numbers = [np.frombuffer(x, "<i4").tolist() for x in known.all_of(run.kinds)]
            size = np.fromiter(map(len, numbers), dtype=np.int64, count=len(numbers))
            spelled = [",".join(map(str, x)) for x in numbers]
            texts = [known.decode(x, first=False) for x in numbers]
            ids_hash, text_hash, codes = [], [], run.codes.tolist()
            for start, stop in zip(run.bounds[:-1].tolist(), run.bounds[1:].tolist(), strict=True):
                own = codes[start:stop]
                ids_hash.append(hashlib.sha256(",".join([spelled[k] for k in own]).encode()).hexdigest())
                text_hash.append(hashlib.sha256("".join([texts[k] for k in own]).removeprefix(" ").encode()).hexdigest())
            columns = [pa.array(run.per_row(size[run.codes]), pa.int64()), pa.array(ids_hash), pa.array(text_hash)]
            yield pa.RecordBatch.from_arrays([run.batch.column("doc_id"), *columns], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return _source(docs, id_col, text_col).mapInArrow(read, f"doc_id {ids}, n_tokens long, ids_sha256 string, decoded_sha256 string")

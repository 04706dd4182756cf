"""Operators 11 to 13 against plain versions and the libraries."""

import functools
import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docsheaf.llm import alignment, pieces, trie
from docsheaf.llm.queries import op11_conversation_trie, op12_lockstep_alignment, op13_sentencepiece
from docsheaf.llm.tokens import Run, token_path
from tests.llm.helpers import DOCS, SF, odd_docs, rows_of

LONG = " ".join(f"word{i % 977}" for i in range(30_000))
WHOLE = "".join(chr(0x4E00 + i % 3000) for i in range(5_000)) + "a" * 3000
ODD = [(1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, LONG), (5, LONG), (None, "no id here"), (None, None), (6, "a▁b ▁ c"), (7, "x\n\nx\nx \ny"), (8, WHOLE), (9, " <s> <|endoftext|> <0x0A>\x00 é🎉 "), (10, "  two  spaces")]
CHARS = "abcdehilnort  \n▁éè漢字🎉\x00<>0x.,АБг한국'"
TEXTS = st.text(alphabet=CHARS, max_size=40)
SHA_OF_NOTHING = hashlib.sha256(b"").hexdigest()


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


@pytest.fixture(scope="module")
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=token_path(pieces.MODEL))


@pytest.fixture(scope="module")
def byte_library():
    from tokenizers import Tokenizer

    found = Tokenizer.from_file(token_path(alignment.BYTE_TOKENIZER))
    found.encode_special_tokens = True
    return found


# ---- 13: SentencePiece
@given(TEXTS)
@settings(max_examples=400, deadline=None)
def test_backtracking_encodes_as_the_library(library, text):
    known = pieces.Pieces.of(token_path(pieces.MODEL))
    ids = known.encode(" " + text) if text else []
    assert ids == library.encode(text)
    assert known.decode(ids) == library.decode(ids)


@given(st.lists(st.integers(0, 31_999) | st.integers(0, 258), max_size=15))
@settings(max_examples=400, deadline=None)
def test_any_ids_decode_as_by_the_library(library, ids):
    assert pieces.Pieces.of(token_path(pieces.MODEL)).decode(ids) == library.decode(ids)


def test_pieces_of_pieces_in_any_order(library):
    """Rows of whole pieces, whose seams need most stepping back."""
    known, rng = pieces.Pieces.of(token_path(pieces.MODEL)), random.Random(4)
    for _ in range(600):
        text = "".join(known.text[rng.randint(259, 31_999)] for _ in range(12)).replace("▁", " ")
        assert known.encode(" " + text) == library.encode(text)


def test_a_search_that_must_step_back(library):
    """Without incompatible neighbours and dead ends the longest pieces would do: they don't."""
    known, differ = pieces.Pieces.of(token_path(pieces.MODEL)), 0
    for word in LONG.split()[:50] + ["unbelievably", "misunderstandings", "concatenations", "thermodynamically"]:
        text, greedy = "▁" + word, []
        while text:
            greedy.append(next(text[:k] for k in range(len(text), 0, -1) if text[:k] in known.ids))
            text = text.removeprefix(greedy[-1])
        differ += greedy != known.split("▁" + word)
        assert known.encode(" " + word) == library.encode(word)
    assert differ


def test_sentencepiece_of_odd_rows(spark, library):
    docs = odd_docs(spark, ODD)
    want = []
    for doc, text in ODD:
        ids = library.encode(text or "")
        want.append((doc, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert rows_of(pieces.report(docs), ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]) == sorted(want, key=str)
    encoded = pieces.encode(docs)
    assert sorted(((r.doc_id, list(r.ids)) for r in encoded.collect()), key=str) == sorted([(d, library.encode(t or "")) for d, t in ODD], key=str)
    assert rows_of(pieces.decode(encoded), ["doc_id", "text"]) == sorted([(d, library.decode(library.encode(t or ""))) for d, t in ODD], key=str)
    assert pieces.decode(spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")).first().text is None
    for df in (pieces.report(spark.createDataFrame([], DOCS)), pieces.encode(spark.createDataFrame([], DOCS))):
        assert df.count() == 0


def test_sentencepiece_of_the_table(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = op13_sentencepiece(spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        ids = library.encode(texts[r.doc_id])
        assert (r.n_tokens, r.ids_sha256, r.decoded_sha256) == (len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids)))


# ---- 12: alignment
@functools.cache
def bytes_of_pieces():
    return alignment.piece_bytes(pieces.Pieces.of(token_path(pieces.MODEL)))


def plain_alignment(text, first, second):
    """(ids of A, ids of B, groups, links), the tokens taken one by one."""
    known, spelled = alignment.PlainIds.of(token_path(alignment.BYTE_TOKENIZER)), bytes_of_pieces()
    if not text:
        return [], [], "", []
    a, b = first.encode(" " + text, add_special_tokens=False).ids, second.encode(text)
    if any(b"".join(x) != f" {text}".encode() for x in ([known.bytes[k] for k in a], [spelled[k] for k in b])):
        return [], [], "", []
    a_end, b_end = np.cumsum([len(known.bytes[k]) for k in a]).tolist(), np.cumsum([len(spelled[k]) for k in b]).tolist()
    groups, links, i, j = [], [], 0, 0
    for cut in sorted(set(a_end) & set(b_end)):
        m, n = a_end.index(cut, i) + 1, b_end.index(cut, j) + 1
        groups.append(",".join(map(str, a[i:m])) + "|" + ",".join(map(str, b[j:n])))
        links.append((a[m - 1], b[n - 1]))
        i, j = m, n
    return a, b, ";".join(groups), links


def plain_report(rows, first, second):
    found = [(doc, *plain_alignment(text, first, second)) for doc, text in rows]
    count = Counter(link for *_, links in found for link in links)
    best = defaultdict(int)
    for (_, b), n in count.items():
        best[b] = max(best[b], n)
    return [
        (doc, len(a), len(b), len(groups.split(";")) if groups else 0, len(links), sum(count[x] == best[x[1]] for x in links), sum(count[x] for x in links), sha(groups) if groups else "")
        for doc, a, b, groups, links in found
    ]


REPORT = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]


@given(st.lists(TEXTS, min_size=1, max_size=5))
@settings(max_examples=60, deadline=None)
def test_lockstep_of_any_batch(byte_library, library, texts):
    first, second = alignment.PlainIds.of(token_path(alignment.BYTE_TOKENIZER)), pieces.Pieces.of(token_path(pieces.MODEL))
    second.spelled = alignment.piece_bytes(second)
    lengths, spelled = (np.array(list(map(len, first.bytes))), np.array(list(map(len, second.spelled)))), alignment.spellings(50_300)
    batch = pa.RecordBatch.from_arrays([pa.array(range(len(texts))), pa.array(texts, pa.string())], names=["doc_id", "text"])
    held, alignment.LANE = alignment.LANE, 2
    try:
        run = alignment.Aligned(alignment._spaced(Run(batch)), first, second, lengths)
    finally:
        alignment.LANE = held
    bounds, pair, n = run.pairs()
    groups = run.groups(spelled)
    for k, text in enumerate(texts):
        *_, want, links = plain_alignment(text, byte_library, library)
        assert groups[k].decode() == want
        assert dict(zip(pair[bounds[k] : bounds[k + 1]].tolist(), n[bounds[k] : bounds[k + 1]].tolist(), strict=True)) == Counter(a << 24 | b for a, b in links)


def test_alignment_of_odd_rows(spark, byte_library, library):
    assert rows_of(alignment.links_report(odd_docs(spark, ODD)), REPORT) == sorted(plain_report(ODD, byte_library, library), key=str)
    assert alignment.links_report(spark.createDataFrame([], DOCS)).count() == 0
    shown = {r.doc_id: r.groups for r in alignment.aligned(odd_docs(spark, ODD), with_groups=True).collect()}
    assert shown[4] == plain_alignment("one", byte_library, library)[2] and shown[6] == ""


@pytest.mark.parametrize("shares", [1 << 16, 3])
def test_alignment_of_the_table(spark, byte_library, library, monkeypatch, shares):
    """With few shares nearly all pairs meet in the shuffle."""
    monkeypatch.setattr(alignment, "SHARES", shares)
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    assert rows_of(op12_lockstep_alignment(spark, SF), REPORT) == sorted(plain_report(rows, byte_library, library), key=str)


# ---- 11: prefix trie
COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def plain_trie(rows):
    """rows: (conv_id, turn, role, text), no two of a conversation with the same turn."""
    own = defaultdict(list)
    for conv, turn, role, text in sorted((r for r in rows if r[0] is not None), key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        own[conv].append((role or "", text or ""))
    members, ends = defaultdict(list), defaultdict(list)
    for conv in sorted(own):
        h, base = zlib.crc32(str(conv).encode()) % 4, int(np.fix(conv / 20)) * 20
        turns = own.get(base, [])[:h] + own[conv][h:]
        for d in range(len(turns) + 1):
            members[tuple(turns[:d])].append(conv)
        ends[tuple(turns)].append(conv)
    kids, leaves, saved = Counter(node[:-1] for node in members if node), Counter(), Counter()
    for node in members:
        words = len(re.findall(r"[^\x20\x09-\x0D]+", node[-1][1])) if node else 0
        for d in range(len(node) + 1):
            leaves[node[:d]] += not kids[node]
            saved[node[:d]] += (len(members[node]) - 1) * words
    return sorted(((m[0], len(k), members[k[:-1]][0] if k else None, len(m), kids[k], leaves[k], saved[k], sha(",".join(map(str, ends[k])))) for k, m in members.items()), key=str)


def conversations(n, seed=3):
    rng, rows = random.Random(seed), [(None, 1, "user", "no conversation"), (-3, None, None, None), (-3, 2, "user", "x y"), (-20, 1, "user", "x y"), (-45, 7, None, "z")]
    for conv in rng.sample(range(4 * n), n):
        kind = rng.random()
        turns = 1 if kind < 0.1 else 4 if kind < 0.4 else rng.randint(1, 6)
        for t in range(turns):
            text = "all the same" if kind < 0.4 else rng.choice([None, "", "a b", "a b c", " two\n words\x0b", f"own {conv}"])
            rows.append((conv, rng.choice([None, 0]) if t == 0 else t, rng.choice(["user", None, "assistant"]) if kind > 0.8 else "user", text))
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize(("limit", "turns"), [(4096, 1 << 17), (7, 1 << 17), (4096, 25)])
def test_trie_matches_a_plain_one(spark, monkeypatch, limit, turns):
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", limit)
    monkeypatch.setattr(trie, "SHARD_TURNS", turns)
    rows = conversations(400)
    df = spark.createDataFrame([(*r, 1, "s", b"p", 2) for r in rows], "conv_id long, turn long, role string, text string, family int, shard string, path binary, n int").repartition(5)
    assert rows_of(trie.prefix_trie(df), COLUMNS) == plain_trie(rows)


def test_one_long_conversation_and_many_copies(spark, monkeypatch):
    """A third of all turns in one conversation, and copies of another one in every shard."""
    monkeypatch.setattr(trie, "SHARD_CONVERSATIONS", 20)
    rows = [(1001, t, "user", f"turn {t} of many") for t in range(250)] + [(conv, t, "user", f"copied {t}") for conv in range(40, 240) for t in range(2)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), COLUMNS) == plain_trie(rows)


def test_repeated_turns_are_turns(spark):
    rows = [(3, 1, "user", "a b"), (3, 1, "user", "a b"), (3, 1, "user", "c"), (3, None, "user", "first")]
    want = [(conv, t, role, text) for (conv, _, role, text), t in zip([rows[3], *sorted(rows[:3], key=lambda r: hashlib.sha256(f"4\nuser\n{r[3]}".encode()).hexdigest())], range(4), strict=True)]
    assert rows_of(trie.prefix_trie(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")), COLUMNS) == plain_trie(want)


def test_empty_and_given_conversations(spark):
    assert trie.prefix_trie(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    assert rows_of(op11_conversation_trie(spark, SF), COLUMNS) == plain_trie(rows)

"""Plain versions of what the operators compute, and inputs with odd rows."""

import hashlib
import random
import re

import duckdb

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, source string, lang string, n_words string, row string, spans string, host string"


def odd_docs(spark, rows):
    """Documents with extra columns whose names clash with those that the operators make."""
    return spark.createDataFrame([(i, t, "s", "en", "x", "y", "z", "h") for i, t in rows], DOCS)


def duck(sql, **frames):
    con = duckdb.connect()
    for name, frame in frames.items():
        con.register(name, frame)
    return con.execute(sql).fetchall()


def rows_of(df, columns):
    return sorted((tuple(r) for r in df.select(*columns).collect()), key=str)


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def without_repeats(rows, size=50):
    first = {}
    for i, t in rows:
        w = split(t)
        for a in range(len(w) - size + 1):
            if i is not None:
                k = tuple(w[a : a + size])
                first[k] = min(first.get(k, i), i)
    out = []
    for i, t in rows:
        w = split(t)
        gone = [False] * len(w)
        for a in range(len(w) - size + 1):
            if i is not None and first[tuple(w[a : a + size])] < i:
                gone[a : a + size] = [True] * size
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out.append((i, len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return sorted(out, key=str)


def passages(seed=5, n=60):
    """Documents pieced together from a few long texts, so that spans repeat across branches."""
    random.seed(seed)
    base = [[f"w{random.randint(0, 10**6)}" for _ in range(400)] for _ in range(4)] + [["a", "b"] * 150, ["z"] * 200]
    rows = []
    for i in range(n):
        t = []
        for _ in range(random.randint(1, 4)):
            b = random.choice(base)
            a = random.randint(0, len(b) - 1)
            t += b[a : a + random.randint(30, 140)] + [f"u{random.randint(0, 10**9)}" for _ in range(random.choice([0, 0, 1, 5]))]
        rows.append((i, " ".join(t)))
    return rows


def best_diagonal(text, item):
    """The best +1 / -2 stretch over every diagonal of two token lists."""
    best = 0
    for shift in range(1 - len(item), len(text)):
        run = 0
        for j in range(max(0, -shift), min(len(item), len(text) - shift)):
            run = max(0, run + (1 if text[j + shift] == item[j] else -2))
            best = max(best, run)
    return best


def lcs(a, b):
    before = [0] * (len(b) + 1)
    for x in a:
        now = [0]
        for j, y in enumerate(b):
            now.append(before[j] + 1 if x == y else max(before[j + 1], now[-1]))
        before = now
    return before[-1]


def near_classes(rows, limit=0.8):
    """Least id of the class of every id, by comparing all pairs word shingle by word shingle."""
    shingles = {}
    for i, t in rows:
        if t is not None:
            w = re.findall(r"\w+", t.lower())
            shingles[i] = [tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))] if w else []
    parent = {i: i for i, _ in rows}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(shingles)
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            x, y = shingles[a], shingles[b]
            if x == y:
                same = True
            elif not x or not y or min(len(x), len(y)) < limit * max(len(x), len(y)):
                same = False
            else:
                both = lcs(x, y)
                same = both >= limit * (len(x) + len(y) - both) - 1e-9
            if same:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {i: root(i) for i, _ in rows}

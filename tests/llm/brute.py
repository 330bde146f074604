"""Plain versions of the operators, and documents with everything odd in them."""

import hashlib
import re
from collections import Counter, defaultdict

PLAIN = re.compile(r"[^\x20\x09-\x0D]+")
NORMAL = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")

PASSAGE = " ".join(f"shared{i}" for i in range(60))


def odd_documents():
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, repeated rows, periodic texts."""
    long = " ".join(f"w{i % 977}x{i % 31}" for i in range(30_000))
    base = [f"tok{i}" for i in range(200)]
    near = base[:]
    near[50] = "changed"
    other = [f"tok{i}" if i % 3 else f"alt{i}" for i in range(200)]
    rows = [
        (1, None, "en", "a"),
        (2, "", "en", "a"),
        (3, " \t\n\x0b ", None, "b"),
        (4, long, "en", "a"),
        (5, " ".join(base), "en", None),
        (6, " ".join(base), "en", "a"),
        (7, " ".join(near), "en", "b"),
        (8, " ".join(other), "fr", "b"),
        (9, "so " * 80 + "end", "en", "c"),
        (10, "left " + PASSAGE + " right one", "en", "c"),
        (11, "before this　is one word " + PASSAGE + " after", "de", "c"),
        (12, "one", "en", "c"),
        (13, "One", "en", "c"),
        (14, "one two", "en", "c"),
        (None, "no id at all but a text of some words", "en", "a"),
        (None, " ".join(base), "en", "a"),
        (15, "repeated row with the same id and text", "en", "d"),
        (15, "repeated row with the same id and text", "en", "d"),
        (16, " ".join(f"u{i}" for i in range(35)), "en", "d"),
        (17, " ".join(f"u{i}" for i in range(34)), "en", "d"),
        (18, "\U0001f600 été " + " ".join(reversed(base)), "fr", "\U0001f600"),
    ]
    return rows


SCHEMA = "doc_id bigint, text string, lang string, source string"
#: Further columns, by names the operators use within.
CLASHES = "key mark size low path digest row score n piece id node component a b start copies n_words base first".split()


def frame(spark, rows, clashes=True):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in CLASHES if clashes else ():
        df = df.selectExpr("*", f"'x' AS {name}")
    return df.repartition(3)


def sha(text):
    return hashlib.sha256(text.encode("utf-8")).hexdigest()


def substring(rows, window):
    words = [PLAIN.findall(t or "") for _, t, *_ in rows]
    count = Counter(tuple(w[i : i + window]) for w in words for i in range(len(w) - window + 1))
    out = []
    for (doc_id, *_), w in zip(rows, words):
        gone = set()
        for i in range(len(w) - window + 1):
            if count[tuple(w[i : i + window])] > 1:
                gone.update(range(i, i + window))
        out.append((doc_id, len(w), len(gone), sha(" ".join(x for i, x in enumerate(w) if i not in gone))))
    return out


def contamination(rows, items, window):
    wins = []
    for item_id, text in items:
        w = NORMAL.findall((text or "").translate(LOWER))
        if item_id is not None:
            wins += [(str(item_id), w[i : i + window]) for i in range(max(1, len(w) - window + 1)) if w]
    out = []
    for doc_id, text, *_ in rows:
        w, hit, found = NORMAL.findall((text or "").translate(LOWER)), set(), set()
        for item_id, x in wins:
            for i in range(len(w) - len(x) + 1):
                if w[i : i + len(x)] == x:
                    hit.update(range(i, i + len(x)))
                    found.add(item_id)
        out.append((doc_id, len(w), len(hit), len(found), sha(",".join(sorted(found)))))
    return out


def shingle_set(text, size):
    w = PLAIN.findall((text or "").translate(LOWER))
    if not w:
        return set()
    n = min(size, len(w))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)}


def components(rows, size, percent):
    """(doc_id, n_shingles, component_id); rows without an id are not linked."""
    sets = [shingle_set(t, size) for _, t, *_ in rows]
    name = {d: d for d, *_ in rows if d is not None}

    def root(x):
        while name[x] != x:
            x = name[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            x, y = rows[i][0], rows[j][0]
            if x is None or y is None or not a or not sets[j]:
                continue
            if 100 * len(a & sets[j]) >= percent * len(a | sets[j]):
                x, y = root(x), root(y)
                name[max(x, y)] = min(x, y)
    return [(d, len(s), None if d is None else root(d)) for (d, *_), s in zip(rows, sets)]


def top_k(vectors, is_query, k, scale=256, limit=2**60):
    import math

    ok = [
        (i, [math.floor(scale * float(x)) for x in v])
        for i, v in vectors
        if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    out = []
    for q, a in ok:
        if is_query(q):
            found = sorted((-max(-limit, min(limit, sum(x * y for x, y in zip(a, b)))), i) for i, b in ok if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found[:k])]
    return out


BASE = {
    "assign": (r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A, 2, 8),
    "access": ("AKIA[A-Z0-9]+", 0, 0, 16),
    "hex": ("[0-9a-f]+", 0, 0, 32),
}


def base_secrets(text):
    out = []
    for n, (kind, (pattern, flags, group, least)) in enumerate(BASE.items()):
        out += [(m.start(), n, kind, m.end()) for m in re.finditer(pattern, text or "", flags) if len(m[group]) >= least]
    return [f"{kind}:{a}:{b}" for a, _, kind, b in sorted(out)]


def seats_one_by_one(weights, seats, most):
    out = [0] * len(weights)
    for _ in range(seats):
        best = [(-w / (2 * s + 1), i) for i, (w, s) in enumerate(zip(weights, out)) if s < most[i] and w > 0]
        if best:
            out[min(best)[1]] += 1
    return out


def code_length(train, text, order=4):
    """Bits of PPM with escape method C, without exclusions, contexts padded with zero bytes."""
    import math

    follow = defaultdict(Counter)
    for t in train:
        data = bytes(order) + t.encode()
        for i in range(order, len(data)):
            for k in range(order + 1):
                follow[data[i - k : i]][data[i]] += 1
    total = 0.0
    data = bytes(order) + text.encode()
    for i in range(order, len(data)):
        for k in range(order, -1, -1):
            seen = follow.get(data[i - k : i])
            if not seen:
                continue
            n, d = sum(seen.values()), len(seen)
            if data[i] in seen:
                total -= math.log2(seen[data[i]] / (n + d))
                break
            total -= math.log2(d / (n + d))
        else:
            total += 8
    return total

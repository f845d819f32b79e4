"""Plain Python versions of the operators, for small fixtures."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")
WS = "\x20\x09\x0a\x0b\x0c\x0d"
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SHAPES = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def substring_dedup(texts, width):
    words = [WORD.findall(t or "") for t in texts]
    seen = Counter(tuple(w[i : i + width]) for w in words for i in range(len(w) - width + 1))
    out = []
    for w in words:
        gone = {p for i in range(len(w) - width + 1) if seen[tuple(w[i : i + width])] > 1 for p in range(i, i + width)}
        out.append((len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)))
    return out


def line_dedup(texts, min_docs):
    key = lambda x: x.strip(WS).translate(UPPER)
    lines = [(t or "").split("\n") for t in texts]
    docs = Counter(k for own in lines for k in {key(x) for x in own} if k)
    return [(len(own), sum(docs[key(x)] >= min_docs for x in own), "\n".join(x for x in own if docs[key(x)] < min_docs)) for own in lines]


def shingles(text, n):
    w = WORD.findall((text or "").translate(UPPER))
    return {tuple(w[i : i + n]) for i in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())


def components(texts, ids, n, percent):
    sets = [shingles(t, n) for t in texts]
    parent = list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= percent * len(sets[i] | sets[j]):
                parent[find(i)] = find(j)
    least: dict = {}
    for i, x in enumerate(ids):
        if x is not None:
            least[find(i)] = min(x, least.get(find(i), x))
    return [(len(sets[i]), least.get(find(i)) if sets[i] else ids[i]) for i in range(len(texts))]


def luhn(d):
    return sum(v if i % 2 == 0 else 2 * v - 9 * (v > 4) for i, v in enumerate(map(int, reversed(d)))) % 10 == 0


def personal(text):
    out = []
    for kind, shape in SHAPES.items():
        for m in re.finditer(shape, text or ""):
            d = re.sub("[^0-9]", "", m[0])
            good = kind == "email" or (kind == "ip" and all(int(x) <= 255 for x in m[0].split("."))) or (kind == "card" and 13 <= len(d) <= 19 and luhn(d)) or (kind == "phone" and 9 <= len(d) <= 15)
            if good:
                out.append((kind, m.start(), m.end()))
    return out


def statistics(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {p for i, g in enumerate(grams) if seen[g] > 1 for p in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(covered)


def fill(sizes, leads, max_tokens, max_segments, max_loss):
    """Bins of pieces (item, start, length), by a look at every piece for every choice."""
    start, out = [0] * len(sizes), []
    left = lambda i: sizes[i] - start[i]
    quiet = lambda i: max(0, min(leads[i], sizes[i]) - start[i])
    for i in range(len(sizes)):
        while left(i) >= max_tokens and quiet(i) + max_loss >= max_tokens:
            out.append([(i, start[i], max_tokens)])
            start[i] += max_tokens
    while any(left(i) for i in range(len(sizes))):
        pool = [i for i in range(len(sizes)) if left(i)]
        mean = lambda f: sum(map(f, pool)) / len(pool)
        w = (mean(left) / max_tokens**3, 1 / max_segments**3, mean(lambda i: left(i) - quiet(i)) / max_loss**3)
        room, pieces = [max_tokens, max_segments, max_loss], []
        while room[0] and room[1] and pool:
            fits = [i for i in pool if left(i) <= room[0] and left(i) - quiet(i) <= room[2]]
            if fits:
                key = lambda i: (left(i) * (w[0] * room[0]) + (left(i) - quiet(i)) * (w[2] * room[2]), left(i), left(i) - quiet(i), -i)
                i = max(fits, key=key)
                take = left(i)
            else:
                longest = lambda i: min(left(i), room[0], quiet(i) + room[2])
                i = max(pool, key=lambda i: (longest(i), left(i), left(i) - quiet(i), -i))
                take = longest(i)
                if not take:
                    break
            loss = max(0, take - quiet(i))
            pieces.append((i, start[i], take))
            start[i] += take
            room = [room[0] - take, room[1] - 1, room[2] - loss]
            pool.remove(i)
        out.append(pieces)
    return out


def minimum_covariance(x, support, floor, max_scale, median, inner, starts=300):
    """Location and scatter of the subset of least determinant over many random starts, then of all within ``inner``; the scale."""
    r, n, best = np.random.default_rng(1), len(x), None
    h = int(support * n)
    scatter = lambda y: np.cov(y.T, bias=True) + np.diag(np.square(floor))
    d2 = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    for _ in range(starts):
        own = x[r.choice(n, x.shape[1] + 1, replace=False)]
        m, c, before = own.mean(0), scatter(own), np.inf
        while True:
            own = x[np.argsort(d2(m, c))[:h]]
            m, c = own.mean(0), scatter(own)
            now = np.linalg.slogdet(c)[1]
            if now >= before - 1e-9:
                break
            before = now
        if best is None or now < best[0]:
            best = (now, m, c)
    scale = lambda m, c: min(max_scale, median / np.median(d2(m, c)))
    _, m, c = best
    own = x[d2(m, c) * scale(m, c) <= inner]
    m, c = own.mean(0), scatter(own)
    return m, c, scale(m, c)

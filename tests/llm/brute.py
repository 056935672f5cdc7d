"""Plain-Python versions of what the operators must give."""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter, defaultdict
from itertools import combinations

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I)


def words(text):
    return WORD.findall(text or "")


def shingles(text, k):
    w = [x.translate(LOWER) for x in words(text)]
    k_ = min(k, len(w))
    return frozenset(tuple(w[i:i + k_]) for i in range(len(w) - k_ + 1)) if k_ else frozenset()


def groups(pairs, nodes):
    up = {n: n for n in nodes}

    def find(n):
        while up[n] != n:
            n = up[n]
        return n

    for a, b in pairs:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def near_components(docs, k=4, percent=85):
    """docs: {id: text} -> {id: (set size, smallest id reachable)}"""
    sets = {i: shingles(t, k) for i, t in docs.items()}
    pairs = [(a, b) for a, b in combinations(sets, 2)
             if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]
    root = groups(pairs, sets)
    return {i: (len(sets[i]), root[i]) for i in sets}


def quality(text):
    w = words(text)
    runs = Counter(tuple(w[i:i + 8]) for i in range(len(w) - 7))
    covered = {j for i in range(len(w) - 7) if runs[tuple(w[i:i + 8])] > 1 for j in range(i, i + 8)}
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    failed = len(w) < 20 or 100 * len(covered) > 30 * len(w)
    symbols = sum(c in "#*$%&|<>" for c in text or "")
    return len(w), sum(map(len, w)), symbols, len(lines) - len(set(lines)), len(covered), failed, len(lines)


def base_spans(text):
    text = text or ""
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    found += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(found)


def entropy_spans(text, classes, allowed, window):
    text, base, out = text or "", base_spans(text), set()
    for _, pattern, _, bits in classes:
        for m in re.finditer(pattern, text):
            s = m[0]
            if any(re.fullmatch(f"(?s:{a})", s) for a in allowed):
                continue
            hot = [i for i in range(len(s) - window + 1)
                   if -sum(c / window * math.log2(c / window) for c in Counter(s[i:i + window]).values()) >= bits - 1e-9]
            if hot:
                a, b = m.start() + hot[0], m.start() + hot[-1] + window
                if not any(x[0] <= a and b <= x[2] for x in base):
                    out.add((a, 3, b))
    return sorted(out)


def redacted(text, spans, mark="[SECRET]"):
    out, at = [], 0
    for start, _, end in sorted(spans):
        if start > at or at == 0:
            out += [text[at:start], mark]
        at = max(at, end)
    return "".join(out) + text[at:]


def targets(sizes, weights=(5, 2, 1), most=3):
    """sizes: {source: words} -> {source: target}, by resharing again and again."""
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[i % len(weights)] for i, s in enumerate(order)}
    total, full = sum(sizes.values()), {}
    while True:
        rest, open_ = total - sum(full.values()), [s for s in order if s not in full]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_) for s in open_}
        over = [s for s in open_ if share[s] > most * sizes[s]]
        if not over:
            return {**full, **share}
        full |= {s: most * sizes[s] for s in over}


def sha256(text):
    return hashlib.sha256(text.encode()).hexdigest()


def by_group(rows, key):
    out = defaultdict(list)
    for r in rows:
        out[r[key]].append(r)
    return out

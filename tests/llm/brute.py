"""Plain versions of the operators, one document at a time."""

import hashlib
import re
from collections import Counter


def lines(rows, min_words=8):
    """rows (doc_id, text) in order -> (n_lines, n_removed, n_runs, kept text) of each."""
    seqs = []
    for _, t in rows:
        every = (t or "").split("\n")
        seqs.append((every, [i for i, x in enumerate(every) if x.split()]))
    gone = [set() for _ in rows]
    for size in range(1, max((len(at) for _, at in seqs), default=0) + 1):
        seen, again = set(), False
        for d, (every, at) in enumerate(seqs):
            for n in range(len(at) - size + 1):
                run = tuple(every[i] for i in at[n : n + size])
                if run in seen:
                    again = True
                    if sum(len(x.split()) for x in run) >= min_words:
                        gone[d].update(range(n, n + size))
                seen.add(run)
        if not again:  # then no longer run is repeated either
            break
    out = []
    for g, (every, at) in zip(gone, seqs, strict=True):
        drop = {at[n] for n in g}
        out.append((len(every), len(g), sum(n - 1 not in g for n in g), "\n".join(x for i, x in enumerate(every) if i not in drop)))
    return out


def suffixes(rows, window=100):
    """-> (n_bytes, n_removed, n_spans, kept bytes) of each."""
    seen, out = set(), []
    for _, t in rows:
        b = (t or "").encode()
        m, last = bytearray(len(b)), 0
        for s in range(len(b) - window + 1):
            w = b[s : s + window]
            if w in seen:
                for j in range(max(s, last), s + window):
                    m[j] = 1
                last = s + window
            seen.add(w)
        out.append((len(b), sum(m), sum(1 for i in range(len(b)) if m[i] and (i == 0 or not m[i - 1])), bytes(c for c, f in zip(b, m, strict=True) if not f)))
    return out


def links(rows, n=5, threshold=0.8):
    """-> (place of the first row of the group, number of links) of each."""
    sets = []
    for _, t in rows:
        w = re.findall(r"\w+", (t or "").lower())
        sets.append(frozenset(tuple(w[i : i + n]) for i in range(max(1, len(w) - n + 1))) if w else frozenset())
    at: dict = {}
    for i, s in enumerate(sets):
        for x in s:
            at.setdefault(x, []).append(i)
    count, parent = Counter(), list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in enumerate(sets):
        for j, c in Counter(j for x in s for j in at[x]).items():
            if j != i and c >= threshold * (len(s) + len(sets[j]) - c) - 1e-9:
                count[i] += 1
                a, b = find(i), find(j)
                parent[max(a, b)] = min(a, b)
    return [(find(i), count[i]) for i in range(len(rows))]


def sha(x):
    return hashlib.sha256(x if isinstance(x, bytes) else x.encode()).hexdigest()

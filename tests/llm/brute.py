"""Plain re-statements of the operators' contracts, for small inputs."""

import hashlib
import re
from collections import Counter

import numpy as np


def lower(text):
    return re.sub("[A-Z]", lambda m: m.group().lower(), text or "")


def shingle_sets(rows, n):
    out = []
    for doc_id, text in rows:
        w = re.findall(r"[^\x20\x09-\x0d]+", lower(text))
        out.append((doc_id, {tuple(w[k:k + n]) for k in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())))
    return out


def jaccard_components(rows, n=4, num=85, den=100):
    """Counter of (doc_id, n_shingles, component_id)."""
    sets = shingle_sets(rows, n)
    root = list(range(len(sets)))

    def find(a):
        while root[a] != a:
            root[a] = root[root[a]]
            a = root[a]
        return a

    index = {}
    for i, (_, s) in enumerate(sets):
        for j, k in Counter(j for g in s for j in index.get(g, ())).items():
            if den * k >= num * (len(s) + len(sets[j][1]) - k):
                root[find(i)] = find(j)
        for g in s:
            index.setdefault(g, []).append(i)
    least = {}
    for i, (d, _) in enumerate(sets):
        r = find(i)
        if d is not None and (least.get(r) is None or d < least[r]):
            least[r] = d
    return Counter((d, len(s), least.get(find(i)) if s else d) for i, (d, s) in enumerate(sets))


def repeat_masks(rows, width=100):
    """One boolean mask per row: bytes covered by a string that also starts earlier."""
    first = {}
    last = (1, 0)
    for d, text in rows:
        b = (text or "").encode()
        key = (0, d) if d is not None else last
        for p in range(len(b) - width + 1):
            at = (key, p)
            h = b[p:p + width]
            if h not in first or at < first[h]:
                first[h] = at
    masks = []
    for d, text in rows:
        b = (text or "").encode()
        key = (0, d) if d is not None else last
        m = np.zeros(len(b) + 1, int)
        for p in range(len(b) - width + 1):
            if first[b[p:p + width]] < (key, p):
                m[p] += 1
                m[p + width] -= 1
        masks.append(np.cumsum(m)[:-1] > 0)
    return masks


def repeat_digest(rows, width=100):
    out = Counter()
    for (d, text), m in zip(rows, repeat_masks(rows, width)):
        b = np.frombuffer((text or "").encode(), np.uint8)
        edges = int((m[1:] & ~m[:-1]).sum() + (m[0] if len(m) else 0))
        out[(d, len(b), int(m.sum()), edges, hashlib.sha256(b[~m].tobytes()).hexdigest())] += 1
    return out


def edit_distance_in(segment: bytes, text: bytes) -> int:
    """Fewest edits of ``segment`` against any part of ``text``."""
    row = [0] * (len(text) + 1)
    for i, c in enumerate(segment, 1):
        new = [i]
        for j, x in enumerate(text, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != x)))
        row = new
    return min(row)

"""Brute-force versions of the operators, and a small table of awkward documents."""

import collections
import hashlib
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long"
PROSE = " ".join(f"w{i} of the end{i % 7}" for i in range(60))
AWKWARD = [
    (1, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (2, PROSE, "en", "a", 1), (3, None, None, None, None),
    (4, "", "en", "b", 0), (None, "a b c", "en", None, 5), (5, "Of " * 300, "en", "a", 900),
    (6, PROSE.upper() + " more words here", "en", "c", 1), (7, "x" * 5000 + " \n\n y", None, "c", 1),
    (8, PROSE + " tail " + " ".join(f"z{i}" for i in range(50)), "fr", "b", 1), (9, " \t\n", "en", "a", 3),
    (10, PROSE.replace("w7 ", "changed "), "en", "a", 1), (11, "é ñ 😀 end", "es", "d", 10),
]


def words(text):
    return WORD.findall(text or "")


def substring_dedup(rows, k=20):
    docs = [(2**63 - 1 if d is None else d, words(t)) for d, t in rows]
    first = {}
    for d, w in docs:
        for i in range(len(w) - k + 1):
            key = tuple(w[i:i + k])
            first[key] = min(first.get(key, (d, i)), (d, i))
    out = []
    for (d, w), (own, _) in zip(docs, rows, strict=True):
        gone = set()
        for i in range(len(w) - k + 1):
            if first[tuple(w[i:i + k])] < (d, i):
                gone.update(range(i, i + k))
        kept = " ".join(x for i, x in enumerate(w) if i not in gone)
        out.append((own, len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    return out


LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def near_dup(rows, k=4, percent=80):
    sets = []
    for _, t in rows:
        w = words((t or "").translate(LOWER))
        sets.append({tuple(w[i:i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    least = collections.defaultdict(lambda: 2**63 - 1)
    ids = [2**63 - 1 if d is None else d for d, _ in rows]
    for i, d in enumerate(ids):
        least[find(i)] = min(least[find(i)], d)
    # rows without words stand alone
    comp = [least[find(i)] if sets[i] else ids[i] for i in range(len(rows))]
    return [(d, len(s), None if c == 2**63 - 1 else c, i == c)
            for (d, _), s, c, i in zip(rows, sets, comp, ids, strict=True)]

"""Plain Python versions of the operators' contracts."""

import hashlib
import re
from collections import Counter, defaultdict

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SPACE = " \t\n\x0b\x0c\r"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def exact(rows):
    groups = defaultdict(list)
    norm = {}
    for i, (d, t) in enumerate(rows):
        norm[i] = re.sub(r"[\x20\x09-\x0D]", "", t or "")
        groups[norm[i]].append((-len(t or ""), d is None, d if d is not None else 0, d))
    return sorted(((d, min(groups[norm[i]])[3], len(groups[norm[i]]), d == min(groups[norm[i]])[3], sha(norm[i]))
                   for i, (d, _) in enumerate(rows)), key=str)


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return frozenset(tuple(w[i:i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def near(rows):
    """Each row is a document, whatever its id; a null id is the last choice for a component."""
    sets = [shingles(t) for _, t in rows]
    parent = list(range(len(rows)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, a in enumerate(sets):
        for j, b in enumerate(sets[:i]):
            both = len(a & b)
            if both and 100 * both >= 75 * len(a | b):
                x, y = find(i), find(j)
                parent[max(x, y)] = min(x, y)
    least = {}
    for i, (d, _) in enumerate(rows):
        least[find(i)] = min(least.get(find(i), (True, 0)), (d is None, d or 0))
    name = lambda i: None if least[find(i)][0] else least[find(i)][1]
    return sorted(((d, len(sets[i]), name(i)) for i, (d, _) in enumerate(rows)), key=str)


def lines(rows, min_docs=10):
    key = lambda x: x.strip(SPACE).translate(LOW)
    times = Counter(k for _, t in rows for k in {key(x) for x in (t or "").split("\n")} if k)
    out = []
    for d, t in rows:
        all_lines = (t or "").split("\n")
        kept = [x for x in all_lines if not key(x) or times[key(x)] < min_docs]
        out.append((d, len(all_lines), len(all_lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)

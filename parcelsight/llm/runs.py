"""Periodic runs of words, found on a grammar.

The word ids of each document are compressed by Re-Pair: rounds replace the most frequent pairs of
neighbours by new symbols until no pair of a document is left twice. Every boundary between two words
is then the boundary of one rule, which stands for all places that the rule was put, or lies in what
is left at the top. A run that lies in a rule's text and crosses its boundary is found there once and
translated to all places of the rule; runs across boundaries at the top are found in the document.
The smallest rule that holds a whole run yields all of it, others yield parts of it, which merge into it.
"""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator
from itertools import chain, count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from parcelsight.llm.common import mix

#: Least length of a run in words and in periods.
LEAST_WORDS, LEAST_PERIODS = 6, 4
#: Words that are worked on together; a longer document is on its own.
SLICE_WORDS = 1 << 18
_BASE = 0xD6E8FEB86659FD93


def repair(symbols: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, dict[str, np.ndarray]]:
    """(top, again, rules) of the grammars of several documents, whose words lie one after the other.

    ``top`` is true where no rule covers the boundary before a word, ``again`` where a word and the next
    are a pair that its document holds more than once. Of rules: left and size in words, and the places
    (rule, start) where each was put.
    A pair that is alone in its document stays so, whatever is replaced, and isn't looked at again.
    """
    n = len(symbols)
    s, place, size, doc = symbols.astype(np.int64), np.arange(n), np.ones(n, np.int64), doc.astype(np.int64)
    top, again = np.ones(n, bool), np.zeros(n, bool)
    maybe = np.zeros(n, bool)
    maybe[:-1] = doc[1:] == doc[:-1]
    fresh = first = int(symbols.max(initial=0)) + 1
    left, total, rule_at, starts = [], [], [], []
    rounds = 0
    while True:
        near = maybe.copy()
        near[1:] |= maybe[:-1]
        if not near.all():
            s, place, size, doc, maybe = s[near], place[near], size[near], doc[near], maybe[near]
        at = np.flatnonzero(maybe)
        if len(at) < 2:
            break
        twin = np.zeros(len(s), bool)
        twin[at] = s[at] == s[at + 1]
        if twin.any():  # aaaa holds the pair aa twice
            steps = np.arange(len(s))
            begin = twin.copy()
            begin[1:] &= ~twin[:-1]
            odd = twin & ((steps - np.maximum.accumulate(np.where(begin, steps, 0))) % 2 == 1)
            at = at[~odd[at]]
        wide = np.uint64(fresh + 1)
        key = mix((doc[at].astype(np.uint64) * wide + s[at].astype(np.uint64)) * wide + s[at + 1].astype(np.uint64))
        order = np.argsort(key)
        ordered = key[order]
        new = np.ones(len(at), bool)
        new[1:] = ordered[1:] != ordered[:-1]
        group = np.empty(len(at), np.int64)
        group[order] = np.cumsum(new) - 1
        times = np.bincount(group)
        maybe[at[times[group] < 2]] = False
        if not rounds:
            again[place[maybe]] = True
            again[place[twin]] = True
        rounds += 1
        rank = np.empty(len(times), np.int64)
        rank[np.argsort(times, kind="stable")] = np.arange(len(times))
        rank[times < 2] = -1
        weight = np.full(len(s) + 2, -1)
        weight[at + 1] = rank[group]
        mine = weight[at + 1]
        won = (mine > weight[at]) & (mine > weight[at + 2])
        won &= np.bincount(group[won], minlength=len(times))[group] > 1
        chosen, which = at[won], group[won]
        if not len(chosen):
            continue
        names, one, which = np.unique(which, return_index=True, return_inverse=True)
        left.append(size[chosen[one]])
        total.append(size[chosen[one]] + size[chosen[one] + 1])
        rule_at.append(which + fresh - first)
        starts.append(place[chosen])
        top[place[chosen + 1]] = False
        s[chosen] = which + fresh
        size[chosen] += size[chosen + 1]
        maybe[chosen] = maybe[chosen + 1]
        fresh += len(names)
        stay = np.ones(len(s), bool)
        stay[chosen + 1] = False
        s, place, size, doc, maybe = s[stay], place[stay], size[stay], doc[stay], maybe[stay]
    joined = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    return top, again, {"left": joined(left), "size": joined(total), "rule": joined(rule_at), "start": joined(starts)}


class _Hashes:
    """Hashes of all windows of a word sequence, and the longest common extensions of two of its places."""

    def __init__(self, symbols: np.ndarray) -> None:
        n = len(symbols)
        powers = []
        for base in (_BASE, pow(_BASE, -1, 1 << 64)):
            row = np.full(n + 1, base, np.uint64)
            row[0] = 1
            powers.append(np.multiply.accumulate(row))
        self.n, self.down = n, powers[1]
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(mix(symbols.astype(np.uint64) + np.uint64(77)) * powers[0][:n], out=self.sums[1:])

    def window(self, at: np.ndarray, size) -> np.ndarray:
        return (self.sums[at + size] - self.sums[at]) * self.down[at]

    def forward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words from a and b on are equal, ``most`` at most."""
        found = np.zeros(len(a), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            fits = np.flatnonzero(found + step <= most)
            x, y = a[fits] + found[fits], b[fits] + found[fits]
            found[fits[self.window(x, step) == self.window(y, step)]] += step
            step >>= 1
        return found

    def backward(self, a: np.ndarray, b: np.ndarray, most: np.ndarray) -> np.ndarray:
        """How many words that end before a and b are equal, ``most`` at most."""
        found = np.zeros(len(a), np.int64)
        step = 1 << int(most.max(initial=0)).bit_length()
        while step:
            fits = np.flatnonzero(found + step <= most)
            x, y = a[fits] - found[fits] - step, b[fits] - found[fits] - step
            found[fits[self.window(x, step) == self.window(y, step)]] += step
            step >>= 1
        return found


def _crossing(words: np.ndarray, doc: np.ndarray, ends: np.ndarray, again: np.ndarray,
              b: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """(boundary number, period, start, end) of the runs within [lo, hi) that cross the boundary before word b.

    Such a run has two periods at least on one side of the boundary, so that the window of m <= period words
    on that side comes again a period further away.
    """
    hashes, n, out = _Hashes(words), len(words), []
    # how far runs that are known already reach from each boundary
    low_end, high_end = b.copy(), b.copy()

    def extend(which: np.ndarray, i: np.ndarray, q: np.ndarray) -> None:
        low, high = lo[which], hi[which]
        start = i - hashes.backward(i, i + q, i - low)
        end = i + q + hashes.forward(i, i + q, high - i - q)
        long = end - start >= np.maximum(LEAST_WORDS, LEAST_PERIODS * q)
        out.append(np.stack([which[long], q[long], start[long], end[long]]))
        np.minimum.at(low_end, which[long], start[long])
        np.maximum.at(high_end, which[long], end[long])

    for q in (1, 2, 3):
        right = np.flatnonzero(b + q < hi)
        x = b[right]
        right = right[(words[x] == words[x + q]) & (words[x - 1] == words[x - 1 + q])]
        extend(right, b[right], np.full(len(right), q))
        left = np.flatnonzero(b - 1 - q >= lo)
        x = b[left]
        left = left[(words[x] == words[x - q]) & (words[x - 1] == words[x - 1 - q])]
        extend(left, b[left] - q, np.full(len(left), q))
    m = 4
    alive = np.flatnonzero(again[:-2] & again[1:-1] & np.append(again[2:-1], False)) if n > m else np.zeros(0, int)
    while True:
        alive = alive[alive + m <= ends[doc[alive]]]
        open_ = np.flatnonzero(hi - lo >= 4 * m)
        if len(alive) < 2 or not len(open_):
            break
        key = hashes.window(alive, m) + mix(doc[alive].astype(np.uint64) + np.uint64(1))
        order = np.argsort(key, kind="stable")
        key, alive = key[order], alive[order]
        new = np.append(True, key[1:] != key[:-1])
        group = np.cumsum(new) - 1
        keep = np.bincount(group)[group] > 1
        alive, group = alive[keep], group[keep]
        line = group * (n + 1) + alive  # ascending
        seat = np.full(n, -1)
        seat[alive] = np.arange(len(alive))
        for side in (1, -1):
            # within a run that is known the window comes again at multiples of its period only
            if side > 0:
                which = open_[b[open_] + 2 * m <= hi[open_]]
                window = b[which]
                bound = np.maximum(window + m, high_end[which] - m + 1)
            else:
                which = open_[b[open_] - 2 * m >= lo[open_]]
                window = b[which] - m
                bound = np.minimum(window - m, low_end[which] - 1)
            here = seat[window]
            ok = (here >= 0) & (bound >= 0)
            which, window, here, bound = which[ok], window[ok], here[ok], bound[ok]
            own = group[here]
            at = np.searchsorted(line, own * (n + 1) + np.minimum(bound, n), "left" if side > 0 else "right") - (side < 0)
            while len(which):
                ok = (at >= 0) & (at < len(alive))
                ok &= group[np.where(ok, at, 0)] == own
                which, window, own, at = which[ok], window[ok], own[ok], at[ok]
                q = side * (alive[at] - window)
                room = hi[which] - b[which] if side > 0 else b[which] - lo[which]
                ok = (q < 2 * m) & (2 * q <= room)
                which, window, own, at, q = which[ok], window[ok], own[ok], at[ok], q[ok]
                if side > 0:
                    ok = np.flatnonzero(b[which] + q < hi[which])
                    ok = ok[words[b[which[ok]] - 1] == words[b[which[ok]] - 1 + q[ok]]]
                    extend(which[ok], b[which[ok]], q[ok])
                else:
                    ok = np.flatnonzero(b[which] - q > lo[which])
                    ok = ok[words[b[which[ok]]] == words[b[which[ok]] - q[ok]]]
                    extend(which[ok], b[which[ok]] - q[ok], q[ok])
                at = at + side
        alive = np.sort(alive)
        m *= 2
    found = np.concatenate(out, 1).astype(np.int64)
    # of equal stretches at a boundary the smallest period stays: larger ones are its multiples
    order = np.lexsort((found[1], found[3], found[2], found[0]))
    found = found[:, order]
    same = np.zeros(found.shape[1], bool)
    same[1:] = (found[[0, 2, 3], 1:] == found[[0, 2, 3], :-1]).all(0)
    return found[:, ~same]


def _plain_runs(words: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs by comparing the sequence with itself at each distance: the exact way out where hashes clash."""
    seen: dict[tuple[int, int], int] = {}
    for q in range(1, len(words) // LEAST_PERIODS + 1):
        equal = np.concatenate([[False], words[:-q] == words[q:], [False]])
        edges = np.flatnonzero(equal[1:] != equal[:-1]).reshape(-1, 2)
        for a, b in edges[edges[:, 1] - edges[:, 0] + q >= max(LEAST_WORDS, LEAST_PERIODS * q)].tolist():
            seen.setdefault((a, b + q), q)
    return sorted((a, b - a, q) for (a, b), q in seen.items())


def word_runs(words: np.ndarray, counts: np.ndarray) -> list[list[tuple[int, int, int]]]:
    """(start, length, period) of all runs of each document; ``counts`` words of each lie one after the other."""
    ends = np.cumsum(counts)
    begins = ends - counts
    runs: list[list[tuple[int, int, int]]] = [[] for _ in counts]
    doc = np.repeat(np.arange(len(counts)), counts)
    if len(words) < LEAST_WORDS:
        return runs
    top, again, rules = repair(words, doc)
    # places of a rule lie together, its first place stands for it
    order = np.argsort(rules["rule"], kind="stable")
    rule, start = rules["rule"][order], rules["start"][order]
    first = np.searchsorted(rule, np.arange(len(rules["size"]) + 1))
    large = np.flatnonzero(rules["size"] >= LEAST_WORDS)
    own = start[first[large]]
    outer = np.flatnonzero(top)
    outer = outer[outer > 0]
    outer = outer[(doc[outer] == doc[outer - 1]) & again[outer - 1]]
    b = np.concatenate([own + rules["left"][large], outer])
    lo = np.concatenate([own, begins[doc[outer]]])
    hi = np.concatenate([own + rules["size"][large], ends[doc[outer]]])
    which, q, a, z = _crossing(words, doc, ends, again, b, lo, hi)
    # a boundary of a rule stands for all its places
    inner = which < len(large)
    of = large[which[inner]]
    places = first[of + 1] - first[of]
    item = np.repeat(np.arange(len(of)), places)
    moved = start[np.repeat(first[of], places) + np.arange(len(item)) - np.repeat(np.cumsum(places) - places, places)]
    moved = moved - np.repeat(start[first[of]], places)
    q = np.concatenate([q[inner][item], q[~inner]])
    a, z = (np.concatenate([x[inner][item] + moved, x[~inner]]) for x in (a, z))
    order = np.lexsort((-z, a, q))  # parts of a run lie behind it
    q, a, z = q[order], a[order], z[order]
    if not len(q):
        return runs
    new = np.append(True, q[1:] != q[:-1])
    lift = np.cumsum(new) * (len(words) + 1)
    reach = np.maximum.accumulate(z + lift)
    whole = np.append(True, (z + lift)[1:] > reach[:-1])
    q, a, z = q[whole], a[whole], z[whole]
    order = np.lexsort((q, z, a))
    q, a, z = q[order], a[order], z[order]
    least = np.append(True, (a[1:] != a[:-1]) | (z[1:] != z[:-1]))
    wrong = set()
    for period, s, e in zip(q[least].tolist(), a[least].tolist(), z[least].tolist(), strict=True):
        d = int(doc[s])
        if not ((words[s:e - period] == words[s + period:e]).all()
                and (s == begins[d] or words[s - 1] != words[s - 1 + period])
                and (e == ends[d] or words[e] != words[e - period])):
            wrong.add(d)
        runs[d].append((s - int(begins[d]), e - s, period))
    for d in wrong:
        runs[d] = _plain_runs(words[begins[d]:ends[d]])
    return [sorted(r, key=lambda x: (x[0], x[2])) for r in runs]


def collapse(words: list[bytes], runs: list[tuple[int, int, int]]) -> bytes:
    """The words without what repeats in runs, joined by a space."""
    if not runs:
        return b" ".join(words)
    out, at = [], 0
    for a, z in sorted((s + q, s + n) for s, n, q in runs):
        if a > at:
            out += words[at:a]
        at = max(at, z)
    return b" ".join(out + words[at:])


def periodic_runs(docs: DataFrame, rewrite: Callable[[int | None, list[bytes]], list[bytes]] | None = None,
                  key: str | None = None) -> DataFrame:
    """All runs of repeated words of each whole text, and the text with each run cut to its first period.

    Takes docs with a column text, passes the others on and adds ``n_words``, ``runs``, an array of
    (start, length, period) by start and period, and ``collapsed``. Words are ``[^\\x20\\x09-\\x0D]+``. A run is a
    stretch with smallest period q of at least 6 words and 4 periods that no neighbour extends. Words of any
    run behind its first q are dropped, the others stay, joined by a space. ``rewrite`` may change a row's words
    before; it gets the value of column ``key`` and the words.
    Null and empty texts have no words and no runs. Rows are independent, so that ties, null or repeated ids and
    repeated rows need no rule. Very long texts are worked on whole. An empty table gives an empty result.
    Columns of ``docs`` named like a result give way to it.
    """
    made = ("n_words", "runs", "collapsed")
    keep = [c for c in docs.columns if c != "text" and c not in made]
    run_type = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])

    def results(rows: list[list[bytes]]) -> list[tuple[int, list, bytes]]:
        number = defaultdict(count().__next__)
        sizes = np.array([len(r) for r in rows], np.int64)
        ids = np.fromiter(map(number.__getitem__, chain.from_iterable(rows)), np.int64, sizes.sum())
        runs = word_runs(ids, sizes)
        return [(len(row), found, collapse(row, found)) for row, found in zip(rows, runs, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def emit(part: pa.RecordBatch, rows: list[list[bytes]]) -> pa.RecordBatch:
            n, found, texts = zip(*results(rows), strict=True)
            flat = [x for f in found for x in f]
            start, length, period = zip(*flat, strict=True) if flat else ((), (), ())
            runs = pa.ListArray.from_arrays(
                pa.array(np.cumsum([0, *map(len, found)]), pa.int32()),
                pa.StructArray.from_arrays([pa.array(x, pa.int64()) for x in (start, length, period)],
                                           fields=list(run_type)))
            made_columns = [pa.array(n, pa.int64()), runs, pa.array([t.decode() for t in texts], pa.string())]
            return pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *made_columns], names=[*keep, *made])

        for batch in batches:
            at, rows, held = 0, [], 0
            keys = batch.column(batch.num_columns - 1).to_pylist() if rewrite else None
            for i, text in enumerate(batch.column("text")):
                words = (text.as_py() or "").encode().split()
                if rewrite:
                    words = rewrite(keys[i], words)
                if rows and held + len(words) > SLICE_WORDS:
                    yield emit(batch.slice(at, len(rows)), rows)
                    at, rows, held = i, [], 0
                rows.append(words)
                held += len(words)
            if rows:
                yield emit(batch.slice(at, len(rows)), rows)

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    schema = ", ".join([*kinds, "n_words long", "runs array<struct<start long, length long, period long>>",
                        "collapsed string"])
    given = [docs[f"`{c}`"] for c in [*keep, "text"]]
    if rewrite:
        given.append(docs[f"`{key}`"].alias("__rewrite_key"))
    return docs.select(*given).mapInArrow(run, schema)

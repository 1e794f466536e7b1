"""BPE encoding and decoding with a tokenization automaton.

The merges are compiled, one gadget after the other, into a deterministic automaton over tokens: the
gadget of (u, v) sends all u-arcs to a copy of their target that has no v-arc, and gives every state
with a u-arc an arc for the joined token to where v led. A word has exactly one accepted token
sequence. Copies differ from their origin by one arc, so the state behind a token is stored as the arcs
that gadgets took away and their time, and the transition table is filled in as tokens are met.
"""

from __future__ import annotations

import hashlib
import json
import re
import unicodedata
from collections.abc import Iterable, Iterator
from functools import cached_property
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame

#: The byte alphabet of byte-level vocabularies keeps printable bytes as they are.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
#: Chunks that a worker remembers, the longest of them, transitions that it keeps in the table, texts that it
#: holds at once and their characters.
CACHE_CHUNKS, CACHE_LENGTH, TABLE_SIZE, SLICE_ROWS, SLICE_LETTERS = 300_000, 48, 400_000, 1024, 2 << 20
#: Letters that the reference tokenizers do not know as such yet.
_LATE_LETTERS = "\u209d-\u209f"
#: Bits of a token id; before the first token, a place that no arcs lead to, the mark behind a word's bytes.
_ID_BITS, _ROOT, _NOWHERE, _END = 20, -1, -2, 256
_MARK = re.compile(r"(?<=[a-z])([.,;:!?])[ \n]")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte."""
    spare = iter(range(256, 512))
    plain = set(_PLAIN)
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


class Automaton:
    """The compiled merges of one tokenizer file and its word splitting."""

    def __init__(self, spec: dict) -> None:
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.symbols = dict(enumerate(byte_alphabet()))
        steps = spec["normalizer"]["normalizers"]
        if [s["type"] for s in steps] != ["NFC", "Replace", "Lowercase"]:
            raise ValueError("unknown normaliser")
        split = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.parts = regex.compile(split.replace(r"\p{L}", rf"[\p{{L}}--[{_LATE_LETTERS}]]"), regex.V1)
        self.space = regex.compile(steps[1]["pattern"]["Regex"])
        self.cut = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self._build(model["merges"])
        self._texts = {i: t for t, i in self.ids.items()} | {i: t for t, i in self.special.items()}
        last = max(self._texts, default=-1)
        self.numbers = pa.array([str(i) for i in range(last + 1)], pa.string())
        self.labels = pa.array([self._texts.get(i) for i in range(last + 1)], pa.string())

    def _build(self, merges: list) -> None:
        ids = self.ids
        #: Step whose gadget took an arc from the state behind a token, by both; birth and parts of joined tokens.
        self.took: dict[int, int] = {}
        self.born: dict[int, int] = {}
        self.left: dict[int, int] = {}
        self.right: dict[int, int] = {}
        self.table: dict[int, bool] = {}  # arcs that words have asked for, by token before and token
        pairs = [tuple(pair.split(" ")) if isinstance(pair, str) else tuple(pair) for pair in merges]
        for step, (u, v) in enumerate(pairs):
            a, b, joined = ids[u], ids[v], ids[u + v]
            if joined in self.born or not self._arc(a, b):
                continue
            self.took[a << _ID_BITS | b] = step
            self.born[joined], self.left[joined], self.right[joined] = step, a, b
        # beginnings of tokens, with the token's id or -1, and the tokens that end a word; tokens whose
        # merges no word can reach have no arcs
        unreached = {u + v for u, v in pairs} - {t for t, i in ids.items() if i in self.born}
        self.begins: dict[str, int] = {}
        self.ends: dict[str, int] = {}
        for text, token in ids.items():
            if text in unreached:
                continue
            if self.end and text.endswith(self.end):
                self.ends[text.removesuffix(self.end)] = token
                continue
            self.begins[text] = token
            for k in range(1, len(text)):
                self.begins.setdefault(text[:k], -1)
        self.longest = max(map(len, self.ends), default=0)

    def _arc(self, before: int, token: int) -> bool:
        """Whether the state behind the token ``before`` has an arc for the token.

        Going back in time from the last gadget: an arc is there unless a gadget of the token before has taken it.
        Before a token was joined its arc was the one of its left part, and before the token before was joined its
        state was that of its right part. Between base symbols all arcs are there.
        """
        took, born, limit = self.took, self.born, 1 << 60
        while True:
            step = took.get(before << _ID_BITS | token)
            if step is not None and step < limit:
                return False
            since, start = born.get(token, -1), born.get(before, -1)
            if since < 0 and start < 0:
                return True
            if since > start:
                token, limit = self.left[token], min(limit, since + 1)
            else:
                before, limit = self.right[before], min(limit, start)

    def has_arc(self, before: int, token: int) -> bool:
        """The same, looked up in the table first; a word begins with any token."""
        if before == _ROOT:
            return True
        key = before << _ID_BITS | token
        found = self.table.get(key)
        if found is None:
            if len(self.table) > TABLE_SIZE:
                self.table.clear()
            found = self.table[key] = self._arc(before, token)
        return found

    @cached_property
    def batch(self) -> Batch:
        return Batch(self)

    def word(self, text: str) -> list[int]:
        """Token ids of one pre-split word."""
        joined = text.encode().decode("latin-1").translate(self.symbols)
        n = len(joined)
        if not n:
            return []
        has_arc, begins, ends, longest = self.has_arc, self.begins, self.ends, self.longest
        # The automaton accepts one sequence only, so that the longest arc may be tried first; a place that
        # leads nowhere leads nowhere by any way, as one way at most leads there.
        out, open_, dead, at, before = [], [], set(), 0, _ROOT
        stop = n + (not self.end)
        while True:
            arcs = []
            for to in range(at + 1, stop):
                token = begins.get(joined[at:to])
                if token is None:
                    break
                if token >= 0:
                    arcs.append((to, token))
            if n - at <= longest:
                token = ends.get(joined[at:])
                if token is not None:
                    arcs.append((n, token))
            while True:
                while arcs:
                    to, token = arcs.pop()
                    if to not in dead and has_arc(before, token):
                        break
                else:
                    dead.add(at)
                    at, before, arcs = open_.pop()
                    out.pop()
                    continue
                break
            out.append(token)
            if to == n:
                return out
            open_.append((at, before, arcs))
            at, before = to, token

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
        return text.lower() if "\u0130" not in text and "\u03a3" not in text else "".join(map(str.lower, text))

    def words(self, low: str) -> list[str]:
        """Pre-split words of a normal text."""
        if low.isalpha():
            return [low]
        return self.parts.findall(self.space.sub(" ", low))

    def arcs_text(self, tokens: Iterable[int]) -> str:
        """The texts of a token sequence's arcs, joined by a space as a decoder without rules does."""
        return " ".join([t for t in map(self._texts.get, tokens) if t is not None])


class _Lookup:
    """Whole numbers by whole numbers, for arrays at once; -1 for what isn't there."""

    def __init__(self, entries: dict[int, int]) -> None:
        bits = max(4, (2 * len(entries)).bit_length())
        self.shift, self.mask = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, -1, np.int32)
        keys = np.fromiter(entries, np.int64, len(entries))
        values = np.fromiter(entries.values(), np.int32, len(entries))
        at = self._first(keys)
        while len(keys):
            free = np.flatnonzero(self.keys[at] < 0)
            place, one = np.unique(at[free], return_index=True)
            self.keys[place], self.values[place] = keys[free[one]], values[free[one]]
            left = self.keys[at] != keys
            keys, values, at = keys[left], values[left], (at[left] + 1) & self.mask

    def _first(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = self._first(keys)
        met = self.keys[at]
        out = np.where(met == keys, self.values[at], -1)
        left = np.flatnonzero((met != keys) & (met >= 0))
        while len(left):
            at = (at[left] + 1) & self.mask if len(at) == len(keys) else (at + 1) & self.mask
            met = self.keys[at]
            hit = met == keys[left]
            out[left[hit]] = self.values[at[hit]]
            more = ~hit & (met >= 0)
            left, at = left[more], at[more]
        return out


class Batch:
    """Many words walked through the automaton in step.

    One sequence of arcs at most leads to each place of a word. So places are settled from left to right: of the
    tokens that end at a place, the one counts whose start is settled and whose arc the state there has.
    """

    def __init__(self, machine: Automaton) -> None:
        base = {c: b for b, c in enumerate(byte_alphabet())}
        children: dict[int, int] = {}
        ends: dict[int, int] = {}
        for texts, last in ((machine.begins, ()), (machine.ends, (_END,))):
            for text, token in texts.items():
                if token < 0 or any(c not in base for c in text):
                    continue
                node = 0
                for symbol in (*(base[c] for c in text), *last):
                    node = children.setdefault(node << 9 | symbol, len(children) + 1)
                ends[node] = token
        self.child = _Lookup(children)
        self.token = np.full(len(children) + 1, -1, np.int32)
        self.token[np.fromiter(ends, np.int64, len(ends))] = np.fromiter(ends.values(), np.int32, len(ends))
        self.took = _Lookup(machine.took)
        count = max(machine.ids.values()) + 1
        self.born, self.left, self.right = (np.full(count, -1, np.int64) for _ in range(3))
        for row, parts in ((self.born, machine.born), (self.left, machine.left), (self.right, machine.right)):
            row[np.fromiter(parts, np.int64, len(parts))] = np.fromiter(parts.values(), np.int64, len(parts))
        self.marked = bool(machine.end)

    def has_arcs(self, before: np.ndarray, token: np.ndarray) -> np.ndarray:
        """``Automaton.has_arc`` for arrays."""
        out = before == _ROOT
        open_ = np.flatnonzero(~out)
        before, token = before[open_], token[open_]
        limit = np.full(len(open_), 1 << 60)
        while len(open_):
            step = self.took(before << _ID_BITS | token)
            since, start = self.born[token], self.born[before]
            alive = (step < 0) | (step >= limit)
            settled = alive & (since < 0) & (start < 0)
            out[open_[settled]] = True
            go = alive & ~settled
            open_, before, token, limit, since, start = (x[go] for x in (open_, before, token, limit, since, start))
            later = since > start
            limit = np.minimum(limit, np.where(later, since + 1, start))
            token, before = np.where(later, self.left[token], token), np.where(later, before, self.right[before])
        return out

    def __call__(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(token ids of all words, bounds of each word's); words are not empty."""
        raw = [w.encode() for w in words]
        sizes = np.fromiter(map(len, raw), np.int64, len(raw))
        spans = sizes + self.marked
        first = np.cumsum(spans) - spans
        symbols = np.full(spans.sum(), _END, np.int64)
        inside = np.ones(len(symbols), bool)
        if self.marked:
            inside[first + sizes] = False
        symbols[inside] = np.frombuffer(b"".join(raw), np.uint8)
        word = np.repeat(np.arange(len(raw)), spans)
        # tokens at every place
        at, stop = np.arange(len(symbols)), (first + spans)[word]
        node, length, starts, lengths, tokens = np.zeros(len(at), np.int64), 0, [], [], []
        while len(at):
            node = self.child(node << 9 | symbols[at + length]).astype(np.int64)
            alive = node >= 0
            at, node, stop = at[alive], node[alive], stop[alive]
            length += 1
            found = np.flatnonzero(self.token[node] >= 0)
            starts.append(at[found])
            tokens.append(self.token[node[found]])
            lengths.append(np.full(len(found), length))
            more = at + length < stop
            at, node, stop = at[more], node[more], stop[more]
        start, token = np.concatenate(starts), np.concatenate(tokens).astype(np.int64)
        start = start + word[start]  # a word has a place more than symbols
        end = start + np.concatenate(lengths)
        zero = first + np.arange(len(raw))
        local = end - np.repeat(zero, spans + 1)[end]
        order = np.argsort(local, kind="stable")
        start, end, token, local = start[order], end[order], token[order], local[order]
        last, back = np.full(len(symbols) + len(raw), _NOWHERE), np.zeros(len(symbols) + len(raw), np.int64)
        last[zero] = _ROOT
        cuts = np.searchsorted(local, np.arange(1, int(spans.max(initial=0)) + 2))
        for a, z in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
            known = a + np.flatnonzero(last[start[a:z]] != _NOWHERE)
            good = known[self.has_arcs(last[start[known]], token[known])]
            last[end[good]], back[end[good]] = token[good], start[good]
        here, of, found, owner = zero + spans, np.arange(len(raw)), [], []
        while len(here):
            found.append(last[here])
            owner.append(of)
            here = back[here]
            more = last[here] != _ROOT
            here, of = here[more], of[more]
        owner, found = np.concatenate(owner[::-1]), np.concatenate(found[::-1])
        order = np.argsort(owner, kind="stable")
        return found[order], np.searchsorted(owner[order], np.arange(len(raw) + 1))


_loaded: dict[str, Automaton] = {}


def automaton(raw: str) -> Automaton:
    key = hashlib.sha256(raw.encode()).hexdigest()
    if key not in _loaded:
        _loaded[key] = Automaton(json.loads(raw))
    return _loaded[key]


class Encoder:
    """Encodes and decodes texts in slices: every different chunk between blanks once, the rest is taking and joining.

    Neither normalising nor splitting looks across a blank or a line end. Chunks are kept with the texts of their
    ids and of their arcs; when there are too many, those that were met least go.
    """

    def __init__(self, machine: Automaton, most: int = CACHE_CHUNKS) -> None:
        self.machine, self.most = machine, most
        self._keep([], pa.array([], pa.string()), pa.array([], pa.string()), np.zeros(0, np.int64))

    def _keep(self, chunks: list[str], ids: pa.Array, texts: pa.Array, sizes: np.ndarray) -> None:
        self.place = dict(zip(chunks, range(len(chunks)), strict=True))
        self.ids, self.texts, self.sizes = ids, texts, sizes
        self.met = np.zeros(len(chunks), np.int64)

    def _forget(self) -> None:
        """Keep the half that was met most; very long chunks never stay."""
        chunks = list(self.place)
        order = np.argsort(-self.met, kind="stable")[:self.most // 2]
        order = np.sort([i for i in order.tolist() if len(chunks[i]) <= CACHE_LENGTH])
        at = pa.array(order, pa.int64())
        self._keep([chunks[i] for i in order.tolist()], self.ids.take(at), self.texts.take(at), self.sizes[order])

    def _learn(self, chunks: list[str]) -> None:
        machine = self.machine
        parts = [[c] if c[:1] == " " else machine.words(c) for c in chunks]
        words = dict.fromkeys(chain.from_iterable(parts))
        words.pop("", None)
        long = {w: [machine.special[w[1:]]] if w[0] == " " else machine.word(w)
                for w in words if len(w) > CACHE_LENGTH or w[0] == " "}
        short = [w for w in words if w not in long]
        number = dict(zip(chain(short, long), range(len(words)), strict=True)) | {"": len(words)}
        tokens, bounds = machine.batch(short) if short else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        tokens = np.concatenate([tokens, *(np.array(t, np.int64) for t in long.values())])
        bounds = np.concatenate([bounds, bounds[-1] + np.cumsum([*map(len, long.values())], dtype=np.int64)])
        bounds = np.append(bounds, bounds[-1])  # the empty word
        of = np.fromiter(map(number.__getitem__, chain.from_iterable(parts)), np.int64)
        size = (bounds[1:] - bounds[:-1])[of]
        ends = np.cumsum(size)
        flat = tokens[np.repeat(bounds[of] - ends + size, size) + np.arange(size.sum())]
        offsets = np.append(0, ends)[np.cumsum([0, *map(len, parts)])]
        self.place |= zip(chunks, range(len(self.place), len(self.place) + len(chunks)), strict=True)
        at = pa.array(flat)
        join = lambda x: pc.binary_join(pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), x.take(at)), " ")
        self.ids = pa.concat_arrays([self.ids, join(machine.numbers)])
        self.texts = pa.concat_arrays([self.texts, join(machine.labels)])
        self.sizes = np.append(self.sizes, np.diff(offsets))
        self.met = np.append(self.met, np.zeros(len(chunks), np.int64))

    def _chunks(self, text: str) -> list[str]:
        """What stands between blanks and line ends of the normal text; a special token behind a blank."""
        cut = self.machine.cut
        if cut and "<|" in text:
            return [c for k, part in enumerate(cut.split(text)) for c in ([" " + part] if k % 2 else self._plain(part))]
        return self._plain(text)

    def _plain(self, text: str) -> list[str]:
        # a mark between a letter and a blank is a word of its own, and the letters before it are met more often alone
        return _MARK.sub(r" \1 ", self.machine.normal(text)).replace("\n", " ").split(" ")

    def encode(self, texts: list[str]) -> tuple[np.ndarray, pa.Array, pa.Array]:
        """(numbers of tokens, ids joined by a space, decoded texts)."""
        if len(self.place) > self.most:
            self._forget()
        chunks, ends = [], [0]
        for text in texts:
            chunks += self._chunks(text)
            ends.append(len(chunks))
        new = [c for c in dict.fromkeys(chunks) if c not in self.place]
        if new:
            self._learn(new)
        at = np.fromiter(map(self.place.__getitem__, chunks), np.int64, len(chunks))
        self.met += np.bincount(at, minlength=len(self.met))
        sizes = self.sizes[at]
        some = sizes > 0  # chunks without tokens stand in no list
        before = np.concatenate([[0], np.cumsum(some)])[ends]
        total = np.concatenate([[0], np.cumsum(sizes)])[ends]
        taken, offsets = pa.array(at[some]), pa.array(before, pa.int32())
        join = lambda x: pc.binary_join(pa.ListArray.from_arrays(offsets, x.take(taken)), " ")
        return np.diff(total), join(self.ids), join(self.texts)


def _slices(texts: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """(first row, texts) of at most SLICE_ROWS texts and SLICE_LETTERS characters; a longer text is alone."""
    at, held, size = 0, [], 0
    for i, text in enumerate(texts):
        text = text.as_py() or ""
        if held and (len(held) == SLICE_ROWS or size + len(text) > SLICE_LETTERS):
            yield at, held
            at, held, size = i, [], 0
        held.append(text)
        size += len(text)
    if held:
        yield at, held


def _digests(texts: pa.Array) -> pa.Array:
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset:texts.offset + len(texts) + 1].tolist()
    data = memoryview(data or b"")
    return pa.array([hashlib.sha256(data[a:b]).hexdigest() for a, b in zip(ends, ends[1:])], pa.string())


#: What a round trip can return of a text.
_RESULTS = {
    "n_tokens": ("long", lambda n, ids, texts: pa.array(n, pa.int64())),
    "token_ids": ("string", lambda n, ids, texts: ids),
    "decoded": ("string", lambda n, ids, texts: texts),
    "ids_sha256": ("string", lambda n, ids, texts: _digests(ids)),
    "decoded_sha256": ("string", lambda n, ids, texts: _digests(texts)),
}

_encoders: dict[str, Encoder] = {}


def encoder(raw: str) -> Encoder:
    """This worker's encoder for a tokenizer file; what it has met stays for later tasks."""
    machine = automaton(raw)
    return _encoders.setdefault(hashlib.sha256(raw.encode()).hexdigest(), Encoder(machine))


def bpe_round_trip(docs: DataFrame, tokenizer_file: str,
                   results: tuple[str, ...] = ("n_tokens", "token_ids", "decoded")) -> DataFrame:
    """Encode each whole text with the merges of a tokenizer file and decode the ids again.

    Returns the columns of ``docs`` but text, then ``results``: n_tokens, token_ids (decimal, joined by a
    space), decoded, and the digests ids_sha256 and decoded_sha256 of the last two. A null or empty text has
    no tokens and decodes to an empty text. Rows are independent: ties and repeated rows need no rule, and an
    empty table gives an empty result. Columns of ``docs`` that share a name with a result give way to it.
    The file is read on the driver (it is of fixed size) and sent along.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = docs.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in docs.columns if c != "text" and c not in results]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(shared.value).encode
        for batch in batches:
            for at, texts in _slices(batch.column("text")):
                found = encode(texts)
                part = batch.slice(at, len(texts))
                yield pa.RecordBatch.from_arrays(
                    [*(part.column(c) for c in keep), *(_RESULTS[c][1](*found) for c in results)],
                    names=[*keep, *results])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema if f.name in keep]
    schema = ", ".join([*kinds, *(f"{c} {_RESULTS[c][0]}" for c in results)])
    return docs.select(*keep, "text").mapInArrow(run, schema)


def decode_ids(tokens: DataFrame, tokenizer_file: str, ids: str = "token_ids", out: str = "decoded") -> DataFrame:
    """Add the texts of token ids: the labels of their arcs, joined by a space.

    ``ids`` is a column of decimal ids joined by spaces, or of arrays of numbers. Unknown ids have no label and
    are passed over, as are null ones in arrays; a null or empty row decodes to an empty text. A column named like ``out``
    gives way. Rows are independent, and an empty table gives an empty result.
    """
    with open(tokenizer_file, encoding="utf-8") as f:
        shared = tokens.sparkSession.sparkContext.broadcast(f.read())
    keep = [c for c in tokens.columns if c != out]
    joined = tokens.schema[ids].dataType.typeName() == "string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = automaton(shared.value)
        for batch in batches:
            rows = batch.column("__ids").to_pylist()
            made = [machine.arcs_text((map(int, r.split()) if joined else r) if r else ()) for r in rows]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(made, pa.string())],
                                             names=[*keep, out])

    kinds = [f"`{f.name}` {f.dataType.simpleString()}" for f in tokens.schema if f.name in keep]
    given = tokens.select(*(tokens[f"`{c}`"] for c in keep), tokens[f"`{ids}`"].alias("__ids"))
    return given.mapInArrow(run, ", ".join([*kinds, f"`{out}` string"]))

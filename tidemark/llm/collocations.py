"""Phrases whose words stand together more often than by chance, from weighted acyclic automata.

Words are lowered (A-Z) and split by spaces and tabs within pieces that end at `.,;:!?` and line ends. Every
phrase of up to `longest` words is a path through an automaton: language, word, word, ... Each arc has a weight,
the number of times that the phrase that ends with it was seen.

1. Each task counts its words by hash, then pairs of words that are frequent; the sums over all tasks make two
   bit maps of fixed size, of frequent words and pairs. They only spare work: a phrase can't be frequent unless
   all its pairs are, and a wrong bit costs a count that is thrown away later.
2. Each shard, `BLOCK` words of a task, sorts its phrases and builds an automaton from them. In sorted order the phrases
   with one beginning follow each other, so a state is complete as soon as the beginning changes; the
   complete states of a depth are registered together, deepest first, and those that go on alike become one.
3. The shards' automata are cut at bounds between phrases and sent to the ranges. There their union is made
   step by step; weights of equal paths are added up, and what stays below the least count goes.
4. For the score, a phrase is cut in two. Both parts are looked up where their own range is: the parts that
   arrive there form an automaton, and its composition with the range's automaton yields their counts. A range
   that gets many parts (a very common word) is copied to several tasks.

The bounds come from a sample of pairs; they decide where a phrase is counted, never whether. Within a shard
words are told apart by 64-bit hashes, between shards by their text.
"""

from __future__ import annotations

import bisect
import hashlib
import struct
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.llm.common import U64, mix, narrow, pieces, signed, words
from tidemark.session import stage

# Bytes that end a piece, and those that end a word.
PIECE_END = np.zeros(256, bool)
PIECE_END[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
STOPS = PIECE_END.copy()
STOPS[[0x20, 0x09]] = True

MAP_BITS = 26
BLOCK = 1_500_000  # words of a shard
MARKERS = 64  # pairs a shard proposes as bounds
MARKERS_MOST = 20_000  # pairs the driver chooses bounds from
NO_LANG = "und"

_PAIR = U64(0xD6E8FEB86659FD93)
_ARC = [U64(0xA0761D6478BD642F), U64(0xE7037ED1A0B428DB), U64(0x8EBC6AF09C88C6E3)]


def _spans(at: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The numbers at[i], ..., at[i] + counts[i] - 1, for all i in a row."""
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) + np.repeat(at - (ends - counts), counts)


# -- automata ----------------------------------------------------------------------------------------


@dataclass
class Trie:
    """Phrases by depth: node j of depth d has a parent at depth d - 1, a symbol and a weight.

    Symbols are sorted, and so are the nodes of a depth, by parent and symbol: that is the order of the phrases.
    """

    symbols: list[bytes]
    parent: list[np.ndarray]
    label: list[np.ndarray]
    weight: list[np.ndarray]

    def __len__(self) -> int:
        return sum(map(len, self.label))


class Automaton:
    """A minimised trie: states with the same arcs are one. State 0 has none."""

    def __init__(self, symbols, depth, root, sizes, label, weight, target):
        self.symbols, self.depth, self.root = symbols, depth, root
        self.sizes, self.label, self.weight, self.target = sizes, label, weight, target
        self.at = np.cumsum(sizes) - sizes

    @classmethod
    def build(cls, trie: Trie) -> Automaton:
        sizes, arcs = [np.zeros(1, np.int64)], [[], [], []]
        n_states = 1
        below = np.zeros(len(trie.label[-1]), np.int64)
        for d in range(len(trie.label) - 1, -1, -1):
            parents = len(trie.label[d - 1]) if d else 1
            own = (trie.label[d].astype(np.int64), trie.weight[d], below)
            size = np.bincount(trie.parent[d], minlength=parents)
            has = np.flatnonzero(size)
            at, size = (np.cumsum(size) - size)[has], size[has]
            below = np.zeros(parents, np.int64)
            if not len(has):
                continue
            code = mix(sum(x.astype(U64) * m for x, m in zip(own, _ARC)))
            sign = mix(np.add.reduceat(code, at) + size.astype(U64))
            _, first, state = np.unique(sign, return_index=True, return_inverse=True)
            # The arcs themselves decide; a sign that two kinds of states share merges nothing.
            twin = first[state]
            mine = _spans(at, size)
            same = (size == size[twin]).all()
            if same:
                theirs = _spans(at[twin], size)
                same = all((x[mine] == x[theirs]).all() for x in own)
            if not same:
                first = state = np.arange(len(has))
            kept = _spans(at[first], size[first])
            for got, x in zip(arcs, own):
                got.append(x[kept])
            sizes.append(size[first])
            below[has] = n_states + state
            n_states += len(first)
        join = lambda xs: np.concatenate([np.zeros(0, np.int64), *xs])
        return cls(trie.symbols, len(trie.label), int(below[0]), np.concatenate(sizes), *map(join, arcs))

    def to_bytes(self) -> bytes:
        lengths = np.array([len(s) for s in self.symbols], "<u4")
        head = struct.pack("<5Q", self.depth, self.root, len(self.symbols), len(self.sizes), len(self.label))
        arrays = [lengths, self.sizes.astype("<u4"), self.label.astype("<u4"), self.target.astype("<u4"), self.weight.astype("<i8")]
        body = b"".join([head, *[x.tobytes() for x in arrays], *self.symbols])
        return zstandard.ZstdCompressor(level=1).compress(body)

    @classmethod
    def from_bytes(cls, blob: bytes) -> Automaton:
        body = zstandard.ZstdDecompressor().decompress(blob)
        depth, root, n_symbols, n_states, n_arcs = struct.unpack_from("<5Q", body)
        at, out = 40, []
        for n, kind in ((n_symbols, "<u4"), (n_states, "<u4"), (n_arcs, "<u4"), (n_arcs, "<u4"), (n_arcs, "<i8")):
            out.append(np.frombuffer(body, kind, n, at).astype(np.int64))
            at += n * np.dtype(kind).itemsize
        lengths, sizes, label, target, weight = out
        stop = (at + np.cumsum(lengths)).tolist()
        symbols = [body[b - n : b] for b, n in zip(stop, lengths.tolist())]
        return cls(symbols, depth, root, sizes, label, weight, target)

    def expand(self) -> Trie:
        """All paths, in order."""
        parent, label, weight = [], [], []
        states = np.array([self.root])
        for _ in range(self.depth):
            counts = self.sizes[states]
            arc = _spans(self.at[states], counts)
            parent.append(np.repeat(np.arange(len(states)), counts))
            label.append(self.label[arc])
            weight.append(self.weight[arc])
            states = self.target[arc]
        return Trie(self.symbols, parent, label, weight)

    def compose(self, other: Trie) -> list[np.ndarray]:
        """The weight here of each node of `other`, by depth; 0 where this automaton has no such path."""
        place = {s: k for k, s in enumerate(self.symbols)}
        known = np.array([place.get(s, -1) for s in other.symbols], np.int64)
        span = len(self.symbols) + 1
        keys = np.repeat(np.arange(len(self.sizes)), self.sizes) * span + self.label
        states, out = np.array([self.root]), []
        for parent, label in zip(other.parent, other.label):
            state, symbol = states[parent], known[label]
            key = state * span + symbol
            at = np.minimum(np.searchsorted(keys, key), max(0, len(keys) - 1))
            hit = (symbol >= 0) & (keys[at] == key) if len(keys) else np.zeros(len(key), bool)
            out.append(np.where(hit, self.weight[at] if len(keys) else 0, 0))
            # State 0 has no arcs, so nothing is found below a path that is missing.
            states = np.where(hit, self.target[at] if len(keys) else 0, 0)
        return out


def trie_of(paths: list[tuple[bytes, ...]], depth: int) -> tuple[Trie, np.ndarray]:
    """The trie of some paths, and the node at which each of them ends (at the depth of its length)."""
    symbols = sorted(set().union(*paths)) if paths else []
    place = {s: k for k, s in enumerate(symbols)}
    size = np.array([len(p) for p in paths], np.int64)
    node = np.zeros(len(paths), np.int64)
    parents, labels = [], []
    for d in range(depth):
        on = np.flatnonzero(size > d)
        label = np.array([place[paths[k][d]] for k in on.tolist()], np.int64)
        unique, node[on] = np.unique(node[on] * max(1, len(symbols)) + label, return_inverse=True)
        parent, label = np.divmod(unique, max(1, len(symbols)))
        parents.append(parent)
        labels.append(label)
    return Trie(symbols, parents, labels, [np.zeros(len(x), np.int64) for x in labels]), node


def union(tries: list[Trie]) -> Trie:
    """All paths of all tries; weights of equal paths are added."""
    symbols = sorted(set().union(*[t.symbols for t in tries]))
    place = {s: k for k, s in enumerate(symbols)}
    maps = [np.array([place[s] for s in t.symbols], np.int64) for t in tries]
    above = [np.zeros(1, np.int64) for _ in tries]
    out = Trie(symbols, [], [], [])
    for d in range(max(len(t.label) for t in tries)):
        key = np.concatenate([u[t.parent[d]] * len(symbols) + m[t.label[d]] for t, m, u in zip(tries, maps, above)])
        unique, node = np.unique(key, return_inverse=True)
        weight = np.zeros(len(unique), np.int64)
        np.add.at(weight, node, np.concatenate([t.weight[d] for t in tries]))
        parent, label = np.divmod(unique, max(1, len(symbols)))
        out.parent.append(parent)
        out.label.append(label)
        out.weight.append(weight)
        above = np.split(node, np.cumsum([len(t.label[d]) for t in tries])[:-1])
    return out


def relabelled(trie: Trie) -> Trie:
    """The same with only the symbols that occur."""
    used = np.unique(np.concatenate(trie.label))
    return Trie([trie.symbols[k] for k in used.tolist()], trie.parent, [np.searchsorted(used, x) for x in trie.label], trie.weight)


def pruned(trie: Trie, least: int) -> Trie:
    """Only paths that lead to a weight of at least `least`; smaller weights become 0."""
    depth = len(trie.label)
    keep: list[np.ndarray] = [None] * depth
    for d in range(depth - 1, -1, -1):
        keep[d] = trie.weight[d] >= least
        if d + 1 < depth:
            keep[d][trie.parent[d + 1][keep[d + 1]]] = True
    parent, label, weight = [], [], []
    for d in range(depth):
        new = np.cumsum(keep[d - 1]) - 1 if d else np.zeros(1, np.int64)
        parent.append(new[trie.parent[d][keep[d]]])
        label.append(trie.label[d][keep[d]])
        kept = trie.weight[d][keep[d]]
        weight.append(np.where(kept >= least, kept, 0))
    return relabelled(Trie(trie.symbols, parent, label, weight))


def cut(trie: Trie, bounds: list[tuple[bytes, bytes, bytes]]) -> Iterator[tuple[int, Trie]]:
    """The trie by ranges: range r has the phrases from bound r - 1 up to bound r (exclusive).

    Bounds are (language, word, word). A single word stands before all longer phrases that it begins. In other
    ranges it is only on the way, with the weight 0.
    """
    names, depth = trie.symbols, len(trie.label)

    def one(j: int) -> tuple[bytes, bytes, bytes]:
        return names[trie.label[0][trie.parent[1][j]]], names[trie.label[1][j]], b""

    def two(j: int) -> tuple[bytes, bytes, bytes]:
        return *one(trie.parent[2][j])[:2], names[trie.label[2][j]]

    ones, twos = range(len(trie.label[1])), range(len(trie.label[2]))
    at_one = [0, *[bisect.bisect_left(ones, b, key=one) for b in bounds], len(ones)]
    at_two = [0, *[bisect.bisect_left(twos, b, key=two) for b in bounds], len(twos)]
    for r in range(len(bounds) + 1):
        own, (lo, hi) = (at_one[r], at_one[r + 1]), (at_two[r], at_two[r + 1])
        if own[0] == own[1] and lo == hi:
            continue
        # Words that have their own weight here, or are on the way to a pair.
        first = min(own[0] if own[0] < own[1] else len(ones), int(trie.parent[2][lo]) if lo < hi else len(ones))
        last = max(own[1] if own[0] < own[1] else 0, int(trie.parent[2][hi - 1]) + 1 if lo < hi else 0)
        spans = [None, (first, last), (lo, hi)]
        for d in range(3, depth):
            spans.append(tuple(np.searchsorted(trie.parent[d], spans[-1]).tolist()))
        langs = (int(trie.parent[1][first]), int(trie.parent[1][last - 1]) + 1)
        spans[0] = langs
        parent, label, weight = [], [], []
        for d, (a, b) in enumerate(spans):
            parent.append(trie.parent[d][a:b] - (spans[d - 1][0] if d else 0))
            label.append(trie.label[d][a:b])
            weight.append(trie.weight[d][a:b])
        here = np.arange(first, last)
        weight[1] = np.where((here >= own[0]) & (here < own[1]), weight[1], 0)
        yield r, relabelled(Trie(names, parent, label, weight))


def paths(trie: Trie) -> Iterator[tuple[int, list[list[bytes]], list[int]]]:
    """(depth, paths, weights) of the nodes of each depth."""
    above: list[list[bytes]] = [[]]
    for d in range(len(trie.label)):
        symbols = trie.symbols
        above = [[*above[p], symbols[s]] for p, s in zip(trie.parent[d].tolist(), trie.label[d].tolist())]
        yield d + 1, above, trie.weight[d].tolist()


# -- words of texts ----------------------------------------------------------------------------------


@dataclass
class Run:
    """Words of some documents: a hash of language and word, where they stand, and their language.

    `joined[i]` says that word i + 1 follows word i in the same piece.
    """

    keys: np.ndarray
    body: np.ndarray
    start: np.ndarray
    end: np.ndarray
    joined: np.ndarray
    langs: list[bytes]
    lang: np.ndarray

    def text(self, i: int) -> bytes:
        return self.body[self.start[i] : self.end[i]].tobytes().lower()


def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[Run]:
    """The words of batches of (text, language)."""
    for batch in batches:
        for lo, hi, body, begins in pieces(batch.column(0)):
            h, start, end, first = words(body, begins, STOPS)
            if not len(h):
                continue
            row = np.repeat(np.arange(hi - lo), np.diff(first))
            names = [x.encode() for x in batch.column(1).slice(lo, hi - lo).to_pylist()]
            langs = sorted(set(names))
            place = {x: k for k, x in enumerate(langs)}
            lang = np.array([place[x] for x in names], np.int64)[row]
            salt = np.array([int.from_bytes(hashlib.blake2b(x, digest_size=8).digest(), "little") for x in langs], U64)
            ended = np.zeros(len(body) + 1, np.int32)
            np.cumsum(PIECE_END[body], out=ended[1:])
            joined = np.zeros(len(h), bool)
            joined[:-1] = (row[1:] == row[:-1]) & (ended[start[1:]] == ended[end[:-1]])
            yield Run(mix(h ^ salt[lang]), body, start, end, joined, langs, lang)


def pair_keys(keys: np.ndarray) -> np.ndarray:
    """A hash of every word and the next one; the last one is paired with nothing."""
    out = keys * _PAIR
    out[:-1] += keys[1:]
    return mix(out)


def _lookup(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    bit = keys & U64((1 << MAP_BITS) - 1)
    return ((table[bit >> U64(6)] >> (bit & U64(63))) & U64(1)).astype(bool)


def _added(keys: list[np.ndarray], counts: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    key, n = np.concatenate(keys), np.concatenate(counts)
    order = np.argsort(key)
    key, n = key[order], n[order]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return key[first], np.add.reduceat(n, first) if len(first) else n


_COUNTED = "part int, kind int, lang string, data binary, n long"
_KINDS = [pa.int32(), pa.int32(), pa.string(), pa.binary(), pa.int64()]
_KEYS, _TOTAL, _MARKER = 0, 1, 2


def _table(rows: list[tuple]) -> pa.RecordBatch:
    names = [c.split()[0] for c in _COUNTED.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(_KINDS)], names=names)


def _counter(parts: int, held):
    """A task's part of the counts: of words if `held` is None, of pairs of words in that bit map otherwise.

    Keys go out sorted, summed and cut by their highest bits, so that each part is summed in one task. With the
    words go the number of words by language, with the pairs some of them as markers.
    """

    def flushed(keys: list[np.ndarray]) -> list[tuple]:
        key, n = np.unique(np.concatenate(keys), return_counts=True)
        part = ((key >> U64(32)) * U64(parts)) >> U64(32)
        at = np.searchsorted(part, np.arange(parts + 1, dtype=U64))
        return [
            (p, _KEYS, None, key[a:b].tobytes() + n[a:b].astype("<u4").tobytes(), None)
            for p, (a, b) in enumerate(zip(at.tolist(), at[1:].tolist()))
            if a < b
        ]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = None if held is None else np.frombuffer(held.value, U64)
        keys, pending, totals, markers = [], 0, {}, []
        for r in runs(batches):
            if table is None:
                keys.append(r.keys)
                for k, n in enumerate(np.bincount(r.lang, minlength=len(r.langs)).tolist()):
                    totals[r.langs[k]] = totals.get(r.langs[k], 0) + n
            else:
                known = _lookup(table, r.keys)
                known[:-1] &= known[1:] & r.joined[:-1]
                known[-1] = False
                at = np.flatnonzero(known)
                keys.append(pair_keys(r.keys)[at])
                for i in at[:: max(1, 8 * len(at) // MARKERS)].tolist():
                    markers.append((r.langs[r.lang[i]].decode(), r.text(i) + b" " + r.text(i + 1)))
            pending += len(keys[-1])
            if pending >= BLOCK:
                yield _table(flushed(keys))
                keys, pending = [], 0
                markers = markers[:: -(-len(markers) // MARKERS)] if markers else []
        rest = flushed(keys) if pending else []
        rest += [(hash_part(k, parts), _TOTAL, k.decode(), None, n) for k, n in totals.items()]
        markers = markers[:: -(-len(markers) // MARKERS)] if markers else []
        rest += [(hash_part(m, parts), _MARKER, lang, m, None) for lang, m in markers]
        yield _table(rest)

    return run


def hash_part(value: bytes, parts: int) -> int:
    return int.from_bytes(hashlib.blake2b(value, digest_size=4).digest(), "little") * parts >> 32


def _summed(least: int):
    """A part's sums: keys counted at least `least` times (their low bits, as rows of `n`), totals and markers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, n = np.zeros(0, U64), np.zeros(0, np.int64)
        keys, counts, pending = [], [], 0
        for batch in batches:
            rest = []
            for part, kind, lang, data, number in zip(*[c.to_pylist() for c in batch.columns]):
                if kind != _KEYS:
                    rest.append((part, kind, lang, data, number))
                    continue
                size = len(data) // 12
                keys.append(np.frombuffer(data, U64, size))
                counts.append(np.frombuffer(data, "<u4", size, 8 * size).astype(np.int64))
                pending += size
                if pending > max(1_000_000, len(key)):
                    key, n = _added([key, *keys], [n, *counts])
                    keys, counts, pending = [], [], 0
            if rest:
                yield _table(rest)
        key, n = _added([key, *keys], [n, *counts])
        often = signed(key[n >= least] & U64((1 << MAP_BITS) - 1))
        for lo in range(0, len(often), 100_000):
            some = pa.array(often[lo : lo + 100_000])
            zero = pa.array(np.zeros(len(some), np.int32))
            none = pa.nulls(len(some))
            columns = [zero, zero, none.cast(pa.string()), none.cast(pa.binary()), some]
            yield pa.RecordBatch.from_arrays(columns, names=[c.split()[0] for c in _COUNTED.split(", ")])

    return run


def _bit_map(counted: DataFrame) -> bytes:
    """2^MAP_BITS bits, gathered as at most 2^MAP_BITS / 64 words."""
    cells = (
        counted.where(F.col("kind") == _KEYS)
        .select(F.shiftright("n", 6).cast("int").alias("cell"), F.expr("shiftleft(1L, cast(n & 63 as int))").alias("bit"))
        .groupBy("cell")
        .agg(F.bit_or("bit").alias("bits"))
        .toArrow()
    )
    table = np.zeros(1 << (MAP_BITS - 6), np.int64)
    table[cells["cell"].to_numpy()] = cells["bits"].to_numpy()
    return table.tobytes()


def _shards(longest: int, words_held, pairs_held, bounds_held):
    """A task's automata of phrases, one per shard and range."""

    def shard(block: list[Run], known: list[np.ndarray], texts: dict[int, bytes]) -> Trie:
        langs = sorted(set().union(*[r.langs for r in block]))
        keys = np.concatenate([r.keys for r in block])
        good = np.concatenate(known)
        pair = np.concatenate([r.joined for r in block])
        lang = np.concatenate([np.searchsorted(np.array(langs, object), np.array(r.langs, object))[r.lang] for r in block])
        unique, word = np.unique(keys[good], return_inverse=True)
        spelled = [texts[k] for k in unique.tolist()]
        symbols = sorted({*langs, *spelled})
        place = {s: k for k, s in enumerate(symbols)}
        label = np.full(len(keys), -1, np.int64)
        label[good] = np.array([place[s] for s in spelled], np.int64)[word]
        label_of_lang = np.array([place[x] for x in langs], np.int64)[lang]
        at = np.flatnonzero(good)
        trie = Trie(symbols, [], [], [])
        node = np.zeros(len(at), np.int64)
        for d in range(longest + 1):
            if d > 1:
                # All pairs on the way must be frequent.
                on = pair[at + d - 2]
                at, node = at[on], node[on]
            step = label_of_lang[at] if d == 0 else label[at + d - 1]
            found, node, n = np.unique(node * len(symbols) + step, return_inverse=True, return_counts=True)
            parent, symbol = np.divmod(found, max(1, len(symbols)))
            trie.parent.append(parent)
            trie.label.append(symbol)
            trie.weight.append(n if d else np.zeros(len(n), np.int64))
        return trie

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        frequent, joined = np.frombuffer(words_held.value, U64), np.frombuffer(pairs_held.value, U64)
        block, known, texts, pending = [], [], {}, 0

        def out() -> pa.RecordBatch:
            made = [(r, Automaton.build(t).to_bytes()) for r, t in cut(shard(block, known, texts), bounds_held.value)]
            return pa.RecordBatch.from_arrays(
                [pa.array([m[0] for m in made], pa.int32()), pa.array([m[1] for m in made], pa.binary())],
                names=["part", "blob"],
            )

        for r in runs(batches):
            good = _lookup(frequent, r.keys)
            r.joined[:-1] &= good[1:] & good[:-1]
            r.joined &= _lookup(joined, pair_keys(r.keys))
            unique, first = np.unique(np.where(good, r.keys, r.keys[0]), return_index=True)
            for k, i in zip(unique.tolist(), first.tolist()):
                if k not in texts:
                    texts[k] = r.text(i)
            # The text is not needed any more.
            r.body = r.start = r.end = None
            block.append(r)
            known.append(good)
            pending += len(good)
            if pending >= BLOCK:
                yield out()
                block, known, texts, pending = [], [], {}, 0
        if pending:
            yield out()

    return run


def _united(least: int):
    """A range's automaton: the union of the automata that arrive, without rare paths."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, whole, waiting, size = None, None, [], 0
        for batch in batches:
            for p, blob in zip(batch.column(0).to_pylist(), batch.column(1)):
                part = p
                waiting.append(Automaton.from_bytes(blob.as_py()).expand())
                size += len(waiting[-1])
                if size > max(500_000, len(whole) if whole else 0):
                    whole, waiting, size = union([whole, *waiting] if whole else waiting), [], 0
        if waiting:
            whole = union([whole, *waiting] if whole else waiting)
        if whole is not None:
            blob = Automaton.build(pruned(whole, least)).to_bytes()
            yield pa.RecordBatch.from_arrays(
                [pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=["part", "blob"]
            )

    return run


# -- counts and scores -------------------------------------------------------------------------------


@dataclass
class Counted:
    """Range automata (part, blob), the bounds between them, and the number of words by language."""

    automata: DataFrame
    bounds: list[tuple[bytes, bytes, bytes]]
    totals: DataFrame
    longest: int


def _bounds(counted: DataFrame, parts: int) -> list[tuple[bytes, bytes, bytes]]:
    """Bounds of `parts` ranges, from at most `MARKERS_MOST` markers."""
    some = counted.where(F.col("kind") == _MARKER).select("lang", "data").distinct()
    rows = some.orderBy(F.xxhash64("lang", "data"), "lang", "data").limit(MARKERS_MOST).collect()
    keys = sorted((r["lang"].encode(), *bytes(r["data"]).split(b" ")) for r in rows)
    step = max(1, len(keys) / parts)
    return sorted({keys[int(k * step)] for k in range(1, parts) if int(k * step) < len(keys)})


def count(
    docs: DataFrame, least: int = 30, longest: int = 4, text_col: str = "text", lang_col: str = "lang"
) -> Counted:
    """Automata of all phrases of one to `longest` words (at least two) that occur `least` times in a language.

    NULL texts are empty; a missing language is `und`. Repeated rows count as often as they stand there.
    """
    if longest < 2 or least < 1:
        raise ValueError("phrases have at least two words and a count of at least one")
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    rows = narrow(docs, text_col, lang_col).toDF("text", "lang")
    rows = rows.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(NO_LANG)).alias("lang"))

    def counted(held, label: str) -> DataFrame:
        own = rows.mapInArrow(_counter(parts, held), _COUNTED)
        return stage(own.repartitionById(parts, F.col("part")).mapInArrow(_summed(least), _COUNTED), label)

    single = counted(None, "words")
    words_held = spark.sparkContext.broadcast(_bit_map(single))
    pairs = counted(words_held, "word-pairs")
    pairs_held = spark.sparkContext.broadcast(_bit_map(pairs))
    bounds = _bounds(pairs, parts)
    bounds_held = spark.sparkContext.broadcast(bounds)
    shards = rows.mapInArrow(_shards(longest, words_held, pairs_held, bounds_held), "part int, blob binary")
    ranges = shards.repartitionById(len(bounds) + 1, F.col("part")).mapInArrow(_united(least), "part int, blob binary")
    totals = single.where(F.col("kind") == _TOTAL).groupBy("lang").agg(F.sum("n").alias("n"))
    return Counted(stage(ranges, "phrases"), bounds, totals, longest)


def phrases(found: Counted) -> DataFrame:
    """(lang, phrase, n): the phrases of the automata, with their counts."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for blob in batch.column(1):
                for d, names, weights in paths(Automaton.from_bytes(blob.as_py()).expand()):
                    kept = [(p[0], b" ".join(p[1:]), n) for p, n in zip(names, weights) if d > 1 and n]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([k[c] for k in kept], t).cast(u) for c, (t, u) in enumerate(_PHRASE)],
                        names=["lang", "phrase", "n"],
                    )

    return found.automata.select("part", "blob").mapInArrow(run, "lang string, phrase string, n long")


_PHRASE = [(pa.binary(), pa.string()), (pa.binary(), pa.string()), (pa.int64(), pa.int64())]
_QUERY = "part int, lang string, piece string, phrase string, k int, first boolean, a long"


def _part_queries(found: Counted) -> DataFrame:
    """One row per phrase, place to cut it, and part: where the part is counted, and what it belongs to."""
    held = found.automata.sparkSession.sparkContext.broadcast(found.bounds)
    kinds = [pa.int32(), pa.string(), pa.string(), pa.string(), pa.int32(), pa.bool_(), pa.int64()]
    names = [c.split()[0] for c in _QUERY.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = held.value
        for batch in batches:
            for blob in batch.column(1):
                for d, every, weights in paths(Automaton.from_bytes(blob.as_py()).expand()):
                    if d < 3:
                        continue
                    rows = []
                    for p, a in zip(every, weights):
                        if not a:
                            continue
                        lang, phrase = p[0].decode(), b" ".join(p[1:]).decode()
                        for k in range(1, d - 1):
                            for first, piece in ((True, p[1 : k + 1]), (False, p[k + 1 :])):
                                key = (p[0], piece[0], piece[1] if len(piece) > 1 else b"")
                                rows.append((bisect.bisect_right(bounds, key), lang, b" ".join(piece).decode(), phrase, k, first, a))
                        if len(rows) > 20_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)
                            rows = []
                    if rows:
                        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), kinds)], names=names)

    return found.automata.select("part", "blob").mapInArrow(run, _QUERY)


def look_up(found: Counted, queries: DataFrame) -> DataFrame:
    """`queries` (as of `_part_queries`) with `f`, the count of the part: 0 if it is rare.

    Rows go to the range that counts their part. Ranges with more than twice the usual number of rows are
    copied, and their rows are dealt to the copies by phrase. The driver learns one number per range.
    """
    spark = queries.sparkSession
    sizes = {r["part"]: r["n"] for r in queries.groupBy("part").agg(F.count(F.lit(1)).alias("n")).collect()}
    most = max(1, 2 * sum(sizes.values()) // max(1, len(found.bounds) + 1))
    plan, slots = [], 0
    for part in range(len(found.bounds) + 1):
        copies = max(1, -(-sizes.get(part, 0) // most))
        plan.append((part, slots, copies))
        slots += copies
    places = F.broadcast(spark.createDataFrame(plan, "part int, slot_at int, copies int"))
    blob = found.automata.join(places, "part").select(
        F.explode(F.expr("sequence(slot_at, slot_at + copies - 1)")).alias("slot"), F.lit(0).alias("kind"), "blob"
    )
    names = [c.split()[0] for c in _QUERY.split(", ")]
    dealt = (F.col("slot_at") + F.pmod(F.xxhash64("phrase", "k", "first"), F.col("copies"))).cast("int")
    asked = queries.join(places, "part").select(dealt.alias("slot"), F.lit(1).alias("kind"), *names)
    both = blob.unionByName(asked, allowMissingColumns=True).repartitionById(slots, F.col("slot"))
    both = both.sortWithinPartitions("slot", "kind").select("kind", "blob", *names)
    depth = found.longest + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            lo = 0
            if len(batch) and batch.column(0)[0].as_py() == 0:
                held = Automaton.from_bytes(batch.column(1)[0].as_py())
                lo = 1
            rows = batch.slice(lo).select(names)
            if not len(rows):
                continue
            parts = [(g.encode(), *p.encode().split(b" ")) for g, p in zip(rows.column(1).to_pylist(), rows.column(2).to_pylist())]
            f = np.zeros(len(parts), np.int64)
            if held is not None:
                trie, node = trie_of(parts, depth)
                weights = held.compose(trie)
                size = np.array([len(p) for p in parts])
                for d in range(depth):
                    on = size == d + 1
                    f[on] = weights[d][node[on]]
            yield pa.RecordBatch.from_arrays([*rows.columns, pa.array(f)], names=[*names, "f"])

    return both.mapInArrow(run, f"{_QUERY}, f long")


def _wide(c: Column) -> Column:
    return c.cast("decimal(24,0)")


def mine(
    docs: DataFrame, least: int = 30, top: int = 2000, longest: int = 4, percent: int = 80,
    text_col: str = "text", lang_col: str = "lang",
) -> DataFrame:
    """The best phrases of each language: lang, rank, phrase, a, l, r, n, score.

    A phrase of 2 to `longest` words counted at least `least` times is cut in two after k words, with l and r as counts
    of its parts; its score is floor(2000000 a / (l + r)), for the cut where that is lowest (the smallest k
    of equal ones). Phrases that lie in a longer one with at least `percent` % of their count are left out. `n` is the
    number of words of the language. Ties go to the higher count, then by the bytes of the phrase. Languages
    without such phrases, and empty tables, have no rows.
    """
    found = count(docs, least, longest, text_col, lang_col)
    asked = stage(_part_queries(found), "part-queries")
    words_of = lambda c: F.size(F.split(c, " "))
    # A longer phrase that holds another one holds one that is a word longer, too, with no smaller count.
    longer = asked.where((words_of("piece") > 1) & (words_of("piece") + 1 == words_of("phrase"))).select(
        "lang", F.col("piece").alias("phrase"), F.col("a").alias("longer")
    )
    rows = look_up(found, asked).select("lang", "phrase", "k", "first", "a", "f")
    rows = rows.unionByName(longer, allowMissingColumns=True)
    part = lambda k, first: F.max(F.when((F.col("k") == k) & (F.col("first") == first), F.col("f")))
    sums = rows.groupBy("lang", "phrase").agg(
        F.max("a").alias("a"),
        F.max("longer").alias("longer"),
        *[part(k, first).alias(f"{name}{k}") for k in range(1, longest) for name, first in (("l", True), ("r", False))],
    )
    sums = sums.where(F.col("longer").isNull() | (100 * _wide(F.col("longer")) < percent * _wide(F.col("a"))))
    cuts = [
        F.when(
            F.col(f"l{k}").isNotNull(),
            F.struct(
                F.expr(f"(cast(a as decimal(24,0)) * 2000000) div (cast(l{k} as decimal(24,0)) + r{k})").cast("long").alias("score"),
                F.lit(k).alias("k"),
                F.col(f"l{k}").alias("l"),
                F.col(f"r{k}").alias("r"),
            ),
        )
        for k in range(1, longest)
    ]
    scored = sums.select("lang", "phrase", "a", (F.least(*cuts) if len(cuts) > 1 else cuts[0]).alias("cut"))
    scored = scored.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    best = scored.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return best.join(found.totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")

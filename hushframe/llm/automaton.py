"""Weighted acyclic automata over words: built from sorted sequences, unions that add weights, composition for lookups."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard

_HEAD = 5


def _runs(first: np.ndarray, count: np.ndarray) -> np.ndarray:
    """first[0], first[0] + 1, … count[0] numbers, then those of first[1], …"""
    ends = np.cumsum(count)
    return np.arange(ends[-1] if len(ends) else 0) - np.repeat(ends - count - first, count)


def starts(keys: np.ndarray) -> np.ndarray:
    """For each column of sorted rows, where a row's prefix up to that column differs from the row before."""
    new = np.ones(keys.shape, bool)
    if len(keys):
        new[1:] = np.logical_or.accumulate(keys[1:] != keys[:-1], axis=1)
    return new


@dataclass(frozen=True)
class Automaton:
    """Accepts sequences of words, each with a weight.

    ``words`` are sorted by bytes; symbol s stands for ``words[s - 1]``. The arcs of state q are ``first[q]`` to ``first[q + 1]``,
    sorted by symbol; an arc's weight is that of the sequence which ends with it (0: none does). State 0 has no arcs, the
    last state is the start. States with one arc, the tails of most sequences, are shared."""

    words: pa.Array
    first: np.ndarray
    symbol: np.ndarray
    weight: np.ndarray
    target: np.ndarray

    @classmethod
    def of(cls, words: pa.Array, keys: np.ndarray, counts: np.ndarray) -> Automaton:
        """``keys`` are sorted, different rows of symbols, filled up with 0; ``counts`` their weights, above 0."""
        new = starts(keys)
        depth = keys.shape[1]
        levels = []  # (symbol, weight, parent) of each level's nodes: the different prefixes of that length
        above = np.zeros(len(keys), np.int64)
        for d in range(depth):
            has = keys[:, d] > 0
            head = new[:, d] & has
            at = np.nonzero(head)[0]
            own = np.cumsum(head) - 1
            ends = has & ((keys[:, d + 1] == 0) if d + 1 < depth else True)
            weight = np.zeros(len(at), np.int64)
            weight[own[ends]] = counts[ends]
            levels.append((keys[at, d].astype(np.int64), weight, above[at]))
            above = own
        symbols, weights, targets, sizes = [], [], [], [np.zeros(1, np.int64)]
        states, arcs = 1, np.zeros(len(levels[-1][0]) if levels else 0, np.int64)  # arcs: the state of each node below
        for d in range(depth - 1, -1, -1):
            symbol, weight, parent = levels[d]
            nodes = len(levels[d - 1][0]) if d else 1
            size = np.bincount(parent, minlength=nodes)
            start = np.cumsum(size) - size
            state = np.zeros(nodes, np.int64)
            alone = np.nonzero(size == 1)[0]
            if len(alone):
                i = start[alone]
                far = symbol[i] * states + arcs[i]
                _, far = np.unique(far, return_inverse=True)
                both = far * (weight[i].max() + 1) + weight[i]
                _, some, which = np.unique(both, return_index=True, return_inverse=True)
                state[alone] = states + which
                i = i[some]
                symbols.append(symbol[i]), weights.append(weight[i]), targets.append(arcs[i])
                sizes.append(np.ones(len(i), np.int64))
                states += len(i)
            several = np.nonzero((size > 1) | ((size == 0) & (d == 0)))[0]
            if len(several):
                state[several] = states + np.arange(len(several))
                i = _runs(start[several], size[several])
                symbols.append(symbol[i]), weights.append(weight[i]), targets.append(arcs[i])
                sizes.append(size[several])
                states += len(several)
            arcs = state
        join = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
        return cls(words, np.append(0, np.cumsum(join(sizes))), join(symbols), join(weights), join(targets))

    def step(self, states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(place in ``states``, arc) of all arcs that leave them."""
        size = self.first[states + 1] - self.first[states]
        return np.repeat(np.arange(len(states)), size), _runs(self.first[states], size)

    def sequences(self, depth: int) -> tuple[np.ndarray, np.ndarray]:
        """(keys, weights) of all sequences with a weight, of up to ``depth`` words; not sorted."""
        state = np.array([len(self.first) - 2])
        path = np.zeros((1, depth), np.int64)
        keys, weights = [path[:0]], [self.weight[:0]]
        for d in range(depth):
            of, arc = self.step(state)
            path = path[of]
            path[:, d] = self.symbol[arc]
            state, weight = self.target[arc], self.weight[arc]
            some = weight > 0
            keys.append(path[some]), weights.append(weight[some])
        return np.concatenate(keys), np.concatenate(weights)

    def pack(self) -> bytes:
        """Only the words in use are kept."""
        used, symbol = np.unique(self.symbol, return_inverse=True)
        words = self.words.take(pa.array(used - 1)).cast(pa.binary())
        offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        text = words.buffers()[2].to_pybytes()[offsets[0] : offsets[-1]] if len(words) and words.buffers()[2] else b""
        wide = np.int64 if self.weight.max(initial=0) >= 1 << 31 else np.int32
        parts = [np.diff(offsets).astype(np.int32), np.diff(self.first).astype(np.int32), (symbol + 1).astype(np.int32), self.target.astype(np.int32)]
        head = np.array([len(used), len(self.first) - 1, len(symbol), int(wide is np.int64), len(text)], np.int64)
        raw = b"".join([head.tobytes(), *(p.tobytes() for p in parts), self.weight.astype(wide).tobytes(), text])
        return zstandard.compress(raw, 1)

    @classmethod
    def unpack(cls, data: bytes) -> Automaton:
        raw = zstandard.decompress(data)
        n_words, states, n, long, _ = np.frombuffer(raw, np.int64, _HEAD)
        at = 8 * _HEAD

        def take(count: int, kind) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, kind, count, at)
            at += out.nbytes
            return out

        lengths, sizes, symbol, target = (take(c, np.int32) for c in (n_words, states, n, n))
        weight = take(n, np.int64 if long else np.int32)
        offsets = np.append(0, np.cumsum(lengths)).astype(np.int32)
        words = pa.Array.from_buffers(pa.binary(), int(n_words), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw[at:])])
        first = np.append(0, np.cumsum(sizes.astype(np.int64)))
        return cls(words, first, symbol.astype(np.int64), weight.astype(np.int64), target.astype(np.int64))


def sorted_words(words: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """(different words sorted by bytes, symbol of each of ``words``)."""
    coded = pc.dictionary_encode(words)
    if isinstance(coded, pa.ChunkedArray):
        coded = coded.combine_chunks()
        if isinstance(coded, pa.ChunkedArray):
            coded = coded.chunk(0)
    order = pc.array_sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(1, len(order) + 1)
    return coded.dictionary.take(pa.array(order)), rank[coded.indices.to_numpy()]


def counted(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Sorted different rows of ``keys`` with their counts added up."""
    if not len(keys):
        return keys, counts
    order = np.lexsort(keys.T[::-1])
    keys, counts = keys[order], counts[order]
    at = np.nonzero(starts(keys)[:, -1])[0]
    return keys[at], np.add.reduceat(counts, at)


def merged(each: Sequence[Automaton], depth: int) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(words, keys, weights) of what any of ``each`` accepts, sorted; weights of the same sequence are added up."""
    words, symbol = sorted_words(pa.chunked_array([a.words for a in each], pa.binary()))
    keys, counts, at = [], [], 0
    for a in each:
        here = np.append(0, symbol[at : at + len(a.words)])
        at += len(a.words)
        own, n = a.sequences(depth)
        keys.append(here[own])
        counts.append(n)
    return words, *counted(np.concatenate(keys), np.concatenate(counts))


def union(each: Sequence[Automaton], depth: int) -> Automaton:
    return Automaton.of(*merged(each, depth))


def compose(asked: Automaton, known: Automaton, depth: int) -> tuple[np.ndarray, np.ndarray]:
    """(keys over ``asked``'s words, weight in ``known``) of each sequence that both accept. Both are walked at once, word by
    word, along arcs with the same word."""
    same = pc.index_in(asked.words, value_set=known.words).fill_null(-1).to_numpy()
    symbol_of = np.append(-1, same) + 1
    place = (np.repeat(np.arange(len(known.first) - 1), np.diff(known.first)) << 32) + known.symbol
    here, there = np.array([len(asked.first) - 2]), np.array([len(known.first) - 2])
    path = np.zeros((1, depth), np.int64)
    keys, weights = [path[:0]], [known.weight[:0]]
    for d in range(depth):
        of, arc = asked.step(here)
        want = (there[of] << 32) + symbol_of[asked.symbol[arc]]
        found = np.minimum(np.searchsorted(place, want), max(0, len(place) - 1))
        hit = (place[found] == want) if len(place) else np.zeros(len(want), bool)
        of, arc, found = of[hit], arc[hit], found[hit]
        path = path[of]
        path[:, d] = asked.symbol[arc]
        here, there = asked.target[arc], known.target[found]
        both = (asked.weight[arc] > 0) & (known.weight[found] > 0)
        keys.append(path[both]), weights.append(known.weight[found][both])
    return np.concatenate(keys), np.concatenate(weights)

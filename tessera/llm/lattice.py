"""Viterbi over the lattices of many words at once, in numpy.

The words of a block stand side by side. Place by place, edges into the place
are tried for all words together, from the shortest on: an edge is a node of the
trie of pieces read backwards, and it fits if merging leaves it apart from the
piece that ends where it starts. Exactly one edge into each place fits. A
character that no piece holds is an edge that always fits.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np

#: Words of more characters are for a walk of their own.
LONGEST = 64
#: Words of a block.
_BLOCK = 1 << 14
#: Slots of the pairs that are remembered, at most.
_SLOTS = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


class Numbers:
    """A map from int64 keys, none negative, to int32 values, none negative: open addressing, at most half full."""

    def __init__(self, most: int | None = None) -> None:
        self.most = most
        self._empty(1 << 12)

    def _empty(self, slots: int) -> None:
        self.keys, self.values = np.full(slots, -1, np.int64), np.zeros(slots, np.int32)
        self.n, self.mask, self.shift = 0, slots - 1, np.uint64(65 - slots.bit_length())

    def _slots(self, keys: np.ndarray) -> np.ndarray:
        return (keys.view(np.uint64) * _ODD >> self.shift).view(np.int64)

    def get(self, keys: np.ndarray) -> np.ndarray:
        """The values of keys, -1 for those that are not there."""
        at = self._slots(keys)
        held = self.keys[at]
        hit = held == keys
        values = np.where(hit, self.values[at], np.int32(-1))
        left = np.flatnonzero(~hit & (held >= 0))
        while len(left):
            at[left] = next_at = (at[left] + 1) & self.mask
            held = self.keys[next_at]
            hit = held == keys[left]
            values[left[hit]] = self.values[next_at[hit]]
            left = left[~hit & (held >= 0)]
        return values

    def put(self, keys: np.ndarray, values: np.ndarray) -> None:
        """Adds distinct keys that are not there. All older ones go if there would be more than fit into `most` slots."""
        slots = len(self.keys)
        while 2 * (self.n + len(keys)) > slots:
            slots *= 2
        if self.most is not None and slots > self.most:
            slots = max(self.most, 1 << (2 * len(keys)).bit_length())
            self._empty(slots)
        elif slots > len(self.keys):
            there = self.keys >= 0
            old = self.keys[there], self.values[there]
            self._empty(slots)
            self.put(*old)
        self.n += len(keys)
        at = self._slots(keys)
        while len(keys):
            free = self.keys[at] < 0
            self.keys[at[free]] = keys[free]  # of keys that meet in a slot one stays
            won = self.keys[at] == keys
            self.values[at[won]] = values[won]
            keys, values, at = keys[~won], values[~won], (at[~won] + 1) & self.mask


class Lattice:
    """The edges of words: ends of pieces as nodes, and which pairs of pieces merging leaves apart."""

    def __init__(self, kinds: dict[str, int], ids: dict[str, int], byte_ids: list[int], apart: Callable[[str, str], bool]) -> None:
        self.apart, self.byte_ids = apart, byte_ids
        self.names = sorted(s for s, kind in kinds.items() if kind and len(s) == 1)
        nodes = {s: i for i, s in enumerate(self.names)}
        #: The node of all characters that no piece holds, and each character's; those that only longer pieces hold have none.
        self.other = len(self.names)
        self.names.append("")
        self.n_codes = len(self.names)
        self.codes = np.full(0x110000, self.other, np.int32)
        self.codes[[ord(c) for p in ids for c in p if c not in nodes]] = -1
        self.codes[[ord(s) for s in nodes]] = np.arange(len(nodes))
        longer = sorted((s for s in kinds if len(s) > 1 and all(c in nodes for c in s)), key=len)
        for s in longer:
            nodes[s] = len(self.names)
            self.names.append(s)
        self.before = Numbers()
        keys = np.array([nodes[s[1:]] * self.n_codes + nodes[s[0]] for s in longer], np.int64)
        self.before.put(keys, np.array([nodes[s] for s in longer], np.int32))
        self.edge = np.array([kinds.get(s, 1) > 0 for s in self.names], bool)
        self.ids = np.array([ids.get(s, -1) for s in self.names], np.int32)
        self.pairs = Numbers(_SLOTS)

    def _fits(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left.astype(np.int64) * len(self.names) + right
        fits = self.pairs.get(keys)
        new = fits < 0
        if new.any():
            unmet, back = np.unique(keys[new], return_inverse=True)
            names, n, other = self.names, len(self.names), self.other
            found = np.array([other in (k // n, k % n) or self.apart(names[k // n], names[k % n]) for k in unmet.tolist()], np.int32)
            self.pairs.put(unmet, found)
            fits[new] = found[back]
        return fits > 0

    def encode(self, words: list[str]) -> list[bytes | None]:
        """The ids of words as bytes of int32; None for empty words, those of over LONGEST characters and those with a character that has no node."""
        out: list[bytes | None] = [None] * len(words)
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        order = np.argsort(-sizes, kind="stable")
        order = order[(sizes[order] > 0) & (sizes[order] <= LONGEST)]
        for first in range(0, len(order), _BLOCK):
            block = order[first : first + _BLOCK]
            size = sizes[block]
            flat = np.frombuffer("".join([words[i] for i in block.tolist()]).encode("utf-32-le"), np.uint32)
            whole = np.minimum.reduceat(self.codes[flat], np.cumsum(size) - size) >= 0
            if not whole.all():
                flat, block, size = flat[np.repeat(whole, size)], block[whole], size[whole]
            if len(block):
                for i, ids in zip(block.tolist(), self._paths(flat, size), strict=True):
                    out[i] = ids
        return out

    def _paths(self, flat: np.ndarray, size: np.ndarray) -> list[bytes]:
        """The ids of words given as their characters one after another, the longest words first."""
        n, longest = len(size), int(size[0])
        of = np.repeat(np.arange(n), size)
        codes = np.zeros((longest, n), np.int32)
        codes[np.arange(len(flat)) - np.repeat(np.cumsum(size) - size, size), of] = self.codes[flat]
        last, back = np.zeros((longest + 1, n), np.int32), np.zeros((longest + 1, n), np.int8)
        for end in range(1, longest + 1):
            at = np.arange(np.searchsorted(-size, -end, "right"))  # the words that reach so far
            start, node = end - 1, codes[end - 1, : len(at)]
            while start and len(at):
                edges = np.flatnonzero(self.edge[node])
                fits = edges[self._fits(last[start, at[edges]], node[edges])]
                found = at[fits]
                last[end, found], back[end, found] = node[fits], start
                left = np.ones(len(at), bool)
                left[fits] = False
                start -= 1
                at = at[left]
                node = self.before.get(node[left].astype(np.int64) * self.n_codes + codes[start, at])
                if (node < 0).any():
                    raise ValueError("no edge into a place of a word")
            if not self.edge[node].all():  # merging always leaves an edge that ends here
                raise ValueError("no edge into a place of a word")
            last[end, at] = node
        steps, at, row = [], size.copy(), np.arange(n)
        while len(row):
            steps.append((row, self.ids[last[at, row]]))
            at = back[at, row].astype(np.int64)
            row, at = row[at > 0], at[at > 0]
        count = np.zeros(n, np.int64)
        for row, _ in steps:
            count[row] += 1
        stop = np.cumsum(count)
        ids = np.zeros(int(stop[-1]), np.int32)
        for i, (row, found) in enumerate(steps):
            ids[stop[row] - 1 - i] = found
        lone = np.flatnonzero(ids < 0)  # in the order of their characters
        if len(lone):
            held = [c.encode() for c in map(chr, flat[self.codes[flat] == self.other].tolist())]
            lengths = np.ones(len(ids), np.int64)
            lengths[lone] = [len(b) for b in held]
            there = np.zeros(len(ids), bool)
            there[lone] = True
            ids, there = np.repeat(ids, lengths), np.repeat(there, lengths)
            ids[there] = np.array(self.byte_ids, np.int32)[np.frombuffer(b"".join(held), np.uint8)]
            stop = np.cumsum(lengths)[stop - 1]
        raw, stops = ids.tobytes(), (4 * stop).tolist()
        return [raw[a:b] for a, b in zip([0, *stops], stops, strict=False)]

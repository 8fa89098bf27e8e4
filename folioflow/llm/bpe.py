"""Byte-pair encoding of many short words at once, with the vocabulary and merges of a public tokenizer file.

For words of ASCII and Latin-1 letters, of digits and of marks, the file's normaliser lower-cases and its
pattern parts nothing further; all other words go to the tokenizers library. Both give the same ids.
"""

from __future__ import annotations

import json

import numpy as np

LONGEST = 24
_TABLE_BITS = 19
_NONE = np.int32(1 << 30)


def byte_letters() -> list[str]:
    """The letter that stands for each byte in byte-level vocabularies: itself where it can be printed, else the next unused one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return [chr(b) if b in plain else chr(256 + rest.index(b)) for b in range(256)]


class Merger:
    """Ids of words given as bytes; each merge takes the pair of the lowest rank, and of those the leftmost."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab, suffix = model["vocab"], model["end_of_word_suffix"]
        letters = byte_letters()
        self.inner = np.array([vocab.get(c, -1) for c in letters], np.int32)
        self.last = np.array([vocab.get(c + suffix, -1) for c in letters], np.int32)
        self.base = np.int64(max(vocab.values()) + 1)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        keys = np.array([vocab[a] * int(self.base) + vocab[b] for a, b in pairs], np.int64)
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int32)
        # ranks by open addressing: a key is in one of a few slots from its own on
        self.mask = (1 << _TABLE_BITS) - 1
        self.keys = np.full(1 << _TABLE_BITS, -1, np.int64)
        self.ranks = np.full(1 << _TABLE_BITS, _NONE, np.int32)
        left, rank, self.probes = keys, np.arange(len(keys), dtype=np.int32), 0
        slot = self._slot(keys)
        while len(left):
            self.probes += 1
            free = self.keys[slot] < 0
            _, first = np.unique(slot[free], return_index=True)
            take = np.flatnonzero(free)[first]
            self.keys[slot[take]], self.ranks[slot[take]] = left[take], rank[take]
            rest = np.ones(len(left), bool)
            rest[take] = False
            left, rank, slot = left[rest], rank[rest], (slot[rest] + 1) & self.mask

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - _TABLE_BITS)).astype(np.int64)

    def _rank(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a * self.base + b
        slot = self._slot(key)
        out = np.where(self.keys[slot] == key, self.ranks[slot], _NONE)
        todo = np.flatnonzero((self.keys[slot] != key) & (self.keys[slot] >= 0) & (a >= 0) & (b >= 0))
        slot = slot[todo]
        for _ in range(self.probes - 1):
            if not len(todo):
                break
            slot = (slot + 1) & self.mask
            at = self.keys[slot]
            hit = at == key[todo]
            out[todo[hit]] = self.ranks[slot[hit]]
            go = ~hit & (at >= 0)
            todo, slot = todo[go], slot[go]
        out[(a < 0) | (b < 0)] = _NONE
        return out

    def ids(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words one after the other, how many each has); no word is empty or longer than LONGEST."""
        n = len(starts)
        count = np.zeros(n, np.int64)
        kept: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        edges = (0, 4, 8, 12, 16, LONGEST)
        for low, high in zip(edges[:-1], edges[1:], strict=True):
            rows = np.flatnonzero((sizes > low) & (sizes <= high))
            if len(rows):
                ids, length = self._merge(data, starts[rows], sizes[rows], high)
                count[rows] = length
                kept.append((rows, ids, length))
        at = np.concatenate([[0], np.cumsum(count)])
        out = np.zeros(int(at[-1]), np.uint32)
        for rows, ids, length in kept:
            real = np.arange(ids.shape[1]) < length[:, None]
            out[(at[rows][:, None] + np.arange(ids.shape[1]))[real]] = ids[real]
        return out, count

    def _merge(self, data: np.ndarray, starts: np.ndarray, sizes: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
        n = len(starts)
        cols = np.arange(width)
        real = cols < sizes[:, None]
        raw = data[np.minimum(starts[:, None] + cols, len(data) - 1)]
        ids = np.where(real, self.inner[raw], np.int32(-1)).astype(np.int64)
        ids[np.arange(n), sizes - 1] = self.last[raw[np.arange(n), sizes - 1]]
        ranks = np.full((n, width), _NONE, np.int32)  # of the pair that begins here
        i, j = np.nonzero(real[:, 1:])
        ranks[i, j] = self._rank(ids[i, j], ids[i, j + 1])
        length = sizes.astype(np.int64).copy()
        live = np.arange(n)
        while len(live):
            r = ranks[live]
            at = r.argmin(axis=1)
            best = r[np.arange(len(live)), at]
            going = best < _NONE
            live, at, best = live[going], at[going], best[going]
            if not len(live):
                break
            shift = np.minimum(cols + (cols > at[:, None]), width - 1)
            row = np.arange(len(live))
            new = ids[live][row[:, None], shift]
            new[:, -1] = np.where(shift[:, -1] == cols[-1], -1, new[:, -1])
            new[row, at] = self.made[best]
            moved = ranks[live][row[:, None], shift]
            moved[:, -1] = _NONE
            length[live] -= 1
            follows = at + 1 < length[live]
            after = np.full(len(live), _NONE, np.int32)
            k = np.flatnonzero(follows)
            after[k] = self._rank(new[k, at[k]], new[k, at[k] + 1])
            moved[row, at] = after
            k = np.flatnonzero(at > 0)
            moved[k, at[k] - 1] = self._rank(new[k, at[k] - 1], new[k, at[k]])
            ids[live], ranks[live] = new, moved
        return ids, length

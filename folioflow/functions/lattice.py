"""Words of text that is written without blanks: the most probable path through the words that a dictionary knows.

Every known word is an edge from its start to its end, every character one too, so that there always is a path. A path's chance is the product
of its words' shares of all counts; what the dictionary lacks counts once.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioflow.functions.folds import freed

#: CJK characters: the first, and how many.
FIRST, SPAN = 0x4E00, 0x9FFF - 0x4E00 + 1
#: Words of a dictionary at most, since it is sent to every task; and characters of a word.
MAX_WORDS, LONGEST = 500_000, 8
#: Bytes of text and characters of runs in hand at the same time; runs of over LONG characters of which there are fewer than FEW are cut one by one.
TEXT_BYTES, RUN_CHARS, FEW, LONG = 1 << 19, 1 << 18, 16, 128
#: Places of a table of nodes by characters at most.
DENSE = 1 << 24
_NONE, _CJK, _OTHER = 1, 2, 3
#: What a code point is: no part of a word, CJK, or another letter or digit; 0 until it is asked for.
_kinds = np.zeros(0x110000, np.uint8)
_kinds[FIRST : FIRST + SPAN] = _CJK


def best_path(run: str, words: dict[str, float], unknown: float, longest: int = LONGEST) -> list[str]:
    """The run cut into words with the greatest sum of weights (logarithms); of equal cuts that with the longer word first."""
    n = len(run)
    best, step = [0.0] * (n + 1), [1] * n
    for i in range(n - 1, -1, -1):
        best[i] = words.get(run[i], unknown) + best[i + 1]
        for j in range(i + 2, min(n, i + longest) + 1):
            weight = words.get(run[i:j])
            if weight is not None and weight + best[j] >= best[i]:
                best[i], step[i] = weight + best[j], j - i
    out, i = [], 0
    while i < n:
        out.append(run[i : i + step[i]])
        i += step[i]
    return out


def dictionary(counts: DataFrame, word: str = "word", n: str = "n", most: int = MAX_WORDS) -> dict[str, int]:
    """The commonest words of counts (word, n), at most ``most`` of at most ``LONGEST`` characters."""
    rows = counts.where((F.length(word) <= LONGEST) & (F.length(word) > 0) & (F.col(n) > 0)).orderBy(F.col(n).desc(), word).limit(most)
    found = rows.select(word, n).toArrow()
    return dict(zip(found[word].to_pylist(), found[n].to_pylist(), strict=True))


def kinds(points: np.ndarray) -> np.ndarray:
    found = _kinds[points]
    if not found.all():
        for p in np.unique(points[found == 0]).tolist():
            _kinds[p] = _OTHER if chr(p).isalnum() else _NONE
        found = _kinds[points]
    return found


class Lattice:
    """Cuts many runs at the same time, each as ``best_path`` does.

    The dictionary is a tree of characters: what starts at any place is looked up for all places, a character further at a time. Then all runs
    are gone through from their ends together, so that a step is a few operations on arrays and adds the same numbers in the same order.
    """

    def __init__(self, text: str, lengths: np.ndarray, weights: np.ndarray, unknown: float) -> None:
        """Words of CJK characters, one after the other in ``text``, with their weights."""
        self.unknown = unknown
        chars = np.frombuffer(text.encode("utf-16-le"), "<u2").astype(np.int64) - FIRST
        starts, node = np.cumsum(lengths) - lengths, np.zeros(len(lengths), np.int64)
        edges, n = [np.empty(0, np.int64)], 1
        for depth in range(LONGEST):
            some = np.flatnonzero(lengths > depth)
            level, which = np.unique(node[some] * SPAN + chars[starts[some] + depth], return_inverse=True)
            node[some] = n + which
            edges.append(level)
            n += len(level)
        self.weight = np.full(n, -np.inf)
        self.weight[node] = weights
        self.first = np.zeros(SPAN, np.int64)
        self.first[edges[1]] = np.arange(1, 1 + len(edges[1]))
        self.single = self.weight[self.first]
        self.single[self.single == -np.inf] = unknown
        self._keep(np.concatenate(edges))

    def _keep(self, edges: np.ndarray) -> None:
        """The edges (node and character) for lookup; the one at place i leads to node i + 1."""
        node, char = np.divmod(edges, SPAN)
        inner = np.unique(node)
        #: Nodes that lead on, counted from 1, as rows of a table; 0 for the others and the root, which also stands for none.
        self.row = np.zeros(len(edges) + 1, np.int64)
        self.row[inner] = np.arange(1, 1 + len(inner))
        self.row[0] = 0
        used = np.unique(char)
        self.letter = np.zeros(SPAN, np.int64)
        self.letter[used] = np.arange(1, 1 + len(used))
        self.letters, leads = 1 + len(used), np.arange(1, 1 + len(edges), dtype=np.int32)
        keys = self.row[node] * self.letters + self.letter[char]
        self.dense = (1 + len(inner)) * self.letters <= DENSE
        if self.dense:
            self.child = np.zeros((1 + len(inner)) * self.letters, np.int32)
            self.child[keys[node > 0]] = leads[node > 0]
            return
        # with many characters the table is a hash table
        bits = max(4, (2 * len(edges)).bit_length())
        self.shift, self.last = np.uint64(64 - bits), (1 << bits) - 1
        self.keys, self.child = np.full(1 << bits, -1, np.int64), np.zeros(1 << bits, np.int32)
        todo = np.flatnonzero(node > 0)
        at = self._slot(keys[todo])
        while len(todo):
            free = self.keys[at] == -1
            self.keys[at[free]] = keys[todo[free]]  # of those that meet one stays
            won = self.keys[at] == keys[todo]
            self.child[at[won]] = leads[todo[won]]
            todo, at = todo[~won], (at[~won] + 1) & self.last

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def _next(self, rows: np.ndarray, letters: np.ndarray) -> np.ndarray:
        """The nodes that the letters lead to, 0 for none."""
        key = rows * self.letters + letters
        if self.dense:
            return self.child.take(key)
        at = self._slot(key)
        found = self.keys.take(at)
        out = np.where(found == key, self.child.take(at), 0)
        more = np.flatnonzero((found != key) & (found != -1))
        while len(more):
            at[more] = (at[more] + 1) & self.last
            found = self.keys[at[more]]
            hit = found == key[more]
            out[more[hit]] = self.child[at[more[hit]]]
            more = more[~hit & (found != -1)]
        return out

    def weights(self, chars: np.ndarray, following: np.ndarray) -> np.ndarray:
        """By length and place, the weight of the word that starts there, -inf for none; ``following`` is the place of the next character, -1 for none."""
        out = np.full((LONGEST, len(chars)), -np.inf)
        out[0] = self.single.take(chars)
        letters, start = self.letter.take(chars), np.arange(len(chars))
        at, rows = following, self.row.take(self.first.take(chars))
        for depth in range(1, LONGEST):
            on = np.flatnonzero((rows > 0) & (at >= 0))
            start, at = start.take(on), at.take(on)
            node = self._next(rows.take(on), letters.take(at))
            out[depth, start] = self.weight.take(node)
            at, rows = following.take(at), self.row.take(node)
        return out

    def cuts(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Where words start in the runs; chars are counted from ``FIRST``."""
        bundle = (np.cumsum(lengths) - 1) // RUN_CHARS
        edges = [0, *(np.flatnonzero(np.diff(bundle)) + 1).tolist(), len(lengths)]
        out = []
        for a, b in zip(edges, edges[1:], strict=False):
            order = a + np.argsort(-lengths[a:b], kind="stable")
            some, sizes = starts[order], lengths[order]
            n_long = int((sizes > max(LONG, sizes[FEW - 1] if len(sizes) >= FEW else 0)).sum())
            out += [s + self._one(chars[s : s + n]) for s, n in zip(some[:n_long].tolist(), sizes[:n_long].tolist(), strict=True)]
            out += self._together(chars, some[n_long:], sizes[n_long:])
        return out

    def _one(self, run: np.ndarray) -> np.ndarray:
        """Where words start in one long run, from its end a word at a time."""
        best, step = [0.0] * (len(run) + 1), [1] * len(run)
        for a in range((len(run) - 1) // RUN_CHARS * RUN_CHARS, -1, -RUN_CHARS):
            piece = run[a : a + RUN_CHARS + LONGEST - 1]
            weights = self.weights(piece, np.append(np.arange(1, len(piece)), -1))[:, :RUN_CHARS].T[::-1]
            at, size = np.nonzero(weights > -np.inf)
            for i, n, w in zip((a + len(weights) - 1 - at).tolist(), (size + 1).tolist(), weights[at, size].tolist(), strict=True):
                score = w + best[i + n]
                if n == 1 or score >= best[i]:
                    best[i], step[i] = score, n
        out, i = [], 0
        while i < len(run):
            out.append(i)
            i += step[i]
        return np.array(out, np.int64)

    def _together(self, chars: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> list[np.ndarray]:
        """Where words start in runs, of which the longest is first."""
        if not len(lengths):
            return []
        # places are ordered by their distance from the run's end, then by run: those of one distance are a slice, those a character on an earlier one
        longest = int(lengths[0])
        n = len(lengths) - np.cumsum(np.bincount(lengths, minlength=longest + 1))[:longest]
        off = np.cumsum(n) - n
        left = np.repeat(np.arange(longest), n)
        run = np.arange(len(left)) - off[left]
        place = starts[run] + lengths[run] - 1 - left
        following = np.where(left > 0, off[left - 1] + run, -1)
        weights = self.weights(chars[place], following)
        best, step = np.empty(len(place)), np.ones(len(place), np.int8)
        at, counts = off.tolist(), n.tolist()
        for t, (a, k) in enumerate(zip(at, counts, strict=True)):
            here, size = best[a : a + k], step[a : a + k]
            np.add(weights[0, a : a + k], best[at[t - 1] : at[t - 1] + k] if t else 0.0, out=here)
            for d in range(2, min(LONGEST, t + 1) + 1):
                other = weights[d - 1, a : a + k] + (best[at[t - d] : at[t - d] + k] if t >= d else 0.0)
                np.copyto(size, d, where=other >= here)
                np.maximum(here, other, out=here)
        out, runs, left = [], np.arange(len(lengths)), lengths - 1
        while len(runs):
            i = off[left] + runs
            out.append(place[i])
            left = left - step[i]
            on = left >= 0
            runs, left = runs[on], left[on]
        return out

    def words(self, texts: pa.Array) -> pa.Array:
        """An array of words for each text."""
        strings = [t or "" for t in texts.to_pylist()]
        ends = np.cumsum([0, *map(len, strings)])
        points = np.frombuffer("".join(strings).encode("utf-32-le"), "<u4")
        del strings
        kind = kinds(points)
        new = np.ones(len(points), bool)
        new[1:] = kind[1:] != kind[:-1]
        new[ends[ends < len(points)]] = True
        starts = np.flatnonzero(new)
        lengths, of = np.diff(np.append(starts, len(points))), kind[starts]
        begins = np.zeros(len(points), bool)
        begins[starts[of == _OTHER]] = True
        cjk = of == _CJK
        if cjk.any():
            for places in self.cuts(points.astype(np.int32) - FIRST, starts[cjk], lengths[cjk]):
                begins[places] = True
        # the words' characters follow each other in the values as in the text
        kept = kind != _NONE
        width = kept * (np.uint8(1) + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000))
        upto = np.cumsum(width, dtype=np.int32)
        offsets = np.append(0, upto)[np.append(np.flatnonzero(begins), len(points))].astype(np.int32)
        data = points[kept].tobytes().decode("utf-32-le").encode()
        values = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(offsets), pa.py_buffer(data))
        before = np.append(0, np.cumsum(begins))[ends].astype(np.int32)
        return pa.ListArray.from_arrays(pa.array(before), values)


_made: dict[str, Lattice] = {}


def _lattice(key: str, *parts) -> Lattice:
    """The worker's lattice of that key: made by its first task, the next ones find it there."""
    if key not in _made:
        _made.clear()
        _made[key] = Lattice(*parts)
    return _made[key]


def packed(known: dict[str, int]) -> tuple[str, np.ndarray, np.ndarray, float]:
    """What ``Lattice`` takes, of the words that can be in runs of CJK characters; weights are logarithms of shares of all counts."""
    total = math.log(max(1, sum(known.values())))
    usable = {w: math.log(n) - total for w, n in known.items() if 0 < len(w) <= LONGEST and all(FIRST <= ord(c) < FIRST + SPAN for c in w)}
    return "".join(usable), np.array([len(w) for w in usable], np.int64), np.array(list(usable.values()), np.float64), -total


def words(c: Column | str, known: dict[str, int]) -> Column:
    """An array of a text's words: runs of CJK characters cut by the dictionary, other runs of letters and digits whole. Null has none."""
    if len(known) > MAX_WORDS:
        raise ValueError(f"a dictionary has at most {MAX_WORDS} words")
    key, parts, none = uuid.uuid4().hex, packed(known), pa.array([], pa.list_(pa.string()))

    @F.arrow_udf("array<string>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        lattice = _lattice(key, *parts)
        for texts in batches:
            sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
            share = (np.cumsum(sizes, dtype=np.int64) - 1) // TEXT_BYTES
            edges = [0, *(np.flatnonzero(np.diff(share)) + 1).tolist(), len(texts)]
            yield pa.concat_arrays([none, *(lattice.words(texts.slice(a, b - a)) for a, b in zip(edges, edges[1:], strict=False) if b > a)])
            del texts
            freed()

    return run(c)

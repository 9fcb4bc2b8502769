"""Frequent k-mers of all lengths in two passes over the reads.

A k-mer in more than a share of all reads is in more than that share of at least one part of them. So each part is searched
for its own frequent k-mers, from a start size on as long as they can be extended, and what any part finds is counted exactly
in all of them. Both walk all places of a part at once; what isn't frequent leaves the walk.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Letters of a part at least, where there are so many; a part has less than twice as many, or one batch more.
PART_LETTERS = 3_000_000
#: Buckets that places are counted in first, and entries at most of the table that takes the first letters at once.
_BUCKETS_LOG2, _JUMP = 20, 1 << 22


@dataclass
class Part:
    """The letters of some texts in a row: what each is, whose it is, and how many its text has from there on."""

    chars: np.ndarray
    owner: np.ndarray
    left: np.ndarray
    texts: int


def part(batches: list[pa.Array]) -> Part:
    """Texts as code points; a null is an empty text."""
    texts = pc.fill_null(pa.chunked_array(batches).cast(pa.large_string()), "").combine_chunks()
    texts = texts if isinstance(texts, pa.Array) else pa.concat_arrays(texts.chunks)
    size = pc.utf8_length(texts).to_numpy(zero_copy_only=False).astype(np.int64)
    offsets = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]] if len(texts) else np.zeros(0, np.uint8)
    chars = raw if size.sum() == len(raw) else np.frombuffer(raw.tobytes().decode().encode("utf-32-le"), np.uint32)
    end = np.repeat(np.cumsum(size).astype(np.int32), size)
    return Part(chars, np.repeat(np.arange(len(size), dtype=np.int32), size), end - np.arange(len(chars), dtype=np.int32), len(size))


def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[Part]:
    """The texts of a first column in parts of one to two times PART_LETTERS, the last one perhaps of fewer."""
    held: list[tuple[pa.Array, int]] = []
    for b in batches:
        step = max(1, min(b.num_rows, 2_000))
        for i in range(0, b.num_rows, step):
            piece = b.column(0)[i : i + step]
            held.append((piece, pc.sum(pc.utf8_length(piece)).as_py() or 0))
        while sum(n for _, n in held) >= 2 * PART_LETTERS:
            taken, n = [], 0
            while n < PART_LETTERS:
                taken.append(held[0][0])
                n += held.pop(0)[1]
            yield part(taken)
    if held:
        yield part([a for a, _ in held])


def _in_texts(cls: np.ndarray, owner: np.ndarray, texts: int, classes: int) -> np.ndarray:
    """Of how many texts each class has a place."""
    key = np.sort(cls.astype(np.int64) * texts + owner)
    return np.bincount(key[np.flatnonzero(np.diff(key, prepend=-1))] // max(texts, 1), minlength=classes)


def _words(code: np.ndarray, letters: int, k: int) -> np.ndarray:
    """A number for the k letters from each place on, the same for the same letters."""
    n = len(code) - k + 1
    word, top = np.zeros(max(n, 0), np.int64), 1
    for j in range(k if n > 0 else 0):
        if top * letters >= 2**62:
            seen, word = np.unique(word, return_inverse=True)
            top = len(seen)
        word = word * letters + code[j : n + j]
        top *= letters
    return word


def longest_frequent(p: Part, k: int, longest: int, least: int, texts: int) -> list[str]:
    """The k-mers in more than least / texts of the part's texts that no letter can be added to, of the size k to longest."""
    kinds, code = np.unique(p.chars, return_inverse=True)
    code, a = code.astype(np.int64), max(len(kinds), 1)
    over = lambda n: n * texts > least * p.texts
    word = _words(code, a, k)
    at = np.flatnonzero(p.left[: len(word)] >= k)
    word = word[at]
    bucket = (word.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - _BUCKETS_LOG2)).astype(np.int64)
    often = over(np.bincount(bucket, minlength=1 << _BUCKETS_LOG2))[bucket]
    at, word = at[often], word[often]
    seen, word = np.unique(word, return_inverse=True)
    found, size, classes, first, parent = [], k, len(seen), np.zeros(0, np.int64), None
    while True:
        # Places are counted first: a class in few places is in few texts.
        stay = over(np.bincount(word, minlength=classes))
        some = stay[word]
        at, word = at[some], word[some]
        stay &= over(_in_texts(word, p.owner[at], p.texts, classes))
        some = stay[word]
        at, word = at[some], (np.cumsum(stay) - 1)[word[some]]
        if parent is not None:
            ends = np.ones(len(first), bool)
            ends[parent[stay]] = False
            found += [(int(x), size - 1) for x in first[ends]]
        first = np.zeros(int(stay.sum()), np.int64)
        first[word] = at
        if not len(first):
            break
        if size >= longest:
            found += [(int(x), size) for x in first]
            break
        some = p.left[at] > size
        at, word = at[some], word[some]
        word = word * a + code[at + size]
        classes, parent = len(first) * a, np.arange(len(first) * a) // a
        size += 1
    return ["".join(map(chr, p.chars[x : x + n])) for x, n in found]


class Trie:
    """All prefixes of some texts of k letters and more as nodes; 0 is the empty one, and longer ones have higher numbers."""

    def __init__(self, texts: list[str], k: int):
        self.k, self.texts = k, (texts := sorted(set(texts)))
        p = part([pa.array(texts, pa.string())])
        self.kinds = np.unique(p.chars)
        self.a = a = len(self.kinds) + 1
        code, size = np.searchsorted(self.kinds, p.chars), np.bincount(p.owner, minlength=len(texts))
        start = np.cumsum(size) - size
        self.parent, self.depth, self.text = [np.zeros(1, np.int64)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        node, own, nodes, steps, depth = np.zeros(len(texts), np.int64), np.arange(len(texts)), 1, [], 0
        self.jump, self.jumped, word = np.zeros(1, np.int32), 0, np.zeros(1, np.int64)
        while True:
            more = size[own] > depth
            own, node = own[more], node[more]
            if not len(own):
                break
            edge, at, node = np.unique(node * a + code[start[own] + depth], return_index=True, return_inverse=True)
            self.parent.append(edge // a)
            self.depth.append(np.full(len(edge), depth + 1))
            self.text.append(own[at])
            steps.append(edge)
            depth += 1
            if depth <= k and a**depth <= _JUMP:
                word = word[edge // a - (nodes - len(word))] * a + edge % a
                self.jump, self.jumped = np.full(a**depth, -1, np.int32), depth
                self.jump[word] = np.arange(nodes, nodes + len(edge))
            node, nodes = node + nodes, nodes + len(edge)
        self.parent, self.depth, self.text = map(np.concatenate, (self.parent, self.depth, self.text))
        self.child = np.full(nodes * a, -1, np.int32)
        self.child[np.concatenate([*steps, np.zeros(0, np.int64)]).astype(np.int64)] = np.arange(1, nodes)

    def word(self, node: int) -> str:
        return self.texts[self.text[node]][: self.depth[node]]

    def counts(self, p: Part) -> np.ndarray:
        """In how many of the part's texts each node of k letters and more is."""
        k, out = self.k, np.zeros(len(self.depth), np.int64)
        if not self.texts:
            return out
        code = np.minimum(np.searchsorted(self.kinds, p.chars), self.a - 2).astype(np.int64)
        code[self.kinds[code] != p.chars] = self.a - 1
        word = _words(code, self.a, self.jumped)[: len(p.chars)]
        at = np.flatnonzero(p.left[: len(word)] >= k)
        node = self.jump[word[at]]
        del word
        size = self.jumped
        while True:
            some = node >= 0
            at, node = at[some], node[some]
            if not len(at):
                return out
            if size >= k:
                low, high = int(node.min()), int(node.max()) + 1
                out[low:high] += _in_texts(node - low, p.owner[at], p.texts, high - low)
            some = p.left[at] > size
            at, node = at[some], node[some]
            node = self.child[node.astype(np.int64) * self.a + code[at + size]]
            size += 1

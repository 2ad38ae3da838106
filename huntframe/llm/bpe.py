"""Byte-level BPE of a whole corpus: speculate and verify.

Texts are split into words by the vocabulary's pattern. For every word not yet known, a greedy
longest match proposes tokens. A proposal is the BPE result exactly if all its adjacent pairs
are compatible, that is if merging the two tokens' bytes gives these two tokens again; one
vectorised pass tests every adjacent pair of all new words. Only words that hold an
incompatible pair are merged exactly. Known words are kept per worker up to a bound.

Defined cases: null and empty texts give an empty list (length 0); strings of special tokens
are plain text; any text length works, as words are handled one by one; a very long word is
proposed and verified like any other, in linear time.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession

#: Where the vocabulary files lie; a parameter of every public function here.
VOCABULARIES = os.environ.get("HUNTFRAME_TOKENIZERS", "/opt/tokenizers")

# Fixed value: the published pattern that splits text before the merges.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: The same for texts of ASCII characters only, where classes are plain ranges.
_ASCII = re.compile(r"""'s|'t|'re|'ve|'m|'ll|'d| ?[A-Za-z]+| ?[0-9]+| ?[^\s0-9A-Za-z]+|\s+(?!\S)|\s+""", re.ASCII)
_ANY = regex.compile(PATTERN)

#: Words a worker remembers before it starts afresh; bounds its memory.
KNOWN_WORDS = 300_000


def words(text: str) -> list[str]:
    return _ASCII.findall(text) if text.isascii() else _ANY.findall(text)


class Tables:
    """What merging needs: ids of byte strings, the split of each token, ids of mergeable pairs.

    The size is that of the vocabulary, about 50 000 tokens, whatever the corpus.
    """

    def __init__(self, ranks: dict[bytes, int]):
        self.ids = ranks
        self.longest = max(map(len, ranks))
        self.base = max(ranks.values()) + 1
        self.left = np.arange(self.base, dtype=np.int64)
        self.right = np.arange(self.base, dtype=np.int64)
        self.pairs: dict[tuple[int, int], int] = {}
        for token, i in sorted(ranks.items(), key=lambda x: x[1]):
            if len(token) > 1:
                a, b = self._split(token, i)
                self.left[i], self.right[i] = a, b
                self.pairs[a, b] = i
        keys = np.array([a * self.base + b for a, b in self.pairs], dtype=np.int64)
        order = np.argsort(keys)
        self.keys, self.made = keys[order], np.array(list(self.pairs.values()), dtype=np.int64)[order]

    def _split(self, token: bytes, limit: int) -> tuple[int, int]:
        """The two tokens whose merge makes ``token``: what merges of lower rank leave of it."""
        left = self.merge([self.ids[token[i : i + 1]] for i in range(len(token))])
        if len(left) != 2:
            raise ValueError(f"token {limit} isn't the merge of two others")
        return left[0], left[1]

    def merge(self, parts: list[int]) -> list[int]:
        """Exact merging: always the adjacent pair of lowest rank, the leftmost among equals."""
        n = len(parts)
        nxt, prv = list(range(1, n + 1)), list(range(-1, n - 1))
        alive = parts[:]
        heap = [(r, i, alive[i], alive[i + 1]) for i in range(n - 1) if (r := self.pairs.get((alive[i], alive[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = nxt[i] if alive[i] == a else n
            if j >= n or alive[j] != b:
                continue
            alive[i], alive[j], nxt[i] = r, -1, nxt[j]
            if nxt[i] < n:
                prv[nxt[i]] = i
                if (s := self.pairs.get((r, alive[nxt[i]]))) is not None:
                    heapq.heappush(heap, (s, i, r, alive[nxt[i]]))
            if prv[i] >= 0 and (s := self.pairs.get((alive[prv[i]], r))) is not None:
                heapq.heappush(heap, (s, prv[i], alive[prv[i]], r))
        return [x for x in alive if x >= 0]

    def greedy(self, word: bytes) -> list[int]:
        """The longest token at each place."""
        out, i, n, ids = [], 0, len(word), self.ids
        while i < n:
            j = min(n, i + self.longest)
            while (t := ids.get(word[i:j])) is None:
                j -= 1
            out.append(t)
            i = j
        return out

    def compatible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """For each pair of tokens, whether merging their bytes gives the pair again.

        Merging the two undone step by step: the later-made of the tokens at the border is
        split, and no token across the border may have been mergeable before that.
        """
        a, b = a.copy(), b.copy()
        limit = np.full(len(a), np.iinfo(np.int64).max)
        good = np.ones(len(a), dtype=bool)
        live = np.arange(len(a))
        while len(live):
            x, y = a[live], b[live]
            key = x * self.base + y
            at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
            crossed = (self.keys[at] == key) & (self.made[at] < limit[live])
            good[live[crossed]] = False
            live, x, y = live[~crossed], x[~crossed], y[~crossed]
            can_x, can_y = self.right[x] != x, self.left[y] != y
            undo_x = can_x & ((x > y) | ~can_y)
            undo_y = can_y & ~undo_x
            limit[live] = np.where(undo_x, x, np.where(undo_y, y + 1, limit[live]))
            a[live] = np.where(undo_x, self.right[x], x)
            b[live] = np.where(undo_y, self.left[y], y)
            live = live[undo_x | undo_y]
        return good

    def encode_words(self, new: list[str]) -> list[tuple[int, ...]]:
        """Ids of each word: greedy proposals, one check of all pairs, exact merging of what fails."""
        proposals = []
        for w in new:
            raw = w.encode()
            t = self.ids.get(raw)
            proposals.append([t] if t is not None else self.greedy(raw))
        sizes = np.fromiter(map(len, proposals), dtype=np.int64, count=len(proposals))
        flat = np.fromiter(chain.from_iterable(proposals), dtype=np.int64, count=int(sizes.sum()))
        word = np.repeat(np.arange(len(proposals)), sizes)
        inner = np.flatnonzero(word[:-1] == word[1:])
        if len(inner):
            pairs, back = np.unique(flat[inner] * self.base + flat[inner + 1], return_inverse=True)
            good = self.compatible(pairs // self.base, pairs % self.base)
            for i in np.unique(word[inner[~good[back]]]):
                proposals[i] = self.merge([self.ids[bytes([c])] for c in new[i].encode()])
        return [tuple(p) for p in proposals]


_tables: dict[str, Tables] = {}


def tables(path: str) -> Tables:
    """The tables of a vocabulary file of ranks, once per process; where the path is unknown, of the file shipped under its name."""
    if path not in _tables:
        with open(path if os.path.exists(path) else SparkFiles.get(os.path.basename(path)), "rb") as f:
            _tables[path] = Tables({base64.b64decode(a): int(b) for a, b in map(bytes.split, f)})
    return _tables[path]


class Encoder:
    """Encodes batches of texts; remembers words within a bound."""

    def __init__(self, path: str):
        self.tables, self.known = tables(path), {}

    def split(self, texts: list[str | None]) -> list[list[str]]:
        """The words of each text, all of them known afterwards."""
        split = [words(t) if t else [] for t in texts]
        new = set(chain.from_iterable(split)).difference(self.known)
        if len(self.known) + len(new) > KNOWN_WORDS:
            self.known = {}
            new = set(chain.from_iterable(split))
        if new:
            listed = list(new)
            self.known.update(zip(listed, self.tables.encode_words(listed)))
        return split

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and the number of each text."""
        parts = [np.fromiter(chain.from_iterable(map(self.known.__getitem__, w)), dtype=np.int32) for w in self.split(texts)]
        return np.concatenate(parts) if parts else np.empty(0, np.int32), np.fromiter(map(len, parts), dtype=np.int32, count=len(parts))

    def count(self, texts: list[str | None]) -> np.ndarray:
        split, size = self.split(texts), {}
        for w in chain.from_iterable(split):
            if w not in size:
                size[w] = len(self.known[w])
        return np.fromiter((sum(map(size.__getitem__, w)) for w in split), dtype=np.int64, count=len(split))


#: Characters of text handled at once; keeps a worker's memory bounded whatever the batch.
BLOCK_CHARS = 2_000_000


def _blocks(batch: pa.RecordBatch, text: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about BLOCK_CHARS bytes of text each."""
    sizes = np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0))
    block = np.cumsum(sizes) // BLOCK_CHARS
    at = 0
    while at < len(block):
        end = int(np.searchsorted(block, block[at], side="right"))
        yield batch.slice(at, end - at)
        at = end


def encode(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, ids array<int>)`` of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in _blocks(batch, 1):
                ids, sizes = encoder.encode(part.column(1).to_pylist())
                offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(pa.array(offsets), pa.array(ids))], names=[key, "ids"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, ids array<int>")


def lengths(docs: DataFrame, vocabulary: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``(key, n_tokens)`` of each row's text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(vocabulary)
        for batch in batches:
            for part in _blocks(batch, 1):
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(encoder.count(part.column(1).to_pylist()))], names=[key, "n_tokens"])

    rows = docs.select(key, text)
    return rows.mapInArrow(run, f"{key} {rows.schema[key].dataType.simpleString()}, n_tokens bigint")


_shipped: set[tuple[str, str]] = set()


def vocabulary(spark: SparkSession, name: str = "byte_bpe_50k.tiktoken") -> str:
    """The path of a vocabulary file, which the driver ships to the executors, so that they need no such folder."""
    path = os.path.join(spark.conf.get("spark.huntframe.tokenizers", VOCABULARIES), name)
    app = spark.sparkContext.applicationId
    if (app, path) not in _shipped and os.path.exists(path):
        spark.sparkContext.addFile(path)
        _shipped.add((app, path))
    return path

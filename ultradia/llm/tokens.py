"""Token ids of every text by a public byte-level BPE vocabulary.

Spark's regular expressions cut each text into words (the tokenizer's own pattern). In the tasks
the words of an Arrow batch are made distinct, and each distinct word is encoded once:

* speculate: greedy longest match proposes the tokens of the word
* verify: the proposal is the exact encoding if and only if every two adjacent tokens are
  compatible, that is, merging the bytes of the two alone gives these two again; the pairs of all
  new words are tested together against the pairs known so far
* only the words that fail a test are merged exactly

The ids are then spread over the words' places by array operations.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The pattern of the vocabulary, for Java: \s and the classes by Unicode.
PATTERN = r"(?U)'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
VOCABULARY = "byte_bpe_50k.tiktoken"
#: Words and pairs that a worker remembers; beyond, it forgets all and learns anew (the result is the same).
REMEMBERED = 400_000


def vocabulary_path(name: str = VOCABULARY) -> str:
    """Where the installed public vocabularies lie; any other path to a file of ranks will do."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """The vocabulary and what has been learned of it, in one worker."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.token = {i: t for t, i in self.rank.items()}
        self.longest = max(map(len, self.rank))
        self.size = max(self.token) + 1
        self.words: dict[str, list[int]] = {}
        self.fits: dict[int, bool] = {}
        self.proposed = self.merged = 0

    def merge(self, word: bytes) -> list[int]:
        """Exact byte-pair merging: always the adjacent pair of lowest rank, the leftmost first.

        Kept as a heap of candidate pairs over a linked list, so that one very long word costs
        n log n.
        """
        import heapq

        n = len(word)
        if n < 2:
            return [self.rank[word]] if n else []
        end, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := self.rank.get(word[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, stop = heapq.heappop(heap)
            if not alive[i] or end[i] >= n or not alive[end[i]] or end[end[i]] != stop:
                continue
            j = end[i]
            alive[j], end[i] = False, stop
            if stop < n:
                before[stop] = i
                if (r := self.rank.get(word[i : end[stop]])) is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            if (h := before[i]) >= 0 and (r := self.rank.get(word[h:stop])) is not None:
                heapq.heappush(heap, (r, h, stop))
        out, i = [], 0
        while i < n:
            out.append(self.rank[word[i : end[i]]])
            i = end[i]
        return out

    def propose(self, word: bytes) -> list[int]:
        """Greedy longest match from the left."""
        out, i, n, rank = [], 0, len(word), self.rank
        while i < n:
            for j in range(min(n, i + self.longest), i, -1):
                if (r := rank.get(word[i:j])) is not None:
                    out.append(r)
                    i = j
                    break
        return out

    def learn(self, words: list[str]) -> None:
        """Encode words not yet known."""
        if len(self.words) + len(words) > REMEMBERED:
            self.words.clear()
        if len(self.fits) > REMEMBERED:
            self.fits.clear()
        proposals = [self.propose(w.encode()) for w in words]
        lengths = np.fromiter(map(len, proposals), np.int64, len(proposals))
        flat = np.fromiter((t for p in proposals for t in p), np.int64, int(lengths.sum()))
        ok = np.ones(len(words), bool)
        if len(flat) > 1:
            owner = np.repeat(np.arange(len(words)), lengths)
            adjacent = owner[1:] == owner[:-1]
            pairs, place = np.unique((flat[:-1] * self.size + flat[1:])[adjacent], return_inverse=True)
            for p in pairs.tolist():
                if p not in self.fits:
                    a, b = divmod(p, self.size)
                    self.fits[p] = self.merge(self.token[a] + self.token[b]) == [a, b]
            fits = np.fromiter((self.fits[p] for p in pairs.tolist()), bool, len(pairs))
            ok[owner[1:][adjacent][~fits[place]]] = False
        self.proposed += len(words)
        for w, p, good in zip(words, proposals, ok.tolist()):
            if not good:
                self.merged += 1
            self.words[w] = p if good else self.merge(w.encode())

    def encode(self, words: pa.Array) -> pa.Array:
        """A list of ids for each list of words (null: the empty list)."""
        if isinstance(words, pa.ChunkedArray):
            words = words.combine_chunks()
        counts = pc.fill_null(pc.list_value_length(words), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        coded = words.flatten().dictionary_encode()
        distinct = coded.dictionary.to_pylist()
        new = [w for w in distinct if w not in self.words]
        if new:
            if len(self.words) + len(new) > REMEMBERED:
                self.words.clear()
                new = distinct
            self.learn(new)
        lists = [self.words[w] for w in distinct]
        lengths = np.fromiter(map(len, lists), np.int64, len(lists))
        flat = np.fromiter((t for x in lists for t in x), np.int32, int(lengths.sum()))
        starts = np.concatenate(([0], np.cumsum(lengths)))
        at = coded.indices.to_numpy(zero_copy_only=False)
        n = lengths[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        total = int(ends[-1]) if len(n) else 0
        ids = flat[np.arange(total) - np.repeat(ends - n, n) + np.repeat(starts[at], n)] if total else np.zeros(0, np.int32)
        bounds = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
        return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(ids, pa.int32()))


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_ids(df: DataFrame, key: str, text: str, path: str | None = None, only_count: bool = False) -> DataFrame:
    """key and ``ids`` (list of integers) of every row, or ``n_tokens`` with ``only_count``.

    Null and empty text: the empty list (0 tokens). Blanks are text. Rows are independent: repeated
    keys give repeated rows. No shuffle: each task encodes what it reads, in batches of Arrow;
    columns other than key and text are not read.
    """
    path = path or vocabulary_path()
    words = F.expr(f"regexp_extract_all(`{text}`, r\"{PATTERN}\", 0)")
    rows = df.select(F.col(key), words.alias("words"))
    name = "n_tokens" if only_count else "ids"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for b in batches:
            ids = enc.encode(b.column(1))
            out = pc.list_value_length(ids).cast(pa.int64()) if only_count else ids
            yield pa.RecordBatch.from_arrays([b.column(0), out], names=[key, name])

    kind = df.schema[key].dataType.simpleString()
    return rows.mapInArrow(run, f"`{key}` {kind}, {name} {'bigint' if only_count else 'array<int>'}")

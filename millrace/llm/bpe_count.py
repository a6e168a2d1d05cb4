"""Operator 2: token counts by byte-pair merging with a heap and a linked list.

A text is cut by the tokenizer's pattern; each piece starts as its bytes and the pair of
lowest rank is merged until none is left. The count is the number of bytes less the
number of merges, so no token identifier is ever built. Each task reads the merge ranks
once and keeps a bounded table of pieces that it has counted.

Defined results: a null text counts as empty (0 bytes, 0 tokens); an empty table gives an
empty result; repeated rows and null ids are kept as they are; other columns are ignored.
"""

from __future__ import annotations

import functools
import heapq
import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

#: Pieces that a task remembers; at about 150 bytes each they stay under 150 MB.
REMEMBERED = 1_000_000
#: Longer pieces are counted each time, so that what is remembered stays small.
LONGEST_REMEMBERED = 64


class MergeRanks:
    """Merge ranks of a byte-level tokenizer file; a pair of symbols is one integer."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        vocab = spec["model"]["vocab"]
        shown = _shown_bytes()
        self.first = [vocab[shown[b]] for b in range(256)]
        self.ranks: dict[int, tuple[int, int]] = {}
        for rank, pair in enumerate(spec["model"]["merges"]):
            left, right = pair if isinstance(pair, list) else pair.split(" ")
            self.ranks[vocab[left] << 20 | vocab[right]] = rank, vocab[left + right]
        self.start = {(a, b): self.ranks[pair][0] for a in range(256) for b in range(256) if (pair := self.first[a] << 20 | self.first[b]) in self.ranks}
        import public_tokenizers

        self.piece = regex.compile(public_tokenizers.PATTERN)
        special = [t["content"] for t in spec.get("added_tokens", [])]
        self.special = regex.compile("|".join(map(regex.escape, sorted(special, key=len, reverse=True)))) if special else None

    def count_piece(self, raw: bytes) -> int:
        """Symbols left of one piece when no adjacent pair has a rank.

        A heap entry is rank * n + position; ``symbol`` holds -1 where a symbol has gone
        into its left neighbour, and ``after`` and ``before`` link those that are left.
        """
        n = len(raw)
        if n < 2:
            return n
        of, start = self.ranks.get, self.start
        heap = [rank * n + i for i, pair in enumerate(zip(raw, raw[1:])) if (rank := start.get(pair)) is not None]
        if not heap:
            return n
        heapq.heapify(heap)
        pop, push = heapq.heappop, heapq.heappush
        symbol = [*map(self.first.__getitem__, raw), -1]
        after, before = [*range(1, n + 1), n], [*range(-1, n)]
        left = n
        while heap:
            rank, i = divmod(pop(heap), n)
            j = after[i]
            found = of(symbol[i] << 20 | symbol[j])
            if found is None or found[0] != rank:  # one of the pair has gone or changed since it was pushed
                continue
            new = symbol[i] = found[1]
            symbol[j] = -1
            after[i] = k = after[j]
            left -= 1
            if k < n:
                before[k] = i
                pair = of(new << 20 | symbol[k])
                if pair is not None:
                    push(heap, pair[0] * n + i)
            h = before[i]
            if h >= 0:
                pair = of(symbol[h] << 20 | new)
                if pair is not None:
                    push(heap, pair[0] * n + h)
        return left


@functools.lru_cache(maxsize=1)
def _shown_bytes() -> list[str]:
    """The letter by which byte-level vocabularies show each byte: printable bytes stand
    for themselves, the others take the letters from 256 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    shown, extra = [], 256
    for b in range(256):
        if b in printable:
            shown.append(chr(b))
        else:
            shown.append(chr(extra))
            extra += 1
    return shown


class _Known(dict):
    """Counts of pieces seen; a miss is counted and, if short, kept."""

    def __init__(self, ranks: MergeRanks, remembered: int):
        self.ranks, self.remembered = ranks, remembered

    def __missing__(self, piece: str) -> int:
        n = self.ranks.count_piece(piece.encode("utf-8"))
        if len(piece) <= LONGEST_REMEMBERED:
            if len(self) >= self.remembered:
                self.clear()
            self[piece] = n
        return n


class TokenCounter:
    def __init__(self, path: str, remembered: int = REMEMBERED):
        self.ranks = MergeRanks(path)
        self.known = _Known(self.ranks, remembered)

    def __call__(self, text: str) -> int:
        special, total = self.ranks.special, 0
        if special is None or not special.search(text):
            return self._plain(text)
        at = 0
        for m in special.finditer(text):
            total += self._plain(text[at : m.start()]) + 1
            at = m.end()
        return total + self._plain(text[at:])

    def _plain(self, text: str) -> int:
        return sum(map(self.known.__getitem__, self.ranks.piece.findall(text)))


@functools.lru_cache(maxsize=2)
def _counter(path: str) -> TokenCounter:
    """One counter for each Python worker; it outlives a task."""
    return TokenCounter(path)


def count_tokens(docs: DataFrame, tokenizer: str = "byte_bpe_50k.json", limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (more than ``limit`` tokens) of each row.

    ``tokenizer`` is a file name known to ``public_tokenizers`` on the executors, or a path.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        import public_tokenizers

        counter = _counter(tokenizer if os.path.isabs(tokenizer) else public_tokenizers.path(tokenizer))
        for batch in batches:
            texts = batch.column(1)
            sizes = [0 if n is None else n for n in pa.compute.binary_length(texts).to_pylist()]
            tokens = [counter(t.as_py()) if t.is_valid else 0 for t in texts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(sizes, pa.int64()), pa.array(tokens, pa.int64()), pa.array([n > limit for n in tokens], pa.bool_())],
                names=["doc_id", "n_bytes", "n_tokens", "over_limit"],
            )

    import pyarrow.compute  # noqa: F401

    return docs.select("doc_id", "text").mapInArrow(count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean")

"""Operator 9: language by rank-order profiles of frequent letter n-grams.

A profile is the list of the most frequent n-grams (one to three letters, with word
borders) of all training texts of a language. A document is compared with each profile by
the out-of-place distance: the sum over its own most frequent n-grams of how far their
ranks differ, or the profile's length where the profile lacks one. The smallest distance
wins; ties go to the smaller language name.

Defined results: a null text, or one without a letter, is ``und`` with score 0; so is any
text if nothing was learned. Rows whose lang is null teach nothing. Repeated rows count
as often as they occur. An empty table gives an empty result. Other columns are ignored.
The score is d2 / (d1 + d2) of the best and second distance (1 - d1 / largest possible if
only one language is known). The profiles sent to tasks hold ``size`` n-grams a language,
however large the input is.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import held_out, slices, utf8

PROFILE_SIZE = 300
#: Counts that a training task holds before it passes them on.
HELD_COUNTS = 2_000_000


@functools.lru_cache(maxsize=1)
def _folded() -> np.ndarray:
    """For each code point its lower-case letter, or 0 where it is no letter."""
    out = np.zeros(0x110000, np.int64)
    for point in range(0x110000):
        letter = chr(point)
        if letter.isalpha():
            low = letter.lower()
            out[point] = ord(low) if len(low) == 1 else point
    return out


def _letters(raw: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Folded letters of a slice of texts, and where each text starts among them."""
    starts_char = (raw & 0xC0) != 0x80
    at = np.concatenate([[0], np.cumsum(starts_char)])[offsets]
    points = np.frombuffer(raw.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    return _folded()[points], at


def _ngrams(letters: np.ndarray) -> np.ndarray:
    """Codes of all n-grams of one to three symbols, 21 bits each; a border, which no letter
    has the code of, may only stand at an end."""
    if not letters.any():
        return np.zeros(0, np.int64)
    x = np.concatenate([[0], letters, [0]])
    letter, x = x > 0, np.maximum(x, 1)
    two, three = x[:-1] << 21 | x[1:], x[:-2] << 42 | x[1:-1] << 21 | x[2:]
    return np.concatenate([x[letter], two[letter[:-1] | letter[1:]], three[letter[1:-1]]])


def _merge(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    codes, where = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
    return codes, np.bincount(where, np.concatenate([p[1] for p in parts]), len(codes)).astype(np.int64)


def _count_ngrams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    n = 0

    def passed() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            codes, counts = _merge(parts)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(codes), pa.string()), pa.array(codes), pa.array(counts)], names=["lang", "code", "n"])
        held.clear()

    for batch in batches:
        langs = batch.column(1).to_pylist()
        raw, offsets = utf8(batch.column(0))
        for start, end in slices(offsets):
            letters, at = _letters(raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
            for lang in sorted(set(langs[start:end])):
                rows = [i for i in range(end - start) if langs[start + i] == lang]
                codes = _ngrams(np.concatenate([x for i in rows for x in (letters[at[i] : at[i + 1]], [0])]).astype(np.int64))
                part = np.unique(codes, return_counts=True)
                held.setdefault(lang, []).append(part)
                n += len(part[0])
            if n > HELD_COUNTS:
                for lang in held:
                    held[lang] = [_merge(held[lang])]
                n = sum(len(parts[0][0]) for parts in held.values())
                if n > HELD_COUNTS // 2:
                    yield from passed()
                    n = 0
    yield from passed()


def learn_profiles(docs: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """lang, code, rank (from 0): the ``size`` most frequent n-grams of each language."""
    counted = (
        docs.filter(F.col("text").isNotNull() & F.col("lang").isNotNull())
        .select("text", "lang")
        .mapInArrow(_count_ngrams, "lang string, code long, n long")
        .groupBy("lang", "code")
        .agg(F.sum("n").alias("n"))
    )
    ranked = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    return counted.withColumn("rank", ranked - 1).filter(F.col("rank") < size).select("lang", "code", "rank")


class Profiles:
    """The learned profiles as one sorted list of codes and a rank for each language."""

    def __init__(self, rows: list[tuple[str, int, int]], size: int):
        self.size, self.langs = size, sorted({r[0] for r in rows})
        self.codes = np.unique(np.array([r[1] for r in rows], np.int64))
        self.ranks = np.full((len(self.langs), len(self.codes) + 1), -1, np.int64)
        place = {lang: i for i, lang in enumerate(self.langs)}
        for lang, code, rank in rows:
            self.ranks[place[lang], np.searchsorted(self.codes, code)] = rank

    def predict(self, letters: np.ndarray) -> tuple[str, float]:
        codes, counts = np.unique(_ngrams(letters), return_counts=True)
        if not len(codes) or not self.langs:
            return "und", 0.0
        top = codes[np.lexsort((codes, -counts))[: self.size]]
        where = np.searchsorted(self.codes, top)
        where[(where < len(self.codes)) & (self.codes[np.minimum(where, len(self.codes) - 1)] != top)] = len(self.codes)
        ranks = self.ranks[:, where]
        away = np.where(ranks < 0, self.size, np.abs(ranks - np.arange(len(top)))).sum(axis=1)
        order = np.argsort(away, kind="stable")
        best = float(away[order[0]])
        if len(order) == 1:
            return self.langs[0], 1.0 - best / (self.size * len(top))
        second = float(away[order[1]])
        return self.langs[order[0]], second / (best + second) if second else 0.5


def predict(docs: DataFrame, profiles: list[tuple[str, int, int]], size: int = PROFILE_SIZE, held: Column | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred and score of each row."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Profiles(profiles, size)
        for batch in batches:
            raw, offsets = utf8(batch.column(2))
            found = []
            for start, end in slices(offsets):
                letters, at = _letters(raw[offsets[start] : offsets[end]], offsets[start : end + 1] - offsets[start])
                found += [model.predict(letters[at[i] : at[i + 1]]) for i in range(end - start)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())],
                names=["doc_id", "held_out", "lang_pred", "score"],
            )

    held = held_out() if held is None else held
    return docs.select("doc_id", held.alias("held_out"), "text").mapInArrow(score, "doc_id long, held_out boolean, lang_pred string, score double")


def identify(docs: DataFrame, size: int = PROFILE_SIZE) -> DataFrame:
    """Learns from all rows that are not held out, then predicts every row."""
    learned = learn_profiles(docs.filter(~held_out()), size)
    return predict(docs, [tuple(r) for r in learned.collect()], size)

"""Periodic runs of words by seed and extend along diagonals.

A run is a maximal stretch of words with smallest period q that is at least ``times`` periods and ``least`` words long, so
its words match those q further on over max(least, times * q) - q places at least: the guaranteed overlap. Lags are taken
in classes [2**j, 2**(j + 1)). All grams as long as the least overlap guaranteed at these or larger lags are named exactly, by pairing the names of
shorter grams, and each occurrence is paired with the next one of the same document. Grams are at least as long as any
lag of their class (which needs three periods or more), so inside a run the next occurrence is exactly one period away: a
seed for every run, none at a multiple of its period, and at most as many as there are words. Seeds are extended both
ways along their diagonal; a table with the furthest place covered at each lag suppresses the seeds of a stretch that
was extended already.

Documents need no shuffle. Those of a batch are named together, some ten thousands of words at a time; a document leaves
the classes once no gram recurs in it, or when it is too short. Memory is linear in the longest document.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Words named together, unless one document alone has more.
WORDS_AT_ONCE = 200_000
WORD = re.compile("[^\x20\x09-\x0d]+")
RUN = ("start", "length", "period")


def _paired(left: np.ndarray, shift: int) -> np.ndarray:
    """A number for each pair of the name at a place and the one ``shift`` further on; equal for equal pairs only."""
    right = np.zeros_like(left)
    right[: max(len(left) - shift, 0)] = left[shift:] + 1
    return pd.factorize(left * (int(left.max()) + 2) + right)[0]


def _matching(codes: np.ndarray, at: int, lag: int, way: int) -> int:
    """How many places from ``at`` on (or before it, with ``way`` -1) hold the same as ``lag`` further on."""
    n, step, last = 0, 64, len(codes) - lag
    while True:
        a, b = (at + n, min(at + n + step, last)) if way > 0 else (max(at - n - step, 0), at - n)
        unlike = codes[a:b] != codes[a + lag : b + lag]
        if unlike.any():
            return n + int(np.argmax(unlike if way > 0 else unlike[::-1]))
        n += max(b - a, 0)
        if b - a < step:
            return n
        step *= 2


def find_runs(codes: np.ndarray, sizes: np.ndarray, least: int, times: int) -> list[tuple[int, int, int]]:
    """(place, length, period) of all runs in ``codes``: the words of documents of ``sizes`` words as numbers, with a number
    that occurs nowhere else behind each document."""
    found, furthest = [], {}
    name, level, lag = pd.factorize(codes)[0], 0, 1
    at, of = np.arange(len(codes)), np.repeat(np.arange(len(sizes)), sizes + 1)
    going = sizes >= least
    while True:
        going &= sizes >= max(least, times * lag)
        if not going.any():
            return found
        stay = going[of]
        if not stay.all():
            name, at, of = name[stay], at[stay], of[stay]
        gram = min(max(least, times * q) - q for q in (lag, least // times, -(-least // times)) if q >= lag)  # also of all larger lags
        while 2 << level <= gram:
            name, level = _paired(name, 1 << level), level + 1
        grams = _paired(name, gram - (1 << level))
        order = np.argsort(grams, kind="stable")
        a, b = order[:-1], order[1:]
        again = (grams[a] == grams[b]) & (of[a] == of[b])
        a, b = a[again], b[again]
        going = np.zeros(len(sizes), bool)
        going[of[a]] = True
        near = (b - a >= lag) & (b - a < 2 * lag)
        i, d = at[a[near]], (b - a)[near]
        order = np.lexsort((i, d))
        i, d = i[order], d[order]
        head = np.ones(len(i), bool)  # a seed right behind another of its lag lies in the same stretch
        head[1:] = (d[1:] != d[:-1]) | (i[1:] != i[:-1] + 1)
        for x, q in zip(i[head].tolist(), d[head].tolist()):
            if furthest.get(q, -1) > x:
                continue
            low, high = x - _matching(codes, x, q, -1), x + gram
            high += _matching(codes, high, q, 1)
            furthest[q] = high
            if high - low + q >= max(least, times * q):
                found.append((low, high - low + q, q))
        lag *= 2


def _scan(texts: list[str], least: int, times: int) -> Iterator[tuple[int, list[tuple[int, int, int]], str]]:
    """Of each text its number of words, its runs, and what is left of it."""
    words = [WORD.findall(x) for x in texts]
    sizes = np.array([len(w) for w in words], np.int64)
    codes = np.empty(int(sizes.sum()) + len(words), np.int64)
    ends = np.cumsum(sizes + 1) - 1
    inner = np.ones(len(codes), bool)
    inner[ends] = False
    flat = np.empty(int(sizes.sum()), object)
    flat[:] = [x for w in words for x in w]
    codes[inner], codes[ends] = pd.factorize(flat)[0], -1 - np.arange(len(words))
    runs: list[list[tuple[int, int, int]]] = [[] for _ in words]
    for place, length, period in find_runs(codes, sizes, least, times):
        k = int(np.searchsorted(ends, place))
        runs[k].append((place - int(ends[k] - sizes[k]), length, period))
    for w, mine in zip(words, runs):
        mine.sort(key=lambda r: (r[0], r[2]))
        if mine:
            edges = np.zeros(len(w) + 1, np.int64)
            for start, length, period in mine:
                edges[start + period] += 1
                edges[start + length] -= 1
            gone = np.cumsum(edges[:-1]) > 0
            yield len(w), mine, " ".join([x for x, g in zip(w, gone.tolist()) if not g])
        else:
            yield len(w), mine, " ".join(w)


def periodic_runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least: int = 6, times: int = 4) -> DataFrame:
    """One row per document: ``doc_id, n_words, runs, collapsed``.

    ``runs`` holds (start, length, period) of every run, in words from 0, by start and then period. ``collapsed`` is the
    text without the words that lie in a run behind its first period, joined by single spaces. Words are what white
    space (space, tab to carriage return) parts. Null and empty texts have no words; null ids and repeated rows stay
    rows; an empty table gives none. Other columns aren't read. ``times`` is 3 or more.
    """
    if times < 3:
        raise ValueError("a run has three periods at least")
    run = T.StructType([T.StructField(n, T.LongType()) for n in RUN])
    schema = T.StructType([T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_words", T.LongType()), T.StructField("runs", T.ArrayType(run)), T.StructField("collapsed", T.StringType())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(schema)

        def made(ids: list, texts: list[str]) -> pa.RecordBatch:
            out = list(_scan(texts, least, times))
            flat = [r for _, runs, _ in out for r in runs]
            fields = [pa.array([r[k] for r in flat], pa.int64()) for k in range(3)]
            offsets = np.concatenate([[0], np.cumsum([len(runs) for _, runs, _ in out])]).astype(np.int32)
            runs = pa.ListArray.from_arrays(pa.array(offsets), pa.StructArray.from_arrays(fields, RUN))
            columns = [pa.array(ids, arrow.field(0).type), pa.array([n for n, _, _ in out], pa.int64()), runs, pa.array([c for _, _, c in out], pa.string())]
            return pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

        for batch in batches:
            ids, texts, size = [], [], 0
            for k in range(batch.num_rows):
                ids.append(batch.column(0)[k].as_py())
                texts.append(batch.column(1)[k].as_py() or "")
                size += len(texts[-1]) // 6 + 1
                if size >= WORDS_AT_ONCE:
                    yield made(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield made(ids, texts)

    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(scan, schema)

"""Repeated lines, found by range-partitioned hashes and given back as a bitmap for each document.

Each line's key (the line without white space at its ends, A to Z lower-cased) becomes a 128-bit hash. Hashes with the
document's number and the line's place are dealt out by range and sorted in each partition, by hash, then document, then
place. A partition then is a stream in which a line's occurrences stand together, the first one first, and a line is
decided as soon as it has been seen in enough documents: only occurrences of undecided lines are held, those of fewer
documents than the threshold. Dropped places come together by document as bits of 64-line words, and only these narrow
rows are shuffled; texts meet them once, by document, where the kept text is wanted.

A line that is a large share of all would make one long stream. Such keys are found by a sketch of frequent items, which
is merged from all tasks and bounded; their occurrences are counted by a pre-aggregated grouping and decided by a
broadcast of at most HEAVY_MOST rows. Which keys go this way changes no result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import HEAVY_LEAST, HEAVY_SHARE, ascii_lower, cut, free_name, shuffle_partitions, text_or_empty

HEAVY_MOST = 1000
BLANKS = " \t\n\x0b\x0c\r"


def line_key(line: Column) -> Column:
    """A line without spaces, tabs, vertical tabs, form feeds and carriage returns at its ends, A to Z lower-cased."""
    return ascii_lower(F.btrim(line, F.lit(BLANKS)))


def _lines(text: Column) -> Column:
    return F.split(text, "\n", -1)


def hashed_lines(docs: DataFrame, id_col: str, text_col: str, least_chars: int) -> DataFrame:
    """(rid, doc_id, text, keys), written once: ``keys`` has a struct of two hashes for each line, null if it is too short."""

    def key(line: Column) -> Column:
        # the key is bound once, as a lambda's variable
        one = F.transform(F.array(line_key(line)), lambda k: F.when(F.length(k) >= least_chars, F.struct(F.xxhash64(k).alias("h"), F.xxhash64(F.lit(1), k).alias("g"))))
        return F.element_at(one, 1)

    rows = docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    return cut(rows.select(F.monotonically_increasing_id().alias("rid"), "doc_id", "text", F.transform(_lines(F.col("text")), key).alias("keys")), "lines")


@dataclass
class Stream:
    """Decides the lines of one sorted partition. What is held over to the next batch is one line's state."""

    least_docs: int
    keep_first: bool
    key: tuple | None = None
    docs: int = 0
    last: int | None = None
    held: list[np.ndarray] = field(default_factory=list)

    def take(self, h: np.ndarray, g: np.ndarray, rid: np.ndarray, pos: np.ndarray) -> np.ndarray:
        """(rid, pos) of the lines that are decided to go, as two rows."""
        edge = np.ones(len(h), bool)
        edge[1:] = (h[1:] != h[:-1]) | (g[1:] != g[:-1])
        new = edge.copy()
        new[1:] |= rid[1:] != rid[:-1]
        same = self.key == (h[0], g[0])
        if same:
            new[0] = rid[0] != self.last
        starts = np.flatnonzero(edge)
        run = np.cumsum(edge) - 1
        docs = np.add.reduceat(new.astype(np.int64), starts)
        before = self.docs if same else 0
        docs[0] += before
        gone = (docs >= self.least_docs)[run]
        places = np.stack([rid, pos])
        spare = edge & ~(np.arange(len(h)) == 0) if same else edge  # the first occurrences
        take = gone & ~spare if self.keep_first else gone
        out = [places[:, take]]
        if same and docs[0] >= self.least_docs:
            out = [*self.held, *out]
        if not same or len(starts) > 1 or docs[0] >= self.least_docs:
            self.held = []
        if docs[-1] < self.least_docs:
            last = run == run[-1]
            self.held.append(places[:, last & ~spare if self.keep_first else last])
        self.key, self.docs, self.last = (h[-1], g[-1]), int(docs[-1]), rid[-1]
        return np.concatenate(out, 1)


def dropped_lines(lines: DataFrame, least_docs: int, keep_first: bool) -> DataFrame:
    """(rid, pos) of the lines to drop, from (h, g, rid, pos)."""
    items = F.expr(f"approx_top_k(h, {HEAVY_MOST}, {10 * HEAVY_MOST})")
    found = lines.agg(F.count("*").alias("n"), items.alias("top")).select("n", F.explode_outer("top").alias("t"))
    share = F.greatest(F.lit(HEAVY_LEAST), F.col("n") / HEAVY_SHARE)
    heavy = cut(found.where(F.col("t.count") >= share).select(F.col("t.item").alias("h")), "heavy-lines")
    some = not heavy.isEmpty()

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        state = Stream(least_docs, keep_first)
        for batch in batches:
            if batch.num_rows:
                rid, pos = state.take(*[c.to_numpy() for c in batch.columns])
                yield pa.RecordBatch.from_arrays([pa.array(rid), pa.array(pos)], ["rid", "pos"])

    key = ["h", "g", "rid", "pos"]
    light = lines.join(F.broadcast(heavy), "h", "left_anti") if some else lines
    dealt = light.select(*key).repartitionByRange(shuffle_partitions(lines.sparkSession), *key[:2]).sortWithinPartitions(*key)
    out = dealt.mapInArrow(stream, "rid long, pos long")
    if not some:
        return out
    hot = lines.join(F.broadcast(heavy), "h")
    by_doc = hot.groupBy("h", "g", "rid").agg(F.min("pos").alias("pos"))
    often = by_doc.groupBy("h", "g").agg(F.count("*").alias("docs"), F.min(F.struct("rid", "pos")).alias("first")).where(F.col("docs") >= least_docs)
    # as many rows as there are heavy hashes, but for collisions of one half of the hash
    gone = hot.join(F.broadcast(cut(often, "often")), ["h", "g"])
    if keep_first:
        gone = gone.where((F.col("rid") != F.col("first.rid")) | (F.col("pos") != F.col("first.pos")))
    return out.unionByName(gone.select("rid", "pos"))


def keep_bitmaps(dropped: DataFrame) -> DataFrame:
    """(rid, n_dropped, keep): ``keep`` is a sparse bitmap of the lines that stay, for each document that loses any.

    For every 64 lines of which one goes it has 4 bytes with their number and 8 bytes of bits, lowest bit first; words
    that aren't there stay whole. All in network byte order.
    """
    word, bit = F.expr("cast(pos div 64 as int)"), F.expr("shiftleft(1L, cast(pos % 64 as int))")
    words = dropped.groupBy("rid", word.alias("word")).agg(F.bit_or(bit).alias("bits"))
    text = F.transform(F.sort_array(F.collect_list(F.struct("word", "bits"))), lambda w: F.concat(F.lpad(F.hex(w["word"]), 8, "0"), F.lpad(F.hex(F.bitwise_not(w["bits"])), 16, "0")))
    return words.groupBy("rid").agg(F.sum(F.bit_count("bits")).cast("long").alias("n_dropped"), F.unhex(F.array_join(text, "")).alias("keep"))


def line_bitmaps(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> tuple[DataFrame, DataFrame]:
    """(numbered documents, bitmaps): ``rid, doc_id, text, keys`` and ``rid, n_dropped, keep`` of those that lose lines.

    A line goes if its key has ``least_chars`` code points or more and occurs in ``least_docs`` documents or more; with
    ``keep_first`` its first occurrence, by number of the document and place, stays. Repeated rows are documents of
    their own. Null text is one empty line; null ids stay; an empty table gives two empty ones.
    """
    rows = hashed_lines(docs, id_col, text_col, least_chars)
    lines = rows.select("rid", F.posexplode("keys").alias("pos", "key")).where("key is not null").select("key.h", "key.g", "rid", F.col("pos").cast("long").alias("pos"))
    return rows, keep_bitmaps(dropped_lines(lines, least_docs, keep_first))


def kept_text(text: pd.Series, keep: pd.Series) -> pd.Series:
    """The lines whose bits are set, joined again; null without a bitmap."""

    def one(t: str, b: bytes) -> str:
        words = np.frombuffer(b, np.dtype([("word", ">u4"), ("keep", "V8")]))
        lines = t.split("\n")
        at = np.unpackbits(np.frombuffer(words["keep"].tobytes(), np.uint8).reshape(-1, 8)[:, ::-1].copy(), axis=1, bitorder="little")
        gone = (words["word"].astype(np.int64)[:, None] * 64 + np.arange(64))[at == 0]
        stay = np.ones(len(lines), bool)
        stay[gone] = False
        return "\n".join([x for x, s in zip(lines, stay.tolist()) if s])

    return pd.Series([None if b is None else one(t, b) for t, b in zip(text, keep)], dtype=object)


def drop_repeated_lines(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_docs: int = 10, least_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """One row per document: ``rid, doc_id, n_lines, n_dropped, text``, the text without the lines that ``line_bitmaps`` drops.

    Texts are shuffled once, and only those that lose lines go through Python.
    """
    rows, bitmaps = line_bitmaps(docs, id_col, text_col, least_docs, least_chars, keep_first)
    both = rows.withColumn("n_lines", F.size("keys").cast("long")).drop("keys").join(bitmaps, "rid", "left")
    less = F.pandas_udf(kept_text, "string")(F.when(F.col("keep").isNotNull(), F.col("text")), F.col("keep"))
    return both.select("rid", "doc_id", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), F.coalesce(less, "text").alias("text"))

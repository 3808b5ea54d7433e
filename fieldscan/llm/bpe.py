"""Byte-level BPE encoding and decoding, with long texts encoded in parts by tree concatenation.

A text longer than ``leaf_chars`` becomes leaves that any tasks encode in parallel. Two neighbours are joined by
encoding a small window around the join anew, growing it until its first and last tokens are those that both sides have
there. Every pair of neighbouring tokens of the result then stands in one of three valid encodings, which makes the
whole valid; pairs of leaves, then of pairs, are joined up to the whole text. Texts without any place where the
tokenizer splits are joined in the same way.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import text_or_empty

LEAF_CHARS = 16_384
#: Tokens on each side of a join that the first window has.
FIRST_WINDOW = 8
ROWS_PER_BATCH = 400

_coders: dict[int, Coder] = {}


class Coder:
    """Encoder and decoder for one vocabulary of byte sequences, with special strings that are one token each."""

    def __init__(self, vocabulary: bytes, pattern: str, special: dict[str, int]):
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, vocabulary.splitlines())}
        self.coding = tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens=special)
        self.token_bytes = {v: k for k, v in ranks.items()} | {v: k.encode() for k, v in special.items()}
        self.allowed = set(special)
        self.widest = max((len(s.encode()) for s in special), default=0)

    @staticmethod
    def shared(vocabulary: bytes, pattern: str, special: dict[str, int]) -> Coder:
        key = hash((vocabulary, pattern, *special.items()))
        if key not in _coders:
            _coders[key] = Coder(vocabulary, pattern, special)
        return _coders[key]

    def encode(self, text: str) -> np.ndarray:
        return self.coding.encode_to_numpy(text, allowed_special=self.allowed).astype(np.int32)

    def decode(self, ids: np.ndarray) -> str:
        return self.coding.decode_bytes(ids.tolist()).decode("utf-8", errors="replace")

    def _edges(self, left: np.ndarray, right: np.ndarray, w: int) -> tuple[int, int, str]:
        """Window of w tokens or more on each side that covers a special string over the join and reads as text."""
        get = self.token_bytes
        i, head = len(left), b""
        while i > 0 and (len(left) - i < w or len(head) < self.widest or head[0] & 0xC0 == 0x80 or head[:1] == b"'"):
            i -= 1
            head = get[int(left[i])] + head
        j, tail = 0, b""
        while j < len(right):
            if j >= w and len(tail) >= self.widest:
                follows = get[int(right[j])]
                last = tail.decode("utf-8", errors="ignore")[-1:]
                # an apostrophe may begin a contraction with what follows; white space may lose its last character to it
                if follows[0] & 0xC0 != 0x80 and b"'" not in tail[-3:] and not (last.isspace() and not follows[:1].isspace()):
                    break
            tail += get[int(right[j])]
            j += 1
        return i, j, (head + tail).decode("utf-8")

    def join(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The encoding of two texts put together, from the encodings of both."""
        if not len(left) or not len(right):
            return np.concatenate([left, right])
        w = FIRST_WINDOW
        while True:
            i, j, text = self._edges(left, right, w)
            mid = self.encode(text)
            starts = i == 0 or len(mid) >= 4 and np.array_equal(mid[:2], left[i : i + 2])
            ends = j == len(right) or len(mid) >= 4 and np.array_equal(mid[-2:], right[j - 2 : j])
            if starts and ends:
                return np.concatenate([left[:i], mid, right[j:]])
            w *= 2

    def join_all(self, parts: list[np.ndarray]) -> np.ndarray:
        while len(parts) > 1:
            parts = [self.join(*parts[k : k + 2]) if k + 1 < len(parts) else parts[k] for k in range(0, len(parts), 2)]
        return parts[0]


def _table(columns: dict[str, pa.Array], ids: list[np.ndarray], texts: list[str] | None, schema: pa.Schema) -> pa.RecordBatch:
    columns["n_tokens"] = pa.array([len(x) for x in ids], pa.int64())
    if "ids" in schema.names:
        offsets = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
        columns["ids"] = pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*ids, np.empty(0, np.int32)])))
    if "decoded" in schema.names:
        columns["decoded"] = pa.array(texts, pa.string())
    return pa.RecordBatch.from_arrays([columns[n].cast(schema.field(n).type) for n in schema.names], names=schema.names)


def encode(
    docs: DataFrame,
    vocabulary_path: str,
    pattern: str,
    special: dict[str, int],
    id_col: str = "doc_id",
    text_col: str = "text",
    leaf_chars: int = LEAF_CHARS,
    ids: bool = True,
    decoded: bool = True,
) -> DataFrame:
    """One row per document: ``doc_id, n_tokens`` and, if asked for, ``ids`` (array of int) and ``decoded`` (text).

    ``vocabulary_path`` names a file of base64 byte sequences and ranks on the driver, of fixed size, which is broadcast.
    Null text counts as empty and has no tokens; null ids and repeated rows are kept; an empty table gives no rows.
    """
    from pyspark.sql.pandas.types import to_arrow_schema

    with open(vocabulary_path, "rb") as f:
        vocabulary = docs.sparkSession.sparkContext.broadcast(f.read())
    fields = [T.StructField("doc_id", docs.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())]
    fields += [T.StructField("ids", T.ArrayType(T.IntegerType(), False))] * ids + [T.StructField("decoded", T.StringType())] * decoded
    out, part = T.StructType(fields), T.StructType(
        [T.StructField("rid", T.LongType()), fields[0], T.StructField("leaf", T.IntegerType()), fields[1], T.StructField("ids", T.ArrayType(T.IntegerType(), False))]
    )
    out_arrow, part_arrow = to_arrow_schema(out), to_arrow_schema(part)

    def coder() -> Coder:
        return Coder.shared(vocabulary.value, pattern, special)

    def leaves(schema: pa.Schema):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            code = coder()
            for whole in batches:
                for at in range(0, whole.num_rows, ROWS_PER_BATCH):
                    batch = whole.slice(at, ROWS_PER_BATCH)
                    coded = [code.encode(x) for x in batch.column("text").to_pylist()]
                    texts = [code.decode(x) for x in coded] if "decoded" in schema.names else None
                    kept = {n: batch.column(n) for n in batch.schema.names if n != "text"}
                    yield _table(kept, coded, texts, schema)

        return run

    def joined(group: pa.Table) -> pa.Table:
        group = group.sort_by("leaf")
        lists = group.column("ids").combine_chunks()
        flat, cuts = lists.values.to_numpy(zero_copy_only=False), lists.offsets.to_numpy()
        code = coder()
        whole = code.join_all([flat[a:b] for a, b in zip(cuts, cuts[1:])])
        made = _table({"doc_id": group.column("doc_id").combine_chunks()[:1]}, [whole], [code.decode(whole)] if decoded else None, out_arrow)
        return pa.Table.from_batches([made])

    text = text_or_empty(F.col(text_col))
    rows = docs.select(F.col(id_col).alias("doc_id"), text.alias("text"))
    short = rows.where(F.length("text") <= leaf_chars).mapInArrow(leaves(out_arrow), out)
    size = f"cast(ceil(length(text) / {leaf_chars}D) as int)"
    cuts = F.expr(f"transform(sequence(0, {size} - 1), i -> substring(text, i * {leaf_chars} + 1, {leaf_chars}))")
    long = (
        rows.withColumn("rid", F.monotonically_increasing_id())
        .where(F.length("text") > leaf_chars)
        .select("rid", "doc_id", F.posexplode(cuts).alias("leaf", "text"))
        .mapInArrow(leaves(part_arrow), part)
        .groupBy("rid")
        .applyInArrow(joined, out)
    )
    return short.unionByName(long)


def decode(coded: DataFrame, vocabulary_path: str, pattern: str, special: dict[str, int], ids_col: str = "ids") -> DataFrame:
    """``coded`` with a column ``decoded``: the text of its ids. Null ids give null; no ids give the empty text."""
    with open(vocabulary_path, "rb") as f:
        vocabulary = coded.sparkSession.sparkContext.broadcast(f.read())

    @F.pandas_udf("string")
    def text_of(ids):
        code = Coder.shared(vocabulary.value, pattern, special)
        return ids.map(lambda x: None if x is None else code.decode(np.asarray(x, np.int32)))

    return coded.withColumn("decoded", text_of(F.col(ids_col)))


def digest(ids: Column) -> Column:
    """SHA-256 of decimal ids joined by commas, as lower-case hex."""
    return F.sha2(F.array_join(ids.cast("array<string>"), ","), 256)

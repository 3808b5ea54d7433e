"""Near-duplicates by Order MinHash over five-word shingles, verified by banded alignment.

A shingle is labelled with its occurrence in the text, so repeats count. Each of ``BANDS`` sketches samples the two
shingles with the least hash values and keeps them in text order; two texts agree in a sketch if they share both in the
same order, which edits disturb and shuffled content doesn't survive. Documents that agree in a sketch and are of
similar size meet in a bucket, and again in a finer bucket if they agree in two sketches.

Verification aligns the two shingle sequences inside the band that a similarity of ``SIMILARITY`` leaves: with m aligned
shingles of n and k, the similarity is m / (n + k - m). It is at most the Jaccard similarity of the labelled shingles.

Texts of equal words are one node. Pairs that are likely to be similar are verified first and only where they may join
two components: the sketches are sorted once for each band, by its key and the next ones, so a node stands beside those
that agree with it in most, and these are its pairs, linear in the nodes whatever the size of a bucket. Of them, the one
that agrees in most sketches comes first.

Buckets that still hold several components are then compared exactly. Of two similar texts, each has one of the other's
shingles among its own rarest ones (a prefix filter), and what the places of the shared ones leave bounds the whole
overlap; a text whose rare shingles are all its own has no partner left and leaves without a comparison. All pairs
between components that pass are verified, the one with the most in common first, until none is left; so no pair that
meets in a bucket is left out.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import FEW, cut, heavy_keys, join_heads, many, numbered, text_or_empty
from .components import components

WORDS = 5
SIMILARITY = 0.8
BANDS = 12
#: Texts that are looked at more closely are fetched by a broadcast of their keys up to this number, else by a shuffle.
BROADCAST_KEYS = 1_000_000
CHUNK_BYTES = 4_000_000
#: Sketches in which neighbours in the sorted order agree if they are verified before the exact step.
LIKELY = 3
#: Rounds, at most, in which some pairs between components are verified before all that are left are, and texts of a component in them.
SAMPLES, REPS = 3, 16
#: Pairs of one text that are verified in one task, about.
PAIRS_PER_TASK = 1000
_M = np.uint64(0x9E3779B97F4A7C15)
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)
_FACTORS = (np.random.default_rng(17).integers(0, 1 << 62, BANDS, dtype=np.uint64) << np.uint64(1)) | np.uint64(1)


def _mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def word_hashes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words (runs of letters and digits, lower-cased) of some texts, and where each text's begin and end."""
    import xxhash

    plain = pc.replace_substring_regex(pc.utf8_lower(texts), r"[^\pL\pN]+", " ")
    lists = pc.utf8_split_whitespace(pc.utf8_trim_whitespace(plain))
    coded = lists.flatten().dictionary_encode()
    known = np.array([xxhash.xxh3_64_intdigest(w) for w in coded.dictionary.to_pylist()], np.uint64)
    counts = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    flat = known[coded.indices.to_numpy(zero_copy_only=False)] if len(known) else np.empty(0, np.uint64)
    # the only "word" of a text without words is empty
    real = flat != xxhash.xxh3_64_intdigest("")
    ends = np.cumsum(counts)
    kept = np.concatenate([[0], np.cumsum(real)])
    return flat[real], np.concatenate([[0], kept[ends]]).astype(np.int64)


def shingles(words: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Plain and labelled shingle values of all texts, and where each text's begin; a short text is one shingle."""
    n = np.diff(cuts)
    size = np.where(n >= WORDS, n - WORDS + 1, (n > 0).astype(np.int64))
    starts = np.concatenate([[0], np.cumsum(size)])
    doc = np.repeat(np.arange(len(n)), size)
    first = np.arange(starts[-1]) - starts[doc] + cuts[doc]
    value = np.zeros(len(first), np.uint64)
    for k in range(WORDS):
        inside = first + k < cuts[doc + 1]
        word = words[np.minimum(first + k, len(words) - 1)] if len(words) else np.empty(0, np.uint64)
        value = value * _M + np.where(inside, word, np.uint64(k))
    value = _mix(value)
    key = value ^ _mix(doc.astype(np.uint64) + np.uint64(1))
    order = np.argsort(key, kind="stable")
    again = np.concatenate([[False], key[order][1:] == key[order][:-1]])
    labelled = value
    if again.any():
        run = np.arange(len(key))
        occurrence = np.empty(len(key), np.uint64)
        occurrence[order] = run - np.maximum.accumulate(np.where(again, 0, run))
        labelled = np.where(occurrence > 0, _mix(value + occurrence * _M), value)
    return value, labelled, starts


def sketches(labelled: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """BANDS keys for each text that has shingles."""
    size = np.diff(starts)
    size, at = size[size > 0], starts[:-1][size > 0]
    out = np.empty((len(at), BANDS), np.uint64)
    if not len(at):
        return out
    for band, factor in enumerate(_FACTORS):
        rank = labelled * factor
        places = []
        for _ in range(2):
            least = np.minimum.reduceat(rank, at)
            hit = np.flatnonzero(rank == np.repeat(least, size))
            # values are distinct in a text, but for ranks that are already taken, so the first place of each text is it
            owner = np.searchsorted(at, hit, side="right") - 1
            places.append(hit[np.concatenate([[True], owner[1:] != owner[:-1]])])
            rank[places[-1]] = _TOP
        a, b = np.minimum(*places), np.maximum(*places)
        out[:, band] = _mix(_mix(labelled[a] + np.uint64(band)) * _M + labelled[b])
    return out


def _longest_rise(x: np.ndarray) -> int:
    if len(x) < 2 or (x[1:] > x[:-1]).all():
        return len(x)
    tails: list[int] = []
    for v in x.tolist():
        k = bisect_left(tails, v)
        tails[k : k + 1] = [v]
    return len(tails)


def aligned(plain_a: np.ndarray, plain_b: np.ndarray, label_a: np.ndarray, label_b: np.ndarray, least: float) -> float:
    """The similarity m / (n + k - m) if it reaches ``least``, else something less.

    Places of one shingle in both texts that are further apart than the band can't be in an alignment that reaches it.
    """
    n, k = len(label_a), len(label_b)
    if not n or not k or min(n, k) < least * max(n, k):
        return 0.0
    need = int(np.ceil(least * (n + k) / (1 + least) - 1e-9))
    band = max(n, k) - need
    _, at_a, at_b = np.intersect1d(label_a, label_b, assume_unique=True, return_indices=True)
    if len(at_a) < need:
        return 0.0
    keep = np.abs(at_a - at_b) <= band
    at_a, at_b = at_a[keep], at_b[keep]
    m = _longest_rise(at_b[np.argsort(at_a)])
    if m < need and len(np.unique(label_a)) and (len(np.unique(plain_a)) < n or len(np.unique(plain_b)) < k):
        # labels may stand crosswise where repeats were deleted: align all equal shingles in the band
        order = np.argsort(plain_b, kind="stable")
        ordered = plain_b[order]
        lo, hi = np.searchsorted(ordered, plain_a, "left"), np.searchsorted(ordered, plain_a, "right")
        tails: list[int] = []
        for i in range(n):
            places = order[lo[i] : hi[i]]
            for j in places[np.abs(places - i) <= band][::-1].tolist():
                t = bisect_left(tails, j)
                tails[t : t + 1] = [j]
        m = len(tails)
    return m / (n + k - m)


def _chunks(batch: pa.RecordBatch, columns: list[str]) -> Iterator[pa.RecordBatch]:
    sizes = sum(pc.binary_length(batch.column(c)).to_numpy(zero_copy_only=False).astype(np.int64) for c in columns)
    group = np.cumsum(sizes) // CHUNK_BYTES
    edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]])
    for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
        if b > a:
            yield batch.slice(a, b - a)


def sketch_documents(rows: DataFrame) -> DataFrame:
    """``rid, doc_id, fp`` (of the words), ``n`` (shingles) and ``keys`` (BANDS sketches; none without words) of rows rid, doc_id, text."""
    from pyspark.sql import types as T
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = T.StructType(
        [rows.schema["rid"], rows.schema["doc_id"], T.StructField("fp", T.BinaryType()),
         T.StructField("n", T.IntegerType()), T.StructField("keys", T.ArrayType(T.LongType(), False))]
    )
    arrow = to_arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _chunks(whole, ["text"]):
                words, cuts = word_hashes(batch.column("text"))
                _, labelled, starts = shingles(words, cuts)
                n = np.diff(starts)
                keys = sketches(labelled, starts).reshape(-1).view(np.int64)
                offsets = np.concatenate([[0], np.cumsum(np.where(n > 0, BANDS, 0))]).astype(np.int32)
                prints = [blake2b(words[a:b].tobytes(), digest_size=16).digest() for a, b in zip(cuts[:-1], cuts[1:])]
                columns = [batch.column("rid"), batch.column("doc_id"), pa.array(prints, pa.binary()), pa.array(n.astype(np.int32)), pa.ListArray.from_arrays(pa.array(offsets), pa.array(keys))]
                yield pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(columns, arrow)], schema=arrow)

    return rows.select("rid", "doc_id", "text").mapInArrow(run, schema)


def hashed_words(texts: DataFrame) -> DataFrame:
    """``rid, words``: the word hashes of rows (rid, text), eight bytes each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _chunks(whole, ["text"]):
                words, cuts = word_hashes(batch.column("text"))
                data = [None, pa.py_buffer((8 * cuts).astype(np.int32)), pa.py_buffer(words)]
                yield pa.RecordBatch.from_arrays([batch.column("rid"), pa.Array.from_buffers(pa.binary(), batch.num_rows, data)], ["rid", "words"])

    return texts.select("rid", "text").mapInArrow(run, "rid long, words binary")


def _unpacked(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of some rows, and where each row's begin."""
    offsets = np.frombuffer(words.buffers()[1], np.int32)[words.offset : words.offset + len(words) + 1].astype(np.int64)
    data = words.buffers()[2]
    flat = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]].tobytes() if data is not None else b""
    return np.frombuffer(flat, np.uint64), (offsets - offsets[0]) // 8


def shared_buckets(nodes: DataFrame) -> DataFrame:
    """``rid, bucket``: the buckets of each node that others are in, too."""
    finer = F.expr(f"transform(keys, (k, i) -> xxhash64(k, keys[(i + 1) % {BANDS}]))")
    rows = nodes.select("rid", "n", F.posexplode(F.concat("keys", finer)).alias("band", "key"))
    size = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(1 / SIMILARITY)) + 1e-9).cast("int")
    classes = F.when(F.col("band") < BANDS, F.array(size - 1, size)).otherwise(F.array(F.lit(-9)))
    rows = rows.select("rid", F.explode(classes).alias("size"), "band", "key")
    rows = rows.select("rid", F.xxhash64("size", "band", "key").alias("bucket"))
    several = rows.groupBy("bucket").agg(F.count("*").alias("c")).where("c > 1").select("bucket")
    return rows.join(many(several), "bucket")


def neighbour_pairs(nodes: DataFrame) -> DataFrame:
    """``a, b, agree``: nodes side by side in one of the orders of sketches, and in how many sketches they agree.

    For each band, nodes are sorted over the cluster by its key and the next three; neighbours have the first in common.
    Neighbours that a partition's end parts are left out, as the exact step finds them.
    """
    ahead = ", ".join(f"'k{k}', keys[(i + {k}) % {BANDS}]" for k in range(4))
    rows = nodes.select("rid", F.posexplode(F.expr(f"transform(keys, (k, i) -> named_struct({ahead}))")).alias("band", "k"))
    order = ["band", "k0", "k1", "k2", "k3", "rid"]
    rows = rows.select("rid", "band", "k.*").repartitionByRange(*order).sortWithinPartitions(*order).select("band", "k0", "rid")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = np.empty((3, 0), np.int64)
        for batch in batches:
            x = np.concatenate([last, np.array([batch.column(c).to_numpy() for c in ("band", "k0", "rid")], np.int64)], axis=1)
            same = (x[:2, 1:] == x[:2, :-1]).all(0)
            low, high = np.minimum(x[2, 1:], x[2, :-1])[same], np.maximum(x[2, 1:], x[2, :-1])[same]
            last = x[:, -1:]
            yield pa.RecordBatch.from_arrays([pa.array(low), pa.array(high)], ["a", "b"])

    pairs = rows.mapInArrow(run, "a long, b long").distinct()
    for side in "ab":
        pairs = pairs.join(many(nodes.select(F.col("rid").alias(side), F.col("keys").alias(f"k{side}"), F.col("n").alias(f"n{side}"))), side)
    pairs = pairs.where(F.least("na", "nb") >= SIMILARITY * F.greatest("na", "nb"))
    equal = sum(((F.col("ka")[i] == F.col("kb")[i]).cast("int") for i in range(BANDS)), F.lit(0))
    return pairs.select("a", "b", equal.alias("agree"))


def mixed_nodes(shared: DataFrame, comps: DataFrame) -> DataFrame:
    """``rid, comp``: the nodes of buckets that hold several components."""
    rows = shared.join(many(comps.withColumnRenamed("node", "rid")), "rid", "left").select("rid", "bucket", F.coalesce("comp", "rid").alias("comp"))
    mixed = rows.groupBy("bucket").agg(F.min("comp").alias("low"), F.max("comp").alias("high")).where("low < high")
    return rows.join(many(mixed.select("bucket")), "bucket", "left_semi").select("rid", "comp").distinct()


def _words_of(asked: DataFrame, words: DataFrame, rows: int) -> DataFrame:
    """The rows of ``words`` (rid, words) that the ``rows`` rids of ``asked`` name: by a broadcast of FEW at most, else by a shuffle."""
    return words.join(F.broadcast(asked) if rows <= FEW else many(asked), "rid", "left_semi")


def prefixes(nodes: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """``token, rid, n, rank, short``: the rarest shingles of the nodes (rid), among which similar texts share one.

    Shingles are ranked by how many of the nodes have them; those that only one has are left out, though they count.
    Similar texts of n <= k shingles have at least ``least`` * (n + k) / (1 + ``least``) in common, so the least ranked of
    these is among as many first ones as the rest leaves over: ``short`` ones where the other text isn't shorter.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _chunks(whole, ["words"]):
                _, labelled, starts = shingles(*_unpacked(batch.column("words")))
                n = np.diff(starts)
                columns = [pa.array(np.repeat(batch.column("rid").to_numpy(), n)), pa.array(np.repeat(n.astype(np.int32), n)), pa.array(labelled.view(np.int64))]
                yield pa.RecordBatch.from_arrays(columns, ["rid", "n", "token"])

    rows = cut(_words_of(nodes.select("rid"), words, nodes.count()).mapInArrow(run, "rid long, n int, token long"), "shingles")
    often = rows.groupBy("token").agg(F.count("*").alias("c")).where("c > 1")
    own = W.partitionBy("rid")
    ranked = rows.join(many(often), "token").withColumn("rank", F.row_number().over(own.orderBy("c", "token")) + F.col("n") - F.count("*").over(own))

    def among(share: float) -> Column:
        return F.col("rank") <= F.col("n") - F.ceil(F.col("n") * share - 1e-9) + 1

    return ranked.where(among(least)).select("token", "rid", "n", "rank", among(2 * least / (1 + least)).alias("short"))


def _fits(least: float, a: str = "a", b: str = "b") -> tuple[Column, Column]:
    """Whether texts can be similar by their sizes, the first being the shorter, and by the ranks of a shingle they share; and what they must share."""
    n, k = F.col(f"n{a}"), F.col(f"n{b}")
    need = F.ceil((n + k) * (least / (1 + least)) - 1e-9)
    room = 1 + F.least(n - F.col(f"r{a}"), k - F.col(f"r{b}"))
    return (n <= k) & (n >= least * k) & (room >= need), need


def sampled_pairs(rows: DataFrame, least: float, turn: int) -> DataFrame:
    """``a, b``: for each shingle, a text of one component with up to REPS texts of another of several texts, chosen by hash.

    ``rows`` are ``prefixes`` with ``comp``. It finds some link between most components that have one.
    """
    mixed = F.hash("rid", "token", F.lit(turn))
    pick = F.struct((~F.col("short")).alias("late"), mixed.alias("h"), "rid", "n", "rank")
    one = rows.where("short").groupBy("token", F.col("comp").alias("ca")).agg(F.min(pick).alias("x"))
    one = one.select("token", "ca", F.col("x.rid").alias("a"), F.col("x.n").alias("na"), F.col("x.rank").alias("ra"))
    some = rows.groupBy("token", F.col("comp").alias("cb"), F.pmod(F.hash("rid"), F.lit(REPS))).agg(F.min(pick).alias("x"))
    some = some.select("token", "cb", F.col("x.rid").alias("b"), F.col("x.n").alias("nb"), F.col("x.rank").alias("rb"))
    several = rows.groupBy("comp").agg(F.countDistinct("rid").alias("nodes")).where("nodes > 1").select(F.col("comp").alias("cb"))
    room = _fits(least)[0] | _fits(least, "b", "a")[0]
    both = one.join(many(some.join(many(several), "cb", "left_semi")), "token").where((F.col("ca") != F.col("cb")) & room)
    return both.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()


def prefix_pairs(rows: DataFrame, least: float) -> DataFrame:
    """``a, b, common``: pairs of different components that include all pairs with a similarity of ``least``.

    ``rows`` are ``prefixes`` with ``comp``. Components meet first, where the sizes and ranks of their members leave a
    pair possible, so that the members of one aren't crossed with each other. What two texts share up to the last ranks
    found, and the room behind these, is all they can have in common.
    """
    ends = [F.min("n").alias("lo"), F.max("n").alias("hi"), F.max(F.col("n") - F.col("rank")).alias("room")]
    group = lambda df, c: df.groupBy("token", F.col("comp").alias(f"c{c}")).agg(*ends).withColumnsRenamed({k: f"{k}{c}" for k in ("lo", "hi", "room")})
    least_need = F.ceil((F.col("loa") + F.col("lob")) * (least / (1 + least)) - 1e-9)
    likely = (F.col("loa") <= F.col("hib")) & (F.col("hia") >= least * F.col("lob")) & (1 + F.least("rooma", "roomb") >= least_need)
    meet = group(rows.where("short"), "a").join(many(group(rows, "b")), "token").where((F.col("ca") != F.col("cb")) & likely).select("token", "ca", "cb", "lob", "hib", "roomb")
    side = lambda df, c: df.select("token", F.col("comp").alias(f"c{c}"), F.col("rid").alias(c), F.col("n").alias(f"n{c}"), F.col("rank").alias(f"r{c}"))
    # a member of the one component, with the best that the other may have
    fits_some = (F.col("na") <= F.col("hib")) & (F.col("na") >= least * F.col("lob"))
    fits_some &= 1 + F.least(F.col("na") - F.col("ra"), "roomb") >= F.ceil((F.col("na") + F.greatest("na", "lob")) * (least / (1 + least)) - 1e-9)
    both = side(rows.where("short"), "a").join(many(meet), ["token", "ca"]).where(fits_some).drop("lob", "hib", "roomb").join(many(side(rows, "b")), ["token", "cb"])
    fits, need = _fits(least)
    found = both.where(fits).groupBy("a", "b").agg(F.count("*").alias("common"), *[F.max(c).alias(c) for c in ("ra", "rb", "na", "nb")])
    found = found.where(F.col("common") + F.least(F.col("na") - F.col("ra"), F.col("nb") - F.col("rb")) >= need)
    return found.groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(F.max("common").alias("common"))


def _joined(comps: DataFrame, links: DataFrame) -> DataFrame:
    """``comps`` (node, comp) after more links between nodes."""
    side = lambda c: many(comps.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")))
    bridges = links.join(side("a"), "a", "left").join(side("b"), "b", "left")
    over = components(bridges.select(F.coalesce("ca", "a").alias("a"), F.coalesce("cb", "b").alias("b")))
    over = over.select(F.col("node").alias("comp"), F.col("comp").alias("top"))
    every = comps.unionByName(over.select(F.col("comp").alias("node"), "comp").join(many(comps), "node", "left_anti"))
    return cut(every.join(many(over), "comp", "left").select("node", F.coalesce("top", "comp").alias("comp")), "comps")


def _with_words(joined: DataFrame, pairs: DataFrame, words: DataFrame, side: str, rows: int) -> DataFrame:
    """``joined`` with the words of one side of the ``rows`` ``pairs`` (a, b); the pairs of a text that has many are spread over tasks."""
    parts = F.ceil(F.col("rows_of_key") / PAIRS_PER_TASK).cast("int").alias("parts")
    heavy = heavy_keys(pairs.groupBy(side).agg(F.count("*").alias("rows_of_key")), [side]).select(side, parts)
    heads = _words_of(pairs.select(F.col(side).alias("rid")), words, rows).select(F.col("rid").alias(side), F.col("words").alias(f"t{side}"))
    if heavy.isEmpty():
        return joined.join(many(heads), side)
    every = F.coalesce("parts", F.lit(1))
    left = joined.join(F.broadcast(heavy), side, "left").withColumn("salt", F.pmod(F.hash("a", "b"), every)).drop("parts")
    right = heads.join(F.broadcast(heavy), side, "left").withColumn("salt", F.explode(F.sequence(F.lit(0), every - 1))).drop("parts")
    return left.join(many(right), [side, "salt"]).drop("salt")


def _verify(pairs: DataFrame, words: DataFrame, least: float) -> DataFrame:
    """The rows a, b of the stored table ``pairs`` whose texts are similar, by their words (rid, words)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for batch in _chunks(whole, ["ta", "tb"]):
                sides = []
                for side in "ab":
                    # rows of one text stand together where the join sorts by it
                    ids = batch.column(side).to_numpy()
                    new = np.concatenate([[True], ids[1:] != ids[:-1]])
                    at = np.cumsum(new) - 1
                    made = shingles(*_unpacked(batch.column(f"t{side}").filter(pa.array(new))))
                    sides.append((at, *made))
                (ia, pa_, la, sa), (ib, pb, lb, sb) = sides
                good = []
                for i, j in zip(ia.tolist(), ib.tolist()):
                    x, y = slice(sa[i], sa[i + 1]), slice(sb[j], sb[j + 1])
                    good.append(aligned(pa_[x], pb[y], la[x], lb[y], least) >= least)
                yield batch.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    n = pairs.count()
    both = _with_words(pairs.select("a", "b"), pairs, words, "a", n)
    both = _with_words(both, pairs, words, "b", n)
    return both.select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long")


def near_classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row per row of ``docs``: ``doc_id, class_id, class_size, kept``.

    Classes are the components of the links. ``class_id`` is the least id in the class (null if it has none), and of
    each class the row with that id is kept (of rows that repeat it, one). Texts of equal words are in one class; a text
    without words is a class by itself; fewer words than a shingle are one shingle. Null text counts as empty, null ids
    come last, an empty table gives no rows. Other columns are not read.
    """
    rows, _ = numbered(docs.select(F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text")))
    return _classes(rows, similarity).drop("rid")


def _classes(rows: DataFrame, similarity: float) -> DataFrame:
    """``near_classes`` of a stored table (rid, doc_id, text), with ``rid``."""
    made = cut(sketch_documents(rows), "sketches")
    worded = made.where("n > 0")
    nodes = cut(worded.groupBy("fp").agg(F.min(F.struct("rid", "n", "keys")).alias("x"), F.count("*").alias("copies")).select("fp", "copies", "x.*"), "nodes")
    shared = cut(shared_buckets(nodes), "shared")
    involved = cut(shared.select("rid").distinct(), "involved")
    involved = F.broadcast(involved) if involved.count() <= BROADCAST_KEYS else many(involved)
    words = cut(hashed_words(rows.join(involved, "rid", "left_semi")), "words")
    pairs = cut(neighbour_pairs(nodes.join(involved, "rid", "left_semi")).where(F.col("agree") >= LIKELY), "pairs")

    both = pairs.select("a", "b", "agree").unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b"), "agree"))
    best = both.groupBy("a").agg(F.max(F.struct("agree", "b")).alias("x")).select(F.least("a", "x.b").alias("a"), F.greatest("a", "x.b").alias("b"))
    best = cut(best.distinct(), "best-pairs")
    found = components(cut(_verify(best, words, similarity), "links"))

    def apart(some: DataFrame) -> DataFrame:
        """Pairs between components, with these: the others can't change a class."""
        side = lambda c: many(found.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}")))
        named = some.join(side("a"), "a", "left").join(side("b"), "b", "left")
        ends = {"low": F.least(F.coalesce("ca", "a"), F.coalesce("cb", "b")), "high": F.greatest(F.coalesce("ca", "a"), F.coalesce("cb", "b"))}
        return named.withColumns(ends).where("low != high").drop("ca", "cb")

    def linked(some: DataFrame) -> DataFrame:
        more = cut(_verify(some, words, similarity), "links")
        return found if more.isEmpty() else _joined(found, more)

    found = linked(cut(apart(pairs.join(many(best), ["a", "b"], "left_anti")).select("a", "b"), "other-pairs"))
    mixed = cut(mixed_nodes(shared, found), "mixed-nodes")
    rare = cut(prefixes(mixed, words, similarity), "prefixes")

    def with_comp() -> DataFrame:
        return rare.join(many(found.withColumnRenamed("node", "rid")), "rid", "left").withColumn("comp", F.coalesce("comp", "rid"))

    tested = pairs.select("a", "b")
    for turn in range(SAMPLES):
        some = cut(sampled_pairs(with_comp(), similarity, turn).join(many(tested), ["a", "b"], "left_anti"), "sampled-pairs")
        tested, before = tested.unionByName(some), found
        found = linked(some)
        if found is before:
            break
    left = cut(prefix_pairs(with_comp(), similarity).join(many(tested), ["a", "b"], "left_anti"), "untested")
    first = apart(left).groupBy("low", "high").agg(F.max(F.struct("common", "a", "b")).alias("x")).select("x.a", "x.b")
    first = cut(first, "first-pairs")
    found = linked(first)
    found = linked(cut(apart(left.join(many(first), ["a", "b"], "left_anti")).select("a", "b"), "last-pairs"))

    named = nodes.select("fp", "copies", F.col("rid").alias("node")).join(many(found), "node", "left").select("fp", "copies", F.coalesce("comp", "node").alias("comp"))
    member = join_heads(worded.select("rid", "doc_id", "fp"), named, ["fp"], "copies").select("rid", "doc_id", "comp")
    member = member.unionByName(made.where("n = 0").select("rid", "doc_id", F.col("rid").alias("comp")))
    member = cut(member, "members")
    order = F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rid")
    top = member.groupBy("comp").agg(F.min(order).alias("first"), F.count("*").alias("class_size"))
    return join_heads(member, cut(top, "tops"), ["comp"], "class_size").select(
        "rid", "doc_id", F.col("first.doc_id").alias("class_id"), "class_size", (F.col("rid") == F.col("first.rid")).alias("kept")
    )


def drop_near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", similarity: float = SIMILARITY) -> DataFrame:
    """One row of each class, the one that ``near_classes`` keeps, with all columns of ``docs``; an empty table stays empty."""
    rows, rid = numbered(docs)
    named = rows.select(F.col(rid).alias("rid"), F.col(id_col).alias("doc_id"), text_or_empty(F.col(text_col)).alias("text"))
    gone = _classes(named, similarity).where("not kept").select(F.col("rid").alias(rid))
    return rows.join(gone, rid, "left_anti").drop(rid)

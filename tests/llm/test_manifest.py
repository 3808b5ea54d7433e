"""Merkle manifests, line deduplication and periodic runs against plain Python, on odd rows too."""

import hashlib
import random
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from fieldscan.llm import line_dedup, merkle, periodic, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long, rid long, keys string, steps string, Tree int"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BLANKS = " \t\n\x0b\x0c\r"


def odd_rows():
    """Nulls everywhere, repeated rows, ties, empty and very long texts, one language with most rows."""
    draw = random.Random(3)
    rows = []
    for i in range(150):
        lang = draw.choice(["en", "en", "en", "en", "de", "", None, "É", "zz"])
        text = draw.choice([None, "", "\n", "One line", "a\n\nB\r\n a \n", "x " * draw.randint(0, 90), "é É \nÉ é", "word\n" * draw.randint(1, 200)])
        rows.append((None if i % 29 == 0 else i // 2 * 3, text, lang, draw.choice([None, "s"]), draw.choice([None, 7]), 5, "k", "s", 1))
    rows += rows[:9] + [rows[1]] * 4
    rows.append((10**12, ("la " * 3000 + "end\n") * 3, "solo", "s", 1, 0, "", "", 0))
    return rows


# --- Merkle manifest


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def plain_leaf(row, add=0):
    i, text, lang, source, n, *_ = row
    return digest(*["-" if x is None else f"{len(str(x).encode())}:{x}" for x in (i, source, lang, n if n is None else n + add, text)])


def plain_levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([digest(*out[-1][i : i + 2]) for i in range(0, len(out[-1]), 2)])
    return out


def plain_manifest(rows):
    by_lang = {}
    for r in rows:
        by_lang.setdefault(r[2], []).append(r)
    langs = sorted(by_lang, key=lambda x: (x is not None, (x or "").encode()))
    for lang in langs:
        by_lang[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, plain_leaf(r)))
    trees = [plain_levels([plain_leaf(r) for r in by_lang[lang]]) for lang in langs]
    top = plain_levels([t[-1][0] for t in trees])
    out = Counter()
    for k, lang in enumerate(langs):
        for i, r in enumerate(by_lang[lang]):
            tampered = r[0] is not None and zlib.crc32(str(r[0]).encode()) % 7 == 0
            shown, path = plain_leaf(r, 1 if tampered else 0), []
            for levels, at in ((trees[k], i), (top, k)):
                for level in levels[:-1]:
                    other = level[at ^ 1] if at ^ 1 < len(level) else ""
                    shown = digest(other, shown) if at % 2 else digest(shown, other)
                    path.append(other)
                    at //= 2
            out[(r[0], plain_leaf(r), trees[k][-1][0], top[-1][0], digest(*path), shown, shown == top[-1][0])] += 1
    return out


@pytest.mark.parametrize("rows", [odd_rows(), odd_rows()[:1], odd_rows()[1:3], [], [(i, "t", f"lang {i}", None, i, 0, "", "", 0) for i in range(37)]])
def test_manifest(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = queries.op11_merkle(spark, str(tmp_path))
    assert Counter(map(tuple, got.collect())) == plain_manifest(rows)


def test_manifest_of_large_trees_with_shuffled_ancestors(spark, monkeypatch):
    monkeypatch.setattr(merkle, "BROADCAST_BYTES", -1)
    rows = spark.range(5000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 > 0, "a").otherwise(F.concat(F.lit("b"), F.col("id") % 50)).alias("lang"), F.sha2(F.col("id").cast("string"), 256).alias("leaf"))
    proved, root = merkle.proofs(rows, "doc_id", "lang", "leaf")
    n = merkle.n_steps(F.col("steps"))
    ends = proved.select(merkle.fold(F.col("leaf"), F.col("steps"), 0, n).alias("end")).groupBy("end").count().collect()
    assert [(r["end"], r["count"]) for r in ends] == [(root, 5000)]
    leaves = {}
    for r in rows.orderBy("doc_id").collect():
        leaves.setdefault(r["lang"], []).append(r["leaf"])
    assert root == plain_levels([plain_levels(leaves[k])[-1][0] for k in sorted(leaves)])[-1][0]


# --- line deduplication


def plain_lines(rows, least_docs, least_chars, keep_first=False):
    key = lambda line: line.strip(BLANKS).translate(LOWER)
    often = Counter(k for r in rows for k in {key(x) for x in (r[1] or "").split("\n")} if len(k) >= least_chars)
    out = []
    for r in rows:
        lines = (r[1] or "").split("\n")
        kept = [x for x in lines if often[key(x)] < least_docs]
        out.append((r[0], len(lines), len(lines) - len(kept), "\n".join(kept)))
    return Counter(out)


@pytest.mark.parametrize("least_docs, least_chars, heavy", [(10, 1, 1000), (2, 1, 1000), (3, 4, 3), (1, 1, 2), (10, 1, 2)])
def test_lines(spark, monkeypatch, least_docs, least_chars, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY_LEAST", heavy)
    rows = odd_rows()
    got = line_dedup.drop_repeated_lines(spark.createDataFrame(rows, DOCS).repartition(7), least_docs=least_docs, least_chars=least_chars)
    assert Counter((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == plain_lines(rows, least_docs, least_chars)


def test_no_lines(spark):
    assert line_dedup.drop_repeated_lines(spark.createDataFrame([], DOCS)).count() == 0


@pytest.mark.parametrize("heavy", [1000, 4])
def test_first_occurrences_stay(spark, monkeypatch, heavy):
    monkeypatch.setattr(line_dedup, "HEAVY_LEAST", heavy)
    texts = ["same\nown 1\nSame ", "same\nown 2", "other\nsame", "other", *["same"] * 9]
    rows, maps = line_dedup.line_bitmaps(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"), least_docs=2, keep_first=True)
    at, text = {r["rid"]: r["doc_id"] for r in rows.collect()}, {r["rid"]: r["text"] for r in rows.collect()}
    gone = {at[r["rid"]]: r["n_dropped"] for r in maps.collect()}
    first = {k: min(r for r in at if k in text[r].lower().split("\n")) for k in ("same", "other")}
    want = Counter()
    for r, t in text.items():
        seen = set()
        for line in t.split("\n"):
            k = line.strip().lower()
            if k in first and (r != first[k] or k in seen):
                want[at[r]] += 1
            seen.add(k)
    assert gone == dict(want)


def test_stream_in_small_batches():
    import numpy as np

    draw = random.Random(1)
    for _ in range(300):
        rows = sorted((draw.randint(0, 3), draw.randint(0, 1), draw.randint(0, 6), draw.randint(0, 4)) for _ in range(draw.randint(1, 60)))
        rows = sorted(set(rows))
        least, first = draw.randint(1, 4), draw.random() < 0.5
        state, got, at = line_dedup.Stream(least, first), [], 0
        while at < len(rows):
            some = rows[at : at + draw.randint(1, 9)]
            at += len(some)
            got += list(zip(*state.take(*map(np.array, zip(*some))).tolist()))
        docs = Counter((h, g) for h, g, r in {x[:3] for x in rows})
        heads = {min(x for x in rows if x[:2] == k) for k in docs} if first else set()
        assert sorted(got) == sorted((r, p) for h, g, r, p in rows if docs[h, g] >= least and (h, g, r, p) not in heads)


def test_bitmaps_are_sparse(spark):
    rows = [(1, p) for p in (0, 63, 64, 64 * 5000 + 7)]
    (r,) = line_dedup.keep_bitmaps(spark.createDataFrame(rows, "rid long, pos long")).collect()
    assert r["n_dropped"] == 4 and len(r["keep"]) == 3 * 12
    text = "\n".join(map(str, range(64 * 5000 + 9)))
    import pandas as pd

    kept = line_dedup.kept_text(pd.Series([text]), pd.Series([r["keep"]]))[0].split("\n")
    assert set(map(str, range(64 * 5000 + 9))) - set(kept) == {str(p) for _, p in rows}


# --- periodic runs


def plain_runs(words, least=6, times=4):
    out = []
    for q in range(1, len(words) // times + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            run = words[i : j + q]
            if j > i and len(run) >= max(least, times * q) and not any(all(run[x] == run[x + p] for x in range(len(run) - p)) for p in range(1, q)):
                out.append((i, len(run), q))
            i = max(j, i + 1)
    out.sort(key=lambda r: (r[0], r[2]))
    gone = {x for start, length, period in out for x in range(start + period, start + length)}
    return out, " ".join(w for i, w in enumerate(words) if i not in gone)


def blocks_of(draw):
    words = []
    for _ in range(draw.randint(0, 9)):
        unit = [draw.choice("ab" if draw.random() < 0.5 else "abcdef") for _ in range(draw.randint(1, 12))]
        words += (unit * draw.randint(1, 9))[: draw.randint(1, 60)]
    return words


@pytest.mark.parametrize("least, times", [(6, 4), (10, 3), (3, 3), (9, 5)])
def test_runs(spark, least, times):
    draw = random.Random(least)
    texts = [" \t".join(blocks_of(draw)) + draw.choice(["", "\n", " b"]) for _ in range(200)]
    rows = [(i if i % 7 else None, t, "x", 1) for i, t in enumerate([None, "", *texts, texts[0], texts[0]])]
    got = periodic.periodic_runs(spark.createDataFrame(rows, "doc_id long, text string, runs string, N_words int").repartition(3), least=least, times=times)
    split = lambda t: re.findall("[^\x20\x09-\x0d]+", t or "")
    want = Counter((i, len(split(t)), *map(str, plain_runs(split(t), least, times))) for i, t, *_ in rows)
    assert Counter((r[0], r[1], str([tuple(x) for x in r[2]]), r[3]) for r in got.collect()) == want
    assert sum(len(r[2]) for r in got.collect()) > 100


def test_query_of_runs(spark):
    folder = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in queries.op13_periodic(spark, folder).collect()}
    rows = queries.table(spark, folder, "documents").collect()
    assert len(got) == len(rows)
    for d in rows:
        words, h = re.findall("[^\x20\x09-\x0d]+", d["text"] or ""), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            words = [words[i] if i < a else words[a + (i - a) % (1 + (n - a) // (3 + g % 8))] for i in range(n)]
        if n > 2000:
            continue
        runs, left = plain_runs(words)
        best = max(runs, key=lambda r: (r[1], -r[0], -r[2]), default=None)
        want = (d["doc_id"], len(runs), *((*best, 1000 * best[1] // best[2]) if best else (None,) * 4), digest(*[f"{a},{b},{c}\n" for a, b, c in runs]), digest(left))
        assert tuple(got[d["doc_id"]]) == want


def test_odd_documents_of_the_run_query(spark, tmp_path):
    spark.createDataFrame(odd_rows(), DOCS).write.parquet(f"{tmp_path}/documents.parquet")
    assert queries.op13_periodic(spark, str(tmp_path)).count() == len(odd_rows())
    spark.createDataFrame([], DOCS).write.parquet(f"{tmp_path}/none/documents.parquet")
    assert queries.op13_periodic(spark, f"{tmp_path}/none").count() == 0
    with pytest.raises(ValueError):
        periodic.periodic_runs(spark.createDataFrame([], DOCS), times=2)

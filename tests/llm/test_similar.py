"""Near-duplicates and benchmark leaks against brute force and planted cases."""

import random
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest

from fieldscan.llm import common, components, decontam, near_dedup, queries

DOCS = "doc_id long, text string, rid long, comp string, n int"


def shingle_lists(texts):
    import re

    out = []
    for t in texts:
        w = re.findall(r"[^\W_]+", (t or "").lower())
        out.append([tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))] if w else [])
    return out


def lcs(a, b):
    row = np.zeros(len(b) + 1, np.int64)
    for x in a:
        hit = np.array([x == y for y in b], np.int64)
        new = np.maximum(row[1:], row[:-1] + hit)
        row[1:] = np.maximum.accumulate(new)
    return int(row[-1])


def brute_classes(texts, least=0.8):
    sh = shingle_lists(texts)
    top = list(range(len(texts)))

    def root(i):
        while top[i] != i:
            i = top[i]
        return i

    sets = [Counter(s) for s in sh]
    for i in range(len(texts)):
        for j in range(i):
            n, k = len(sh[i]), len(sh[j])
            if not n or not k or min(n, k) < least * max(n, k):
                continue
            common = sum((sets[i] & sets[j]).values())
            if common < least * (n + k - common):
                continue
            m = lcs(sh[i], sh[j])
            if m >= least * (n + k - m) - 1e-9:
                a, b = sorted((root(i), root(j)))
                top[b] = a
    return [root(i) for i in range(len(texts))]


def corpus(n=260, seed=1):
    rng = random.Random(seed)
    vocab = [a + b + c for a in "bdfgklm" for b in "aeiou" for c in ("n", "r", "s", "tt", "")]
    word = lambda: rng.choice(vocab)
    passage = [word() for _ in range(60)]
    base = [[word() for _ in range(rng.randrange(3, 220))] for _ in range(n // 4)]
    texts = [" ".join(b) for b in base]
    while len(texts) < n:
        kind = rng.random()
        b = list(rng.choice(base))
        if kind < 0.35:
            for _ in range(rng.randrange(0, 1 + len(b) // 40)):
                i = rng.randrange(len(b))
                b[i : i + rng.randrange(2)] = [word()] * rng.randrange(2)
        elif kind < 0.5:
            for _ in range(len(b) // 12):
                b[rng.randrange(len(b))] = word()
        elif kind < 0.6:
            half = len(b) // 2
            b = b[half:] + b[:half]
        elif kind < 0.85:
            b = passage + [word() for _ in range(rng.randrange(2, 50))]
        else:
            b = [rng.choice(["same", "words"])] * rng.randrange(1, 90)
        texts.append(rng.choice([" ", "  ", ", "]).join(b).capitalize())
    return texts


def same_partition(a, b):
    return len(set(zip(a, b))) == len(set(a)) == len(set(b))


def classes(spark, tmp_path, rows):
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/d")
    return near_dedup.near_classes(spark.read.parquet(f"{tmp_path}/d")).collect()


def test_near_against_brute_force(spark, tmp_path):
    texts = corpus()
    out = classes(spark, tmp_path, [(i, t, 1, "x", 2) for i, t in enumerate(texts)])
    got = {r["doc_id"]: r for r in out}
    want = brute_classes(texts)
    assert len(got) == len(texts)
    assert same_partition([got[i]["class_id"] for i in range(len(texts))], want)
    sizes = Counter(want)
    for i, c in enumerate(want):
        assert got[i]["class_id"] == c and got[i]["class_size"] == sizes[c] and got[i]["kept"] == (i == c)


def test_near_edges(spark, tmp_path):
    copy = " ".join(f"w{i}" for i in range(3000))
    rows = [(1, None, 1, "", 1), (2, "", 1, "", 1), (3, "...", 1, "", 1), (4, "one two", 1, "", 1), (5, "One, TWO!", 1, "", 1), (None, "one two", None, None, None),
            (7, copy, 1, "", 1), (7, copy, 1, "", 1), (8, copy + " end", 1, "", 1), (9, "one", 1, "", 1)]
    out = classes(spark, tmp_path, rows)
    assert len(out) == len(rows)
    by = defaultdict(list)
    for r in out:
        by[r["class_id"]].append((r["doc_id"], r["class_size"], r["kept"]))
    assert sorted(x[0] for x in by[7]) == [7, 7, 8] and sum(x[2] for x in by[7]) == 1
    assert {x[0] for x in by[4]} == {4, 5, None} and len(by[1]) == len(by[2]) == len(by[3]) == len(by[9]) == 1
    none = classes(spark, tmp_path / "none", [])
    assert none == []


def test_near_hot_group(spark, tmp_path):
    rng = random.Random(3)
    base = [f"w{rng.randrange(900)}" for _ in range(400)]
    rows = []
    for i in range(900):
        b = list(base)
        for _ in range(rng.randrange(4)):
            b[rng.randrange(len(b))] = "changed"
        rows.append((i, " ".join(b), 1, "", 1))
    rows += [(1000 + i, " ".join(f"x{rng.randrange(10**6)}" for _ in range(100)), 1, "", 1) for i in range(50)]
    out = classes(spark, tmp_path, rows)
    assert {r["class_id"] for r in out if r["doc_id"] < 900} == {0}
    assert all(r["class_size"] == 1 for r in out if r["doc_id"] >= 1000)


def test_near_chain_of_edits(spark, tmp_path):
    """Copies of copies: most texts are similar to few of a large group, which no single leader shows."""
    rng = random.Random(11)
    texts = [[f"w{rng.randrange(500)}" for _ in range(90)]]
    for _ in range(219):
        b = list(texts[-1] if rng.random() < 0.5 else rng.choice(texts))
        for _ in range(rng.randrange(1, 3)):
            b[rng.randrange(len(b))] = f"new{rng.randrange(10**6)}"
        texts.append(b)
    rows = [(i, " ".join(t), 1, "", 1) for i, t in enumerate(texts)]
    out = {r["doc_id"]: r["class_id"] for r in classes(spark, tmp_path, rows)}
    want = brute_classes([r[1] for r in rows])
    assert len(set(want)) > 5
    assert same_partition([out[i] for i in range(len(rows))], want)


def test_near_dropped_rows_keep_clashing_columns(spark, tmp_path):
    copy = " ".join(f"w{i}" for i in range(40))
    rows = [(1, copy, 5), (1, copy, 6), (2, copy + " end", 7), (3, "other", 8), (None, None, None)]
    spark.createDataFrame(rows, "doc_id long, text string, rid long").selectExpr("*", "'x' AS RID_", "1 AS __rid").write.parquet(f"{tmp_path}/d")
    out = near_dedup.drop_near_duplicates(spark.read.parquet(f"{tmp_path}/d"))
    assert out.columns == ["doc_id", "text", "rid", "RID_", "__rid"]
    assert sorted((r["doc_id"] or 0) for r in out.collect()) == [0, 1, 3]


def test_near_pairs_that_share_a_passage(spark, tmp_path):
    passage = " ".join(f"p{i}" for i in range(304))
    own = lambda kind, i, n: " ".join(f"{kind}{i}x{k}" for k in range(n))
    pairs = 1500
    rows = [(2 * i + j, f"{passage} {own('s', i, 58)} {own('t', 2 * i + j, 42)}", 1, "", 1) for i in range(pairs) for j in range(2)]
    out = classes(spark, tmp_path, rows)
    assert len(out) == 2 * pairs
    assert all(r["class_id"] == r["doc_id"] // 2 * 2 and r["class_size"] == 2 for r in out)


def test_alignment_and_sketches():
    texts = corpus(60, 5)
    words, cuts = near_dedup.word_hashes(pa.array(texts))
    plain, labelled, starts = near_dedup.shingles(words, cuts)
    sh = shingle_lists(texts)
    assert np.diff(starts).tolist() == [len(s) for s in sh]
    for i in range(60):
        part = slice(starts[i], starts[i + 1])
        assert len(set(labelled[part].tolist())) == len(sh[i]) and len(set(plain[part].tolist())) == len(set(sh[i]))
    for i in range(60):
        for j in range(i):
            a, b = slice(starts[i], starts[i + 1]), slice(starts[j], starts[j + 1])
            m = lcs(sh[i], sh[j])
            want = m / (len(sh[i]) + len(sh[j]) - m)
            got = near_dedup.aligned(plain[a], plain[b], labelled[a], labelled[b], 0.5)
            assert got == pytest.approx(want) if want >= 0.5 else got < 0.5
    keys = near_dedup.sketches(labelled, starts)
    assert keys.shape == (60, near_dedup.BANDS)
    # order counts: the same shingles in another order give other keys
    x = np.array([5, 9], np.uint64)
    a = near_dedup.sketches(x, np.array([0, 2]))
    b = near_dedup.sketches(x[::-1].copy(), np.array([0, 2]))
    assert (a != b).all()


def test_near_query_against_brute_force(spark):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    table = pq.read_table(f"{folder}/documents.parquet")
    got = {r["doc_id"]: r["class_id"] for r in queries.op5_near_dedup(spark, folder).collect()}
    ids = table.column("doc_id").to_pylist()
    assert same_partition([got[i] for i in ids], brute_classes(table.column("text").to_pylist()))


# --- decontamination

ITEMS = "item_id long, text string, h string"
QUESTION = "A train to Paris leaves with 40 passengers and picks up 12 more at each stop, and after 40 minutes the guard called Anna counts all of the people in it, how many will she find"


def test_leaks(spark, tmp_path):
    filler = "plain text about gardens and the weather that no exam would ever ask for in this way "
    other = QUESTION.replace("40", "75").replace("12", "9").replace("Paris", "Rome").replace("Anna", "Greta").replace("minutes", "hours")
    mixed = QUESTION.replace("40 passengers", "75 passengers").replace("Paris", "Rome")
    part = " ".join(QUESTION.split()[:14])
    texts = {1: filler + QUESTION + " " + filler, 2: filler * 3 + other, 3: mixed, 4: part, 5: filler, 6: None, 7: "", 8: QUESTION + " " + filler * 900, 9: QUESTION + " " + other}
    rows = [(i, t, 1, "x", 1) for i, t in texts.items()] + [(1, texts[1], 1, "x", 1), (None, QUESTION, None, None, None)]
    items = [(70, QUESTION, "x"), (71, "too short", ""), (72, None, ""), (73, "", ""), (74, "1 2 3 4 5 6 7 8 9", ""), (None, "an item without an id that has words enough", "")]
    rows.append((10, "x an item without an id that has words enough", 1, "", 1))
    spark.createDataFrame(rows, DOCS).repartition(3).write.parquet(f"{tmp_path}/d")
    docs, bench = spark.read.parquet(f"{tmp_path}/d"), spark.createDataFrame(items, ITEMS)
    got = Counter((r["doc_id"], r["item_id"]) for r in decontam.find_leaks(docs, bench).collect())
    want = {(1, 70): 2, (2, 70): 1, (8, 70): 1, (None, 70): 1, (10, None): 1}
    assert {k: v for k, v in got.items() if k[0] not in (3, 9)} == want
    # 3 gives one value of the item two values of its own, so its slots disagree in part
    by = {r["doc_id"]: r for r in decontam.find_leaks(docs, bench).collect()}
    assert by[1]["agreement"] == 1.0 and by[2]["agreement"] == 1.0 and (3 not in by or by[3]["agreement"] < 1)
    kept = decontam.drop_leaks(docs, bench)
    assert kept.columns == docs.columns and {r["doc_id"] for r in kept.collect()} >= {4, 5, 6, 7}
    assert kept.count() == len(rows) - sum(1 for r in rows if (r[0], 70) in got or (r[0], None) in got)
    assert decontam.find_leaks(docs, bench.limit(0)).count() == 0
    assert decontam.find_leaks(docs.limit(0), bench).count() == 0


def test_leaks_of_each_occurrence(spark, tmp_path):
    filler = "plain text about gardens and the weather that no exam would ever ask for in this way "
    other = QUESTION.replace("40", "75").replace("12", "9").replace("Paris", "Rome").replace("Anna", "Greta").replace("minutes", "hours")
    longer = QUESTION.replace("leaves with", "leaves in the early morning with")
    repeated = " ".join(f"on day {i} he walks {2 * i + 1} km to the shop and then back home." for i in range(1, 5))
    same = "the box of 7 red pens and the box of 7 blue pens cost as much as the box of 7 green pens"
    differs = same.replace("7 red", "1 red").replace("7 blue", "2 blue").replace("7 green", "3 green")
    texts = {1: f"{QUESTION} {other}", 2: f"{filler} {other} {filler} {QUESTION}", 3: f"{longer}. {other}", 4: repeated, 5: f"{filler} {repeated} {filler}", 6: filler, 7: f"{differs} {differs}"}
    spark.createDataFrame([(i, t, 1, "x", 1) for i, t in texts.items()], DOCS).repartition(3).write.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame([(70, QUESTION, "x"), (71, repeated, "x"), (72, same, "x")], ITEMS)
    got = {(r["doc_id"], r["item_id"]): r for r in decontam.find_leaks(spark.read.parquet(f"{tmp_path}/d"), bench).collect()}
    assert set(got) == {(1, 70), (2, 70), (3, 70), (4, 71), (5, 71)}
    assert all(r["agreement"] == 1.0 for r in got.values())
    assert all(got[k]["covered"] == got[k]["windows"] for k in [(1, 70), (2, 70), (4, 71), (5, 71)])


def test_leaks_by_shuffle(spark, tmp_path, monkeypatch):
    folder = "/root/testdata/sf0.001"
    broadcast = sorted(map(str, queries.op10_decontamination(spark, folder).collect()))
    monkeypatch.setattr(decontam, "BROADCAST_ROWS", 0)
    assert sorted(map(str, queries.op10_decontamination(spark, folder).collect())) == broadcast and broadcast


def test_leaks_with_names_that_begin_sentences(spark, tmp_path):
    item = "Alice has 12 apples in her basket. Alice gives 4 apples to a friend. Alice then eats 2 apples on the way home. How many apples are left?"
    other = item.replace("Alice", "Carol").replace("12", "31").replace(" 4 ", " 7 ").replace(" 2 ", " 5 ")
    docs = [(1, other), (2, "Intro text. " + item + " More text."), (3, item.lower()), (4, "so " + item[0].lower() + item[1:]), (5, item.replace("Alice", "Carol", 1)), (6, None)]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(f"{tmp_path}/d")
    bench = spark.createDataFrame([(7, item), (None, "nothing of the kind is in any of these documents at all"), (8, None)], "item_id long, text string")
    out = {r["doc_id"]: r for r in decontam.find_leaks(spark.read.parquet(f"{tmp_path}/d"), bench).collect()}
    assert set(out) == {1, 2, 3, 4} or set(out) == {1, 2, 3, 4, 5}
    assert out[1]["agreement"] == 1.0 and out[2]["covered"] == out[2]["windows"]


def test_exploded_rows_and_pairs_are_not_broadcast(spark, monkeypatch):
    """Sketches that are exploded look as small as their file; a broadcast of them, or of links, passes through the driver."""
    monkeypatch.setattr(common, "FEW", -1)
    monkeypatch.setattr(near_dedup, "FEW", -1)
    monkeypatch.setattr(near_dedup, "BROADCAST_KEYS", 0)
    plans, written = [], common.cut

    def seen(df, name="cut"):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return written(df, name)

    for module in (near_dedup, components):
        monkeypatch.setattr(module, "cut", seen)
    words = [[f"w{random.Random(g).randrange(9**6)}x{k}" for k in range(40)] for g in range(12)]
    docs = spark.createDataFrame([(i, " ".join(words[i % 12][: 40 - i // 12])) for i in range(36)], "doc_id long, text string")
    got = near_dedup.near_classes(docs)
    plans.append(("classes", got._jdf.queryExecution().executedPlan().toString()))
    assert {(r.doc_id % 12, r.class_size) for r in got.collect()} == {(g, 3) for g in range(12)}
    assert {"shared", "pairs", "edges", "prefixes", "classes"} <= {name for name, _ in plans}
    assert not [name for name, plan in plans if "Broadcast" in plan]


def test_leaks_of_documents_are_not_broadcast(spark):
    """Tables with rows of documents are joined by shuffles; only those made of items may be broadcast."""
    text = " ".join(f"word{k}" for k in range(30))
    docs = spark.createDataFrame([(i, text if i % 2 else f"other {i}") for i in range(8)], "doc_id long, text string")
    found = decontam.find_leaks(docs, spark.createDataFrame([(1, text)], "item_id long, text string"))
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin [rid" in plan and "BroadcastHashJoin [rid" not in plan
    assert sorted(r.doc_id for r in found.collect()) == [1, 3, 5, 7]

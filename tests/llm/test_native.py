"""Secret scan, exact duplicates and shards against plain Python over hard rows."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from fieldscan.llm import exact_dedup, secrets, sharding

SCHEMA = "doc_id long, text string, rid long, sha string, n int"
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A)


def hard_rows():
    rng = random.Random(5)
    long = "".join(rng.choice("abcdé \n") for _ in range(40_000))
    texts = [None, "", "", "A", "a", "É", "é", long, long.upper(), long.replace("é", "É"), long[:-1] + "x", "x" * 4096, "x" * 4097, "X" * 4096]
    texts += [long[:8192], long[:4096], "same text", "same text", "Same Text"] + ["hot block " * 900] * 40
    rows = [(i, t, 7, "clash", 1) for i, t in enumerate(texts)]
    return rows + [(None, "same text", 7, None, None), (16, "same text", 7, "clash", 1), (None, None, None, None, None)]


def low(t):
    return re.sub("[A-Z]", lambda m: m[0].lower(), t or "")


def check_exact(spark, docs, rows):
    out = exact_dedup.exact_duplicates(docs).collect()
    want = defaultdict(list)
    for r in rows:
        want[low(r[1])].append(r[0])
    assert len(out) == len(rows)
    by_sha = {hashlib.sha256(k.encode()).hexdigest(): v for k, v in want.items()}
    for r in out:
        ids = by_sha[r["text_sha256"]]
        best = max((i for i in ids if i is not None), default=None)
        assert (r["keep_id"], r["group_size"]) == (best, len(ids))
    kept = Counter(r["text_sha256"] for r in out if r["kept"])
    assert set(kept) == set(by_sha) and set(kept.values()) <= {1}
    assert all(r["doc_id"] == r["keep_id"] for r in out if r["kept"])


def test_exact(spark, tmp_path):
    rows = hard_rows()
    check_exact(spark, spark.createDataFrame(rows, SCHEMA).repartition(3), rows)
    check_exact(spark, spark.createDataFrame([], SCHEMA), [])
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/d")
    docs = spark.read.parquet(f"{tmp_path}/d")
    kept = exact_dedup.drop_exact_duplicates(docs)
    assert kept.columns == docs.columns
    assert Counter(low(r["text"]) for r in kept.collect()) == Counter({low(r[1]) for r in rows})


def test_exact_heavy(spark, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HEAVY_LEAST", 10)
    monkeypatch.setattr(exact_dedup, "HEAVY_SHARE", 8)
    rows = hard_rows()
    check_exact(spark, spark.createDataFrame(rows, SCHEMA), rows)


@pytest.mark.parametrize("n", [0, 1, 39, 3000])
def test_shards(spark, n):
    rng = random.Random(n)
    rows = [(i if i % 3 else 5, rng.choice([None, "", "é" * rng.randrange(90), f"t{i}"]), 1, "s", 2) for i in range(n)]
    if n:
        rows[0] = (None, None, None, None, None)
    out = sharding.assign_shards(spark.createDataFrame(rows, SCHEMA).repartition(5), shards=40).collect()
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in out) == Counter(
        (i, len((t or "").encode()) + 16, zlib.crc32((t or "").encode())) for i, t, *_ in rows
    )
    slots = defaultdict(list)
    for r in out:
        slots[r["shard"]].append(r["slot"])
    counts = [len(slots.get(s, [])) for s in range(40)]
    assert max(counts) - min(counts) <= 1
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


def test_ring_moves_little_and_is_bounded():
    rng = random.Random(1)
    counts = Counter(rng.randrange(sharding.RING) for _ in range(20_000))
    counts[77] += 9_000  # a hot key

    def place(shards, slack):
        at = {}
        for cell, lo, hi, shard, _ in sharding.walk_ring(dict(counts), shards, 64, slack):
            at |= {(cell, k): shard for k in range(lo, hi)}
        return at

    for slack in (0.0, 0.1):
        a, b = place(40, slack), place(41, slack)
        assert len(a) == len(b) == 29_000
        assert max(Counter(a.values()).values()) <= -(-29_000 * (1 + slack) // 40)
        assert sum(a[k] != b[k] for k in a) < 0.45 * len(a)


def test_shards_do_not_follow_the_layout(spark):
    """The same rows in other files and splits are in the same shards and slots, also with a hot key and equal rows."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 7, 7, rng.randrange(300)]), rng.choice([None, "", "same", str(rng.random())]), None, None, None) for _ in range(1200)]
    df = spark.createDataFrame(rows + [rows[5]] * 300, SCHEMA)
    got = [sorted((tuple(r) for r in sharding.assign_shards(part, shards=10, vnodes=8).collect()), key=str) for part in (df.coalesce(1), df.repartition(11), df.orderBy("text").repartition(3))]
    assert got[0] == got[1] == got[2] and len(got[0]) == 1500


def test_rows_go_to_the_next_shard_with_room(spark):
    """Clockwise from a row's cell, every shard before the one it is in is full."""
    ids = [i if i % 3 else 5 for i in range(2000)]
    rows = spark.createDataFrame([(i, f"t{k}") for k, i in enumerate(ids)], "doc_id long, text string").repartition(4)
    out = sharding.assign_shards(rows, shards=10, vnodes=8, slack=0.2).collect()
    load, most = Counter(r["shard"] for r in out), -(-2000 * 12 // 100)
    place = lambda name: int(hashlib.md5(name.encode()).hexdigest()[:4], 16) * sharding.RING // 65536
    ring = sorted((place(f"shard {s} node {v}"), s) for s in range(10) for v in range(8))
    assert max(load.values()) <= most and len(out) == 2000
    moved = 0
    for r in out:
        start = next((k for k, (cell, _) in enumerate(ring) if cell >= place(str(r["doc_id"]))), 0)
        walk = [ring[(start + k) % len(ring)][1] for k in range(len(ring))]
        before = walk[: walk.index(r["shard"])]
        assert all(load[s] == most for s in before)
        moved += bool(before)
    assert 0 < moved < 1000


def spans_of(text):
    text = text or ""
    out = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 8]
    out += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    out += [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    strong = sorted(out)
    weak = [(m.start(), 3, m.end()) for m in re.finditer(secrets.WEAK["ident"][4:], text, re.I | re.A)]
    weak += [(m.start(), 4, m.end()) for m in re.finditer(secrets.WEAK["blob"], text) if re.search("[0-9]", m[0]) and re.search("[A-Z]", m[0]) and re.search("[a-z]", m[0])]
    weak += [(m.start(), 5, m.end()) for m in re.finditer(secrets.WEAK["endpoint"], text)]
    every = strong + weak
    for s, k, e in weak:
        near = {kind for at, kind, _ in every if abs(at - s) <= secrets.SCOPE}
        who, what, where = near & {1, 3}, near & {0, 2, 4}, near & {5}
        if not any(a < e and b > s for a, _, b in strong) and ((k == 3 and what) or (k == 4 and (who or where)) or (k == 5 and who and what)):
            out.append((s, k, e))
    return sorted(out)


def test_secrets(spark):
    rng = random.Random(3)
    bits = ["token = ", "Password:", "secret: secret: abcdefghij ", "api_key='", "AKIAABCDEFGHIJKL", "AKIA12", "0123456789abcdef" * 2, "deadbeef", "é𝔘\n",
            " user=joe ", "login: bob99 ", "https://host.example.com/x?y=1 ", "Zm9vYmFyQmF6MTIzNDU2Nzg5 ", "plain words here ", "x" * 150, "aGVsbG8wV29ybGQxMjM0NTY", "=", " "]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randrange(40))) for _ in range(300)] + [None, "", "é" * 9000 + "token=abcdefgh12"]
    texts.append("token = abcdefgh1 " * 3000)
    rows = [(i // 2 if i % 7 else None, t, 1, "s", 2) for i, t in enumerate(texts)]
    got = secrets.find_secrets(spark.createDataFrame(rows, SCHEMA).repartition(4)).collect()
    have = Counter((r["doc_id"], tuple((s["start"], s["kind"], s["end"]) for s in r["spans"])) for r in got)
    assert have == Counter((r[0], tuple(spans_of(r[1]))) for r in rows)
    assert secrets.find_secrets(spark.createDataFrame([], SCHEMA)).count() == 0
    one = secrets.find_secrets(spark.createDataFrame([(1, "token=abcdefgh", 1, "", 1)], SCHEMA)).select(secrets.span_text(F.col("spans"))).first()
    assert one[0] == "assign:0:14"

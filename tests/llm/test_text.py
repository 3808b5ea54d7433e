"""URL filter, toxicity, BPE, token counts and WARC against plain Python, round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from fieldscan.llm import bpe, common, histogram, queries, toxicity, urls, warc

DOCS = "doc_id long, text string, rid long, score string, n int"


# --- URL filter


def plain_url(url):
    if url is None or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    cut = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host, tail = rest[:cut], rest[cut:]
    cut = next((i for i, c in enumerate(tail) if c in "?#"), len(tail))
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in host), tail[:cut]


def plain_rule(host, path):
    best = None
    for rule, allow in queries.URL_RULES:
        name, tail = rule.split("/", 1)
        if (host == name or host.endswith("." + name)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[0])):
            best = rule, allow
    return best


def page_urls():
    good = [f"https://www.h{i}.example.org/en/2{i}" for i in range(60)] + [f"http://a{i}.com/fr/{i}?x=/de/#t" for i in range(60)]
    bad = [f"https://x.example.org/es/{i}" for i in range(60)] + [f"https://B{i}.COM/de/{i}" for i in range(60)]
    odd = [None, "", "no scheme", "://", "://ORG", "http://org/", "http://org", "http://É.Org/é", "http://a.org?x://y/z", "http://example.org/en/1", "http://xorg/",
           "http://example.org/en/", "http://a.net/fr/3", "http://a.net/de/3", "http://u@h.com:80/fr/", "http://com/fr", "http://com/fr/\n://x", "x" * 30_000]
    return good + bad + odd + odd[:4]


def test_urls(spark):
    rows = [(i // 2 if i % 9 else None, u, "x", "clash") for i, u in enumerate(page_urls())]
    schema = "page_id long, url string, host string, verdict string"
    got = urls.judge_urls(spark.createDataFrame(rows, schema).repartition(3), queries.URL_RULES).collect()
    assert len(got) == len(rows)
    want = Counter()
    for i, u, *_ in rows:
        host, path = plain_url(u)
        rule = plain_rule(host, path)
        want[(i, host, path, rule and rule[0], {None: None, True: "allow", False: "block"}[rule and rule[1]])] += 1
    assert Counter((r[0], r[1], r[2], r[3], r["verdict"] if r["rule"] else None) for r in got) == want
    assert all((r["verdict"] == "allow") == (r["score"] >= 0) for r in got if r["rule"] is None)
    ruled = [r for r in got if r["rule"]]
    assert np.mean([(r["verdict"] == "allow") == (r["score"] >= 0) for r in ruled]) > 0.95
    empty = urls.judge_urls(spark.createDataFrame([], schema), queries.URL_RULES)
    assert empty.count() == 0 and empty.columns[:5] == ["page_id", "host", "path", "rule", "verdict"]
    alone = urls.judge_urls(spark.createDataFrame([(1, "http://a.net/", "", "")], schema), []).collect()
    assert [(r["rule"], r["verdict"]) for r in alone] == [(None, "allow")]


def test_markov_models_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(urls, "PIECE", 8)
    texts = [("http://abc.com/a1", True), ("abcabc", True), ("http://abd.com/a22222222222222", False), ("é/é", False), ("abc.com/é", None), ("", True), (None, None), ("abcabc", True)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(texts)], "i long, url string, label boolean").repartition(3).cache()
    model = urls.log_ratios(urls.count_strings(rows, "url", "label"))
    got = {r["i"]: r["ratio"] for r in urls.score_urls(rows, "i", "url", model).collect()}
    longest = urls.ORDER
    padded = [(bytes(longest) + (u or "").encode(), label) for u, label in texts]
    seen = {c: Counter(x[i - k : i + 1] for x, label in padded if label is c for i in range(longest, len(x)) for k in range(longest + 1)) for c in (True, False)}

    def p(c, context, byte):
        shorter = p(c, context[1:], byte) if context else 1 / 256
        after = [n for key, n in seen[c].items() if len(key) == len(context) + 1 and key[:-1] == context]
        return shorter if not after else (seen[c][context + byte] + len(after) * shorter) / (sum(after) + len(after))

    want = {}
    for i, (x, _) in enumerate(padded):
        gains = [np.log(p(True, x[j - longest : j], x[j : j + 1])) - np.log(p(False, x[j - longest : j], x[j : j + 1])) for j in range(longest, len(x))]
        if gains:
            want[i] = pytest.approx(np.mean(gains), abs=1e-5)
    assert got == want


def test_url_models_learn_digits_and_long_contexts(spark):
    made = [(f"http://a{i}.net/item/{(i % 2) * 7:02d}x", i % 2 == 0) for i in range(300)]
    rows = spark.createDataFrame([(i, *t) for i, t in enumerate(made)], "i long, url string, label boolean")
    model = urls.log_ratios(urls.count_strings(rows.withColumn("label", F.expr("if(i < 200, label, null)")), "url", "label"))
    got = urls.score_urls(rows.where("i >= 200"), "i", "url", model).join(rows, "i").collect()
    assert len(got) == 100 and all((r["ratio"] > 0) == r["label"] for r in got)


# --- toxicity

SEED = ("idiot", "stupid", "moron", "scum", "trash", "loser", "clown", "worthless", "pathetic", "disgusting")


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) <= 1
    return any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def test_automaton_against_edit_distance():
    rng = random.Random(2)
    terms = {t: ("strong", 0.0) for t in SEED} | {"=idiom": ("word", 0.0), "^ache": ("stem", 2.0), "=acheter": ("word", 0.0), "=achen": ("word", 3.0)}
    matcher = toxicity.Matcher(terms)
    words = set(SEED) | {"idiom", "ache", "acheter", "achen", "achexyz", "ach", ""}
    for t in SEED:
        for _ in range(150):
            w = list(t)
            for _ in range(rng.randrange(1, 3)):
                i = rng.randrange(len(w) + 1)
                w[i : i + rng.randrange(2)] = rng.choice(["", "x", "1", "o", "s", "é"])
            words.add("".join(w))
    for w in words:
        if w in SEED:
            want = "exact"
        elif w == "achen" or w.startswith("ache") and w != "acheter":
            want = "learned"
        elif w in ("idiom", "acheter"):
            want = None
        else:
            want = "fuzzy" if any(len(t) >= 5 and one_edit(t, w) for t in SEED) else None
        assert (matcher.match(w) or (None,))[0] == want, w


def test_context_separates_quotation():
    matcher = toxicity.Matcher({t: ("strong", 0.0) for t in SEED})
    at = toxicity.FEATURES.index("quoted")
    assert toxicity.features("the teacher said “idiot” is a rude word", matcher, {})[at] > 0
    assert toxicity.features("you are an idiot and they said so", matcher, {})[at] == 0
    assert toxicity.features("what an idi0t", matcher, {})[1] > 0
    assert toxicity.features("", matcher, {}) == [0.0] * len(toxicity.FEATURES)


def toxic_rows(n=1500):
    rng = random.Random(8)
    plain = [a + b for a in ("ka", "lo", "mi", "ter", "su") for b in ("ne", "ro", "pa", "ling", "da", "vo")]
    rows, labels = [], []
    for i in range(n):
        words = [rng.choice(plain) for _ in range(rng.randrange(5, 60))]
        toxic = i % 6 == 0
        if toxic:
            for _ in range(rng.randrange(1, 4)):
                words.insert(rng.randrange(len(words)), rng.choice([*SEED, "stupd", "zargle", "zargling", "zargler"]))
        rows.append((i, " ".join(words), 1, "clash", 0))
        labels.append((i, 1, int(toxic)))
    return rows, labels


def plain_features(text, terms):
    """The features by their definition: edit distance to each term, and windows of words, for each word by itself."""
    low = text.lower()
    found = list(re.finditer(r"\w+", low))
    words = [m.group() for m in found]
    by = {kind: [t for t, (k, _) in terms.items() if k == kind] for kind in ("strong", "firm", "word", "stem")}
    counts, quoted, learned = Counter(), 0, {}
    for i, w in enumerate(words):
        stems = [terms[s][1] for s in by["stem"] if w.startswith(s[1:])]
        if w in by["strong"] or w in by["firm"]:
            kind = "exact"
        elif "=" + w in by["word"]:
            kind = "learned" if terms["=" + w][1] > 0 else None
        elif stems:
            kind = "learned" if max(stems) > 0 else None
        else:
            kind = "fuzzy" if any(len(t) >= toxicity.FUZZY_LEAST and one_edit(t, w) for t in by["strong"]) else None
        if kind is None:
            continue
        lo, hi = max(0, i - toxicity.WINDOW), min(len(words) - 1, i + toxicity.WINDOW)
        near = set(words[lo:i] + words[i + 1 : hi + 1])
        marks = all(any(q in part for q in "\"“”„«»‹›") for part in (low[found[lo].start() : found[i].start()], low[found[i].end() : found[hi].end()]))
        if (marks or near & toxicity.REPORTING) and not near & toxicity.ADDRESS:
            quoted += 1
            continue
        counts[kind] += 1
        if kind == "learned":
            learned[w] = terms["=" + w][1] if "=" + w in terms else max(stems)
    total = sum(counts.values())
    if not total and not quoted:
        return [0.0] * 6
    return [np.log1p(counts["exact"]), np.log1p(counts["fuzzy"]), sum(learned.values()), np.log1p(quoted), float(total > 0), np.log1p(1000 * total / len(words))]


def test_scores_against_a_plain_scorer(spark):
    rows, labels = toxic_rows(900)
    rng = random.Random(5)
    rows = [(i, t + rng.choice(["", " she said", ' "quoted zargle here" ok', " you zargle", " stupd zarglx"]), *rest) for i, t, *rest in rows]
    docs, labelled = spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    sample = toxicity._sample(docs, labelled, "doc_id", "text", "toxic", toxicity.FIT_ROWS)
    terms = toxicity.learn_terms(sample, ("moron",))
    data = sample.toPandas()
    x = np.array([plain_features(t, terms) for t in data["text"]])
    weights = toxicity.fit(x, (data["label"] > 0).to_numpy(float))
    got = {r["doc_id"]: r["score"] for r in toxicity.score_documents(docs, labelled, given=("moron",)).collect()}
    for i, t, *_ in rows:
        z = weights[0] + np.dot(plain_features(t, terms), weights[1:])
        assert abs(got[i] - 1 / (1 + np.exp(-np.clip(z, -30, 30)))) < 1e-6, t


def test_misspelled_learned_terms(spark):
    """A term of any language that only labels teach is caught with an edit; words of clean documents one edit away aren't."""
    rng = random.Random(4)
    plain = ["haus", "baum", "garten", "lampe", "fenster", "regal", "schrank", "teppich"]
    rows, labels = [], []
    for i in range(1200):
        words = [rng.choice(plain) for _ in range(20)]
        if i % 5 == 1:
            words[rng.randrange(20)] = rng.choice(["widerling", "schwachkopf"])
        elif i % 5 == 2:
            words[rng.randrange(20)] = "schwachkop"
        rows.append((i, " ".join(words)))
        labels.append((i, 1, int(i % 5 == 1)))
    rows += [(5000, "haus du widerlinq baum"), (5001, "haus schwachkop baum"), (5002, "haus baum"), (5003, "widerlinqq")]
    out = toxicity.score_documents(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    got = {r["doc_id"]: r["predicted"] for r in out.where("doc_id >= 5000").collect()}
    assert got == {5000: 1, 5001: 0, 5002: 0, 5003: 0}


def test_toxicity(spark, tmp_path):
    rows, labels = toxic_rows()
    rows += [(None, None, None, None, None), (3, "", 1, "", 1), (3, "idiot " * 60_000, 1, "", 1)]
    docs = spark.createDataFrame(rows, DOCS).repartition(3)
    labelled = spark.createDataFrame([*labels, (None, 1, 1), (4, None, None)], "doc_id long, quality int, toxic int")
    out = toxicity.score_documents(docs, labelled).collect()
    assert Counter(r["doc_id"] for r in out) == Counter(r[0] for r in rows)
    truth = {i: t for i, _, t in labels}
    for r in out:
        assert 0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.5)
        assert r["held_out"] == (r["doc_id"] is not None and zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0)
    held = [(truth[r["doc_id"]], r["predicted"]) for r in out if r["held_out"] and r["doc_id"] != 3]
    assert np.mean([a == b for a, b in held]) > 0.97
    # labels of the held-out fold change nothing
    turned = [(i, q, 1 - t if zlib.crc32(str(i).encode()) % 5 == 0 else t) for i, q, t in labels]
    again = toxicity.score_documents(docs, spark.createDataFrame(turned, "doc_id long, quality int, toxic int")).collect()
    key = lambda x: sorted((str(r["doc_id"]), round(r["score"], 9)) for r in x)
    assert key(out) == key(again)
    none = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    assert toxicity.score_documents(spark.createDataFrame([], DOCS), none).count() == 0
    assert toxicity.score_documents(docs.limit(20), none).count() == 20
    docs.write.parquet(f"{tmp_path}/d")
    stored = spark.read.parquet(f"{tmp_path}/d")
    kept = toxicity.drop_toxic(stored, labelled)
    assert kept.columns == stored.columns and kept.count() == sum(r["predicted"] == 0 for r in out)


# --- BPE


@pytest.fixture(scope="module")
def reference():
    import public_tokenizers
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


def hard_texts():
    rng = random.Random(4)
    bits = ["the", "'s", "'", "'re", "!!", " ", "  ", "\n", "\t", "123", "é", "𝔘", "<|endoftext|>", "<|", "==", "　", "中文", "x" * 30, " " * 30, "ab12" * 5, "\r\n", "don't"]
    texts = [None, "", " ", "a" * 5000, " " * 5000, "ab1" * 2000, "'" * 900, "<|endoftext|>" * 200, "x\n" * 2000]
    for _ in range(250):
        some = rng.sample(bits, rng.randrange(1, 6)) if rng.random() < 0.5 else bits
        texts.append("".join(rng.choice(some) for _ in range(rng.randrange(1, 120))))
    return texts


@pytest.mark.parametrize("leaf", [7, 50, 16_384])
def test_bpe(spark, reference, leaf):
    rows = [(i if i % 5 else None, t, 1, "clash", 1) for i, t in enumerate(hard_texts())] + [(1, "same", 1, "", 1)] * 2
    out = bpe.encode(spark.createDataFrame(rows, DOCS).repartition(3), **queries.vocabulary(), leaf_chars=leaf)
    out = out.withColumn("digest", bpe.digest(F.col("ids"))).collect()
    want = Counter()
    for i, t, *_ in rows:
        ids = reference.encode(t or "", add_special_tokens=False).ids
        want[(i, tuple(ids), reference.decode(ids, skip_special_tokens=False), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())] += 1
    assert Counter((r["doc_id"], tuple(r["ids"]), r["decoded"], r["digest"]) for r in out) == want
    assert all(r["n_tokens"] == len(r["ids"]) for r in out)


def test_bpe_edges(spark, reference):
    assert bpe.encode(spark.createDataFrame([], DOCS), **queries.vocabulary()).count() == 0
    every = "".join(chr(c) for c in range(0x2FFFF) if not 0xD800 <= c < 0xE000)
    texts = [every[k : k + 9000] for k in range(0, len(every), 9000)] + [" a".join(every[k : k + 3000]) for k in range(0, len(every), 3000)]
    rows = [(i, t, 0, "", 0) for i, t in enumerate(texts)]
    got = {r["doc_id"]: r["ids"] for r in bpe.encode(spark.createDataFrame(rows, DOCS), **queries.vocabulary(), leaf_chars=4000, decoded=False).collect()}
    differ = [i for i, t in enumerate(texts) if got[i] != reference.encode(t, add_special_tokens=False).ids]
    assert differ == []
    back = bpe.decode(spark.createDataFrame([(1, [15496, 995]), (2, None), (3, [])], "doc_id long, ids array<int>"), **queries.vocabulary()).collect()
    assert [r["decoded"] for r in back] == ["Hello world", None, ""]


# --- token counts


def test_histogram(spark, monkeypatch):
    monkeypatch.setattr(histogram, "RANGE", 8)
    rng = random.Random(6)
    lengths = [rng.choice([0, 3, 7, 8, 40, rng.randrange(200)]) for _ in range(500)] + [100_000]
    df = spark.createDataFrame([(x,) for x in lengths] + [(None,)], "n_tokens long")
    hist = histogram.length_histogram(df)
    lengths.append(0)
    got = {r["length"]: r for r in hist.collect()}
    assert set(got) == set(lengths)
    for k, r in got.items():
        assert r["n_docs"] == lengths.count(k)
        assert (r["docs_ge"], r["tokens_ge"]) == (sum(x >= k for x in lengths), sum(x for x in lengths if x >= k))
        assert (r["docs_le"], r["tokens_le"]) == (sum(x <= k for x in lengths), sum(x for x in lengths if x <= k))
        assert r["truncated_total"] == sum(min(x, k) for x in lengths)
        assert r["share_le"] == r["docs_le"] / len(lengths)
    for q in (0.0, 0.5, 0.99, 1.0):
        k = histogram.length_at(hist, q).first()[0]
        assert sum(x <= k for x in lengths) >= q * len(lengths) and (k == 0 or sum(x < k for x in lengths) < q * len(lengths))
    for r in histogram.truncated_totals(hist, [0, 5, 8, 1000, 10**7]).collect():
        assert (r["docs_over"], r["total"]) == (sum(x > r["limit"] for x in lengths), sum(min(x, r["limit"]) for x in lengths))
    assert histogram.length_histogram(df.limit(0)).count() == 0


def test_token_counts_query(spark, reference):
    import pyarrow.parquet as pq

    folder = "/root/testdata/sf0.001"
    lengths = [len(reference.encode(t or "", add_special_tokens=False).ids) for t in pq.read_table(f"{folder}/documents.parquet").column("text").to_pylist()]
    got = queries.op8_token_counts(spark, folder).collect()
    assert {r["length"]: r["n_docs"] for r in got} == dict(Counter(lengths))
    assert all(r["truncated_total"] == sum(min(x, r["length"]) for x in lengths) for r in got)


# --- WARC

PAGES = "page_id long, url string, html string, n long, digest string"


def test_warc_round_trip(spark, tmp_path):
    bodies = [None, "", "a", "a", "é\r\n\r\nWARC/1.1\r\n", "long\n" * 30_000, "long\n" * 30_000, "x\r\n\r", "hot"] + ["hot"] * 20
    rows = [(i if i != 8 else None, f"http://h/{i}\r\nX: y" if i % 2 else None, b, 1, "clash") for i, b in enumerate(bodies)]
    rows += [(2, "u", "a", 1, "c"), (9, "u", "hot", None, None), (9, "u", "hot", None, None)]
    spark.createDataFrame(rows, PAGES).repartition(4).write.parquet(f"{tmp_path}/p")
    for least in (0, 2):
        path = f"{tmp_path}/w{least}"
        warc.write_archives(spark.read.parquet(f"{tmp_path}/p"), path, revisit_least=least)
        out = warc.read_archives(spark, path).collect()
        assert not [r for r in out if r["problem"]]
        groups: dict = {}
        for i, _, b, *_ in rows:
            groups.setdefault(b or "", []).append(i)
        best = {b: min(i for i in ids if i is not None) for b, ids in groups.items()}
        assert Counter(r["page_id"] and int(r["page_id"]) for r in out) == Counter(r[0] for r in rows)
        for r in out:
            if r["record_type"] == "response":
                assert hashlib.sha1(r["payload"]).digest() == base64.b32decode(r["payload_digest"]) and len(r["payload"]) == r["payload_bytes"]
        by_digest = {base64.b32encode(hashlib.sha1(b.encode()).digest()).decode(): b for b in groups}
        responses = Counter()
        for r in out:
            body = by_digest[r["payload_digest"]]
            assert r["payload_bytes"] == len(body.encode())
            if r["record_type"] == "response":
                responses[body] += 1
                assert r["refers_to"] is None
            else:
                assert int(r["refers_to"]) == best[body] and len(body.encode()) >= least
        assert all(responses[b] == (1 if len(b.encode()) >= least else len(ids)) for b, ids in groups.items())
    warc.write_archives(spark.createDataFrame([], PAGES), f"{tmp_path}/none")
    assert warc.read_archives(spark, f"{tmp_path}/none").count() == 0


def record(body, digest=True):
    mark = f"WARC-Block-Digest: sha1:{base64.b32encode(hashlib.sha1(body).digest()).decode()}\r\n" if digest else ""
    return b"WARC/1.0\r\nWARC-Type: resource\r\n" + mark.encode() + b"Content-Length: %d\r\n\r\n" % len(body) + body + b"\r\n\r\n"


def test_salvage(spark, tmp_path):
    rng = random.Random(9)
    for trial in range(150):
        bodies = [bytes(rng.randrange(256) for _ in range(rng.randrange(400))) for _ in range(6)]
        parts = [record(b) if rng.random() < 0.5 else gzip.compress(record(b), mtime=0) for b in bodies]
        hurt = rng.randrange(6)
        x = bytearray(parts[hurt])
        kind = rng.choice(["flip", "cut", "insert", "none"])
        if kind == "flip":
            x[rng.randrange(len(x))] ^= 1 << rng.randrange(8)
        elif kind == "cut":
            del x[rng.randrange(len(x)) :]
        elif kind == "insert":
            k = rng.randrange(len(x))
            x[k:k] = b"??"
        parts[hurt] = bytes(x)
        data = b"".join(parts)
        found = list(warc.salvage(data))
        assert [a for a, *_ in found] + [len(data)] == [0, *(b for _, b, *_ in found)]
        good = [block for *_, problem, _, block in [(a, b, p, f, k) for a, b, p, f, k in found] if problem is None]
        assert all(b in good for i, b in enumerate(bodies) if i != hurt)
        if kind == "none":
            assert good == bodies
    (tmp_path / "a.warc").write_bytes(record(b"one") + b"garbage" + record(b"two") + record(b"three")[:-9])
    log = warc.quarantined(warc.read_archives(spark, f"file://{tmp_path}")).orderBy("start").collect()
    n = len(record(b"one"))
    assert [(r["start"], r["end"]) for r in log][0] == (n, n + 7) and len(log) == 2


def test_url_models_are_not_broadcast(spark):
    """The model grows with the URLs, and its rows are far larger than their files; a broadcast passes through the driver."""
    pages = spark.createDataFrame([(i, f"http://{'good' if i % 2 else 'bad'}{i}.example/{i}") for i in range(40)], "page_id long, url string")
    strings = common.cut(urls.count_strings(pages.withColumn("label", F.col("page_id") % 2 == 1), "url", "label"))
    model = urls.log_ratios(strings)
    scored = urls.score_urls(pages, "page_id", "url", common.cut(model))
    judged = urls.judge_urls(pages, [("example/", True)])
    assert scored.count() == judged.count() == 40
    for df in (model, scored, judged):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()

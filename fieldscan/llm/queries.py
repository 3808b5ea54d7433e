"""Queries over the driver's tables, one for each operator, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, decontam, exact_dedup, histogram, line_dedup, merkle, near_dedup, periodic, secrets, sharding, toxicity, urls, warc
from .common import scratch_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: Rules of the URL filter: host and path, and whether they allow.
URL_RULES = [("org/", True), ("example.org/es/", False), ("example.org/en/1", False), ("com/fr/", True), ("com/de/", False)]
SPECIAL = {"<|endoftext|>": 50256}


def vocabulary() -> dict:
    """Place and pattern of the public byte-level vocabulary, its special string, as parameters of the coder."""
    import public_tokenizers

    return {"vocabulary_path": public_tokenizers.path("byte_bpe_50k.tiktoken"), "pattern": public_tokenizers.PATTERN, "special": SPECIAL}


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)


def op2_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.find_secrets(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"] < len(secrets.STRONG))

    def count(i: int) -> Column:
        return F.size(F.filter("spans", lambda s: s["kind"] == i)).cast("long")

    counts = [count(i).alias(f"n_{k}") for i, k in enumerate(secrets.STRONG)]
    return found.select(
        "doc_id", *counts, F.sha2(secrets.span_text(base), 256).alias("base_sha256"), secrets.span_text(F.col("spans")).alias("spans")
    )


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents")).drop("rid")


def op4_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = sharding.assign_shards(table(spark, sf_dir, "documents"), shards=40)
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


def op5_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_classes(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")).drop("rid")


def op7_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe.encode(table(spark, sf_dir, "documents"), **vocabulary())
    return coded.select("doc_id", "n_tokens", bpe.digest(F.col("ids")).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return histogram.length_histogram(bpe.encode(table(spark, sf_dir, "documents"), **vocabulary(), ids=False, decoded=False))


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages, path = table(spark, sf_dir, "pages"), scratch_path(spark, "warc")
    warc.write_archives(pages, path)
    records = warc.read_archives(spark, path, payload=False).where("problem is null")
    kind = pages.schema["page_id"].dataType
    return records.select(
        F.col("page_id").cast(kind).alias("page_id"), "payload_bytes", "payload_digest", "record_type", F.col("refers_to").cast(kind).alias("refers_to")
    )


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontam.find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark")).drop("rid")


def op11_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    fields = [F.col(c) for c in ("doc_id", "source", "lang", "n_chars", "text")]
    tampered = F.crc32(F.col("doc_id").cast("string")) % 7 == 0
    changed = F.when(tampered, merkle.leaf_digest(*fields[:3], F.col("n_chars") + 1, fields[4]))
    leaves = docs.select("doc_id", "lang", merkle.leaf_digest(*fields).alias("leaf"), F.unhex(changed).alias("shown"))
    rows, root = merkle.proofs(leaves, "doc_id", "lang", "leaf")
    n, steps = merkle.n_steps(F.col("steps")), F.col("steps")
    rows = rows.withColumn("subroot", merkle.fold(F.col("leaf"), steps, 0, F.col("subroot_at")))
    honest, other = merkle.fold(F.col("subroot"), steps, F.col("subroot_at"), n), merkle.fold(F.lower(F.hex("shown")), steps, 0, n)
    out = rows.select(
        "doc_id", "leaf", "subroot", F.lit(root).cast("string").alias("root"), F.sha2(merkle.siblings(steps), 256).alias("proof_sha256"),
        F.when(F.col("shown").isNull(), honest).otherwise(other).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup.drop_repeated_lines(table(spark, sf_dir, "documents"), least_docs=10, least_chars=1)
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def repeated_part(docs: DataFrame) -> DataFrame:
    """(doc_id, text) in which every tenth document, by the CRC-32 of its id, repeats its words from some place on."""
    h = F.crc32(F.col("doc_id").cast("string"))
    words = F.filter(F.split(F.coalesce("text", F.lit("")), "[\\x20\\x09-\\x0D]+"), lambda w: w != "")
    rows = docs.select("doc_id", "text", h.alias("h"))
    plain = rows.where("h is null or h % 10 != 0").select("doc_id", "text")
    rows = rows.where("h % 10 = 0").withColumns({"w": words, "g": F.expr("h div 10")}).withColumn("n", F.size("w"))
    rows = rows.withColumn("a", F.expr("CASE WHEN n > 0 THEN cast(g % n as int) END")).withColumn("p", F.expr("cast(1 + (n - a) div (3 + g % 8) as int)"))
    again = F.expr("CASE WHEN n > 0 THEN array_join(transform(w, (x, i) -> CASE WHEN i < a THEN x ELSE w[a + (i - a) % p] END), ' ') ELSE '' END")
    return plain.unionByName(rows.select("doc_id", again.alias("text")))


def op13_periodic(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = periodic.periodic_runs(repeated_part(table(spark, sf_dir, "documents")), least=6, times=4)
    found = found.withColumn("most", F.expr("array_max(transform(runs, r -> struct(r.length, -r.start AS s, -r.period AS p)))"))
    every = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", *[r[c].cast("string") for c in periodic.RUN]), F.lit("\n"))), "")
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), (-F.col("most.s")).alias("start"), F.col("most.length").alias("length"), (-F.col("most.p")).alias("period"),
        F.expr("1000 * most.length div -most.p").alias("exponent_milli"), F.sha2(every, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


QUERIES = {
    "op1_url_filter": op1_url_filter,
    "op2_secret_scan": op2_secret_scan,
    "op3_exact_dedup": op3_exact_dedup,
    "op4_sharding": op4_sharding,
    "op5_near_dedup": op5_near_dedup,
    "op6_toxicity": op6_toxicity,
    "op7_bpe": op7_bpe,
    "op8_token_counts": op8_token_counts,
    "op9_warc": op9_warc,
    "op10_decontamination": op10_decontamination,
    "op11_merkle": op11_merkle,
    "op12_line_dedup": op12_line_dedup,
    "op13_periodic": op13_periodic,
}


def _secrets_sql() -> str:
    """Strong matches and weak candidates by DuckDB's regular expressions, linked by a range frame."""
    one = []
    for i, (kind, pattern) in enumerate({**secrets.STRONG, **secrets.WEAK}.items()):
        pattern = pattern.replace("'", "''")
        ok = "true"
        if kind == "assign":
            ok = f"list_transform(regexp_extract_all(t, '{pattern}', 2), lambda g: length(g) >= {secrets.ASSIGN_LEAST})[i]"
        elif kind == "blob":
            ok = "regexp_matches(m[i], '[0-9]') AND regexp_matches(m[i], '[A-Z]') AND regexp_matches(m[i], '[a-z]')"
        one.append(
            f"SELECT rid, {i} AS kind, i, length(m[i]) AS len, length(p[i]) AS gap, {ok} AS ok FROM (SELECT rid, t, m, p, unnest(range(1, len(m) + 1)) AS i"
            f" FROM (SELECT rid, t, regexp_extract_all(t, '{pattern}', 0) AS m, string_split_regex(t, '{pattern}') AS p FROM d) WHERE len(m) > 0)"
        )
    scope = f"OVER (PARTITION BY rid ORDER BY start RANGE BETWEEN {secrets.SCOPE} PRECEDING AND {secrets.SCOPE} FOLLOWING)"
    names = "['" + "', '".join(secrets.KINDS) + "'][kind + 1]"
    text = f"string_agg({names} || ':' || start || ':' || stop, ',' ORDER BY start, kind)"
    return f"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t FROM documents),
raw AS ({" UNION ALL ".join(one)}),
placed AS (SELECT *, sum(gap + len) OVER (PARTITION BY rid, kind ORDER BY i) AS stop FROM raw),
fit AS (SELECT rid, kind, CAST(stop - len AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM placed WHERE ok),
near AS (SELECT *, bool_or(kind IN (1, 3)) {scope} AS who, bool_or(kind IN (0, 2, 4)) {scope} AS what, bool_or(kind = 5) {scope} AS wher FROM fit),
free AS (SELECT n.* FROM near n WHERE kind < 3 OR NOT EXISTS (
  SELECT 1 FROM fit s WHERE s.rid = n.rid AND s.kind < 3 AND s.start < n.stop AND s.stop > n.start)),
kept AS (SELECT * FROM free WHERE kind < 3 OR (kind = 3 AND what) OR (kind = 4 AND (who OR wher)) OR (kind = 5 AND who AND what)),
by_row AS (SELECT rid, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS b, count(*) FILTER (kind = 2) AS c,
  {text} FILTER (kind < 3) AS base, {text} AS spans FROM kept GROUP BY rid)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(b, 0) AS n_access, coalesce(c, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN by_row USING (rid)"""


def leaks_sql(docs: str) -> str:
    """Leaks of the benchmark in the table or subquery ``docs`` (doc_id, rid, text): CTEs that end in ``leaks``."""
    d, w = decontam, decontam.WINDOW
    anywhere, inside = r"(^|[^\p{L}\p{N}])", r"([\p{L}\p{N},;:] )"

    def marked(text: str, before: str | None) -> str:
        named = text
        for _ in range(2 if before else 0):  # without a look back, every second name of a run is left to the second pass
            named = f"regexp_replace({named}, '{before}(\\p{{Lu}}\\p{{Ll}}+)', '\\1{d.MARK}name\\2', 'g')"
        digits = f"regexp_replace({named}, '([0-9])[.,]([0-9])', '\\1{d.POINT}\\2', 'g')"
        united = f"regexp_replace({digits}, '([0-9]) ?({d.UNITS})\\b', '\\1 {d.MARK}unit\\2', 'g')"
        numbered = f"regexp_replace({united}, '([0-9][0-9{d.POINT}]*)', ' {d.MARK}num\\1 ', 'g')"
        return f"CASE WHEN regexp_matches({text}, '[0-9]') THEN {numbered} ELSE {named} END"

    def windows(source: str, keys: str, before: str | None = anywhere) -> str:
        return f"""SELECT {keys}, i, v[i:i + {w - 1}] AS vals, list_transform(v[i:i + {w - 1}], lambda x:
    CASE WHEN starts_with(x, '{d.MARK}') THEN regexp_extract(x, '{d.MARK}(num|name|unit)') ELSE lower(x) END) AS words
  FROM (SELECT {keys}, v, unnest(range(1, len(v) - {w - 2})) AS i FROM (SELECT {keys},
    list_filter(string_split_regex({marked("coalesce(text, '')", before)}, '{d.SPLIT}'), lambda x: x <> '') AS v FROM {source}))"""

    literals = f"len(list_filter(words, lambda x: NOT starts_with(x, '{d.MARK}')))"
    return f"""parts AS (SELECT row_number() OVER () AS part, item_id, text FROM benchmark),
base AS (SELECT part, i, item_id, vals, words, words AS wd FROM ({windows("parts", "part, item_id")}) WHERE {literals} >= {d.LITERALS}),
item_windows AS (SELECT item_id, wd, words, vals FROM base
  UNION SELECT b.item_id, b.wd, f.words, f.vals FROM base b JOIN ({windows("parts", "part", inside)}) f USING (part, i)
  UNION SELECT b.item_id, b.wd, f.words, f.vals FROM base b JOIN ({windows("parts", "part", None)}) f USING (part, i)),
asked AS (SELECT DISTINCT words FROM item_windows),
seen AS (SELECT DISTINCT rid, doc_id, words, vals FROM ({windows(docs, "rid, doc_id")}) SEMI JOIN asked USING (words)),
sizes AS (SELECT DISTINCT item_id, wd, words FROM item_windows),
of_item AS (SELECT item_id, count(DISTINCT wd) AS windows FROM sizes GROUP BY 1),
cover AS (SELECT rid, doc_id, item_id, count(DISTINCT wd) AS covered FROM (SELECT DISTINCT rid, doc_id, words FROM seen) JOIN sizes USING (words) GROUP BY ALL),
pairs AS (SELECT * FROM cover JOIN of_item USING (item_id) WHERE covered >= {d.SHARE} * windows),
slots AS (SELECT rid, item_id, unnest(i.vals) AS a, unnest(s.vals) AS b FROM (SELECT DISTINCT item_id, words, vals FROM item_windows) i
  JOIN seen s USING (words) SEMI JOIN pairs USING (rid, item_id)),
votes AS (SELECT rid, item_id, a, b, count(*) AS n FROM slots WHERE starts_with(a, '{d.MARK}') GROUP BY ALL),
most AS (SELECT rid, item_id, a, max(n) AS most, sum(n) AS every FROM votes GROUP BY ALL),
agreed AS (SELECT rid, item_id, CAST(sum(most) AS DOUBLE) / CAST(sum(every) AS DOUBLE) AS agreed FROM most GROUP BY ALL),
leaks AS (SELECT rid, doc_id, item_id, covered, windows, coalesce(agreed, 1) AS agreement FROM pairs LEFT JOIN agreed USING (rid, item_id)
  WHERE coalesce(agreed, 1) >= {d.AGREE})"""


def _merkle_sql() -> str:
    """Levels and folds as recursive queries: each round makes the next level of all trees of more than one node."""

    def leaf(n_chars: str) -> str:
        fields = ["doc_id", "source", "lang", n_chars, "text"]
        return "sha256(" + " || ".join(f"coalesce(strlen(CAST({f} AS VARCHAR)) || ':' || CAST({f} AS VARCHAR), '-')" for f in fields) + ")"

    def levels(name: str, leaves: str) -> str:
        return f"""{name} AS (SELECT t, 0 AS level, pos, h, n FROM {leaves}
  UNION ALL SELECT t, level + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (any_value(n) + 1) // 2 FROM {name} WHERE n > 1 GROUP BY t, level, pos // 2)"""

    def fold(name: str, start: str, nodes: str) -> str:
        up = lambda h: f"sha256(CASE WHEN s.h IS NULL THEN f.{h} WHEN f.pos % 2 = 1 THEN s.h || f.{h} ELSE f.{h} || s.h END)"
        return f"""{name} AS (SELECT rid, t, 0 AS level, pos, n, h, other, sibs FROM {start}
  UNION ALL SELECT f.rid, f.t, f.level + 1, f.pos // 2, (f.n + 1) // 2, {up("h")}, {up("other")}, f.sibs || coalesce(s.h, '')
  FROM {name} f LEFT JOIN {nodes} s ON s.t = f.t AND s.level = f.level AND s.pos = xor(f.pos, 1) WHERE f.n > 1)"""

    step = "xor(x >> 1, (x & 1) * 3988292384)"  # of CRC-32, for one bit
    crc = f"list_reduce(list_prepend(4294967295, list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))), lambda c, b: list_reduce(list_prepend(xor(c, b), [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, y: {step}))"
    return f"""WITH RECURSIVE d AS (SELECT row_number() OVER () AS rid, doc_id, lang, {leaf("n_chars")} AS h,
  CASE WHEN xor({crc}, 4294967295) % 7 = 0 THEN {leaf("n_chars + 1")} ELSE {leaf("n_chars")} END AS other FROM documents),
l AS (SELECT rid, doc_id, h, other, '' AS sibs, dense_rank() OVER (ORDER BY encode(lang) NULLS FIRST) - 1 AS t,
  row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, count(*) OVER (PARTITION BY lang) AS n FROM d),
{levels("low", "l")},
{fold("up", "l", "low")},
subs AS (SELECT 0 AS t, t AS pos, h, count(*) OVER () AS n FROM low WHERE n = 1),
{levels("high", "subs")},
reached AS (SELECT up.rid, 0 AS t, up.t AS pos, subs.n, up.h, up.other, up.sibs FROM up JOIN subs ON subs.pos = up.t WHERE up.n = 1),
{fold("over", "reached", "high")}
SELECT l.doc_id, l.h AS leaf, subs.h AS subroot, o.h AS root, sha256(o.sibs) AS proof_sha256, o.other AS folded_root, o.other = o.h AS verified
FROM l JOIN subs ON subs.pos = l.t JOIN over o ON o.rid = l.rid AND o.n = 1"""


ORACLE_SQL = {
    "op10_decontamination": f"""WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents),
{leaks_sql("numbered")}
SELECT doc_id, item_id, covered, windows, agreement FROM leaks""",
    "op2_secret_scan": _secrets_sql(),
    "op11_merkle": _merkle_sql(),
    "op12_line_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
l AS (SELECT rid, doc_id, unnest(range(1, len(a) + 1)) AS i, unnest(a) AS line FROM d),
k AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
often AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT rid) >= 10),
m AS (SELECT rid, doc_id, i, line, key IN (SELECT key FROM often) AS gone FROM k)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (gone) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY rid, doc_id""",
    "op3_exact_dedup": """
WITH d AS (SELECT row_number() OVER () AS rid, doc_id,
  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id DESC NULLS LAST, rid) = 1 AS kept, sha256(t) AS text_sha256 FROM d""",
    "op9_warc": f"""
WITH p AS (SELECT row_number() OVER () AS rid, page_id, coalesce(html, '') AS t FROM pages),
h AS (SELECT *, sha1(t) AS x, row_number() OVER (PARTITION BY t ORDER BY page_id NULLS LAST, rid) AS k,
  first_value(page_id) OVER (PARTITION BY t ORDER BY page_id NULLS LAST, rid) AS first_id FROM p)
SELECT page_id, strlen(t) AS payload_bytes, list_aggregate(list_transform(range(0, 32), lambda i: substr('{warc.BASE32}',
    (((('0x' || substr(x, (i // 4) * 5 + 1, 5))::INT) >> (15 - 5 * (i % 4))) & 31)::INT + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN k = 1 THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN k > 1 THEN first_id END AS refers_to FROM h""",
}

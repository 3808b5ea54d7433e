"""Secrets in text, with multipart credentials linked by an interval join.

Strong kinds (assign, access, hex) are reported wherever they stand. Weak candidates (ident: a user or client name,
blob: a random-looking token, endpoint: a service address) say little alone; each is reported only if the parts that
complement it start within ``scope`` characters of it in the same document. That interval join is a range frame over
the parts in text order: linear in the parts, without their pairs.

All work is in DataFrame expressions. Parts, not texts, are shuffled, once, by row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import text_or_empty

#: The three strong patterns and the shortest length of group (assign) or match. A run of [0-9a-f] or of
#: [A-Z0-9] that is too short can't hold a longer one, so their length stands in the pattern.
STRONG = {
    "assign": r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
    "access": r"AKIA[A-Z0-9]{12,}",
    "hex": r"[0-9a-f]{32,}",
}
ASSIGN_LEAST = 8
WEAK = {
    "ident": r"""(?i)\b(?:user_?name|user|login|account_?id|client_?id|key_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9._@-]{3,}""",
    "blob": r"[A-Za-z0-9+/_-]{20,}",
    "endpoint": r"""(?:https?|jdbc|amqps?|redis|postgresql|postgres|mysql|mongodb|s3)://[A-Za-z0-9._~:/?#@!$&()*+,;=%-]+""",
}
KINDS = [*STRONG, *WEAK]
SCOPE = 200
#: What a text must contain for the pattern to match at all; a byte search that spares most texts the pattern.
NEEDS = {"assign": (":", "="), "access": ("AKIA",), "ident": (":", "="), "endpoint": ("://",)}


def _parts(text: Column, kind: str) -> Column:
    """Array of (kind number, index, length of the gap before, length of the match, fits) for the matches of a kind."""
    pattern = F.lit(STRONG.get(kind) or WEAK[kind])
    found = F.regexp_extract_all(text, pattern, F.lit(0))
    fits = F.transform(found, lambda m: F.lit(True))
    if kind == "assign":
        fits = F.transform(F.regexp_extract_all(text, pattern, F.lit(2)), lambda g: F.length(g) >= ASSIGN_LEAST)
    elif kind == "blob":
        fits = F.transform(found, lambda m: m.rlike("[0-9]") & m.rlike("[A-Z]") & m.rlike("[a-z]"))
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), found.alias("m"), fits.alias("ok"))
    made = F.transform(
        F.slice(zipped, 1, F.size(found)),
        lambda z, i: F.struct(
            F.lit(KINDS.index(kind)).alias("kind"), i.alias("at"), F.length(z["gap"]).alias("gap"), F.length(z["m"]).alias("len"), z["ok"].alias("ok")
        ),
    )
    none = F.array().cast("array<struct<kind:int,at:int,gap:int,len:int,ok:boolean>>")
    needs = [text.contains(x) for x in NEEDS.get(kind, ())]
    has = needs[0] if needs else text.rlike(STRONG.get(kind) or WEAK[kind])
    for x in needs[1:]:
        has = has | x
    return F.when(has, made).otherwise(none)


def find_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", scope: int = SCOPE) -> DataFrame:
    """One row per document: ``doc_id`` and ``spans``, an array of (start, kind number, end) in text order.

    Places count code points; ends are exclusive. ``KINDS`` has the kinds by number. Null text counts as empty; an empty
    table gives no rows; rows that repeat an id are scanned each for itself. A weak span that overlaps a strong one is
    left out. Matches of one kind don't overlap.
    """
    text = text_or_empty(F.col(text_col))
    rows = docs.select(
        F.monotonically_increasing_id().alias("rid"), F.col(id_col).alias("doc_id"), F.concat(*[_parts(text, k) for k in KINDS]).alias("parts")
    )
    parts = rows.select("rid", "doc_id", F.explode_outer("parts").alias("p")).select("rid", "doc_id", "p.*").repartition("rid")
    end = F.sum(F.col("gap") + F.col("len")).over(W.partitionBy("rid", "kind").orderBy("at").rowsBetween(W.unboundedPreceding, 0))
    # a match that doesn't fit has moved the places behind it; now it only stands for its row, so that no row is lost
    parts = parts.withColumn("end", end).withColumn("start", F.when(F.col("ok"), F.col("end") - F.col("len")))
    parts = parts.withColumn("kind", F.when(F.col("ok"), F.col("kind")))

    def is_kind(*names: str) -> Column:
        return F.col("kind").isin([KINDS.index(k) for k in names])

    near = W.partitionBy("rid").orderBy("start").rangeBetween(-scope, scope)
    one = F.lit(1)
    ahead = W.partitionBy("rid").orderBy("start", "kind").rowsBetween(W.unboundedPreceding, -1)
    behind = W.partitionBy("rid").orderBy(F.desc("start"), F.desc("kind")).rowsBetween(W.unboundedPreceding, -1)
    strong = is_kind(*STRONG)
    linked = (
        parts.withColumn("who", F.max(F.when(is_kind("access", "ident"), one)).over(near))
        .withColumn("what", F.max(F.when(is_kind("assign", "hex", "blob"), one)).over(near))
        .withColumn("where", F.max(F.when(is_kind("endpoint"), one)).over(near))
        .withColumn("reach", F.max(F.when(strong, F.col("end"))).over(ahead))
        .withColumn("next", F.min(F.when(strong, F.col("start"))).over(behind))
    )
    clear = (F.coalesce("reach", F.lit(0)) <= F.col("start")) & (F.col("next").isNull() | (F.col("next") >= F.col("end")))
    has = {k: F.col(k).isNotNull() for k in ("who", "what", "where")}
    weak = clear & (
        (is_kind("ident") & has["what"]) | (is_kind("blob") & (has["who"] | has["where"])) | (is_kind("endpoint") & has["who"] & has["what"])
    )
    span = F.when(strong | weak, F.struct(F.col("start").cast("long").alias("start"), "kind", F.col("end").cast("long").alias("end")))
    return linked.groupBy("rid", "doc_id").agg(F.sort_array(F.collect_list(span)).alias("spans")).drop("rid")


def span_text(spans: Column) -> Column:
    """Spans as ``kind:start:end``, comma-joined."""
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", names[s["kind"]], s["start"], s["end"])), ",")

"""Benchmark decontamination by template canonicalisation.

Numbers, names and units become typed placeholders, so a question whose parameters were changed keeps its template. In
documents every capitalised word is a name, also the first of a sentence. A benchmark item has up to three forms: with
all capitalised words as names, with those inside sentences only, and with none, so that copies match that begin in the
middle of a sentence or are in lower case.
Windows of ``WINDOW`` template words are joined by hash with those of the benchmark. A document leaks an item if it has
``SHARE`` of the item's windows and the slots agree: one value of the item always stands where one value of the
document stands. Where they disagree over the whole document, which may have the template several times with other
values, each occurrence is judged by itself.

Only documents that hold one of an item's rarest windows, of which fewer than those may be missing, are paired with it,
so a window that many items and documents share pairs none of them.

All work is in DataFrame expressions. Documents are read once; only windows that the benchmark has leave a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import cut, many, numbered, text_or_empty

WINDOW = 5
SHARE = 0.8
#: Words of a window that are no placeholders, at least.
LITERALS = 3
AGREE = 0.8
#: Windows of all items, repeats included, up to which tables made of them are broadcast (tens of MB); beyond, both sides are shuffled.
BROADCAST_ROWS = 300_000

#: Fixed values. The marks are letters that no usual text has, so they stay inside a word.
MARK, POINT = "ǃ", "ǀ"
UNITS = "km|kg|cm|mm|mg|ml|hours|hour|minutes|minute|seconds|second|days|day|weeks|week|months|month|years|year|miles|mile|meters|metres|meter|metre|feet|foot|inches|inch|pounds|pound|dollars|dollar|euros|euro|cents|cent|percent|litres|liters|litre|liter|grams|gram|degrees|degree|m|g|s|h|l"
#: A name is a capitalised word, anywhere or inside a sentence only; the look back comes after the capital, which few places have.
ANYWHERE = r"\p{Lu}(?<![\p{L}\p{N}]\p{Lu})\p{Ll}+"
INSIDE = r"\p{Lu}(?<=[\p{L}\p{N},;:] \p{Lu})\p{Ll}+"
SLOT = MARK + r"(num|name|unit)[\p{L}\p{N}]*"
SPLIT = r"[^\p{L}\p{N}]+"


def annotated(text: Column, name: str | None = ANYWHERE) -> Column:
    """The text with its slots marked: each begins with MARK and its type and keeps its value, in one word.

    ``name`` is the pattern of names; None marks none.
    """
    named = text if name is None else F.regexp_replace(text, name, MARK + "name$0")
    digits = F.regexp_replace(named, r"([0-9])[.,]([0-9])", "$1" + POINT + "$2")
    united = F.regexp_replace(digits, rf"([0-9]) ?({UNITS})\b", "$1 " + MARK + "unit$2")
    numbered = F.regexp_replace(united, rf"[0-9][0-9{POINT}]*", " " + MARK + "num$0 ")
    return F.when(text.rlike("[0-9]"), numbered).otherwise(named)


def _windows(rows: DataFrame, name: str | None = ANYWHERE, places: str | None = None) -> DataFrame:
    """``rows`` with a text ``text`` to its windows: kept columns, marked (the whole text), template (its words), pos and h.

    What stands before the first word or behind the last one leaves an empty word there. ``places`` names a column with
    the only places to take, if there is one.
    """
    keep = [c for c in rows.columns if c not in ("text", places)]
    asked = [F.col(places)] if places else []
    marked = rows.select(*keep, *asked, annotated(text_or_empty(F.col("text")), name).alias("marked"))
    low = F.lower("marked")
    stripped = F.when(F.col("marked").contains(MARK), F.regexp_replace(low, SLOT, MARK + "$1")).otherwise(low)
    words = marked.select(*keep, *asked, "marked", F.split(stripped, SPLIT, -1).alias("template")).where(F.size("template") >= WINDOW)
    # words are hashed once; windows are then made of hashes in generated code, as a lambda for each would be slow
    hashed = words.select(*keep, *asked, "marked", "template", F.transform("template", lambda w: F.xxhash64(w)).alias("hashes"))
    if places:
        each = hashed.select(*keep, "marked", "template", "hashes", F.explode(places).alias("pos")).withColumn("first", F.get("hashes", F.col("pos")))
    else:
        each = hashed.select(*keep, "marked", "template", "hashes", F.posexplode("hashes").alias("pos", "first"))
    rest = [F.get("hashes", F.col("pos") + k) for k in range(1, WINDOW)]
    full = each.where(F.col("pos") <= F.size("hashes") - WINDOW)
    return full.select(*keep, "marked", "template", "pos", F.xxhash64("first", *rest).alias("h"))


def _cut_out(found: DataFrame, keep: list[str]) -> DataFrame:
    """Windows with their place and words, and in the same places the words with the values of slots."""
    at = F.col("pos") + 1
    cut_out = found.select(*keep, "h", "marked", "pos", F.slice("template", at, WINDOW).alias("words"))
    values = F.when(_literals(F.col("words")) == WINDOW, F.col("words")).otherwise(F.slice(F.split("marked", SPLIT, -1), at, WINDOW))
    return cut_out.select(*keep, "pos", "h", "words", values.alias("values"))


def _literals(words: Column) -> Column:
    return F.size(F.filter(words, lambda w: ~w.startswith(MARK)))


def _agreements(matches: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, agreed`` of the windows (item_values, values) with slots: the share of places that have the usual value."""
    slots = matches.select(*keys, F.explode(F.arrays_zip("item_values", "values")).alias("slot"))
    slots = slots.where(F.col("slot.item_values").startswith(MARK))
    votes = slots.groupBy(*keys, F.col("slot.item_values").alias("a"), F.col("slot.values").alias("b")).count()
    most = votes.groupBy(*keys, "a").agg(F.max("count").alias("most"), F.sum("count").alias("all"))
    return most.groupBy(*keys).agg((F.sum("most").cast("double") / F.sum("all")).alias("agreed"))


def _best_occurrences(matches: DataFrame) -> DataFrame:
    """``pair, agreement, covered`` of the best occurrence of each pair that has one with SHARE and AGREE.

    ``matches`` (pair, windows, part, span, window, place, pos, item_values, values) are windows of an item's text
    ``part`` that stand in the document. The difference of both places is constant along a copy and shifts where words
    were put in or left out. Each difference that occurs is tried: every window of the item takes the match that is
    nearest to it, less than the item's ``span`` away, so a copy behind this one lends it nothing.
    """
    shifted = matches.withColumn("shift", F.col("pos") - F.col("place"))
    near = shifted.withColumn("cell", F.floor(F.col("shift") / F.col("span")))
    anchors = near.select("pair", "part", F.col("shift").alias("anchor"), "cell").distinct()
    anchors = anchors.select("pair", "part", "anchor", F.explode(F.array(F.col("cell") - 1, F.col("cell"), F.col("cell") + 1)).alias("cell"))
    occurrence = ["pair", "part", "anchor"]
    away = F.abs(F.col("shift") - F.col("anchor"))
    met = near.join(anchors, ["pair", "part", "cell"]).where(away < F.col("span"))
    row = F.struct(away.alias("away"), "shift", "windows", "window", "item_values", "values")
    taken = met.groupBy(*occurrence, "place").agg(F.min(row).alias("x")).select(*occurrence, "x.*")
    sizes = taken.groupBy(*occurrence).agg(F.countDistinct("window").alias("covered"), F.first("windows").alias("windows"))
    enough = sizes.where(F.col("covered") >= SHARE * F.col("windows"))
    taken = cut(taken.join(enough.select(*occurrence, "covered"), occurrence), "leak-occurrences")
    judged = taken.select(*occurrence, "covered").distinct().join(_agreements(taken, occurrence), occurrence, "left")
    judged = judged.withColumn("agreement", F.coalesce("agreed", F.lit(1.0))).where(F.col("agreement") >= AGREE)
    return judged.groupBy("pair").agg(F.max(F.struct("agreement", "covered")).alias("x")).select("pair", "x.*")


def find_leaks(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    rid: str | None = None,
) -> DataFrame:
    """One row per leak: ``rid`` (the document's number, or what the column ``rid`` holds), ``doc_id, item_id, covered, windows, agreement``.

    ``covered`` of the item's distinct ``windows`` stand in the document; ``agreement`` is the share of slot places where
    the document's value is the usual one for the item's value (1 without slots). Both are of the whole document if it
    agrees as a whole, else of its best occurrence; copies that are each torn apart by more words than the item has are
    judged as a whole only. Items of fewer than WINDOW words, or
    with none of LITERALS literal words in a window, identify no passage and match nothing; so do null and empty texts.
    Items that repeat an id count as one item. Repeated documents are judged each; empty tables give no rows.
    """
    asked = benchmark.select(F.monotonically_increasing_id().alias("part"), F.col(item_col).alias("item_id"), F.col(item_text_col).alias("text"))
    known = (_literals(F.col("words")) >= LITERALS) & ~F.array_contains("words", "")
    # null ids are items, too: they get a key of their own
    base = _cut_out(_windows(asked), ["part", "item_id"]).where(known).withColumn("item", F.struct("item_id")).drop("item_id")
    place = F.struct("part", "pos")
    base = cut(base.withColumn("window", F.min(place).over(W.partitionBy("item", "h", "words"))), "item-windows")
    # marks of names don't move words, so a window's other forms stand in the same place
    forms = [_cut_out(_windows(asked, name), ["part"]).join(base.select("part", "pos", "item", "window"), ["part", "pos"]) for name in (INSIDE, None)]
    columns = ["part", "pos", "item", "window", "h", "words", "values"]
    items = cut(base.select(*columns).unionByName(forms[0].select(*columns)).unionByName(forms[1].select(*columns)).distinct(), "item-forms")
    # every table that is made of items has no more rows than it, and a row is a few words
    few = items.count() <= BROADCAST_ROWS

    def small(df: DataFrame) -> DataFrame:
        return F.broadcast(df) if few else df

    number = F.monotonically_increasing_id() if rid is None else F.col(rid)
    rows = docs.select(number.alias("rid"), F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    asked = items.select(F.col("h").alias("item_h"), F.col("words").alias("item_words")).distinct()
    words = F.slice("template", F.col("pos") + 1, WINDOW)
    # the words are compared behind an "or", so that the join's key is the hash alone
    same = (F.col("h") == F.col("item_h")) & ((words == F.col("item_words")) | (F.size("template") < 0))
    if few:
        found = _windows(rows).join(F.broadcast(asked), same)
    else:
        # only hashes and places are shuffled, and the texts they are found in are read again
        rows = rows if rid is not None else cut(rows, "numbered")
        hits = _windows(rows.select("rid", "text")).select("rid", "pos", "h")
        hits = cut(hits.join(asked.select(F.col("item_h").alias("h")).distinct(), "h", "left_semi"), "leak-hits")
        places = hits.groupBy("rid").agg(F.sort_array(F.collect_list("pos")).alias("places"))
        found = _windows(rows.join(places, "rid"), places="places").join(asked, same)
    seen = cut(_cut_out(found, ["rid", "doc_id"]), "leak-windows")

    of_item = items.select("item", "window", "h", "words").distinct()
    held = seen.select("rid", "h", "words").distinct()
    often = held.groupBy("h", "words").agg(F.count("*").alias("c"))
    each = of_item.join(often, ["h", "words"], "left").groupBy("item", "window").agg(F.coalesce(F.sum("c"), F.lit(0)).alias("c"))
    every = W.partitionBy("item")
    ranked = each.withColumn("rank", F.row_number().over(every.orderBy("c", "window"))).withColumn("windows", F.count("*").over(every))
    # a document with SHARE of an item's windows has one of its rarest: as many as may be missing, and one more
    rarest = ranked.where(F.col("rank") <= F.col("windows") - F.ceil(F.col("windows") * SHARE - 1e-9) + 1).where("c > 0")
    probes = of_item.join(rarest, ["item", "window"]).select("item", "windows", "h", "words")
    pairs = held.join(small(probes), ["h", "words"]).select("rid", "item", "windows").distinct()
    met = held.join(many(pairs), "rid").join(small(of_item), ["item", "h", "words"])
    leaks = met.groupBy("rid", "item", "windows").agg(F.countDistinct("window").alias("covered")).where(F.col("covered") >= SHARE * F.col("windows"))
    leaks = cut(leaks.withColumn("pair", F.monotonically_increasing_id()), "leak-pairs")

    def of_pairs(matches: DataFrame, pairs: DataFrame, held: DataFrame) -> DataFrame:
        """Windows of documents (rid) that stand in the items which they are paired with."""
        return matches.join(many(pairs.select("rid", "item", "pair", "windows")), "rid").join(small(held), ["item", "h", "words"])

    slotted = items.where(_literals(F.col("words")) < WINDOW).select("item", "h", "words", F.col("values").alias("item_values")).distinct()
    values = seen.where(_literals(F.col("words")) < WINDOW).select("rid", "h", "words", "values").distinct()
    agreed = _agreements(of_pairs(values, leaks, slotted), ["pair"])
    whole = cut(leaks.join(many(agreed), "pair", "left").withColumn("agreement", F.coalesce("agreed", F.lit(1.0))), "leak-agreements")

    text = W.partitionBy("part")
    placed = items.withColumn("span", F.max("pos").over(text) - F.min("pos").over(text) + 1)
    placed = placed.select("part", "item", "h", "words", "span", "window", F.col("pos").alias("place"), F.col("values").alias("item_values"))
    open_pairs = whole.where(F.col("agreement") < AGREE)
    best = _best_occurrences(of_pairs(seen.drop("doc_id"), open_pairs, placed))
    better = open_pairs.drop("covered", "agreement").join(many(best), "pair")
    columns = ["rid", "item", "covered", "windows", "agreement"]
    out = whole.where(F.col("agreement") >= AGREE).select(*columns).unionByName(better.select(*columns))
    named = seen.groupBy("rid").agg(F.first("doc_id").alias("doc_id"))
    return out.join(many(named), "rid").select("rid", "doc_id", F.col("item.item_id").alias("item_id"), "covered", "windows", "agreement")


def drop_leaks(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text"
) -> DataFrame:
    """The rows of ``docs`` that leak no item, with all their columns; an empty table stays empty."""
    rows, rid = numbered(docs)
    bad = find_leaks(rows, benchmark, id_col, text_col, item_col, item_text_col, rid).select(F.col("rid").alias(rid)).distinct()
    return rows.join(bad, rid, "left_anti").drop(rid)

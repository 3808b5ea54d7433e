"""URL filter: rules on host and path first, then the ratio of two character language models.

Accepted and rejected URLs train one variable-order Markov model each over bytes. A context of up to ``ORDER`` bytes
predicts by its own counts, interpolated with the prediction of the next shorter context as far as its counts are few
(Witten-Bell), so the data decide how long a context counts; an unseen one falls back to shorter ones. The score of a URL
is the difference of its two log-likelihoods, divided by its length, less a threshold calibrated on labelled URLs that
were kept out of training.

Both models are one table with a row for each distinct string of ``ORDER`` + 1 bytes of the URLs. It grows with them and
stays distributed: counts are summed by string, shorter contexts are sums of longer ones, predictions are joined from
each order to the next, and URLs meet the table by string. A string has at most 256 extensions, so no group of these
joins and windows is large; strings that many URLs share are joined apart.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import UPPER, cut, join_heads, many, numbered, text_or_empty

#: Bytes of the longest context; one more must fit a 64-bit number.
ORDER = 6
#: URLs are turned into strings of ORDER + 1 bytes in pieces of this many bytes, which bounds memory.
PIECE = 1 << 20
#: Log-likelihoods are summed as whole multiples of 1 / UNIT, so sums don't depend on their order.
UNIT = 1 << 20
#: Scores are calibrated in steps of 1/STEPS from -SPAN to SPAN.
STEPS, SPAN = 100, 12
HOLD_OUT = 5


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host: after the first ``://`` up to ``/``, ``?``, ``#`` or the end, A to Z lower-cased. Path: then up to ``?`` or ``#``."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return F.translate(host, UPPER, UPPER.lower()), path


def matched_rule(host: Column, path: Column, rules: list[tuple[str, bool]]) -> tuple[Column, Column]:
    """The longest rule ``host/path`` that fits, and its verdict (true: allow); null without one.

    A rule fits its host and the host's subdomains where the path starts with the rule's path.
    """
    rule = verdict = None
    for text, allow in sorted(rules, key=lambda r: (-len(r[0]), r[0])):
        name, slash, tail = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith(slash + tail)
        rule = F.when(fits, text) if rule is None else rule.when(fits, text)
        verdict = F.when(fits, F.lit(allow)) if verdict is None else verdict.when(fits, F.lit(allow))
    if rule is None:
        return F.lit(None).cast("string"), F.lit(None).cast("boolean")
    return rule, verdict


def _pieces(urls: pd.Series) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every byte with the ORDER bytes before it, as a number, beside its URL's place in ``urls``; some PIECE bytes at a time.

    Zero bytes stand before the start of a URL.
    """

    def grams(parts: list[bytes], places: list[int]) -> tuple[np.ndarray, np.ndarray]:
        codes = np.frombuffer(b"".join(parts), np.uint8).astype(np.int64)
        out = codes.copy()
        for k in range(1, ORDER + 1):
            out[k:] |= codes[:-k] << 8 * k
        lengths = np.array([len(x) for x in parts])
        real = np.ones(len(codes), bool)
        starts = np.cumsum(lengths) - lengths
        for k in range(ORDER):
            real[starts + k] = False
        return np.repeat(places, lengths - ORDER), out[real]

    parts, places, size = [], [], 0
    for place, url in enumerate(urls):
        raw = bytes(ORDER) + (url or "").encode()
        for at in range(0, len(raw) - ORDER, PIECE):
            parts.append(raw[at : at + PIECE + ORDER])
            places.append(place)
            size += len(parts[-1])
            if size >= PIECE:
                yield grams(parts, places)
                parts, places, size = [], [], 0
    if parts:
        yield grams(parts, places)


def count_strings(df: DataFrame, url_col: str, label_col: str) -> DataFrame:
    """``gram, good, bad, n`` for each string of ORDER + 1 bytes: how often it occurs in accepted, rejected and all URLs.

    URLs whose label is null count in ``n`` only.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            good, bad = (batch["label"].eq(x).fillna(False).to_numpy(bool) for x in (True, False))
            for place, gram in _pieces(batch["url"]):
                kinds, at = np.unique(gram, return_inverse=True)
                sums = {"good": good[place], "bad": bad[place], "n": np.ones(len(at), bool)}
                yield pd.DataFrame({"gram": kinds} | {c: np.bincount(at, x, len(kinds)).astype(np.int64) for c, x in sums.items()})

    rows = df.select(F.col(url_col).alias("url"), F.col(label_col).alias("label"))
    made = rows.mapInPandas(count, "gram long, good long, bad long, n long")
    return made.groupBy("gram").agg(*(F.sum(c).alias(c) for c in ("good", "bad", "n")))


def _last(order: int) -> Column:
    """The last ``order`` + 1 bytes of ``gram``."""
    return F.col("gram").bitwiseAND(F.lit((1 << 8 * (order + 1)) - 1))


def log_ratios(strings: DataFrame) -> DataFrame:
    """``strings`` (``gram, good, bad, n``) with ``gain``: the log-probability of the last byte after the ones before it
    under the accepted model less that under the rejected one, in multiples of 1 / UNIT."""
    levels = [strings]
    for k in range(ORDER - 1, -1, -1):
        levels.insert(0, cut(levels[0].groupBy(_last(k).alias("gram")).agg(F.sum("good").alias("good"), F.sum("bad").alias("bad")), f"urls-{k}"))
    shorter = None
    for k, level in enumerate(levels):
        context = W.partitionBy(F.shiftright("gram", 8))
        for c in ("good", "bad"):
            level = level.withColumns({f"{c}_all": F.sum(c).over(context), f"{c}_kinds": F.sum((F.col(c) > 0).cast("long")).over(context)})
        if shorter is None:
            level = level.withColumns({f"{c}_less": F.lit(1 / 256) for c in ("good", "bad")})
        else:
            level = level.withColumn("tail", _last(k - 1)).join(many(shorter), "tail")
        for c in ("good", "bad"):
            own = (F.col(c) + F.col(f"{c}_kinds") * F.col(f"{c}_less")) / (F.col(f"{c}_all") + F.col(f"{c}_kinds"))
            level = level.withColumn(f"{c}_p", F.when(F.col(f"{c}_all") > 0, own).otherwise(F.col(f"{c}_less")))
        shorter = level.select(F.col("gram").alias("tail"), F.col("good_p").alias("good_less"), F.col("bad_p").alias("bad_less"))
    return level.select("gram", "good", "bad", "n", F.round((F.log("good_p") - F.log("bad_p")) * UNIT).cast("long").alias("gain"))


def score_urls(df: DataFrame, id_col: str, url_col: str, model: DataFrame) -> DataFrame:
    """``id_col, ratio``: mean over a URL's bytes of the log-probability difference. A null or empty URL has no row.

    ``id_col`` tells rows apart. ``model`` is ``log_ratios`` over these URLs' strings.
    """

    def strings(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            ids = batch["rid"].to_numpy(np.int64)
            for place, gram in _pieces(batch["url"]):
                order = np.lexsort((gram, place))
                place, gram = place[order], gram[order]
                (first,) = np.nonzero(np.r_[True, (place[1:] != place[:-1]) | (gram[1:] != gram[:-1])])
                yield pd.DataFrame({"rid": ids[place[first]], "gram": gram[first], "times": np.diff(np.r_[first, len(gram)])})

    made = df.select(F.col(id_col).alias("rid"), F.col(url_col).alias("url")).mapInPandas(strings, "rid long, gram long, times long")
    met = join_heads(made, model.select("gram", "gain", "n"), ["gram"], "n")
    total = met.groupBy("rid").agg(F.sum(F.col("gain") * F.col("times")).alias("gain"), F.sum("times").alias("bytes"))
    return total.select(F.col("rid").alias(id_col), (F.col("gain") / F.col("bytes") / UNIT).alias("ratio"))


def calibrate(scored: DataFrame, accepted_col: str) -> float:
    """The threshold with the best mean of both classes' accuracy; 0 where a class is missing. Gathers 2*STEPS*SPAN counts at most."""
    step = F.floor(F.least(F.greatest(F.col("ratio"), F.lit(-SPAN)), F.lit(SPAN)) * STEPS).cast("int")
    got = scored.groupBy(step.alias("step"), F.col(accepted_col).alias("accepted")).agg(F.count("*").alias("n")).toPandas()
    good, bad = (got[got["accepted"] == a].groupby("step")["n"].sum() for a in (True, False))
    if not len(good) or not len(bad):
        return 0.0
    edges = np.arange(-SPAN * STEPS, SPAN * STEPS + 1)
    below = lambda x: np.concatenate([[0], np.cumsum(x.reindex(edges, fill_value=0).to_numpy())])[:-1]
    right = (1 - below(good) / good.sum() + below(bad) / bad.sum()) / 2
    best = np.flatnonzero(right >= right.max() - 1e-12)
    return float(edges[best[np.argmin(np.abs(edges[best]))]]) / STEPS


def judge_urls(pages: DataFrame, rules: list[tuple[str, bool]], id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """One row per page: ``page_id, host, path, rule, verdict`` (allow or block) and ``score`` (at 0 or above: allowed by the models).

    URLs that a rule decides are the labelled ones; one in HOLD_OUT of them, chosen by hash, only calibrates. A null URL,
    or one without ``://``, has an empty host and path; a null or empty one scores 0 less the threshold. With no labelled
    URL, or of one class only, an untrained model is uniform. Repeated rows are judged each; an empty table gives no rows.
    """
    host, path = host_and_path(F.col(url_col))
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), host.alias("host"), path.alias("path"))
    rule, allowed = matched_rule(F.col("host"), F.col("path"), rules)
    held = F.pmod(F.xxhash64(text_or_empty(F.col("url"))), F.lit(HOLD_OUT)) == 0
    rows, rid = numbered(rows.withColumn("rule", rule).withColumn("allowed", allowed).withColumn("held", held))
    strings = cut(count_strings(rows.withColumn("label", F.when(~F.col("held"), F.col("allowed"))), "url", "label"), "urls")
    ratios = score_urls(rows, rid, "url", cut(log_ratios(strings), "urls-model"))
    scored = cut(rows.drop("url").join(many(ratios), rid, "left").withColumn("ratio", F.coalesce("ratio", F.lit(0.0))), "urls-scored")
    threshold = calibrate(scored.where(F.col("held") & F.col("allowed").isNotNull()), "allowed")
    scored = scored.withColumn("score", F.col("ratio") - threshold)
    verdict = F.when(F.coalesce(F.col("allowed"), F.col("score") >= 0), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "score")

"""Toxicity by a lexicon that is matched with misspellings and judged in its context.

The lexicon (terms and stems that labelled documents teach, and terms that the caller gives) is a trie. The Levenshtein
automaton of one edit is intersected with it, as a deterministic automaton whose states are made when first reached, so a
word is judged by one walk and most words end it after a few letters. Terms that stand in toxic documents almost only may
be misspelled, in any language, unless clean documents have words one edit from them. Around each hit a window of words tells quotation (quote marks,
reporting words) from abuse (address to a person). A logistic regression on the counted hits gives the score.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, numbered, text_or_empty

#: Reporting words, and words that address a person.
REPORTING = frozenset("said says wrote writes called quote quoted quotes term word dit écrit appelle sagte schrieb nennt wort dijo escribió llama palabra".split())
ADDRESS = frozenset("you your youre yourself tu toi vous votre du dich dein deine sie tú usted eres".split())
#: Labelled rows, in order of a hash of their id, that the lexicon and the regression are fitted on, at most.
FIT_ROWS = 12_000
#: Documents of the fitted sample that a key needs to be looked at; toxic ones that a word and a stem need to be a term.
SEEN, WORD_DOCS, STEM_DOCS = 4, 4, 20
#: Log-odds of a term that counts by itself, and may be misspelled if it has so many letters.
STRONG = 4.5
FUZZY_LEAST = 5
#: A term isn't matched with an edit if more than one in so many clean documents have a word one edit from it.
NEAR_SHARE = 500
WINDOW = 6
CACHE = 400_000
_WORD = re.compile(r"\w+")
_QUOTES = "\"“”„«»‹›"
#: Stem lengths that are tried.
STEMS = range(4, 8)
FEATURES = ("exact", "fuzzy", "learned", "quoted", "any", "density")
#: Weights before any label is seen: intercept first. The regression is pulled to them, so they hold where labels say nothing.
PRIOR = np.array([-2.5, 2.0, 1.5, 0.5, 0.2, 0.5, 0.2])


class Matcher:
    """Walks words through the product of the lexicon's trie and the automaton of one edit.

    ``terms`` as ``learn_terms`` gives them, marked text -> (kind, weight): strong terms may be misspelled, firm ones,
    words (marked =) and stems (^) may not.
    """

    def __init__(self, terms: dict[str, tuple[str, float]]):
        self.trie: list[dict[str, int]] = [{}]
        self.ends: dict[int, dict[str, float]] = defaultdict(dict)
        self.names: dict[int, str] = {}
        # a node allows an edit if a strong term of FUZZY_LEAST letters or more ends at it or below it
        self.fuzzy = [False]
        for marked, (kind, weight) in sorted(terms.items()):
            node, term = 0, marked.lstrip("=^")
            edits = kind == "strong" and len(term) >= FUZZY_LEAST
            self.fuzzy[0] |= edits
            for c in term:
                node = self.trie[node].setdefault(c, len(self.trie))
                if node == len(self.trie):
                    self.trie.append({})
                    self.fuzzy.append(False)
                self.fuzzy[node] |= edits
            self.ends[node][kind] = weight
            self.names[node] = term
        self.states: dict[frozenset, int] = {}
        self.sets: list[frozenset] = []
        self.step: list[dict[str, int]] = []
        self.verdict: list[tuple[str, float] | None] = []
        self.first = self._state(self._close({(0, 0)}))

    def _close(self, pairs: set[tuple[int, int]]) -> frozenset:
        more = {(child, 1) for node, edits in pairs if node >= 0 and not edits for child in self.trie[node].values() if self.fuzzy[child]}
        return frozenset(pairs | more)

    def _state(self, pairs: frozenset) -> int:
        if pairs not in self.states:
            self.states[pairs] = len(self.sets)
            self.sets.append(pairs)
            self.step.append({})
            self.verdict.append(self._end(pairs))
        return self.states[pairs]

    def _end(self, pairs: frozenset) -> tuple[str, float] | None:
        ended = [(edits, self.ends[node], node) for node, edits in pairs if node in self.ends]
        ended += [(0, {"stem": self.ends[-1 - node]["stem"]}, node) for node, _ in pairs if node < 0]
        whole = [kinds for edits, kinds, _ in ended if not edits]
        for kind in ("strong", "firm", "word", "stem"):
            weights = [kinds[kind] for kinds in whole if kind in kinds]
            if weights:
                return ("exact", 0.0) if kind in ("strong", "firm") else ("learned", max(weights)) if max(weights) > 0 else None
        if self._near(pairs):
            return "fuzzy", 0.0
        return None

    def _near(self, pairs: frozenset) -> list[str]:
        return [self.names[node] for node, edits in pairs if edits and "strong" in self.ends.get(node, ()) and len(self.names[node]) >= FUZZY_LEAST]

    def near_terms(self, word: str) -> list[str]:
        """The strong terms that are one edit from a word that is matched with an edit."""
        if (self.match(word) or ("",))[0] != "fuzzy":
            return []
        state = self.first
        for c in word:
            state = self.step[state][c]
        return self._near(self.sets[state])

    def _next(self, state: int, c: str) -> int:
        out: set[tuple[int, int]] = set()
        for node, edits in self.sets[state]:
            if node < 0:
                out.add((node, 0))
                continue
            if not edits and "stem" in self.ends.get(node, ()):
                out.add((-1 - node, 0))  # behind a stem, where any rest fits
            if (child := self.trie[node].get(c)) is not None and (not edits or self.fuzzy[child]):
                out.add((child, edits))
            if not edits and self.fuzzy[node]:
                out.add((node, 1))
                out |= {(x, 1) for x in self.trie[node].values() if self.fuzzy[x]}
        return self._state(self._close(out))

    def match(self, word: str) -> tuple[str, float] | None:
        """(exact, fuzzy or learned; the weight of a learned term) or None."""
        state = self.first
        for c in word:
            after = self.step[state].get(c)
            if after is None:
                after = self.step[state][c] = self._next(state, c)
            if not self.sets[after]:
                return None
            state = after
        return self.verdict[state]


def features(text: str, matcher: Matcher, cache: dict[str, tuple[str, float] | None]) -> list[float]:
    """The values of FEATURES for a whole text."""
    low = text.lower()
    words = _WORD.findall(low)
    hit = False
    for w in set(words):
        if w not in cache:
            if len(cache) >= CACHE:
                cache.clear()
            cache[w] = matcher.match(w)
        hit = hit or cache[w] is not None
    if not hit:
        return [0.0] * len(FEATURES)
    seen, quoted, learned = Counter(), 0, {}
    spans = [m.span() for m in _WORD.finditer(low)]
    for i, w in enumerate(words):
        found = cache[w] if w in cache else matcher.match(w)
        if found is None:
            continue
        near = words[max(0, i - WINDOW) : i] + words[i + 1 : i + 1 + WINDOW]
        a, b = spans[i]
        before, after = low[spans[max(0, i - WINDOW)][0] : a], low[b : spans[min(len(words) - 1, i + WINDOW)][1]]
        marks = any(q in before for q in _QUOTES) and any(q in after for q in _QUOTES)
        if (marks or not REPORTING.isdisjoint(near)) and ADDRESS.isdisjoint(near):
            quoted += 1
        else:
            seen[found[0]] += 1
            if found[0] == "learned":
                learned[w] = found[1]
    total = sum(seen.values())
    counts = [np.log1p(seen["exact"]), np.log1p(seen["fuzzy"]), sum(learned.values()), np.log1p(quoted)]
    return [*counts, float(total > 0), np.log1p(1000 * total / len(words))]


def fold(id_col: Column) -> Column:
    return F.crc32(id_col.cast("string").cast("binary")) % 5


def _sample(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, label_col: str, rows: int) -> DataFrame:
    """Text and label of at most ``rows`` labelled documents outside the held-out fold."""
    asked = (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .where((fold(F.col("id")) != 0) & F.col("label").isNotNull())
        .groupBy("id")
        .agg(F.max("label").alias("label"))
        .orderBy(F.xxhash64("id"), "id")
        .limit(rows)
    )
    texts = docs.select(F.col(id_col).alias("id"), text_or_empty(F.col(text_col)).alias("text"))
    # the broadcast side has FIT_ROWS small rows at most
    return cut(texts.join(F.broadcast(asked), "id").select("id", "text", "label").dropDuplicates(["text", "label"]), "toxic-sample")


def learn_terms(sample: DataFrame, given: tuple[str, ...] = ()) -> dict[str, tuple[str, float]]:
    """Term -> (kind, weight): words, and stems (beginnings of words), with the log-odds of standing in toxic documents.

    Words with log-odds of STRONG or more are strong terms, as the ``given`` ones are; of them, those with words of clean
    documents one edit away are firm. Words in WORD_DOCS toxic documents and stems in STEM_DOCS or more are terms if the
    odds say so, all of them; with the harmless forms and near words of clean documents they are bounded by the words of
    the fitted sample.

    A term counts if it stands after several different words, which keeps copies of one toxic document from teaching
    all its words. Words with a stem that is a term have their own weight, so that harmless forms of it don't count.
    """

    def keys(word: str) -> Iterator[str]:
        if len(word) >= 4:
            yield word
            for n in STEMS:
                if len(word) > n:
                    yield word[:n] + "*"

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        sums = (Counter(), Counter())
        for batch in batches:
            for text, label in zip(batch["text"], batch["label"]):
                sums[int(label > 0)].update({k for w in set(_WORD.findall(text.lower())) for k in keys(w)})
        for label, x in enumerate(sums):
            if x:
                yield pd.DataFrame({"key": list(x), "label": label, "n": list(x.values())})

    docs = {r["toxic"]: r["n"] for r in sample.groupBy((F.col("label") > 0).alias("toxic")).agg(F.count("*").alias("n")).collect()}
    n = F.sum(F.when(F.col("label") == 1, F.col("n")).otherwise(0))
    clean = F.sum(F.when(F.col("label") == 0, F.col("n")).otherwise(0))
    counts = sample.mapInPandas(count, "key string, label int, n long").groupBy("key").agg(n.alias("toxic"), clean.alias("clean"))
    odds = F.log((F.col("toxic") + 0.5) / (docs.get(True, 0) + 1)) - F.log((F.col("clean") + 0.5) / (docs.get(False, 0) + 1))
    counts = cut(counts.withColumn("odds", odds).where(F.col("toxic") + F.col("clean") >= SEEN), "toxic-counts")
    least = F.when(F.col("key").endswith("*"), STEM_DOCS).otherwise(WORD_DOCS)
    likely = counts.where((F.col("toxic") >= least) & (F.col("odds") >= 1.3))
    asked = {r["key"]: r["odds"] for r in likely.collect()}  # keys of the sample

    def befores(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = set()
            for text in batch.loc[batch["label"] > 0, "text"]:
                words = _WORD.findall(text.lower())
                rows |= {(k, a) for a, w in zip(["", *words], words) for k in keys(w) if k in asked}
            if rows:
                yield pd.DataFrame(list(rows), columns=["key", "before"])

    varied = sample.mapInPandas(befores, "key string, before string").groupBy("key").agg(F.countDistinct("before").alias("n"))
    got = {r["key"]: r["n"] for r in varied.where("n >= 4").collect()}  # keys asked for only
    words = sorted((k for k in got if not k.endswith("*")), key=lambda w: (-got[w], w))
    strong = {*given, *(w for w in words if asked[w] >= STRONG)}
    stems: list[str] = []
    for k in sorted((k[:-1] for k in got if k.endswith("*") and got[k] >= 20), key=lambda k: (len(k), k)):
        if not any(k.startswith(s) for s in stems) and not any(t.startswith(k) for t in strong):
            stems.append(k)
    out = {"^" + s: ("stem", asked[s + "*"]) for s in stems} | {"=" + w: ("word", asked[w]) for w in words if w not in strong}
    begins = F.lit(False)
    for n in STEMS:
        if mine := [s for s in stems if len(s) == n]:
            begins = begins | F.substring("key", 1, n).isin(mine)
    if stems:
        learned = set(words)
        forms = counts.where(begins & ~F.col("key").endswith("*"))  # words of the sample
        out |= {"=" + r["key"]: ("word", max(0.0, r["odds"])) for r in forms.collect() if r["key"] not in learned}
    out |= {t: ("strong", 0.0) for t in strong}

    def near_words(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher = Matcher(out)
        for batch in batches:
            clean = [set(_WORD.findall(text.lower())) for text in batch.loc[batch["label"] == 0, "text"]]
            if found := [(w, t) for doc in clean for w in doc for t in matcher.near_terms(w)]:
                yield pd.DataFrame(found, columns=["word", "term"])

    # words of clean documents that are one edit from a term are no misspellings; a term that has many takes no edits
    near = cut(sample.mapInPandas(near_words, "word string, term string").groupBy("word", "term").count(), "toxic-near")
    crowded = near.groupBy("term").agg(F.sum("count").alias("n")).where(F.col("n") > docs.get(False, 0) / NEAR_SHARE)
    firm = {r["term"] for r in crowded.collect()}  # terms of the lexicon
    out |= {t: ("firm", 0.0) for t in firm}
    return {"=" + r["word"]: ("word", 0.0) for r in near.select("word").distinct().collect()} | out  # words of the sample


def fit(x: np.ndarray, y: np.ndarray, pull: float = 1.0) -> np.ndarray:
    """Weights (intercept first) of the logistic regression, pulled to PRIOR; Newton's steps, halved while they don't help."""
    x = np.hstack([np.ones((len(x), 1)), x])

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float(np.sum(np.logaddexp(0, z) - y * z) + pull / 2 * np.sum((w - PRIOR) ** 2))

    w = PRIOR.copy()
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (p - y) + pull * (w - PRIOR)
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + pull * np.eye(len(w)), grad)
        while loss(w - step) > loss(w) and np.abs(step).max() > 1e-9:
            step /= 2
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _with_features(df: DataFrame, terms: dict[str, tuple[str, float]], keep: list[str]) -> DataFrame:
    from pyspark.sql import types as T

    fields = [df.schema[k] for k in keep] + [T.StructField(f, T.DoubleType()) for f in FEATURES]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        matcher, cache = Matcher(terms), {}
        for batch in batches:
            for at in range(0, len(batch), 500):
                part = batch.iloc[at : at + 500]
                made = np.array([features(t, matcher, cache) for t in part["text"]], float).reshape(-1, len(FEATURES))
                yield pd.concat([part[keep].reset_index(drop=True), pd.DataFrame(made, columns=FEATURES)], axis=1)

    return df.select(*keep, "text").mapInPandas(run, T.StructType(fields))


def score_documents(
    docs: DataFrame,
    labels: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    label_col: str = "toxic",
    fit_rows: int = FIT_ROWS,
    rid: str | None = None,
    given: tuple[str, ...] = (),
) -> DataFrame:
    """One row per document: ``rid`` (the row's number, or what the column ``rid`` holds), ``doc_id, held_out, score, predicted``.

    ``given`` are terms that count without being learned, in lower case.

    Null text counts as empty and gets the score of a text without hits. A null id is not held out. Labels of the fold
    that is held out are never read; without labels the prior weights and the given terms hold. Repeated rows are scored
    each; an empty table gives no rows.
    """
    sample = _sample(docs, labels, id_col, text_col, label_col, fit_rows)
    terms = learn_terms(sample, given)
    seen = _with_features(sample, terms, ["label"]).toPandas()  # fit_rows rows at most
    weights = fit(seen[list(FEATURES)].to_numpy(float), (seen["label"] > 0).to_numpy(float))
    # the id is kept as text in Python, so that nulls stay and no type changes
    rows = docs.select(
        (F.monotonically_increasing_id() if rid is None else F.col(rid)).alias("rid"),
        F.col(id_col).cast("string").alias("doc_id"),
        text_or_empty(F.col(text_col)).alias("text"),
    )
    made = _with_features(rows, terms, ["rid", "doc_id"])
    z = F.lit(float(weights[0]))
    for name, w in zip(FEATURES, weights[1:]):
        z = z + F.col(name) * float(w)
    score = 1 / (1 + F.exp(-F.greatest(F.least(z, F.lit(30.0)), F.lit(-30.0))))
    return made.select(
        "rid",
        F.col("doc_id").cast(docs.schema[id_col].dataType).alias("doc_id"),
        F.coalesce(fold(F.col("doc_id")) == 0, F.lit(False)).alias("held_out"),
        score.alias("score"),
        (score >= 0.5).cast("int").alias("predicted"),
    )


def drop_toxic(
    docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", fit_rows: int = FIT_ROWS
) -> DataFrame:
    """The rows of ``docs`` that aren't predicted toxic, with all their columns; an empty table stays empty."""
    rows, rid = numbered(docs)
    bad = score_documents(rows, labels, id_col, text_col, label_col, fit_rows, rid).where("predicted = 1").select(F.col("rid").alias(rid))
    return rows.join(bad, rid, "left_anti").drop(rid)

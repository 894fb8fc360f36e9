"""A convolutional text classifier for toxicity, trained in numpy.

A word's embedding is the sum of hashed rows: of the word and of its first four, five and six letters, so
unseen endings of known stems are known. Filters of several widths run over the words; the greatest
response of each filter over the whole text feeds a logistic unit. Filters are learned from a bounded sample;
a cut is calibrated for each language, which is guessed from the text's own letters, on all other labelled rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import give_back, lean, materialize, table

#: Bound of the sample that is learned from: so many documents of each label, by the order of a hash.
SAMPLE = 2500
#: Hashed rows, embedding size, filters of each width, widths.
ROWS, SIZE, FILTERS, WIDTHS = 1 << 20, 8, 8, (1, 2, 3)
EPOCHS, RATE, SEED = 4, 0.1, 17
#: Words whose responses a worker keeps. Memory only.
CACHE = 100_000
#: Logits of a unit that histograms tell apart, and the greatest logit they hold.
BINS, REACH = 100, 40
#: A false alarm counts as so many misses where cuts are calibrated: most documents are clean.
ALARM = 9.0

WORD = re.compile(r"[^\W\d_]+")
# Letters that mark a language; where none is frequent, it is "en".
LETTERS = {"de": "äöüß", "fr": "éèêçàâîôùœ", "es": "ñóíáú¿¡"}


def features(word: str) -> tuple[int, ...]:
    h = lambda x: xxhash.xxh3_64_intdigest(x) % ROWS
    return (h("w" + word), *(h(f"{n}" + word[:n]) for n in (4, 5, 6) if len(word) >= n))


def language(text: str) -> str:
    """Guess from letters alone. Ties go to the first language of LETTERS."""
    low = text.lower()
    counts = {k: sum(low.count(c) for c in v) for k, v in LETTERS.items()}
    best = max(counts, key=lambda k: counts[k])
    return best if counts[best] * 100 > len(low) else "en"


@dataclass
class Model:
    rows: np.ndarray  # sorted numbers of the trained rows
    table: np.ndarray  # their embeddings, and a last row of zeros for all others
    filters: dict[int, np.ndarray] = field(default_factory=dict)  # width -> (width, SIZE, FILTERS)
    bias: dict[int, np.ndarray] = field(default_factory=dict)
    out: np.ndarray | None = None
    out_bias: float = 0.0
    cuts: dict[str, float] = field(default_factory=dict)

    def at(self, numbers: np.ndarray) -> np.ndarray:
        k = np.searchsorted(self.rows, numbers)
        k[k == len(self.rows)] = 0
        return np.where(self.rows[k] == numbers, k, len(self.rows)) if len(self.rows) else np.zeros(len(numbers), "i8")


class Scorer:
    """Scores of texts. A word's responses to all filters are worked out once and kept."""

    def __init__(self, model: Model):
        self.m, self.known, self.n = model, {}, 0
        self.width = sum(WIDTHS) * FILTERS
        self.responses = np.zeros((CACHE, self.width), "f4")
        self.weights = np.hstack([model.filters[w][k] for w in WIDTHS for k in range(w)]) if model.out is not None else None

    def indexes(self, words: list[str]) -> np.ndarray:
        known = self.known
        new = list(dict.fromkeys(w for w in words if w not in known))
        if self.n + len(new) > len(self.responses):
            known.clear()
            self.n, new = 0, list(dict.fromkeys(words))
            if len(new) > len(self.responses):  # one text of more different words
                self.responses = np.zeros((len(new), self.width), "f4")
        if new:
            found = [features(w) for w in new]
            ends = np.cumsum([0, *map(len, found)])
            rows = self.m.at(np.fromiter((x for f in found for x in f), "i8", ends[-1]))
            emb = np.add.reduceat(self.m.table[rows], ends[:-1], axis=0)
            self.responses[self.n : self.n + len(new)] = emb @ self.weights
            known.update((w, self.n + k) for k, w in enumerate(new))
            self.n += len(new)
        return np.fromiter(map(known.__getitem__, words), "i8", len(words))

    def logit(self, text: str) -> float:
        m = self.m
        words = WORD.findall(text.lower())
        r = self.responses[self.indexes(words)] if words else np.zeros((0, self.width), "f4")
        pooled, at = [], 0
        for w in WIDTHS:
            n = len(r) - w + 1
            if n > 0:
                z = r[:n, at : at + FILTERS].copy()
                for k in range(1, w):
                    z += r[k : k + n, at + k * FILTERS : at + (k + 1) * FILTERS]
                pooled.append(np.maximum(0, z.max(0) + m.bias[w]))
            else:
                pooled.append(np.zeros(FILTERS, "f4"))
            at += w * FILTERS
        return float(np.concatenate(pooled) @ m.out + m.out_bias)


def spared(rng: np.random.Generator, n: int) -> np.ndarray:
    """Which of n texts the filters aren't learned from."""
    return rng.random(n) < 0.2


def train(texts: list[str], labels: list[int]) -> Model:
    """Learn from whole texts; a fifth of them only calibrates first cuts. Without both labels nothing is toxic."""
    rng = np.random.default_rng(SEED)
    fold = spared(rng, len(texts))
    y = np.asarray(labels)
    fit = np.flatnonzero(~fold)
    if len(set(y[fit])) < 2:
        return Model(np.empty(0, "i8"), np.zeros((1, SIZE), "f4"))
    known: dict[str, int] = {}
    docs = []  # numbers of each text's words: the driver holds four bytes a word
    for i in fit:
        words = WORD.findall(texts[i].lower())
        for w in words:
            if w not in known:
                known[w] = len(known)
        docs.append(np.fromiter(map(known.__getitem__, words), "i4", len(words)))
    flat = np.full((len(known), 4), -1, "i8")
    for k, w in enumerate(known):
        f = features(w)
        flat[k, : len(f)] = f
    del known
    numbers = np.unique(flat[flat >= 0])
    model = Model(numbers, rng.normal(0, 0.01, (len(numbers) + 1, SIZE)).astype("f4"))
    zero = len(numbers)
    model.table[zero] = 0
    at = np.where(flat < 0, zero, np.searchsorted(numbers, flat)).astype("i4")  # rows of each word
    del flat
    # first component: log odds of a row's documents, so that filters start from what tells the labels apart
    seen = np.zeros((2, zero + 1))
    for d, i in zip(docs, fit, strict=True):
        seen[y[i], np.unique(at[d])] += 1
    total = np.bincount(y[fit], minlength=2)
    odds = np.log((seen[1] + 0.5) / (total[1] + 1)) - np.log((seen[0] + 0.5) / (total[0] + 1))
    model.table[:, 0] = np.where(seen.sum(0) >= 3, np.clip(odds, -2, 4) / 4, 0)
    model.table[zero] = 0
    for w in WIDTHS:
        model.filters[w] = rng.normal(0, 0.3, (w, SIZE, FILTERS)).astype("f4")
        model.filters[w][:, 0, : FILTERS // 2] += 0.5
        model.bias[w] = np.zeros(FILTERS, "f4")
    model.out = rng.normal(0, 0.1, len(WIDTHS) * FILTERS).astype("f4")
    squares: dict = {"table": np.full(model.table.shape, 1e-2, "f4"), "out": np.full(model.out.shape, 1e-2, "f4"), "b": 1e-2}
    squares |= {("f", w): np.full(model.filters[w].shape, 1e-2, "f4") for w in WIDTHS} | {("b", w): np.full(FILTERS, 1e-2, "f4") for w in WIDTHS}

    def step(value, gradient, key):
        squares[key] += gradient * gradient
        value -= RATE * gradient / np.sqrt(squares[key])

    for _ in range(EPOCHS):
        for d in rng.permutation(len(docs)):
            rows = at[docs[d]]
            x = model.table[rows].sum(1)
            pooled, places = [], []
            for w in WIDTHS:
                n = len(x) - w + 1
                if n > 0:
                    z = sum(x[k : k + n] @ model.filters[w][k] for k in range(w)) + model.bias[w]
                    top = z.argmax(0)
                    best = z[top, np.arange(FILTERS)]
                else:
                    top, best = np.zeros(FILTERS, "i8"), np.zeros(FILTERS, "f4")
                pooled.append(np.maximum(0, best))
                places.append((top, (best > 0) & (n > 0)))
            v = np.concatenate(pooled)
            error = 1 / (1 + np.exp(-np.clip(v @ model.out + model.out_bias, -30, 30))) - y[fit[d]]
            if abs(error) < 1e-3:
                continue
            back = error * model.out
            step(model.out, (error * v).astype("f4"), "out")
            squares["b"] += error * error
            model.out_bias -= RATE * error / np.sqrt(squares["b"])
            for j, w in enumerate(WIDTHS):
                top, on = places[j]
                g = np.where(on, back[j * FILTERS : (j + 1) * FILTERS], 0).astype("f4")
                if not g.any():
                    continue
                step(model.bias[w], g, ("b", w))
                gf = np.zeros_like(model.filters[w])
                for k in range(w):
                    here = x[np.minimum(top + k, len(x) - 1)]
                    gf[k] = (here * g[:, None]).T
                    gx = g[:, None] * model.filters[w][k].T
                    for f in np.flatnonzero(on):
                        mine = rows[top[f] + k]
                        mine = mine[mine != zero]
                        squares["table"][mine] += gx[f] ** 2
                        model.table[mine] -= RATE * gx[f] / np.sqrt(squares["table"][mine])
                step(model.filters[w], gf, ("f", w))
    # cuts: for all, and for each language with enough of both labels
    check = np.flatnonzero(fold) if len(set(y[fold])) == 2 else np.arange(len(texts))
    scorer = Scorer(model)
    z, langs = np.asarray([scorer.logit(texts[i]) for i in check]), np.asarray([language(texts[i]) for i in check])
    model.cuts[""] = cut(z, y[check])
    for lang in set(langs):
        mine = langs == lang
        if min(np.bincount(y[check][mine], minlength=2)) >= 10:
            model.cuts[str(lang)] = cut(z[mine], y[check][mine])
    return model


def cut(z: np.ndarray, y: np.ndarray, n: np.ndarray | None = None) -> float:
    """Middle of the gap with the least cost between sorted logits, of n rows each."""
    order = np.argsort(z, kind="stable")
    n = np.ones(len(z), "i8") if n is None else n
    z, clean, toxic = z[order], np.where(y == 0, n, 0)[order], np.where(y == 1, n, 0)[order]
    balance = max(1.0, clean.sum()) / max(1.0, toxic.sum())
    missed = np.concatenate([[0], np.cumsum(toxic)]) * balance
    alarms = np.concatenate([np.cumsum(clean[::-1])[::-1], [0]]) * ALARM
    cost = missed + alarms
    edges = np.concatenate([[z[0] - 2], (z[1:] + z[:-1]) / 2, [z[-1] + 2]])
    best = np.flatnonzero(cost == cost.min())
    widths = np.concatenate([[0], np.diff(z), [0]])
    return float(edges[best[widths[best].argmax()]])


def labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, toxic) of the labels that may be learned from, one row a doc_id."""
    return (
        labels.select(F.col("doc_id").cast("long"), F.col("toxic").cast("int")).dropna()
        .where(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 0)
        .groupBy("doc_id").agg((F.max("toxic") > 0).cast("int").alias("toxic"))
    )


def fit(docs: DataFrame, labels: DataFrame) -> tuple[Model, list[int]]:
    """Filters, with first cuts, from a bounded sample of the labelled documents whose crc32(doc_id as text) mod 5 is not 0.

    The sample is SAMPLE documents of each label by the order of a hash of doc_id. Also gives the doc_ids that the
    filters are learned from. Rows with a null label or text take no part; a doc_id labelled twice counts by its
    higher label, one on rows of different texts by the least text.
    """
    train_ids = labelled(labels)
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id")).distinct().join(train_ids, "doc_id")
    chosen = [known.where(F.col("toxic") == k).orderBy(F.xxhash64("doc_id"), "doc_id").limit(SAMPLE) for k in (0, 1)]
    ids = F.broadcast(chosen[0].unionByName(chosen[1]))  # at most 2 * SAMPLE rows
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where("text IS NOT NULL").join(ids, "doc_id")
    found = {r["doc_id"]: r for r in rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.max("toxic").alias("toxic")).collect()}
    order = sorted(found)
    model = train([found[i]["text"] for i in order], [found[i]["toxic"] for i in order])
    found.clear()
    give_back()  # the driver goes on with other steps
    return model, [i for i, out in zip(order, spared(np.random.default_rng(SEED), len(order)), strict=True) if not out]


def logits(texts: pa.Array, scorer: Scorer) -> pa.StructArray:
    """(lang, logit) of each text; null is scored as the empty text."""
    langs, made = [], []
    for t in texts:
        t = t.as_py() or ""
        langs.append(language(t))
        made.append(scorer.logit(t) if scorer.m.out is not None else 0.0)
    return pa.StructArray.from_arrays([pa.array(langs, pa.string()), pa.array(made, pa.float64())], ["lang", "logit"])


def with_logits(rows: DataFrame, model: Model) -> DataFrame:
    """rows with a column s (lang, logit) in place of their text: each text is scored once, in a written table."""
    shared = rows.sparkSession.sparkContext.broadcast(model)  # rows of the bounded sample's words

    def scored(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        scorer = Scorer(shared.value)
        for texts in batches:
            yield logits(texts, scorer)

    @F.arrow_udf("lang string, logit double")
    def score(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        yield from lean(scored)(batches)

    return materialize(rows.withColumn("s", score("text")).drop("text"), "logits")


def histogram(scored: DataFrame, train_ids: DataFrame, fitted: list[int]) -> pd.DataFrame:
    """(lang, toxic, bin, n): logits of all labelled training rows but the fitted ones. Bounded by the bins."""
    out = F.broadcast(scored.sparkSession.createDataFrame([(i,) for i in fitted], "id long"))  # at most 2 * SAMPLE rows
    rows = scored.where("known").select("id", "s.*").join(out, "id", "left_anti").join(train_ids.withColumnRenamed("doc_id", "id"), "id")
    bin_ = F.floor(F.greatest(F.lit(-REACH), F.least(F.lit(REACH), F.col("logit"))) * BINS).cast("int").alias("bin")
    return rows.groupBy("lang", "toxic", bin_).agg(F.count("*").alias("n")).toPandas()


def calibrate(model: Model, found: pd.DataFrame) -> None:
    """Cuts for all, and for each language with enough of both labels; without both labels they stay as they are."""
    z, y, n, langs = (found["bin"].to_numpy() + 0.5) / BINS, found["toxic"].to_numpy(), found["n"].to_numpy(), found["lang"].to_numpy()
    if len(set(y)) < 2:
        return
    model.cuts = {"": cut(z, y, n)}
    for lang in sorted(set(langs)):
        mine = langs == lang
        if min(n[mine & (y == k)].sum() for k in (0, 1)) >= 10:
            model.cuts[str(lang)] = cut(z[mine], y[mine], n[mine])


def scores(docs: DataFrame, labels: DataFrame, extra: tuple = ()) -> tuple[DataFrame, Column]:
    """A written table of all rows of docs (id, extra columns, s), and the score, 0.5 at the cut of a text's language."""
    model, fitted = fit(docs, labels)
    ids = F.col("doc_id").cast("long").alias("id")
    scored = with_logits(docs.select(ids, F.col("text").isNotNull().alias("known"), *extra, "text"), model)
    if model.out is None:
        return scored, F.lit(0.0)
    calibrate(model, histogram(scored, labelled(labels), fitted))
    at = F.lit(model.cuts[""])
    for lang, z in model.cuts.items():
        at = F.when(F.col("s.lang") == lang, z).otherwise(at) if lang else at
    z = F.greatest(F.lit(-30.0), F.least(F.lit(30.0), F.col("s.logit") - at))
    return scored, 1 / (1 + F.exp(-z))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted) of every row of docs; null and empty texts are scored as empty.

    Learned from the labelled documents whose crc32(doc_id as text) mod 5 is not 0; cuts come from all of them but
    those that the filters are learned from, where both labels are among them. Without both labels all scores are 0.
    Repeated rows are scored each; an empty table gives none; columns besides doc_id and text aren't read.
    """
    scored, score = scores(docs, labels)
    held = F.coalesce(F.crc32(F.col("id").cast("string").cast("binary")) % 5 == 0, F.lit(False))
    return scored.select(F.col("id").alias("doc_id"), held.alias("held_out"), score.alias("score"), (score >= 0.5).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't predicted toxic, with the columns of docs; clashing names in docs are harmless.

    Null and empty texts stay unless the empty text is toxic by the model; repeated rows are judged each, alike; an
    empty table stays empty.
    """
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row")
    scored, score = scores(docs, table(spark, sf_dir, "labels"), (row,))
    return scored.where(score < 0.5).select("row.*")

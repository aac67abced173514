"""Language identification: sparse multinomial logistic regression on TF-IDF
character n-grams, trained with follow-the-regularised-leader (FTRL-Proximal)
and elastic-net penalties, then temperature calibration.

Features: the text in lower case, every run of characters that are not letters
as one blank, all n-grams of 1 to 3 characters of the whole text hashed to
2^15 buckets; ``(1 + ln count) * idf``, scaled to length 1.  Document
frequencies are counted over all documents one may learn from.  The weights
are fitted on a bounded sample of them: about ``per_lang`` documents for each
language, drawn by a hash of doc_id; more than ``MAX_LANGS`` languages are an
error, none is left out.  A fifth of the sample is kept from the weights and
sets the temperature.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseflow.llm.shingles import mix

BUCKETS = 1 << 15
PER_LANG, MAX_LANGS = 1000, 500
UNDETERMINED = "und"
_STRETCH = 1 << 20


def has_letter(text: str | None) -> bool:
    return bool(text) and any(c.isalpha() for c in text)


_LETTER = np.empty(0, dtype=bool)


def _letters() -> np.ndarray:
    """Which code points are letters, built once per worker."""
    global _LETTER
    if not len(_LETTER):
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), dtype=bool, count=0x110000)
    return _LETTER


def counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Bucket numbers and n-gram counts of a whole text, taken in stretches of
    bounded size (n-grams across their borders included)."""
    total = np.zeros(BUCKETS, dtype=np.int64)
    letter = _letters()
    tail = np.array([0x20], dtype=np.uint32)
    for at in range(0, len(text), _STRETCH):
        low = text[at:at + _STRETCH].lower()
        points = np.frombuffer(low.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
        points = np.where(letter[points], points, np.uint32(0x20))
        points = np.concatenate([tail, points] if at + _STRETCH < len(text) else [tail, points, [np.uint32(0x20)]])
        blank = points == 0x20
        keep = np.ones(len(points), dtype=bool)
        keep[1:] = ~(blank[1:] & blank[:-1])
        points = points[keep].astype(np.uint64)
        known = 0 if at == 0 else len(tail)          # grams inside the carried tail are counted already
        h = np.zeros(len(points), dtype=np.uint64)
        for n in range(3):
            h = h[:len(points) - n] * np.uint64(0x9E3779B97F4A7C15) + points[n:] + np.uint64(1)
            new = h[max(0, known - n):]
            total += np.bincount((mix(new + np.uint64(n)) >> np.uint64(49)).astype(np.int64), minlength=BUCKETS)
        tail = points[-2:].astype(np.uint32)
    at = np.flatnonzero(total)
    return at, total[at]


@dataclass
class Model:
    langs: list[str]
    idf: np.ndarray                     # BUCKETS
    weights: np.ndarray                 # (BUCKETS + 1) x langs, the last row is the bias
    temperature: float

    def vector(self, at, n):
        x = (1.0 + np.log(n)) * self.idf[at]
        size = math.sqrt(float(x @ x))
        return x / size if size else x

    def logits(self, at, n):
        return self.vector(at, n) @ self.weights[at] + self.weights[-1]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not self.langs or not has_letter(text):
            return UNDETERMINED, 0.0
        p = _softmax(self.logits(*counts(text)) / self.temperature)
        best = int(p.argmax())
        return self.langs[best], float(min(1.0, max(0.0, p[best])))


def _softmax(z):
    e = np.exp(z - z.max())
    return e / e.sum()


def ftrl(rows, classes: int, epochs: int = 3, alpha: float = 0.5, beta: float = 1.0, l1: float = 0.02,
         l2: float = 0.001) -> np.ndarray:
    """FTRL-Proximal on ``rows`` of (buckets, values, class): weights with
    exact zeros from the l1 part; the bias row is not penalised."""
    z = np.zeros((BUCKETS + 1, classes))
    n = np.zeros((BUCKETS + 1, classes))
    first = np.full(BUCKETS + 1, l1)
    first[-1] = 0.0

    def leader(at):
        zz, cut = z[at], first[at][:, None]
        return np.where(np.abs(zz) <= cut, 0.0, -(zz - np.sign(zz) * cut) / ((beta + np.sqrt(n[at])) / alpha + l2))

    for _ in range(epochs):
        for at, x, y in rows:
            at, x = np.append(at, BUCKETS), np.append(x, 1.0)
            w = leader(at)
            p = _softmax(x @ w)
            p[y] -= 1.0
            g = np.outer(x, p)
            sigma = (np.sqrt(n[at] + g * g) - np.sqrt(n[at])) / alpha
            z[at] += g - sigma * w
            n[at] += g * g
    return leader(np.arange(BUCKETS + 1))


def temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature with the least negative log-likelihood (golden section
    on its logarithm; convex there for practical purposes)."""
    if not len(labels):
        return 1.0

    def loss(log_t):
        z = logits / math.exp(log_t)
        z = z - z.max(axis=1, keepdims=True)
        return float((np.log(np.exp(z).sum(axis=1)) - z[np.arange(len(labels)), labels]).mean())

    a, b, r = math.log(0.05), math.log(20.0), (math.sqrt(5) - 1) / 2
    c, d = b - r * (b - a), a + r * (b - a)
    for _ in range(40):
        if loss(c) <= loss(d):
            b, d = d, c
            c = b - r * (b - a)
        else:
            a, c = c, d
            d = a + r * (b - a)
    return math.exp((a + b) / 2)


def _sample_features(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(u, lang, *(x.astype(np.int32).tobytes() for x in counts(t)))
                for u, lang, t in zip(pdf["u"], pdf["lang"], pdf["text"], strict=True) if has_letter(t)]
        yield pd.DataFrame(rows, columns=["u", "lang", "at", "n"])


def _frequencies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs = np.zeros(BUCKETS, dtype=np.int64), 0
    for batch in batches:
        for t in batch.column(0):
            t = t.as_py()
            if has_letter(t):
                total[counts(t)[0]] += 1
                docs += 1
    at = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(np.append(at, BUCKETS).astype(np.int32)),
                                      pa.array(np.append(total[at], docs))], names=["bucket", "df"])


def fit(train: DataFrame, per_lang: int = PER_LANG) -> Model:
    """Fit on ``train(doc_id, text, lang)``.  Rows with null lang, null text or
    no letter teach nothing; without any other the model answers ``und``."""
    usable = train.where("lang is not null and text is not null").select(
        F.col("doc_id").cast("string").alias("doc_id"), F.col("text").cast("string").alias("text"),
        F.col("lang").cast("string").alias("lang"))
    per = usable.groupBy("lang").agg(F.count(F.lit(1)).alias("c")).orderBy(F.desc("c"), "lang").limit(MAX_LANGS + 1).collect()
    if len(per) > MAX_LANGS:
        raise ValueError(f"more than {MAX_LANGS} values of lang: none is left out, and the weights of all do not fit the driver")
    df = np.zeros(BUCKETS + 1, dtype=np.int64)
    for r in (usable.select("text").mapInArrow(_frequencies, "bucket int, df long")
              .groupBy("bucket").agg(F.sum("df").alias("df")).collect()):
        df[r.bucket] = r.df
    idf = np.log((1.0 + df[-1]) / (1.0 + df[:-1])) + 1.0
    if not per:
        return Model([], idf, np.zeros((BUCKETS + 1, 0)), 1.0)
    # each row draws a number by its doc_id; a language's share is set so that
    # about per_lang rows are below it
    draw = F.pmod(F.xxhash64("doc_id"), F.lit(1 << 30)) / float(1 << 30)
    share = F.coalesce(*(F.when(F.col("lang") == r.lang, F.lit(min(1.0, per_lang / r.c))) for r in per), F.lit(0.0))
    pdf = (usable.withColumn("u", draw).where(F.col("u") < share).select("u", "lang", "text")
           .mapInPandas(_sample_features, "u double, lang string, at binary, n binary").toPandas())
    langs = sorted(pdf["lang"].unique())
    model = Model(langs, idf, np.zeros((BUCKETS + 1, len(langs))), 1.0)
    pdf["order"] = (pdf["u"] * (1 << 30)).astype(np.int64) * 2654435761 % (1 << 32)
    rows = []
    for _, lang, at, n, _ in pdf.sort_values(["order", "lang", "at", "n"]).itertuples(index=False):
        at, n = np.frombuffer(at, np.int32), np.frombuffer(n, np.int32)
        rows.append((at, model.vector(at, n), langs.index(lang)))
    held, taught = rows[::5], [r for i, r in enumerate(rows) if i % 5] or rows
    model.weights = ftrl(taught, len(langs))
    logits = np.array([x @ model.weights[at] + model.weights[-1] for at, x, _ in held])
    model.temperature = temperature(logits, np.array([y for _, _, y in held]))
    model.weights = model.weights.astype(np.float32)
    model.idf = model.idf.astype(np.float32)
    return model


def held_out(doc_id: Column, folds: int, fold: int) -> Column:
    """Whether crc32 of the id as text falls into the fold; a null id does not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == fold, F.lit(False))


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, lang_pred, score per row, from the text alone.  Null texts and
    texts without a letter are ``und`` with score 0; repeated rows and null ids
    are answered each; other columns are ignored."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            said = [model.predict(t.as_py()) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in said], pa.string()),
                                              pa.array([x for _, x in said], pa.float64())],
                                             names=["doc_id", "lang_pred", "score"])

    return (docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
            .mapInArrow(run, "doc_id long, lang_pred string, score double"))

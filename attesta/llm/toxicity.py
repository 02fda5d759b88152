"""Toxicity: a linear classifier of character n-grams scaled by naive Bayes log-count ratios.

A text's features are the distinct hashed n-grams of its words. On labelled rows, r = log ratio of a feature's smoothed
share of toxic and other texts; features of the largest ratios are kept, each has the value r, and a logistic
regression with an L2 penalty learns the weights. Scoring passes whole texts slice by slice through one table of
weights, whose size is bounded by 2**BITS.

Learning takes at most ``max_rows`` labelled documents, those of the smallest id hash, of ``max_chars`` characters together (a text that
would pass this is left out), and keeps the ``features`` n-grams of the largest ratios; labels, language, source and
id are no features. Of rows that share an id the least text counts. Defined cases: a text that is null, empty or without words scores the intercept; a label
that is null or other than 0 and 1 teaches nothing; a repeated label row counts once; without both classes the
score is the share of toxic rows (0 without any); a null id is not held out and teaches nothing.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.charfeatures import held_out, sigmoid, take_apart
from attesta.llm.shared import Scratch
from attesta.llm.textarrays import slices

LENGTHS, BITS = (3, 4, 5), 20
MAX_ROWS, MAX_CHARS, FEATURES, SMOOTH, PENALTY, STEPS = 12_000, 60_000_000, 10_000, 0.5, 1e-3, 300
SLICE = 1 << 20


def fit(texts: list, labels: np.ndarray, features: int = FEATURES) -> tuple[np.ndarray, np.ndarray, float]:
    """Features, their weights with the ratio multiplied in, intercept.

    Minimises the mean logistic loss plus PENALTY / 2 times the squared weights (not the intercept) by Nesterov's method.
    """
    y = labels.astype(np.float64)
    none = np.zeros(0, np.int64), np.zeros(0), float(np.log((y.sum() + 1e-9) / (len(y) - y.sum() + 1e-9))) if len(y) else -50.0
    if not len(y) or y.min() == y.max():
        return none
    every = np.ones(1 << BITS, bool)
    chunks = [range(a, min(a + 400, len(texts))) for a in range(0, len(texts), 400)]

    def rows(chosen):
        for c in chunks:
            row, f = take_apart(pa.array([texts[i] for i in c], pa.large_string()), LENGTHS, BITS).distinct(chosen)
            yield row + c[0], f

    count = np.zeros((2, 1 << BITS))
    for row, f in rows(every):
        for k in (0, 1):
            count[k] += np.bincount(f[y[row] == k], minlength=1 << BITS)
    share = [(count[k] + SMOOTH) / (count[k].sum() + SMOOTH * (count.sum(0) > 0).sum()) for k in (0, 1)]
    r = np.where(count.sum(0) > 1, np.log(share[1] / share[0]), 0.0)
    # ratio times the root of the number of texts: far from chance, not only rare
    weight = np.abs(r) * np.sqrt(count.sum(0))
    top = np.sort(np.argsort(-weight, kind="stable")[:features])
    top = top[weight[top] > 0]
    if not len(top):
        return none
    chosen = np.zeros(1 << BITS, bool)
    chosen[top] = True
    place = np.zeros(1 << BITS, np.int32)
    place[top] = np.arange(len(top))
    got = [(row.astype(np.int32), place[f]) for row, f in rows(chosen)]
    row, col = np.concatenate([x for x, _ in got]), np.concatenate([x for _, x in got])
    value = r[top][col]
    # the loss bends by a quarter of the mean squared length of the rows in the steepest direction, which power iteration finds
    x = np.ones(len(top) + 1)
    for _ in range(20):
        x /= np.sqrt((x * x).sum())
        along = np.bincount(row, weights=value * x[:-1][col], minlength=len(y)) + x[-1]
        x = np.r_[np.bincount(col, weights=value * along[row], minlength=len(top)), along.sum()] / len(y)
    rate = 1 / (0.25 * 1.1 * np.sqrt((x * x).sum()) + PENALTY)
    w = prev = np.zeros(len(top) + 1)
    for k in range(STEPS):
        z = w + k / (k + 3) * (w - prev)
        p = sigmoid(np.bincount(row, weights=value * z[:-1][col], minlength=len(y)) + z[-1])
        g = np.r_[np.bincount(col, weights=value * (p - y)[row], minlength=len(top)), (p - y).sum()] / len(y) + PENALTY * np.r_[z[:-1], 0.0]
        prev, w = w, z - rate * g
    return top, w[:-1] * r[top], float(w[-1])


def _score(model, threshold: float):
    def run(batches):
        feature, weight, intercept = model
        table = np.zeros(1 << BITS)
        table[feature] = weight
        chosen = np.zeros(1 << BITS, bool)
        chosen[feature] = True
        for b in slices(batches, "text", SLICE):
            row, f = take_apart(b.column("text"), LENGTHS, BITS).distinct(chosen)
            score = sigmoid(np.bincount(row, weights=table[f], minlength=b.num_rows) + intercept)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(score), pa.array((score >= threshold).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return run


def score_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", modulus: int = 4, remainder: int = 2, threshold: float = 0.3, max_rows: int = MAX_ROWS, max_chars: int = MAX_CHARS, features: int = FEATURES) -> DataFrame:
    """doc_id, held_out, score, predicted of each row; learns from labelled rows that are not held out."""
    scratch = Scratch(docs.sparkSession, "toxicity")
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("doc_id", modulus, remainder))
    known = labels.where(F.col(label_col).isin(0, 1)).groupBy(F.col(id_col).alias("doc_id")).agg(F.max(label_col).alias("y")).where(~held_out("doc_id", modulus, remainder))
    # at most max_rows ids, so the broadcast is bounded
    some = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(max_rows)
    # however many rows an id has, one of them is kept; at most max_rows
    picked = scratch.table(base.where("not held_out").join(F.broadcast(some), "doc_id").groupBy("doc_id", "y").agg(F.min("text").alias("text")), "labelled")
    sizes = picked.select("doc_id", F.coalesce(F.char_length("text"), F.lit(0)).alias("n")).orderBy(F.xxhash64("doc_id"), "doc_id").collect()
    total, over = 0, []
    for r in sizes:
        if total + r["n"] > max_chars:
            over.append(r["doc_id"])
        else:
            total += r["n"]
    got = (picked.where(~F.col("doc_id").isin(over)) if over else picked).toPandas()
    got = got.sort_values("doc_id") if len(got) else got
    scratch.drop()
    model = fit(got["text"].tolist(), got["y"].to_numpy(np.int64), features)
    return base.mapInArrow(_score(model, threshold), f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, score double, predicted int")


def op3_toxicity(spark, sf_dir: str) -> DataFrame:
    return score_toxicity(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))

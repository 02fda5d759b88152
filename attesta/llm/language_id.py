"""Language identification by hierarchical discrimination of character n-grams.

First the family: multinomial naive Bayes over hashed n-grams. Then, within the family, one linear support vector
machine for each pair of its languages; most votes win, the sum of margins breaks ties. All scores are sums over
words, so a text costs one lookup for each distinct word of a slice, whatever its length.

Learning takes at most ``max_rows`` texts of ``max_chars`` characters together, shared evenly among the languages and at most ``per_language``
of each: those of the smallest hash of id and text (a text that would pass the share of characters is left out; equal rows count once).
Defined cases: a text that is null or has no letter is ``und`` with score 0; a null language teaches nothing; a
language without a listed family is a family of its own; with nothing to learn from all texts are ``und``; a null id is not held
out; repeated rows each get a row.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attesta.llm.charfeatures import held_out, sigmoid, take_apart
from attesta.llm.shared import Scratch
from attesta.llm.textarrays import slices

#: ISO 639-1 codes by family.
FAMILIES = {
    "germanic": ["en", "de", "nl", "sv", "da", "no", "nb", "nn", "is", "af", "lb", "fy", "yi"],
    "romance": ["fr", "es", "it", "pt", "ro", "ca", "gl", "oc"],
    "slavic": ["ru", "uk", "be", "pl", "cs", "sk", "sl", "hr", "sr", "bs", "bg", "mk"],
    "baltic": ["lt", "lv"],
    "celtic": ["ga", "gd", "cy", "br"],
    "uralic": ["fi", "et", "hu"],
    "turkic": ["tr", "az", "kk", "ky", "uz", "tk", "tt"],
    "indo-aryan": ["hi", "ur", "bn", "pa", "gu", "mr", "ne", "si"],
    "dravidian": ["ta", "te", "kn", "ml"],
    "semitic": ["ar", "he", "am", "mt"],
}
LENGTHS, BITS = (1, 2, 3, 4), 17
MAX_ROWS, PER_LANGUAGE, MAX_CHARS = 4_000, 500, 30_000_000
EPOCHS, PENALTY = 60, 1e-4
SLICE = 1 << 20


def family_of(lang: str) -> str:
    base = lang.lower().split("-")[0].split("_")[0]
    return next((f for f, codes in FAMILIES.items() if base in codes), f"only {lang}")


def fit(texts: list, langs: list[str]) -> dict:
    """families, tables of log probability, languages of each family, and for each pair of a family a table and an intercept."""
    dims = 1 << BITS
    names = sorted(set(langs))
    y = np.array([names.index(x) for x in langs], np.int64)
    parts = []
    for a in range(0, len(texts), 400):
        row, f, c = take_apart(pa.array(texts[a : a + 400], pa.large_string()), LENGTHS, BITS).counts(dims)
        parts.append(((row + a).astype(np.int32), f.astype(np.int32), c.astype(np.float32)))
    row, feat, count = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.float32))
    total = np.maximum(np.bincount(row, weights=count, minlength=len(texts)), 1)
    family = [family_of(x) for x in names]
    groups = sorted(set(family))
    of = np.array([groups.index(x) for x in family], np.int64)
    share = count / total[row]
    log_p = []
    for k in range(len(groups)):
        m = of[y[row]] == k
        # every text has one vote, whatever its length; only n-grams seen at all are smoothed
        mass = np.bincount(feat[m], weights=share[m], minlength=dims)
        log_p.append(np.log((mass + 1e-3) / (mass.sum() + 1e-3 * dims)))
    base = np.mean(log_p, 0) if log_p else np.zeros(dims)
    mean = np.bincount(feat, weights=share, minlength=dims) / max(1, len(texts))
    scale = np.where(mean > 0, 1 / np.sqrt(mean + 1e-6), 0.0)
    rng = np.random.default_rng(7)
    pairs = {}
    for k in range(len(groups)):
        for i, j in combinations([n for n in range(len(names)) if of[n] == k], 2):
            pairs[(i, j)] = _svm(row, feat, share * scale[feat], y, i, j, scale, rng)
    return {"names": names, "family": of, "log_p": [x - base for x in log_p], "pairs": pairs}


def _svm(row, feat, value, y, i: int, j: int, scale: np.ndarray, rng) -> tuple[np.ndarray, float]:
    """Squared hinge loss with an L2 penalty, full gradients with momentum. Positive is language i."""
    m = (y[row] == i) | (y[row] == j)
    docs, r = np.unique(row[m], return_inverse=True)
    cols, c = np.unique(feat[m], return_inverse=True)
    v = value[m]
    sign = np.where(y[docs] == i, 1.0, -1.0)
    weight = np.where(sign > 0, 0.5 / max(1, (sign > 0).sum()), 0.5 / max(1, (sign < 0).sum()))
    w = prev = np.zeros(len(cols) + 1)
    rate = 0.5 / (np.bincount(r, weights=v * v).max(initial=0) + 1)
    for k in range(EPOCHS):
        z = w + k / (k + 3) * (w - prev)
        slack = np.maximum(0, 1 - sign * (np.bincount(r, weights=v * z[:-1][c], minlength=len(docs)) + z[-1]))
        g = -2 * weight * sign * slack
        grad = np.r_[np.bincount(c, weights=v * g[r], minlength=len(cols)) + PENALTY * z[:-1], g.sum()]
        prev, w = w, z - rate * grad
    table = np.zeros(len(scale))
    table[cols] = w[:-1] * scale[cols]
    return table, float(w[-1])


def classify(model: dict, texts) -> tuple[list[str], np.ndarray]:
    s = take_apart(texts, LENGTHS, BITS)
    names = model["names"]
    total = np.maximum(s.row_sums(np.bincount(s.owner, minlength=s.n_words)), 1)
    has = s.row_sums(s.has_letter.astype(float)) > 0 if s.n_words else np.zeros(s.n, bool)
    if not names:
        return ["und"] * s.n, np.zeros(s.n)
    logit = np.stack([s.row_sums(s.word_sums(t)) for t in model["log_p"]], 1) if s.n_words else np.zeros((s.n, len(model["log_p"])))
    # the evidence of a text grows with its length only up to a hundred n-grams: they depend on each other
    logit *= (np.minimum(total, 100) / total)[:, None]
    logit -= logit.max(1, keepdims=True)
    p = np.exp(logit)
    p /= p.sum(1, keepdims=True)
    fam = p.argmax(1)
    votes, margin = np.zeros((s.n, len(names))), np.zeros((s.n, len(names)))
    for (i, j), (table, b) in model["pairs"].items():
        d = (s.row_sums(s.word_sums(table)) if s.n_words else np.zeros(s.n)) / total + b
        votes[:, i] += d >= 0
        votes[:, j] += d < 0
        margin[:, i] += d
        margin[:, j] -= d
    outside = np.array(model["family"])[None, :] != fam[:, None]
    votes[outside] = -1
    best = np.lexsort((margin, votes), axis=1)[:, -1] if len(names) > 1 else np.zeros(s.n, np.int64)
    inside = (~outside).sum(1)
    sure = np.where(inside > 1, sigmoid(3 * margin[np.arange(s.n), best] / np.maximum(inside - 1, 1)), 1.0)
    score = np.where(has, p[np.arange(s.n), fam] * sure, 0.0)
    return [names[k] if ok else "und" for k, ok in zip(best, has)], score


def _predict(model: dict):
    def run(batches):
        for b in slices(batches, "text", SLICE):
            lang, score = classify(model, b.column("text"))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("held_out"), pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=["doc_id", "held_out", "lang_pred", "score"])

    return run


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", modulus: int = 4, remainder: int = 2, max_rows: int = MAX_ROWS, per_language: int = PER_LANGUAGE, max_chars: int = MAX_CHARS) -> dict:
    """The model of texts with a known language that are not held out."""
    base = docs.where(~held_out(id_col, modulus, remainder) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    n = {r["lang"]: r["n"] for r in base.groupBy(F.col(lang_col).cast("string").alias("lang")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(max_rows).collect()}
    each = min(per_language, max(1, max_rows // max(1, len(n))))
    # a share of a language's hashes that has a third more rows than wanted; then exactly as many
    h = F.xxhash64(F.lit("language-id"), F.col(id_col), F.col(text_col))
    below = {k: int(min(1.0, (1.33 * each + 30) / v) * (2**64 - 1)) - 2**63 for k, v in n.items()}
    pairs = [F.lit(x) for k, v in below.items() for x in (k, min(v, 2**63 - 1))]
    some = base.where(h <= F.create_map(*pairs)[F.col(lang_col).cast("string")]) if pairs else base.limit(0)
    some = some.select(h.alias("h"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang"))
    # hashes and lengths first; then the chosen texts, each once however often it occurs
    sizes = some.groupBy("h", "lang").agg(F.max(F.char_length("text")).alias("n")).orderBy("h", "lang").limit(4 * max_rows).collect()
    room, taken, chosen = dict.fromkeys(n, max_chars // max(1, len(n))), dict.fromkeys(n, 0), []
    for r in sizes:
        if taken[r["lang"]] < each and r["n"] <= room[r["lang"]]:
            room[r["lang"]] -= r["n"]
            taken[r["lang"]] += 1
            chosen.append((r["h"], r["lang"]))
    keys = docs.sparkSession.createDataFrame(chosen, "h long, lang string")
    got = some.join(F.broadcast(keys), ["h", "lang"]).groupBy("h", "lang").agg(F.min("text").alias("text")).toPandas().sort_values(["h", "lang"])
    return fit(got["text"].tolist(), got["lang"].tolist())


def identify(docs: DataFrame, model: dict, id_col: str = "doc_id", text_col: str = "text", modulus: int = 4, remainder: int = 2) -> DataFrame:
    """doc_id, held_out, lang_pred, score of each row."""
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).withColumn("held_out", held_out("doc_id", modulus, remainder))
    return base.mapInArrow(_predict(model), f"doc_id {dict(base.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def _keep(model: dict, text_col: str, lang_col: str, min_score: float):
    def run(batches):
        for b in slices(batches, text_col, SLICE):
            lang, score = classify(model, b.column(text_col))
            known = pa.array(lang, pa.string())
            filled = pc.coalesce(b.column(lang_col), known)
            b = b.set_column(b.schema.get_field_index(lang_col), lang_col, filled)
            yield b.filter(pc.and_(pc.not_equal(known, "und"), pa.array(score >= min_score)))

    return run


def keep_identified(docs: DataFrame, model: dict, text_col: str = "text", lang_col: str = "lang", min_score: float = 0.2) -> DataFrame:
    """The rows of docs whose language is found with a score of min_score or more, in one pass; a null lang is filled in."""
    return docs.mapInArrow(_keep(model, text_col, lang_col, min_score), docs.schema)


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    Scratch(spark, "language")
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return identify(docs, learn(docs))

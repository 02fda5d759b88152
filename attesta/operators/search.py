"""A stand-in for the external passage search: BM25 over texts and cosine over vectors, both as plans that keep only query terms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

K1, B = 1.2, 0.75


def tokens(c: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(c, F.lit(""))), r"[^a-z0-9]+"), lambda w: w != "")


def bm25(docs: DataFrame, query: str, limit: int = 12, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id_col, score of the best documents. Only rows of query terms are exploded; lengths are one aggregate of the same scan."""
    import re

    terms = sorted({w for w in re.split(r"[^a-z0-9]+", query.lower()) if w})
    limit = max(1, min(limit, 12))
    if not terms:
        return docs.select(id_col, F.lit(0.0).alias("score")).limit(0)
    t = docs.select(id_col, tokens(F.col(text_col)).alias("w")).select(id_col, F.size("w").alias("dl"), F.filter("w", lambda x: x.isin(terms)).alias("hits"))
    total = t.agg(F.count("*").alias("n"), F.avg("dl").alias("avg_dl"))
    tf = t.where(F.size("hits") > 0).select(id_col, "dl", F.explode("hits").alias("term")).groupBy(id_col, "dl", "term").agg(F.count("*").alias("tf"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))  # a row for each query term
    idf = F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avg_dl")))
    scored = tf.join(F.broadcast(df), "term").crossJoin(F.broadcast(total)).groupBy(id_col).agg(F.round(F.sum(part), 6).alias("score"))
    return scored.orderBy(F.desc("score"), id_col).limit(limit)


def cosine(vectors: DataFrame, query: list[float], limit: int = 12, id_col: str = "vec_id", vec_col: str = "embedding") -> DataFrame:
    """id_col, score of the nearest vectors of the query's length."""
    q = F.array(*[F.lit(float(x)) for x in query])
    dot = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y), F.lit(0.0), lambda s, x: s + x)
    v = vectors.where((F.size(vec_col) == len(query)) & F.exists(vec_col, lambda x: x != 0))
    norm = F.sqrt(dot(F.col(vec_col), F.transform(vec_col, lambda x: x.cast("double"))))
    score = F.round(dot(F.col(vec_col), q) / (norm * float(sum(x * x for x in query) ** 0.5 or 1.0)), 6)
    return v.select(id_col, score.alias("score")).orderBy(F.desc("score"), id_col).limit(limit)

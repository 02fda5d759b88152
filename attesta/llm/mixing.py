"""Mixes sources to target weights by Poisson replication [DataFrame functions only].

A source's rate is its target size over its size. A document's number of copies is a Poisson variable of that mean,
inverted at a uniform number that is a hash of seed and id, so reruns, lost executors and other partitionings
give the same rows. Copies are then dealt to range partitions of a hash, which is a global shuffle. Counting sizes
is one aggregation with a row for each source and task; a source of any share of the rows is never gathered.

Defined cases: a null source is a source of its own; a null text has size 0; a source of size 0 has rate 1; a
source with weight 0 goes; a null id hashes as the text "null"; rows that share an id get the same number of copies; input
columns named like the outputs (mix_copy, mix_copies, mix_key) are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attesta.llm.shared import Scratch, parts_of

#: Mean of one inversion; larger means are sums of independent draws.
STEP = 16.0
BROADCAST_ROWS = 100_000
SEED, ALPHA = "mix-1", 0.7


def uniform(*parts: Column | str) -> Column:
    """A number in [0, 1) from 52 bits of a hash of the parts."""
    text = F.concat_ws(":", *[F.lit(p) if isinstance(p, str) else F.coalesce(p.cast("string"), F.lit("null")) for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("long") / F.lit(4503599627370496.0)


def _cdf(rate: Column) -> Column:
    """The Poisson distribution function at 0, 1, ... up to where it no longer grows."""
    top = F.ceil(rate + 12 * F.sqrt(rate) + 24).cast("int")
    first = F.exp(-rate)
    start = F.struct(first.alias("p"), F.array(first).alias("c"))
    step = lambda a, k: F.struct((a["p"] * rate / k).alias("p"), F.concat(a["c"], F.array(F.element_at(a["c"], -1) + a["p"] * rate / k)).alias("c"))
    return F.aggregate(F.sequence(F.lit(1), top), start, step, lambda a: a["c"])


def source_rates(docs: DataFrame, source: str, text: str, weights: dict[str, float] | None, alpha: float) -> DataFrame:
    """mix_source, rate. Without weights a source weighs its characters to the power alpha; the total is kept."""
    size = docs.groupBy(F.col(source).alias("mix_source")).agg(F.coalesce(F.sum(F.char_length(text).cast("long")), F.lit(0)).alias("n"))
    if weights is None:
        size = size.withColumn("w", F.pow(F.col("n").cast("double"), F.lit(alpha)))
    else:
        pairs = [F.lit(x) for k, v in weights.items() for x in (k, float(v))]
        size = size.withColumn("w", F.coalesce(F.create_map(*pairs)[F.col("mix_source")] if pairs else F.lit(None).cast("double"), F.lit(0.0)))
    total = size.agg(F.sum("n").alias("tn"), F.sum("w").alias("tw"))
    return size.crossJoin(F.broadcast(total)).select("mix_source", F.when(F.col("n") == 0, 1.0).when(F.col("tw") == 0, 0.0).otherwise(F.col("tn") * F.col("w") / F.col("tw") / F.col("n")).alias("rate"))


def poisson_mix(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, seed: str = SEED, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text") -> DataFrame:
    """Every row of docs as often as drawn, with mix_copy (from 1), mix_copies and mix_key, the place in the global order."""
    docs = docs.drop("mix_copy", "mix_copies", "mix_key")
    # a row for each source, counted in one pass and kept; broadcast only when there are few
    rates = Scratch(docs.sparkSession, "mix").table(source_rates(docs, source_col, text_col, weights, alpha), "rates")
    few = rates.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS
    rates = rates.withColumn("draws", F.greatest(F.lit(1), F.ceil(F.col("rate") / STEP)).cast("int"))
    rates = rates.select("mix_source", "draws", _cdf(F.col("rate") / F.col("draws")).alias("cdf"))
    held = docs.join(F.broadcast(rates) if few else rates, F.col(source_col).eqNullSafe(F.col("mix_source")))
    # one hash for each draw, before the distribution function is read
    us = F.transform(F.sequence(F.lit(1), F.col("draws")), lambda j: uniform(seed, F.col(id_col), j))
    drawn = F.aggregate(us, F.lit(0), lambda n, u: n + F.size(F.filter(F.col("cdf"), lambda c: c <= u)))
    held = held.withColumn("mix_copies", drawn).where("mix_copies > 0").drop("mix_source", "draws", "cdf")
    held = held.withColumn("mix_copy", F.explode(F.sequence(F.lit(1), F.col("mix_copies"))))
    held = held.withColumn("mix_key", F.md5(F.concat_ws(":", F.lit(f"{seed}-order"), F.coalesce(F.col(id_col).cast("string"), F.lit("null")), F.col("mix_copy"))))
    return held.repartitionByRange(parts_of(docs.sparkSession), "mix_key").sortWithinPartitions("mix_key")


def op7_poisson_mix(spark, sf_dir: str) -> DataFrame:
    return poisson_mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP7_SQL = f"""
WITH RECURSIVE size AS (
  SELECT source AS s, coalesce(sum(length(text)), 0)::BIGINT AS n, pow(coalesce(sum(length(text)), 0)::DOUBLE, {ALPHA}) AS w
  FROM documents GROUP BY source),
rate AS (
  SELECT s, CASE WHEN n = 0 THEN 1.0 ELSE (SELECT sum(n)::BIGINT FROM size) * w / (SELECT sum(w) FROM size) / n END AS rate FROM size),
draw AS (SELECT s, greatest(1, ceil(rate / {STEP}))::INT AS draws, rate / greatest(1, ceil(rate / {STEP}))::INT AS m FROM rate),
cdf(s, draws, m, k, p, c) AS (
  SELECT s, draws, m, 0, exp(-m), exp(-m) FROM draw
  UNION ALL
  SELECT s, draws, m, k + 1, p * m / (k + 1), c + p * m / (k + 1) FROM cdf WHERE k + 1 <= ceil(m + 12 * sqrt(m) + 24)),
cdfs AS (SELECT s, draws, list(c ORDER BY k) AS cs FROM cdf GROUP BY s, draws),
counted AS (
  SELECT d.*, CAST(list_sum(list_transform(range(1, c.draws + 1), lambda j: len(list_filter(c.cs, lambda x: x <=
    ('0x' || substr(md5('{SEED}:' || coalesce(d.doc_id::VARCHAR, 'null') || ':' || j::VARCHAR), 1, 13))::BIGINT / 4503599627370496.0)))) AS INTEGER) AS mix_copies
  FROM documents d JOIN cdfs c ON d.source IS NOT DISTINCT FROM c.s)
SELECT x.*, g.mix_copy::INTEGER AS mix_copy, md5('{SEED}-order:' || coalesce(doc_id::VARCHAR, 'null') || ':' || g.mix_copy::VARCHAR) AS mix_key
FROM counted x, LATERAL (SELECT unnest(range(1, x.mix_copies + 1)) AS mix_copy) g
"""

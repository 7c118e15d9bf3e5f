r"""Mixing sources to target weights by Pareto order sampling.

Each source has a target in words. Every document gets the whole copies that target / size of its
source allows for certain; what is left of the target is drawn without replacement, with odds of
inclusion in proportion to a document's words. Documents so long that this would be 1 or more are
certain and taken out first, and the rest is rescaled (as often as that makes others certain). The
others rank by random odds divided by their inclusion odds (Pareto sampling), and the ranks are
taken in order until the words taken meet what is left: the sample's size is fixed in words.
Native DataFrame functions only.

A source may hold any share of the rows. Which documents are certain follows from one row for each
source and size (at most the square root of twice the words of a source). Ranks fall into
``BUCKETS`` buckets and each of those into as many again; words are summed by source and bucket
before the shuffle, and only the innermost bucket in which a source's draw ends is ordered row by
row. Choosing a row then is a comparison with a few values of its source. Sources are numbered and
levelled on range partitions; the driver gets sums only.

Defined cases: null or empty text has size 0 and takes no words; a null source is a source of
its own, last in order; the random odds come from a digest of doc_id and text, so reruns agree
and rows equal in both (also null) are taken or left together; an empty table or one without
words gives targets of 0; further columns play no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from denspark.lineage import cut
from denspark.sources.readers import number_rows

#: Weights of the sources in code point order, repeated; words of the mix, and of a source, by words there.
WEIGHTS, TOTAL, MOST = (3, 1, 2), 1.5, 2
#: Buckets of ranks, and of the ranks in one of them.
BUCKETS = 4096
WORD = r"[^\x20\x09-\x0D]+"


def _odds() -> Column:
    """Random odds from the row's digest."""
    digest = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.coalesce("text", F.lit(""))).cast("binary"))
    u = (F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") + 0.5) / float(1 << 52)
    return u / (1 - u)


def _size() -> Column:
    return F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")


def targets(sizes: DataFrame, weights=WEIGHTS, total: float = TOTAL, most: float = MOST) -> DataFrame:
    """(source, source_size) -> the same with ``target``: shares by weight, none above ``most`` times its size.

    A common level times its weight is a source's share. Sources above their limit stop there and the
    level of the others rises, until no more stop; each round is one aggregate.
    """
    order = sizes.select(F.col("source").isNull().alias("last"), "source", "source_size")
    w = F.element_at(F.lit([float(x) for x in weights]), (F.col("id") % len(weights) + 1).cast("int"))
    rows = cut(number_rows(order, ["last", "source"]).select("source", "source_size", w.alias("w"), (F.lit(float(most)) * F.col("source_size")).alias("cap")))
    sums = rows.agg(F.sum("source_size").alias("words"), F.sum("w").alias("w")).first()
    words = float(total) * (sums["words"] or 0)
    level, stopped = words / sums["w"] if sums["w"] else 0.0, -1
    while True:
        full = F.col("cap") <= F.col("w") * F.lit(level)
        now = rows.agg(F.count_if(full).alias("n"), F.sum(F.when(full, F.col("cap"))).alias("cap"), F.sum(F.when(~full, F.col("w"))).alias("w")).first()
        if now["n"] == stopped or not now["w"]:
            break
        stopped, level = now["n"], (words - (now["cap"] or 0.0)) / now["w"]
    return rows.select("source", "source_size", F.least("cap", F.col("w") * F.lit(level)).alias("target"))


def inclusion(counts: DataFrame) -> DataFrame:
    """(source, scale, certain_words) from (source, size, n, left): a document's inclusion probability is ``scale`` times its size, 1 at most.

    From the longest documents down, those that the scale of the rest would make certain are taken out.
    """
    words = (F.col("n") * F.col("size")).cast("decimal(20,0)")
    rows = counts.where("size > 0 and left > 0").withColumns({"words": words, "squares": words * F.col("size").cast("decimal(12,0)")})
    down = Window.partitionBy("source").orderBy(F.desc("size"))
    above = F.coalesce(F.sum("words").over(down.rowsBetween(Window.unboundedPreceding, -1)).cast("double"), F.lit(0.0))
    rest = F.sum("squares").over(down.rowsBetween(0, Window.unboundedFollowing)).cast("double")
    rows = rows.withColumn("above", above).withColumn("scale", (F.col("left") - F.col("above")) / rest).where(F.col("scale") * F.col("size") < 1)
    best = rows.groupBy("source").agg(F.max_by(F.struct("scale", "above"), "size").alias("best"))
    return best.select("source", "best.scale", F.col("best.above").alias("certain_words"))


def _chance() -> Column:
    return F.col("scale") * F.col("size")


def _rank() -> Column:
    """Pareto rank: random odds over inclusion odds; null for documents without words, and for certain ones."""
    p = _chance()
    return F.when((p > 0) & (p < 1), F.col("odds") / (p / (1 - p)))


def _bucket(rank: Column) -> Column:
    """Number among BUCKETS * BUCKETS, rising with the rank."""
    return F.least(F.lit(BUCKETS * BUCKETS - 1), F.floor(BUCKETS * BUCKETS * (rank / (1 + rank)))).cast("int")


def _on_source(rows: DataFrame, other: DataFrame, how: str = "inner") -> DataFrame:
    renamed = other.withColumnRenamed("source", "_of")
    return rows.join(renamed, rows["source"].eqNullSafe(renamed["_of"]), how).drop("_of")


def draws(sized: DataFrame, **how) -> DataFrame:
    """Per source: source_size, target, whole copies, scale, and the rank (bucket and value) at which its draw ends."""
    counts = cut(sized.groupBy("source", "size").agg(F.count("*").alias("n")))
    goal = targets(counts.groupBy("source").agg(F.sum(F.col("n") * F.col("size")).alias("source_size")), **how)
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    goal = goal.withColumn("whole", F.floor(rate).cast("long"))
    goal = cut(goal.withColumn("left", F.greatest(F.lit(0.0), F.col("target") - F.col("whole") * F.col("source_size"))))
    goal = cut(_on_source(goal, inclusion(_on_source(counts, goal.select("source", "left"))), "left").withColumn("left", F.col("left") - F.coalesce("certain_words", F.lit(0.0))))
    ranked = _on_source(sized, goal.select("source", "scale", "left")).withColumn("rank", _rank()).where("rank is not null")
    ranked = ranked.select("source", "size", "left", "rank", _bucket(F.col("rank")).alias("bucket"))
    last = None
    for step in (BUCKETS, 1):
        rows = ranked.withColumn("part", F.floor(F.col("bucket") / step).cast("int"))
        if last is None:
            rows = rows.withColumn("base", F.lit(0).cast("long"))
        else:
            rows = _on_source(rows, last).where(F.floor(F.col("bucket") / BUCKETS) == F.col("last_bucket"))
        sums = rows.groupBy("source", "part").agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first("base").alias("base"))
        running = Window.partitionBy("source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
        sums = sums.withColumn("base", F.col("base") + F.coalesce(F.sum("words").over(running), F.lit(0))).where("base < left")
        last = cut(sums.groupBy("source").agg(F.max("part").alias("last_bucket"), F.max_by("base", "part").alias("base")))
    edge = _on_source(ranked, last).where("bucket = last_bucket")
    edge = edge.groupBy("source", "rank").agg(F.sum("size").alias("words"), F.first("base").alias("base"), F.first("left").alias("left"))
    inner = Window.partitionBy("source").orderBy("rank").rowsBetween(Window.unboundedPreceding, -1)
    edge = edge.withColumn("upto", F.col("base") + F.coalesce(F.sum("words").over(inner), F.lit(0)) + F.col("words") / 2).where("upto < left")
    edge = edge.groupBy("source").agg(F.max("rank").alias("last_rank"))
    out = _on_source(_on_source(goal, last.drop("base"), "left"), edge, "left")
    return out.select("source", "source_size", "target", "whole", "scale", "last_bucket", "last_rank")


def _copies() -> Column:
    rank = _rank()
    drawn = (_bucket(rank) < F.col("last_bucket")) | ((_bucket(rank) == F.col("last_bucket")) & (rank <= F.col("last_rank")))
    return F.col("whole") + F.coalesce((_chance() >= 1) | drawn, F.lit(False)).cast("long")


def mix(docs: DataFrame, **how) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken (words the mix takes, repeats counted), source, copies and chance (of the last copy)."""
    sized = cut(docs.select("doc_id", "source", _size().alias("size"), _odds().alias("odds")))
    rows = _on_source(sized, cut(draws(sized, **how)))
    chance = F.least(F.lit(1.0), F.coalesce(_chance(), F.lit(0.0)))
    return rows.select("doc_id", "size", "source_size", "target", (F.col("size") * _copies()).alias("taken"), "source", _copies().alias("copies"), chance.alias("chance"))


def take_mix(docs: DataFrame, **how) -> DataFrame:
    """The documents that the mix takes, with their columns and ``copies`` (a column of that name is replaced)."""
    plan = cut(draws(cut(docs.select("source", _size().alias("size"), _odds().alias("odds"))), **how))
    own = F.struct(*[F.col(f"`{c}`") for c in docs.columns if c != "copies"]).alias("row")
    rows = docs.select(own, _odds().alias("odds"), F.col("source"), _size().alias("size"))
    rows = _on_source(rows, plan).withColumn("n", _copies()).where("n > 0")
    return rows.select("row.*", F.col("n").alias("copies"))


ORACLE_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, source, CAST(length(regexp_replace(regexp_replace(coalesce(text, ''), '[^\x20\x09-\x0D]+', 'w', 'g'), '[\x20\x09-\x0D]+', '', 'g')) AS BIGINT) AS size,
         (CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || coalesce(text, '')), 1, 13) AS BIGINT) + 0.5::DOUBLE) / 4503599627370496::DOUBLE AS u
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY 1),
w AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS nth, [3, 1, 2][CAST((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS INT)]::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
-- Shares by weight; sources above their cap stop there, and the rest is shared again.
r AS (
  SELECT 0 AS step, nth, source, source_size, w, cap, FALSE AS stopped, w * (1.5::DOUBLE * sum(source_size) OVER () / sum(w) OVER ()) AS share FROM w
  UNION ALL
  SELECT step + 1, nth, source, source_size, w, cap, stopped OR cap <= share,
         CASE WHEN stopped OR cap <= share THEN cap ELSE w * ((1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) FILTER (WHERE stopped OR cap <= share) OVER (), 0)) / sum(w) FILTER (WHERE NOT (stopped OR cap <= share)) OVER ()) END
  FROM r WHERE step < (SELECT count(*) FROM w)),
t AS (SELECT source, source_size, share AS target, CASE WHEN source_size > 0 THEN share / source_size ELSE 0 END AS rate FROM r WHERE step = (SELECT count(*) FROM w)),
t2 AS (SELECT *, CAST(floor(rate) AS BIGINT) AS whole, greatest(0.0::DOUBLE, target - floor(rate) * source_size) AS rest FROM t),
-- Documents in proportion to size; from the longest down, those that are certain are taken out.
h AS (SELECT source, size, count(*) AS n FROM d WHERE size > 0 GROUP BY 1, 2),
i AS (SELECT h.source, h.size, t2.rest, CAST(coalesce(sum(n::HUGEINT * size) OVER (PARTITION BY h.source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE) AS above,
             CAST(sum(n::HUGEINT * size * size) OVER (PARTITION BY h.source ORDER BY size ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS DOUBLE) AS squares
      FROM h JOIN t2 ON h.source IS NOT DISTINCT FROM t2.source WHERE t2.rest > 0),
c AS (SELECT source, (rest - above) / squares AS scale, above FROM i WHERE (rest - above) / squares * size < 1 QUALIFY row_number() OVER (PARTITION BY source ORDER BY size DESC) = 1),
x AS (
  SELECT d.doc_id, d.source, d.size, d.u / (1 - d.u) AS odds, t2.source_size, t2.target, t2.whole, t2.rest - coalesce(c.above, 0) AS rest, coalesce(c.scale * d.size, 0) AS p
  FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
y AS (SELECT *, CASE WHEN p > 0 AND p < 1 THEN odds / (p / (1 - p)) END AS rank FROM x),
z AS (SELECT *, sum(CASE WHEN rank IS NULL THEN 0 ELSE size END) OVER (PARTITION BY source ORDER BY rank NULLS LAST RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto,
             sum(size) OVER (PARTITION BY source, rank) AS own FROM y),
k AS (SELECT *, CAST(whole + CASE WHEN p >= 1 OR rank IS NOT NULL AND upto - own + own / 2.0::DOUBLE < rest THEN 1 ELSE 0 END AS BIGINT) AS copies FROM z)
SELECT doc_id, size, source_size, target, CAST(size * copies AS BIGINT) AS taken, source, copies, least(1.0::DOUBLE, p) AS chance FROM k
"""

"""Operator 8: mix sources to target weights by Pareto order sampling.

Each source gets a target number of words. A document is taken in whole copies: first the copies
that are certain (the whole part of target / source size), then at most one more, drawn with unequal
probabilities proportional to size (capped at one) so that the expected words equal what is left.

Pareto order sampling ranks the documents of a source by q = (u / (1 - u)) / (p / (1 - p)), u a random
number that belongs to the document (a hash of its id, its text and the seed) and p its inclusion probability,
and takes the front of that order. The size of the sample is fixed in words: the front ends before it
passes what is left, and one closing document, the one nearest to the remaining gap, completes it.

Sums over sizes, sizes by rank bucket and sources are partial aggregates; only the one rank bucket of
a source in which its sample ends is sorted row by row. No source is gathered in a task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from . import common

#: Rank buckets of a source; they only divide the work.
BUCKETS = 4096


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0) -> DataFrame:
    """`source, source_size, target` of `sizes(source, size)`: water-filling of share x all words by weight.

    Sources by code point, null last, take the weights in turn. A target stops at `most` times its
    source's size; what it leaves is dealt to the others by weight. Sources in the order of
    (cap / weight) fill up first, so the level at which the rest stands follows from running sums.
    One row per source meets in one task.
    """
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    by_name = Window.orderBy(F.col("source").asc_nulls_last())
    place = F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights)))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (place + 1).cast("int"))
    sources = sources.withColumn("weight", weight).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    fill = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("source").asc_nulls_last())
    everything = Window.partitionBy()
    before, after = fill.rowsBetween(Window.unboundedPreceding, -1), fill.rowsBetween(0, Window.unboundedFollowing)
    left = F.sum("source_size").over(everything) * F.lit(float(share)) - F.coalesce(F.sum("cap").over(before), F.lit(0.0))
    level = left / F.sum("weight").over(after)
    sources = sources.withColumn("fits", level * F.col("weight") < F.col("cap")).withColumn("level", level)
    # the level of the first source that does not fill up; behind it caps above the level were taken off, so it is the largest
    final = F.max(F.when(F.col("fits"), F.col("level"))).over(everything)
    target = F.when(final.isNull(), F.col("cap")).otherwise(F.least(F.col("cap"), final * F.col("weight")))
    return sources.select("source", "source_size", target.alias("target"))


def _unit(seed: str) -> Column:
    """A number strictly between 0 and 1 that belongs to a document's id and text."""
    digits = F.substring(F.md5(F.concat_ws(":", common.id_text("doc_id"), F.lit(seed), F.md5(F.coalesce(F.col("text"), F.lit(""))))), 1, 13)
    return (F.conv(digits, 16, 10).cast("double") + 0.5) / F.lit(float(1 << 52))


def inclusion_scale(sizes: DataFrame) -> DataFrame:
    """`source, scale`: the factor c for which min(1, c * size) * size sums to `rest`, per source.

    The largest sizes may be certain (c * size >= 1). Sizes descending, the factor without the first k
    of them is (rest - their words) / (squares of the others); the right k is the first that leaves no
    size over one. Works on one row per source and distinct size.
    """
    steps = sizes.where("rest > 0 and size > 0").groupBy("source", "size").agg(F.count("*").alias("n"), F.first("rest").alias("rest"))
    down = Window.partitionBy("source").orderBy(F.col("size").desc())
    words = F.col("n") * F.col("size").cast("double")
    larger = F.coalesce(F.sum(words).over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    squares = F.sum(words * F.col("size")).over(down.rowsBetween(0, Window.unboundedFollowing))
    steps = steps.select("source", "size", ((F.col("rest") - larger) / squares).alias("scale"))
    return steps.where(F.col("scale") * F.col("size") <= 1).groupBy("source").agg(F.max_by("scale", "size").alias("scale"))


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, most: float = 2.0, seed: str = "mix") -> DataFrame:
    """`doc_id, source, size, source_size, target, copies, taken, fingerprint` of every row of `docs(doc_id, text, source, ...)`.

    `fingerprint` (of id, text and source) names a row among those of `docs`.

    Null and empty texts have size 0 and are never taken. A null source is a source of its own, last in
    order. Ties in rank go by id, then size. Repeated rows (same id, text and source) rank alike: as many of
    them as fit are taken, and as they are alike every run gives the same rows. An empty table gives an
    empty result. Other columns are ignored.
    """
    docs = docs.select("doc_id", "source", common.n_words(F.col("text")).alias("size"), _unit(seed).alias("u"),
                       F.xxhash64("doc_id", "text", "source").alias("fingerprint"))
    # the row number only tells repeated rows apart; as they are alike, it leaves no mark on the result
    docs = common.saved(docs.withColumn("row", F.monotonically_increasing_id()), "mix-sizes")
    targets = source_targets(docs, weights, share, most)
    ratio = F.col("target") / F.when(F.col("source_size") > 0, F.col("source_size"))
    # a hair below a whole number is that number
    whole = F.coalesce(F.floor(ratio + F.lit(1e-9)), F.lit(0)).cast("long")
    targets = targets.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    targets = targets.withColumn("key", _key("source")).withColumnRenamed("source", "its")
    targets = common.saved(targets, "mix-targets")
    docs = docs.withColumn("key", _key("source"))

    sized = docs.join(F.broadcast(targets.select("key", "rest")) if _few(targets) else targets.select("key", "rest"), "key")
    scale = inclusion_scale(sized.select(F.col("key").alias("source"), "size", "rest")).withColumnRenamed("source", "key")
    targets = common.saved(targets.join(scale, "key", "left"), "mix-scales")
    if _few(targets):
        targets = F.broadcast(targets)

    u = F.col("u")
    p = F.least(F.lit(1.0), F.col("scale") * F.col("size"))
    odds = F.when(F.col("size") <= 0, None).when(p >= 1, F.lit(0.0)).otherwise((u / (1 - u)) / (p / (1 - p)))
    ranked = docs.join(targets, "key").withColumn("q", odds)
    ranked = ranked.withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * BUCKETS).cast("int"))

    # where each source's sample ends: first by bucket, then by row inside that bucket
    run = Window.partitionBy("key").orderBy("bucket")
    buckets = (ranked.where("q is not null").groupBy("key", "bucket").agg(F.sum("size").alias("words"), F.first("rest").alias("rest"))
               .withColumn("upto", F.sum("words").over(run)))
    ends = (buckets.where("upto > rest").groupBy("key")
            .agg(F.min("bucket").alias("end"), F.min_by(F.col("upto") - F.col("words"), "bucket").alias("before")))
    ends = common.saved(ends, "mix-ends")
    ends = F.broadcast(ends) if _few(ends) else ends
    ranked = ranked.join(ends, "key", "left")
    order = Window.partitionBy("key").orderBy("q", F.col("doc_id").asc_nulls_last(), "size", "row")
    inside = (ranked.where("bucket = end").withColumn("upto", F.col("before") + F.sum("size").over(order.rowsBetween(Window.unboundedPreceding, 0)))
              .withColumn("front", F.col("upto") <= F.col("rest")))
    inside = common.saved(inside, "mix-inside")
    after = ranked.where("bucket > end").withColumn("front", F.lit(False)).withColumn("upto", F.lit(None).cast("long"))
    front = ranked.where("q is not null and (end is null or bucket < end)").withColumn("front", F.lit(True)).withColumn("upto", F.lit(None).cast("long"))
    never = ranked.where("q is null").withColumn("front", F.lit(False)).withColumn("upto", F.lit(None).cast("long"))

    # one closing document per source: nearest to the words still missing, if it brings the source nearer
    reached = inside.groupBy("key").agg(F.max(F.when(F.col("front"), F.col("upto"))).alias("in_end"), F.first("before").alias("b"))
    reached = reached.select("key", F.coalesce("in_end", "b").alias("reached"))
    reached = F.broadcast(reached) if _few(ends) else reached
    behind = inside.where("not front").unionByName(after).join(reached, "key")
    gap = F.abs(F.col("rest") - F.col("reached") - F.col("size"))
    closing = (behind.where(gap < F.col("rest") - F.col("reached"))
               .groupBy("key").agg(F.min(F.struct(gap.alias("gap"), "q", common.id_text("doc_id").alias("id"), "row")).alias("closing")))
    closing = common.saved(closing.select("key", F.col("closing.row").alias("closing_row")), "mix-closing")
    closing = F.broadcast(closing) if _few(ends) else closing

    rows = front.unionByName(never).unionByName(after).unionByName(inside).join(closing, "key", "left")
    same = F.coalesce(F.col("row") == F.col("closing_row"), F.lit(False))
    copies = F.col("whole") + (F.col("front") | same).cast("long")
    copies = F.when(F.col("size") > 0, copies).otherwise(F.lit(0)).cast("long")
    return rows.select("doc_id", "source", "size", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"), "fingerprint")


def _key(source: str) -> Column:
    """A source as a join key: a null source is not a source named by any text."""
    return F.coalesce(F.concat(F.lit("s"), F.col(source)), F.lit("n"))


def _few(sources: DataFrame, rows: int = 100_000) -> bool:
    """Whether a table of one row per source is small enough to broadcast; more sources join by key."""
    return sources.limit(rows + 1).count() <= rows


def op8_mixing(spark, sf):
    return mix(common.table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken", "source", "copies")


def mixing_stage(spark, docs, sf_dir):
    """The documents the mix takes, with `copies`: how often it holds each (equal rows are one with all their copies).

    An input column named `copies` is replaced, others are kept as they are. Null and empty texts have size 0 and
    are never taken; rows with null ids or sources take part; an empty table stays empty.
    """
    taken = mix(docs).where("copies > 0").groupBy("fingerprint").agg(F.sum("copies").alias("__copies"))
    named = docs.withColumn("__fingerprint", F.xxhash64("doc_id", "text", "source")).dropDuplicates(["__fingerprint"])
    chosen = named.join(taken, named["__fingerprint"] == taken["fingerprint"])
    return chosen.select(*[named[c] for c in docs.columns if c != "copies"], F.col("__copies").alias("copies"))


OP8_SQL = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    (CAST(CAST('0x' || substr(md5(concat_ws(':', coalesce(CAST(doc_id AS VARCHAR), ''), 'mix', md5(coalesce(text, '')))), 1, 13) AS BIGINT) AS DOUBLE)
      + CAST(0.5 AS DOUBLE)) / CAST(4503599627370496 AS DOUBLE) AS u
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
    CAST([3, 1, 2][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS w
  FROM d GROUP BY source),
f AS (
  SELECT *, 2.0::DOUBLE * source_size AS cap,
    (sum(CAST(source_size AS DOUBLE)) OVER () * CAST(1.5 AS DOUBLE)
      - coalesce(sum(2.0::DOUBLE * source_size) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
      / sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM s WINDOW o AS (ORDER BY 2.0::DOUBLE * source_size / w, source NULLS LAST)),
g AS (SELECT *, max(CASE WHEN level * w < cap THEN level END) OVER () AS final FROM f),
t AS (
  SELECT source, source_size, CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END AS target,
    CAST(coalesce(floor(CASE WHEN final IS NULL THEN cap ELSE least(cap, final * w) END / nullif(source_size, 0) + 1e-9::DOUBLE), 0) AS BIGINT) AS whole
  FROM g),
t2 AS (SELECT *, target - whole * source_size AS rest FROM t),
st AS (
  SELECT d.source, d.size, count(*) AS n, min(t2.rest) AS rest FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source
  WHERE rest > 0 AND size > 0 GROUP BY d.source, d.size),
sc AS (
  SELECT source, size, (rest - coalesce(sum(n * CAST(size AS DOUBLE)) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0::DOUBLE))
    / sum(n * CAST(size AS DOUBLE) * size) OVER (PARTITION BY source ORDER BY size DESC ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS scale
  FROM st),
c AS (SELECT source, arg_max(scale, size) AS scale FROM sc WHERE scale * size <= 1 GROUP BY source),
r AS (
  SELECT d.*, source_size, target, whole, rest, least(1.0::DOUBLE, scale * size) AS p
  FROM d JOIN t2 ON d.source IS NOT DISTINCT FROM t2.source LEFT JOIN c ON d.source IS NOT DISTINCT FROM c.source),
q AS (SELECT *, CASE WHEN size <= 0 OR p IS NULL THEN NULL WHEN p >= 1 THEN 0.0::DOUBLE ELSE (u / (1 - u)) / (p / (1 - p)) END AS q FROM r),
k AS (
  SELECT *, q IS NOT NULL AND sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) <= rest AS front,
    sum(size) OVER (PARTITION BY source ORDER BY q NULLS LAST, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM q),
h AS (SELECT source, coalesce(max(CASE WHEN front THEN upto END), 0) AS reached FROM k GROUP BY source),
b AS (
  SELECT k.source, min(struct_pack(gap := abs(rest - reached - size), q := q, id := coalesce(CAST(doc_id AS VARCHAR), ''))) AS closing
  FROM k JOIN h ON k.source IS NOT DISTINCT FROM h.source
  WHERE q IS NOT NULL AND NOT front AND abs(rest - reached - size) < rest - reached GROUP BY k.source)
SELECT doc_id, size, source_size, target, k.source,
  CASE WHEN size > 0 THEN whole + CAST(front OR coalesce(closing.id = coalesce(CAST(doc_id AS VARCHAR), '') AND closing.q = q, false) AS BIGINT) ELSE 0 END AS copies,
  CASE WHEN size > 0 THEN whole + CAST(front OR coalesce(closing.id = coalesce(CAST(doc_id AS VARCHAR), '') AND closing.q = q, false) AS BIGINT) ELSE 0 END * size AS taken
FROM k LEFT JOIN b ON k.source IS NOT DISTINCT FROM b.source
"""

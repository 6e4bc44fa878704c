"""Mixing sources to target weights by Sainte-Lague apportionment of equal blocks.

1. Targets: sources share ``share`` times all words by weight; a source stops at
   ``most`` times its size and the excess goes to the others by weight.
2. Documents fall into shards by a seeded hash. Within a shard each source is a
   stream of its documents in seeded order, cut into blocks of ``block`` words.
3. The blocks of a shard's target go to its sources by highest quotients
   ``votes / (2 k + 1)``; the quotas are integers.
4. A quota takes its blocks in whole passes over the stream, and what is left
   from the blocks in seeded order.

All of it is joins, windows and aggregates over one narrow row for each document
or block. The number of shards grows with the corpus, so no window holds more
than about ``shard_words`` words, however hot a source is. Only the window that
weighs the sources sees one row for each source.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from civitext.session import materialise

WORD = r"[^\x20\x09-\x0D]+"
SHARE, MOST, WEIGHTS = 1.5, 2, (3, 1, 2)
BLOCK, SHARD_WORDS, SEED = 32, 1 << 22, "mix-1"


def _hash(*parts: Column) -> Column:
    return F.md5(F.concat_ws("|", F.lit(SEED), *parts).cast("binary"))


def targets(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """``source, source_size, target``, one row for each source."""
    by_name = Window.orderBy(F.asc_nulls_last("source"))
    sources = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumns({"place": F.row_number().over(by_name)})
    sources = sources.withColumns(
        {
            "weight": F.element_at(F.array(*map(F.lit, weights)), (F.col("place") - 1) % len(weights) + 1),
            "stop": most * F.col("source_size"),
        }
    )
    # sources reach their stop in the order of stop / weight; the level is set by those that do not
    before = Window.orderBy(F.col("stop") / F.col("weight"), "place").rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.orderBy(F.lit(1)).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    stopped, lighter = F.coalesce(F.sum("stop").over(before), F.lit(0)), F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = (share * F.sum("source_size").over(whole) - stopped) / (F.sum("weight").over(whole) - lighter)
    levels = sources.withColumn("level", level)
    fits = F.when(F.col("stop") >= F.col("level") * F.col("weight"), F.struct(F.col("stop") / F.col("weight"), "place", "level"))
    target = F.coalesce(F.least(F.col("stop").cast("double"), F.min(fits).over(whole)["level"] * F.col("weight")), F.col("stop").cast("double"))
    return levels.select("source", "source_size", target.alias("target"))


def _quotas(groups: DataFrame, block: int) -> DataFrame:
    """Blocks for each ``shard, source`` by highest quotients.

    With the divisor ``votes / (seats -+ n / 2)`` rounding gives at most (at
    least) all seats, so only quotients between the two need ranking: a few for
    each source.
    """
    shard = Window.partitionBy("shard")
    votes = groups.withColumn("votes", F.when(F.col("source_size") > 0, F.col("target") * F.col("words") / F.col("source_size")).otherwise(0.0))
    votes = votes.withColumns({"all_votes": F.round(F.sum("votes").over(shard), 6), "n": F.count("*").over(shard)})
    votes = votes.withColumn("seats", F.floor(F.col("all_votes") / block + 0.5))
    rate = F.col("votes") / F.col("all_votes")
    sure = F.floor(rate * (F.col("seats") - F.col("n") / 2) + 0.5) - 1
    most = F.floor(rate * (F.col("seats") + F.col("n") / 2) + 0.5) + 1
    votes = votes.filter("votes > 0").withColumns({"sure": F.greatest(F.lit(0).cast("long"), sure), "most": most})
    votes = votes.withColumn("free", F.col("seats") - F.sum("sure").over(shard))
    tried = votes.select("shard", "source", "sure", "free", "votes", F.explode(F.sequence("sure", "most")).alias("k"))
    best = Window.partitionBy("shard").orderBy(F.desc(F.col("votes") / (2 * F.col("k") + 1)), F.asc_nulls_last("source"), "k")
    given = tried.withColumn("won", F.row_number().over(best) <= F.col("free"))
    return given.groupBy("shard", "source").agg((F.first("sure") + F.count_if("won")).alias("quota"))


def sizes_of(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.col("source").cast("string").alias("source"), F.regexp_count(F.col("text").cast("string"), F.lit(WORD)).cast("long").alias("size")).fillna(0, "size")


def mix(sizes: DataFrame, block: int = BLOCK, shard_words: int = SHARD_WORDS, **options) -> DataFrame:
    """``doc_id, size, source_size, target, taken, ranges``: how many words of each document the mix takes.

    ``sizes`` has ``doc_id, source, size`` and is read several times, so it
    should be a table. ``ranges`` lists ``start, stop, times`` (word numbers,
    stop exclusive). Null sources are one source, last in order. Documents
    without words take part with nothing. Repeated rows are documents of their
    own. An empty table gives an empty result.
    """
    total = sizes.agg(F.sum("size")).first()[0] or 0
    shards = total // shard_words + 1
    by_source = targets(sizes, **options)
    key = _hash(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")))
    half = lambda at: F.conv(F.substring("hash", at, 8), 16, 10).cast("long")
    placed = sizes.withColumn("hash", key).withColumns({"shard": half(1) % shards, "order": half(9)}).drop("hash")
    words = placed.groupBy("shard", "source").agg(F.sum("size").alias("words"))
    same = lambda a, b: a.join(b.withColumnRenamed("source", "its_source"), F.col("source").eqNullSafe(F.col("its_source"))).drop("its_source")
    groups = same(words, by_source)
    quotas = _quotas(groups, block).join(
        groups.select(F.col("shard").alias("g_shard"), F.col("source").alias("g_source"), "words"),
        (F.col("shard") == F.col("g_shard")) & F.col("source").eqNullSafe(F.col("g_source")),
    )
    blocks = F.ceil(F.col("words") / block)
    quota = F.least(F.col("quota"), MOST * blocks)
    quotas = quotas.select(
        F.col("g_shard"), "g_source", F.floor(quota / blocks).alias("passes"), (quota % blocks).alias("extra")
    )
    stream = Window.partitionBy("shard", "source").orderBy("order", F.asc_nulls_last("doc_id"), "size").rowsBetween(Window.unboundedPreceding, 0)
    streamed = placed.withColumn("end", F.sum("size").over(stream)).withColumn("begin", F.col("end") - F.col("size"))
    cut = streamed.filter("size > 0").select(
        "*", F.explode(F.sequence(F.floor(F.col("begin") / block), F.floor((F.col("end") - 1) / block))).alias("number")
    )
    drawn = Window.partitionBy("shard", "source").orderBy("draw", "number")
    draw = _hash(F.coalesce("source", F.lit("")), F.col("shard").cast("string"), F.col("number").cast("string"))
    ranked = cut.withColumn("draw", F.substring(draw, 1, 16)).withColumn("rank", F.dense_rank().over(drawn))
    chosen = ranked.join(quotas, (F.col("shard") == F.col("g_shard")) & F.col("source").eqNullSafe(F.col("g_source")))
    times = F.col("passes") + F.when(F.col("rank") <= F.col("extra"), 1).otherwise(0)
    start = F.greatest(F.col("begin"), F.col("number") * block) - F.col("begin")
    stop = F.least(F.col("end"), (F.col("number") + 1) * block) - F.col("begin")
    pieces = chosen.select("doc_id", "source", "size", "shard", "begin", start.alias("start"), stop.alias("stop"), times.alias("times")).filter("times > 0")
    taken = pieces.groupBy("doc_id", "source", "size", "shard", "begin").agg(
        F.sum((F.col("stop") - F.col("start")) * F.col("times")).alias("taken"), F.array_sort(F.collect_list(F.struct("start", "stop", "times"))).alias("ranges")
    )
    # a document with words is known by its source, shard and place in the stream
    left = streamed.select(*(F.col(c).alias(f"l_{c}") for c in ("doc_id", "source", "size", "shard", "begin")))
    both = (
        (F.col("l_shard") == F.col("shard")) & F.col("l_source").eqNullSafe(F.col("source")) & (F.col("l_begin") == F.col("begin")) & (F.col("l_size") == F.col("size"))
    )
    result = left.join(taken, both, "left").select(
        F.col("l_doc_id").alias("doc_id"), F.col("l_source").alias("source"), F.col("l_size").alias("size"), F.coalesce("taken", F.lit(0)).alias("taken"), "ranges"
    )
    return same(result, by_source).select("doc_id", "source", "size", "source_size", "target", "taken", "ranges")


def mixed_texts(docs: DataFrame, sizes: DataFrame, **options) -> DataFrame:
    """``docs`` with the words that the mix takes; those taken twice follow once more. Needs unique ids.

    Documents of which the mix takes nothing are left out.
    """
    taken = mix(sizes, **options).filter("taken > 0").select(F.col("doc_id").alias("its_id"), "ranges")
    words = F.regexp_extract_all(F.col("text").cast("string"), F.lit(WORD), F.lit(0))

    def pass_of(k: int) -> Column:
        own = F.filter("ranges", lambda r: r["times"] >= k)
        return F.flatten(F.transform(own, lambda r: F.slice(F.col("words"), r["start"].cast("int") + 1, (r["stop"] - r["start"]).cast("int"))))

    joined = docs.join(taken, F.col("doc_id").eqNullSafe(F.col("its_id"))).withColumn("words", words)
    text = F.array_join(F.concat(pass_of(1), pass_of(2)), " ")
    return joined.withColumn("text", text).select(docs.columns)


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    sizes = materialise(sizes_of(docs), "mix-sizes")
    return mix(sizes).select("doc_id", "size", "source_size", "target", "taken")


#: The same mix by ranking every quotient.
OP8_SQL = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::BIGINT AS size FROM documents
), sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source ASC NULLS LAST) AS place FROM sizes GROUP BY source
), weighed AS (
  SELECT *, CASE (place - 1) % 3 WHEN 0 THEN 3 WHEN 1 THEN 1 ELSE 2 END AS weight, {MOST} * source_size AS stop FROM sources
), levels AS (
  SELECT *, ({SHARE}::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(stop) OVER earlier, 0)::DOUBLE)
    / ((sum(weight) OVER ())::DOUBLE - coalesce(sum(weight) OVER earlier, 0)::DOUBLE) AS level
  FROM weighed WINDOW earlier AS (ORDER BY stop / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), targets AS (
  SELECT source, source_size, coalesce(least(stop::DOUBLE, weight * (
    SELECT arg_min(level, (stop / weight, place)) FROM levels WHERE stop >= level * weight)), stop::DOUBLE) AS target FROM levels
), hashed AS (
  SELECT *, md5('{SEED}|' || coalesce(doc_id::VARCHAR, 'null')) AS hash FROM sizes
), placed AS (
  SELECT doc_id, source, size, ('0x' || hash[1:8])::BIGINT % ((SELECT coalesce(sum(size), 0) FROM sizes)::BIGINT // {SHARD_WORDS} + 1) AS shard,
    ('0x' || hash[9:16])::BIGINT AS ordinal FROM hashed
), groups AS (
  SELECT shard, p.source, sum(size)::BIGINT AS words, any_value(target) AS target, any_value(source_size) AS source_size,
    any_value(target) * sum(size)::BIGINT / any_value(source_size) AS votes
  FROM placed p JOIN targets t ON p.source IS NOT DISTINCT FROM t.source GROUP BY shard, p.source HAVING sum(size) > 0
), seats AS (
  SELECT shard, floor(round(sum(votes), 6) / {BLOCK} + 0.5)::BIGINT AS seats FROM groups GROUP BY shard
), quotients AS (
  SELECT shard, source, seats, row_number() OVER (PARTITION BY shard ORDER BY votes / (2 * k + 1) DESC, source ASC NULLS LAST, k) AS won
  FROM (SELECT g.*, seats, unnest(range(seats + 1)) AS k FROM groups g JOIN seats USING (shard))
), quotas AS (
  SELECT g.shard, g.source, any_value(ceil(words / {BLOCK})::BIGINT) AS blocks,
    least(count(*) FILTER (won <= seats), {MOST} * any_value(ceil(words / {BLOCK})::BIGINT)) AS quota
  FROM groups g JOIN quotients q ON g.shard = q.shard AND g.source IS NOT DISTINCT FROM q.source GROUP BY g.shard, g.source
), streamed AS (
  SELECT *, (sum(size) OVER (PARTITION BY shard, source ORDER BY ordinal, doc_id NULLS LAST, size ROWS UNBOUNDED PRECEDING))::BIGINT AS ends FROM placed
), cut AS (
  SELECT *, unnest(range((ends - size) // {BLOCK}, (ends - 1) // {BLOCK} + 1)) AS number FROM streamed WHERE size > 0
), ranked AS (
  SELECT *, dense_rank() OVER (PARTITION BY shard, source ORDER BY md5('{SEED}|' || coalesce(source, '') || '|' || shard || '|' || number)[1:16], number) AS draw FROM cut
), taken AS (
  SELECT r.shard, r.source, r.ends, r.size, sum((least(ends, (number + 1) * {BLOCK}) - greatest(ends - size, number * {BLOCK}))
    * (quota // blocks + (draw <= quota % blocks)::BIGINT))::BIGINT AS taken
  FROM ranked r JOIN quotas q ON r.shard = q.shard AND r.source IS NOT DISTINCT FROM q.source GROUP BY r.shard, r.source, r.ends, r.size
)
SELECT s.doc_id, s.size, t.source_size, t.target, coalesce(k.taken, 0)::BIGINT AS taken
FROM streamed s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
LEFT JOIN taken k ON s.shard = k.shard AND s.source IS NOT DISTINCT FROM k.source AND s.ends = k.ends AND s.size = k.size
"""

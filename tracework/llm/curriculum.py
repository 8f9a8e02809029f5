"""Mixing sources to target weights along a time-varying curriculum.

Each source owes the mix a number of words (its target). A schedule says how its share moves over training time, from 0 to 1: the
integral of the schedule is the source's cumulative demand, and inverting that demand gives every copy of a document the time at
which the words before it have been used up. Copies whose words lie beyond the target get no time and are not taken.

The running sum of words inside a source never needs a whole source in one task: documents are ordered by a hash, the hash's leading
``DIGITS`` hexadecimal digits cut a source into slots (65536), slot sums are added up by shelves of ``SHELF`` slots, and the running
sum of documents is taken inside slots.

Defined results: a null or empty text has size 0 and is taken 0 words; a null source is a source of its own, last in order; if all
sizes are 0, all targets are 0; rows that repeat an id count separately; extra columns are carried only where asked for.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tracework.llm.repeats import stored
from tracework.llm.text import WORD

DIGITS = 4
SHELF = 256
MOST_PASSES = 3
#: Rate of a source over time as (time, rate) knots, by weight: light sources fade, heavy ones grow. Rates are scaled to integrate to 1.
SCHEDULES = {1: ((0.0, 1.5), (1.0, 0.5)), 2: ((0.0, 1.0), (1.0, 1.0)), 3: ((0.0, 0.5), (0.5, 1.0), (1.0, 1.5))}


def words_in(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text.cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def targets(totals: DataFrame, most: int = MOST_PASSES) -> DataFrame:
    """Target words per source: weights 1, 2, 3 repeating in code-point order share all words; what exceeds ``most`` times a
    source is reshared by weight. Sources reach that ceiling in order of size over weight, so one ordered pass finds the level."""
    w = (totals.withColumn("weight", ((F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1) % 3 + 1).cast("double"))
         .withColumn("ceiling", (F.col("source_size") * most).cast("double")).withColumn("ratio", F.col("ceiling") / F.col("weight")))
    before = Window.orderBy("ratio", "weight", F.col("source").isNull(), "source").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything).cast("double") - F.coalesce(F.sum("ceiling").over(before), F.lit(0.0))) / (
        F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0.0)))
    free = F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", "level"))).over(everything)["level"]
    return w.withColumn("level", level).select(
        "source", "source_size", F.col("weight").cast("int").alias("weight"),
        F.coalesce(F.least("ceiling", free * F.col("weight")), F.col("ceiling")).alias("target"))


def time_of(share: Column, knots: tuple[tuple[float, float], ...]) -> Column:
    """The time at which the integral of a piecewise linear rate has reached ``share`` of its total."""
    parts = [(t0, t1, r0, r1, (r0 + r1) / 2 * (t1 - t0)) for (t0, r0), (t1, r1) in zip(knots, knots[1:], strict=False)]
    total, done = sum(p[4] for p in parts), 0.0
    out = F.lit(knots[-1][0])
    pieces = []
    for t0, t1, r0, r1, area in parts:
        need, slope = share * total - done, (r1 - r0) / (t1 - t0)
        at = need / r0 if slope == 0 else (F.sqrt(F.lit(r0 * r0) + need * (2 * slope)) - r0) / slope
        done += area
        pieces.append((share * total <= done, F.lit(t0) + at))
    for within, at in reversed(pieces):
        out = F.when(within, at).otherwise(out)
    return out


def assign(df: DataFrame, text_col: str = "text", id_col: str = "doc_id", source_col: str = "source", carry: tuple[str, ...] = ("doc_id",),
           schedules: dict[int, tuple[tuple[float, float], ...]] = SCHEDULES) -> DataFrame:
    """Per document: ``size``, its source's ``source_size`` and ``target``, and ``times``, the training times of its copies."""
    digits = F.md5(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary"))
    rows = df.select(F.struct(*[F.col(c) for c in carry]).alias("_carry"), F.col(source_col).cast("string").alias("source"), words_in(F.col(text_col)).alias("size"), digits.alias("order"))
    # a key without nulls, so that one shuffle of the documents serves both the running sum and the join with the slots
    rows = rows.withColumn("slot", F.conv(F.substring("order", 1, DIGITS), 16, 10).cast("int")).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))
    slots = stored(rows.groupBy("key", "source", "slot").agg(F.sum("size").alias("words")).withColumn("shelf", F.expr(f"slot div {SHELF}")), "slots")
    shelves = stored(slots.groupBy("key", "source", "shelf").agg(F.sum("words").alias("words")), "shelves")
    goal = targets(shelves.groupBy("source").agg(F.sum("words").alias("source_size"))).withColumn("key", F.coalesce(F.concat(F.lit("="), "source"), F.lit("")))

    def before(*keys: str, order: list[str], of: str) -> Column:
        earlier = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(of).over(earlier), F.lit(0))

    base = shelves.withColumn("base", before("key", order=["shelf"], of="words")).join(goal.drop("source"), "key").drop("source", "words")
    plan = slots.withColumn("ahead", before("key", "shelf", order=["slot"], of="words")).join(base, ["key", "shelf"]).select(
        "key", "slot", (F.col("base") + F.col("ahead")).alias("ahead"), "source_size", "weight", "target")
    placed = rows.withColumn("within", before("key", "slot", order=["order", "size"], of="size")).join(plan, ["key", "slot"])
    middle = (F.col("ahead") + F.col("within")).cast("double") + F.col("size") / 2
    copies = F.array(*[middle + F.col("source_size") * n for n in range(MOST_PASSES)])

    def clock(c: Column) -> Column:
        share = c / F.col("target")
        out = F.lit(None).cast("double")
        for weight, knots in schedules.items():
            out = F.when(F.col("weight") == weight, time_of(share, knots)).otherwise(out)
        return out

    return placed.select("_carry.*", "source_size", "size", "target", F.transform(F.filter(copies, lambda c: c < F.col("target")), clock).alias("times"))


def _in_order(rows: DataFrame, *ties: str) -> DataFrame:
    """One row per copy with its ``position`` in time, range-sorted by it."""
    return rows.withColumn("position", F.explode("times")).drop("times").orderBy("position", *ties)


def mixed(df: DataFrame, carry: tuple[str, ...], **kwargs) -> DataFrame:
    """The mix itself: one row per copy with its ``position`` in time, range-sorted by it. Whole copies only."""
    return _in_order(assign(df, carry=carry, **kwargs).select(*carry, "times"), *[c for c in carry if c == "doc_id"])


def digest(df: DataFrame) -> DataFrame:
    """Per document the words that the mix takes, counted in the mix itself: its copies at their places in time."""
    planned = stored(assign(df).withColumn("row", F.monotonically_increasing_id()), "planned")
    mix = stored(_in_order(planned.select("row", "size", "times"), "row"), "mix")
    taken = mix.groupBy("row").agg(F.sum("size").alias("taken"))
    return planned.join(taken, "row", "left").select("doc_id", "size", "source_size", "target", F.coalesce("taken", F.lit(0)).cast("long").alias("taken"))


SQL = r"""
WITH d AS (SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
                  md5(coalesce(doc_id::VARCHAR, '')) AS o FROM documents),
s AS (SELECT source, sum(size)::BIGINT AS source_size FROM d GROUP BY source),
w AS (SELECT *, ((row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1)::DOUBLE AS weight, (source_size * 3)::DOUBLE AS ceiling FROM s),
l AS (SELECT *, ceiling / weight AS ratio,
             (sum(source_size) OVER ()::DOUBLE - coalesce(sum(ceiling) OVER b, 0)) / (sum(weight) OVER () - coalesce(sum(weight) OVER b, 0)) AS level
      FROM w WINDOW b AS (ORDER BY ceiling / weight, weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
g AS (SELECT source, source_size, coalesce(least(ceiling, (SELECT arg_min(level, ratio) FROM l WHERE level <= ratio) * weight), ceiling) AS target FROM l),
c AS (SELECT d.*, coalesce(sum(size) OVER (PARTITION BY source ORDER BY o, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE + size / 2.0::DOUBLE AS mid FROM d)
SELECT doc_id, size, source_size, target,
       (size * ((mid < target)::INT + (mid + source_size < target)::INT + (mid + source_size * 2 < target)::INT))::BIGINT AS taken
FROM c JOIN g ON c.source IS NOT DISTINCT FROM g.source
"""

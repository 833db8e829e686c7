"""Mix sources to target weights under a curriculum that varies with time.

Training runs from time 0 to 1. Each source has a schedule, its weight at each
time. The integral of the schedule says how much of the source's target has
been asked for at any time; inverting it gives every document the time at which
its words are due, and sorting by that time gives the training order.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.common import order_hash, stored, table, word_count

# A schedule is linear between knots (time, weight); times rise from 0 to 1,
# weights are not negative and not all 0.
Schedule = Sequence[tuple[float, float]]

# Early, steady and late sources, dealt to the sources in their order.
SCHEDULES: tuple[Schedule, ...] = (
    ((0.0, 1.5), (1.0, 0.5)),
    ((0.0, 1.0), (1.0, 1.0)),
    ((0.0, 0.5), (0.5, 0.5), (1.0, 2.0)),
)
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MAX_REPEATS = 2
# A source is cut into parts by the first hexadecimal digits of the drawn hash,
# here into 4096. The words before a document are those of the parts before its
# own and of its part up to it, so that no task holds a source.
PART_DIGITS = 3


def targets(
    sizes: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
) -> DataFrame:
    """Per row ``(source, source_size)`` the words to take: ``place``, ``target``.

    Sources by code point, NULL last, get ``weights`` in turn. All targets sum
    to ``share`` of all sizes; none is above ``max_repeats`` times its size.
    What a full source cannot take goes to the others by weight: they share the
    rest at one rate. In the order of size per weight, the rate with the first
    sources full rises up to the one sought and falls after it, so it is the
    greatest. There is a row per source here, not per document, so one task may
    sort them.
    """
    alphabet = Window.orderBy(F.col("source").asc_nulls_last())
    kinds = F.array(*map(F.lit, weights))
    cap = F.col("source_size") * max_repeats
    by_fill = Window.orderBy(F.col("cap") / F.col("weight"), F.col("place"))
    before = by_fill.rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy(F.lit(1))
    ranked = (
        sizes.withColumn("place", F.row_number().over(alphabet) - 1)
        .withColumn("weight", F.element_at(kinds, (F.col("place") % len(weights) + 1).cast("int")))
        .withColumn("cap", cap.cast("double"))
        .withColumn("wanted", F.sum("source_size").over(everything) * F.lit(float(share)))
        .withColumn("all_weights", F.sum("weight").over(everything))
        .withColumn("caps_before", F.coalesce(F.sum("cap").over(before), F.lit(0.0)))
        .withColumn("weights_before", F.coalesce(F.sum("weight").over(before), F.lit(0)))
        # What each unit of weight gets if exactly the sources before are full.
        .withColumn(
            "rate",
            (F.col("wanted") - F.col("caps_before"))
            / (F.col("all_weights") - F.col("weights_before")),
        )
        .withColumn("final_rate", F.max("rate").over(everything))
    )
    return ranked.select(
        "source",
        "source_size",
        "place",
        F.least("cap", F.col("final_rate") * F.col("weight")).alias("target"),
    )


def due_time(asked: Column, schedule: Schedule) -> Column:
    """The time at which a share ``asked`` (0 to 1) of the whole is asked for."""
    pieces, area = [], 0.0
    for (t0, w0), (t1, w1) in zip(schedule, schedule[1:], strict=False):
        pieces.append((t0, t1, w0, w1, area))
        area += (t1 - t0) * (w0 + w1) / 2
    times = []
    for t0, t1, w0, w1, below in pieces:
        rest = F.greatest(asked * area - below, F.lit(0.0))
        slope = (w1 - w0) / (t1 - t0)
        # w0 x + slope x^2 / 2 = rest, in the form that bears a slope of 0.
        root = F.sqrt(F.greatest(w0 * w0 + 2 * slope * rest, F.lit(0.0)))
        x = F.when(w0 + root > 0, 2 * rest / (w0 + root)).otherwise(F.lit(0.0))
        times.append((below + (t1 - t0) * (w0 + w1) / 2, F.least(t0 + x, F.lit(float(t1)))))
    found = F.lit(float(schedule[-1][0]))
    for upto, time in reversed(times):
        found = F.when(asked * area <= upto, time).otherwise(found)
    return found


def mix(
    docs: DataFrame,
    weights: Sequence[int] = WEIGHTS,
    share: float = SHARE,
    max_repeats: int = MAX_REPEATS,
    schedules: Sequence[Schedule] = SCHEDULES,
    part_digits: int = PART_DIGITS,
) -> DataFrame:
    """One row per document: ``doc_id, source, size, source_size, target,
    positions``; ``positions`` has a time for each copy that the mix takes.

    A source's documents are lined up in an order drawn by hash, again and
    again; a copy is taken if the middle of its words lies within the target,
    so a source misses its target by half a document at most. Whole documents
    are taken, at most ``max_repeats`` times each.

    NULL text has size 0; a document without words is taken once if its place
    in the line is within the target, and adds no words. NULL ``source`` is a
    source. Rows that repeat an id stay rows; fully equal ones are
    interchangeable. Empty tables give empty results. Other columns are not
    read.
    """
    slim = stored(
        docs.select(
            F.col("doc_id"),
            F.col("source"),
            word_count(F.col("text")).alias("size"),
        ).withColumn("draw", order_hash(F.col("doc_id"))),
        "mix-sizes",
    ).withColumn("part", F.left("draw", F.lit(part_digits)))
    # NULL is a source like any other, which a join on equality would lose.
    key = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    slim = slim.withColumn("source_key", key)

    by_part = slim.groupBy("source_key", "source", "part").agg(F.sum("size").alias("part_size"))
    by_source = by_part.groupBy("source_key", "source").agg(F.sum("part_size").alias("source_size"))
    wanted = targets(by_source.drop("source_key"), weights, share, max_repeats).withColumn(
        "source_key", key
    )
    earlier = Window.partitionBy("source_key").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1
    )
    starts = (
        by_part.withColumn("part_start", F.coalesce(F.sum("part_size").over(earlier), F.lit(0)))
        .join(wanted.drop("source"), "source_key")
        .select("source_key", "part", "part_start", "source_size", "place", "target")
    )
    line = (
        Window.partitionBy("source_key", "part")
        .orderBy("draw", "doc_id", "size")
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    placed = slim.join(starts, ["source_key", "part"]).withColumn(
        "start", F.col("part_start") + F.coalesce(F.sum("size").over(line), F.lit(0))
    )
    middle = lambda k: F.col("start") + F.col("size") / 2 + k * F.col("source_size")
    kind = F.col("place") % len(schedules)
    time = lambda asked: F.coalesce(
        *[F.when(kind == i, due_time(asked, s)) for i, s in enumerate(schedules)]
    )
    copies = F.array_compact(
        F.array(
            *[
                F.when(
                    middle(k) <= F.col("target"),
                    F.when(F.col("target") > 0, time(middle(k) / F.col("target"))).otherwise(0.0),
                )
                for k in range(max_repeats)
            ]
        )
    )
    return placed.select(
        "doc_id", "source", "size", "source_size", "target", "draw", copies.alias("positions")
    )


def training_order(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The rows of ``docs``, once for each position in ``plan``, range-sorted.

    Rows that repeat an id are one document here: each of them stands at the
    positions of one of them.
    """
    taken = plan.filter(F.size("positions") > 0)
    one = taken.groupBy("doc_id").agg(F.min(F.struct("draw", "positions")).alias("at"))
    rows = docs.select(F.col("doc_id").alias("id"), F.struct("*").alias("row"))
    return (
        rows.join(one, F.col("id").eqNullSafe(F.col("doc_id")))
        .select("row", F.explode("at.positions").alias("position"), F.col("at.draw").alias("draw"))
        .orderBy("position", "draw")
        .select("row.*")
    )


def op3_mix_sources(spark, sf_dir: str) -> DataFrame:
    """``position_1`` and ``position_2`` are the times of a document's copies, to a
    millionth; NULL where the mix takes no such copy."""
    plan = mix(table(spark, sf_dir, "documents"))
    place = lambda k: F.floor(F.get("positions", F.lit(k)) * 1e6).cast("double") / 1e6
    return plan.select(
        "doc_id",
        "size",
        "source_size",
        "target",
        (F.col("size") * F.size("positions")).cast("long").alias("taken"),
        place(0).alias("position_1"),
        place(1).alias("position_2"),
    )


# The time at which a share of a source's target is asked for, by its schedule.
_DUE_SQL = """CASE WHEN {0} IS NULL THEN NULL
           WHEN kind = 0 THEN least(2 * {0} / (1.5 + sqrt(2.25 - 2 * {0})), 1)
           WHEN kind = 1 THEN least({0}, 1)
           ELSE CASE WHEN {0} * 0.875::DOUBLE <= 0.25 THEN least(2 * ({0} * 0.875::DOUBLE), 0.5)
                ELSE least(0.5 + 2 * ({0} * 0.875::DOUBLE - 0.25)
                           / (0.5 + sqrt(0.25 + 6 * ({0} * 0.875::DOUBLE - 0.25))), 1) END
           END"""

OP3_SQL = rf"""
WITH sized AS (
    SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS draw,
           coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size
    FROM documents
), sources AS (
    SELECT source, sum(size)::BIGINT AS source_size,
           row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1 AS place
    FROM sized GROUP BY source
), weighed AS (
    SELECT *, [3, 1, 2][(place % 3 + 1)::INT] AS weight, source_size * 2.0::DOUBLE AS cap
    FROM sources
), ranked AS (
    SELECT *, sum(source_size) OVER () * 1.5::DOUBLE AS wanted, sum(weight) OVER () AS all_weights,
           coalesce(sum(cap) OVER fill, 0)::DOUBLE AS caps_before,
           coalesce(sum(weight) OVER fill, 0) AS weights_before
    FROM weighed
    WINDOW fill AS (ORDER BY cap / weight, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), rated AS (
    SELECT *, (wanted - caps_before) / (all_weights - weights_before) AS rate FROM ranked
), targets AS (
    SELECT source, source_size, place, least(cap, max(rate) OVER () * weight) AS target FROM rated
), lined AS (
    SELECT s.doc_id, s.size, t.source_size, t.target, t.place % 3 AS kind,
           s.size / 2.0::DOUBLE + coalesce(sum(s.size) OVER (
               PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size
               ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS middle
    FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source
), asked AS (
    SELECT *, CASE WHEN middle <= target AND target > 0 THEN middle / target
                   WHEN middle <= target THEN 0 END::DOUBLE AS asked_1,
           CASE WHEN middle + source_size <= target AND target > 0 THEN (middle + source_size) / target
                WHEN middle + source_size <= target THEN 0 END::DOUBLE AS asked_2
    FROM lined
)
SELECT doc_id, size, source_size, target,
       size * ((asked_1 IS NOT NULL)::BIGINT + (asked_2 IS NOT NULL)::BIGINT) AS taken,
       floor({_DUE_SQL.format("asked_1")} * 1e6::DOUBLE) / 1e6::DOUBLE AS position_1,
       floor({_DUE_SQL.format("asked_2")} * 1e6::DOUBLE) / 1e6::DOUBLE AS position_2
FROM asked
"""

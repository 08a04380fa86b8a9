"""Top-n rows per group where n is a share of the group's unknown size and a group may span many
tasks: the place of the cut is found by counting, rows are never gathered by group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.session import cut_lineage

BINS = 4096  # of a group in a round
MOST_GROUPS = 100_000  # whose cut is sought by counting: the size of what is broadcast
ONE_TASK_ROWS = 100_000  # a group of up to so many rows is ranked in one task


def _bin(value: Column, low: Column, high: Column, whole: bool) -> Column:
    """Bin of ``value`` in [low, high], rising with it; the least is in the first bin, the
    greatest in the last."""
    if whole:  # exact differences, also of longs that no double holds
        less = lambda a, b: (a.cast("decimal(20,0)") - b.cast("decimal(20,0)")).cast("double")
        share = F.try_divide(less(value, low), less(high, low))
    else:  # halves keep a wide span finite; a narrow one has none
        span = high / 2 - low / 2
        share = F.when(span > 1e-300, F.try_divide(value / 2 - low / 2, span)).otherwise(F.try_divide(value - low, high - low))
    return F.least(F.lit(BINS - 1), F.floor(share * BINS)).cast("int")


def _cuts(rows: DataFrame, group: list[str], need: DataFrame, value: str, whole: bool = False) -> DataFrame:
    """group, cut, above, need: the ``need``-th greatest ``value`` of each group, and how many rows
    are greater; ``need`` (group, need) has few rows. A round counts the rows of each bin of the
    stretch that holds the cut (partial sums first), and goes on in the bin that does. Ends of a bin
    are its least and greatest value, so a round that splits nothing is a value that repeats."""
    open_ = rows.join(F.broadcast(need), group).groupBy(*group, "need").agg(
        F.min(value).alias("low"), F.max(value).alias("high")).withColumn("above", F.lit(0).cast("long"))
    done, open_ = None, cut_lineage(open_)
    while True:
        here = open_.filter("low = high").select(*group, F.col("low").alias("cut"), "above", "need")
        done = here if done is None else done.unionByName(here)
        open_ = open_.filter("low < high")
        if open_.isEmpty():
            return cut_lineage(done)
        within = rows.join(F.broadcast(open_), group).filter(F.col(value).between(F.col("low"), F.col("high")))
        counts = within.groupBy(*group, "above", "need", _bin(F.col(value), F.col("low"), F.col("high"), whole).alias("bin")).agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("low"), F.max(value).alias("high"))
        w = Window.partitionBy(*group).orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
        counts = counts.withColumn("above", F.col("above") + F.coalesce(F.sum("n").over(w), F.lit(0)))
        open_ = cut_lineage(counts.filter("above < need AND need <= above + n").select(*group, "low", "high", "above", "need"))


def top_share(df: DataFrame, group: list[str], score: str, order: str, ratio: float,
              one_task_rows: int = ONE_TASK_ROWS) -> DataFrame:
    """The ``floor(ratio * rows)`` rows of each group with the greatest ``score``, ties to the
    smaller ``order`` (a whole number, different for the rows of a group).

    Groups of more than ``one_task_rows`` rows (or of more than 1 / MOST_GROUPS of all rows, so that
    there are at most MOST_GROUPS such groups) are cut by counting: first the score of the last row
    that stays, then, among rows of that score, the order of the last one. Their rows are then
    filtered where they are. The others are ranked by a window. Null and NaN scores come last, below
    negative infinity; null groups are a group."""
    if not 0 <= ratio <= 1:
        raise ValueError("ratio must be in [0, 1]")
    s = F.col(score).cast("double")
    names = [f"__g{i}" for i in range(len(group))]
    most = float.fromhex("0x1.fffffffffffffp+1023")
    clipped = F.least(F.greatest(s, F.lit(-most)), F.lit(most)) + 0.0  # one zero
    # infinities stand beside the greatest numbers, told apart by __class; lost scores below all
    kind = F.when(s.isNull() | F.isnan(s), 0).when(s == float("-inf"), 1).when(s == float("inf"), 3).otherwise(2)
    keyed = df.select(F.struct(*[F.col(c) for c in df.columns]).alias("row"),
                      *[F.to_json(F.struct(F.col(g))).alias(n) for g, n in zip(group, names)],
                      F.when(kind == 2, clipped).otherwise(0.0).alias("score"), kind.cast("double").alias("kind"),
                      F.col(order).cast("long").alias("place"))
    sizes = cut_lineage(keyed.groupBy(*names).agg(F.count(F.lit(1)).alias("n")))
    total = sizes.agg(F.sum("n")).first()[0] or 0
    large = sizes.filter(F.col("n") > max(one_task_rows, total // MOST_GROUPS))
    need = large.select(*names, F.floor(F.col("n") * F.lit(ratio)).cast("long").alias("need"))
    kept = _small(keyed, names, large, ratio)
    if not large.isEmpty():
        kept = kept.unionByName(_large(keyed, names, need))
    return kept.select("row.*")


def _small(keyed: DataFrame, names: list[str], large: DataFrame, ratio: float) -> DataFrame:
    rest = keyed.join(F.broadcast(large.select(*names)), names, "left_anti")
    of = Window.partitionBy(*names)
    ranked = rest.withColumn("rank", F.row_number().over(of.orderBy(F.desc("kind"), F.desc("score"), "place"))).withColumn(
        "n", F.count(F.lit(1)).over(of))
    return ranked.filter(F.col("rank") <= F.floor(F.col("n") * F.lit(ratio))).select("row")


def _large(keyed: DataFrame, names: list[str], need: DataFrame) -> DataFrame:
    """Three cuts, each among the rows that the ones before leave open."""
    some = cut_lineage(need.filter("need > 0"))
    rows, cuts, open_ = keyed.select(*names, "kind", "score", (-F.col("place")).alias("place")), some, some
    for value in ("kind", "score", "place"):
        found = _cuts(rows, names, open_, value, whole=value == "place")
        cuts = cuts.join(found.select(*names, F.col("cut").alias(f"{value}_cut")), names)
        rows = rows.join(F.broadcast(found.select(*names, F.col("cut").alias("at"))), names).filter(
            F.col(value) == F.col("at")).drop("at")
        open_ = found.select(*names, (F.col("need") - F.col("above")).alias("need"))
    met = keyed.join(F.broadcast(cut_lineage(cuts)), names)
    return met.filter(F.struct("kind", "score", -F.col("place")) >= F.struct("kind_cut", "score_cut", "place_cut")).select("row")

"""Exact global row numbers, seeded orders and exact-size splits without a
single-partition window: a balanced range sort, a checkpoint, per-partition counts
(one small row per partition) and in-partition row numbers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def seeded_hash(seed, *parts) -> Column:
    """md5 hex of ``seed:part1:part2...`` -- the same value DuckDB's md5 gives."""
    cols = [F.lit(str(seed))]
    for p in parts:
        cols += [F.lit(":"), (F.col(p) if isinstance(p, str) else p).cast("string")]
    return F.md5(F.concat(*cols))


def global_index(df: DataFrame, order_cols: list[str], out: str = "idx", total: str | None = None,
                 partition_cols: list[str] | None = None) -> DataFrame:
    """0-based position of every row in ``order_cols`` order (restarted for every value
    of ``partition_cols``), exact, with no single-partition window over the data.

    1. a range-partitioned sort on the full order (Spark samples the keys, so the
       partitions are balanced however the keys cluster);
    2. a reliable checkpoint to the shared folder fixes partitions and row order;
    3. rows per sorted partition (at most one row per partition and partition value);
    4. position = rows before this partition + row number inside it, read from
       ``monotonically_increasing_id`` (partition index in the high bits).
    Only the order and partition columns go through this; other columns are joined back
    by them, so they must name a row (end the order with a unique column)."""
    from packwright.session import cut_lineage

    parts = list(partition_cols or [])
    keys = list(dict.fromkeys([*parts, *order_cols]))
    if set(df.columns) - set(keys):
        indexed = global_index(df.select(*keys), order_cols, out, total, parts)
        return df.join(indexed, on=keys)
    s = cut_lineage(df.orderBy(*parts, *order_cols))
    s = s.withColumn("__m", F.monotonically_increasing_id())
    s = s.withColumn("__pid", F.shiftright("__m", 33)).withColumn("__local", F.col("__m").bitwiseAND(F.lit((1 << 33) - 1)))
    # rows before each sorted partition (one row per partition)
    per_pid = s.groupBy("__pid").agg(F.count(F.lit(1)).alias("__c"))
    pid_off = per_pid.select("__pid", F.coalesce(F.sum("__c").over(
        Window.orderBy("__pid").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).cast("bigint").alias("__off"),
        F.sum("__c").over(Window.partitionBy(F.lit(1))).cast("bigint").alias("__all"))
    j = s.join(F.broadcast(pid_off), "__pid").withColumn("__g", F.col("__off") + F.col("__local"))
    if parts:
        # rows before each partition value and its size (one row per value)
        per_part = s.groupBy(*parts).agg(F.count(F.lit(1)).alias("__size"))
        w = Window.orderBy(*parts).rowsBetween(Window.unboundedPreceding, -1)
        part_off = per_part.select(*parts, "__size", F.coalesce(F.sum("__size").over(w), F.lit(0)).cast("bigint").alias("__start"))
        j = j.join(part_off, parts)
    else:
        j = j.withColumn("__start", F.lit(0).cast("bigint")).withColumn("__size", F.col("__all"))
    j = j.withColumn(out, (F.col("__g") - F.col("__start")).cast("bigint"))
    if total:
        j = j.withColumn(total, F.col("__size").cast("bigint"))
    return j.drop("__m", "__pid", "__local", "__off", "__all", "__g", "__start", "__size")


def sequential_index(df: DataFrame, order_cols: list[str], out: str = "idx") -> DataFrame:
    """Exact position in key order (``order_cols`` must end with a unique column)."""
    return global_index(df, order_cols, out=out)


def seeded_order(df: DataFrame, key: str, seed, *salt, out: str = "idx", total: str | None = None,
                 partition_cols: list[str] | None = None) -> DataFrame:
    """Rows in md5(seed:salt...:key) order (ties by key), numbered from 0. A salt is a
    literal value or a Column (e.g. the epoch)."""
    salts = [s if isinstance(s, Column) else F.lit(s) for s in salt]
    d = df.withColumn("__h", seeded_hash(seed, *salts, key))
    return global_index(d, ["__h", key], out=out, total=total, partition_cols=partition_cols).drop("__h")


DIGITS = 4  # hex digits that one round of the cut looks at


def smallest(df: DataFrame, hash_col: str, key: str, k: int) -> tuple[str, object] | None:
    """(hash, key) of the k-th row in (hash, key) order, None if k is 0: a histogram of the
    next hash digits narrows the range (at most 16^4 counts come back a round), until the rows
    that share the whole prefix are few."""
    prefix, left, rows = "", k, df
    while left > 0:
        n = len(prefix)
        digits = F.substring(hash_col, n + 1, DIGITS)
        hist = sorted(tuple(r) for r in rows.groupBy(digits.alias("d")).agg(F.count(F.lit(1)).alias("n")).collect())
        for d, count in hist:
            if left <= count:
                break
            left -= count
        prefix += d
        rows = rows.filter(F.col(hash_col).startswith(prefix))
        if count <= FEW or len(prefix) >= 32:
            last = rows.select(hash_col, key).orderBy(hash_col, key).limit(left).orderBy(F.desc(hash_col), F.desc(key)).first()
            return last[0], last[1]
    return None


FEW = 1000  # rows among which the last place is found by sorting


def exact_split(df: DataFrame, key: str, fraction: float, seed, out: str = "split",
                test_name: str = "test", train_name: str = "train") -> DataFrame:
    """Seeded split with exactly ceil(fraction * n) test rows: those of smallest seeded hash
    (ties by key). The cut is found on a written (hash, key) table; the rows themselves are
    neither sorted nor written."""
    from math import ceil

    from packwright.session import cut_lineage

    h = seeded_hash(seed, key)
    keys = cut_lineage(df.select(h.alias("__h"), key))
    last = smallest(keys, "__h", key, ceil(keys.count() * fraction))
    if last is None:
        return df.withColumn(out, F.lit(train_name))
    at, row = F.lit(last[0]), F.lit(last[1])
    test = (h < at) | ((h == at) & (F.col(key) <= row))
    return df.withColumn(out, F.when(test, F.lit(test_name)).otherwise(F.lit(train_name)))


#: Modulus and multiplier of the round function of :func:`permuted` (products stay below 2^62).
PRIME, MULTIPLIER = 2_147_483_647, 48_271
STEPS = 3  # of two half rounds


def permutation_keys(seed: int, epoch: int) -> list[int]:
    """One key for each half round, below PRIME."""
    import hashlib

    return [int(hashlib.md5(f"{seed}:{epoch}:{i}".encode()).hexdigest()[:8], 16) % PRIME for i in range(2 * STEPS)]


def permutation_sides(n: int) -> tuple[int, int]:
    """(a, b): whole numbers whose product is n or little more."""
    import math

    a = max(1, math.isqrt(n))
    return a, max(1, -(-n // a))


def permuted(index: Column, n: int, keys: list[int]) -> Column:
    """The place of ``index`` (0 to n - 1) in a permutation of 0 to n - 1 that ``keys`` name: plain
    arithmetic, so any epoch's order, or any row's place in it, needs no sort and no table.

    A Feistel network on pairs (x div b, x mod b): each half round adds a function of one half to
    the other, which can be undone, so the whole is one to one on 0 to a*b - 1. A value of n or
    more (few: a*b - n < a) goes through again until it is below n, which keeps it one to one.
    ``n`` is below 2^62."""
    import math

    a, b = permutation_sides(n)
    spare = a * b - n
    # more walks than the longest possible, or so many that none is left (2^-100 a row)
    walks = 0 if not spare else min(spare, math.ceil(100 / math.log2(a * b / spare)))

    def half(value: Column, key: Column, side: int) -> Column:
        x = (value + key) % F.lit(PRIME)
        return ((x * x) % F.lit(PRIME) * F.lit(MULTIPLIER) + key) % F.lit(PRIME) % F.lit(side)

    def once(x: Column) -> Column:
        def step(acc, k):
            left = (acc["l"] + half(acc["r"], k["l"], a)) % F.lit(a)
            return F.struct(left.alias("l"), ((acc["r"] + half(left, k["r"], b)) % F.lit(b)).alias("r"))

        ks = F.array(*[F.struct(F.lit(keys[2 * i]).cast("long").alias("l"), F.lit(keys[2 * i + 1]).cast("long").alias("r"))
                       for i in range(STEPS)])
        start = F.struct(((x - x % F.lit(b)) / F.lit(b)).cast("long").alias("l"), (x % F.lit(b)).cast("long").alias("r"))
        return F.aggregate(ks, start, step, lambda acc: acc["l"] * F.lit(b).cast("long") + acc["r"])

    out = once(index.cast("long"))
    if walks:
        out = F.aggregate(F.sequence(F.lit(1), F.lit(walks)), out, lambda x, _: F.when(x < n, x).otherwise(once(x)))
    return F.when(index < n, out)

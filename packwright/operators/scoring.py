"""Score tables: masked sequence log-probabilities, preference losses, perplexity,
and the group-wise ranking operators (top-n in order, capacity-bounded assignment,
nucleus cut, greedy and weighted picks, penalty on seen items)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from packwright.operators.tokens import bounded_broadcast
from packwright.params import DEFAULT, IGNORE_INDEX, Params


def softplus(x: Column) -> Column:
    """ln(1 + e^x), written stably."""
    return F.greatest(x, F.lit(0.0)) + F.log(F.lit(1.0) + F.exp(-F.abs(x)))


def unigram_logp(counts: DataFrame, id_col: str = "id", cnt_col: str = "cnt") -> DataFrame:
    """Add-one smoothed log-probability per id: ln((cnt + 1) / (total + rows)).

    ``counts`` is a vocabulary-sized table (bounded), so its totals come from one
    window over it."""
    whole = Window.partitionBy(F.lit(1))
    return counts.select(
        F.col(id_col).alias("id"),
        F.log((F.col(cnt_col) + F.lit(1)) / (F.sum(cnt_col).over(whole) + F.count(F.lit(1)).over(whole))).alias("logp"),
    )


def sequence_logps(df: DataFrame, key: list[str], labels: str, logp: DataFrame, shift: bool = True,
                   ignore: int = IGNORE_INDEX, eps: float = 1e-5, params: Params = DEFAULT) -> DataFrame:
    """Per sequence: sum of log-probs of trained labels, their count, and the mean
    sum / (count + eps). ``logp`` is a broadcast (id, logp) table (<= vocabulary)."""
    start = 1 if shift else 0
    ex = df.select(*key, F.posexplode(labels).alias("__pos", "__lab")).filter(
        (F.col("__pos") >= start) & (F.col("__lab") != ignore))
    j = ex.join(bounded_broadcast(logp.select(F.col("id").alias("__lab"), "logp"), params), "__lab", "left")
    g = j.groupBy(*key).agg(F.sum("logp").alias("logp_sum"), F.count(F.lit(1)).alias("n_trained"))
    return g.withColumn("logp_avg", F.col("logp_sum") / (F.col("n_trained") + F.lit(eps)))


def orpo_metrics(pairs: DataFrame, chosen: str, rejected: str, beta: float) -> DataFrame:
    """ORPO: log-odds of chosen vs rejected mean log-probs; loss = -c + beta *
    softplus(-log_odds); rewards, accuracy and both loss parts as means."""
    c, r = F.col(chosen), F.col(rejected)
    log_odds = (c - r) - (F.log(F.lit(1.0) - F.exp(c)) - F.log(F.lit(1.0) - F.exp(r)))
    orl = softplus(-log_odds)
    return pairs.agg(
        F.count(F.lit(1)).alias("n_pairs"),
        F.avg(-c + F.lit(beta) * orl).alias("loss"),
        F.avg(-c).alias("sft_loss"),
        (F.lit(beta) * F.avg(orl)).alias("orpo_loss"),
        (F.lit(beta) * F.avg(c)).alias("chosen_rewards"),
        (F.lit(beta) * F.avg(r)).alias("rejected_rewards"),
        F.avg((c > r).cast("double")).alias("acc"),
    )


def dpo_loss(pc: Column, pr: Column, rc: Column, rr: Column, beta: float) -> Column:
    return softplus(-F.lit(beta) * ((pc - pr) - (rc - rr)))


def penalise_seen(cands: DataFrame, seen: DataFrame, item: str, score: str, penalty: float) -> DataFrame:
    """Candidates already present in the history: negative scores are multiplied by
    the penalty, others divided. History is de-duplicated before the join."""
    h = seen.select(F.col(item).alias("__seen")).dropDuplicates()
    j = cands.join(h, cands[item] == F.col("__seen"), "left")
    s = F.col(score)
    return j.withColumn(score, F.when(F.col("__seen").isNull(), s).when(s < 0, s * penalty).otherwise(s / penalty)).drop("__seen")


def nucleus(df: DataFrame, group: list[str], item: str, score: str, temperature: float, top_p: float) -> DataFrame:
    """Per group softmax(score / T) (stabilised by the group max), ascending by
    probability (ties by item), drop items while the running mass <= 1 - top_p.

    A group is a candidate set (at most the vocabulary), so the running-sum window
    holds a bounded number of rows per group."""
    if not temperature > 0:
        raise ValueError("temperature must be > 0")
    if not 0 < top_p < 1:
        raise ValueError("top_p must be in (0, 1)")
    g = Window.partitionBy(*group)
    s = F.col(score) / F.lit(temperature)
    d = df.withColumn("__s", s).withColumn("__e", F.exp(F.col("__s") - F.max("__s").over(g)))
    d = d.withColumn("prob", F.col("__e") / F.sum("__e").over(g))
    run = Window.partitionBy(*group).orderBy("prob", item).rowsBetween(Window.unboundedPreceding, 0)
    d = d.withColumn("__cum", F.sum("prob").over(run))
    return d.filter(F.col("__cum") > F.lit(1 - top_p)).drop("__s", "__e", "__cum")


def greedy_pick(df: DataFrame, group: list[str], item: str, score: str) -> DataFrame:
    """Arg-max item per group, ties to the smaller item. Aggregate (map-side combined),
    so a hot group is reduced before the shuffle."""
    return df.groupBy(*group).agg(F.max_by(F.col(item), F.struct(F.col(score), -F.col(item))).alias(item))


def uniform_from_hash(seed, key: str) -> Column:
    """Deterministic uniform in (0, 1) from md5(seed:key): 52 bits of the digest."""
    h = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    return (F.conv(F.substring(h, 1, 13), 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2 ** 52))


def weighted_pick(df: DataFrame, group: list[str], item: str, score: str, temperature: float, seed) -> DataFrame:
    """One draw per group with probability softmax(score / T): Gumbel-max, arg-max of
    score / T - ln(-ln(u)); the group's log-normaliser is constant so it is skipped."""
    u = uniform_from_hash(seed, item)
    k = F.col(score) / F.lit(temperature) - F.log(-F.log(u))
    return df.withColumn("__k", k).groupBy(*group).agg(F.max_by(F.col(item), F.struct("__k", -F.col(item))).alias(item))


def top_n_in_order(arr: Column, score, ratio: float) -> Column:
    """Per row: positions of the int(ratio * n) best elements (score desc, position
    asc), returned in position order. Runs inside the row, no shuffle."""
    n = F.size(arr)
    keep = F.floor(n * F.lit(ratio)).cast("int")
    ranked = F.sort_array(F.transform(arr, lambda x, i: F.struct((-score(x)).alias("k"), i.alias("pos"))))
    best = F.slice(ranked, 1, keep)
    return F.sort_array(F.transform(best, lambda s: s["pos"]))


def capacity_assign(df: DataFrame, group: list[str], item: str, probs: str, n_buckets: int, k: int) -> DataFrame:
    """Every bucket takes its best ``n_items * k // n_buckets`` items of a group (by
    probability desc, ties by item); an item may be taken by several buckets or by
    none. Returns (group, item, bucket) rows plus bucket -1 for untaken items.

    Groups are bounded (a sequence of items), so per-(group, bucket) windows are too."""
    ex = df.select(*group, item, F.posexplode(probs).alias("bucket", "p"))
    n_items = F.count(F.lit(1)).over(Window.partitionBy(*group, "bucket"))
    ranked = ex.withColumn("__cap", F.floor(n_items * F.lit(k) / F.lit(n_buckets))).withColumn(
        "__rk", F.row_number().over(Window.partitionBy(*group, "bucket").orderBy(F.desc("p"), item)))
    taken = ranked.filter(F.col("__rk") <= F.col("__cap")).select(*group, item, F.col("bucket").cast("int"))
    untaken = df.select(*group, item).join(taken.select(*group, item).distinct(), [*group, item], "left_anti") \
        .withColumn("bucket", F.lit(-1))
    return taken.unionByName(untaken)

"""Array rules on token-id columns, all linear-time higher-order expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from packwright.params import IGNORE_INDEX


def _c(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def _let(value: Column, body) -> Column:
    """Evaluate ``value`` once and pass it to ``body`` (a lambda variable bound through
    a one-element array), instead of repeating the expression inside lambdas."""
    return F.get(F.transform(F.array(value), body), 0)


def segment_mask(ids, eos_id: int) -> Column:
    """Segment numbers: start at 1 and step up *after* every eos.

    eos positions -> run boundaries (computed once per row) -> runs of the segment
    number; O(n) per row."""
    a = _c(ids)
    n = F.size(a)
    eos_pos = F.filter(F.transform(a, lambda x, i: F.when(x == eos_id, i).otherwise(F.lit(-1))), lambda p: p >= 0)
    bounds = F.concat(F.array(F.lit(-1)), eos_pos, F.array(n - 1))
    runs = _let(bounds, lambda b: F.flatten(F.transform(
        F.sequence(F.lit(1), F.size(b) - 1), lambda k: F.array_repeat(k, F.get(b, k) - F.get(b, k - 1)))))
    return F.when(n == 0, F.array().cast("array<int>")).otherwise(runs)


def right_pad(arr, length: int, value: int) -> Column:
    a = _c(arr)
    return F.concat(a, F.array_repeat(F.lit(value), F.greatest(F.lit(length) - F.size(a), F.lit(0))))


def ones_like(arr) -> Column:
    return F.array_repeat(F.lit(1), F.size(_c(arr)))


def masked_labels(prompt_ids, target_ids, ignore: int = IGNORE_INDEX) -> Column:
    """Loss labels: ignore id on prompt tokens, ids on reply tokens."""
    return F.concat(F.array_repeat(F.lit(ignore), F.size(_c(prompt_ids))), _c(target_ids))


def shifted_targets(labels) -> Column:
    """Position i predicts i+1: the target row is labels[1:]."""
    a = _c(labels)
    return F.slice(a, 2, F.greatest(F.size(a) - 1, F.lit(0)))


def trained_count(labels, ignore: int = IGNORE_INDEX) -> Column:
    return F.size(F.filter(_c(labels), lambda x: x != ignore))


def truncate_at(ids, stop_id: int, max_len: int) -> Column:
    """Keep up to and including the first stop id, at most ``max_len`` tokens."""
    a = _c(ids)
    first = F.array_position(a, stop_id)
    keep = F.least(F.lit(max_len), F.when(first > 0, first).otherwise(F.size(a)))
    return F.slice(a, 1, keep.cast("int"))


def special_mask(ids, special_ids) -> Column:
    s = F.array(*[F.lit(x) for x in special_ids])
    return F.transform(_c(ids), lambda x: F.array_contains(s, x).cast("int"))


def wrap_specials(first, second=None, bos: int | None = None, eos: int | None = None) -> Column:
    """bos + first + eos (+ bos + second + eos); either marker may be switched off."""
    pre = [F.array(F.lit(bos))] if bos is not None else []
    post = [F.array(F.lit(eos))] if eos is not None else []
    parts = pre + [_c(first)] + post
    if second is not None:
        parts += pre + [_c(second)] + post
    return F.concat(*parts)


def token_type_ids(first, second=None, bos: int | None = None, eos: int | None = None) -> Column:
    extra = (1 if bos is not None else 0) + (1 if eos is not None else 0)
    out = F.array_repeat(F.lit(0), F.size(_c(first)) + extra)
    if second is not None:
        out = F.concat(out, F.array_repeat(F.lit(1), F.size(_c(second)) + extra))
    return out


def special_tokens_mask(first, second=None, bos: int | None = None, eos: int | None = None) -> Column:
    pre = [F.array(F.lit(1))] if bos is not None else []
    post = [F.array(F.lit(1))] if eos is not None else []
    parts = pre + [F.array_repeat(F.lit(0), F.size(_c(first)))] + post
    if second is not None:
        parts += pre + [F.array_repeat(F.lit(0), F.size(_c(second)))] + post
    return F.concat(*parts)


def attention_pairs(mask) -> Column:
    """Visible (query, key) pairs under the causal mask the model builds from a row.

    Segment numbers above 1: block-diagonal, sum over segments of n(n+1)/2 for
    non-zero segment values (runs are contiguous). 0/1 masks: key j is visible to
    every query i >= j when mask[j] = 1, i.e. sum of (L - j) over set keys."""
    m = _c(mask)
    n = F.size(m)
    starts = F.filter(
        F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))),
        lambda i: (i < n) & ((i == 0) | (F.get(m, i) != F.get(m, i - 1))),
    )

    def blocks(s: Column) -> Column:
        ends = F.concat(F.slice(s, 2, F.greatest(F.size(s) - 1, F.lit(0))), F.array(n))
        return F.aggregate(
            F.arrays_zip(s.alias("s"), ends.alias("e")),
            F.lit(0).cast("bigint"),
            lambda acc, r: acc + F.when(F.get(m, r["s"]) != 0,
                                        ((r["e"] - r["s"]) * (r["e"] - r["s"] + 1) / 2).cast("bigint")).otherwise(0),
        )

    causal = F.aggregate(
        F.transform(m, lambda x, j: (x * (n - j)).cast("bigint")), F.lit(0).cast("bigint"), lambda acc, x: acc + x
    )
    return F.when(n == 0, F.lit(0).cast("bigint")).when(F.array_max(m) > 1, _let(starts, blocks)).otherwise(causal)

"""Conversation repair against a search over all edit scripts, and the table of steps against
plain strings."""

import hashlib
import itertools
import random
import re
import zlib

import pytest

from packwright.llm import conversation_repair as R
from packwright.llm import queries as Q

SCHEMA = "conv_id long, turn long, role string, text string"
SPACE = " \t\n\x0b\x0c\r"


def key(r):
    return (r[0] is not None, r[0] or 0, r[1], r[2])


def faults(rows):
    seen, out = set(), []
    for _, role, text in rows:
        bare = text.strip(SPACE)
        out.append("blank" if not bare else "duplicate" if (role, text) in seen else
                   "truncated" if bare[-1] not in ".!?" else None)
        seen.add((role, text))
    return out


def cheapest(rows, marks):
    """(cost, audit, repaired) of the best script, by breadth over all of them."""
    legal = re.compile(r"s?(ua)*u?")  # what can still become legal
    held = {("", ""): (0, [])}  # (initials, audit) -> (cost, repaired)

    def inserts(held):
        out = dict(held)
        for _ in range(3):
            for (ini, audit), (cost, rep) in list(out.items()):
                for role in ("user", "assistant"):
                    k = (ini + role[0], audit + "I")
                    if legal.fullmatch(k[0]) and len(audit) - len(audit.rstrip("I")) < 3:
                        if k not in out or out[k][0] > cost + 2:
                            out[k] = (cost + 2, [*rep, (role, "")])
        return out

    for (_, role, text), mark in zip(rows, marks):
        new = {}
        for (ini, audit), (cost, rep) in inserts(held).items():
            ways = [(ini, audit + "D", cost + 3, rep)]
            if mark not in ("blank", "duplicate"):
                extra = mark == "truncated"
                for letter, r, c in (("K", role, 0), ("R", "user", 2), ("R", "assistant", 2)):
                    if r and legal.fullmatch(ini + r[0]):
                        ways.append((ini + r[0], audit + letter, cost + c + extra, [*rep, (r, text)]))
            for i, a, c, p in ways:
                if (i, a) not in new or new[i, a][0] > c:
                    new[i, a] = (c, p)
        least = min(c for c, _ in new.values())
        held = {k: v for k, v in new.items() if v[0] <= least + 8}  # eight edits' slack: no way back costs more
    ends = [(c, a, p) for (i, a), (c, p) in inserts(held).items() if re.fullmatch(r"(s?(ua)+)?", i)]
    return min(ends, key=lambda x: x[:2])


def want(conv, rows):
    """rows: (turn, role, text) after damage, of one conversation."""
    rows = sorted(rows, key=key)
    marks = faults(rows)
    cost, audit, repaired = cheapest(rows, marks)
    turns = [t for t, _, _ in rows if t is not None]
    gaps = max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0
    pairs = [a[1][:1] + b[1][:1] for a, b in itertools.pairwise(rows)]
    text = "\n".join(f"{r}:{t}" for r, t in repaired)
    return (conv, gaps, marks.count("blank"), marks.count("duplicate"), marks.count("truncated"),
            sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256(text.encode()).hexdigest())


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def by_conv(rows):
    out = {}
    for c, t, r, x in rows:
        out.setdefault(c, []).append((t, " " if r is None else r, " " if x is None else x))
    return out


def random_rows(seed, convs, roles):
    rng = random.Random(seed)
    rows = []
    for c in range(convs):
        for t in range(rng.randint(1, 7)):
            text = rng.choice(["Yes.", "no", "", " \t", "a?", f"t{t}!", None, "x. \n"])
            rows.append((c, rng.choice([t, t, t, t + 3, 0, None]), rng.choice(roles), text))
    return rows


@pytest.mark.parametrize("seed", range(3))
def test_cheapest_scripts(spark, seed):
    rows = random_rows(seed, 120, ["user", "assistant", "user", "assistant", "system", "tool", None, ""])
    out = R.conversation_audits(spark.createDataFrame(rows, SCHEMA).repartition(5))
    assert got(out) == sorted((want(c, r) for c, r in by_conv(rows).items()), key=str)


def test_spilt_conversations_agree(spark):
    rows = random_rows(9, 60, ["user", "assistant", "system"])
    rng = random.Random(4)
    rows += [(1000, t, rng.choice(["user", "assistant"]), f"turn {t}{rng.choice(['', '.', ''])}") for t in range(20_000)]
    src = spark.createDataFrame(rows, SCHEMA).repartition(7)
    whole, spilt = got(R.conversation_audits(src)), got(R.conversation_audits(src, spill_bytes=2000))
    assert whole == spilt
    assert len(next(r for r in whole if r[0] == 1000)[7]) >= 20_000


def test_repaired_turns_are_legal(spark):
    rows = random_rows(21, 80, ["user", "assistant", "system", "bot"])
    turns = R.repaired_turns(spark.createDataFrame(rows, SCHEMA)).collect()
    for conv, group in itertools.groupby(sorted(turns, key=lambda r: (r.conv, r.seq)), key=lambda r: r.conv):
        group = list(group)
        assert [r.seq for r in group] == list(range(len(group)))
        assert re.fullmatch(r"(s?(ua)+)?", "".join(r.role[0] for r in group if r.edit != "D"))
        assert sum(r.edit != "I" for r in group) == len(by_conv(rows)[conv])


def test_defined_cases(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert got(R.conversation_audits(empty)) == []
    rows = [(None, None, "user", "a."), (None, 0, "assistant", "b."), (None, 0, "assistant", "b."), (7, None, None, None),
            (8, 0, "user", "é" * 200_000 + "."), (8, 5, "assistant", "ok.")]
    src = spark.createDataFrame([(*r, 1, "z") for r in rows], SCHEMA + ", row int, k1 string")
    assert got(R.conversation_audits(src)) == sorted((want(c, r) for c, r in by_conv(rows).items()), key=str)
    only_named = R.conversation_audits(src, present=R.F.lit(False))
    assert {r[0]: r[1:] for r in got(only_named)} == {
        c: (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest()) for c in (None, 7, 8)}


def test_hot_repeats(spark):
    rows = [(1, t, ["user", "assistant"][t % 2], "ok.") for t in range(3000)]
    (r,) = got(R.conversation_audits(spark.createDataFrame(rows, SCHEMA)))
    assert (r[3], r[6], r[7]) == (2998, 3 * 2998, "KK" + "D" * 2998)


def damage(rows):
    out = {}
    for c, t, role, text in rows:
        name = f"{' ' if c is None else c}:{' ' if t is None else t}"
        how, role, text = zlib.crc32(name.encode()) % 20, " " if role is None else role, " " if text is None else text
        mine = out.setdefault(c, [])
        if how == 1:
            text = ""
        if how == 2:
            text = re.sub("[.!?]", "", text)
        if how == 4:
            role = "user"
        mine += [(t, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    return out


def test_query_over_a_table(spark):
    d = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    wanted = sorted((want(c, r) for c, r in damage(rows).items()), key=str)
    assert got(Q.op11_conversation_repair(spark, d)) == wanted

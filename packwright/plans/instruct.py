"""Instruction and preference queries: union, repeat removal, split, chat template,
supervised and preference examples, and the per-example array rules."""

from __future__ import annotations

from pyspark.sql import functions as F

from packwright import sql as S
from packwright.functions import arrays as AR
from packwright.functions.text import prompt_text, template_replace
from packwright.operators import examples as X
from packwright.operators import instruct as I
from packwright.operators.tokens import vocab_for_join
from packwright.params import BOS_ID, BOS_TOKEN, EOS_TOKEN, ROLE_ASSISTANT, ROLE_USER
from packwright.plans.common import EOS, EOS_LIT, L, P, ids_str, tokens_sql, vocab, vocab_sql
from packwright.sources import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}
KEY = ["conv_id", "turn"]
IGN = P.ignore_index


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


# --- SQL twins of the template and the block encoder ---------------------------------
SYS_SQL = S.lit(X.system_block(P))
UB_PRE = S.lit(f"\n{BOS_TOKEN}{ROLE_USER}\n")
UB_POST = S.lit(f"{EOS_TOKEN}\n{BOS_TOKEN}{ROLE_ASSISTANT}\n")
PROMPT_SQL = "(CASE WHEN input <> '' THEN instruction || chr(10) || input ELSE instruction END)"


def ub(x: str) -> str:
    return f"({UB_PRE} || {x} || {UB_POST})"


CHAT_BLOCKS_SQL = (
    "list_concat(flatten(list_transform(history, lambda p, i: ["
    f"{{'text': (CASE WHEN i = 1 THEN {SYS_SQL} ELSE '' END) || {ub('p[1]')}, 'trained': false, 'side': 0}}, "
    f"{{'text': p[2] || {EOS_LIT}, 'trained': true, 'side': 0}}])), "
    f"[{{'text': (CASE WHEN len(history) = 0 THEN {SYS_SQL} ELSE '' END) || {ub(PROMPT_SQL)}, 'trained': false, 'side': 0}}, "
    "{'text': output, 'trained': true, 'side': 0}])"
)
DPO_BLOCKS_SQL = (
    f"[{{'text': {SYS_SQL} || {ub(PROMPT_SQL)}, 'trained': false, 'side': 0}}, "
    "{'text': output[1], 'trained': true, 'side': 1}, {'text': output[2], 'trained': true, 'side': 2}]"
)


def token_rows_sql(src: str, blocks: str) -> str:
    """CTEs vocab, bl, tk, ti(conv_id, turn, b, pos, trained, side, id)."""
    return f"""vocab AS {vocab_sql()},
bl AS (SELECT conv_id, turn, unnest(list_transform({blocks}, lambda x, i: {{'text': x.text, 'trained': x.trained, 'side': x.side, 'b': i}})) AS blk FROM ({src})),
tk AS (SELECT conv_id, turn, blk.b AS b, blk.trained AS trained, blk.side AS side, unnest({tokens_sql(S.pretokens('blk.text'))}) AS s FROM bl),
ti AS (SELECT conv_id, turn, b, s.pos AS pos, trained, side, coalesce(v.id, 0) AS id FROM tk LEFT JOIN vocab v ON v.token = tk.s.token)"""


def sft_encoded_sql(src: str = A.SFT_SQL) -> str:
    return f"""{token_rows_sql(src, CHAT_BLOCKS_SQL)},
ex AS (SELECT conv_id, turn, list_concat(list(id ORDER BY b, pos), [{EOS}]) AS ids,
              list_concat(list(CASE WHEN trained THEN id ELSE {IGN} END ORDER BY b, pos), [{EOS}]) AS labels
       FROM ti GROUP BY conv_id, turn)"""


def pad_sql(x: str, value: int) -> str:
    return f"list_concat({x}, list_transform(range(greatest({L} - len({x}), 0)), lambda z: {value}))"


def ones_sql(x: str) -> str:
    return f"list_transform({x}, lambda z: 1)"


def s_(x: str) -> str:
    return f"array_to_string({x}, ' ')"


# --- queries ----------------------------------------------------------------------------
@q("prompt_text", f"SELECT conv_id, turn, {PROMPT_SQL} AS prompt FROM ({A.SFT_SQL})")
def prompt_text_q(spark, sf_dir):
    return A.sft(spark, sf_dir).select(*KEY, prompt_text("instruction", "input").alias("prompt"))


def _with_placeholders(col):
    return F.replace(F.replace(col, F.lit(" the "), F.lit(" <NAME> ")), F.lit(" und "), F.lit(" <AUTHOR> "))


PLACEHOLDER_SQL = "replace(replace(output, ' the ', ' <NAME> '), ' und ', ' <AUTHOR> ')"


def _template_sql(x: str) -> str:
    for a, b in P.placeholder_values:
        x = f"replace({x}, {S.lit(a)}, {S.lit(b)})"
    return x


@q("template_replace", f"SELECT conv_id, turn, {_template_sql(PLACEHOLDER_SQL)} AS output FROM ({A.SFT_SQL})")
def template_replace_q(spark, sf_dir):
    s = A.sft(spark, sf_dir)
    return s.select(*KEY, template_replace(_with_placeholders(F.col("output")), P.placeholder_values).alias("output"))


KEY_SQL = "array_to_string(list_concat(flatten(history), [instruction, input]), chr(31))"
KEY_COMPAT_SQL = "array_to_string(list_concat(flatten(history), [instruction, input]), '')"


@q("dedup_key", f"SELECT conv_id, turn, idx, md5({KEY_SQL}) AS key_md5, md5({KEY_COMPAT_SQL}) AS key_compat_md5 FROM ({A.SFT_DUP_SQL})")
def dedup_key_q(spark, sf_dir):
    d = A.sft_with_duplicates(spark, sf_dir)
    return d.select(*KEY, "idx", F.md5(I.dedup_key(P)).alias("key_md5"),
                    F.md5(I.dedup_key(P.with_(dedup_compat=True))).alias("key_compat_md5"))


@q("dedup_first", f"""SELECT conv_id, turn, idx FROM (SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY idx) AS rn
FROM ({A.SFT_DUP_SQL})) WHERE rn = 1""")
def dedup_first_q(spark, sf_dir):
    d = A.sft_with_duplicates(spark, sf_dir)
    return I.dedup_first(d, I.dedup_key(P), "idx").select(*KEY, "idx")


@q("dup_report", f"""SELECT count(*)::BIGINT AS n_rows, count(DISTINCT {KEY_SQL})::BIGINT AS n_distinct,
(count(*) - count(DISTINCT {KEY_SQL}))::BIGINT AS n_duplicates FROM ({A.SFT_DUP_SQL})""")
def dup_report(spark, sf_dir):
    d = A.sft_with_duplicates(spark, sf_dir)
    return I.duplicate_report(d, I.dedup_key(P))


SPLIT_KEY = "idx"


def _split_sql(src: str, key: str) -> str:
    return (f"SELECT *, CASE WHEN row_number() OVER (ORDER BY md5('{P.seed}:' || CAST({key} AS VARCHAR)), {key}) "
            f"<= ceil(count(*) OVER () * {P.test_fraction}) THEN 'test' ELSE 'train' END AS split FROM ({src})")


@q("train_test_split", "SELECT conv_id, turn, split FROM (" + _split_sql(
    f"SELECT *, conv_id * 1000 + turn AS idx FROM ({A.SFT_SQL})", "idx") + ")")
def train_test_split(spark, sf_dir):
    s = A.sft(spark, sf_dir).withColumn("idx", F.col("conv_id") * 1000 + F.col("turn"))
    return I.split_train_test(s, "idx", P).select(*KEY, "split")


# Four instruction sources built from the SFT table: plain records without a history
# column, records with history, records with repeats (deduplicated within that source
# only), and records whose outputs carry placeholders.
COMBINED_SQL = f"""(WITH d AS ({A.SFT_DUP_SQL}),
a AS (SELECT 0 AS source_rank, conv_id, turn, idx, instruction, input, output, []::VARCHAR[][] AS history FROM d WHERE conv_id % 4 = 0 AND idx < 10000000000),
b AS (SELECT 1 AS source_rank, conv_id, turn, idx, instruction, input, output, history FROM d WHERE conv_id % 4 = 1 AND idx < 10000000000),
c AS (SELECT 2 AS source_rank, conv_id, turn, idx, instruction, input, output, history FROM (
        SELECT *, row_number() OVER (PARTITION BY {KEY_SQL} ORDER BY idx) AS rn FROM d WHERE conv_id % 4 = 2) WHERE rn = 1),
e AS (SELECT 3 AS source_rank, conv_id, turn, idx, instruction, input, {_template_sql(PLACEHOLDER_SQL)} AS output, history FROM d WHERE conv_id % 4 = 3 AND idx < 10000000000)
SELECT * FROM a UNION ALL SELECT * FROM b UNION ALL SELECT * FROM c UNION ALL SELECT * FROM e)"""


def combined(spark, sf_dir):
    from packwright.session import cut_lineage

    # the four sources are slices of one frame: build it once, cut lineage
    d = cut_lineage(A.sft_with_duplicates(spark, sf_dir))
    first = F.col("idx") < F.lit(10_000_000_000)
    a = d.filter((F.col("conv_id") % 4 == 0) & first).drop("history")
    b = d.filter((F.col("conv_id") % 4 == 1) & first)
    c = I.dedup_first(d.filter(F.col("conv_id") % 4 == 2), I.dedup_key(P), "idx")
    e = I.rewrite_placeholders(
        d.filter((F.col("conv_id") % 4 == 3) & first).withColumn("output", _with_placeholders(F.col("output"))),
        "output", P)
    return I.union_sources([a, b, c, e])


@q("combine_instructions", "SELECT source_rank, conv_id, turn, len(history)::INTEGER AS n_history, output, split FROM ("
   + _split_sql(COMBINED_SQL, "idx") + ")")
def combine_instructions(spark, sf_dir):
    u = I.split_train_test(combined(spark, sf_dir), "idx", P)
    return u.select("source_rank", *KEY, F.size("history").alias("n_history"), "output", "split")


@q("chat_pairs", f"""SELECT conv_id, turn, len(bl)::INTEGER AS n_blocks,
array_to_string(list_transform(bl, lambda x: x.text), chr(30)) AS rendered,
array_to_string(list_transform(bl, lambda x: CASE WHEN x.trained THEN '1' ELSE '0' END), '') AS trained
FROM (SELECT conv_id, turn, {CHAT_BLOCKS_SQL} AS bl FROM ({A.SFT_SQL}))""")
def chat_pairs(spark, sf_dir):
    s = A.sft(spark, sf_dir).select(*KEY, X.chat_blocks(P).alias("bl"))
    return s.select(*KEY, F.size("bl").alias("n_blocks"),
                    F.array_join(F.transform("bl", lambda x: x["text"]), "\x1e").alias("rendered"),
                    F.array_join(F.transform("bl", lambda x: F.when(x["trained"], "1").otherwise("0")), "").alias("trained"))


@q("sft_examples", f"""WITH {sft_encoded_sql()}
SELECT conv_id, turn, len(ids)::INTEGER AS n_tokens, {s_(pad_sql('ids', P.pad_id))} AS input_ids,
  {s_(pad_sql(ones_sql('ids'), 0))} AS attention_mask, {s_(pad_sql('labels', IGN))} AS labels
FROM ex WHERE len(ids) < {L}""")
def sft_examples_q(spark, sf_dir):
    e = X.sft_examples(A.sft(spark, sf_dir), KEY, vocab(spark, sf_dir), P)
    return e.select(*KEY, "n_tokens", ids_str("input_ids").alias("input_ids"),
                    ids_str("attention_mask").alias("attention_mask"), ids_str("labels").alias("labels"))


def dpo_encoded_sql(src: str = A.PREFERENCE_SQL) -> str:
    valid = f"SELECT * FROM ({src}) WHERE len(output) = 2"
    return f"""{token_rows_sql(valid, DPO_BLOCKS_SQL)},
pe AS (SELECT conv_id, turn,
  coalesce(list(id ORDER BY b, pos) FILTER (WHERE side = 0), []) AS p,
  coalesce(list(id ORDER BY b, pos) FILTER (WHERE side = 1), []) AS c,
  coalesce(list(id ORDER BY b, pos) FILTER (WHERE side = 2), []) AS r FROM ti GROUP BY conv_id, turn),
de AS (SELECT conv_id, turn, list_concat(p, c, [{EOS}]) AS chosen_ids,
  list_concat(list_transform(p, lambda z: {IGN}), c, [{EOS}]) AS chosen_labels,
  list_concat(p, r, [{EOS}]) AS rejected_ids, list_concat(list_transform(p, lambda z: {IGN}), r, [{EOS}]) AS rejected_labels FROM pe)"""


@q("dpo_examples", f"""WITH {dpo_encoded_sql()}
SELECT conv_id, turn, {s_(pad_sql('chosen_ids', P.pad_id))} AS chosen_ids, {s_(pad_sql(ones_sql('chosen_ids'), 0))} AS chosen_attention_mask,
  {s_(pad_sql('chosen_labels', IGN))} AS chosen_labels, {s_(pad_sql('rejected_ids', P.pad_id))} AS rejected_ids,
  {s_(pad_sql(ones_sql('rejected_ids'), 0))} AS rejected_attention_mask, {s_(pad_sql('rejected_labels', IGN))} AS rejected_labels
FROM de WHERE len(chosen_ids) < {L} AND len(rejected_ids) < {L}""")
def dpo_examples_q(spark, sf_dir):
    e = X.dpo_examples(A.preference(spark, sf_dir), KEY, vocab(spark, sf_dir), P)
    return e.select(*KEY, *[ids_str(c).alias(c) for c in e.columns if c not in KEY])


@q("overlength_report", f"""WITH {sft_encoded_sql()}, sft_len AS (SELECT 'sft' AS kind, len(ids) AS length FROM ex WHERE len(ids) >= {L})
SELECT kind, count(*)::BIGINT AS n_dropped, max(length)::BIGINT AS max_length FROM sft_len GROUP BY kind
UNION ALL
SELECT kind, count(*)::BIGINT, max(length)::BIGINT FROM (
  WITH {dpo_encoded_sql()}
  SELECT CASE WHEN len(chosen_ids) >= {L} THEN 'chosen' ELSE 'rejected' END AS kind,
         CASE WHEN len(chosen_ids) >= {L} THEN len(chosen_ids) ELSE len(rejected_ids) END AS length
  FROM de WHERE len(chosen_ids) >= {L} OR len(rejected_ids) >= {L}) GROUP BY kind""")
def overlength_report(spark, sf_dir):
    return X.overlength_report(X.sft_lengths(A.sft(spark, sf_dir), [], P), X.dpo_lengths(A.preference(spark, sf_dir), [], P), P)


@q("preference_validation", f"""SELECT conv_id, turn, len(output)::INTEGER AS n_outputs,
CASE WHEN len(output) = 2 THEN 'valid' ELSE 'quarantined' END AS status FROM ({A.PREFERENCE_SQL})""")
def preference_validation(spark, sf_dir):
    return X.preference_status(A.preference(spark, sf_dir)).select(*KEY, F.size("output").alias("n_outputs"), "status")


# Final pair only: prompt block ids masked, reply ids + eos trained.
def _final_pair(spark, sf_dir):
    s = A.sft(spark, sf_dir).select(*KEY, "history", "instruction", "input", "output")
    blocks = F.slice(X.chat_blocks(P), -2, 2)
    e = X.encode_blocks(s.select(*KEY, blocks.alias("bl")), KEY, "bl", vocab(spark, sf_dir), P)
    src = F.transform(F.filter("toks", lambda t: ~t["trained"]), lambda t: t["id"])
    tgt = F.concat(F.transform(F.filter("toks", lambda t: t["trained"]), lambda t: t["id"]), F.array(F.lit(P.eos_id)))
    return e.select(*KEY, src.alias("src"), tgt.alias("tgt"))


FINAL_PAIR_SQL = f"""{token_rows_sql(A.SFT_SQL, f'list_slice({CHAT_BLOCKS_SQL}, -2, -1)')},
fp AS (SELECT conv_id, turn, coalesce(list(id ORDER BY b, pos) FILTER (WHERE NOT trained), []) AS src,
       list_concat(coalesce(list(id ORDER BY b, pos) FILTER (WHERE trained), []), [{EOS}]) AS tgt FROM ti GROUP BY conv_id, turn)"""


@q("mask_labels", f"""WITH {FINAL_PAIR_SQL}
SELECT conv_id, turn, {s_(f"list_concat(list_transform(src, lambda z: {IGN}), tgt)")} AS labels FROM fp""")
def mask_labels(spark, sf_dir):
    f = _final_pair(spark, sf_dir)
    return f.select(*KEY, ids_str(AR.masked_labels("src", "tgt", IGN)).alias("labels"))


@q("pad_rows", f"""WITH {FINAL_PAIR_SQL}
SELECT conv_id, turn, {s_(pad_sql('tgt', P.pad_id))} AS input_ids, {s_(pad_sql(ones_sql('tgt'), 0))} AS attention_mask,
  {s_(pad_sql('tgt', IGN))} AS labels FROM fp WHERE len(tgt) < {L}""")
def pad_rows(spark, sf_dir):
    f = _final_pair(spark, sf_dir).filter(F.size("tgt") < L)
    return f.select(*KEY, ids_str(AR.right_pad("tgt", L, P.pad_id)).alias("input_ids"),
                    ids_str(AR.right_pad(AR.ones_like("tgt"), L, 0)).alias("attention_mask"),
                    ids_str(AR.right_pad("tgt", L, IGN)).alias("labels"))


@q("loss_token_count", f"""WITH {sft_encoded_sql()}
SELECT conv_id, turn, len(list_filter(labels[2:], lambda z: z <> {IGN}))::INTEGER AS n_targets,
       (len(ids) - 1)::INTEGER AS n_positions FROM ex WHERE len(ids) < {L}""")
def loss_token_count(spark, sf_dir):
    """Counted from tokens per block; the first position is a prompt token, so the shift drops
    no trained label."""
    e = X.sft_lengths(A.sft(spark, sf_dir), KEY, P).filter(F.col("n_tokens") < L)
    return e.select(*KEY, F.col("n_trained").alias("n_targets"), (F.col("n_tokens") - 1).alias("n_positions"))


@q("special_token_arrays", f"""WITH {token_rows_sql(A.SFT_SQL, "[{'text': instruction, 'trained': false, 'side': 0}, {'text': output, 'trained': true, 'side': 1}]")},
pr AS (SELECT conv_id, turn, coalesce(list(id ORDER BY b, pos) FILTER (WHERE side = 0), []) AS a,
       coalesce(list(id ORDER BY b, pos) FILTER (WHERE side = 1), []) AS c FROM ti GROUP BY conv_id, turn)
SELECT conv_id, turn, {s_('list_concat(a, c)')} AS wrapped_default,
  {s_(f'list_concat([{BOS_ID}], a, [{EOS}], [{BOS_ID}], c, [{EOS}])')} AS wrapped_bos_eos,
  {s_("list_concat(list_transform(range(len(a) + 2), lambda z: 0), list_transform(range(len(c) + 2), lambda z: 1))")} AS token_type_ids,
  {s_("list_concat([1], list_transform(a, lambda z: 0), [1], [1], list_transform(c, lambda z: 0), [1])")} AS special_tokens_mask
FROM pr""")
def special_token_arrays(spark, sf_dir):
    s = A.sft(spark, sf_dir)
    blocks = F.array(X._blk(F.col("instruction"), False, 0), X._blk(F.col("output"), True, 1))
    e = X.encode_blocks(s.select(*KEY, blocks.alias("bl")), KEY, "bl", vocab(spark, sf_dir), P)
    e = e.select(*KEY, F.transform(F.filter("toks", lambda t: t["side"] == 0), lambda t: t["id"]).alias("a"),
                 F.transform(F.filter("toks", lambda t: t["side"] == 1), lambda t: t["id"]).alias("c"))
    return e.select(
        *KEY,
        ids_str(AR.wrap_specials("a", "c")).alias("wrapped_default"),
        ids_str(AR.wrap_specials("a", "c", bos=BOS_ID, eos=P.eos_id)).alias("wrapped_bos_eos"),
        ids_str(AR.token_type_ids("a", "c", bos=BOS_ID, eos=P.eos_id)).alias("token_type_ids"),
        ids_str(AR.special_tokens_mask("a", "c", bos=BOS_ID, eos=P.eos_id)).alias("special_tokens_mask"),
    )


def _first_row_sql(ex: str, where: str, sides: list[tuple[str, str, str]]) -> str:
    """(side, pos, id, label, token) of the first kept row: one row is chosen, one list of positions
    opened for each side, and the vocabulary joined last."""
    rows = " UNION ALL ".join(
        f"SELECT '{side}' AS side, unnest(list_transform(range(0, {L}), lambda i: {{'pos': i, 'id': a[i + 1], 'label': b[i + 1]}})) AS z "
        f"FROM (SELECT {pad_sql(ids, P.pad_id)} AS a, {pad_sql(labels, IGN)} AS b FROM first_row)" for side, ids, labels in sides)
    return f"""first_row AS (SELECT * FROM {ex} WHERE {where} QUALIFY row_number() OVER (ORDER BY conv_id, turn) = 1),
u AS ({rows})
SELECT u.side, u.z.pos::INTEGER AS pos, u.z.id AS id, u.z.label AS label, v.token FROM u JOIN vocab v ON v.id = u.z.id WHERE v.token <> '<unk>'"""


def _inspect(rows, sides, v):
    """(side, position, id, label, token) of padded rows, unknown and padding tokens skipped."""
    parts = F.array(*[F.struct(F.lit(side).alias("side"), F.col(ids).alias("ids"), F.col(labels).alias("labels"))
                      for side, ids, labels in sides])
    z = rows.select(F.explode(parts).alias("s")).select(
        "s.side", F.posexplode(F.arrays_zip(F.col("s.ids").alias("id"), F.col("s.labels").alias("label"))).alias("pos", "z"))
    z = z.select("side", "pos", F.col("z.id").alias("id"), F.col("z.label").alias("label"))
    d = z.join(vocab_for_join(v, P).select(F.col("id").alias("__id"), "token"), F.col("id") == F.col("__id")).drop("__id")
    return d.filter(F.col("token") != "<unk>")


@q("inspect_tokens", f"""WITH {sft_encoded_sql()},
{_first_row_sql('ex', f'len(ids) < {L}', [('sft', 'ids', 'labels')])}""")
def inspect_tokens(spark, sf_dir):
    """Row inspector for the first example. Showing one row is the feature, hence the limit;
    only that row is encoded."""
    kept = X.sft_lengths(A.sft(spark, sf_dir), KEY, P).filter(F.col("n_tokens") < L).select(*KEY).orderBy(*KEY).limit(1)
    v = vocab(spark, sf_dir)
    e = X.sft_examples(A.sft(spark, sf_dir).join(F.broadcast(kept), KEY, "left_semi"), KEY, v, P)
    return _inspect(e, [("sft", "input_ids", "labels")], v)


@q("inspect_preference", f"""WITH {dpo_encoded_sql()},
{_first_row_sql('de', f'len(chosen_ids) < {L} AND len(rejected_ids) < {L}',
                [('chosen', 'chosen_ids', 'chosen_labels'), ('rejected', 'rejected_ids', 'rejected_labels')])}""")
def inspect_preference(spark, sf_dir):
    """The same for the first preference pair: its chosen and its rejected row."""
    n = X.dpo_lengths(A.preference(spark, sf_dir), KEY, P)
    kept = n.filter((F.col("n_chosen") < L) & (F.col("n_rejected") < L)).select(*KEY).orderBy(*KEY).limit(1)
    v = vocab(spark, sf_dir)
    e = X.dpo_examples(A.preference(spark, sf_dir).join(F.broadcast(kept), KEY, "left_semi"), KEY, v, P)
    return _inspect(e, [("chosen", "chosen_ids", "chosen_labels"), ("rejected", "rejected_ids", "rejected_labels")], v)

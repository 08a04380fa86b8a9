"""Score-table queries. Token log-probabilities come from a unigram table of the
documents (a stand-in for model scores, derived from the given tables); group scores
come from ``embeddings``; candidates and history from token counts and ``benchmark``."""

from __future__ import annotations

from pyspark.sql import functions as F

from packwright import sql as S
from packwright.functions.arrays import truncate_at
from packwright.operators import examples as X
from packwright.operators import scoring as SC
from packwright.operators.topn import top_share
from packwright.operators.loading import fixed_batches
from packwright.operators.ordering import sequential_index
from packwright.operators.tokens import bounded_broadcast, encode, pretokens
from packwright.params import EOS_TOKEN, SPECIAL_TOKENS
from packwright.plans.common import EOS, L, P, ids_str, tokens_sql, vocab, vocab_sql
from packwright.plans.corpus import CONV_TEXT_SQL, packed_sql_cte, saved_packed
from packwright.plans.instruct import KEY, dpo_encoded_sql, sft_encoded_sql
from packwright.sources import adapters as A

QUERIES: dict = {}
ORACLES: dict = {}
IGN = P.ignore_index
BETA = P.beta


def q(name, sql=None):
    def deco(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return deco


LP_SQL = "lp AS (SELECT id, ln((cnt + 1) / (sum(cnt) OVER () + count(*) OVER ())) AS logp FROM vocab)"


def _logp(spark, sf_dir):
    return SC.unigram_logp(vocab(spark, sf_dir))


def _labels_sql(src: str, col: str, side: int | None = None) -> str:
    side_sel = f"{side} AS side, " if side is not None else ""
    return (f"SELECT conv_id, turn, {side_sel}unnest(list_transform({col}, lambda x, i: {{'lab': x, 'pos': i}})) AS s FROM {src}")


@q("sequence_logps", f"""WITH {sft_encoded_sql()}, {LP_SQL},
u AS ({_labels_sql(f"ex WHERE len(ids) < {L}", 'labels')}),
j AS (SELECT conv_id, turn, logp FROM u LEFT JOIN lp ON lp.id = u.s.lab WHERE s.pos >= 2 AND s.lab <> {IGN})
SELECT conv_id, turn, round(sum(logp), 6) AS logp_sum, count(*)::BIGINT AS n_trained,
       round(sum(logp) / (count(*) + 1e-5), 6) AS logp_avg FROM j GROUP BY ALL""")
def sequence_logps(spark, sf_dir):
    e = X.sft_examples(A.sft(spark, sf_dir), KEY, vocab(spark, sf_dir), P, keep_overlength=True)
    e = e.filter(F.col("n_tokens") < L)
    s = SC.sequence_logps(e, KEY, "labels", _logp(spark, sf_dir))
    return s.select(*KEY, F.round("logp_sum", 6).alias("logp_sum"), "n_trained", F.round("logp_avg", 6).alias("logp_avg"))


def _pair_token_rows(spark, sf_dir):
    """(conv_id, turn, side, label) for the trained, shifted labels of kept pairs."""
    d = X.dpo_examples(A.preference(spark, sf_dir), KEY, vocab(spark, sf_dir), P, keep_overlength=True)
    d = d.filter((F.size("chosen_ids") < L) & (F.size("rejected_ids") < L))
    sides = F.array(F.struct(F.lit(0).alias("side"), F.col("chosen_labels").alias("labels")),
                    F.struct(F.lit(1).alias("side"), F.col("rejected_labels").alias("labels")))
    x = d.select(*KEY, F.explode(sides).alias("__s"))
    x = x.select(*KEY, F.col("__s.side").alias("side"), F.posexplode("__s.labels").alias("pos", "lab"))
    return x.filter((F.col("pos") >= 1) & (F.col("lab") != IGN))


PAIR_ROWS_SQL = f"""{dpo_encoded_sql()}, {LP_SQL},
k AS (SELECT * FROM de WHERE len(chosen_ids) < {L} AND len(rejected_ids) < {L}),
u AS ({_labels_sql('k', 'chosen_labels', 0)} UNION ALL {_labels_sql('k', 'rejected_labels', 1)})"""


def _softplus_sql(x: str) -> str:
    return f"(greatest({x}, 0) + ln(1 + exp(-abs({x}))))"


@q("orpo_metrics", f"""WITH {PAIR_ROWS_SQL},
j AS (SELECT conv_id, turn, side, logp FROM u LEFT JOIN lp ON lp.id = u.s.lab WHERE s.pos >= 2 AND s.lab <> {IGN}),
pa AS (SELECT conv_id, turn, sum(logp) FILTER (WHERE side = 0) / (count(*) FILTER (WHERE side = 0) + 1e-5) AS c,
              sum(logp) FILTER (WHERE side = 1) / (count(*) FILTER (WHERE side = 1) + 1e-5) AS r FROM j GROUP BY ALL),
lo AS (SELECT *, {_softplus_sql('-((c - r) - (ln(1 - exp(c)) - ln(1 - exp(r))))')} AS orl FROM pa)
SELECT count(*)::BIGINT AS n_pairs, round(avg(-c + {BETA} * orl), 6) AS loss, round(avg(-c), 6) AS sft_loss,
  round({BETA} * avg(orl), 6) AS orpo_loss, round({BETA} * avg(c), 6) AS chosen_rewards,
  round({BETA} * avg(r), 6) AS rejected_rewards, round(avg(CASE WHEN c > r THEN 1.0 ELSE 0.0 END), 6) AS acc FROM lo""")
def orpo_metrics(spark, sf_dir):
    x = _pair_token_rows(spark, sf_dir)
    j = x.join(bounded_broadcast(_logp(spark, sf_dir).withColumnRenamed("id", "lab")), "lab", "left")
    side = F.col("side")
    pa = j.groupBy(*KEY).agg(
        (F.sum(F.when(side == 0, F.col("logp"))) / (F.count(F.when(side == 0, 1)) + F.lit(1e-5))).alias("c"),
        (F.sum(F.when(side == 1, F.col("logp"))) / (F.count(F.when(side == 1, 1)) + F.lit(1e-5))).alias("r"),
    )
    m = SC.orpo_metrics(pa, "c", "r", BETA)
    return m.select("n_pairs", *[F.round(c, 6).alias(c) for c in m.columns if c != "n_pairs"])


def _ref_logp(spark, sf_dir):
    """Reference-model stand-in: unigram of all conversation turns over the same ids.
    Tokens are matched to the broadcast vocabulary before counting, so both sides of
    the final join are vocabulary-sized."""
    d = A.table(spark, sf_dir, "conversations")
    v = vocab(spark, sf_dir).select("token", "id")
    toks = d.select(F.explode(pretokens("text")).alias("token")).join(bounded_broadcast(v), "token")
    cnt = toks.groupBy("id").agg(F.count(F.lit(1)).alias("c_ref"))
    j = v.join(cnt, "id", "left").select("id", F.coalesce("c_ref", F.lit(0)).cast("bigint").alias("cnt"))
    return SC.unigram_logp(j).withColumnRenamed("logp", "logp_ref")


@q("dpo_loss", f"""WITH {PAIR_ROWS_SQL},
rc AS (SELECT token, count(*) AS c_ref FROM (SELECT unnest({S.pretokens('text')}) AS token FROM conversations) GROUP BY token),
rl AS (SELECT id, ln((cnt + 1) / (sum(cnt) OVER () + count(*) OVER ())) AS logp_ref FROM (SELECT v.id, coalesce(rc.c_ref, 0) AS cnt FROM vocab v LEFT JOIN rc USING (token))),
j AS (SELECT conv_id, turn, side, logp, logp_ref FROM u LEFT JOIN lp ON lp.id = u.s.lab LEFT JOIN rl ON rl.id = u.s.lab WHERE s.pos >= 2 AND s.lab <> {IGN}),
pa AS (SELECT conv_id, turn, sum(logp) FILTER (WHERE side = 0) AS pc, sum(logp) FILTER (WHERE side = 1) AS pr,
              sum(logp_ref) FILTER (WHERE side = 0) AS rc_, sum(logp_ref) FILTER (WHERE side = 1) AS rr FROM j GROUP BY ALL)
SELECT conv_id, turn, round({_softplus_sql(f'-{BETA} * ((pc - pr) - (rc_ - rr))')}, 6) AS loss FROM pa""")
def dpo_loss(spark, sf_dir):
    x = _pair_token_rows(spark, sf_dir)
    lp = _logp(spark, sf_dir).join(_ref_logp(spark, sf_dir), "id").withColumnRenamed("id", "lab")
    j = x.join(bounded_broadcast(lp), "lab", "left")  # vocabulary-sized
    side = F.col("side")
    pa = j.groupBy(*KEY).agg(
        F.sum(F.when(side == 0, F.col("logp"))).alias("pc"), F.sum(F.when(side == 1, F.col("logp"))).alias("pr"),
        F.sum(F.when(side == 0, F.col("logp_ref"))).alias("rc"), F.sum(F.when(side == 1, F.col("logp_ref"))).alias("rr"),
    )
    return pa.select(*KEY, F.round(SC.dpo_loss(F.col("pc"), F.col("pr"), F.col("rc"), F.col("rr"), BETA), 6).alias("loss"))


@q("perplexity", f"""WITH {packed_sql_cte()}, {LP_SQL},
rows_ AS (SELECT pack_group, source, chunk, row_number() OVER (ORDER BY pack_group, source, chunk) - 1 AS i
          FROM (SELECT DISTINCT pack_group, source, chunk FROM m WHERE split = 'validation')),
tt AS (SELECT r.i // {P.batch_size} AS batch, -lp.logp AS nll FROM m JOIN rows_ r USING (pack_group, source, chunk)
      JOIN lp ON lp.id = m.id WHERE m.split = 'validation' AND m.g % {L} >= 1),
bb AS (SELECT batch, sum(nll) AS s, count(*) AS n FROM tt GROUP BY batch)
SELECT count(*)::BIGINT AS n_batches, sum(n)::BIGINT AS n_tokens, round(exp(avg(s / n)), 6) AS ppl_batch_mean,
       round(exp(sum(s) / sum(n)), 6) AS ppl_token FROM bb""")
def perplexity(spark, sf_dir):
    """exp of the mean per-batch mean loss (how the reference reports it), plus the
    token-weighted value, over every validation batch."""
    p = saved_packed(spark, sf_dir).filter(F.col("split") == "validation")  # partition pruning
    p = sequential_index(p, ["pack_group", "source", "chunk"], out="i")
    p = fixed_batches(p, "i", P.batch_size)
    t = p.select("batch", F.posexplode("input_ids").alias("pos", "id")).filter(F.col("pos") >= 1)
    t = t.join(bounded_broadcast(_logp(spark, sf_dir)), "id")
    b = t.groupBy("batch").agg(F.sum(-F.col("logp")).alias("s"), F.count(F.lit(1)).alias("n"))
    return b.agg(
        F.count(F.lit(1)).alias("n_batches"), F.sum("n").cast("bigint").alias("n_tokens"),
        F.round(F.exp(F.avg(F.col("s") / F.col("n"))), 6).alias("ppl_batch_mean"),
        F.round(F.exp(F.sum("s") / F.sum("n")), 6).alias("ppl_token"),
    )


SPECIALS_SQL = "(" + ", ".join(S.lit(t) for t in SPECIAL_TOKENS) + ")"
PEN_SQL = f"""vocab AS {vocab_sql()},
cc AS (SELECT lang, token, count(*) AS cnt FROM (SELECT lang, unnest({S.pretokens('text')}) AS token FROM documents) GROUP BY ALL),
cand AS (SELECT lang, token, ln(cnt) - 2 AS score FROM cc SEMI JOIN vocab USING (token) WHERE token NOT IN {SPECIALS_SQL}),
hist AS (SELECT DISTINCT unnest({S.pretokens('text')}) AS token FROM benchmark),
pen AS (SELECT c.lang, c.token, CASE WHEN h.token IS NULL THEN c.score WHEN c.score < 0 THEN c.score * {P.repetition_penalty}
        ELSE c.score / {P.repetition_penalty} END AS score FROM cand c LEFT JOIN hist h USING (token))"""


def _penalised(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents")
    cc = d.select("lang", F.explode(pretokens("text")).alias("token")).groupBy("lang", "token").agg(
        F.count(F.lit(1)).alias("cnt"))
    specials = F.array(*[F.lit(t) for t in SPECIAL_TOKENS])
    v = bounded_broadcast(vocab(spark, sf_dir).select("token"))
    cand = cc.join(v, "token", "left_semi").filter(~F.array_contains(specials, F.col("token")))
    cand = cand.select("lang", "token", (F.log(F.col("cnt")) - F.lit(2.0)).alias("score"))
    hist = A.table(spark, sf_dir, "benchmark").select(F.explode(pretokens("text")).alias("token"))
    return SC.penalise_seen(cand, hist, "token", "score", P.repetition_penalty)


@q("penalise_seen", f"WITH {PEN_SQL} SELECT lang, token, round(score, 6) AS score FROM pen")
def penalise_seen(spark, sf_dir):
    return _penalised(spark, sf_dir).select("lang", "token", F.round("score", 6).alias("score"))


@q("nucleus_filter", f"""WITH {PEN_SQL},
s AS (SELECT lang, token, exp(score / {P.temperature} - max(score / {P.temperature}) OVER (PARTITION BY lang)) AS e FROM pen),
p AS (SELECT lang, token, e / sum(e) OVER (PARTITION BY lang) AS prob FROM s),
c AS (SELECT lang, token, sum(prob) OVER (PARTITION BY lang ORDER BY prob, token ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS cum FROM p)
SELECT lang, token FROM c WHERE cum > {repr(1 - P.top_p)}::DOUBLE""")
def nucleus_filter(spark, sf_dir):
    n = SC.nucleus(_penalised(spark, sf_dir), ["lang"], "token", "score", P.temperature, P.top_p)
    return n.select("lang", "token")


GROUP_ITEMS = 64  # items per group in the embeddings table (a bounded "sequence")


def _emb(spark, sf_dir):
    e = A.table(spark, sf_dir, "embeddings")
    return e.select(F.expr(f"vec_id div {GROUP_ITEMS}").alias("grp"), "vec_id",
                    F.col("embedding").cast("array<double>").alias("v"))


@q("greedy_pick", f"""SELECT grp, vec_id FROM (SELECT vec_id // {GROUP_ITEMS} AS grp, vec_id,
 row_number() OVER (PARTITION BY vec_id // {GROUP_ITEMS} ORDER BY embedding[1]::DOUBLE DESC, vec_id) AS rk FROM embeddings) WHERE rk = 1""")
def greedy_pick(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumn("score", F.get("v", 0))
    return SC.greedy_pick(e, ["grp"], "vec_id", "score")


@q("weighted_pick", f"""SELECT grp, vec_id FROM (SELECT vec_id // {GROUP_ITEMS} AS grp, vec_id,
 row_number() OVER (PARTITION BY vec_id // {GROUP_ITEMS} ORDER BY embedding[2]::DOUBLE / {P.temperature}
   - ln(-ln((('0x' || substr(md5('{P.seed}:' || CAST(vec_id AS VARCHAR)), 1, 13))::BIGINT + 0.5) / 4503599627370496.0)) DESC, vec_id) AS rk
 FROM embeddings) WHERE rk = 1""")
def weighted_pick(spark, sf_dir):
    e = _emb(spark, sf_dir).withColumn("score", F.get("v", 1))
    return SC.weighted_pick(e, ["grp"], "vec_id", "score", P.temperature, P.seed)


KEEP_RATIO = 0.7  # share of items kept per group


@q("topn_in_order", f"""SELECT doc_id, array_to_string(list_sort(list_transform(list_slice(list_sort(list_transform(lines,
  lambda x, i: {{'k': -length(x), 'pos': i - 1}})), 1, floor(len(lines) * {KEEP_RATIO}::DOUBLE)::INTEGER), lambda s: s.pos)), ' ') AS kept
FROM (SELECT doc_id, string_split(text, chr(10)) AS lines FROM documents)""")
def topn_in_order(spark, sf_dir):
    d = A.table(spark, sf_dir, "documents").select("doc_id", F.split("text", "\n").alias("lines"))
    return d.select("doc_id", ids_str(SC.top_n_in_order(F.col("lines"), F.length, KEEP_RATIO)).alias("kept"))


TOP_ONE_TASK = 100  # rows of a source above which the cut is found by counting


@q("topn_by_source", f"""SELECT source, doc_id, n FROM (SELECT source, doc_id, length(text)::BIGINT AS n,
  row_number() OVER (PARTITION BY source ORDER BY length(text) DESC, doc_id) AS rk, count(*) OVER (PARTITION BY source) AS c FROM documents)
WHERE rk <= floor(c * {KEEP_RATIO}::DOUBLE)""")
def topn_by_source(spark, sf_dir):
    """The longest documents of each source, a share of its unknown number: a source that holds a
    third of the rows is not gathered."""
    d = A.table(spark, sf_dir, "documents").select("source", "doc_id", F.length("text").cast("bigint").alias("n"))
    return top_share(d, ["source"], "n", "doc_id", KEEP_RATIO, TOP_ONE_TASK)


N_BUCKETS = 64  # one for each element of a vector
PER_ITEM = 1


@q("capacity_assign", f"""WITH e AS (SELECT vec_id // {GROUP_ITEMS} AS grp, vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings),
p AS (SELECT grp, vec_id, list_transform(v, lambda x: round(exp(x - list_max(v)) / list_sum(list_transform(v, lambda y: exp(y - list_max(v)))), 6)) AS probs FROM e),
x AS (SELECT grp, vec_id, unnest(list_transform(probs, lambda x, i: {{'b': i - 1, 'p': x}})) AS s FROM p),
r AS (SELECT grp, vec_id, s.b AS bucket, row_number() OVER (PARTITION BY grp, s.b ORDER BY s.p DESC, vec_id) AS rk,
             count(*) OVER (PARTITION BY grp, s.b) * {PER_ITEM} // {N_BUCKETS} AS cap FROM x),
t AS (SELECT grp, vec_id, bucket::INTEGER AS bucket FROM r WHERE rk <= cap)
SELECT * FROM t UNION ALL SELECT grp, vec_id, -1 FROM e WHERE (grp, vec_id) NOT IN (SELECT (grp, vec_id) FROM t)""")
def capacity_assign(spark, sf_dir):
    e = _emb(spark, sf_dir)
    v = F.col("v")

    def once(value, fn):
        """fn of a value that is computed once a row, not once for each element."""
        return F.transform(F.array(value), fn)[0]

    ex = once(F.array_max(v), lambda m: F.transform(v, lambda x: F.exp(x - m)))
    probs = once(ex, lambda e: once(F.aggregate(e, F.lit(0.0), lambda a, x: a + x),
                                    lambda s: F.transform(e, lambda x: F.round(x / s, 6))))
    return SC.capacity_assign(e.select("grp", "vec_id", probs.alias("probs")), ["grp"], "vec_id", "probs", N_BUCKETS, PER_ITEM)


@q("truncate_at_eos", f"""WITH vocab AS {vocab_sql()},
t AS (SELECT conv_id, unnest({tokens_sql(S.pretokens('text'))}) AS s FROM {CONV_TEXT_SQL}),
i AS (SELECT conv_id, s.pos AS pos, coalesce(v.id, 0) AS id FROM t LEFT JOIN vocab v ON v.token = t.s.token),
f AS (SELECT conv_id, least({L}, coalesce(min(pos) FILTER (WHERE id = {EOS}), count(*))) AS keep FROM i GROUP BY conv_id)
SELECT conv_id, count(*)::INTEGER AS n_ids, array_to_string(list(id ORDER BY pos), ' ') AS ids FROM i JOIN f USING (conv_id) WHERE pos <= keep GROUP BY conv_id""")
def truncate_at_eos(spark, sf_dir):
    c = A.table(spark, sf_dir, "conversations")
    conv = c.groupBy("conv_id").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("turn", "text"))),
                                                            lambda s: F.concat(s["text"], F.lit(EOS_TOKEN))), "").alias("text"))
    e = encode(conv, "text", ["conv_id"], vocab(spark, sf_dir), P)
    t = e.select("conv_id", truncate_at("ids", P.eos_id, L).alias("ids"))
    return t.select("conv_id", F.size("ids").alias("n_ids"), ids_str("ids").alias("ids"))

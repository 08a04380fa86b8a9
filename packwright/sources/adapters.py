"""Adapters: the shared test tables -> the record shapes the operators consume.

Every adapter is written twice, once with DataFrame functions and once as a DuckDB
CTE (``*_SQL``) used by the oracle queries; both must give identical rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from packwright import sql as S

# Fixed values of the adapters (test-data conventions).
# Blocks of consecutive ids go to one split, every tenth to validation; sources repeat within
# a block, so split and source are independent.
SPLIT_BLOCK = 20
VALIDATION_EVERY = 10
SFT_INPUT_SUFFIX = "Reply in the same language."
SCREENSHOT_TITLE = "截图"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def split_col(key: str = "doc_id"):
    block = F.expr(f"{key} div {SPLIT_BLOCK}")
    return F.when(block % VALIDATION_EVERY == 0, F.lit("validation")).otherwise(F.lit("train"))


SPLIT_SQL = f"(CASE WHEN doc_id // {SPLIT_BLOCK} % {VALIDATION_EVERY} = 0 THEN 'validation' ELSE 'train' END)"


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Plain corpora (content/text/code all = documents.text) with a split column."""
    return table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "text", split_col().alias("split"))


CORPUS_SQL = f"SELECT doc_id, source, lang, text, {SPLIT_SQL} AS split FROM documents"


# --- wikipedia-shaped rows -------------------------------------------------------
def wikipedia(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wikipedia_from(table(spark, sf_dir, "documents"))


def wikipedia_from(d: DataFrame, keep: tuple = ()) -> DataFrame:
    title = F.substring_index("text", "\n", 1)
    body = F.expr("substr(text, length(substring_index(text, '\n', 1)) + 2)")
    early = F.when(F.col("doc_id") % 7 == 0, F.lit("See References\nbelow. ")).otherwise(F.lit(""))
    charts = F.when(F.col("doc_id") % 5 == 0, F.lit("\nCharts\nchart rows")).otherwise(F.lit(""))
    tail = (
        F.when(F.col("doc_id") % 3 == 0, F.lit("\nReferences\n\nsource list"))
        .when(F.col("doc_id") % 3 == 1, F.lit("\nExternal links\nlink list"))
        .otherwise(F.lit(""))
    )
    return d.select(
        *keep,
        F.col("doc_id").cast("string").alias("id"),
        "doc_id",
        "source",
        split_col().alias("split"),
        title.alias("title"),
        F.concat(early, body, charts, tail).alias("text"),
    )


WIKIPEDIA_SQL = (
    "SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, source, " + SPLIT_SQL + " AS split, "
    "split_part(text, chr(10), 1) AS title, "
    "(CASE WHEN doc_id % 7 = 0 THEN " + S.lit("See References\nbelow. ") + " ELSE '' END) || "
    "substr(text, length(split_part(text, chr(10), 1)) + 2) || "
    "(CASE WHEN doc_id % 5 = 0 THEN " + S.lit("\nCharts\nchart rows") + " ELSE '' END) || "
    "(CASE WHEN doc_id % 3 = 0 THEN " + S.lit("\nReferences\n\nsource list")
    + " WHEN doc_id % 3 = 1 THEN " + S.lit("\nExternal links\nlink list") + " ELSE '' END) AS text "
    "FROM documents"
)


# --- encyclopedia-shaped rows (nested) ---------------------------------------------
def baike(spark: SparkSession, sf_dir: str) -> DataFrame:
    return baike_from(table(spark, sf_dir, "documents"))


def baike_from(d: DataFrame, keep: tuple = ()) -> DataFrame:
    d = d.withColumn("__lines", F.split("text", "\n"))
    title = F.get(F.col("__lines"), 0)
    summary = F.when(F.col("doc_id") % 4 == 0, F.lit(None).cast("string")).otherwise(
        F.coalesce(F.get(F.col("__lines"), 1), F.lit(""))
    )
    rest = F.slice("__lines", 3, F.greatest(F.size("__lines") - 2, F.lit(0)))

    def section(line, i):
        stitle = F.when((F.col("doc_id") + i) % 11 == 0, F.lit(SCREENSHOT_TITLE)).otherwise(
            F.substring_index(line, " ", 1)
        )
        content = F.concat(
            F.replace(F.replace(line, F.lit(", "), F.lit(",　")), F.lit(". "), F.lit(".\n  \xa0")),
            F.when((i == 0) & (F.col("doc_id") % 2 == 0), F.concat(F.lit("\xa0\xa0"), title)).otherwise(F.lit("")),
        )
        return F.struct(stitle.alias("title"), content.alias("content"))

    return d.select(
        *keep,
        "doc_id",
        "source",
        split_col().alias("split"),
        title.alias("title"),
        summary.alias("summary"),
        F.transform(rest, section).alias("sections"),
        F.array(F.col("lang")).alias("tags"),
        F.concat(F.lit("doc/"), F.col("doc_id").cast("string")).alias("url"),
    )


BAIKE_SQL = (
    "SELECT doc_id, source, " + SPLIT_SQL + " AS split, __lines[1] AS title, "
    "(CASE WHEN doc_id % 4 = 0 THEN NULL ELSE coalesce(__lines[2], '') END) AS summary, "
    "list_transform(__lines[3:], lambda line, i: {'title': (CASE WHEN (doc_id + i - 1) % 11 = 0 THEN "
    + S.lit(SCREENSHOT_TITLE) + " ELSE split_part(line, ' ', 1) END), "
    "'content': replace(replace(line, ', ', ',' || chr(12288)), '. ', '.' || chr(10) || '  ' || chr(160)) || "
    "(CASE WHEN i = 1 AND doc_id % 2 = 0 THEN chr(160) || chr(160) || __lines[1] ELSE '' END)}) AS sections, "
    "[lang] AS tags, 'doc/' || CAST(doc_id AS VARCHAR) AS url "
    "FROM (SELECT *, string_split(text, chr(10)) AS __lines FROM documents)"
)


# --- code-shaped rows ----------------------------------------------------------------
def code(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select(
        "doc_id",
        split_col().alias("split"),
        F.col("text").alias("code"),
        F.col("source").alias("repo_name"),
        F.concat(F.col("doc_id").cast("string"), F.lit(".txt")).alias("path"),
        F.col("lang").alias("language"),
        F.lit("mit").alias("license"),
        F.col("n_chars").alias("size"),
    )


CODE_SQL = (
    "SELECT doc_id, " + SPLIT_SQL + " AS split, text AS code, source AS repo_name, "
    "CAST(doc_id AS VARCHAR) || '.txt' AS path, lang AS language, 'mit' AS license, n_chars AS size FROM documents"
)


# --- instruction records ---------------------------------------------------------------
def sft(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every assistant turn that answers a user turn becomes (instruction, input,
    output, history); history holds the conversation's earlier (user, assistant)
    pairs. Windows are per conversation only."""
    c = table(spark, sf_dir, "conversations")
    w = Window.partitionBy("conv_id").orderBy("turn")
    qa = (
        c.withColumn("__prev_role", F.lag("role").over(w))
        .withColumn("__prev_text", F.lag("text").over(w))
        .filter((F.col("role") == "assistant") & (F.col("__prev_role") == "user"))
        .select("conv_id", "turn", F.col("__prev_text").alias("instruction"), F.col("text").alias("output"))
    )
    wh = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, -1)
    return qa.select(
        "conv_id",
        "turn",
        "instruction",
        F.when(F.col("conv_id") % 2 == 0, F.lit("")).otherwise(F.lit(SFT_INPUT_SUFFIX)).alias("input"),
        "output",
        F.collect_list(F.array("instruction", "output")).over(wh).alias("history"),
    )


SFT_SQL = (
    "SELECT conv_id, turn, instruction, "
    "(CASE WHEN conv_id % 2 = 0 THEN '' ELSE " + S.lit(SFT_INPUT_SUFFIX) + " END) AS input, output, "
    "coalesce(list([instruction, output]) OVER (PARTITION BY conv_id ORDER BY turn "
    "ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), []::VARCHAR[][]) AS history "
    "FROM (SELECT conv_id, turn, prev_text AS instruction, text AS output FROM ("
    "SELECT *, lag(role) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_role, "
    "lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS prev_text FROM conversations) "
    "WHERE role = 'assistant' AND prev_role = 'user')"
)


def preference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """output = [chosen, rejected]: the reply, and the conversation's next reply (or the
    question itself when there is none); every 17th conversation has one element."""
    s = sft(spark, sf_dir)
    w = Window.partitionBy("conv_id").orderBy("turn")
    rejected = F.coalesce(F.lead("output").over(w), F.col("instruction"))
    return s.select(
        "conv_id",
        "turn",
        "instruction",
        "input",
        F.when(F.col("conv_id") % 17 == 0, F.array("output")).otherwise(F.array(F.col("output"), rejected)).alias(
            "output"
        ),
    )


PREFERENCE_SQL = (
    "SELECT conv_id, turn, instruction, input, (CASE WHEN conv_id % 17 = 0 THEN [output] ELSE "
    "[output, coalesce(lead(output) OVER (PARTITION BY conv_id ORDER BY turn), instruction)] END) AS output "
    "FROM (" + SFT_SQL + ")"
)


def sft_with_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SFT rows plus a second copy of every conversation with conv_id % 5 = 0; the
    copy comes later in input order (``idx``)."""
    s = sft(spark, sf_dir)
    base = F.col("conv_id") * 1000 + F.col("turn")
    copies = F.when(F.col("conv_id") % 5 == 0, F.array(base, F.lit(10_000_000_000) + base)).otherwise(F.array(base))
    return s.withColumn("idx", F.explode(copies))  # one pass over the SFT rows, no self-union


SFT_DUP_SQL = (
    "SELECT *, conv_id * 1000 + turn AS idx FROM (" + SFT_SQL + ") UNION ALL "
    "SELECT *, 10000000000 + conv_id * 1000 + turn AS idx FROM (" + SFT_SQL + ") WHERE conv_id % 5 = 0"
)

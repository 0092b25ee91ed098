"""Fixture views over the driver tables (see FIXTURES.md part 2).

Every fixture is plain SQL arithmetic on ids.  The column expressions below
are written once as SQL text that both Spark SQL and DuckDB accept, so the
Spark side (``F.expr``) and the DuckDB oracle (CTEs) build the same input.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.vocab import EMOTIONS, TECHNIQUES, VULNERABILITIES, the_form

TABLES = [
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem",
    "events", "documents", "embeddings", "pages", "benchmark", "labels", "conversations",
]

# Texts of the stored model responses, indexed by (d + s) % 7.
RESPONSE_TEXTS = ["Yes.", "No", "I cannot say", "No, but yes", "Unclear", "YES!", "Perhaps"]
MODELS = ["model_a", "model_b"]
SETTINGS = ["zeroshot", "fewshot"]
# Short phrase list of our own, taken from the fixture prose.
PHRASES = ["the", "of the", "in the", "and the", "de la", "le un", "der die", "que la", "thou", "is the"]


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def label_list_sql(labels: list[str], cond, sep: str = ",", form=lambda x: x) -> str:
    """``concat_ws(sep, CASE WHEN cond(j) THEN label_j END, ...)`` in vector order."""
    parts = [f"CASE WHEN {cond(j)} THEN {_q(form(lab))} END" for j, lab in enumerate(labels)]
    return f"concat_ws({_q(sep)}, " + ", ".join(parts) + ")"


MANIP = "CASE WHEN doc_id % 10 < 7 THEN '1' ELSE '0' END"
GOLD_TECH = (
    "CASE WHEN doc_id % 10 < 7 AND doc_id % 17 <> 3 THEN "
    + label_list_sql(TECHNIQUES, lambda j: f"((doc_id + 1) * {j + 2}) % 13 < 3")
    + " ELSE '' END"
)
GOLD_VUL = (
    "CASE WHEN doc_id % 10 < 7 AND doc_id % 19 <> 4 THEN "
    + label_list_sql(VULNERABILITIES, lambda j: f"((doc_id + 1) * {j + 2}) % 7 < 2")
    + " ELSE '' END"
)


# Some lists with a label's other spelling, some with a label that no vocabulary has.
DIRTY_TECH = (
    f"CASE WHEN doc_id % 3 = 0 THEN replace({GOLD_TECH}, 'Playing Victim Role', 'Playing the Victim Role') "
    f"WHEN doc_id % 7 = 1 THEN concat_ws(',', NULLIF({GOLD_TECH}, ''), 'Gaslighting') "
    f"WHEN doc_id % 7 = 2 THEN 'Gaslighting,Other' ELSE {GOLD_TECH} END"
)
# Annotation cells left blank.
BLANK_CELLS = {
    "manipulative_2": "CAST(id AS BIGINT) % 11 = 0", "confidence_1": "CAST(id AS BIGINT) % 6 = 0",
    "confidence_2": "CAST(id AS BIGINT) % 6 < 2", "confidence_3": "CAST(id AS BIGINT) % 12 = 0",
}


def _ann_manip(k: int) -> str:
    # gold manipulative flipped when d % (k+4) = 0
    return (
        f"CASE WHEN (doc_id % 10 < 7 AND doc_id % {k + 4} <> 0) "
        f"OR (doc_id % 10 >= 7 AND doc_id % {k + 4} = 0) THEN '1' ELSE '0' END"
    )


def _ann_cols(k: int) -> list[tuple[str, str]]:
    m = _ann_manip(k)
    tech = label_list_sql(TECHNIQUES, lambda j: f"((doc_id + 1) * {j + 2}) % 13 < 3 AND (doc_id + {j + k}) % 5 <> 0")
    vul = label_list_sql(VULNERABILITIES, lambda j: f"((doc_id + 1) * {j + 2}) % 7 < 2 AND (doc_id + {j + k}) % 5 <> 0")
    return [
        (f"annotator_{k}", f"concat('AN', CAST((doc_id + {k}) % 12 AS STRING))"),
        (f"manipulative_{k}", m),
        (f"technique_{k}", f"CASE WHEN {m} = '1' THEN {tech} ELSE '' END"),
        (f"victim_{k}", f"CASE WHEN {m} = '1' THEN CAST((doc_id + {k}) % 2 AS STRING) ELSE '' END"),
        (f"vulnerability_{k}", f"CASE WHEN {m} = '1' THEN {vul} ELSE '' END"),
        (f"marks_{k}", "''"),
        (f"confidence_{k}", f"CAST(1 + (doc_id * {k}) % 5 AS STRING)"),
    ]


ANNOTATION_COLS: list[tuple[str, str]] = [
    ("inner_id", "CAST(doc_id AS STRING)"),
    ("id", "CAST(doc_id AS STRING)"),
    ("dialogue", "text"),
    ("original movie dialogue", "''"),
    ("movie name", "source"),
    ("agreement", "''"),
] + [c for k in (1, 2, 3) for c in _ann_cols(k)]

RESPONSE_SQL = "CASE (doc_id + s) % 7 " + " ".join(
    f"WHEN {i} THEN {_q(t)}" for i, t in enumerate(RESPONSE_TEXTS)
) + " END"
MODEL_SQL = f"CASE WHEN s < 2 THEN {_q(MODELS[0])} ELSE {_q(MODELS[1])} END"
SETTING_SQL = f"CASE WHEN s % 2 = 0 THEN {_q(SETTINGS[0])} ELSE {_q(SETTINGS[1])} END"


def _label_response(labels: list[str]) -> str:
    lst = label_list_sql(labels, lambda j: f"((doc_id + 2) * {j + 2}) % 13 < 3", sep=", ", form=the_form)
    return f"COALESCE(NULLIF({lst}, ''), 'None of these')"


LABEL_RESPONSE_SQL = (
    f"CASE WHEN measure = 'technique' THEN {_label_response(TECHNIQUES)} "
    f"ELSE {_label_response(VULNERABILITIES)} END"
)
LOGIT_Y_SQL = (
    "CASE WHEN doc_id % 10 < 7 AND doc_id % 17 <> 3 AND ((doc_id + 1) * (j + 2)) % 13 < 3 THEN 1 ELSE 0 END"
)
LOGIT_SQL = "CAST(((doc_id + 2) * (j + 2)) % 13 - 6 AS DOUBLE) / CAST(3 AS DOUBLE)"
EMOTION_SCORE_SQL = "CAST(((doc_id + 1) * (j + 3)) % 17 AS DOUBLE) / CAST(17 AS DOUBLE)"
ROLE_TAG_SQL = (
    "CASE WHEN role = 'user' THEN 'Person1: ' WHEN role = 'assistant' THEN 'Person2: ' ELSE 'Person3: ' END"
)
TURN_LINE_SQL = f"concat({ROLE_TAG_SQL}, trim(replace(text, chr(10), ' ')))"


# ----------------------------------------------------------------------------
# Spark side
# ----------------------------------------------------------------------------


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _sel(df: DataFrame, cols: list[tuple[str, str]]) -> DataFrame:
    return df.select(*[F.expr(e).alias(n) for n, e in cols])


def fx_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return _sel(
        docs,
        [
            ("id", "CAST(doc_id AS STRING)"),
            ("doc_id", "doc_id"),
            ("dialogue", "text"),
            ("manipulative", MANIP),
            ("technique", GOLD_TECH),
            ("vulnerability", GOLD_VUL),
        ],
    )


def fx_annotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _sel(table(spark, sf_dir, "documents"), ANNOTATION_COLS)


def fx_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    conv = table(spark, sf_dir, "conversations")
    return conv.select(F.col("conv_id").cast("string").alias("id"), "turn", "role", "text")


def fx_dialogues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per conversation: tagged turns joined by newline in turn order."""
    conv = table(spark, sf_dir, "conversations")
    lines = conv.select("conv_id", "turn", F.expr(TURN_LINE_SQL).alias("line"))
    return lines.groupBy("conv_id").agg(
        F.array_join(
            F.transform(F.array_sort(F.collect_list(F.struct("turn", "line"))), lambda x: x["line"]), "\n"
        ).alias("dialogue")
    ).select(F.col("conv_id").cast("string").alias("id"), "dialogue")


def fx_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    x = docs.select("doc_id", F.explode(F.array(*[F.lit(i) for i in range(4)])).alias("s"))
    return _sel(
        x,
        [("id", "CAST(doc_id AS STRING)"), ("model", MODEL_SQL), ("setting", SETTING_SQL), ("response", RESPONSE_SQL)],
    )


def fx_label_responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    x = docs.select("doc_id", F.explode(F.array(F.lit("technique"), F.lit("vulnerability"))).alias("measure"))
    return _sel(x, [("id", "CAST(doc_id AS STRING)"), ("measure", "measure"), ("response", LABEL_RESPONSE_SQL)])


def fx_logits(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id")
    x = docs.select("doc_id", F.explode(F.sequence(F.lit(0), F.lit(len(TECHNIQUES) - 1))).alias("j"))
    return _sel(x, [("id", "CAST(doc_id AS STRING)"), ("j", "j"), ("y", LOGIT_Y_SQL), ("logit", LOGIT_SQL)])


def fx_emotions(spark: SparkSession, sf_dir: str, with_dataset: bool = False) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "lang")
    scores = F.array(
        *[
            F.struct(F.lit(e).alias("label"), F.expr(EMOTION_SCORE_SQL.replace("j + 3", f"{j} + 3")).alias("score"))
            for j, e in enumerate(EMOTIONS)
        ]
    )
    extra = [F.col("lang").alias("dataset")] if with_dataset else []
    return docs.select(
        *extra, F.col("doc_id").cast("string").alias("id"), F.expr(MANIP).alias("class"), scores.alias("scores")
    )


def fx_corpora(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return docs.select(F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("id"),
                       F.col("text").alias("dialogue"))


def fx_aux(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    labels = table(spark, sf_dir, "labels").select("doc_id", "toxic")
    return docs.join(labels, "doc_id").select(
        F.col("text").alias("Dialogue"), F.col("toxic").cast("string").alias("Hate Speech")
    )


def fx_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    emb = table(spark, sf_dir, "embeddings")
    return emb.select(
        F.col("vec_id").cast("string").alias("id"),
        F.expr("CASE WHEN label < 5 THEN '1' ELSE '0' END").alias("class"),
        "embedding",
    )


def fx_phrases(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(p,) for p in PHRASES], "phrase string")


# ----------------------------------------------------------------------------
# DuckDB side: the same views as CTE text for the oracle.
# ----------------------------------------------------------------------------


def _cols_sql(cols: list[tuple[str, str]]) -> str:
    return ", ".join(f'{e} AS "{n}"' for n, e in cols)


_EMO_ROWS = " UNION ALL ".join(f"SELECT {j} AS j, {_q(e)} AS label" for j, e in enumerate(EMOTIONS))

ORACLE_VIEWS: dict[str, str] = {
    "fx_gold": "SELECT CAST(doc_id AS VARCHAR) AS id, doc_id, text AS dialogue, "
    f"{MANIP} AS manipulative, {GOLD_TECH} AS technique, {GOLD_VUL} AS vulnerability FROM documents",
    "fx_annotations": f"SELECT {_cols_sql(ANNOTATION_COLS)} FROM documents",
    "fx_turns": "SELECT CAST(conv_id AS VARCHAR) AS id, turn, role, text FROM conversations",
    "fx_dialogues": f"SELECT CAST(conv_id AS VARCHAR) AS id, string_agg({TURN_LINE_SQL}, chr(10) ORDER BY turn) "
    "AS dialogue FROM conversations GROUP BY conv_id",
    "fx_responses": "SELECT CAST(doc_id AS VARCHAR) AS id, "
    f"{MODEL_SQL} AS model, {SETTING_SQL} AS setting, {RESPONSE_SQL} AS response "
    "FROM documents, (SELECT unnest([0, 1, 2, 3]) AS s) ss",
    "fx_label_responses": "SELECT CAST(doc_id AS VARCHAR) AS id, measure, "
    f"{LABEL_RESPONSE_SQL} AS response FROM documents, "
    "(SELECT unnest(['technique', 'vulnerability']) AS measure) mm",
    "fx_logits": f"SELECT CAST(doc_id AS VARCHAR) AS id, j, {LOGIT_Y_SQL} AS y, {LOGIT_SQL} AS logit "
    f"FROM documents, (SELECT unnest(range(0, {len(TECHNIQUES)})) AS j) jj",
    "fx_emotion_scores": f"SELECT lang AS dataset, CAST(doc_id AS VARCHAR) AS id, {MANIP} AS class, e.j, e.label, "
    f"{EMOTION_SCORE_SQL} AS score FROM documents, ({_EMO_ROWS}) e",
    "fx_corpora": "SELECT lang AS dataset, CAST(doc_id AS VARCHAR) AS id, text AS dialogue FROM documents",
    "fx_aux": 'SELECT d.text AS "Dialogue", CAST(l.toxic AS VARCHAR) AS "Hate Speech" '
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id",
    "fx_embeddings": "SELECT CAST(vec_id AS VARCHAR) AS id, CASE WHEN label < 5 THEN '1' ELSE '0' END AS class, "
    "embedding FROM embeddings",
    "fx_phrases": "SELECT * FROM (VALUES " + ", ".join(f"({_q(p)})" for p in PHRASES) + ") t(phrase)",
}


def with_views(sql: str, *names: str) -> str:
    """Prefix ``sql`` with the CTEs it needs, in dependency order."""
    ctes = [f"{n} AS ({ORACLE_VIEWS[n]})" for n in names]
    if not ctes:
        return sql
    if sql.lstrip().upper().startswith("WITH "):
        return "WITH " + ", ".join(ctes) + ", " + sql.lstrip()[5:]
    return "WITH " + ", ".join(ctes) + " " + sql

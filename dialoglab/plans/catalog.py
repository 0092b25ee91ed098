"""Registered queries: one per operator of the inventory.

Each query takes ``(spark, sf_dir)``, reads the driver tables (through the
fixture views), runs one operator of the library and returns a DataFrame
whose columns match the oracle SQL of :mod:`dialoglab.plans.oracle`.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import labels as L
from ..functions import subwords as SW
from ..functions import text as T
from ..operators import annotators as G
from ..operators import evaluation as E
from ..operators import joins as J
from ..operators import neighbours as N
from ..operators import phrases as PH
from ..operators import prompts as B
from ..operators import reliability as Q
from ..operators import sampling as R
from ..operators import scoring as M
from ..operators import stats as A
from ..sources import readers as S
from ..sources import writers as W
from ..streaming import turns as TU
from . import fixtures as fx

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}


def query(name: str):
    def deco(fn: Query) -> Query:
        QUERIES[name] = fn
        return fn

    return deco


# ---------------------------------------------------------------------------
# shared building blocks
# ---------------------------------------------------------------------------


def gold_split(spark: SparkSession, sf: str) -> DataFrame:
    """fx_gold (without the text) tagged with the R1 split (seed 17, .6/.2/.2)."""
    gold = fx.fx_gold(spark, sf).drop("dialogue")
    return R.split_exact(gold, (0.6, 0.2, 0.2), seed=17)


def binary_predictions(spark: SparkSession, sf: str) -> DataFrame:
    """J1 on the test split: gold label joined with parsed stored responses."""
    test = gold_split(spark, sf).filter(F.col("split") == "test").select(
        "id", L.binarize_label("manipulative", "one").alias("y")
    )
    resp = fx.fx_responses(spark, sf).select("id", "model", "setting", L.parse_yes_no("response").alias("p"))
    return J.join_predictions(test, resp).select("id", "model", "setting", "y", "p")


# ---------------------------------------------------------------------------
# R: splits and samples
# ---------------------------------------------------------------------------


@query("split_exact")
def q_split_exact(spark, sf):
    return gold_split(spark, sf).select("id", "split")


# ---------------------------------------------------------------------------
# P: scalars
# ---------------------------------------------------------------------------


@query("parse_yes_no")
def q_parse_yes_no(spark, sf):
    r = fx.fx_responses(spark, sf)
    return r.select("id", "model", "setting", L.parse_yes_no("response", "substring").alias("pred"))


# ---------------------------------------------------------------------------
# J / E: joins and evaluation
# ---------------------------------------------------------------------------


@query("join_predictions")
def q_join_predictions(spark, sf):
    return binary_predictions(spark, sf)


@query("unanswered")
def q_unanswered(spark, sf):
    test = gold_split(spark, sf).filter(F.col("split") == "test").select("id")
    resp = fx.fx_responses(spark, sf).select("id", "model", "setting")
    return J.unanswered(test, resp)


@query("response_quality")
def q_response_quality(spark, sf):
    return E.response_quality(binary_predictions(spark, sf))


@query("confusion_binary")
def q_confusion_binary(spark, sf):
    return E.confusion_binary(binary_predictions(spark, sf))


@query("binary_metrics")
def q_binary_metrics(spark, sf):
    return E.binary_metrics(binary_predictions(spark, sf))


@query("leaderboard")
def q_leaderboard(spark, sf):
    return E.leaderboard(binary_predictions(spark, sf))


# ---------------------------------------------------------------------------
# S: sources and sinks (fixture written to the shared scratch folder, read back)
# ---------------------------------------------------------------------------


@query("read_labelled_csv")
def q_read_labelled_csv(spark, sf):
    gold = fx.fx_gold(spark, sf)
    src = gold.select(*[F.col(a).alias(b) for a, b in zip(
        ["id", "dialogue", "manipulative", "technique", "vulnerability"], S.LABELLED_COLUMNS)])
    path = W.write_csv(src, W.new_path(src, "labelled"))
    return S.read_labelled_csv(spark, path)


def numbered_file(df: DataFrame, order: str, name: str) -> str:
    """A CSV whose records stand in the order of an id."""
    return W.write_csv(df.orderBy(F.col(order).cast("bigint")), W.new_path(df, name))


@query("read_labelled_csv_split")
def q_read_labelled_csv_split(spark, sf):
    """Read by ranges, with each record's place in the files."""
    src = fx.fx_gold(spark, sf).select(*[F.col(a).alias(b) for a, b in zip(
        ["id", "dialogue", "manipulative", "technique", "vulnerability"], S.LABELLED_COLUMNS)])
    return S.read_labelled_csv(spark, numbered_file(src, "ID", "labelled"), multi_line="split", number="line_no")


@query("align_by_position")
def q_align_by_position(spark, sf):
    """Gold labels and answers from two files, paired by their places in them."""
    gold = fx.fx_gold(spark, sf).select("id", "dialogue", "manipulative")
    answers = fx.fx_responses(spark, sf).filter("model = 'model_a' AND setting = 'zeroshot'").select(F.col("id").alias("r_id"), "response")
    left = S.read_labelled_csv(spark, numbered_file(gold, "id", "gold"), multi_line="split", number="line_no")
    right = S.read_labelled_csv(spark, numbered_file(answers, "r_id", "answers"), multi_line="split", number="line_no")
    both = J.align_by_position(left.drop("dialogue"), right)
    return both.select("line_no", "id", L.binarize_label("manipulative", "one").alias("y"), L.parse_yes_no("response").alias("p"))


@query("read_annotations")
def q_read_annotations(spark, sf):
    ann = fx.fx_annotations(spark, sf)
    path = W.write_csv(ann, W.new_path(ann, "annotations"))
    return S.read_annotations(spark, path)


@query("read_thread_jsonl")
def q_read_thread_jsonl(spark, sf):
    conv = fx.table(spark, sf, "conversations")
    path = W.write_threads(conv, W.new_path(conv, "threads"), "conv_id", "turn", "text")
    return S.read_thread_jsonl(spark, path)


@query("read_turn_table")
def q_read_turn_table(spark, sf):
    conv = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("Number"), F.col("turn").cast("string").alias("Turn"),
        F.col("text").alias("utterance"))
    path = W.write_csv(conv, W.new_path(conv, "turns"), sep="\t")
    return S.read_turn_table(spark, path)


@query("stream_dialogues")
def q_stream_dialogues(spark, sf):
    # a conversation's turns come within minutes; files hold them in any order
    began = F.pmod("conv_id", F.lit(1800)) + F.col("turn")
    turns = fx.table(spark, sf, "conversations").select(
        F.col("conv_id").cast("string").alias("id"), "turn", "text", F.timestamp_seconds(F.lit(1_600_000_000) + began).alias("at"))
    folder = W.new_path(turns, "arriving")
    turns.repartition(4, "turn").write.parquet(f"{folder}/part=0")
    TU.heartbeat(spark, "2020-12-31 00:00:00").write.parquet(f"{folder}/part=1")
    target = W.new_path(turns, "closed")
    TU.start_dialogue_stream(spark, f"{folder}/*", target, W.new_path(turns, "stream"), silence="1 hour", late="2 hours",
                             max_files_per_trigger=2).awaitTermination()
    return TU.closed_dialogues(spark, target).select("id", "dialogue")


@query("read_text_column_csv")
def q_read_text_column_csv(spark, sf):
    dia = fx.fx_dialogues(spark, sf)
    path = W.write_csv(dia, W.new_path(dia, "textcol"))
    return S.read_text_column_csv(spark, path, index=1, skip_header=True)


def corpora(spark, sf) -> DataFrame:
    """Corpora of different kinds side by side: documents, and conversations put together from their turns."""
    conv = fx.table(spark, sf, "conversations")
    return S.union_corpora({
        "documents": fx.fx_corpora(spark, sf),
        "dialogues": fx.fx_dialogues(spark, sf),
        "turns": S.assemble_dialogues(conv, "conv_id", "turn", "text").withColumn("id", F.col("id").cast("string")),
    }, qualify=True)


@query("union_corpora")
def q_union_corpora(spark, sf):
    return corpora(spark, sf)


@query("write_results")
def q_write_results(spark, sf):
    stats = A.token_stats(fx.fx_corpora(spark, sf))
    path = W.write_results(stats, W.new_path(stats, "token_stats"), "json", "dataset")
    return spark.read.json(path).select("dataset", "mean")


# ---------------------------------------------------------------------------
# P: scalars on dialogue text and labels
# ---------------------------------------------------------------------------


@query("normalize_speakers")
def q_normalize_speakers(spark, sf):
    tagged = fx.fx_dialogues(spark, sf).select(F.concat(F.lit("c"), "id").alias("id"), "dialogue")
    plain = fx.fx_corpora(spark, sf).select(F.concat(F.lit("d"), "id").alias("id"), "dialogue")
    return tagged.unionByName(plain).select("id", T.normalize_speakers("dialogue").alias("text"))


@query("strip_speakers")
def q_strip_speakers(spark, sf):
    return fx.fx_dialogues(spark, sf).select("id", T.strip_speakers("dialogue", "person").alias("text"))


@query("parse_turns")
def q_parse_turns(spark, sf):
    t = T.parse_turns(fx.fx_dialogues(spark, sf))
    return t.withColumn("turn", F.col("turn").cast("bigint"))


@query("count_tokens")
def q_count_tokens(spark, sf):
    c = fx.fx_corpora(spark, sf)
    return c.select("id", T.count_tokens(T.strip_speakers("dialogue", "person")).alias("n_tokens"))


@query("count_tokens_treebank")
def q_count_tokens_treebank(spark, sf):
    dia = fx.fx_dialogues(spark, sf)
    return dia.select("id", T.count_tokens(T.strip_speakers("dialogue", "person"), rule="treebank").alias("n_tokens"))


@query("token_stats_treebank")
def q_token_stats_treebank(spark, sf):
    return A.token_stats(fx.fx_corpora(spark, sf), rule="treebank")


@query("truncate_tokens")
def q_truncate_tokens(spark, sf):
    c = fx.fx_corpora(spark, sf)
    return c.select("id", T.truncate_tokens("dialogue", 500, "first").alias("text"))


@query("truncate_tokens_last")
def q_truncate_tokens_last(spark, sf):
    c = fx.fx_corpora(spark, sf)
    return c.select("id", T.truncate_tokens("dialogue", 4096, "last").alias("text"))


def _model_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


@query("truncate_pieces")
def q_truncate_pieces(spark, sf):
    pieces = SW.vocabulary_of(_model_file())
    c = fx.fx_corpora(spark, sf)
    return c.select("id", SW.truncate_pieces("dialogue", pieces, 500).alias("text"), SW.count_pieces("dialogue", pieces).alias("n_pieces"))


@query("truncate_model_tokens")
def q_truncate_model_tokens(spark, sf):
    c = fx.fx_corpora(spark, sf)
    return c.select("id", SW.truncate_model_tokens("dialogue", _model_file(), 500, "last").alias("text"))


@query("binarize_label")
def q_binarize_label(spark, sf):
    return fx.fx_gold(spark, sf).select("id", L.binarize_label("manipulative", "one").alias("label"))


@query("resolve_label_column")
def q_resolve_label_column(spark, sf):
    return L.resolve_label_column(fx.fx_aux(spark, sf), "train")


@query("filter_measured")
def q_filter_measured(spark, sf):
    g = L.filter_measured(fx.fx_gold(spark, sf), "technique")
    return g.select("id", "dialogue", "manipulative", "technique", "vulnerability")


@query("canonicalize_labels")
def q_canonicalize_labels(spark, sf):
    g = fx.fx_gold(spark, sf)
    return g.select("id", F.array_join(L.canonicalize_labels(L.split_labels("technique"), "the"), ",").alias("labels"))


@query("multi_hot")
def q_multi_hot(spark, sf):
    g = fx.fx_gold(spark, sf)
    return g.select("id", L.bits_string(L.multi_hot(L.split_labels("technique"), "technique")).alias("bits"))


@query("parse_label_list")
def q_parse_label_list(spark, sf):
    r = fx.fx_label_responses(spark, sf)
    tech = F.array_join(L.parse_label_list("response", "technique"), ",")
    vul = F.array_join(L.parse_label_list("response", "vulnerability"), ",")
    return r.select("id", "measure", F.when(F.col("measure") == "technique", tech).otherwise(vul).alias("labels"))


@query("threshold_scores")
def q_threshold_scores(spark, sf):
    lg = fx.fx_logits(spark, sf)
    arr = lg.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("j", "logit"))).alias("s"))
    logits = F.transform(F.col("s"), lambda x: x["logit"])
    return arr.select("id", L.bits_string(L.threshold_scores(logits, 0.5)).alias("bits"))


@query("top_emotion")
def q_top_emotion(spark, sf):
    return fx.fx_emotions(spark, sf).select("id", L.top_emotion(F.col("scores")).alias("emotion"))


# ---------------------------------------------------------------------------
# A: statistics
# ---------------------------------------------------------------------------


def gold_with_lang(spark, sf) -> DataFrame:
    docs = fx.table(spark, sf, "documents")
    g = docs.select(F.col("lang").alias("dataset"), F.col("doc_id").cast("string").alias("id"),
                    F.expr(fx.MANIP).alias("manipulative"), F.expr(fx.GOLD_TECH).alias("technique"))
    return g


@query("dataset_summary")
def q_dataset_summary(spark, sf):
    g = R.split_exact(gold_with_lang(spark, sf), (0.6, 0.2, 0.2), seed=17)
    return A.dataset_summary(g, ("dataset", "split"))


@query("label_counts")
def q_label_counts(spark, sf):
    return A.label_counts(fx.fx_gold(spark, sf), "technique")


@query("label_cooccurrence")
def q_label_cooccurrence(spark, sf):
    return A.label_cooccurrence(fx.fx_gold(spark, sf), "technique", "technique")


@query("label_cross_cooccurrence")
def q_label_cross_cooccurrence(spark, sf):
    return A.label_cross_cooccurrence(fx.fx_gold(spark, sf))


@query("token_stats")
def q_token_stats(spark, sf):
    return A.token_stats(fx.fx_corpora(spark, sf))


@query("turn_stats")
def q_turn_stats(spark, sf):
    return A.turn_stats(fx.fx_corpora(spark, sf))


@query("ccdf")
def q_ccdf(spark, sf):
    return A.ccdf(fx.fx_corpora(spark, sf), T.count_lines("dialogue"), "dataset")


@query("emotion_distribution")
def q_emotion_distribution(spark, sf):
    e = fx.fx_emotions(spark, sf).select(L.top_emotion(F.col("scores")).alias("emotion"), "class")
    return A.emotion_distribution(e)


@query("emotion_counts")
def q_emotion_counts(spark, sf):
    e = fx.fx_emotions(spark, sf, with_dataset=True).select("dataset", L.top_emotion(F.col("scores")).alias("emotion"))
    return A.emotion_counts(e, "dataset")


@query("split_label_share")
def q_split_label_share(spark, sf):
    return A.split_label_share(gold_split(spark, sf))


@query("compare_datasets")
def q_compare_datasets(spark, sf):
    g = gold_with_lang(spark, sf)
    return A.compare_datasets(g, "technique")


# ---------------------------------------------------------------------------
# G: gold labels from annotators
# ---------------------------------------------------------------------------


@query("unpivot_annotators")
def q_unpivot_annotators(spark, sf):
    return G.unpivot_annotators(fx.fx_annotations(spark, sf))


@query("gold_consensus")
def q_gold_consensus(spark, sf):
    return G.gold_labels(fx.fx_annotations(spark, sf), "consensus")


@query("gold_majority")
def q_gold_majority(spark, sf):
    return G.gold_labels(fx.fx_annotations(spark, sf), "majority")


@query("vote_labels")
def q_vote_labels(spark, sf):
    return G.vote_labels(fx.fx_annotations(spark, sf), "technique", 2)


@query("annotator_agreement")
def q_annotator_agreement(spark, sf):
    return G.annotator_agreement(fx.fx_annotations(spark, sf))


@query("annotator_alpha")
def q_annotator_alpha(spark, sf):
    """Chance-corrected agreement on the binary label, blank votes left out."""
    ann = fx.fx_annotations(spark, sf)
    blank = {c: F.when(F.expr(cond), F.lit("")).otherwise(F.col(c)) for c, cond in fx.BLANK_CELLS.items() if c.startswith("manipulative")}
    return Q.alpha(ann.withColumns(blank))


@query("annotator_reliability")
def q_annotator_reliability(spark, sf):
    return Q.annotator_reliability(fx.fx_annotations(spark, sf), rounds=20)


# ---------------------------------------------------------------------------
# R: samples
# ---------------------------------------------------------------------------


@query("sample_cap")
def q_sample_cap(spark, sf):
    return R.sample_cap(fx.fx_corpora(spark, sf).select("id"), n=5000, seed=42)


@query("holdout")
def q_holdout(spark, sf):
    return R.holdout(fx.fx_corpora(spark, sf).select("id"), 0.2, seed=42)


@query("balance_classes")
def q_balance_classes(spark, sf):
    g = fx.fx_gold(spark, sf).select("id", "manipulative")
    return R.balance_classes(g, "manipulative", seed=0)


@query("sample_per_group")
def q_sample_per_group(spark, sf):
    return R.sample_per_group(fx.fx_corpora(spark, sf).select("id", "dataset"), "dataset", n=500, seed=11)


def pick_examples(gold: DataFrame, label_col: str | None, k, measure_filter: str | None = None) -> DataFrame:
    """R6 on the train split of ``gold`` (seed 17 split, seed 0 examples), text included.

    Cuts are found on the ids; rows are compared with them where they are, and only
    the ``sum(k)`` chosen ones move, so no dialogue text goes through a shuffle.
    """
    rows = L.filter_measured(gold, measure_filter) if measure_filter else gold
    train = R.split_exact(rows, seed=17, tie_cols=()).filter(F.col("split") == "train").drop("split")
    return R.select_examples(train, label_col, k, seed=0, tie_cols=())


def train_examples(spark, sf) -> DataFrame:
    """2 positives and 1 negative from the train split."""
    return pick_examples(fx.fx_gold(spark, sf), "manipulative", {"1": 2, "0": 1})


@query("select_examples")
def q_select_examples(spark, sf):
    return train_examples(spark, sf).select("id", "manipulative", F.col("example_no").cast("bigint"))


# ---------------------------------------------------------------------------
# B / J2: prompts and training text
# ---------------------------------------------------------------------------


def test_rows(spark, sf) -> DataFrame:
    # document ids are unique, so the cuts read nothing but ids
    return R.split_exact(fx.fx_gold(spark, sf), seed=17, tie_cols=()).filter(F.col("split") == "test")


@query("zeroshot_messages")
def q_zeroshot_messages(spark, sf):
    return B.zeroshot_messages(test_rows(spark, sf), "binary")


@query("zeroshot_messages_technique")
def q_zeroshot_messages_technique(spark, sf):
    return B.zeroshot_messages(test_rows(spark, sf), "technique")


@query("zeroshot_messages_vulnerability")
def q_zeroshot_messages_vulnerability(spark, sf):
    return B.zeroshot_messages(test_rows(spark, sf), "vulnerability")


def fewshot_measure(spark, sf, measure: str) -> DataFrame:
    """B2 for a label measure: rows with labels, split, 3 train examples of any class."""
    gold = fx.fx_gold(spark, sf)
    split = R.split_exact(L.filter_measured(gold, measure), seed=17, tie_cols=())
    examples = pick_examples(gold, None, 3, measure_filter=measure)
    return B.fewshot_messages(split.filter(F.col("split") == "test"), examples, measure)


@query("fewshot_messages_technique")
def q_fewshot_messages_technique(spark, sf):
    return fewshot_measure(spark, sf, "technique")


@query("fewshot_messages_vulnerability")
def q_fewshot_messages_vulnerability(spark, sf):
    return fewshot_measure(spark, sf, "vulnerability")


@query("fewshot_messages")
def q_fewshot_messages(spark, sf):
    return B.fewshot_messages(test_rows(spark, sf), train_examples(spark, sf), "binary")


@query("attach_examples")
def q_attach_examples(spark, sf):
    return B.attach_examples(test_rows(spark, sf), train_examples(spark, sf))


@query("sft_text_binary")
def q_sft_text_binary(spark, sf):
    return B.sft_text(fx.fx_gold(spark, sf), "dialogue", "manipulative")


@query("sft_text_by_label_column")
def q_sft_text_by_label_column(spark, sf):
    """Corpora with other label columns: each names its own question."""
    docs = fx.table(spark, sf, "documents").select("doc_id", F.col("text").alias("dialogue"))
    rows = docs.join(fx.table(spark, sf, "labels").select("doc_id", F.col("toxic").cast("string").alias("y")), "doc_id")
    rows = rows.withColumn("id", F.col("doc_id").cast("string"))
    out = None
    for column in ("Hate Speech", "Stress", "Suicide"):
        part = B.sft_text(rows.withColumnRenamed("y", column), "dialogue", column).withColumn("label_column", F.lit(column))
        out = part if out is None else out.unionByName(part)
    return out


@query("sft_text_multilabel")
def q_sft_text_multilabel(spark, sf):
    g = L.filter_measured(fx.fx_gold(spark, sf), "technique")
    return B.sft_text_multilabel(g, "technique")


@query("classifier_table")
def q_classifier_table(spark, sf):
    return B.classifier_table(fx.fx_aux(spark, sf), "binary")


# ---------------------------------------------------------------------------
# M: scoring and models
# ---------------------------------------------------------------------------


@query("batch_score")
def q_batch_score(spark, sf):
    return M.batch_score(test_rows(spark, sf), M.keyword_stub(("the ", "que ")), "dialogue", "response")


@query("train_binary")
def q_train_binary(spark, sf):
    g = R.split_exact(fx.fx_gold(spark, sf), seed=17, tie_cols=()).select(
        "id", F.col("dialogue").alias("text"), L.binarize_label("manipulative").alias("label"), "split")
    return M.train_binary(g)


@query("train_epochs")
def q_train_epochs(spark, sf):
    """Every epoch of every run of the binary training, scored on the validation rows."""
    g = R.split_exact(fx.fx_gold(spark, sf), seed=17, tie_cols=()).select(
        "id", F.col("dialogue").alias("text"), L.binarize_label("manipulative").alias("label"), "split")
    return M.train_epochs(g, max_iter=8)


@query("best_training_run")
def q_best_training_run(spark, sf):
    return M.best_run(q_train_epochs(spark, sf))


@query("train_multilabel")
def q_train_multilabel(spark, sf):
    g = L.filter_measured(fx.fx_gold(spark, sf), "technique")
    g = R.split_exact(g, seed=17, tie_cols=()).select(
        "id", F.col("dialogue").alias("text"), L.multi_hot(L.split_labels("technique"), "technique").alias("labels"),
        "split")
    return M.train_multilabel(g, "technique")


def fold_metrics(spark, sf) -> DataFrame:
    """Micro-F1 of every (model/setting, fold) on the test split - a run x epoch table from data."""
    bp = binary_predictions(spark, sf).select(
        F.concat_ws("/", "model", "setting").alias("run"),
        (F.pmod(F.col("id").cast("bigint"), F.lit(5)) + 1).cast("bigint").alias("epoch"), "y", "p")
    return E.binary_metrics(bp, ("run", "epoch")).select("run", "epoch", F.col("micro_f1").alias("f1"))


@query("best_run")
def q_best_run(spark, sf):
    return M.best_run(fold_metrics(spark, sf))


@query("standardize_embeddings")
def q_standardize_embeddings(spark, sf):
    return M.standardize(fx.fx_embeddings(spark, sf), "class")


@query("project_2d")
def q_project_2d(spark, sf):
    return M.project_2d(fx.fx_embeddings(spark, sf), "class")


@query("project_neighbours")
def q_project_neighbours(spark, sf):
    return N.project_neighbours(fx.fx_embeddings(spark, sf), "class")


# ---------------------------------------------------------------------------
# Multi-label evaluation
# ---------------------------------------------------------------------------


def multilabel_predictions(spark, sf, measure: str = "technique") -> DataFrame:
    """Gold label vectors (non-empty lists) joined with parsed stored label answers."""
    g = L.filter_measured(fx.fx_gold(spark, sf), measure).select(
        "id", L.multi_hot(L.split_labels(measure), measure).alias("y"))
    r = fx.fx_label_responses(spark, sf).filter(F.col("measure") == measure).select(
        "id", L.multi_hot(L.parse_label_list("response", measure), measure).alias("p"))
    return g.join(r, "id")


def _register_multilabel(measure: str, suffix: str) -> None:
    QUERIES[f"confusion_multilabel{suffix}"] = lambda spark, sf: E.confusion_multilabel(
        multilabel_predictions(spark, sf, measure), measure)
    QUERIES[f"multilabel_metrics{suffix}"] = lambda spark, sf: E.multilabel_metrics(
        multilabel_predictions(spark, sf, measure), measure)
    QUERIES[f"per_label_metrics{suffix}"] = lambda spark, sf: E.per_label_metrics(
        multilabel_predictions(spark, sf, measure), measure)


_register_multilabel("technique", "")
_register_multilabel("vulnerability", "_vulnerability")


@query("pooled_auc")
def q_pooled_auc(spark, sf):
    lg = fx.fx_logits(spark, sf).select("y", F.col("logit").alias("score"))
    return E.pooled_auc(lg, "thresholded").unionByName(E.pooled_auc(lg, "score"))


# ---------------------------------------------------------------------------
# Key phrases
# ---------------------------------------------------------------------------


@query("match_key_phrases")
def q_match_key_phrases(spark, sf):
    return PH.match_key_phrases(fx.fx_corpora(spark, sf), fx.fx_phrases(spark))


@query("match_key_phrases_automaton")
def q_match_key_phrases_automaton(spark, sf):
    """Every pair of neighbouring words that some dialogue begins with is a phrase: a list that grows with the data."""
    c = fx.fx_corpora(spark, sf)
    own = c.select(PH.first_words("dialogue", 2).alias("phrase")).distinct()
    hits = PH.automaton_phrases(c, own, "dialogue", "id", "phrase", lemmas=False)
    return hits.groupBy("phrase").agg(F.count(F.lit(1)).alias("n_dialogues"))


@query("match_key_phrases_lemmas")
def q_match_key_phrases_lemmas(spark, sf):
    """Base forms: a word that ends in -s, -ed or -ing stands for its base form."""
    return PH.match_key_phrases(fx.fx_corpora(spark, sf), fx.fx_phrases(spark), lemmas=True)


# ---------------------------------------------------------------------------
# input that is not clean, and the other settings of operators
# ---------------------------------------------------------------------------


def fx_dirty(spark, sf) -> DataFrame:
    """Gold lists in which some labels have their other spelling and some are in no vocabulary."""
    docs = fx.table(spark, sf, "documents")
    return docs.select(F.col("doc_id").cast("string").alias("id"), F.expr(fx.DIRTY_TECH).alias("technique"),
                       F.expr(fx.GOLD_VUL).alias("vulnerability"))


@query("label_cooccurrence_dirty")
def q_label_cooccurrence_dirty(spark, sf):
    return A.label_cooccurrence(fx_dirty(spark, sf), "technique", "technique")


@query("label_cross_cooccurrence_dirty")
def q_label_cross_cooccurrence_dirty(spark, sf):
    return A.label_cross_cooccurrence(fx_dirty(spark, sf))


@query("unknown_label_counts")
def q_unknown_label_counts(spark, sf):
    return A.unknown_label_counts(fx_dirty(spark, sf), "technique", "technique")


@query("annotator_agreement_blank")
def q_annotator_agreement_blank(spark, sf):
    ann = fx.fx_annotations(spark, sf)
    blank = {c: F.when(F.expr(cond), F.lit("")).otherwise(F.col(c)) for c, cond in fx.BLANK_CELLS.items()}
    return G.annotator_agreement(ann.withColumns(blank))


@query("unpivot_annotators_blank")
def q_unpivot_annotators_blank(spark, sf):
    ann = fx.fx_annotations(spark, sf)
    blank = {c: F.when(F.expr(cond), F.lit("")).otherwise(F.col(c)) for c, cond in fx.BLANK_CELLS.items()}
    return G.unpivot_annotators(ann.withColumns(blank)).select("id", "annotator_no", "manipulative", "confidence")


@query("unanswered_no_gold")
def q_unanswered_no_gold(spark, sf):
    """One more model that answers nothing but unknown ids, and one without a name."""
    test = gold_split(spark, sf).filter(F.col("split") == "test").select("id")
    resp = fx.fx_responses(spark, sf).select("id", "model", "setting")
    stray = resp.filter("setting = 'zeroshot'").select(F.concat(F.lit("x"), "id").alias("id"), F.lit("model_c").alias("model"), "setting")
    unnamed = resp.filter("model = 'model_a'").withColumn("model", F.lit(None).cast("string"))
    return J.unanswered(test, resp.unionByName(stray).unionByName(unnamed))


@query("match_key_phrases_repeated")
def q_match_key_phrases_repeated(spark, sf):
    p = fx.fx_phrases(spark)
    more = p.filter("phrase <> 'thou'").select(F.upper("phrase").alias("phrase"))
    return PH.match_key_phrases(fx.fx_corpora(spark, sf), p.unionByName(p).unionByName(more))


@query("split_threads")
def q_split_threads(spark, sf):
    """Threads without an id in the file, split: every record is in one of the parts."""
    conv = fx.table(spark, sf, "conversations")
    path = W.write_threads(conv, W.new_path(conv, "threads"), "conv_id", "turn", "text", with_id=False)
    return R.split_exact(S.read_thread_jsonl(spark, path)).groupBy("split").agg(F.count(F.lit(1)).alias("n"))


@query("sample_corpora")
def q_sample_corpora(spark, sf):
    """S3 + S5 + S4 side by side, at most 60 of each."""
    conv, dia = fx.table(spark, sf, "conversations"), fx.fx_dialogues(spark, sf)
    threads = S.read_thread_jsonl(spark, W.write_threads(conv, W.new_path(conv, "threads"), "conv_id", "turn", "text", False))
    texts = S.read_text_column_csv(spark, W.write_csv(dia, W.new_path(dia, "textcol")), index=1, skip_header=True)
    turns = S.assemble_dialogues(conv, "conv_id", "turn", "text")
    both = S.union_corpora({"threads": threads, "texts": texts, "turns": turns}, qualify=True)
    return R.sample_per_group(both, "dataset", n=60).groupBy("dataset").agg(
        F.count(F.lit(1)).alias("n"), F.count_distinct("id").alias("n_ids"))


@query("split_null_ids")
def q_split_null_ids(spark, sf):
    """Ids that are NULL or repeated, classes that are NULL: sizes still add up."""
    docs = fx.table(spark, sf, "documents").select(
        F.expr("CASE WHEN doc_id % 5 = 0 THEN NULL ELSE CAST(doc_id % 50 AS STRING) END").alias("id"), "doc_id",
        F.expr("CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END").alias("class"))
    parts = R.split_exact(docs).select(F.lit("split").alias("what"), F.col("split").alias("name"))
    per = R.sample_per_group(docs, "class", n=20).select(F.lit("per class").alias("what"), F.col("class").alias("name"))
    even = R.balance_classes(docs, "class").select(F.lit("balanced").alias("what"), F.col("class").alias("name"))
    some = R.select_examples(docs, "class", 2).select(F.lit("examples").alias("what"), F.col("class").alias("name"))
    return parts.unionByName(per).unionByName(even).unionByName(some).groupBy("what", "name").agg(F.count(F.lit(1)).alias("n"))


@query("token_stats_by_corpus")
def q_token_stats_by_corpus(spark, sf):
    return A.token_stats(corpora(spark, sf), tags={"dialogues": "person", "turns": "turn"})


@query("turn_stats_by_corpus")
def q_turn_stats_by_corpus(spark, sf):
    return A.turn_stats(corpora(spark, sf), constant={"turns": 2})


@query("ccdf_buckets")
def q_ccdf_buckets(spark, sf):
    return A.ccdf(fx.fx_corpora(spark, sf), T.count_lines("dialogue"), "dataset", method="buckets")


@query("pooled_auc_by_class")
def q_pooled_auc_by_class(spark, sf):
    lg = fx.fx_logits(spark, sf).select(F.expr("CASE WHEN j % 3 = 0 THEN NULL ELSE CAST(j % 3 AS STRING) END").alias("part"),
                                        "y", F.col("logit").alias("score"))
    return E.pooled_auc(lg, "score", by="part").select("part", "auc")


@query("label_variants")
def q_label_variants(spark, sf):
    """P6 and P10-P13 in their other forms."""
    g = fx.fx_gold(spark, sf).select("id", "manipulative", "technique", "vulnerability")
    r = fx.fx_responses(spark, sf).filter("model = 'model_a' AND setting = 'zeroshot'").select(F.col("id").alias("r_id"), "response")
    j = g.join(r, F.col("id") == F.col("r_id"))
    return j.select(
        "id", L.binarize_label("manipulative", "not_zero").alias("not_zero"), L.binarize_label("manipulative", "cast").alias("as_int"),
        L.bits_string(L.multi_hot(L.split_labels("technique"), "technique", "strict")).alias("strict_bits"),
        L.bits_string(L.multi_hot(L.split_labels("vulnerability"), "vulnerability")).alias("vulnerability_bits"),
        L.parse_yes_no("response", "prefix_first").alias("prefix_first"))


@query("argmax_label")
def q_argmax_label(spark, sf):
    lg = fx.fx_logits(spark, sf).groupBy("id").agg(F.array_sort(F.collect_list(F.struct("j", "logit"))).alias("s"))
    return lg.select("id", L.argmax_label(F.transform("s", lambda x: x["logit"])).alias("label"))


@query("label_counts_vulnerability")
def q_label_counts_vulnerability(spark, sf):
    return A.label_counts(fx.fx_gold(spark, sf), "vulnerability")


@query("label_cooccurrence_vulnerability")
def q_label_cooccurrence_vulnerability(spark, sf):
    return A.label_cooccurrence(fx.fx_gold(spark, sf), "vulnerability", "vulnerability")


@query("leaderboard_multilabel")
def q_leaderboard_multilabel(spark, sf):
    p = multilabel_predictions(spark, sf).withColumn("train_data", F.lit("own")).withColumn(
        "model", F.when(F.pmod(F.col("id").cast("bigint"), F.lit(2)) == 0, "a").otherwise("b"))
    return E.leaderboard_multilabel(p, "technique")


@query("evaluate_prompts")
def q_evaluate_prompts(spark, sf):
    """The whole chain: dialogue cut to the model's length, messages, answers of the stub, parsed, joined, scored."""
    test = test_rows(spark, sf)
    cut = test.select("id", T.truncate_tokens("dialogue", 4096, "last").alias("dialogue"))
    messages = B.zeroshot_messages(cut, "binary")
    answers = M.batch_score(messages, M.keyword_stub(("que ", " und ")), "messages", "response")
    p = answers.select("id", L.parse_yes_no("response").alias("p"), F.lit("stub").alias("model"), F.lit("zeroshot").alias("setting"))
    gold = test.select("id", L.binarize_label("manipulative", "one").alias("y"))
    return E.binary_metrics(J.join_predictions(gold, p))

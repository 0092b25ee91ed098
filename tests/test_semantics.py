"""Hand-computed cases for the semantics contract (parsing, aliases, metrics, ties, CSV)."""

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from dialoglab.functions import labels as L
from dialoglab.functions import text as T
from dialoglab.operators import evaluation as E
from dialoglab.operators import scoring as M
from dialoglab.operators import stats as A
from dialoglab.sources import readers as S
from dialoglab.sources import writers as W


def one_col(spark, values, name="x", dtype="string"):
    return spark.createDataFrame([(v,) for v in values], f"{name} {dtype}")


# --- P11 -------------------------------------------------------------------------

YES_NO = [
    # text, substring, prefix_first
    ("Yes.", 1, 1),
    ("No", 0, 0),
    ("I cannot say", 0, 0),  # 'cannot' contains 'no'
    ("No, but yes", 1, 0),  # substring looks for 'yes' first
    ("Unclear", -1, -1),
    ("YES!", 1, 1),
    ("Perhaps", -1, -1),
    ("eyes", 1, 1),
    ("", -1, -1),
]


@pytest.mark.parametrize("mode,idx", [("substring", 1), ("prefix_first", 2)])
def test_parse_yes_no_truth_table(spark, mode, idx):
    df = one_col(spark, [t[0] for t in YES_NO])
    got = [r[0] for r in df.select(L.parse_yes_no("x", mode)).collect()]
    assert got == [t[idx] for t in YES_NO]


# --- P9 / P10 / P12: alias matrix ---------------------------------------------------


def test_multi_hot_lenient_accepts_both_spellings_and_ignores_unknown(spark):
    df = one_col(spark, ["Playing Victim Role,Denial", "Playing the Servant Role", "Bogus", ""])
    bits = [r[0] for r in df.select(L.bits_string(L.multi_hot(L.split_labels("x"), "technique"))).collect()]
    assert bits == ["10001000000", "00000100000", "00000000000", "00000000000"]
    invalid = [r[0] for r in df.select(L.multi_hot_invalid(L.multi_hot(L.split_labels("x"), "technique"))).collect()]
    assert invalid == [False, False, True, True]


def test_multi_hot_strict_lowercases_and_rejects_alias(spark):
    df = one_col(spark, ["denial,playing the victim role"])
    row = df.select(L.bits_string(L.multi_hot(L.split_labels("x"), "technique", "strict")).alias("b"),
                    L.unknown_labels(L.split_labels("x"), "technique", "strict").alias("u")).first()
    assert row.b == "10000000000"
    assert row.u == ["playing the victim role"]


def test_parse_label_list_matches_the_form_only(spark):
    df = one_col(spark, ["Playing Victim Role and DENIAL", "playing the victim role", "nothing here"])
    got = [r[0] for r in df.select(L.parse_label_list("x", "technique")).collect()]
    assert got == [["Denial"], ["Playing Victim Role"], []]


def test_canonicalize_both_directions(spark):
    df = one_col(spark, ["Playing Victim Role,Denial,Playing the Servant Role"])
    the = df.select(F.array_join(L.canonicalize_labels(L.split_labels("x"), "the"), ",")).first()[0]
    gold = df.select(F.array_join(L.canonicalize_labels(L.split_labels("x"), "gold"), ",")).first()[0]
    assert the == "Playing the Victim Role,Denial,Playing the Servant Role"
    assert gold == "Playing Victim Role,Denial,Playing Servant Role"


# --- P1-P5, P13, P14 --------------------------------------------------------------


def test_normalize_speakers_tags_untagged_lines(spark):
    df = one_col(spark, ["Person1: hi\nPerson2: yo", "Turn 3: a", "plain\ntext", "end\n", "", "\nlead"])
    got = [r[0] for r in df.select(T.normalize_speakers("x")).collect()]
    assert got == ["<person>: hi\n<person>: yo", "<person>: a", "<person>: plain\n<person>: text",
                   "<person>: end\n<person>: ", "<person>: ", "<person>: \n<person>: lead"]


def test_strip_and_parse_turns(spark):
    df = spark.createDataFrame([("1", "Person1: hi there\nPerson2: no\nuntagged")], "id string, dialogue string")
    assert df.select(T.strip_speakers("dialogue")).first()[0] == "hi there\nno\nuntagged"
    rows = T.parse_turns(df).orderBy("turn").collect()
    assert [(r.turn, r.speaker, r.text) for r in rows] == [(0, "Person1", "hi there"), (1, "Person2", "no"),
                                                            (2, "", "untagged")]


def test_count_and_truncate_tokens(spark):
    df = one_col(spark, ["Don't stop, é-tude 42!", ""])
    assert [r[0] for r in df.select(T.count_tokens("x")).collect()] == [10, 0]
    df2 = one_col(spark, ["a b c d e"])
    r = df2.select(T.truncate_tokens("x", 2, "first"), T.truncate_tokens("x", 2, "last"),
                   T.truncate_tokens("x", 9, "last")).first()
    assert tuple(r) == ("a b", "d e", "a b c d e")


def test_threshold_and_argmax(spark):
    df = spark.createDataFrame([([0.0, -0.1, 2.0],)], "s array<double>")
    r = df.select(L.threshold_scores(F.col("s")), L.argmax_label(F.col("s"))).first()
    assert r[0] == [1, 0, 1] and r[1] == 2


def test_top_emotion_tie_goes_to_earlier(spark):
    df = spark.createDataFrame([([Row(label="anger", score=0.4), Row(label="joy", score=0.6),
                                  Row(label="fear", score=0.6)],)], "s array<struct<label:string,score:double>>")
    assert df.select(L.top_emotion(F.col("s"))).first()[0] == "joy"


def test_binarize_rules(spark):
    df = one_col(spark, ["1", "0", "", "2"])
    one = [r[0] for r in df.select(L.binarize_label("x", "one")).collect()]
    nz = [r[0] for r in df.select(L.binarize_label("x", "not_zero")).collect()]
    assert one == [1, 0, 0, 0] and nz == [1, 0, 1, 1]


def test_resolve_label_column_priority(spark):
    df = spark.createDataFrame([("d", "1", "0")], "Dialogue string, Manipulative string, `Hate Speech` string")
    assert L.resolve_label_column(df, "train").first().label == "0"
    assert L.resolve_label_column(df, "instruction").first().label == "1"
    with pytest.raises(ValueError):
        L.resolve_label_column(df.select("Dialogue"), "eval")


# --- E: metrics --------------------------------------------------------------------


def binary_df(spark, pairs):
    return spark.createDataFrame([("m", "s", y, p) for y, p in pairs], "model string, setting string, y int, p int")


def test_binary_metrics_hand_computed(spark):
    # tp=2 fp=1 fn=1 tn=1, one corrupted row ignored
    df = binary_df(spark, [(1, 1), (1, 1), (0, 1), (1, 0), (0, 0), (1, -1)])
    cm = E.confusion_binary(df).first()
    assert (cm.tn, cm.fp, cm.fn, cm.tp) == (1, 1, 1, 2)
    m = E.binary_metrics(df).first()
    assert m.precision == pytest.approx(2 / 3, abs=1e-6)
    assert m.recall == pytest.approx(2 / 3, abs=1e-6)
    assert m.accuracy == pytest.approx(0.6) and m.micro_f1 == m.accuracy
    f1_1, f1_0 = 4 / 6, 2 / 4
    assert m.macro_f1 == pytest.approx((f1_1 + f1_0) / 2, abs=1e-6)
    q = E.response_quality(df).first()
    assert (q.n_total, q.n_corrupted, q.n_processed, q.n_gold_pos, q.n_pred_pos) == (6, 1, 5, 3, 3)


def test_binary_metrics_zero_division_and_absent_class(spark):
    df = binary_df(spark, [(0, 0), (0, 0)])
    m = E.binary_metrics(df).first()
    # class 1 absent from gold and prediction: only class 0 counts in macro
    assert (m.precision, m.recall, m.accuracy, m.macro_f1) == (0.0, 0.0, 1.0, 1.0)


def test_no_processed_rows_gives_null_metrics(spark):
    m = E.binary_metrics(binary_df(spark, [(1, -1), (0, -1)])).first()
    assert m.precision is None and m.macro_f1 is None


def test_multilabel_metrics_hand_computed(spark):
    rows = [("a", [1, 0, 0, 0, 0], [1, 0, 0, 0, 0]),
            ("b", [1, 1, 0, 0, 0], [1, 0, 1, 0, 0]),
            ("c", [0, 1, 0, 0, 0], [0, 0, 0, 0, 0])]  # empty prediction: not processed
    df = spark.createDataFrame(rows, "id string, y array<int>, p array<int>")
    m = E.multilabel_metrics(df, "vulnerability").first()
    # pooled over processed rows a, b: tp=2 fp=1 fn=1
    assert m.precision == pytest.approx(2 / 3, abs=1e-6) and m.recall == pytest.approx(2 / 3, abs=1e-6)
    assert m.accuracy == pytest.approx(0.5)
    # per-label F1: Naivete 1.0, Dependency 0, Over-responsibility 0, two absent labels 0
    assert m.macro_f1 == pytest.approx(1.0 / 5)
    per = {r.label: (r.precision, r.recall) for r in E.per_label_metrics(df, "vulnerability").collect()}
    assert per["Naivete"] == (1.0, 1.0) and per["Dependency"] == (0.0, 0.0)


def test_pooled_auc_modes(spark):
    df = spark.createDataFrame([(1, 2.0), (1, 0.5), (0, 0.5), (0, -1.0)], "y int, score double")
    thr = E.pooled_auc(df, "thresholded").first().auc
    assert thr == pytest.approx(0.75)  # TPR 1, TNR 0.5
    sc = E.pooled_auc(df, "score").first().auc
    # pairs (pos, neg): (2.0,0.5) 1, (2.0,-1) 1, (0.5,0.5) .5, (0.5,-1) 1 -> 3.5 / 4
    assert sc == pytest.approx(0.875)


# --- statistics ----------------------------------------------------------------------


def test_label_counts_skip_empty_and_order(spark):
    df = one_col(spark, ["Denial,Evasion", "", "Denial"], "technique")
    got = [(r.label, r.n) for r in A.label_counts(df, "technique").collect()]
    assert got == [("Denial", 2), ("Evasion", 1)]


def test_cross_cooccurrence_counts_repeats(spark):
    df = spark.createDataFrame([("Denial,Denial", "Naivete"), ("Denial", "")], "technique string, vulnerability string")
    got = {(r.label_a, r.label_b): r.n for r in A.label_cross_cooccurrence(df).collect()}
    assert got[("Denial", "Naivete")] == 2 and len(got) == 55


def test_ccdf_points(spark):
    df = spark.createDataFrame([("d", v) for v in [1, 2, 2, 3]], "dataset string, v int")
    got = {r.value: (r.n, r.p_first, r.p_last) for r in A.ccdf(df, "v").collect()}
    assert got == {1: (1, 1.0, 1.0), 2: (2, 0.75, 0.5), 3: (1, 0.25, 0.25)}


def test_turn_stats_constant_mode(spark):
    df = spark.createDataFrame([("t", "a\nb\nc")], "dataset string, dialogue string")
    assert tuple(A.turn_stats(df, constant=2).first()) == ("t", 2.0, 0.0)


def test_dataset_summary_ratio_null_without_negatives(spark):
    df = spark.createDataFrame([("x", "train", "1"), ("x", "train", "1")], "dataset string, split string, manipulative string")
    rows = {r.split: r for r in A.dataset_summary(df).collect()}
    assert rows["train"].ratio is None and rows["all"].n == 2


# --- models / scoring -----------------------------------------------------------------


def test_best_run_ties(spark):
    df = spark.createDataFrame([("b", 1, 0.9), ("a", 2, 0.9), ("a", 3, 0.9), ("c", 1, 0.5)],
                               "run string, epoch int, f1 double")
    assert tuple(M.best_run(df).first()) == ("a", 2, 0.9)


def test_standardize_zero_stdev_counts_as_one(spark):
    df = spark.createDataFrame([("1", "c", [1.0, 5.0]), ("2", "c", [3.0, 5.0])], "id string, class string, embedding array<float>")
    got = {(r.id, r.pos): r.z for r in M.standardize(df).collect()}
    assert got == {("1", 0): -1.0, ("2", 0): 1.0, ("1", 1): 0.0, ("2", 1): 0.0}


def test_batch_score_stub(spark):
    df = spark.createDataFrame([("1", "The cat"), ("2", "a dog")], "id string, text string")
    got = dict(M.batch_score(df, M.keyword_stub(("the ",)), "text", batch_rows=1).collect())
    assert got == {"1": "Yes.", "2": "No."}


# --- sources: CSV with quotes and newlines -------------------------------------------------


def test_labelled_csv_round_trip_with_quotes_and_newlines(spark, tmp_path):
    rows = [("1", 'He said "no"\nthen left', "1", "Denial,Evasion", ""), ("2", "  padded  ", "0", "", "")]
    df = spark.createDataFrame(rows, "ID string, Dialogue string, Manipulative string, Technique string, Vulnerability string")
    path = W.write_csv(df, str(tmp_path / "l"))
    back = sorted(tuple(r) for r in S.read_labelled_csv(spark, path).collect())
    assert back == sorted(rows)
    assert S.read_labelled_csv(spark, path, drop_id=True).columns == ["dialogue", "manipulative", "technique",
                                                                        "vulnerability"]


def test_thread_dialogue(spark):
    df = spark.createDataFrame([("t", [Row(text="Title\nbody one\nbody two "), Row(text="  reply\n")])],
                               "id string, reddit_thread array<struct<text:string>>")
    got = df.select(S.thread_dialogue(F.col("reddit_thread"))).first()[0]
    assert got == "utterance 0: body one body two\nutterance 1: reply"


def test_assemble_dialogues_orders_turns_numerically(spark):
    df = spark.createDataFrame([("n", "10", "@USER late"), ("n", "2", " early ")], "Number string, Turn string, utterance string")
    got = S.assemble_dialogues(df, "Number", "Turn", "utterance").first().dialogue
    assert got == "Turn 2: early\nTurn 10: late"


def test_strip_speakers_tag_sets(spark):
    df = one_col(spark, ["utterance 0: a\nutterance 1: b\nutterance 2: c", "Turn 0: x\nTurn 1: y"])
    got = [r[0] for r in df.select(T.strip_speakers("x", "all")).collect()]
    assert got == ["a\nb\nutterance 2: c", "x\ny"]


def test_select_examples_any_class(spark):
    from dialoglab.operators import sampling as R

    df = spark.createDataFrame([(str(i), str(i % 2)) for i in range(20)], "id string, manipulative string")
    assert R.select_examples(df, None, 3, seed=1).count() == 3
    by_class = R.select_examples(df, "manipulative", {"1": 2, "0": 1}, seed=1).groupBy("manipulative").count()
    assert {r.manipulative: r["count"] for r in by_class.collect()} == {"1": 2, "0": 1}
    per_class = R.select_examples(df, "manipulative", 4, seed=1).groupBy("manipulative").count()
    assert {r.manipulative: r["count"] for r in per_class.collect()} == {"1": 4, "0": 4}


def test_batch_score_vector_output(spark):
    import pandas as pd

    def make():
        return lambda s: pd.Series([[float(len(t)), 1.0] for t in s])

    df = spark.createDataFrame([("1", "abc"), ("2", "")], "id string, text string")
    got = dict(M.batch_score(df, make, "text", "vec", "array<double>").collect())
    assert got == {"1": [3.0, 1.0], "2": [0.0, 1.0]}


def test_labelled_csv_splittable_mode(spark, tmp_path):
    rows = [(str(i), f'say "{i}", twice', "1", "Denial", "") for i in range(50)]
    df = spark.createDataFrame(rows, "ID string, Dialogue string, Manipulative string, Technique string, Vulnerability string")
    path = W.write_csv(df.repartition(3), str(tmp_path / "flat"))
    back = sorted(tuple(r) for r in S.read_labelled_csv(spark, path, multi_line=False).collect())
    assert back == sorted(rows)


def test_multi_hot_checked_raises(spark):
    ok = one_col(spark, ["Denial"]).select(L.multi_hot_checked(L.split_labels("x"), "technique")).first()[0]
    assert ok[0] == 1
    with pytest.raises(Exception, match="all zeros"):
        one_col(spark, ["Bogus"]).select(L.multi_hot_checked(L.split_labels("x"), "technique")).collect()
    with pytest.raises(Exception, match="unknown label"):
        one_col(spark, ["denial,bogus"]).select(
            L.multi_hot_checked(L.split_labels("x"), "technique", "strict")).collect()


def test_unanswered_counts(spark):
    from dialoglab.operators import joins as J

    gold = spark.createDataFrame([("1",), ("2",), ("3",)], "id string")
    preds = spark.createDataFrame([("1", "m", "s"), ("1", "m", "s"), ("2", "m", "s"), ("9", "m", "s"),
                                   ("3", "n", "s")], "id string, model string, setting string")
    got = {(r.model, r.setting): r.n_unanswered for r in J.unanswered(gold, preds).collect()}
    assert got == {("m", "s"): 1, ("n", "s"): 2}
    assert [r.id for r in J.unanswered_ids(gold, preds.filter("model = 'm'")).collect()] == ["3"]


def test_text_column_without_header_skip(spark, tmp_path):
    df = spark.createDataFrame([("h1", " first "), ("x", "second\n")], "a string, b string")
    path = W.write_csv(df.coalesce(1), str(tmp_path / "t"), header=False)
    got = sorted(r.dialogue for r in S.read_text_column_csv(spark, path, 1, skip_header=False).collect())
    assert got == ["first", "second\n".strip()]


def test_resolve_eval_fallback_and_sft_text_kind(spark):
    from dialoglab.operators import prompts as B

    df = spark.createDataFrame([("d", "1")], "Dialogue string, Toxicity string")
    assert tuple(L.resolve_label_column(df, "eval").first()) == ("d", "1")
    t = B.sft_text(spark.createDataFrame([("1", "hello", "0")], "id string, text string, label string"),
                   "text", "label").first().sft_text
    assert "dialogue contain mental manipulation" in t
    df = spark.createDataFrame([("1", "hello", "0")], "id string, text string, stress string")
    t = B.sft_text(df, "text", "stress").first().sft_text
    assert "piece of text contain mental stress" in t and t.endswith("### Answer:\nNo.") and "### Dialogue:\nhello" in t


def test_binarize_cast(spark):
    df = one_col(spark, ["1", "0"])
    assert [r[0] for r in df.select(L.binarize_label("x", "cast")).collect()] == [1, 0]


def test_token_stats_extra(spark):
    df = spark.createDataFrame([("d", "a b"), ("d", "a b c d"), ("d", "x")], "dataset string, dialogue string")
    r = A.token_stats(df, extra=True).first()
    assert (r.mean, r.min, r.max, r.quartiles[1]) == (round(7 / 3, 6), 1, 4, 2)


def test_vocabulary_table_and_helpers(spark):
    from dialoglab.functions import vocab as V

    t = V.vocab_table(spark)
    assert t.count() == 16
    vic = t.filter("label = 'Playing Victim Role'").first()
    assert (vic.measure, vic.ordinal, vic.short_code, vic.match_text) == ("technique", 4, "VIC", "playing the victim role")
    assert V.gold_form("Playing the Servant Role") == "Playing Servant Role"
    assert V.labels_for("vul") == V.VULNERABILITIES
    e = one_col(spark, ["love", "anger", "bogus"]).select(L.emotion_ordinal("x")).collect()
    assert [r[0] for r in e] == [4, 0, -1]


def test_fixture_turns_view(spark):
    from conftest import SF_SMALL
    from dialoglab.plans import fixtures as fx

    turns = fx.fx_turns(spark, SF_SMALL)
    dialogues = fx.fx_dialogues(spark, SF_SMALL)
    assert turns.select("id").distinct().count() == dialogues.count()


@pytest.mark.parametrize("fmt", ["csv", "parquet", "json"])
def test_write_results_formats(spark, fmt):
    from dialoglab.session import scratch_path

    df = spark.createDataFrame([("a", "1", 0.5, 1.5), ("b", "2", -1.0, 2.0), ("a", "3", 2.0, 0.0)],
                               "dataset string, id string, x double, y double")
    path = W.write_results(df, scratch_path(spark, f"results-{fmt}"), fmt, "dataset")
    reader = spark.read.option("header", True).schema("id string, x double, y double, dataset string") \
        if fmt == "csv" else spark.read
    back = getattr(reader, fmt)(path).select("dataset", "id", "x", "y")
    assert sorted(tuple(r) for r in back.collect()) == sorted(tuple(r) for r in df.collect())


def test_multilabel_keeps_empty_predictions_for_classifiers(spark):
    rows = [("a", [1, 0, 0, 0, 0], [1, 0, 0, 0, 0]), ("c", [0, 1, 0, 0, 0], [0, 0, 0, 0, 0]),
            ("d", [0, 0, 0, 0, 0], [0, 0, 0, 0, 0])]
    df = spark.createDataFrame(rows, "id string, y array<int>, p array<int>")
    m = E.multilabel_metrics(df, "vulnerability", skip_empty=False).first()
    assert m.accuracy == pytest.approx(2 / 3) and m.recall == pytest.approx(0.5)
    cm = {r.label: (r.tn, r.fp, r.fn, r.tp) for r in E.confusion_multilabel(df, "vulnerability", skip_empty=False).collect()}
    assert cm["Dependency"] == (2, 0, 1, 0)


def test_multilabel_no_processed_rows_gives_nulls(spark):
    df = spark.createDataFrame([("a", [1, 0, 0, 0, 0], [0, 0, 0, 0, 0])], "id string, y array<int>, p array<int>")
    m = E.multilabel_metrics(df, "vulnerability").first()
    assert m.precision is None and m.accuracy is None and m.macro_f1 is None


def test_emotion_distribution_wide(spark):
    df = spark.createDataFrame([("joy", "1"), ("joy", "0"), ("anger", "1"), ("joy", "1")], "emotion string, class string")
    rows = [tuple(r) for r in A.emotion_distribution_wide(df).collect()]
    assert rows[0] == ("anger", 1, 0) and rows[1] == ("joy", 2, 1) and len(rows) == 6


def test_batch_score_with_repartition(spark):
    df = spark.createDataFrame([(str(i), "the x" if i % 2 else "y") for i in range(40)], "id string, text string")
    out = M.batch_score(df, M.keyword_stub(("the ",)), "text", num_partitions=5)
    got = dict(out.collect())
    assert len(got) == 40 and got["1"] == "Yes." and got["2"] == "No."


def test_ccdf_buckets_without_groups(spark):
    df = spark.createDataFrame([(v,) for v in [1, 2, 2, 3]], "v int")
    got = {r.value: (r.n, r.p_first, r.p_last) for r in A.ccdf(df, "v", by=None, method="buckets").collect()}
    assert got == {1: (1, 1.0, 1.0), 2: (2, 0.75, 0.5), 3: (1, 0.25, 0.25)}

"""DuckDB oracle SQL, one statement per registered query.

Written independently of the Spark operators: plain window functions,
``GROUP BY`` and ``FILTER`` clauses over the same fixture views (CTEs from
:mod:`dialoglab.plans.fixtures`).
"""

from __future__ import annotations

from ..functions.treebank import RULES, SPACE
from ..functions.vocab import ALIASES, EMOTIONS, TECHNIQUES, VULNERABILITIES, the_form
from ..operators.prompts import DEFAULT_TEMPLATES, system_prompt
from .fixtures import ANNOTATION_COLS, BLANK_CELLS, DIRTY_TECH, GOLD_TECH, GOLD_VUL, ORACLE_VIEWS, _q, with_views

# Extra oracle-only views.
ORACLE_VIEWS["fx_split"] = (
    "SELECT id, doc_id, dialogue, manipulative, technique, vulnerability, "
    "CASE WHEN rk <= floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' "
    "WHEN rk <= floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'valid' "
    "ELSE 'test' END AS split FROM (SELECT *, row_number() OVER (ORDER BY md5('17:' || id), id) AS rk, "
    "count(*) OVER () AS n FROM fx_gold) t"
)
ORACLE_VIEWS["fx_binpred"] = (
    "SELECT s.id, r.model, r.setting, CASE WHEN s.manipulative = '1' THEN 1 ELSE 0 END AS y, "
    "CASE WHEN lower(r.response) LIKE '%yes%' THEN 1 WHEN lower(r.response) LIKE '%no%' THEN 0 ELSE -1 END AS p "
    "FROM fx_split s JOIN fx_responses r ON s.id = r.id WHERE s.split = 'test'"
)
BINPRED = ("fx_gold", "fx_split", "fx_responses", "fx_binpred")

_CONF = (
    "count(*) FILTER (WHERE p <> -1 AND y <> 1 AND p <> 1) AS tn, "
    "count(*) FILTER (WHERE p <> -1 AND y <> 1 AND p = 1) AS fp, "
    "count(*) FILTER (WHERE p <> -1 AND y = 1 AND p <> 1) AS fn, "
    "count(*) FILTER (WHERE p <> -1 AND y = 1 AND p = 1) AS tp"
)


def _metrics_sql(by: str) -> str:
    """precision/recall/accuracy/micro/macro from a CTE ``cm`` with tn fp fn tp."""
    sep = ", " if by else ""
    return (
        f"SELECT {by}{sep}"
        "CASE WHEN n > 0 THEN round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) END AS precision, "
        "CASE WHEN n > 0 THEN round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) END AS recall, "
        "CASE WHEN n > 0 THEN round((tp + tn) / n, 6) END AS accuracy, "
        "CASE WHEN n > 0 THEN round((tp + tn) / n, 6) END AS micro_f1, "
        "CASE WHEN n > 0 THEN round(((CASE WHEN tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END) "
        "+ (CASE WHEN tn + fp + fn > 0 THEN 2 * tn / (2 * tn + fp + fn) ELSE 0 END)) "
        "/ ((CASE WHEN tp + fp + fn > 0 THEN 1 ELSE 0 END) + (CASE WHEN tn + fp + fn > 0 THEN 1 ELSE 0 END)), 6) "
        "END AS macro_f1 "
        "FROM (SELECT *, CAST(tp AS DOUBLE) + fp + fn + tn AS n FROM cm) c"
    )


ORACLE: dict[str, str] = {
    "split_exact": with_views("SELECT id, split FROM fx_split", "fx_gold", "fx_split"),
    "parse_yes_no": with_views(
        "SELECT id, model, setting, CASE WHEN lower(response) LIKE '%yes%' THEN 1 "
        "WHEN lower(response) LIKE '%no%' THEN 0 ELSE -1 END AS pred FROM fx_responses",
        "fx_responses",
    ),
    "join_predictions": with_views("SELECT id, model, setting, y, p FROM fx_binpred", *BINPRED),
    "unanswered": with_views(
        "SELECT r.model, r.setting, (SELECT count(DISTINCT id) FROM fx_split WHERE split = 'test') - "
        "count(DISTINCT r.id) AS n_unanswered FROM fx_responses r WHERE r.id IN (SELECT id FROM fx_split "
        "WHERE split = 'test') GROUP BY r.model, r.setting", "fx_gold", "fx_split", "fx_responses"),
    "response_quality": with_views(
        "SELECT model, setting, count(*) AS n_total, count(*) FILTER (WHERE p = -1) AS n_corrupted, "
        "count(*) FILTER (WHERE p <> -1) AS n_processed, count(*) FILTER (WHERE p <> -1 AND y = 1) AS n_gold_pos, "
        "count(*) FILTER (WHERE p <> -1 AND y = 0) AS n_gold_neg, count(*) FILTER (WHERE p = 1) AS n_pred_pos, "
        "count(*) FILTER (WHERE p = 0) AS n_pred_neg FROM fx_binpred GROUP BY model, setting",
        *BINPRED,
    ),
    "confusion_binary": with_views(f"SELECT model, setting, {_CONF} FROM fx_binpred GROUP BY model, setting", *BINPRED),
    "binary_metrics": with_views(
        f"WITH cm AS (SELECT model, setting, {_CONF} FROM fx_binpred GROUP BY model, setting) "
        + _metrics_sql("model, setting"),
        *BINPRED,
    ),
    "leaderboard": with_views(
        f"WITH cm AS (SELECT model, setting, {_CONF} FROM fx_binpred GROUP BY model, setting), "
        f"m AS ({_metrics_sql('model, setting')}) "
        "SELECT *, rank() OVER (ORDER BY macro_f1 DESC NULLS LAST) AS rank FROM m",
        *BINPRED,
    ),
}


# ---------------------------------------------------------------------------
# sources, scalars, statistics, annotators
# ---------------------------------------------------------------------------


STRIP_RE = r"'^[ \t\n\r\f\x0B]+|[ \t\n\r\f\x0B]+$'"
TOKEN_RE = r"'[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]'"
LINE_TAG_RE = r"'^((?:Person|Turn |utterance )\d+):\s?'"


def _strip(x: str) -> str:
    return f"regexp_replace({x}, {STRIP_RE}, '', 'g')"


def _values(col: str, vals) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join(f"({_q(v)})" for v in vals) + f") t({col}))"


def _tokens(x: str) -> str:
    return f"len(regexp_extract_all({x}, {TOKEN_RE}))"


def _treebank(x: str) -> str:
    out = f"(chr(10) || {x} || chr(10))"
    for pattern, by in RULES:
        out = f"regexp_replace({out}, {_q(pattern)}, {_q(by)}, 'g')"
    return f"len(regexp_extract_all({out}, {_q(f'[^{SPACE}{chr(10)}]+')}))"


NO_PERSON = "replace(replace(dialogue, 'Person1: ', ''), 'Person2: ', '')"
ANN_NAMES = ", ".join(f'"{n}"' for n, _ in ANNOTATION_COLS)

_unpivot = " UNION ALL ".join(
    f"SELECT id, {k} AS annotator_no, annotator_{k} AS annotator, TRY_CAST(manipulative_{k} AS INT) AS manipulative, "
    f"technique_{k} AS technique, victim_{k} AS victim, vulnerability_{k} AS vulnerability, marks_{k} AS marks, "
    f"TRY_CAST(confidence_{k} AS INT) AS confidence "
    "FROM fx_annotations" for k in (1, 2, 3)
)
ORACLE_VIEWS["fx_long"] = _unpivot


def _bits(col: str, labels) -> str:
    parts = []
    for lab in labels:
        alt = ALIASES.get(lab)
        cond = f"list_contains(string_split({col}, ','), {_q(lab)})"
        if alt:
            cond = f"({cond} OR list_contains(string_split({col}, ','), {_q(alt)}))"
        parts.append(f"CASE WHEN {cond} THEN '1' ELSE '0' END")
    return "concat(" + ", ".join(parts) + ")"


def _found(col: str, labels) -> str:
    return "concat_ws(',', " + ", ".join(
        f"CASE WHEN strpos(lower({col}), {_q(ALIASES.get(lab, lab).lower())}) > 0 THEN {_q(lab)} END" for lab in labels
    ) + ")"


ORACLE.update({
    "read_labelled_csv": with_views(
        "SELECT id, dialogue, manipulative, technique, vulnerability FROM fx_gold", "fx_gold"),
    "read_annotations": with_views(f"SELECT {ANN_NAMES} FROM fx_annotations", "fx_annotations"),
    "read_thread_jsonl": (
        "SELECT CAST(conv_id AS VARCHAR) AS id, string_agg('utterance ' || CAST(i AS VARCHAR) || ': ' || "
        + _strip("CASE WHEN i = 0 THEN array_to_string(string_split(text, chr(10))[2:], ' ') ELSE text END")
        + ", chr(10) ORDER BY i) AS dialogue FROM (SELECT conv_id, text, "
        "row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i FROM conversations) t GROUP BY conv_id"
    ),
    "read_turn_table": (
        "SELECT CAST(conv_id AS VARCHAR) AS id, string_agg('Turn ' || CAST(turn AS VARCHAR) || ': ' || "
        + _strip("replace(text, '@USER', '')")
        + ", chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id"
    ),
    "stream_dialogues": (
        "SELECT CAST(conv_id AS VARCHAR) AS id, string_agg('Turn ' || CAST(turn AS VARCHAR) || ': ' || "
        + _strip("replace(text, '@USER', '')")
        + ", chr(10) ORDER BY turn) AS dialogue FROM conversations GROUP BY conv_id"
    ),
    "read_text_column_csv": with_views(
        f"SELECT md5(dialogue) AS id, dialogue FROM (SELECT {_strip('dialogue')} AS dialogue FROM fx_dialogues) t",
        "fx_dialogues"),
    "union_corpora": with_views(
        "SELECT 'documents' AS dataset, 'documents/' || id AS id, dialogue FROM fx_corpora UNION ALL "
        "SELECT 'dialogues', 'dialogues/' || id, dialogue FROM fx_dialogues UNION ALL "
        "SELECT 'turns', 'turns/' || CAST(conv_id AS VARCHAR), string_agg('Turn ' || CAST(turn AS VARCHAR) || ': ' || "
        + _strip("replace(text, '@USER', '')") + ", chr(10) ORDER BY turn) FROM conversations GROUP BY conv_id",
        "fx_corpora", "fx_dialogues"),
    "write_results": with_views(
        f"SELECT dataset, round(avg({_tokens(NO_PERSON)}), 6) AS mean FROM fx_corpora GROUP BY dataset", "fx_corpora"),
    "normalize_speakers": with_views(
        "SELECT id, CASE WHEN strpos(t, '<person>:') > 0 THEN t ELSE "
        "array_to_string(list_transform(string_split(t, chr(10)), lambda l: '<person>: ' || l), chr(10)) END AS text "
        "FROM (SELECT id, regexp_replace(regexp_replace(regexp_replace(dialogue, 'Person\\d+:', '<person>:', 'g'), "
        "'Turn \\d+:', '<person>:', 'g'), 'utterance \\d+:', '<person>:', 'g') AS t FROM ("
        "SELECT 'c' || id AS id, dialogue FROM fx_dialogues UNION ALL SELECT 'd' || id, dialogue FROM fx_corpora) x) y",
        "fx_dialogues", "fx_corpora"),
    "strip_speakers": with_views(f"SELECT id, {NO_PERSON} AS text FROM fx_dialogues", "fx_dialogues"),
    "parse_turns": with_views(
        f"SELECT id, CAST(turn AS BIGINT) AS turn, regexp_extract(line, {LINE_TAG_RE}, 1) AS speaker, "
        f"regexp_replace(line, {LINE_TAG_RE}, '') AS text FROM (SELECT id, unnest(generate_series(0, len(parts) - 1)) "
        "AS turn, unnest(parts) AS line FROM (SELECT id, string_split(dialogue, chr(10)) AS parts FROM fx_dialogues) a) b",
        "fx_dialogues"),
    "count_tokens": with_views(f"SELECT id, CAST({_tokens(NO_PERSON)} AS BIGINT) AS n_tokens FROM fx_corpora",
                               "fx_corpora"),
    "count_tokens_treebank": with_views(f"SELECT id, CAST({_treebank(NO_PERSON)} AS BIGINT) AS n_tokens FROM fx_dialogues",
                                        "fx_dialogues"),
    "token_stats_treebank": with_views(
        f"SELECT dataset, round(avg({_treebank(NO_PERSON)}), 6) AS mean FROM fx_corpora GROUP BY dataset", "fx_corpora"),
    "truncate_tokens": with_views(
        "SELECT id, CASE WHEN len(w) <= 500 THEN dialogue ELSE array_to_string(list_slice(w, 1, 500), ' ') END AS text "
        "FROM (SELECT id, dialogue, regexp_extract_all(dialogue, '\\S+') AS w FROM fx_corpora) t", "fx_corpora"),
    "truncate_tokens_last": with_views(
        "SELECT id, CASE WHEN len(w) <= 4096 THEN dialogue ELSE "
        "array_to_string(list_slice(w, len(w) - 4095, len(w)), ' ') END AS text "
        "FROM (SELECT id, dialogue, regexp_extract_all(dialogue, '\\S+') AS w FROM fx_corpora) t", "fx_corpora"),
    "binarize_label": with_views(
        "SELECT id, CASE WHEN manipulative = '1' THEN 1 ELSE 0 END AS label FROM fx_gold", "fx_gold"),
    "resolve_label_column": with_views('SELECT "Dialogue" AS text, "Hate Speech" AS label FROM fx_aux', "fx_aux"),
    "filter_measured": with_views(
        "SELECT id, dialogue, manipulative, technique, vulnerability FROM fx_gold WHERE technique <> ''", "fx_gold"),
    "canonicalize_labels": with_views(
        "SELECT id, replace(replace(technique, 'Playing Victim Role', 'Playing the Victim Role'), "
        "'Playing Servant Role', 'Playing the Servant Role') AS labels FROM fx_gold", "fx_gold"),
    "multi_hot": with_views(f"SELECT id, {_bits('technique', TECHNIQUES)} AS bits FROM fx_gold", "fx_gold"),
    "parse_label_list": with_views(
        f"SELECT id, measure, CASE WHEN measure = 'technique' THEN {_found('response', TECHNIQUES)} "
        f"ELSE {_found('response', VULNERABILITIES)} END AS labels FROM fx_label_responses", "fx_label_responses"),
    "threshold_scores": with_views(
        "SELECT id, string_agg(CASE WHEN 1 / (1 + exp(-logit)) >= 0.5 THEN '1' ELSE '0' END, '' ORDER BY j) AS bits "
        "FROM fx_logits GROUP BY id", "fx_logits"),
    "top_emotion": with_views(
        "SELECT id, label AS emotion FROM (SELECT id, label, row_number() OVER (PARTITION BY id ORDER BY score DESC, j) "
        "AS rn FROM fx_emotion_scores) t WHERE rn = 1", "fx_emotion_scores"),
    "dataset_summary": with_views(
        "SELECT dataset, COALESCE(split, 'all') AS split, count(*) AS n, count(*) FILTER (WHERE manipulative = '1') "
        "AS n_pos, count(*) FILTER (WHERE manipulative = '0') AS n_neg, CASE WHEN count(*) FILTER (WHERE "
        "manipulative = '0') > 0 THEN round(count(*) FILTER (WHERE manipulative = '1') / count(*) FILTER (WHERE "
        "manipulative = '0'), 6) END AS ratio FROM (SELECT s.*, d.lang AS dataset FROM fx_split s JOIN documents d "
        "ON s.doc_id = d.doc_id) t GROUP BY GROUPING SETS ((dataset, split), (dataset))",
        "fx_gold", "fx_split"),
    "label_counts": with_views(
        "SELECT label, count(*) AS n FROM (SELECT unnest(string_split(technique, ',')) AS label FROM fx_gold "
        "WHERE technique <> '') t GROUP BY label", "fx_gold"),
    "label_cooccurrence": with_views(
        "WITH l AS (SELECT DISTINCT id, label FROM (SELECT id, unnest(string_split(technique, ',')) AS label "
        "FROM fx_gold WHERE technique <> '') x), c AS (SELECT a.label AS label_a, b.label AS label_b, count(*) AS n "
        "FROM l a JOIN l b ON a.id = b.id AND a.label <> b.label GROUP BY 1, 2) "
        f"SELECT va.label AS label_a, vb.label AS label_b, COALESCE(c.n, 0) AS n FROM {_values('label', TECHNIQUES)} va "
        f"CROSS JOIN {_values('label', TECHNIQUES)} vb LEFT JOIN c ON c.label_a = va.label AND c.label_b = vb.label",
        "fx_gold"),
    "label_cross_cooccurrence": with_views(
        "WITH t AS (SELECT id, unnest(string_split(technique, ',')) AS a FROM fx_gold WHERE technique <> '' "
        "AND vulnerability <> ''), v AS (SELECT id, unnest(string_split(vulnerability, ',')) AS b FROM fx_gold "
        "WHERE technique <> '' AND vulnerability <> ''), c AS (SELECT a, b, count(*) AS n FROM t JOIN v "
        "ON t.id = v.id GROUP BY 1, 2) "
        f"SELECT va.label AS label_a, vb.label AS label_b, COALESCE(c.n, 0) AS n FROM {_values('label', TECHNIQUES)} va "
        f"CROSS JOIN {_values('label', VULNERABILITIES)} vb LEFT JOIN c ON c.a = va.label AND c.b = vb.label",
        "fx_gold"),
    "token_stats": with_views(
        f"SELECT dataset, round(avg({_tokens(NO_PERSON)}), 6) AS mean FROM fx_corpora "
        "GROUP BY dataset", "fx_corpora"),
    "turn_stats": with_views(
        "SELECT dataset, round(avg(n), 6) AS mean, round(stddev_samp(n), 6) AS stdev FROM (SELECT dataset, "
        f"len(string_split(dialogue, chr(10))) AS n FROM fx_corpora) t GROUP BY dataset",
        "fx_corpora"),
    "ccdf": with_views(
        "SELECT dataset, value, count(*) AS n, round(1 - min(i) / max(tot), 6) AS p_first, "
        "round(1 - max(i) / max(tot), 6) AS p_last FROM (SELECT dataset, value, "
        "row_number() OVER (PARTITION BY dataset ORDER BY value) - 1 AS i, count(*) OVER (PARTITION BY dataset) AS tot "
        f"FROM (SELECT dataset, len(string_split(dialogue, chr(10))) AS value FROM fx_corpora "
        ") a) b GROUP BY dataset, value", "fx_corpora"),
    "emotion_distribution": with_views(
        "WITH top AS (SELECT id, class, label AS emotion FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY "
        "score DESC, j) AS rn FROM fx_emotion_scores) t WHERE rn = 1), c AS (SELECT emotion, class, count(*) AS n "
        "FROM top GROUP BY 1, 2) "
        f"SELECT e.emotion, k.class, COALESCE(c.n, 0) AS n FROM {_values('emotion', EMOTIONS)} e "
        f"CROSS JOIN {_values('class', ['1', '0'])} k LEFT JOIN c ON c.emotion = e.emotion AND c.class = k.class",
        "fx_emotion_scores"),
    "emotion_counts": with_views(
        "SELECT dataset, label AS emotion, count(*) AS n FROM (SELECT dataset, label, row_number() OVER "
        "(PARTITION BY id ORDER BY score DESC, j) AS rn FROM fx_emotion_scores) t WHERE rn = 1 GROUP BY 1, 2",
        "fx_emotion_scores"),
    "split_label_share": with_views(
        "WITH rows_ AS (SELECT * FROM fx_split WHERE technique <> '' AND vulnerability <> ''), "
        "l AS (SELECT split, unnest(string_split(technique, ',')) AS label FROM rows_ UNION ALL "
        "SELECT split, unnest(string_split(vulnerability, ',')) FROM rows_), "
        "c AS (SELECT label, split, count(*) AS n FROM l GROUP BY 1, 2), "
        "g AS (SELECT DISTINCT c.label, s.split FROM c, (VALUES ('train'), ('valid'), ('test')) s(split) "
        "WHERE c.split = 'train') "
        "SELECT g.label, g.split, COALESCE(c.n, 0) AS n, round(COALESCE(c.n, 0) / sum(COALESCE(c.n, 0)) "
        "OVER (PARTITION BY g.label), 6) AS share FROM g LEFT JOIN c ON c.label = g.label AND c.split = g.split",
        "fx_gold", "fx_split"),
    "compare_datasets": (
        "SELECT lang AS dataset, label, count(*) AS n FROM (SELECT lang, unnest(string_split(t, ',')) AS label FROM "
        f"(SELECT lang, {GOLD_TECH} AS t "
        "FROM documents) a WHERE t <> '') b GROUP BY 1, 2"
    ),
    "unpivot_annotators": with_views(
        "SELECT id, annotator_no, annotator, manipulative, technique, victim, vulnerability, marks, confidence FROM fx_long",
        "fx_annotations", "fx_long"),
    "gold_consensus": with_views(
        "SELECT id, CAST(min(manipulative) AS VARCHAR) AS manipulative FROM fx_long GROUP BY id "
        "HAVING min(manipulative) = max(manipulative) AND count(*) = 3", "fx_annotations", "fx_long"),
    "gold_majority": with_views(
        "SELECT id, CASE WHEN sum(manipulative) >= 2 THEN '1' ELSE '0' END AS manipulative FROM fx_long GROUP BY id",
        "fx_annotations", "fx_long"),
    "vote_labels": with_views(
        "SELECT id, label, count(DISTINCT annotator_no) AS n_votes FROM (SELECT id, annotator_no, "
        "unnest(string_split(technique, ',')) AS label FROM fx_long WHERE technique <> '') t GROUP BY id, label "
        "HAVING count(DISTINCT annotator_no) >= 2", "fx_annotations", "fx_long"),
    "annotator_agreement": with_views(
        "SELECT id, round(greatest(sum(manipulative), 3 - sum(manipulative)) / 3, 6) AS agreement, "
        "round(avg(confidence), 6) AS mean_confidence FROM fx_long GROUP BY id", "fx_annotations", "fx_long"),
})


# ---------------------------------------------------------------------------
# samples, prompts, scoring, multi-label evaluation, key phrases
# ---------------------------------------------------------------------------


SPLIT = ("fx_gold", "fx_split")


def _rk(seed: int, part: str = "") -> str:
    p = f"PARTITION BY {part} " if part else ""
    return f"row_number() OVER ({p}ORDER BY md5('{seed}:' || id), id)"


_EXAMPLES = (
    f"SELECT id, manipulative, dialogue, {_rk(0, 'manipulative')} AS example_no FROM fx_split WHERE split = 'train'"
)
ORACLE_VIEWS["fx_examples"] = (
    f"SELECT * FROM ({_EXAMPLES}) e WHERE (manipulative = '1' AND example_no <= 2) "
    "OR (manipulative = '0' AND example_no <= 1)"
)
EXAMPLES = ("fx_gold", "fx_split", "fx_examples")


def _msg(role: str, content: str) -> str:
    return f"{{'role': '{role}', 'content': {content}}}"


_SFT_HEAD = "### Instruction:\n{q}\n\n### Dialogue:\n"
_SFT_TAIL = "\n\n### Answer:\n"
MLONG = ("fx_gold", "fx_label_responses", "fx_mlong")
_MCONF = (
    "count(*) FILTER (WHERE y = 0 AND p = 0) AS tn, count(*) FILTER (WHERE y = 0 AND p = 1) AS fp, "
    "count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, count(*) FILTER (WHERE y = 1 AND p = 1) AS tp"
)

ORACLE.update({
    "sample_cap": with_views(f"SELECT id FROM (SELECT id, {_rk(42)} AS rk FROM fx_corpora) t WHERE rk <= 5000",
                             "fx_corpora"),
    "holdout": with_views(
        "SELECT id, CASE WHEN rk <= ceil(n * CAST(0.2 AS DOUBLE)) THEN 'test' ELSE 'train' END AS split "
        f"FROM (SELECT id, {_rk(42)} AS rk, count(*) OVER () AS n FROM fx_corpora) t", "fx_corpora"),
    "balance_classes": with_views(
        f"WITH r AS (SELECT id, manipulative, {_rk(0, 'manipulative')} AS rk FROM fx_gold), "
        "m AS (SELECT min(c) AS k FROM (SELECT count(*) AS c FROM fx_gold GROUP BY manipulative) x) "
        "SELECT id, manipulative FROM r, m WHERE rk <= k", "fx_gold"),
    "sample_per_group": with_views(
        f"SELECT id, dataset FROM (SELECT id, dataset, {_rk(11, 'dataset')} AS rk FROM fx_corpora) t WHERE rk <= 500",
        "fx_corpora"),
    "select_examples": with_views("SELECT id, manipulative, example_no FROM fx_examples", *EXAMPLES),
    "zeroshot_messages": with_views(
        f"SELECT id, CAST(to_json([{_msg('system', _q(system_prompt('binary')))}, {_msg('user', 'dialogue')}]) "
        "AS VARCHAR) AS messages FROM fx_split WHERE split = 'test'", *SPLIT),
    "zeroshot_messages_technique": with_views(
        f"SELECT id, CAST(to_json([{_msg('system', _q(system_prompt('technique')))}, {_msg('user', 'dialogue')}]) "
        "AS VARCHAR) AS messages FROM fx_split WHERE split = 'test'", *SPLIT),
    "fewshot_messages": with_views(
        "WITH ex AS (SELECT row_number() OVER (ORDER BY CASE WHEN manipulative = '1' THEN 0 ELSE 1 END, example_no) "
        "AS i, manipulative, dialogue FROM fx_examples), "
        "blk AS (SELECT count(*) AS k, flatten(list([" + _msg("user", "'Example ' || CAST(i AS VARCHAR) || ':' || chr(10) "
        "|| dialogue") + ", " + _msg("assistant", "CASE WHEN manipulative = '1' THEN 'Yes' ELSE 'No' END")
        + "] ORDER BY i)) AS m FROM ex) "
        f"SELECT t.id, CAST(to_json(list_concat([{_msg('system', _q(system_prompt('binary') + chr(10)) + ' || replace(' + _q(DEFAULT_TEMPLATES['fewshot_intro']) + ', ' + _q('{k}') + ', CAST(blk.k AS VARCHAR))')}], "
        f"blk.m, [{_msg('user', 't.dialogue')}])) AS VARCHAR) AS messages FROM fx_split t, blk WHERE t.split = 'test'",
        *EXAMPLES),
    "attach_examples": with_views(
        "SELECT id, (SELECT count(*) FROM fx_examples) AS n_examples FROM fx_split WHERE split = 'test'", *EXAMPLES),
    "sft_text_binary": with_views(
        f"SELECT id, {_q(_SFT_HEAD.format(q='Does the following dialogue contain mental manipulation? Answer Yes or No.'))} || dialogue || "
        f"{_q(_SFT_TAIL)} || CASE WHEN manipulative = '1' THEN 'Yes.' ELSE 'No.' END AS sft_text FROM fx_gold",
        "fx_gold"),
    "sft_text_multilabel": with_views(
        f"SELECT id, {_q(_SFT_HEAD.format(q=DEFAULT_TEMPLATES['sft_question_labels'].replace('{measure}', 'technique')))}"
        f" || dialogue || {_q(_SFT_TAIL)} || replace(replace(replace(technique, ',', chr(10)), "
        "'Playing Victim Role', 'Playing the Victim Role'), 'Playing Servant Role', 'Playing the Servant Role') "
        "AS sft_text FROM fx_gold WHERE technique <> ''", "fx_gold"),
    "classifier_table": with_views(
        'SELECT "Dialogue" AS text, CASE WHEN "Hate Speech" = \'0\' THEN 0 ELSE 1 END AS label FROM fx_aux', "fx_aux"),
    "batch_score": with_views(
        "SELECT id, CASE WHEN strpos(lower(dialogue), 'the ') > 0 OR strpos(lower(dialogue), 'que ') > 0 "
        "THEN 'Yes.' ELSE 'No.' END AS response FROM fx_split WHERE split = 'test'", *SPLIT),
    "best_run": with_views(
        "WITH f AS (SELECT model || '/' || setting AS run, CAST(CAST(id AS BIGINT) % 5 + 1 AS BIGINT) AS epoch, "
        "round(avg(CASE WHEN y = p THEN 1.0 ELSE 0.0 END), 6) AS f1 FROM fx_binpred WHERE p <> -1 GROUP BY 1, 2) "
        "SELECT run, epoch, f1 FROM f ORDER BY f1 DESC, run, epoch LIMIT 1", *BINPRED),
    "standardize_embeddings": with_views(
        "WITH l AS (SELECT id, class, unnest(generate_series(0, len(embedding) - 1)) AS pos, "
        "CAST(unnest(embedding) AS DOUBLE) AS x FROM fx_embeddings), "
        "st AS (SELECT class, pos, avg(x) AS mu, stddev_pop(x) AS sd FROM l GROUP BY class, pos) "
        "SELECT id, CAST(l.pos AS BIGINT) AS pos, round((x - mu) / CASE WHEN sd > 0 THEN sd ELSE 1 END, 6) AS z "
        "FROM l JOIN st ON l.class = st.class AND l.pos = st.pos", "fx_embeddings"),
    "pooled_auc": with_views(
        "WITH t AS (SELECT y, CASE WHEN 1 / (1 + exp(-logit)) >= 0.5 THEN 1 ELSE 0 END AS p FROM fx_logits), "
        "c AS (SELECT count(*) FILTER (WHERE y = 1 AND p = 1) AS tp, count(*) FILTER (WHERE y = 1 AND p = 0) AS fn, "
        "count(*) FILTER (WHERE y <> 1 AND p = 0) AS tn, count(*) FILTER (WHERE y <> 1 AND p = 1) AS fp FROM t), "
        "r AS (SELECT y, rank() OVER (ORDER BY logit) + (count(*) OVER (PARTITION BY logit) - 1) / 2.0 AS ar "
        "FROM fx_logits), "
        "u AS (SELECT sum(ar) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS np, "
        "count(*) FILTER (WHERE y <> 1) AS nn FROM r) "
        "SELECT 'thresholded' AS mode, round(((CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END) + "
        "(CASE WHEN tn + fp > 0 THEN tn / (tn + fp) ELSE 0 END)) / 2, 6) AS auc FROM c "
        "UNION ALL SELECT 'score', round((rs - np * (np + 1) / 2.0) / (np * nn), 6) FROM u", "fx_logits"),
    "match_key_phrases": with_views(
        "WITH d AS (SELECT id, ' ' || trim(regexp_replace(lower(dialogue), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' "
        "AS t FROM fx_corpora) SELECT p.phrase, count(d.id) AS n_dialogues FROM fx_phrases p LEFT JOIN d "
        "ON strpos(d.t, ' ' || p.phrase || ' ') > 0 GROUP BY p.phrase", "fx_corpora", "fx_phrases"),
})


# ---------------------------------------------------------------------------
# second measure (vulnerability) and multi-label few-shot prompts
# ---------------------------------------------------------------------------


def _mlong_sql(measure: str, labels) -> str:
    values = "(SELECT * FROM (VALUES " + ", ".join(
        f"({_q(lab)}, {_q(the_form(lab))}, {_q(the_form(lab).lower())})" for lab in labels
    ) + ") t(label, alt, m))"
    return (
        f"WITH v AS {values}, g AS (SELECT id, {measure} AS lst FROM fx_gold WHERE {measure} <> ''), "
        f"r AS (SELECT id, response FROM fx_label_responses WHERE measure = '{measure}'), "
        "ok AS (SELECT g.id, g.lst, r.response FROM g JOIN r ON g.id = r.id "
        "WHERE EXISTS (SELECT 1 FROM v WHERE strpos(lower(r.response), v.m) > 0)) "
        "SELECT ok.id, v.label, CASE WHEN list_contains(string_split(ok.lst, ','), v.label) "
        "OR list_contains(string_split(ok.lst, ','), v.alt) THEN 1 ELSE 0 END AS y, "
        "CASE WHEN strpos(lower(ok.response), v.m) > 0 THEN 1 ELSE 0 END AS p FROM ok CROSS JOIN v"
    )


ORACLE_VIEWS["fx_mlong_vul"] = _mlong_sql("vulnerability", VULNERABILITIES)
MLONG_VUL = ("fx_gold", "fx_label_responses", "fx_mlong_vul")


def _multilabel_oracles(view: str, deps: tuple[str, ...], suffix: str) -> dict[str, str]:
    """E4-E6 over a long (id, label, y, p) view of processed rows."""
    conf = f"SELECT label, {_MCONF} FROM {view} GROUP BY label"
    return {
        f"confusion_multilabel{suffix}": with_views(conf, *deps),
        f"per_label_metrics{suffix}": with_views(
            f"WITH c AS ({conf}) SELECT label, "
            "round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, "
            "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall FROM c", *deps),
        f"multilabel_metrics{suffix}": with_views(
            f"WITH c AS ({conf}), "
            "a AS (SELECT avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS acc FROM (SELECT id, bool_and(y = p) AS ok "
            f"FROM {view} GROUP BY id) x), "
            "s AS (SELECT sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN "
            "2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro FROM c) "
            "SELECT round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, "
            "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(a.acc, 6) AS accuracy, "
            "round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS micro_f1, "
            "round(macro, 6) AS macro_f1 FROM s, a", *deps),
    }


ORACLE_VIEWS["fx_mlong"] = _mlong_sql("technique", TECHNIQUES)
ORACLE.update(_multilabel_oracles("fx_mlong", MLONG, ""))
ORACLE.update(_multilabel_oracles("fx_mlong_vul", MLONG_VUL, "_vulnerability"))

def _answer_sql(measure: str) -> str:
    return (
        f"replace(replace(replace({measure}, ',', chr(10)), 'Playing Victim Role', 'Playing the Victim Role'), "
        "'Playing Servant Role', 'Playing the Servant Role') || chr(10)"
    )


def _msplit_sql(measure: str) -> str:
    return (
        "SELECT *, CASE WHEN rk <= floor(n * CAST(0.6 AS DOUBLE)) THEN 'train' "
        "WHEN rk <= floor(n * CAST(0.6 AS DOUBLE)) + floor(n * CAST(0.2 AS DOUBLE)) THEN 'valid' ELSE 'test' END "
        f"AS split FROM (SELECT *, {_rk(17)} AS rk, count(*) OVER () AS n FROM fx_gold WHERE {measure} <> '') t"
    )


def _fewshot_measure_sql(measure: str) -> str:
    view = f"fx_msplit_{measure}"
    ORACLE_VIEWS[view] = _msplit_sql(measure)
    intro = (_q(system_prompt(measure) + chr(10)) + " || replace(" + _q(DEFAULT_TEMPLATES["fewshot_intro"]) + ", "
             + _q("{k}") + ", CAST(blk.k AS VARCHAR))")
    return with_views(
        f"WITH ex AS (SELECT * FROM (SELECT *, {_rk(0)} AS o FROM {view} WHERE split = 'train') e WHERE o <= 3), "
        "blk AS (SELECT count(*) AS k, flatten(list([" + _msg("user", "'Example ' || CAST(o AS VARCHAR) || ':' || "
        "chr(10) || dialogue") + ", " + _msg("assistant", _answer_sql(measure)) + "] ORDER BY o)) AS m FROM ex) "
        f"SELECT t.id, CAST(to_json(list_concat([{_msg('system', intro)}], blk.m, [{_msg('user', 't.dialogue')}])) "
        f"AS VARCHAR) AS messages FROM {view} t, blk WHERE t.split = 'test'",
        "fx_gold", view)


ORACLE.update({
    "zeroshot_messages_vulnerability": with_views(
        f"SELECT id, CAST(to_json([{_msg('system', _q(system_prompt('vulnerability')))}, {_msg('user', 'dialogue')}]) "
        "AS VARCHAR) AS messages FROM fx_split WHERE split = 'test'", *SPLIT),
    "fewshot_messages_technique": _fewshot_measure_sql("technique"),
    "fewshot_messages_vulnerability": _fewshot_measure_sql("vulnerability"),
})


# ---------------------------------------------------------------------------
# input that is not clean, and the other settings of operators
# ---------------------------------------------------------------------------


ORACLE_VIEWS["fx_dirty"] = f"SELECT CAST(doc_id AS VARCHAR) AS id, {DIRTY_TECH} AS technique, {GOLD_VUL} AS vulnerability FROM documents"
ORACLE_VIEWS["fx_dirty_tech"] = (
    "SELECT id, CASE WHEN l = 'Playing the Victim Role' THEN 'Playing Victim Role' WHEN l = 'Playing the Servant Role' "
    "THEN 'Playing Servant Role' ELSE l END AS label FROM (SELECT id, unnest(string_split(technique, ',')) AS l "
    "FROM fx_dirty WHERE technique <> '') x"
)
ORACLE_VIEWS["fx_blank"] = "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN {cond} THEN '' ELSE {c} END AS {c}" for c, cond in BLANK_CELLS.items()) + ") FROM fx_annotations"
ORACLE_VIEWS["fx_blank_long"] = _unpivot.replace("fx_annotations", "fx_blank")
ORACLE_VIEWS["fx_sides"] = (
    "SELECT 'documents' AS dataset, dialogue FROM fx_corpora UNION ALL SELECT 'dialogues', dialogue FROM fx_dialogues "
    "UNION ALL SELECT 'turns', string_agg('Turn ' || CAST(turn AS VARCHAR) || ': ' || "
    + _strip("replace(text, '@USER', '')") + ", chr(10) ORDER BY turn) FROM conversations GROUP BY conv_id"
)
SIDES = ("fx_corpora", "fx_dialogues", "fx_sides")
_NO_TAGS = ("CASE dataset WHEN 'dialogues' THEN replace(replace(dialogue, 'Person1: ', ''), 'Person2: ', '') "
            "WHEN 'turns' THEN replace(replace(dialogue, 'Turn 0: ', ''), 'Turn 1: ', '') ELSE dialogue END")
_GRID_TV = (f"{_values('label', TECHNIQUES)} va CROSS JOIN {_values('label', VULNERABILITIES)} vb")


def _strict_bits(col: str, labels) -> str:
    return "concat(" + ", ".join(
        f"CASE WHEN list_contains(string_split(lower({col}), ','), {_q(lab.lower())}) THEN '1' ELSE '0' END" for lab in labels) + ")"


ORACLE.update({
    "label_cooccurrence_dirty": with_views(
        "WITH l AS (SELECT DISTINCT id, label FROM fx_dirty_tech), c AS (SELECT a.label AS label_a, b.label AS label_b, "
        "count(*) AS n FROM l a JOIN l b ON a.id = b.id AND a.label <> b.label GROUP BY 1, 2) "
        f"SELECT va.label AS label_a, vb.label AS label_b, COALESCE(c.n, 0) AS n FROM {_values('label', TECHNIQUES)} va "
        f"CROSS JOIN {_values('label', TECHNIQUES)} vb LEFT JOIN c ON c.label_a = va.label AND c.label_b = vb.label",
        "fx_dirty", "fx_dirty_tech"),
    "label_cross_cooccurrence_dirty": with_views(
        "WITH v AS (SELECT id, unnest(string_split(vulnerability, ',')) AS b FROM fx_dirty WHERE vulnerability <> ''), "
        "c AS (SELECT label AS a, b, count(*) AS n FROM fx_dirty_tech t JOIN v ON t.id = v.id GROUP BY 1, 2) "
        f"SELECT va.label AS label_a, vb.label AS label_b, COALESCE(c.n, 0) AS n FROM {_GRID_TV} "
        "LEFT JOIN c ON c.a = va.label AND c.b = vb.label", "fx_dirty", "fx_dirty_tech"),
    "unknown_label_counts": with_views(
        "SELECT label, count(DISTINCT id) AS n FROM fx_dirty_tech WHERE label IN ('Gaslighting', 'Other') GROUP BY label",
        "fx_dirty", "fx_dirty_tech"),
    "annotator_agreement_blank": with_views(
        "SELECT id, round(greatest(coalesce(sum(manipulative), 0), 3 - coalesce(sum(manipulative), 0)) / 3, 6) AS agreement, "
        "round(avg(confidence), 6) AS mean_confidence FROM fx_blank_long GROUP BY id", "fx_annotations", "fx_blank", "fx_blank_long"),
    "unpivot_annotators_blank": with_views(
        "SELECT id, annotator_no, manipulative, confidence FROM fx_blank_long", "fx_annotations", "fx_blank", "fx_blank_long"),
    "unanswered_no_gold": with_views(
        "WITH a AS (SELECT id, model, setting FROM fx_responses UNION ALL SELECT 'x' || id, 'model_c', setting FROM fx_responses "
        "WHERE setting = 'zeroshot' UNION ALL SELECT id, NULL, setting FROM fx_responses WHERE model = 'model_a') "
        "SELECT model, setting, (SELECT count(DISTINCT id) FROM fx_split WHERE split = 'test') - count(DISTINCT s.id) "
        "AS n_unanswered FROM a LEFT JOIN (SELECT id FROM fx_split WHERE split = 'test') s ON a.id = s.id "
        "GROUP BY model, setting", "fx_gold", "fx_split", "fx_responses"),
    "match_key_phrases_repeated": with_views(
        "WITH d AS (SELECT id, ' ' || trim(regexp_replace(lower(dialogue), '[^\\p{L}\\p{N}]+', ' ', 'g')) || ' ' "
        "AS t FROM fx_corpora), p AS (SELECT phrase FROM fx_phrases UNION SELECT upper(phrase) FROM fx_phrases "
        "WHERE phrase <> 'thou') SELECT p.phrase, count(d.id) AS n_dialogues FROM p LEFT JOIN d "
        "ON strpos(d.t, ' ' || lower(p.phrase) || ' ') > 0 GROUP BY p.phrase", "fx_corpora", "fx_phrases"),
    "split_threads": (
        "WITH c AS (SELECT count(DISTINCT conv_id) AS n FROM conversations) "
        "SELECT 'train' AS split, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS n FROM c UNION ALL "
        "SELECT 'valid', CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM c UNION ALL "
        "SELECT 'test', CAST(n - floor(n * CAST(0.6 AS DOUBLE)) - floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM c"
    ),
    "sample_corpora": (
        "SELECT d AS dataset, least(60, count(DISTINCT conv_id)) AS n, least(60, count(DISTINCT conv_id)) AS n_ids "
        "FROM conversations, (VALUES ('threads'), ('texts'), ('turns')) t(d) GROUP BY d"
    ),
    "split_null_ids": (
        "WITH d AS (SELECT CASE WHEN doc_id % 4 = 0 THEN NULL ELSE lang END AS class FROM documents), "
        "n AS (SELECT count(*) AS n FROM d), k AS (SELECT class, count(*) AS n FROM d GROUP BY class) "
        "SELECT 'split' AS what, 'train' AS name, CAST(floor(n * CAST(0.6 AS DOUBLE)) AS BIGINT) AS n FROM n UNION ALL "
        "SELECT 'split', 'valid', CAST(floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM n UNION ALL "
        "SELECT 'split', 'test', CAST(n - floor(n * CAST(0.6 AS DOUBLE)) - floor(n * CAST(0.2 AS DOUBLE)) AS BIGINT) FROM n "
        "UNION ALL SELECT 'per class', class, least(n, 20) FROM k UNION ALL "
        "SELECT 'balanced', class, (SELECT min(n) FROM k) FROM k UNION ALL SELECT 'examples', class, least(n, 2) FROM k"
    ),
    "token_stats_by_corpus": with_views(
        f"SELECT dataset, round(avg({_tokens('t')}), 6) AS mean FROM (SELECT dataset, {_NO_TAGS} AS t FROM fx_sides) x GROUP BY dataset",
        *SIDES),
    "turn_stats_by_corpus": with_views(
        "SELECT dataset, CASE WHEN dataset = 'turns' THEN 2.0::DOUBLE ELSE round(avg(n), 6) END AS mean, "
        "CASE WHEN dataset = 'turns' THEN 0.0::DOUBLE ELSE round(stddev_samp(n), 6) END AS stdev FROM (SELECT dataset, "
        "len(string_split(dialogue, chr(10))) AS n FROM fx_sides) t GROUP BY dataset", *SIDES),
    "ccdf_buckets": ORACLE["ccdf"],
    "pooled_auc_by_class": with_views(
        "WITH l AS (SELECT CASE WHEN j % 3 = 0 THEN NULL ELSE CAST(j % 3 AS VARCHAR) END AS part, y, logit FROM fx_logits), "
        "r AS (SELECT part, y, rank() OVER (PARTITION BY part ORDER BY logit) + (count(*) OVER (PARTITION BY part, logit) - 1) "
        "/ 2.0 AS ar FROM l), u AS (SELECT part, sum(ar) FILTER (WHERE y = 1) AS rs, count(*) FILTER (WHERE y = 1) AS np, "
        "count(*) FILTER (WHERE y <> 1) AS nn FROM r GROUP BY part) "
        "SELECT part, round((rs - np * (np + 1) / 2.0) / (np * nn), 6) AS auc FROM u", "fx_logits"),
    "label_variants": with_views(
        "SELECT g.id, CASE WHEN manipulative = '0' THEN 0 ELSE 1 END AS not_zero, CAST(manipulative AS INT) AS as_int, "
        f"{_strict_bits('technique', TECHNIQUES)} AS strict_bits, {_bits('vulnerability', VULNERABILITIES)} AS vulnerability_bits, "
        "CASE WHEN lower(response) LIKE 'yes%' THEN 1 WHEN lower(response) LIKE 'no%' THEN 0 WHEN lower(response) LIKE '%yes%' "
        "THEN 1 WHEN lower(response) LIKE '%no%' THEN 0 ELSE -1 END AS prefix_first FROM fx_gold g JOIN fx_responses r "
        "ON g.id = r.id WHERE model = 'model_a' AND setting = 'zeroshot'", "fx_gold", "fx_responses"),
    "argmax_label": with_views(
        "SELECT id, CAST(j AS INT) AS label FROM (SELECT id, j, row_number() OVER (PARTITION BY id ORDER BY logit DESC, j) "
        "AS k FROM fx_logits) t WHERE k = 1", "fx_logits"),
    "label_counts_vulnerability": with_views(
        "SELECT label, count(*) AS n FROM (SELECT unnest(string_split(vulnerability, ',')) AS label FROM fx_gold "
        "WHERE vulnerability <> '') t GROUP BY label", "fx_gold"),
    "label_cooccurrence_vulnerability": with_views(
        "WITH l AS (SELECT DISTINCT id, label FROM (SELECT id, unnest(string_split(vulnerability, ',')) AS label "
        "FROM fx_gold WHERE vulnerability <> '') x), c AS (SELECT a.label AS label_a, b.label AS label_b, count(*) AS n "
        "FROM l a JOIN l b ON a.id = b.id AND a.label <> b.label GROUP BY 1, 2) "
        f"SELECT va.label AS label_a, vb.label AS label_b, COALESCE(c.n, 0) AS n FROM {_values('label', VULNERABILITIES)} va "
        f"CROSS JOIN {_values('label', VULNERABILITIES)} vb LEFT JOIN c ON c.label_a = va.label AND c.label_b = vb.label",
        "fx_gold"),
    "evaluate_prompts": with_views(
        "WITH b AS (SELECT CASE WHEN manipulative = '1' THEN 1 ELSE 0 END AS y, CASE WHEN strpos(lower(d), 'que ') > 0 "
        "OR strpos(lower(d), ' und ') > 0 THEN 1 ELSE 0 END AS p FROM (SELECT manipulative, CASE WHEN len(w) <= 4096 THEN "
        "dialogue ELSE array_to_string(list_slice(w, len(w) - 4095, len(w)), ' ') END AS d FROM (SELECT *, "
        "regexp_extract_all(dialogue, '\\S+') AS w FROM fx_split WHERE split = 'test') x) z), "
        f"cm AS (SELECT 'stub' AS model, 'zeroshot' AS setting, {_CONF} FROM b) " + _metrics_sql("model, setting"), *SPLIT),
    "leaderboard_multilabel": with_views(
        "WITH k AS (SELECT *, CASE WHEN CAST(id AS BIGINT) % 2 = 0 THEN 'a' ELSE 'b' END AS model FROM fx_mlong), "
        f"c AS (SELECT model, label, {_MCONF} FROM k GROUP BY model, label), "
        "a AS (SELECT model, avg(CASE WHEN ok THEN 1.0 ELSE 0.0 END) AS acc FROM (SELECT model, id, bool_and(y = p) AS ok "
        "FROM k GROUP BY model, id) x GROUP BY model), "
        "s AS (SELECT model, sum(tp) AS tp, sum(fp) AS fp, sum(fn) AS fn, avg(CASE WHEN 2 * tp + fp + fn > 0 THEN "
        "2 * tp / (2 * tp + fp + fn) ELSE 0 END) AS macro FROM c GROUP BY model), "
        "m AS (SELECT 'own' AS train_data, s.model, round(CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END, 6) AS precision, "
        "round(CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END, 6) AS recall, round(a.acc, 6) AS accuracy, "
        "round(CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END, 6) AS micro_f1, "
        "round(macro, 6) AS macro_f1, 'technique' AS measure FROM s JOIN a ON s.model = a.model) "
        "SELECT *, rank() OVER (ORDER BY macro_f1 DESC NULLS LAST) AS rank FROM m", *MLONG),
})

_ASKED = {"Hate Speech": "Does the following dialogue contain hate speech?", "Stress": "Does the following piece of text contain mental stress?",
          "Suicide": "Does the following piece of text contain suicidal ideation?"}
ORACLE["sft_text_by_label_column"] = " UNION ALL ".join(
    f"SELECT CAST(d.doc_id AS VARCHAR) AS id, {_q(_SFT_HEAD.format(q=q + ' Answer Yes or No.'))} || text || {_q(_SFT_TAIL)} || "
    f"CASE WHEN toxic = 1 THEN 'Yes.' ELSE 'No.' END AS sft_text, {_q(c)} AS label_column "
    "FROM documents d JOIN labels l ON d.doc_id = l.doc_id" for c, q in _ASKED.items())

ORACLE["read_labelled_csv_split"] = with_views(
    "SELECT row_number() OVER (ORDER BY doc_id) - 1 AS line_no, id, replace(dialogue, chr(13) || chr(10), chr(10)) AS dialogue, "
    "manipulative, technique, vulnerability FROM fx_gold", "fx_gold")
ORACLE["align_by_position"] = with_views(
    "SELECT row_number() OVER (ORDER BY g.doc_id) - 1 AS line_no, g.id, CASE WHEN manipulative = '1' THEN 1 ELSE 0 END AS y, "
    "CASE WHEN lower(r.response) LIKE '%yes%' THEN 1 WHEN lower(r.response) LIKE '%no%' THEN 0 ELSE -1 END AS p "
    "FROM fx_gold g JOIN fx_responses r ON g.id = r.id WHERE r.model = 'model_a' AND r.setting = 'zeroshot'", "fx_gold", "fx_responses")
ORACLE["match_key_phrases_automaton"] = with_views(
    "WITH d AS (SELECT id, trim(regexp_replace(lower(dialogue), '[^\\p{L}\\p{N}]+', ' ', 'g')) AS t FROM fx_corpora), "
    "w AS (SELECT id, string_split(t, ' ') AS ws FROM d), "
    "p AS (SELECT DISTINCT array_to_string(ws[1:2], ' ') AS phrase FROM w WHERE array_to_string(ws[1:2], ' ') <> ''), "
    "g AS (SELECT DISTINCT id, unnest(list_concat(ws, [ws[i] || ' ' || ws[i + 1] FOR i IN range(1, len(ws))])) AS phrase FROM w) "
    "SELECT phrase, count(*) AS n_dialogues FROM g JOIN p USING (phrase) GROUP BY phrase", "fx_corpora")
_VOTES = ", ".join(f"CASE WHEN {BLANK_CELLS[c]} THEN '' ELSE {c} END" if c in BLANK_CELLS else c for c in (f"manipulative_{k}" for k in (1, 2, 3)))
ORACLE["annotator_alpha"] = with_views(
    f"WITH l AS (SELECT id, unnest([{_VOTES}]) AS v FROM fx_annotations), "
    "u AS (SELECT id, CAST(count(*) AS DOUBLE) AS m, CAST(count(*) FILTER (WHERE v = '1') AS DOUBLE) AS a FROM l WHERE v IN ('0', '1') "
    "GROUP BY id HAVING count(*) >= 2), "
    "s AS (SELECT count(*) AS n_units, sum(m) AS n, sum(2 * a * (m - a) / (m - 1)) AS o, sum(a) AS a FROM u) "
    "SELECT n_units, CAST(n AS BIGINT) AS n_votes, round(o / n, 6) AS observed, round(2 * a * (n - a) / n / (n - 1), 6) AS expected, "
    "round(1 - o * (n - 1) / (2 * a * (n - a)), 6) AS alpha FROM s", "fx_annotations")

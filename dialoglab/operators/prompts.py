"""Prompt and training-text datasets.

Messages are ``ARRAY<STRUCT<role, content>>`` serialised with ``to_json``.
Few-shot examples are aggregated into one small array (k rows, k a
parameter) and attached to every row as a scalar subquery, so the test
rows are never joined or shuffled to receive them.

The wording below is this package's own; pass ``templates`` to use yours.
"""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.labels import canonicalize_labels, split_labels
from ..functions.vocab import labels_for, the_form

# --- fixed values: headings of the training text and of examples ---------------------
SFT_INSTRUCTION = "### Instruction:\n"
SFT_DIALOGUE = "### Dialogue:\n"
SFT_ANSWER = "### Answer:\n"
EXAMPLE_HEADING = "Example {i}:\n"
# Label columns, what their rows are, and what the label says.
LABEL_QUESTIONS = {
    "Manipulative": ("dialogue", "mental manipulation"),
    "Hate Speech": ("dialogue", "hate speech"),
    "Condescension": ("dialogue", "condescension"),
    "Malevolence": ("dialogue", "malevolence"),
    "Offense": ("dialogue", "offense"),
    "Stress": ("piece of text", "mental stress"),
    "Suicide": ("piece of text", "suicidal ideation"),
    "Delicacy": ("piece of text", "delicate toxicity"),
    "ToxiGen": ("piece of text", "hate speech"),
}
# ------------------------------------------------------------------------------------

DEFAULT_TEMPLATES = {
    "binary": (
        "You are a careful annotator. Read the dialogue and decide whether any speaker uses "
        "mental manipulation on another. Answer with Yes or No."
    ),
    "technique": "You are a careful annotator. Name every manipulation technique used in the dialogue, "
                 "one per line, from this list:",
    "vulnerability": "You are a careful annotator. Name every vulnerability of the targeted person that the "
                     "dialogue exploits, one per line, from this list:",
    "fewshot_intro": "Labelled examples follow ({k} in total); answer the last dialogue the same way.",
    "example": EXAMPLE_HEADING,
    "sft_question": "Does the following {unit} contain {content}? Answer Yes or No.",
    "sft_question_labels": "Which {measure} labels apply to the following dialogue? List one per line.",
}

DEFINITIONS = {
    "Denial": "refusing to admit something that happened",
    "Evasion": "avoiding a direct answer or changing the subject",
    "Feigning Innocence": "pretending not to know or not to mean harm",
    "Rationalization": "giving plausible but false reasons for behaviour",
    "Playing Victim Role": "presenting oneself as the one who is wronged",
    "Playing Servant Role": "presenting oneself as acting only out of duty",
    "Shaming or Belittlement": "making the other feel small or ashamed",
    "Intimidation": "implied or open threats",
    "Brandishing Anger": "showing anger to force compliance",
    "Accusation": "blaming the other to put them on the defensive",
    "Persuasion or Seduction": "charm or flattery to steer the other",
    "Naivete": "trusting too easily",
    "Dependency": "relying on the other person",
    "Over-responsibility": "taking blame for what is not one's fault",
    "Over-intellectualization": "reasoning away one's feelings",
    "Low self-esteem": "doubting one's own worth",
}


def system_prompt(task: str, templates: Mapping[str, str] | None = None) -> str:
    t = {**DEFAULT_TEMPLATES, **(templates or {})}
    if task == "binary":
        return t["binary"]
    labels = labels_for(task)
    numbered = "\n".join(f"{i + 1}. {the_form(lab)}: {DEFINITIONS[lab]}" for i, lab in enumerate(labels))
    return f"{t[task]}\n{numbered}"


def _msg(role: str | Column, content: Column) -> Column:
    r = F.lit(role) if isinstance(role, str) else role
    return F.struct(r.alias("role"), content.alias("content"))


def zeroshot_messages(df: DataFrame, task: str = "binary", text_col: str = "dialogue", id_col: str = "id",
                      templates: Mapping[str, str] | None = None) -> DataFrame:
    """B1: ``[system, user=dialogue]`` as JSON."""
    msgs = F.array(_msg("system", F.lit(system_prompt(task, templates))), _msg("user", F.col(text_col)))
    return df.select(F.col(id_col).alias("id"), F.to_json(msgs).alias("messages"))


def answer_text(task: str, label_col: str) -> Column:
    """Example answer: ``Yes`` / ``No`` or the labels one per line (``the`` form) plus a final newline."""
    if task == "binary":
        return F.when(F.col(label_col) == "1", F.lit("Yes")).otherwise(F.lit("No"))
    labs = canonicalize_labels(split_labels(label_col), "the")
    return F.concat(F.array_join(labs, "\n"), F.lit("\n"))


def example_block(examples: DataFrame, task: str = "binary", text_col: str = "dialogue",
                  class_col: str = "manipulative", order_col: str = "example_no") -> Column:
    """All examples as one array of message pairs - a scalar subquery (k rows, k bounded by the caller).

    Positives come before negatives; inside a class the sampling order is kept.
    """
    label_col = class_col if task == "binary" else task
    rows = examples.select(
        F.struct(
            (F.col(class_col) != "1").cast("int").alias("neg"),
            F.col(order_col).alias("o"),
            F.col(text_col).alias("text"),
            answer_text(task, label_col).alias("answer"),
        ).alias("e")
    )
    return rows.agg(F.array_sort(F.collect_list("e")).alias("ex")).scalar()


def fewshot_messages(df: DataFrame, examples: DataFrame, task: str = "binary", text_col: str = "dialogue",
                     id_col: str = "id", class_col: str = "manipulative",
                     templates: Mapping[str, str] | None = None) -> DataFrame:
    """B2: system (with the example count), example user/assistant pairs, then the dialogue."""
    t = {**DEFAULT_TEMPLATES, **(templates or {})}
    df = df.withColumn("_ex", example_block(examples, task, text_col, class_col))
    ex = F.col("_ex")
    intro = F.concat(F.lit(system_prompt(task, templates) + "\n"),
                     F.replace(F.lit(t["fewshot_intro"]), F.lit("{k}"), F.size(ex).cast("string")))
    head = t["example"].split("{i}")
    pairs = F.flatten(F.transform(ex, lambda e, i: F.array(
        _msg("user", F.concat(F.lit(head[0]), (i + 1).cast("string"), F.lit(head[1]), e["text"])),
        _msg("assistant", e["answer"]),
    )))
    msgs = F.concat(F.array(_msg("system", intro)), pairs, F.array(_msg("user", F.col(text_col))))
    return df.select(F.col(id_col).alias("id"), F.to_json(msgs).alias("messages"))


def attach_examples(df: DataFrame, examples: DataFrame, id_col: str = "id", **kw) -> DataFrame:
    """Every row gets the same example block (no join: a scalar subquery)."""
    ex = example_block(examples, **kw)
    return df.select(F.col(id_col).alias("id"), F.size(ex).cast("bigint").alias("n_examples"))


def _sft_frame(question: str, text_col: str, answer: Column) -> Column:
    return F.concat(F.lit(f"{SFT_INSTRUCTION}{question}\n\n{SFT_DIALOGUE}"), F.col(text_col), F.lit(f"\n\n{SFT_ANSWER}"), answer)


def sft_question(label_col: str, templates: Mapping[str, str] | None = None) -> str:
    """The question that a label column answers (case of the name aside; other columns: the manipulation question)."""
    t = {**DEFAULT_TEMPLATES, **(templates or {})}
    known = {k.lower(): v for k, v in LABEL_QUESTIONS.items()}
    unit, content = known.get(label_col.lower(), LABEL_QUESTIONS["Manipulative"])
    return t["sft_question"].format(unit=unit, content=content)


def sft_text(df: DataFrame, text_col: str = "dialogue", label_col: str = "manipulative",
             id_col: str = "id", templates: Mapping[str, str] | None = None) -> DataFrame:
    """Instruction, dialogue and answer (``Yes.`` or ``No.``) under headings; the label column names the question."""
    ans = F.when(F.col(label_col) == "1", F.lit("Yes.")).otherwise(F.lit("No."))
    body = _sft_frame(sft_question(label_col, templates), text_col, ans)
    return df.select(F.col(id_col).alias("id"), body.alias("sft_text"))


def sft_text_multilabel(df: DataFrame, measure: str = "technique", text_col: str = "dialogue", id_col: str = "id",
                        templates: Mapping[str, str] | None = None) -> DataFrame:
    """Same frame, the answer lists the labels one per line (``the`` form applied)."""
    t = {**DEFAULT_TEMPLATES, **(templates or {})}
    q = t["sft_question_labels"].replace("{measure}", measure)
    labs = F.array_join(canonicalize_labels(split_labels(measure), "the"), "\n")
    body = _sft_frame(q, text_col, labs)
    return df.select(F.col(id_col).alias("id"), body.alias("sft_text"))


def classifier_table(df: DataFrame, task: str = "binary") -> DataFrame:
    """``(text, label)`` - label column resolved (train rule) and binarised ('0' -> 0, else 1).

    The multi-label form fails on a label outside the vocabulary.
    """
    from ..functions.labels import binarize_label, multi_hot_checked, resolve_label_column

    if task == "binary":
        r = resolve_label_column(df, "train")
        return r.select("text", binarize_label("label", "not_zero").alias("label"))
    return df.select(F.col("Dialogue").alias("text"), multi_hot_checked(split_labels(task), task, "strict").alias("label"))

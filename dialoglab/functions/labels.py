"""Label scalars and light table transforms.

All of them are built-in expressions over the fixed vocabulary; the
vocabulary is compiled into the expression as a literal array.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .vocab import ALIASES, EMOTIONS, labels_for, the_form

# --- fixed values ----------------------------------------------------------------
# Label columns of auxiliary corpora, in the order they are looked for.
AUX_LABEL_COLUMNS = ["Hate Speech", "Condescension", "Malevolence", "Offense", "Stress", "Suicide",
                     "Delicacy", "ToxiGen"]
MAIN_LABEL_COLUMN = "Manipulative"
EVAL_FALLBACK_COLUMN = "Toxicity"
# -----------------------------------------------------------------------------------


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def binarize_label(col: str | Column, rule: str = "one") -> Column:
    """``one``: '1' -> 1 else 0; ``not_zero``: '0' -> 0 else 1; ``cast``: integer cast."""
    c = _c(col)
    if rule == "one":
        return F.when(c.cast("string") == "1", 1).otherwise(0)
    if rule == "not_zero":
        return F.when(c.cast("string") == "0", 0).otherwise(1)
    if rule == "cast":
        return c.cast("int")
    raise ValueError(f"unknown rule {rule!r}")


def resolve_label_column(df: DataFrame, rule: str = "train") -> DataFrame:
    """Pick the label column by priority, rename ``Dialogue`` -> ``text``.

    ``train``: auxiliary columns first, then ``Manipulative``;
    ``instruction``: ``Manipulative`` first, then the auxiliary columns;
    ``eval``: ``Manipulative`` else ``Toxicity``.
    Only the schema is inspected - no data is read.
    """
    order = {
        "train": AUX_LABEL_COLUMNS + [MAIN_LABEL_COLUMN],
        "instruction": [MAIN_LABEL_COLUMN] + AUX_LABEL_COLUMNS,
        "eval": [MAIN_LABEL_COLUMN, EVAL_FALLBACK_COLUMN],
    }[rule]
    found = next((c for c in order if c in df.columns), None)
    if found is None:
        raise ValueError(f"no label column among {order}")
    return df.select(F.col("Dialogue").alias("text"), F.col(f"`{found}`").alias("label"))


def filter_measured(df: DataFrame, measure: str, tech_col: str = "technique",
                    vul_col: str = "vulnerability") -> DataFrame:
    """Keep rows whose technique (measure tech) or vulnerability list is non-empty."""
    col = tech_col if measure in ("tech", "technique") else vul_col
    return df.filter(F.coalesce(F.col(col), F.lit("")) != "")


def split_labels(col: str | Column, sep: str = ",") -> Column:
    """Comma list -> array, empty string -> empty array."""
    c = F.coalesce(_c(col), F.lit(""))
    return F.array_remove(F.split(c, sep), "")


def canonicalize_labels(arr: Column, style: str = "the") -> Column:
    """Rewrite the two role labels to the ``the`` form (``style='the'``) or back to gold form."""
    pairs = ALIASES.items() if style == "the" else [(b, a) for a, b in ALIASES.items()]

    def fix(x: Column) -> Column:
        out = None
        for src, dst in pairs:
            out = (F.when(x == src, F.lit(dst)) if out is None else out.when(x == src, F.lit(dst)))
        return out.otherwise(x)

    return F.transform(arr, fix)


def multi_hot(arr: Column, measure: str, mode: str = "lenient") -> Column:
    """P10: label array -> 0/1 array in vector order.

    ``lenient``: exact, case-sensitive names, both spellings of the role
    labels, unknown names ignored.  ``strict``: lower-cased comparison with
    the gold spelling only.  Validity is reported by :func:`multi_hot_invalid`.
    """
    # no lambdas: array_contains stays in generated code, and the shared
    # ``arr`` sub-expression is evaluated once per row (common subexpression
    # elimination does not reach inside lambda functions)
    vocab = labels_for(measure)
    if mode == "lenient":
        def hit(v: str) -> Column:
            c = F.array_contains(arr, F.lit(v))
            return (c | F.array_contains(arr, F.lit(the_form(v)))) if v in ALIASES else c

        return F.array(*[hit(v).cast("int") for v in vocab])
    if mode == "strict":
        low = F.transform(arr, lambda x: F.lower(x))
        return F.array(*[F.array_contains(low, v.lower()).cast("int") for v in vocab])
    raise ValueError("mode must be lenient or strict")


def unknown_labels(arr: Column, measure: str, mode: str = "lenient") -> Column:
    """Labels that are not in the vocabulary (for ``strict`` checks)."""
    vocab = labels_for(measure)
    if mode == "lenient":
        known = F.array(*[F.lit(x) for x in vocab + [the_form(v) for v in vocab if v in ALIASES]])
        return F.filter(arr, lambda x: ~F.array_contains(known, x))
    known = F.array(*[F.lit(v.lower()) for v in vocab])
    return F.filter(arr, lambda x: ~F.array_contains(known, F.lower(x)))


def multi_hot_checked(arr: Column, measure: str, mode: str = "lenient") -> Column:
    """P10 with the original failure rules, raised inside the task:

    ``lenient`` fails on an all-zero vector, ``strict`` fails on an unknown label.
    """
    bits = multi_hot(arr, measure, mode)
    if mode == "lenient":
        bad, msg = multi_hot_invalid(bits), F.concat(F.lit("label vector is all zeros: "), F.array_join(arr, ","))
    else:
        unknown = unknown_labels(arr, measure, "strict")
        bad, msg = F.size(unknown) > 0, F.concat(F.lit("unknown label: "), F.array_join(unknown, ","))
    return F.when(bad, F.raise_error(msg)).otherwise(bits)


def multi_hot_invalid(bits: Column) -> Column:
    """The lenient encoder rejects an all-zero vector."""
    return ~F.array_contains(bits, 1)


def bits_string(bits: Column) -> Column:
    return F.array_join(F.transform(bits, lambda x: x.cast("string")), "")


def parse_yes_no(col: str | Column, mode: str = "substring") -> Column:
    """Free-text answer -> 1 / 0 / -1.

    ``substring``: contains 'yes' -> 1, else contains 'no' -> 0, else -1.
    ``prefix_first``: starts with 'yes'/'no' first, then the substring rule.
    """
    low = F.lower(_c(col))
    sub = F.when(F.instr(low, "yes") > 0, 1).when(F.instr(low, "no") > 0, 0).otherwise(-1)
    if mode == "substring":
        return sub
    if mode == "prefix_first":
        return F.when(low.startswith("yes"), 1).when(low.startswith("no"), 0).otherwise(sub)
    raise ValueError("mode must be substring or prefix_first")


def parse_label_list(col: str | Column, measure: str, form: str = "gold") -> Column:
    """Labels whose match text occurs in the lower-cased answer, in vector order.

    The match text of the two role labels is the ``the`` form.  Returns the
    gold spelling (``form='gold'``) or the ``the`` spelling (``form='the'``);
    an empty array means the answer is unusable.
    """
    low = F.lower(_c(col))
    vocab = labels_for(measure)
    out = (lambda v: v) if form == "gold" else the_form
    hits = [F.when(F.instr(low, the_form(v).lower()) > 0, F.lit(out(v))) for v in vocab]
    return F.array_compact(F.array(*hits))


def threshold_scores(arr: Column, t: float = 0.5) -> Column:
    """Per-label sigmoid(logit) >= t -> 1."""
    return F.transform(arr, lambda x: ((F.lit(1.0) / (F.lit(1.0) + F.exp(-x))) >= F.lit(t)).cast("int"))


def argmax_label(arr: Column) -> Column:
    """P13 binary form: 0-based position of the largest logit (first on ties)."""
    return (F.array_position(arr, F.array_max(arr)) - 1).cast("int")


def top_emotion(arr: Column) -> Column:
    """Label of the highest score in an ``ARRAY<STRUCT<label, score>>``; ties -> earlier entry."""
    ranked = F.transform(arr, lambda x, i: F.struct(x["score"].alias("s"), (-i).alias("ni"), x["label"].alias("label")))
    return F.array_max(ranked)["label"]


def emotion_ordinal(col: str | Column) -> Column:
    return F.array_position(F.array(*[F.lit(e) for e in EMOTIONS]), _c(col)).cast("int") - 1

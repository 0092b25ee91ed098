"""Label vocabulary for the manipulation annotation scheme.

The vocabulary is tiny and fixed, so operators turn it into literal arrays
(compiled into the generated code) or into a small broadcast table; it never
grows with the data.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

# --- fixed values (must equal the annotation scheme) -------------------------
# Techniques in vector order.
TECHNIQUES = [
    "Denial",
    "Evasion",
    "Feigning Innocence",
    "Rationalization",
    "Playing Victim Role",
    "Playing Servant Role",
    "Shaming or Belittlement",
    "Intimidation",
    "Brandishing Anger",
    "Accusation",
    "Persuasion or Seduction",
]
# Vulnerabilities in vector order.
VULNERABILITIES = [
    "Naivete",
    "Dependency",
    "Over-responsibility",
    "Over-intellectualization",
    "Low self-esteem",
]
# Second spelling of two technique names (gold form -> "the" form).
ALIASES = {
    "Playing Victim Role": "Playing the Victim Role",
    "Playing Servant Role": "Playing the Servant Role",
}
# Short codes, keyed by gold label.
SHORT_CODES = {
    "Denial": "DEN",
    "Rationalization": "RAT",
    "Feigning Innocence": "F_I",
    "Evasion": "EVA",
    "Intimidation": "INT",
    "Shaming or Belittlement": "S_B",
    "Accusation": "ACC",
    "Playing Victim Role": "VIC",
    "Playing Servant Role": "SER",
    "Persuasion or Seduction": "P_S",
    "Brandishing Anger": "B_A",
    "Over-responsibility": "O_R",
    "Over-intellectualization": "O_I",
    "Naivete": "NAT",
    "Low self-esteem": "L_S",
    "Dependency": "DEP",
}
# Emotion categories of the emotion classifier, in display order.
EMOTIONS = ["anger", "joy", "sadness", "fear", "love", "surprise"]
# -----------------------------------------------------------------------------

MEASURES = {"technique": TECHNIQUES, "vulnerability": VULNERABILITIES}


def labels_for(measure: str) -> list[str]:
    """Vector-order labels of a measure (``technique``/``tech`` or ``vulnerability``/``vul``)."""
    key = {"tech": "technique", "vul": "vulnerability"}.get(measure, measure)
    if key not in MEASURES:
        raise ValueError(f"unknown measure {measure!r}")
    return MEASURES[key]


def the_form(label: str) -> str:
    return ALIASES.get(label, label)


def gold_form(label: str) -> str:
    inverse = {v: k for k, v in ALIASES.items()}
    return inverse.get(label, label)


def vocab_array(measure: str) -> Column:
    """Vector-order labels as a literal ``ARRAY<STRING>``."""
    return F.array(*[F.lit(x) for x in labels_for(measure)])


def vocab_table(spark: SparkSession) -> DataFrame:
    """``(measure, ordinal, label, short_code, match_text, alias)`` - 16 rows."""
    rows = []
    for measure, labels in MEASURES.items():
        for i, label in enumerate(labels):
            rows.append((measure, i, label, SHORT_CODES[label], the_form(label).lower(), ALIASES.get(label)))
    return spark.createDataFrame(
        rows, "measure string, ordinal int, label string, short_code string, match_text string, alias string"
    )

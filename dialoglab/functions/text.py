"""Dialogue text scalars (P1-P5): built-in string/array expressions only."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .treebank import count_treebank

# --- fixed values --------------------------------------------------------------
PERSON_TAG = "<person>:"
SPEAKER_PATTERNS = [r"Person\d+:", r"Turn \d+:", r"utterance \d+:"]
# Literal tags removed before token counting / emotion scoring, per corpus style.
STRIP_TAGS = {
    "person": ["Person1: ", "Person2: "],
    "utterance": ["utterance 0: ", "utterance 1: "],
    "turn": ["Turn 0: ", "Turn 1: "],
}
STRIP_TAGS["all"] = STRIP_TAGS["person"] + STRIP_TAGS["utterance"] + STRIP_TAGS["turn"]
# Token rule (stated deviation from an NLTK word tokenizer): a run of
# letters/digits/underscore, or one other non-space character.
TOKEN_PATTERN = r"[\p{L}\p{N}_]+|[^\p{L}\p{N}_\s]"
# Speaker tag at the start of a line.
LINE_TAG_PATTERN = r"^((?:Person|Turn |utterance )\d+):\s?"
# ---------------------------------------------------------------------------------


def _c(col: str | Column) -> Column:
    return F.col(col) if isinstance(col, str) else col


def normalize_speakers(col: str | Column) -> Column:
    """Every speaker tag becomes ``<person>:``; untagged text gets the tag on every line."""
    out = _c(col)
    for p in SPEAKER_PATTERNS:
        out = F.regexp_replace(out, p, PERSON_TAG)
    # tag the start of the text and the start after every newline (also a
    # leading or trailing one), exactly like splitting on '\n' and prefixing
    # each piece; plain string replacement, no regex or lambda
    tag = PERSON_TAG + " "
    tagged_lines = F.concat(F.lit(tag), F.replace(out, F.lit("\n"), F.lit("\n" + tag)))
    return F.when(F.instr(out, PERSON_TAG) > 0, out).otherwise(tagged_lines)


def strip_speakers(col: str | Column, tags: str | Sequence[str] = "person") -> Column:
    """Delete literal speaker tags anywhere in the text."""
    tag_list = STRIP_TAGS[tags] if isinstance(tags, str) else list(tags)
    out = _c(col)
    for t in tag_list:
        out = F.replace(out, F.lit(t), F.lit(""))
    return out


def parse_turns(df: DataFrame, id_col: str = "id", text_col: str = "dialogue") -> DataFrame:
    """One row per line - ``(id, turn, speaker, text)``; speaker is '' when untagged."""
    lines = df.select(F.col(id_col).alias("id"), F.posexplode(F.split(F.col(text_col), "\n")).alias("turn", "line"))
    return lines.select(
        "id",
        "turn",
        F.regexp_extract("line", LINE_TAG_PATTERN, 1).alias("speaker"),
        F.regexp_replace("line", LINE_TAG_PATTERN, "").alias("text"),
    )


def tokens(col: str | Column) -> Column:
    return F.regexp_extract_all(_c(col), F.lit(TOKEN_PATTERN), 0)


def count_tokens(col: str | Column, rule: str = "runs") -> Column:
    """Number of word/punctuation tokens; ``rule="treebank"`` splits contractions and sentence ends (see ``treebank``).

    A token with the space before it becomes one letter (no space is left over except at the end), so the length of
    the result is the count and no array of tokens is built.
    """
    if rule == "treebank":
        return count_treebank(_c(col))
    if rule != "runs":
        raise ValueError("rule must be 'runs' or 'treebank'")
    text = F.regexp_replace(_c(col), r"\s*(?:" + TOKEN_PATTERN + ")", "x")
    return F.length(F.regexp_replace(text, r"\s+", "")).cast("bigint")


def truncate_tokens(col: str | Column, n: int, side: str = "first") -> Column:
    """P5: keep the first or last ``n`` whitespace tokens, re-joined with one space.

    A text of at most ``n`` tokens stays as it is, with its newlines.
    """
    words = F.regexp_extract_all(_c(col), F.lit(r"\S+"), 0)
    if side == "first":
        kept = F.slice(words, 1, n)
    elif side == "last":
        kept = F.slice(words, F.greatest(F.size(words) - F.lit(n), F.lit(0)) + F.lit(1), F.lit(n))
    else:
        raise ValueError("side must be 'first' or 'last'")
    return F.when(F.size(words) <= n, _c(col)).otherwise(F.array_join(kept, " "))


def count_lines(col: str | Column) -> Column:
    return F.size(F.split(_c(col), "\n")).cast("bigint")

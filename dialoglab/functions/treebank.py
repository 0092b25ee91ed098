"""P4 by Penn Treebank rules: words counted after contractions, punctuation and sentence ends are split off.

The rules are rewrites in a fixed order, each a regular expression; none looks around, so they mean the same in every engine.  Spark's
generated code finds the same tokens in fewer passes (``PASSES``).

Sentences end at ``.``, ``!`` or ``?`` before white space and a capital or digit, and at a line's end;
the period of an abbreviation or initial ends none, but for a line's last.  Only a sentence's last period is a token of its own,
runs of periods are one token, commas and colons before a digit stay in their number, ``’`` counts as an apostrophe.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# --- fixed values --------------------------------------------------------------
# Abbreviations whose period ends no sentence (a single capital is one, too).
ABBREVIATIONS = ["Mr", "Mrs", "Ms", "Dr", "Prof", "St", "Sr", "Jr", "Gen", "Rev", "Capt", "vs", "etc", "e.g", "i.e", "a.m", "p.m", "U.S", "U.K", "No"]
# Words that count as two.
JOINED = ["cannot", "gonna", "gotta", "wanna", "gimme", "lemme", "d'ye", "more'n"]
# Ends of words after an apostrophe that are tokens of their own; so is "n't".
CLITICS = ["s", "m", "d", "ll", "re", "ve"]
# ---------------------------------------------------------------------------------

SPACE = r" \t\r\f\x0B"  # in a class; newlines end sentences
_CLOSE = r"[)\]}>\"']*"
_KEPT = "\x01"  # a period that ends no sentence
_ONE = "\x02"  # a run of signs that is one token
_IN_NUMBER = "\x03"  # a comma or colon before a digit
_APOSTROPHE = "\x04"  # of a clitic


def _any_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


def _rules() -> list[tuple[str, str]]:
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    joined = (rf"([^\p{{L}}])(?:{'|'.join(f'[{w[0]}{w[0].upper()}]{w[1:]}' for w in JOINED)})([^\p{{L}}])", r"\1x x\2")
    clitic = (rf"([^'{SPACE}\n])(?:'({'|'.join(map(_any_case, CLITICS))})|([nN])'([tT]))([^\p{{L}}\p{{N}}_])",
              rf"\1 \3{_APOSTROPHE}\2\4\5")
    return [
        ("[’`]", "'"),
        (rf"([^\p{{L}}\p{{N}}])({short}|[A-Z])\.", rf"\1\2{_KEPT}"),
        (rf"{_KEPT}({_CLOSE}[{SPACE}]*\n)", r".\1"),
        (r"\.{2,}", f" {_ONE} "),
        (rf"([.!?])({_CLOSE})[{SPACE}]+([\"'(\[{{<]*[\p{{Lu}}\p{{N}}])", r"\1\2" + "\n" + r"\3"),
        (rf"\.({_CLOSE}[{SPACE}]*\n)", r" . \1"),
        (r"([,:])([0-9])", rf"{_IN_NUMBER}\2"),
        (r"([?!;@#%&$,:\[\](){}<>\"«»“”„])", r" \1 "),
        ("-{2,}", f" {_ONE} "),
        # a word at a rule's end may begin the next match, so these two go twice
        joined, joined, clitic, clitic,
        (rf"([{SPACE}\n])'([tT])(is|was)([^\p{{L}}])", r"\1x x\4"),
        (rf"([^{SPACE}\n])'+([{SPACE}\n])", r"\1 ' \2"),
        (rf"([{SPACE}\n])'+([^'{SPACE}\n])", r"\1 ' \2"),
    ]


RULES = _rules()


# --- the same rules for Spark, whose regular expressions can look around ---------
# RULES says what a token is and takes a pass over the text for each rule; these six passes find the same tokens.
_SIGNS = r"?!;@#%&$\[\](){}<>\"«»“”„"
_LINE_END = rf"[)\]}}>\"']*+[{SPACE}]*+\n"
_SENTENCE_END = rf"[)\]}}>\"']*+(?:[{SPACE}]*+\n|[{SPACE}]++[\"'(\[{{<]*+[\p{{Lu}}\p{{N}}])"
#: A letter beyond 16 bits: a pattern that has one looks back by whole characters.
_FAR = "\U0001d400"


def _abbreviation() -> str:
    """The period of an abbreviation, unless a line ends or the one before it was such a period."""
    short = "|".join(a.replace(".", r"\.") for a in ABBREVIATIONS)
    return rf"\.(?<=[^\p{{L}}\p{{N}}{_FAR}](?!\G)(?:{short}|[A-Z])\.)(?!{_LINE_END})"


def _joined() -> str:
    first = "".join(sorted({w[0] + w[0].upper() for w in JOINED}))
    rest = "|".join(rf"{w[1:]}(?<=[^\p{{L}}{_FAR}][{w[0]}{w[0].upper()}]{w[1:]})" for w in JOINED)
    return rf"([{first}])(?:{rest})(?!\p{{L}})"


def _clitic() -> str:
    """A clitic and the sign behind it; the sign that the last match ended with can't be the one before it."""
    before = rf"[^'{SPACE}\n{_SIGNS},:](?<!--)(?<!\.\.)(?!\G)"
    own = "|".join(map(_any_case, CLITICS))
    return rf"(?=['nN])(?:'(?<={before}')({own})|([nN])'(?<={before}[nN]')([tT]))([^\p{{L}}\p{{N}}_])"


def _apart() -> str:
    """Signs that are tokens, and apostrophes at a word's end, alone and before a word."""
    signs = rf"\.(?:\.+|(?={_SENTENCE_END}))|[{_SIGNS}]|[,:](?![0-9])|-{{2,}}"
    end = rf"(?=[{SPACE}\n]|{signs})"
    no_word = rf"[{SPACE}\n{_SIGNS},:]|--|\.\.|\.(?={_SENTENCE_END})"
    return rf"(?=[{_SIGNS}.,:'\-])(?:{signs}|'(?:(?<!(?:{no_word})')'*+{end}|(?<=(?:{no_word})')(?:(?='*+{end})|'*+)))"


_CLITIC = (_clitic(), rf" {_APOSTROPHE}$2$1$3$4")
PASSES = [("[’`]", "'"), (_abbreviation(), _KEPT), (_joined(), "$1x x"), _CLITIC, _CLITIC, (_apart(), " $0 ")]


def treebank_text(col: Column) -> Column:
    """The text with its tokens set apart by white space (some of them are replaced by others)."""
    # a sign of the text's own that stands where the rules' period of an abbreviation would count as one
    own = F.regexp_replace(col, rf"{_KEPT}(?=[)\]}}>\"'’`]*+[{SPACE}]*+(?:\n|\z))", ".")
    out = F.concat(F.lit("\n"), F.when(F.instr(col, _KEPT) > 0, own).otherwise(col), F.lit("\n"))
    for pattern, by in PASSES:
        out = F.regexp_replace(out, pattern, by)
    return out


def count_treebank(col: str | Column) -> Column:
    """Number of tokens; NULL for NULL, 0 for a text of white space."""
    text = F.regexp_replace(treebank_text(F.col(col) if isinstance(col, str) else col), rf"[^{SPACE}\n]+", "x")
    return F.length(F.regexp_replace(text, rf"[{SPACE}\n]+", "")).cast("bigint")

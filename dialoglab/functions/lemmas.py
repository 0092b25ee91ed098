"""English words to their base forms: irregular forms, then suffix rules found by the longest suffix.

The rules follow spelling alone (plural and third person *-s*, past *-ed*, participle *-ing*); they know no parts of speech, so
``lemma("meeting")`` is ``meet``.  Words that no rule fits stay as they are, and ``extra`` overrides both tables.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Mapping

# --- fixed values: irregular forms, base form first ---
IRREGULAR = """
be am is are was were been being
have has had having
do does did done
go goes went gone
say said
get got gotten
make made
know knew known
think thought
take took taken
see saw seen
come came
give gave given
find found
tell told
feel felt
become became
leave left
mean meant
keep kept
begin began begun
show shown
hear heard
run ran
hold held
bring brought
write wrote written
sit sat
stand stood
lose lost
pay paid
meet met
speak spoke spoken
send sent
build built
fall fell fallen
buy bought
teach taught
catch caught
choose chose chosen
understand understood
break broke broken
spend spent
drive drove driven
eat ate eaten
forget forgot forgotten
forgive forgave forgiven
lie lied lying
die died dying
hide hid hidden
win won
sell sold
fight fought
seek sought
steal stole stolen
wear wore worn
child children
man men
woman women
person people
"""
# --------------------------------------------------------
_FORMS = {form: line.split()[0] for line in IRREGULAR.strip().splitlines() for form in line.split()}

_VOWEL = re.compile("[aeiouy]")
#: Stems that lost an e: one vowel and one consonant (hop-, mak-), or an ending that English spells with a silent e.
_SHORT = re.compile(r"^[^aeiouy]*[aeiouy][^aeiouywx]$")
_SILENT = re.compile(r"(?:[aeiou]v|[^aeiou]l(?<!ll)(?<!rl)|[aeiou]s|(?:ch|r)ang|[rd]g|[aeiouns]c|[^aeiou]u|iz|[^aeo]at|[aeiou]us|eas|rs|ns|ee)$")
_DOUBLED = re.compile(r"([bdgmnprt])\1$")


def _base(stem: str) -> str:
    if _DOUBLED.search(stem):
        return stem[:-1]
    return stem + "e" if _SHORT.match(stem) or _SILENT.search(stem) and not stem.endswith("ee") else stem


def _past(word: str) -> str:
    stem = word[:-2]
    return _base(stem) if _VOWEL.search(stem) else word


def _agreed(word: str) -> str:
    return word[:-1] if len(word) > 5 else word


def _participle(word: str) -> str:
    stem = word[:-3]
    return _base(stem) if len(stem) > 1 and _VOWEL.search(stem) else word


def _y(n: int) -> Callable[[str], str]:
    return lambda word: word[:-n] + "y" if len(word) > n + 1 else word


def _cut(n: int) -> Callable[[str], str]:
    return lambda word: word[:-n]


def _stays(word: str) -> str:
    return word


#: Suffix rules; a trie of the reversed suffixes finds the longest one that fits.
RULES: dict[str, Callable[[str], str]] = {
    "ies": _y(3), "ied": _y(3), "sses": _cut(2), "shes": _cut(2), "ches": _cut(2), "xes": _cut(2), "zzes": _cut(2), "oes": _cut(2),
    "ss": _stays, "us": _stays, "is": _stays, "s": _cut(1), "eed": _agreed, "ceed": _stays, "ed": _past, "ing": _participle, "thing": _stays,
}


def _trie(rules: Mapping[str, Callable[[str], str]]) -> dict:
    root: dict = {}
    for suffix, rule in rules.items():
        node = root
        for c in reversed(suffix):
            node = node.setdefault(c, {})
        node[""] = rule
    return root


_SUFFIXES = _trie(RULES)


def lemma(word: str, extra: Mapping[str, str] | None = None) -> str:
    """Base form of a lower-case word."""
    if extra and word in extra:
        return extra[word]
    if word in _FORMS:
        return _FORMS[word]
    if len(word) < 4:
        return word
    node, rule = _SUFFIXES, None
    for c in reversed(word):
        node = node.get(c)
        if node is None:
            break
        rule = node.get("", rule)
    return rule(word) if rule else word

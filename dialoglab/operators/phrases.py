"""Key-phrase matching.

A phrase matches a dialogue when it occurs as whole words in the
normalised text (lower case, every run of non letters/digits -> one
space).  Each dialogue tests the (parameter-sized, size-checked) phrase list and only the
hits leave the row.  Counting is a hash aggregate with map-side partials,
so a phrase that occurs in most dialogues is no hot spot.

Lemmatised phrases ("who pay you") are compared with the base forms of a text's words, and a list of any length is
searched for with a word automaton: goto and failure links over the phrases' words, so a text is read once however many
phrases there are.  Its size is bounded; a longer list comes in parts dealt by hash, each with a pass of its own over the texts.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.lemmas import lemma
from ..session import scratch_path

NON_WORD = r"[^\p{L}\p{N}]+"


def normalize_text(col: str | Column) -> Column:
    c = F.col(col) if isinstance(col, str) else col
    return F.trim(F.regexp_replace(F.lower(c), NON_WORD, " "))


def word_ngrams(norm: Column, n: int) -> Column:
    """All word n-grams of a normalised text (single spaces), without lambdas.

    A regex match cannot overlap, so pass ``k`` (0 <= k < n) drops the first
    ``k`` words and extracts the non-overlapping n-grams from there; the
    passes together hold every n-gram.  Everything stays in JVM regex code.
    """
    if n == 1:
        return F.split(norm, " ")
    gram = r"[^ ]+" + r"(?: [^ ]+)" * (n - 1)
    passes = []
    for k in range(n):
        t = norm if k == 0 else F.regexp_replace(norm, r"^(?:[^ ]+ ){" + str(k) + "}", "")
        passes.append(F.regexp_extract_all(t, F.lit(gram), 0))
    return F.concat(*passes)


#: Up to so many phrases, one substring test each is cheaper than n-grams; beyond MAX_PHRASES the automaton takes over.
FEW_PHRASES, MAX_PHRASES = 256, 20_000
#: Phrases of one automaton, which each Python worker holds (about 250 bytes a word).
AUTOMATON_PHRASES = 200_000


class Automaton:
    """Finds every phrase of a list in a sequence of words (goto, failure and output links)."""

    def __init__(self, phrases: list[list[str]]):
        #: the next nodes of each node by word; nodes without any share one dictionary
        self.goto: list[dict[str, int]] = [{}]
        self.fail, ends = [0], [-1]
        no_next: dict[str, int] = {}
        same: dict[str, str] = {}
        depth_first: list[list[tuple[int, int, str]]] = []
        for k, phrase in enumerate(phrases):
            node = 0
            for d, word in enumerate(phrase):
                nxt = self.goto[node].get(word)
                if nxt is None:
                    nxt, word = len(ends), same.setdefault(word, word)
                    if self.goto[node] is no_next:
                        self.goto[node] = {}
                    self.goto[node][word] = nxt
                    self.goto.append(no_next)
                    ends.append(-1)
                    self.fail.append(0)
                    if d == len(depth_first):
                        depth_first.append([])
                    depth_first[d].append((nxt, node, word))
                node = nxt
            if node:
                ends[node] = k
        self.ends = ends
        #: the next shorter phrase that ends where a node's words end, and the longest
        self.shorter, self.longest = [0] * len(ends), [0] * len(ends)
        for level in depth_first:
            for node, parent, word in level:
                if parent:
                    self.fail[node] = self._step(self.fail[parent], word)
                f = self.fail[node]
                self.shorter[node] = f if ends[f] >= 0 else self.shorter[f]
                self.longest[node] = node if ends[node] >= 0 else self.shorter[node]

    def _step(self, node: int, word: str) -> int:
        while True:
            nxt = self.goto[node].get(word)
            if nxt is not None:
                return nxt
            if not node:
                return 0
            node = self.fail[node]

    def find(self, words: list[str]) -> set[int]:
        """Places in the list of all phrases that occur."""
        goto, fail, longest, ends = self.goto, self.fail, self.longest, self.ends
        met: set[int] = set()
        node, here = 0, goto[0]
        for word in words:
            nxt = here.get(word)
            while nxt is None and node:
                node = fail[node]
                nxt = goto[node].get(word)
            node = nxt or 0
            here = goto[node]
            if longest[node]:
                met.add(longest[node])
        found: set[int] = set()
        for at in met:
            while at and ends[at] not in found:  # behind a phrase that was met the shorter ones were, too
                found.add(ends[at])
                at = self.shorter[at]
        return found


@lru_cache(maxsize=1 << 18)
def _known_lemma(word: str) -> str:
    return lemma(word)


def _base_forms(extra: Mapping[str, str] | None):
    extra = dict(extra or {})
    return lambda word: extra[word] if word in extra else _known_lemma(word)


def _stored(df: DataFrame, name: str, *parts: str) -> DataFrame:
    """Written to the shared folder and read again."""
    path = scratch_path(df.sparkSession, name)
    df.write.partitionBy(*parts).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def first_words(col: str | Column, n: int) -> Column:
    """The first ``n`` words of the normalised text, without normalising the rest of it."""
    c = F.lower(F.col(col) if isinstance(col, str) else col)
    word = r"[\p{L}\p{N}]+"
    return normalize_text(F.regexp_extract(c, f"^{NON_WORD[:-1]}*{word}(?:{NON_WORD}{word}){{0,{n - 1}}}", 0))


def automaton_phrases(df: DataFrame, phrases: DataFrame, text_col: str, id_col: str, phrase_col: str, lemmas: bool,
                      extra: Mapping[str, str] | None = None, most: int = AUTOMATON_PHRASES) -> DataFrame:
    """``(id, phrase)`` by the automaton: a list of any length, at most about ``most`` phrases at a time."""
    spark = df.sparkSession
    listed = phrases.select(F.col(phrase_col).alias("phrase"), normalize_text(phrase_col).alias("_p")).where("_p <> ''").distinct()
    texts = df.select(F.col(id_col).alias("id"), normalize_text(text_col).alias("_t"))
    listed = _stored(listed, "phrases")  # made once: a list may come from the texts themselves
    parts = max(1, -(-listed.count() // most))
    if parts > 1:  # read once, not once for each part
        listed = listed.withColumn("part", F.pmod(F.xxhash64("phrase"), F.lit(parts)))
        listed, texts = _stored(listed, "phrases", "part"), _stored(texts, "texts")
    kind = texts.schema["id"].dataType.simpleString()
    out = None
    for k in range(parts):
        own = listed if parts == 1 else listed.where(F.col("part") == k)
        rows = [(r.phrase, r["_p"]) for r in own.select("phrase", "_p").collect()]  # at most about ``most``
        found = texts.mapInArrow(_finder(spark.sparkContext.broadcast(rows), lemmas, extra), f"id {kind}, phrase string")
        out = found if out is None else out.unionByName(found)
    return out


def _finder(shared, lemmas: bool, extra: Mapping[str, str] | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = _base_forms(extra) if lemmas else None
        words_of = lambda t: list(map(base, t.split(" "))) if base else t.split(" ")
        forms: dict[tuple, list[str]] = {}
        for phrase, norm in shared.value:
            forms.setdefault(tuple(words_of(norm)), []).append(phrase)
        given = list(forms.values())
        automaton = Automaton([list(x) for x in forms])
        for b in batches:
            at, names = [], []
            for i, t in enumerate(b.column(1).to_pylist()):
                if t:
                    for k in automaton.find(words_of(t)):
                        at += [i] * len(given[k])
                        names += given[k]
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(names, pa.string())], ["id", "phrase"])

    return run


def dialogue_phrases(df: DataFrame, phrases: DataFrame, text_col: str = "dialogue", id_col: str = "id",
                     phrase_col: str = "phrase", lemmas: bool = False, extra: Mapping[str, str] | None = None) -> DataFrame:
    """``(id, phrase)`` for every phrase found in a dialogue (each pair once, however often the list repeats it).

    The text is normalised once.  A short list becomes one substring test for each phrase in a generated
    projection; a longer one is intersected with the text's n-grams of the lengths that occur; more than ``MAX_PHRASES``
    are searched for with the automaton.  With ``lemmas`` the automaton compares base forms
    (:mod:`dialoglab.functions.lemmas`; ``extra`` adds forms), so "who pay you" finds "who paid you".
    """
    if lemmas:
        return automaton_phrases(df, phrases, text_col, id_col, phrase_col, True, extra)
    listed = phrases.select(F.col(phrase_col).alias("phrase"), normalize_text(phrase_col).alias("_p")).distinct()
    listed = [tuple(r) for r in listed.filter("_p <> ''").limit(MAX_PHRASES + 1).collect()]
    if len(listed) > MAX_PHRASES:
        return automaton_phrases(df, phrases, text_col, id_col, phrase_col, False)
    forms: dict[str, list[str]] = {}
    for phrase, norm in sorted(listed):
        forms.setdefault(norm, []).append(phrase)
    w = df.select(F.col(id_col).alias("id"), normalize_text(text_col).alias("_t"))
    if len(forms) <= FEW_PHRASES:
        w = w.withColumn("_t", F.concat(F.lit(" "), "_t", F.lit(" ")))
        tests = [F.when(F.contains(F.col("_t"), F.lit(f" {p} ")), F.lit(p)) for p in forms]
        found = F.array_compact(F.array(*tests)) if tests else F.array().cast("array<string>")
    else:
        lengths = sorted({p.count(" ") + 1 for p in forms})
        grams = F.concat(*[word_ngrams(F.col("_t"), n) for n in lengths])
        found = F.array_intersect(grams, F.lit(list(forms)))
    hits = w.select("id", F.explode(found).alias("_p"))
    if all(v == [k] for k, v in forms.items()):  # phrases are given in normal form
        return hits.select("id", F.col("_p").alias("phrase"))
    as_given = F.create_map(*[x for k, v in forms.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return hits.select("id", F.explode(F.element_at(as_given, F.col("_p"))).alias("phrase"))


def match_key_phrases(df: DataFrame, phrases: DataFrame, text_col: str = "dialogue", id_col: str = "id",
                      phrase_col: str = "phrase", lemmas: bool = False, extra: Mapping[str, str] | None = None) -> DataFrame:
    """For every distinct phrase, the number of dialogues containing it (0 when none)."""
    hits = dialogue_phrases(df, phrases, text_col, id_col, phrase_col, lemmas, extra)
    counts = hits.groupBy("phrase").agg(F.count(F.lit(1)).cast("bigint").alias("n_dialogues"))
    return phrases.select(F.col(phrase_col).alias("phrase")).distinct().join(counts, "phrase", "left").select(
        "phrase", F.coalesce("n_dialogues", F.lit(0)).cast("bigint").alias("n_dialogues"))

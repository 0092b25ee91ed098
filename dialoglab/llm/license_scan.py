"""Licence scans with a trained paragraph classifier.

* Paragraph: a line of a text.  Features: its word 1-grams and 2-grams (lower case, edges stripped of punctuation by the
  hash of ``_plain``), hashed to 2^16 columns, counted once each.
* Model: multinomial logistic regression over the licence families and ``unknown``, fitted on at most ``TRAIN_ROWS`` rows:
  variants of the templates below (words dropped, swapped in case, set among other words) and, as ``unknown``, sentences that
  merely speak of licences and the paragraphs of at most ``SAMPLE_DOCS`` documents of at most ``SAMPLE_CHARS`` characters (the
  smallest hashes of doc_id; paragraphs with a template's 3-grams are left out).  A third of the rows is held out.
* Calibration on the held-out rows: a temperature (least log loss), then the lowest threshold at which at most
  ``FALSE_RATE`` of the held-out ``unknown`` rows are given a family.  Below the threshold a paragraph is ``unknown``.
* Confirmation: a predicted family stands if at least ``COVERAGE`` of the word 2-grams of one of its templates are in
  the paragraph.
* Wrapped notices: lines next to each other that aren't blank are joined, without what stands around their words (comment marks).
  Where at least ``COVERAGE`` of a template's 2-grams lie in a stretch of at most ``STRETCH`` times its words that runs over a
  line's end, and one of them is in no other family's templates (``released / under the`` alone names none), the stretch is
  classified like a paragraph; it stands if it is given the template's family.  However many lines a notice is wrapped to, it is found.  Lines of a wrapped notice count as its parts: as paragraphs of their own they aren't
  found if unconfirmed, and a line confirmed with less coverage as another family must be so by its other words.

Every paragraph of every document is scored, a chunk of texts at a time; the model (4 MB) is broadcast.

Defined cases: NULL or empty text has one empty paragraph, which is unknown; a document with several licences
gets them all, sorted; repeated rows are scanned alike; an empty table fits on the templates alone and gives an empty result;
other columns are never read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import SPACE_BYTES, Words, chunks, mix, utf8

COLUMNS = 1 << 16
TRAIN_ROWS = 8_000
SAMPLE_DOCS, SAMPLE_CHARS = 400, 20_000
VARIANTS = 60
FALSE_RATE = 0.001
COVERAGE = 0.6
STRETCH = 2
UNKNOWN = "unknown"

# Notices by which licences are named or granted, by family.
TEMPLATES = {
    "agpl": ["This work is licensed under the GNU Affero General Public License, version 3.",
             "Licensed under the GNU AGPL v3.",
             "You can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by "
             "the Free Software Foundation."],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0.",
                   "Released under the Apache License 2.0.",
                   "Licensed under the Apache License, Version 2.0; you may not use this file except in compliance with the License."],
    "bsd": ["Released under the BSD License.",
            "Licensed under the 3-Clause BSD License.",
            "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the "
            "following conditions are met."],
    "cc-by": ["Licensed under CC BY 4.0.",
              "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.",
                 "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.",
                 "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["Released under CC0 1.0.",
            "To the extent possible under law, the author has waived all copyright and related rights to this work."],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.",
            "Licensed under the GNU GPL v2.",
            "You can redistribute it and/or modify it under the terms of the GNU General Public License as published by the "
            "Free Software Foundation."],
    "isc": ["Released under the ISC License.",
            "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."],
    "lgpl": ["This work is licensed under the GNU Lesser General Public License, version 3.",
             "Licensed under the GNU LGPL v2.1.",
             "You can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by "
             "the Free Software Foundation."],
    "mit": ["Released under the MIT License.",
            "Licensed under the MIT License.",
            "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files."],
    "mpl-2.0": ["Licensed under the Mozilla Public License, Version 2.0.",
                "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "unlicense": ["Released under the Unlicense.",
                  "This is free and unencumbered software released into the public domain."],
}

#: Sentences that speak of licences, or use their words, and grant nothing.
OTHER = [
    "He lost his driving license last year.", "A license fee is due every March.", "The MIT campus lies on the river.",
    "Apache helicopters flew over the base.", "The general public was not admitted.", "She works in the public domain of law.",
    "The version 2.0 of the game was released under great pressure.", "This work is long and the terms are hard.",
    "Permission to enter was granted to nobody.", "The source of the river lies under the hill.",
    "The GNU is an antelope.", "Creative people share in common what they make.", "The software is subject to change.",
    "Free of charge to any person over sixty.", "The BSD is short for something else here.",
    "All rights reserved.", "See the license for details.", "You need a license to fish in this lake.",
    "Mozilla met the press in version 2.0 of its plan.", "The license of the bar was withdrawn.",
    "Licensed premises close at ten.", "The book was released under a false name.", "Attribution of the painting is open.",
    "Terms and conditions apply.", "Licensed under the terms agreed with the buyer.",
]


def _grams(w: Words) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of the word 1-grams and 2-grams, each once for a text."""
    two, at = w.grams(2)
    text = np.concatenate((w.doc, w.doc[at]))
    h = np.concatenate((w.hashes, two))
    order = np.lexsort((h, text))
    text, h = text[order], h[order]
    new = np.concatenate(([True], (h[1:] != h[:-1]) | (text[1:] != text[:-1]))) if len(h) else np.empty(0, bool)
    return text[new], h[new]


_DROP = bytes.maketrans(b".,;:!?()[]\"'", b" " * 12)


def _plain(text: bytes) -> bytes:
    """Without punctuation, so that ``License.`` and ``License,`` are one word."""
    return text.translate(_DROP)


def _columns(h: np.ndarray) -> np.ndarray:
    return (mix(h) % np.uint64(COLUMNS)).astype(np.int64)


@dataclass
class Model:
    families: list[str]
    weights: np.ndarray  # COLUMNS x (families + unknown), float32
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.5

    def probabilities(self, paragraphs: list[bytes]) -> np.ndarray:
        text, h = _grams(Words([_plain(p) for p in paragraphs], lower=True))
        score = np.tile(self.bias, (len(paragraphs), 1))
        if len(h):
            first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
            score[text[first]] += np.add.reduceat(self.weights[_columns(h)], first, axis=0)
        return _softmax(score / self.temperature)

    def predict(self, paragraphs: list[bytes]) -> list[tuple[str, float]]:
        """(family or ``unknown``, calibrated probability) of each paragraph."""
        p = self.probabilities(paragraphs)
        best = p[:, :-1].argmax(axis=1)
        top = p[np.arange(len(p)), best]
        return [(self.families[b] if x >= self.threshold else UNKNOWN, float(x)) for b, x in zip(best.tolist(), top, strict=True)]


def _softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _shape(paragraph: str, rng: np.random.Generator, filler: list[str]) -> str:
    """A variant of a template: words dropped or in another case, set among other words."""
    words = paragraph.split()
    if len(words) > 6:
        words = [w for w in words if rng.random() > 0.08]
    style = rng.integers(4)
    words = [w.upper() for w in words] if style == 0 else [w.lower() for w in words] if style == 1 else words
    around = lambda: list(rng.choice(filler, rng.integers(0, 12))) if filler and rng.random() < 0.5 else []
    return " ".join([*around(), *words, *around()])


def train(unlabelled: list[str], seed: int = 7) -> Model:
    """Fit and calibrate on the templates, ``OTHER`` and paragraphs taken for ``unknown``."""
    rng = np.random.default_rng(seed)
    marks = {tuple(w[i : i + 3]) for t in TEMPLATES.values() for x in t for w in [_plain(x.lower().encode()).split()] for i in range(len(w) - 2)}

    def clean(p: str) -> bool:
        w = _plain(p.lower().encode()).split()
        return bool(w) and not any(tuple(w[i : i + 3]) in marks for i in range(len(w) - 2))

    plain = [p for p in unlabelled if clean(p)]
    filler = sorted({w for p in plain[:200] for w in p.split()}) or ["the", "of", "and"]
    families = sorted(TEMPLATES)
    rows = [(_shape(t, rng, filler), k) for k, f in enumerate(families) for t in TEMPLATES[f] for _ in range(VARIANTS)]
    rows += [(t, k) for k, f in enumerate(families) for t in TEMPLATES[f]]
    rows += [(_shape(o, rng, filler), len(families)) for o in OTHER for _ in range(VARIANTS // 3)]
    rows += [(p, len(families)) for p in plain[: TRAIN_ROWS - len(rows)]]
    order = rng.permutation(len(rows))
    held = order[: len(rows) // 3]
    fitted = np.setdiff1d(order, held)
    x = [r[0].encode() for r in rows]
    y = np.array([r[1] for r in rows])
    model = _fit([x[i] for i in fitted], y[fitted], families)

    # calibration on the rows held out
    raw = np.log(np.maximum(model.probabilities([x[i] for i in held]), 1e-30))
    loss = {t: -np.log(np.maximum(_softmax(raw / t)[np.arange(len(held)), y[held]], 1e-30)).mean() for t in np.geomspace(0.25, 4, 17)}
    model.temperature = float(min(loss, key=loss.get))
    p = _softmax(raw / model.temperature)
    other = np.sort(p[y[held] == len(families)][:, :-1].max(axis=1))
    spare = int(FALSE_RATE * len(other))
    model.threshold = float(max(0.5, np.nextafter(other[len(other) - 1 - spare], 1) if len(other) else 0.5))
    return model


def _fit(texts: list[bytes], y: np.ndarray, families: list[str], steps: int = 80, rate: float = 0.3, decay: float = 1e-4) -> Model:
    """Full-batch gradient steps (Adam) over the columns that occur."""
    text, h = _grams(Words([_plain(t) for t in texts], lower=True))
    used, col = np.unique(_columns(h), return_inverse=True)
    k = len(families) + 1
    by_col = np.argsort(col, kind="stable")
    col_start = np.searchsorted(col[by_col], np.arange(len(used)))
    first = np.flatnonzero(np.concatenate(([True], text[1:] != text[:-1])))
    goal = np.zeros((len(texts), k))
    goal[np.arange(len(texts)), y] = 1
    w, b = np.zeros((len(used), k)), np.zeros(k)
    m, v = [np.zeros_like(w), np.zeros_like(b)], [np.zeros_like(w), np.zeros_like(b)]
    for step in range(1, steps + 1):
        score = np.tile(b, (len(texts), 1))
        score[text[first]] += np.add.reduceat(w[col], first, axis=0)
        miss = (_softmax(score) - goal) / len(texts)
        grads = [np.add.reduceat(miss[text][by_col], col_start, axis=0) + decay * w, miss.sum(axis=0)]
        for i, (param, g) in enumerate(zip((w, b), grads, strict=True)):
            m[i] = 0.9 * m[i] + 0.1 * g
            v[i] = 0.999 * v[i] + 0.001 * g * g
            param -= rate * (m[i] / (1 - 0.9**step)) / (np.sqrt(v[i] / (1 - 0.999**step)) + 1e-8)
    weights = np.zeros((COLUMNS, k), np.float32)
    weights[used] = w
    return Model(families, weights, b.astype(np.float32))


class Templates:
    """Word 2-grams of the templates, for the confirmation."""

    def __init__(self):
        self.grams = {f: [self._two(t.encode()) for t in ts] for f, ts in TEMPLATES.items()}
        self.all = [(f, t, len(_plain(x.encode()).split())) for f in self.grams for t, x in zip(self.grams[f], TEMPLATES[f], strict=True)]
        self.own = {f: set().union(*ts).difference(*[t for g in self.grams if g != f for t in self.grams[g]]) for f, ts in self.grams.items()}
        # hashes of all 2-grams, and which templates have them
        texts = [_plain(x.encode()) for f in self.grams for x in TEMPLATES[f]]
        w = Words(texts, lower=True)
        two, at = w.grams(2)
        self.hashes, col = np.unique(two, return_inverse=True)
        self.has = np.zeros((len(self.hashes), len(texts)), np.int32)
        self.has[col, w.doc[at]] = 1
        self.need = np.ceil(COVERAGE * self.has.sum(axis=0) - 1e-9)

    @staticmethod
    def _two(text: bytes) -> set[tuple[bytes, ...]]:
        w = _plain(text.lower()).split()
        return set(zip(w, w[1:], strict=False))

    def coverage(self, paragraph: bytes, family: str) -> float:
        own = self._two(paragraph)
        return max(len(own & t) / len(t) for t in self.grams[family])

    def candidates(self, blocks: list[bytes]) -> list[tuple[int, int]]:
        """(block, template) where enough of the template's 2-grams are in the block."""
        w = Words([_plain(b) for b in blocks], lower=True)
        two, at = w.grams(2)
        place = np.searchsorted(self.hashes, two)
        place[place == len(self.hashes)] = 0
        hit = np.flatnonzero(self.hashes[place] == two)
        if not len(hit):
            return []
        key = np.unique(w.doc[at[hit]] * len(self.hashes) + place[hit])
        block, gram = np.divmod(key, len(self.hashes))
        first = np.flatnonzero(np.concatenate(([True], block[1:] != block[:-1])))
        # a few blocks at a time: the table has a row for each hit
        out = []
        for i in range(0, len(first), 4096):
            f = first[i : i + 4096]
            end = first[i + 4096] if i + 4096 < len(first) else len(block)
            n = np.add.reduceat(self.has[gram[f[0] : end]], f - f[0], axis=0)
            out += [(int(block[f[r]]), int(t)) for r, t in zip(*np.nonzero(n >= self.need), strict=True)]
        return out


def stretches(words: list[bytes], grams: set[tuple[bytes, ...]], most: int) -> list[tuple[int, int]]:
    """(from, to) of stretches of at most ``most`` words with at least ``COVERAGE`` of the 2-grams: those with most
    of them first, then the shortest; none overlaps an earlier one."""
    at = [i for i, g in enumerate(zip(words, words[1:])) if g in grams]
    inside: dict[tuple[bytes, ...], int] = {}
    found, a = [], 0
    for i in at:
        g = (words[i], words[i + 1])
        inside[g] = inside.get(g, 0) + 1
        while True:  # leave what is too far away, or comes again
            h = (words[at[a]], words[at[a] + 1])
            if i + 2 - at[a] <= most and inside[h] == 1:
                break
            inside[h] -= 1
            if not inside[h]:
                del inside[h]
            a += 1
        if len(inside) >= COVERAGE * len(grams):
            found.append((-len(inside), i + 2 - at[a], at[a], i + 2))
    taken, out = bytearray(len(words)), []
    for _, n, start, end in sorted(found):
        if not any(taken[start:end]):
            taken[start:end] = b"\x01" * n
            out.append((start, end))
    return out


#: What is left out around a line's words in joined lines.
_AROUND = bytes(c for c in range(128) if not chr(c).isalnum())


def _blocks(lines: list[bytes]) -> Iterator[tuple[int, list[bytes]]]:
    """(first line, lines) of two or more neighbouring lines with words."""
    own, start = [], 0
    for k, line in enumerate([*lines, b""]):
        if line := line.strip(_AROUND):
            if not own:
                start = k
            own.append(line)
        else:
            if len(own) > 1:
                yield start, own
            own = []


def _wrapped(texts: list[list[bytes]], model: Model, templates: Templates) -> list[list[dict]]:
    """For each text's lines, the wrapped notices, as in ``scan`` with ``words`` by line: their first word, and the one after the last."""
    out: list[list[dict]] = [[] for _ in texts]
    blocks = [(i, start, own) for i, lines in enumerate(texts) if len(lines) > 1 for start, own in _blocks(lines)]
    if not blocks:
        return out
    maybe, spans = {}, []
    for b, t in templates.candidates([b" ".join(own) for _, _, own in blocks]):
        if b not in maybe:
            maybe = {b: [(w, k) for k, line in enumerate(blocks[b][2]) for w in _plain(line.lower()).split()]}  # blocks come in order
        words, line_of = [w for w, _ in maybe[b]], [k for _, k in maybe[b]]
        family, grams, n = templates.all[t]
        spans += [(b, family, words[a:z], line_of[a:z], line_of.index(line_of[a]), a)
                  for a, z in stretches(words, grams, STRETCH * n) if line_of[a] != line_of[z - 1] and not templates.own[family].isdisjoint(zip(words[a:z], words[a + 1 : z]))]
    if not spans:
        return out
    for (b, family, words, line_of, from_, a), (guess, prob) in zip(spans, model.predict([b" ".join(s[2]) for s in spans]), strict=True):
        if guess != family:
            continue
        i, start, _ = blocks[b]
        parts: dict[int, list[int]] = {}
        for at, k in enumerate(line_of):
            first = a - from_ if k == line_of[0] else 0
            place = parts.setdefault(start + k, [first, first])
            place[1] += 1
        out[i].append({"paragraph": start + line_of[0], "family": family, "probability": prob,
                       "coverage": templates.coverage(b" ".join(words), family), "confirmed": True, "words": parts})
    return out


def _together(lines: list[bytes], single: list[dict], wrapped: list[dict], templates: Templates) -> list[dict]:
    """The notices of single lines and the wrapped ones, without what is part of another."""
    out = {x["paragraph"]: x for x in single}
    kept: list[dict] = []
    for j in sorted(wrapped, key=lambda x: (-x["coverage"], x["paragraph"])):
        mine = j["words"]
        if any(k["family"] == j["family"] and k["words"].keys() & mine.keys() for k in kept):
            continue  # another template of the family
        if any(k in out and out[k]["confirmed"] and out[k]["family"] == j["family"] for k in mine):
            continue  # one of the lines says so already
        kept.append(j)
        for k, (a, z) in mine.items():
            x = out.get(k)
            if x is None:
                continue
            if not x["confirmed"]:
                del out[k]
            elif x["coverage"] < j["coverage"]:
                words = _plain(lines[k].strip(_AROUND).lower()).split()
                rest = max(templates.coverage(b" ".join(w), x["family"]) for w in (words[:a], words[z:]))
                if rest < COVERAGE:
                    del out[k]
    made = [*out.values(), *({n: v for n, v in j.items() if n != "words"} for j in kept)]
    return sorted(made, key=lambda x: (x["paragraph"], x["family"]))


def training_sample(docs: DataFrame) -> list[str]:
    """Paragraphs of a bounded, fixed sample of documents (see above); the only texts that reach the driver.

    Hashes alone are ranked (each task passes on at most SAMPLE_DOCS of them); then the texts up to the last one are read.
    """
    text = F.col("text").cast("string")
    rows = docs.select(F.xxhash64("doc_id").alias("h"), text.alias("text")).filter(F.length("text") <= SAMPLE_CHARS)
    first = rows.select("h").orderBy("h").limit(SAMPLE_DOCS).collect()
    if not first:
        return []
    # rows that share a doc_id: one of them, the least text
    chosen = rows.filter(F.col("h") <= first[-1].h).groupBy("h").agg(F.min("text").alias("text"))
    return [p for r in chosen.orderBy("h").collect() for p in r.text.split("\n")]


def scan(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, found: array of (paragraph, family, probability, coverage, confirmed) of the paragraphs given a family
    and of the wrapped notices, by their first line."""
    shared = docs.sparkSession.sparkContext.broadcast(model or train(training_sample(docs)))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    hit = pa.struct([("paragraph", pa.int64()), ("family", pa.string()), ("probability", pa.float64()),
                     ("coverage", pa.float64()), ("confirmed", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, templates = shared.value, Templates()
        for b in batches:
            texts = utf8(b.column(1))
            for a, z in chunks(texts):
                lines = [t.split(b"\n") for t in texts[a:z]]
                guess = iter(own.predict([p for ls in lines for p in ls]))
                found = []
                for ls in lines:
                    mine = []
                    for k, p in enumerate(ls):
                        family, prob = next(guess)
                        if family != UNKNOWN:
                            c = templates.coverage(p, family)
                            mine.append({"paragraph": k, "family": family, "probability": prob, "coverage": c, "confirmed": c >= COVERAGE})
                    found.append(mine)
                for k, notices in enumerate(_wrapped(lines, own, templates)):
                    if notices:
                        found[k] = _together(lines[k], found[k], notices, templates)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(a, z - a), pa.array(map(len, lines), pa.int64()),
                                                  pa.array(found, pa.list_(hit))], ["doc_id", "n_paragraphs", "found"])

    return rows.mapInArrow(run, f"doc_id {kind}, n_paragraphs bigint, found array<struct<paragraph:bigint,family:string,"
                                "probability:double,coverage:double,confirmed:boolean>>")


def license_report(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """doc_id, n_paragraphs, n_found (given a family), n_confirmed, families (confirmed, distinct, sorted), n_unconfirmed."""
    out = scan(docs, model)
    sure = F.filter("found", lambda x: x["confirmed"])
    return out.select("doc_id", "n_paragraphs", F.size("found").cast("long").alias("n_found"), F.size(sure).cast("long").alias("n_confirmed"),
                      F.array_sort(F.array_distinct(F.transform(sure, lambda x: x["family"]))).alias("families"),
                      (F.size("found") - F.size(sure)).cast("long").alias("n_unconfirmed"))

"""P5 by sub-words: a text is cut after (or before) a number of a model's tokens, and what stays is a substring of it.

Two kinds of models, both read by path or given as a list, so that no vocabulary is part of the library:

* ``truncate_pieces``: greedy longest match of a vocabulary's pieces, as word-piece models do.  Words are runs of what is neither white space
  nor punctuation, and single punctuation signs; a word is covered from the left by the longest piece of a trie, pieces
  inside a word being those marked ``##``.  A word that can't be covered, or is over ``MAX_WORD`` characters, is one token.
* ``truncate_model_tokens``: the tokens of any model file of the ``tokenizers`` library, cut at its character offsets; a character whose bytes
  lie in several tokens stays whole.

NULL stays NULL; a text of at most ``n`` tokens stays as it is.  Rows are handled where they are read, one Arrow batch at a time;
beside the vocabulary a task holds ``n`` offsets and the pieces of at most ``CACHE_WORDS`` recent words.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Callable, Iterable

import pyarrow as pa
import regex
from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

#: Characters of a word that is still cut into pieces.
MAX_WORD = 100
#: Pieces of a vocabulary (it is broadcast).
MAX_PIECES = 1 << 20
CACHE_WORDS = 1 << 16
#: Characters of the texts whose results are held as Python objects.
HELD_CHARS = 1 << 20
INSIDE = "##"
_WORD = regex.compile(r"[\p{P}$+<=>^`|~]|[^\p{P}$+<=>^`|~\p{White_Space}]+")
_END = ""  # key of a trie's node that ends a piece


class PieceTrie:
    """Pieces at a word's begin and inside a word, as two tries of nested dictionaries."""

    def __init__(self, pieces: Iterable[str]):
        self.first: dict = {}
        self.inside: dict = {}
        self.known: dict[str, tuple[int, ...]] = {}
        for p in pieces:
            node = self.inside if p.startswith(INSIDE) and len(p) > len(INSIDE) else self.first
            for c in p[len(INSIDE):] if node is self.inside else p:
                node = node.setdefault(c, {})
            node[_END] = True

    def ends(self, word: str) -> tuple[int, ...]:
        """Where the pieces of a word end; its length alone where it can't be covered."""
        found = self.known.get(word)
        if found is None:
            found = self._cover(word) if len(word) <= MAX_WORD else (len(word),)
            if len(self.known) >= CACHE_WORDS:
                self.known.clear()
            if len(word) <= MAX_WORD:
                self.known[word] = found
        return found

    def _cover(self, word: str) -> tuple[int, ...]:
        out: list[int] = []
        at, root = 0, self.first
        while at < len(word):
            node, longest = root, -1
            for i in range(at, len(word)):
                node = node.get(word[i])
                if node is None:
                    break
                if _END in node:
                    longest = i + 1
            if longest < 0:
                return (len(word),)
            out.append(longest)
            at, root = longest, self.inside
        return tuple(out)

    def spans(self, text: str):
        """(from, to) of every token."""
        for m in _WORD.finditer(text):
            a = m.start()
            for e in self.ends(m.group()):
                yield a, m.start() + e
                a = m.start() + e


def cut_spans(text: str, spans: Iterable[tuple[int, int]], n: int, side: str) -> str:
    """The part of ``text`` up to the end of token ``n``, or from the begin of the last token but ``n`` - 1."""
    if side == "first":
        end = 0
        for i, (_, z) in enumerate(spans):
            if i == n:
                return text[:end]
            end = max(end, z)
        return text
    last: deque[int] = deque(maxlen=n + 1)
    for a, _ in spans:
        last.append(a)
    if len(last) <= n:
        return text
    return text[last[1]:] if n else ""


def vocabulary_of(path: str) -> list[str]:
    """Pieces of a model file of the ``tokenizers`` library; byte-level ones are turned into marked ones (a leading space begins a word).

    Pieces that are no whole characters are left out.
    """
    from tokenizers import Tokenizer, decoders

    model = Tokenizer.from_file(path)
    vocab = sorted(model.get_vocab(with_added_tokens=False))
    if not isinstance(model.decoder, decoders.ByteLevel):
        return vocab
    texts = (model.decoder.decode([p]) for p in vocab)
    return sorted({t[1:] if t[0] == " " else INSIDE + t for t in texts if t.strip() and "�" not in t})


def _check(n: int, side: str) -> None:
    if side not in ("first", "last"):
        raise ValueError("side must be 'first' or 'last'")
    if n < 0:
        raise ValueError("n must not be negative")


_TRIES: dict[int, PieceTrie] = {}


def _shared_trie(shared) -> PieceTrie:
    if shared.id not in _TRIES:
        _TRIES.clear()  # an older one goes
        _TRIES[shared.id] = PieceTrie(shared.value)
    return _TRIES[shared.id]


class _Vocabulary:
    """A broadcast vocabulary with a number by which a worker knows that it has built the trie."""

    def __init__(self, pieces: Iterable[str]):
        pieces = list(dict.fromkeys(pieces))
        if len(pieces) > MAX_PIECES:
            raise ValueError(f"a vocabulary has at most {MAX_PIECES} pieces")
        self.shared = SparkSession.active().sparkContext.broadcast(pieces)
        self.id = hash(tuple(pieces))

    @property
    def value(self) -> list[str]:
        return self.shared.value


def _each(texts: pa.Array, one: Callable, kind: pa.DataType) -> pa.Array:
    """``one`` of each text.  One text at a time is a Python string, and results of few, however many an Arrow batch holds."""
    parts, held, size = [], [], 0
    for x in texts:
        t = x.as_py()
        held.append(None if t is None else one(t))
        size += len(t or "")
        if size >= HELD_CHARS:
            parts.append(pa.array(held, kind))
            held, size = [], 0
    return pa.concat_arrays([*parts, pa.array(held, kind)])


def truncate_pieces(col: str | Column, vocabulary: Iterable[str], n: int, side: str = "first") -> Column:
    """The first or last ``n`` pieces of a text, as a substring."""
    _check(n, side)
    pieces = _Vocabulary(vocabulary)

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        trie = _shared_trie(pieces)
        return _each(texts, lambda t: cut_spans(t, trie.spans(t), n, side), pa.string())

    return cut(col)


def count_pieces(col: str | Column, vocabulary: Iterable[str]) -> Column:
    """Number of pieces of a text."""
    pieces = _Vocabulary(vocabulary)

    @F.arrow_udf("bigint")
    def count(texts: pa.Array) -> pa.Array:
        trie = _shared_trie(pieces)
        return _each(texts, lambda t: sum(1 for _ in trie.spans(t)), pa.int64())

    return count(col)


_MODELS: dict = {}


def truncate_model_tokens(col: str | Column, path: str, n: int, side: str = "first") -> Column:
    """The first or last ``n`` tokens of a model file (on every executor at ``path``), as a substring."""
    _check(n, side)

    @F.arrow_udf("string")
    def cut(texts: pa.Array) -> pa.Array:
        from tokenizers import Tokenizer

        if path not in _MODELS:
            _MODELS[path] = Tokenizer.from_file(path)
            _MODELS[path].no_truncation()
            _MODELS[path].no_padding()
        model = _MODELS[path]
        return _each(texts, lambda t: cut_spans(t, model.encode(t, add_special_tokens=False).offsets, n, side), pa.string())

    return cut(col)

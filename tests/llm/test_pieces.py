"""Ids against the libraries on odd texts, whatever the order in which a worker meets them."""

import os
import random
import subprocess
import sys

import numpy as np
import pytest

from dialoglab.llm import bpe, pieces, token_files

vocab = pytest.importorskip("public_tokenizers")

ODD = ["-", "--", " -", "- ", "-the", " 12.", "12.", "\n", "\n\n", " ", "  ", "\t", "\r\n", "the", " The", "don't", "'LL", "...", "$%&", "é漢", "🙂", "​",
       "<|endoftext|>", "x" * 70, "antidisestablishmentarianism", *(c for c in pieces.WHITE if ord(c) > 127)]


def texts(seed, n):
    rng = random.Random(seed)
    words = [w for t in ODD for w in (t, t + "a", "b" + t)]
    return ["".join(rng.choice(words if rng.random() < 0.4 else [" ", "\n", *ODD]) for _ in range(rng.randint(0, 14))) for _ in range(n)]


def reference():
    import tiktoken
    from tokenizers import Tokenizer

    path = vocab.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    json = Tokenizer.from_file(vocab.path("byte_bpe_50k.json"))
    return own.encode_ordinary, lambda t: json.encode(t, add_special_tokens=False).ids


def encoders():
    return bpe.Encoder(vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN), token_files.Encoder(vocab.path("byte_bpe_50k.json"))


def differ(batches):
    """Texts whose ids differ from the libraries', by new encoders that see the batches in order."""
    (six, eight), (a, b) = encoders(), reference()
    out = []
    for some in batches:
        out += [t for t, ids in zip(some, six.encode(some), strict=True) if ids != a(t)]
        out += [t for t, ids in zip(some, eight.encode(some), strict=True) if ids[:-1].tolist() != b(t)]
    return out


def test_white_space_is_unicodes():
    assert len(pieces.WHITE) == 25 and all(c.isspace() for c in pieces.WHITE)


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(seed):
    own = texts(seed, 1200)
    assert not differ([own[i : i + 100] for i in range(0, len(own), 100)])


@pytest.mark.parametrize("batches", [[[" 12.", "-the"]], [["-the"], [" 12."]], [["foo\n"], ["a\n\n", "a\n\n\nb"]], [["a\n\n", "a\n\n\nb"], ["foo\n"]],
                                     [["- a\n- b\n- c", "--\n--"]], [["x -y", " - "]]])
def test_order_of_calls(batches):
    assert not differ(batches)
    assert not differ(batches[::-1])


@pytest.mark.parametrize("seed", ["0", "1", "7"])
def test_hash_seeds(seed):
    """The order of sets and dicts decides nothing."""
    code = "import test_pieces as t; bad = t.differ([t.texts(99, 300), t.texts(98, 300)]); assert not bad, bad[:3]"
    here = os.path.dirname(os.path.abspath(__file__))
    env = os.environ | {"PYTHONHASHSEED": seed, "PYTHONPATH": os.pathsep.join([here, os.path.dirname(os.path.dirname(here)), os.environ.get("PYTHONPATH", "")])}
    subprocess.run([sys.executable, "-c", code], check=True, env=env, cwd=here, timeout=300)


def test_trees_of_many_words_equal_one_tree():
    path = vocab.path("byte_bpe_multi_50k.tiktoken")
    ranks = bpe.load_ranks(path)
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdeéz漢 🙂tion") for _ in range(rng.choice((1, 2, 3, 5, 8, 9, 15, 16, 17, 30, 90)))).encode() for _ in range(3000)]
    words += [b"", b"a" * 500, b"ab" * 300, bytes(range(256))]
    got = bpe.Trees(ranks).merge(words)
    assert [list(memoryview(x).cast("i")) for x in got] == [bpe.merge_bytes(w, ranks) for w in words]


def test_a_token_over_two_runs_is_noticed():
    """Joined runs whose tokens don't end with the runs are encoded one by one."""
    eight = encoders()[1]
    want = [x for r in (" ab", "cd") for x in eight._each([r])]
    eight.joins = lambda run: True
    assert [list(memoryview(x).cast("I")) for x in eight._solve([" ab", "cd"])] == want


def test_old_entries_move_up_without_being_solved_again():
    asked = []

    def solve(runs):
        asked.extend(runs)
        return [r.encode() for r in runs]

    cache = pieces.PieceCache(solve, 3)
    for text in ("a b c d", "a b e", "a b a"):  # the second call turns the generations
        assert b"".join(cache.look_up([text])[0]) == text.encode()
    assert sorted(asked) == sorted(set(asked)) and cache.recent.new.keys() >= {"b"}


def test_pairs_are_found_by_hash_and_levels_agree_at_every_size():
    ranks = {bytes([i]): i for i in range(256)} | {b"ab": 256, b"abab": 257, b"ba": 258, b"aa": 259, b"abababab": 260}
    table = bpe.PairTable(ranks)
    keys = np.array([97 << 32 | 98, 98 << 32 | 98, 256 << 32 | 256, 257 << 32 | 257, 0], np.int64)
    known, rank = table.find(keys)
    assert known.tolist() == [True, False, True, True, False] and rank[known].tolist() == [256, 257, 260]
    words = [bytes(rng.choice([97, 98], n).tolist()) for n in (2, 5, 9, 16, 17, 31, 33, 70) for rng in [np.random.default_rng(n)] for _ in range(40)]
    got = bpe.Trees(ranks).merge(words)
    assert [np.frombuffer(x, "<i4").tolist() for x in got] == [bpe.merge_bytes(w, ranks) for w in words]


def test_plain_words_are_cut_as_the_pattern_cuts_them():
    vocab = pytest.importorskip("public_tokenizers")
    enc = bpe.Encoder(vocab.path("byte_bpe_multi_50k.tiktoken"), vocab.PATTERN)
    texts = ["it's it’s its' rock'n'roll", "a, (b) c... d!? e_f g-h i2 3j", " x  y\tz", "naïve café, Straße!", "'s 't ''s a''s", "a b, c　d;"]
    enc.merged.most = enc.cache.recent.most = 2
    for t in [*texts, " ".join(texts), *texts]:
        want = [i for w in enc.words.findall(t) for i in bpe.merge_bytes(w.encode(), enc.ranks)]
        assert enc.encode([t]) == [want]


def pieces_of(own):
    raw = [t.encode() for t in own]
    buf = np.frombuffer(b"".join(raw), np.uint8)
    at = pieces.cuts(buf, np.cumsum([0, *map(len, raw)]))
    return [buf[a:z].tobytes().decode() for a, z in zip(at[:-1], at[1:], strict=True)]


@pytest.mark.parametrize("space", pieces.WHITE)
def test_cuts_are_where_runs_begin(space):
    odd = [f"a{space} b\n{space}c é{space}\nà  d", f"{space} a", f"a {space}", "", " à b", "\n", f"漢{space}{space} 字 か", "a"]
    got = pieces_of(odd)
    assert "".join(got) == "".join(odd)
    for piece in got:
        runs = pieces._RUN.findall(piece)
        assert "".join(runs) == piece and not any(r[0] in " \n" for r in runs[1:])  # all of their cuts are found
    assert [p for t in odd for p in pieces_of([t])] == got  # a text's pieces don't depend on its neighbours
    for t in odd:  # a cut is never inside a run
        ends = {0, *np.cumsum([len(r) for r in pieces._RUN.findall(t)]).tolist()}
        assert {0, *np.cumsum([len(p) for p in pieces_of([t])]).tolist()} <= ends


def test_known_runs_are_found_without_python_objects(monkeypatch):
    """A run that is known, however often it stands in the texts, is looked up in arrays."""
    enc = token_files.Encoder(vocab.path("byte_bpe_50k.json"))
    asked = []
    monkeypatch.setattr(token_files.Encoder, "_look_up", lambda self, runs, f=token_files.Encoder._look_up: (asked.append(list(runs)), f(self, runs))[1])
    own = ["foo bar\nfoo bär bar", "bar foo bar"] * 50
    first = enc.encode(own)
    assert sorted(asked[0]) == [b"\nfoo", b" bar", " bär".encode(), b" foo", b"bar", b"foo"] and len(asked) == 1
    assert [x.tolist() for x in enc.encode(own)] == [x.tolist() for x in first] and len(asked) == 1


def test_small_tables_and_blocks(monkeypatch):
    """Runs with NUL, of 30 to 33 bytes, longer than a block; a table that turns over all the time."""
    monkeypatch.setattr(token_files, "FOUND_RUNS", 7)
    path = vocab.path("byte_bpe_50k.json")
    enc, (_, want) = token_files.Encoder(path), reference()
    enc.table = pieces.RunTable(10)
    own = ["a\0 a \0a a\0\0", "", *(" ".join(["é" * (n // 2) + "x" * (n % 2)] * 3) for n in range(28, 36)), "x" * 5000, "\n", "", *texts(5, 400)]
    for some in (own, own[::-1], own):
        assert [x.tolist() for x in enc.encode(some)] == [[*want(t), token_files.END_ID] for t in some]
        assert enc.table.n <= 10 + 7
    assert enc.encode([]) == [] and [x.tolist() for x in enc.encode([""])] == [[token_files.END_ID]]


def test_table_of_runs_keeps_what_is_found():
    rng = np.random.default_rng(3)
    table, known, missed = pieces.RunTable(1000), {}, 0
    for _ in range(200):
        runs = list(dict.fromkeys(bytes(rng.integers(0, 3, rng.integers(1, 32), dtype=np.uint8)) for _ in range(50))) + [b"often"]
        at = np.cumsum([0, *map(len, runs)])
        words = pieces.run_words(np.frombuffer(b"".join(runs), np.uint8), at[:-1], np.diff(at))
        table.turn()
        entry = table.find(words)
        for r, e in zip(runs, entry.tolist(), strict=True):
            assert e < 0 or table.ids[table.at[e] : table.at[e] + table.count[e]].tolist() == known[r]
        missed += int(entry[-1] < 0)
        new = np.flatnonzero(entry < 0)
        ids = [known.setdefault(runs[k], [len(known)] * rng.integers(1, 4)) for k in new]
        count = np.array([len(x) for x in ids], np.int64)
        first = table.append(np.concatenate([np.array(x, np.uint32) for x in [[], *ids]])) + np.cumsum(count) - count
        table.add(words[new], first, count)
    assert missed <= 10  # the first time, and when other runs took both of its slots

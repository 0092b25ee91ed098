"""Treebank counts (P4) against a plain version and by hand; sub-word cuts (P5) against the library's offsets."""

import random
import re

import pytest
import regex
from pyspark.sql import functions as F
from tokenizers import Tokenizer, models, pre_tokenizers

from conftest import SF_CHECK, SF_SMALL
from dialoglab.functions import subwords as SW
from dialoglab.functions import text as T
from dialoglab.functions import treebank as TB
from dialoglab.plans import fixtures as fx
from dialoglab.plans.catalog import QUERIES

# tokens set apart by blanks, and the text they come from
BY_HAND = [
    ("Good muffins cost $ 3.88 in New York .", "Good muffins cost $3.88 in New York."),
    ("Please buy me two of them . Thanks .", "Please buy me\ntwo of them. Thanks."),
    ("I ca n't believe it 's you ; they 'd 've called !", "I can't believe it's you; they'd've called!"),
    ("Dr. Smith met Mr. J. R. Jones at 5 p.m. on Monday .", "Dr. Smith met Mr. J. R. Jones at 5 p.m. on Monday."),
    ("They sell pens , etc .", "They sell pens, etc."),
    ("You x x pay , x x you ? I x x now .", "You gonna pay, wanna you? I gotta now."),
    ("x x x x", "gonna cannot"),
    ("Well .. I do n't know -- maybe", "Well... I don't know--maybe"),
    ("1,000 people at 10:30 , he said : yes", "1,000 people at 10:30, he said: yes"),
    ("` She said ` stop ' and left . `", "\"She said 'stop' and left.\""),
    ("The dogs ' bowl ( empty ) was John ’s", "The dogs' bowl (empty) was John’s"),
    ("no end here. or here", "no end here. or here"),
    ("x x fine , x x", "'Tis fine, 'twas"),
    ("", ""), ("", " \n\t "), (". ", "."), ("..", "...."), ("' '", "' '"),
]


def plain_count(text: str) -> int:
    """For texts of words, numbers and sentence signs: a word at a time, no rewriting."""
    total = 0
    for line in text.split("\n"):
        words = re.split(r"[ \t\r\f\v]+", line.strip(" \t\r\f\v"))
        for i, word in enumerate(words):
            if not word:
                continue
            following = words[i + 1] if i + 1 < len(words) else None
            parts = regex.findall(r"\.{2,}|-{2,}|[?!;@#%&$\[\](){}<>\"]|[,:](?![0-9])|(?:(?!\.{2}|-{2}|[?!;@#%&$\[\](){}<>\"]|[,:](?![0-9])).)+", word)
            total += len(parts)
            stem = parts[-1]
            if len(stem) > 1 and stem.endswith(".") and not stem.startswith(".."):
                short = regex.fullmatch(r"[^\p{L}\p{N}]*(?:[A-Z]|Mr|Mrs|Dr|etc)", stem[:-1]) and len(parts) == 1
                if following is None or (not short and regex.match(r"[\"'(\[{<]*[\p{Lu}\p{N}]", following)):
                    total += 1
    return total


@pytest.mark.parametrize("tokens,text", BY_HAND)
def test_treebank_by_hand(spark, tokens, text):
    got = spark.createDataFrame([(text,)], "x string").select(T.count_tokens("x", rule="treebank")).first()[0]
    assert got == len(tokens.split())


def test_treebank_on_conversations(spark):
    rows = fx.table(spark, SF_CHECK, "conversations").select("text", T.count_tokens("text", rule="treebank").alias("n")).collect()
    assert len(rows) > 100
    assert [r.n for r in rows] == [None if r.text is None else plain_count(r.text) for r in rows]
    with pytest.raises(ValueError):
        T.count_tokens("text", rule="other")


SIGNS_AND_WORDS = [
    "'", "'", "’", "`", "''", ".", ".", "..", "...", "-", "--", "---", ",", ":", "?", "!", ")", "(", '"', "”", "»", "<", "[", "}", "$", "@", "_",
    " ", " ", "  ", "\n", "\t", "\r", "\x0b", "\f", "s", "S", "m", "d", "ll", "LL", "re", "ve", "n", "N", "t", "T", "n't", "N'T", "'s", "'d", "'ve",
    "'tis", "'Twas", "cannot", "Cannot", "CANNOT", "gonna", "Gotta", "d'ye", "D’ye", "more'n", "Mr", "e.g", "e.g.", "U.S", "U.S.", "a.m.", "No.",
    "etc.", "J.", "R.", "A", "x", "word", "1", "23", "é", "É", "日本", "😀", "𝐀", "\u0301", "\x01", "\x02", "\x04", "½", "٣", "Dr.", "\x85",
]


def by_rules(col):
    """The rules one after the other, each as it is stated."""
    out = F.concat(F.lit("\n"), F.col(col), F.lit("\n"))
    for pattern, by in TB.RULES:
        out = F.regexp_replace(out, pattern, re.sub(r"\\([1-5])", r"$\1", by.replace("$", r"\$")))
    return F.size(F.regexp_extract_all(out, F.lit(rf"[^{TB.SPACE}\n]+"), 0))


def test_treebank_passes_keep_the_rules(spark):
    r = random.Random(11)
    texts = ["".join(r.choice(SIGNS_AND_WORDS) + r.choice(["", "", "", " "]) for _ in range(r.randint(0, 14))) for _ in range(8000)]
    texts += ["a's-'s-'dn't x", "xN'TN'TN'T", "J.R. U.S.A. X.U.S. No", "etc.\n", "a, ", "Mr\x01\n.\x01 \n", "a'b.c-d,e1" * 3000, "'" * 9000, "n't" * 4000, None]
    rows = spark.createDataFrame([(t,) for t in texts], "x string").select("x", T.count_tokens("x", rule="treebank").alias("n"), by_rules("x").alias("want"))
    assert [x for x in rows.collect() if x.n != (None if x.x is None else x.want)] == []


def test_treebank_takes_few_passes(spark):
    plan = spark.createDataFrame([("a",)], "x string").select(T.count_tokens("x", rule="treebank").alias("n"))._jdf.queryExecution().optimizedPlan()
    assert plan.toString().count("regexp_replace(") <= 9  # 18 with a pass for each rule


WORDS = ["un", "able", "affable", "believe", "ing", "the", "é", "日本", "x", "don't", "a.b", "$5", "q" * 101, "q" * 100, "naïve", "😀", " ", "—", "«oui»"]
PIECES = ["[UNK]", "un", "##able", "aff", "##a", "##ffable", "be", "##lie", "##ve", "##ing", "the", "é", "日", "##本", "x", "don", "'", "t", "a", ".", "b",
          "$", "5", "na", "##ï", "—", "oui", "«", "##", "q", "##q", "##qq"]


def random_texts(n: int) -> list[str]:
    r = random.Random(5)
    return ["".join(r.choice(WORDS) + r.choice(["", " ", "  ", "\n", "\t", ", "]) for _ in range(r.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize("side", ["first", "last"])
@pytest.mark.parametrize("n", [0, 1, 7, 20, 1000])
def test_pieces_match_the_library(spark, side, n):
    texts = random_texts(300) + ["", " ", "the"]
    model = Tokenizer(models.WordPiece({p: i for i, p in enumerate(PIECES)}, unk_token="[UNK]", max_input_chars_per_word=SW.MAX_WORD))
    model.pre_tokenizer = pre_tokenizers.BertPreTokenizer()
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, x string")
    out = {r.i: r for r in df.select("i", SW.truncate_pieces("x", PIECES, n, side).alias("t"), SW.count_pieces("x", PIECES).alias("n")).collect()}
    assert out[-1].t is None and out[-1].n is None
    for i, t in enumerate(texts):
        at = model.encode(t).offsets
        want = t if len(at) <= n else ("" if n == 0 else t[: at[n - 1][1]] if side == "first" else t[at[-n][0]:])
        assert (out[i].t, out[i].n) == (want, len(at)), t


def test_model_tokens(spark):
    import public_tokenizers as vocab

    path = vocab.path("byte_bpe_50k.json")
    model = Tokenizer.from_file(path)
    texts = ["The quick brown fox jumps over the lazy dog, doesn't it?", "😀日本 naïve", "", "short"] + random_texts(50)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(-1, None)], "i int, x string")
    for n in (0, 2, 5):
        rows = {r.i: r for r in df.select("i", SW.truncate_model_tokens("x", path, n).alias("a"), SW.truncate_model_tokens("x", path, n, "last").alias("z")).collect()}
        assert rows[-1].a is None
        for i, t in enumerate(texts):
            ids = model.encode(t, add_special_tokens=False).ids
            assert t.startswith(rows[i].a) and t.endswith(rows[i].z)
            if t.isascii():
                assert rows[i].a.rstrip() == model.decode(ids[:n]).rstrip()
                assert rows[i].z.strip() == (model.decode(ids[-n:]) if n else "").strip()


def test_vocabulary_is_checked(spark):
    df = spark.range(1).selectExpr("'a' AS x")
    for bad in (lambda: SW.truncate_pieces("x", ["a"], -1), lambda: SW.truncate_pieces("x", ["a"], 1, "middle"),
                lambda: SW.count_pieces("x", map(str, range(SW.MAX_PIECES + 1)))):
        with pytest.raises(ValueError):
            bad()
    assert df.select(SW.count_pieces("x", [])).first()[0] == 1


def test_registered_cuts(spark):
    texts = {r.id: r.dialogue for r in fx.fx_corpora(spark, SF_SMALL).select("id", "dialogue").collect()}
    trie = SW.PieceTrie(SW.vocabulary_of(__import__("public_tokenizers").path("byte_bpe_50k.json")))
    rows = QUERIES["truncate_pieces"](spark, SF_SMALL).collect()
    assert len(rows) == len(texts)
    for r in rows:
        spans = list(trie.spans(texts[r.id]))
        assert r.n_pieces == len(spans)
        assert r.text == (texts[r.id] if len(spans) <= 500 else texts[r.id][: spans[499][1]])
    last = QUERIES["truncate_model_tokens"](spark, SF_SMALL).collect()
    assert len(last) == len(texts) and all(texts[r.id].endswith(r.text) for r in last)


def test_a_batch_of_long_texts_is_held_one_text_at_a_time():
    import tracemalloc

    import pyarrow as pa

    texts = pa.array([*("ab " * 50_000 for _ in range(100)), None, ""])
    tracemalloc.start()
    got = SW._each(texts, lambda t: t[:30_000], pa.string())
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 2_000_000  # the batch is 15 MB, its results are 3 MB
    assert got.to_pylist() == [None if t is None else t[:30_000] for t in texts.to_pylist()]
    assert SW._each(pa.array([], pa.string()), len, pa.int64()).to_pylist() == []

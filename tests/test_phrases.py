"""Key phrases by base forms and by the automaton, against plain search."""

import random
import re

import pytest
from pyspark.sql import functions as F

from dialoglab.functions.lemmas import lemma
from dialoglab.operators import phrases as P
from dialoglab.plans.catalog import QUERIES
from dialoglab.plans.fixtures import PHRASES, fx_corpora
from conftest import SF_SMALL


@pytest.mark.parametrize("base,forms", [
    ("pay", "pay pays paid paying"), ("make", "makes made making"), ("hope", "hopes hoped hoping"), ("hop", "hops hopped hopping"),
    ("try", "tries tried trying"), ("watch", "watches watched watching"), ("stop", "stops stopped stopping"), ("listen", "listens listened listening"),
    ("please", "pleases pleased pleasing"), ("blame", "blames blamed blaming"), ("change", "changes changed changing"), ("believe", "believes believed believing"),
    ("need", "needs needed needing"), ("agree", "agrees agreed agreeing"), ("be", "am is are was were been"), ("child", "children"), ("bus", "bus"),
    ("boss", "boss"), ("nothing", "nothing"), ("sing", "sings singing"), ("red", "red"), ("tell", "tells told telling"), ("go", "goes went gone going"),
    ("use", "uses used using"), ("argue", "argues argued arguing"), ("dance", "dances danced dancing"), ("handle", "handles handled handling"),
    ("succeed", "succeed succeeds"), ("bring", "bringing"), ("hang", "hanging"), ("charge", "charged charging"), ("open", "opened opening"), ("fix", "fixes fixed fixing"), ("play", "plays played playing"), ("show", "showed showing shown")])
def test_base_forms(base, forms):
    assert [lemma(w) for w in forms.split()] == [base] * len(forms.split())


def test_extra_forms_win():
    assert lemma("data", {"data": "datum"}) == "datum" and lemma("paid", {"paid": "paid"}) == "paid"


def plain(texts, phrases, base=lambda w: w):
    norm = lambda t: re.sub(r"[^\w]|_", " ", t.lower()).split()
    out = set()
    for i, t in texts:
        words = list(map(base, norm(t or "")))
        for p in phrases:
            q = list(map(base, norm(p)))
            if q and any(words[k : k + len(q)] == q for k in range(len(words) - len(q) + 1)):
                out.add((i, p))
    return out


def hits(df):
    rows = [tuple(r) for r in df.collect()]
    assert len(rows) == len(set(rows))
    return set(rows)


def frames(spark, texts, phrases):
    return (spark.createDataFrame(texts, "id string, dialogue string").repartition(3),
            spark.createDataFrame([(p,) for p in phrases], "phrase string"))


def test_lemmatised_phrase_finds_inflected_text(spark):
    texts = [("a", "And who paid you?"), ("b", "Who pays you, then"), ("c", "who was paying you"), ("d", "Who-paid you"), ("e", None), ("f", "")]
    df, ph = frames(spark, texts, ["who pay you", "WHO PAY YOU", "you", "  ", "pay"])
    found = hits(P.dialogue_phrases(df, ph, lemmas=True))
    assert {i for i, p in found if p == "who pay you"} == {"a", "b", "d"} == {i for i, p in found if p == "WHO PAY YOU"}
    assert {i for i, p in found if p == "pay"} == {"a", "b", "c", "d"}
    counts = {r.phrase: r.n_dialogues for r in P.match_key_phrases(df, ph, lemmas=True).collect()}
    assert counts == {"who pay you": 3, "WHO PAY YOU": 3, "you": 4, "  ": 0, "pay": 4}


@pytest.mark.parametrize("most", [P.AUTOMATON_PHRASES, 40])
@pytest.mark.parametrize("lemmas", [False, True])
def test_automaton_against_plain_search(spark, lemmas, most):
    """Phrases that overlap, contain and begin like each other; parts of a list change nothing."""
    rng = random.Random(2)
    words = ["a", "b", "ab", "stop", "stopped", "runs", "run", "é", "漢", "x1"]
    texts = [(str(i), " ".join(rng.choice(words) + rng.choice(["", ",", " -"]) for _ in range(rng.randint(0, 30)))) for i in range(120)]
    phrases = list({" ".join(rng.choice(words) for _ in range(rng.randint(1, 5))) for _ in range(150)}) + ["a b", "a  b", "A, b", "!!"]
    df, ph = frames(spark, texts, phrases + phrases[:5])
    want = plain(texts, phrases, lemma if lemmas else lambda w: w)
    assert hits(P.automaton_phrases(df, ph, "dialogue", "id", "phrase", lemmas, most=most)) == want


def test_a_million_phrases(spark):
    """More phrases than one automaton takes: each part has its own pass, the driver holds one part."""
    ph = spark.range(1_000_000).selectExpr("concat('w', id % 1000, ' v', id) AS phrase")
    texts = [("a", "w7 v7 w8 v1008 w9 v8"), ("b", "v999999 w999 v999999 w0 v0"), ("c", "nothing")]
    df = spark.createDataFrame(texts, "id string, dialogue string")
    assert hits(P.dialogue_phrases(df, ph)) == {("a", "w7 v7"), ("a", "w8 v1008"), ("b", "w999 v999999"), ("b", "w0 v0")}


def test_registered_query_against_plain_search(spark):
    texts = [(r.id, r.dialogue) for r in fx_corpora(spark, SF_SMALL).collect()]
    found = plain(texts, PHRASES, lemma)
    want = {p: sum(q == p for _, q in found) for p in PHRASES}
    assert {r.phrase: r.n_dialogues for r in QUERIES["match_key_phrases_lemmas"](spark, SF_SMALL).collect()} == want


def test_lists_and_texts_are_made_once_however_many_parts(spark):
    made = {"phrases": spark.sparkContext.accumulator(0), "texts": spark.sparkContext.accumulator(0)}

    def counted(df, name):
        seen = made[name]

        def run(batches):
            for b in batches:
                seen.add(b.num_rows)
                yield b

        return df.mapInArrow(run, df.schema)

    phrases = counted(spark.createDataFrame([(p,) for p in ("a b", "b c", "c", "x y", "A-b", "")], "phrase string"), "phrases")
    for most, texts_read in ((1, 3), (100, 3)):
        for x in made.values():
            x.value = 0
        texts = counted(spark.createDataFrame([("1", "a b c"), ("2", "x, y"), ("3", None)], "id string, dialogue string"), "texts")
        got = P.automaton_phrases(texts, phrases, "dialogue", "id", "phrase", lemmas=False, most=most).collect()
        assert sorted(map(tuple, got)) == [("1", "A-b"), ("1", "a b"), ("1", "b c"), ("1", "c"), ("2", "x y")]
        assert (made["phrases"].value, made["texts"].value) == (6, texts_read)


def test_first_words_of_the_normalised_text(spark):
    texts = ["", None, "  ", "a", "a b", "--A, b! c", " ÀÉ2..x", "ΑΣ ΣΑΣ b", "...", "a  b", "İx y z", "x\ny\tz", "12 ３ x", "a-", "-a-b-c-d"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 2, 3):
        plain = F.array_join(F.slice(F.split(P.normalize_text("t"), " "), 1, n), " ")
        assert df.select(plain.alias("o"), P.first_words("t", n).alias("w")).where("NOT o <=> w").collect() == []

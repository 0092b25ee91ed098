"""Each operator against its plain version, on messy rows (NULLs, empty and odd texts, ties, repeats, clashing columns), on
an empty table and on the smallest driver table."""

import tracemalloc
import zlib
from collections import Counter, defaultdict

import brute
import numpy as np
import pytest
from messy import empty, messy, small  # noqa: F401
from pyspark.sql import functions as F

from dialoglab.llm import bpe, exact_dedup, license_scan, line_dedup, mixing, ngram_join, quality, sharding, token_count, token_files
from dialoglab.llm.common import Words

vocab = pytest.importorskip("public_tokenizers")


def rows_of(df, *cols):
    return sorted((tuple(r) for r in df.select(*cols).collect()), key=repr)


def pairs(df, *cols):
    return [tuple(r) for r in df.select(*(cols or ("doc_id", "text"))).collect()]


@pytest.fixture(params=["messy", "empty", "small"])
def docs(request):
    return request.getfixturevalue(request.param)


def test_sharding(docs):
    out = sharding.kd_shards(docs, shards=7).collect()
    want = sorted(((d, len((t or "").encode()) + 16, brute.crc(t)) for d, t in pairs(docs)), key=repr)
    assert sorted(((r.doc_id, r["size"], r.text_crc32) for r in out), key=repr) == want
    by = defaultdict(list)
    for r in out:
        assert 0 <= r.shard < 7
        by[r.shard].append(r)
    assert all(sorted(r.slot for r in x) == list(range(len(x))) for x in by.values())
    if want:
        bytes_ = [sum(r["size"] for r in by[k]) for k in range(7)]
        largest = max(x[1] for x in want)
        assert max(bytes_) <= sum(bytes_) / 7 + 2.5 * largest + 1


def test_sharding_by_target_bytes(small):
    total = small.agg(F.sum(F.octet_length("text") + 16)).first()[0]
    out = sharding.kd_shards(small, target_bytes=total // 5 + 1)
    assert out.agg(F.max("shard")).first()[0] == 4


def test_exact_dedup(docs):
    want = sorted(brute.exact(pairs(docs)), key=repr)
    assert rows_of(exact_dedup.exact_dedup(docs), "doc_id", "keep_id", "group_size", "kept", "text_sha256") == want
    left = exact_dedup.drop_copies(docs)
    assert left.columns == docs.columns
    left = left.collect()
    assert len(left) == len({w[4] for w in want})
    best = {(w[0], w[4]) for w in want if w[3]}
    assert {(r.doc_id, brute.exact([(0, r.text)])[0][4]) for r in left} == best


@pytest.mark.parametrize("kind,big", [("long", 2**63 - 1), ("string", "zz")])
def test_exact_dedup_keeper(spark, kind, big):
    """A shorter row with the keeper's id isn't the keeper; the largest id is an id; ids may be strings."""
    one, two = (1, 2) if kind == "long" else ("1", "2")
    rows = [(one, "a b"), (one, "ab"), (one, "a b"), (two, "a  b"), (two, "ab"), (big, "x y"), (None, "xy"), (None, "q"), (None, "q "), (big, "only one")]
    df = spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(4)
    got = Counter((r.doc_id, r.keep_id, r.group_size, r.kept) for r in exact_dedup.exact_dedup(df).collect())
    assert got == Counter([(one, two, 5, False)] * 3 + [(two, two, 5, True), (two, two, 5, False), (big, big, 2, True), (None, big, 2, False),
                                                       (None, None, 2, False), (None, None, 2, True), (big, big, 1, True)])
    for bits in (1 << 23, 64):  # nearly every digest seems to occur often in the small one
        left = sorted((r.text for r in exact_dedup.drop_copies(df, bits).collect()))
        assert left == ["a  b", "only one", "q ", "x y"]


def test_cuckoo_index_inserts_deletes_and_grows():
    rng = np.random.default_rng(1)
    f = exact_dedup.CuckooFilter(buckets=2)
    keys = [rng.bytes(32) for _ in range(3000)]
    for k in keys:
        f.insert(k)
    assert f.mask + 1 > 2 and all(f.verified(k) for k in keys)
    assert all(f.delete(k) for k in keys[::2])
    assert not any(f.verified(k) for k in keys[::2]) and all(f.verified(k) for k in keys[1::2])
    assert not f.delete(keys[0])
    index = exact_dedup.LiveIndex()
    index.add(b"k" * 32, 3, 9, 1)
    index.add(b"k" * 32, 3, 4, 2)
    assert index.remove(b"k" * 32) == [3, 4, 3] and len(index) == 0 and index.remove(b"k" * 32) is None


def test_a_full_index_passes_entries_on(messy):
    keyed = exact_dedup.digests(messy)
    got = exact_dedup.verdicts(keyed, max_live=3).agg(F.sum("n"), F.count("*")).first()
    assert tuple(got) == (messy.count(), keyed.select("digest").distinct().count())


@pytest.mark.parametrize("n,num,den", [(3, 90, 100), (5, 4, 5), (1, 1, 2)])
def test_jaccard_groups(docs, n, num, den, monkeypatch):
    monkeypatch.setattr(ngram_join, "RUN_SETS", 3)  # several runs for a block
    got = rows_of(ngram_join.jaccard_groups(docs, n, num, den), "doc_id", "n_shingles", "component_id", "n_links")
    assert got == sorted(brute.jaccard(pairs(docs), n, num, den), key=repr)


def test_a_task_of_the_join_holds_one_part(spark, small, monkeypatch):
    alone, chains = ngram_join._alone, ngram_join._chains

    def watched(run):
        def one(batches, *more):
            seen = set()

            def look():
                for b in batches:
                    seen.update(b.column(0).to_pylist())
                    yield b

            yield from run(look(), *more)
            assert len(seen) <= 1, seen  # parts are made for the memory of a task

        return one

    monkeypatch.setattr(ngram_join, "PART_SIGNATURES", 500)
    monkeypatch.setattr(ngram_join, "PART_GRAMS", 500)
    monkeypatch.setattr(ngram_join, "_alone", watched(alone))
    monkeypatch.setattr(ngram_join, "_chains", watched(chains))
    got = rows_of(ngram_join.jaccard_groups(small, 5, 4, 5), "doc_id", "component_id")
    monkeypatch.undo()
    assert got == rows_of(ngram_join.jaccard_groups(small, 5, 4, 5), "doc_id", "component_id")


def test_words_take_few_bytes_for_each_of_a_text():
    texts = [b"some words of a text, " * 50] * 400
    tracemalloc.start()
    Words(texts, lower=True)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * sum(map(len, texts))


def test_one_of_each_group(docs):
    left = ngram_join.one_of_each(docs)
    assert left.columns == docs.columns
    want = sorted(r[0] for r in brute.jaccard(pairs(docs), 5, 4, 5) if r[0] is not None and r[0] == r[2])
    assert sorted({r.doc_id for r in left.collect() if r.doc_id is not None}) == sorted(set(want))


def test_one_of_each_group_without_ids_or_with_repeated_ones(spark, messy):
    a, b, c = ([f"{x}{i}" for i in range(60)] for x in "abc")
    near = lambda w, k: " ".join([*w[:k], "other", *w[k + 1 :]])
    rows = [(None, near(a, 0)), (None, near(a, 59)), (None, near(a, 0)), (None, " ".join(a)),  # a group without any id
            (5, near(b, 0)), (5, near(b, 59)), (5, " ".join(b)), (9, " ".join(b)), (None, " ".join(b)),  # its smallest id three times
            (7, " ".join(c)), (7, " ".join(c)), (7, "another text under the same id"), (None, ""), (None, None), (3, "")]
    for df in (spark.createDataFrame(rows, "doc_id long, text string").repartition(3), messy):
        every = pairs(df)
        groups = brute.jaccard([(i, t) for i, (_, t) in enumerate(every)], 5, 4, 5)
        want = defaultdict(list)
        for (d, _), g in zip(every, groups, strict=True):
            want[g[2]].append((d is None, d or 0))
        left = pairs(ngram_join.one_of_each(df))
        assert sorted((d is None, d or 0) for d, _ in left) == sorted(min(x) for x in want.values())
        where = {x: g[2] for x, g in zip(every, groups, strict=True) if g[1]}
        assert len({where[x] for x in left if x in where}) == sum(x in where for x in left)


def test_signatures_of_linked_sets_meet():
    rng = np.random.default_rng(3)
    for num, den in ((9, 10), (4, 5), (1, 2)):
        m = ngram_join.Measure(num, den)
        for _ in range(300):
            common = rng.integers(0, 1 << 63, int(rng.integers(1, 200)), dtype=np.uint64)
            a = np.unique(np.concatenate((common, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(common) // 4)), dtype=np.uint64))))
            b = np.unique(np.concatenate((common, rng.integers(0, 1 << 63, int(rng.integers(0, 1 + len(common) // 4)), dtype=np.uint64))))
            over = len(np.intersect1d(a, b))
            if den * over >= num * (len(a) + len(b) - over):
                assert np.intersect1d(ngram_join.signatures(a, m), ngram_join.signatures(b, m)).size


def test_sketches_differ_in_no_more_than_the_sets():
    rng = np.random.default_rng(4)
    for num, den in ((9, 10), (4, 5), (1, 2), (1, 5)):
        m = ngram_join.Measure(num, den)
        base = [rng.integers(0, 1 << 63, int(n), dtype=np.uint64) for n in (3, 60, 64, 65, 130, 700)]
        own = [np.unique(np.concatenate((b[: int(len(b) * rng.uniform(0.3, 1))], rng.integers(0, 1 << 63, int(rng.integers(1, 9)), dtype=np.uint64))))
               for b in base for _ in range(12)]
        own.sort(key=len)
        for sides in ([0] * len(own), rng.integers(0, 2, len(own)).tolist()):
            got = ngram_join.near([ngram_join.sketch(s) for s in own], [len(s) for s in own], sides, m)
            assert len(got) < len(own)
            forest = ngram_join.Forest(len(own))
            for a, b in got:
                assert sides == [0] * len(own) or sides[a] != sides[b]
                assert forest.join(a, b)
            for a, b in ngram_join.links(own, None, m):
                assert sides != [0] * len(own) and sides[a] == sides[b] or forest.find(a) == forest.find(b)


def test_shared_passages_make_no_large_block(spark, monkeypatch):
    """Texts of common passages have equal signatures, but only near copies reach the search."""
    rng = np.random.default_rng(6)
    passages = [" ".join(f"p{p}w{i}" for i in range(40)) for p in range(30)]
    texts = [" ".join(passages[p] for p in rng.choice(30, 5, replace=False)) for _ in range(150)]
    texts += [texts[0] + " more", texts[1] + " more"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    write, rows = ngram_join.stage_table, {}

    def counted(one, name):
        out = write(one, name)
        rows[name] = out.count()
        return out

    monkeypatch.setattr(ngram_join, "stage_table", counted)
    monkeypatch.setattr(ngram_join, "SKETCH_RUN", 3)  # runs are compared in pairs
    got = rows_of(ngram_join.jaccard_groups(df, 5, 4, 5), "doc_id", "n_shingles", "component_id", "n_links")
    want = brute.jaccard(list(enumerate(texts)), 5, 4, 5)
    assert got == sorted(want, key=repr)
    linked = sum(w[3] > 0 for w in want)
    assert 4 <= linked <= rows["members"] <= linked + 10


def test_t_occurrence_equals_counting():
    rng = np.random.default_rng(5)
    for _ in range(200):
        lists = [np.unique(rng.integers(0, 40, rng.integers(1, 30))) for _ in range(rng.integers(1, 25))]
        n = Counter(x for y in lists for x in y.tolist())
        t = int(rng.integers(1, len(lists) + 2))
        assert sorted(ngram_join.t_occurrence(lists, t)) == sorted((k, v) for k, v in n.items() if v >= t)


def test_components_of_a_long_chain(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(200) if i % 50 != 49] + [(7, 7)], "a long, b long")
    got = {r.node: r.root for r in ngram_join.components(e, "a", "b").collect()}
    assert got == {i: i // 50 * 50 for i in range(200)}


def test_licenses(docs):
    out = license_scan.license_report(docs).collect()
    assert all(r.n_unconfirmed == r.n_found - r.n_confirmed >= 0 for r in out)
    assert sorted(((r.doc_id, r.n_paragraphs) for r in out), key=repr) == sorted(
        ((d, (t or "").count("\n") + 1) for d, t in pairs(docs)), key=repr)
    notices = {"released under the mit license.": "mit", "licensed under the apache license, version 2.0": "apache-2.0",
               "licensed under cc by-nc 4.0.": "cc-by-nc", "licensed under the apache license, version 2.0.": "apache-2.0",
               "this work is licensed under the gnu general public license, version 3.": "gpl"}
    want = sorted(((d, sorted({notices[x.lower()] for x in (t or "").split("\n") if x.lower() in notices})) for d, t in pairs(docs)), key=repr)
    assert sorted(((r.doc_id, r.families) for r in out), key=repr) == want


def test_license_model_on_unseen_variants():
    plain = [f"row {i} tells of rivers and hills number {i}" for i in range(300)]
    model = license_scan.train(plain, seed=1)
    rng = np.random.default_rng(99)
    filler = "some words that lie around it".split()
    cases = [(license_scan._shape(t, rng, filler).encode(), f) for f, ts in license_scan.TEMPLATES.items() for t in ts for _ in range(10)]
    got = [f for f, _ in model.predict([c for c, _ in cases])]
    assert np.mean([g == f for g, (_, f) in zip(got, cases, strict=True)]) > 0.93
    clean = [f"the {i} birds of the river sing" for i in range(500)] + license_scan.OTHER
    assert np.mean([f != license_scan.UNKNOWN for f, _ in model.predict([c.encode() for c in clean])]) < 0.02


WRAPPED = {
    "bsd": "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions\nare met:",
    "gpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
           "the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "lgpl": "This library is free software; you can redistribute it and/or\nmodify it under the terms of the GNU Lesser General Public\n"
            "License as published by the Free Software Foundation; either\nversion 2.1 of the License, or (at your option) any later version.",
    "agpl": "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU Affero General Public License as published\n"
            "by the Free Software Foundation, either version 3 of the License, or\n(at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any\npurpose with or without fee is hereby granted, provided that the above\n"
           "copyright notice and this permission notice appear in all copies.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy\nof this software and associated documentation files (the \"Software\"), to deal",
    "cc-by-nc": "This work is licensed under a Creative Commons\nAttribution-NonCommercial 4.0 International License.",
    "apache-2.0": "Licensed under the\nApache License, Version 2.0",
}


def test_wrapped_licenses(spark):
    """As they stand in files, as comments, a word a line, on one line, among prose; parted by a blank line they are no notice."""
    prose = "The quick brown fox jumps over the lazy dog\nwhile seven small birds sing of the terms of the sea"
    rows, want = [], {}
    for f, t in WRAPPED.items():
        for shape in (t, "\n".join(f" * {x}" for x in t.split("\n")), "\r\n".join(f"// {x}" for x in t.split("\n")), t.replace(" ", "\n"),
                      t.replace("\n", " "), f"{prose}\n{t}\n{prose}"):
            want[len(rows)] = [f]
            rows.append((len(rows), shape))
    for t in (WRAPPED["apache-2.0"].replace("\n", "\n\n"), "Released under\nthe false name", prose, "He was licensed\nunder the old law"):
        want[len(rows)] = []
        rows.append((len(rows), t))
    for t, fs in ((WRAPPED["isc"] + "\n" + WRAPPED["bsd"], ["bsd", "isc"]), ("Licensed under CC BY 4.0.\n" + WRAPPED["lgpl"], ["cc-by", "lgpl"]),
                  ("Released under the MIT License.\nLicensed under the GNU GPL v2.", ["gpl", "mit"])):
        want[len(rows)] = fs
        rows.append((len(rows), t))
    out = license_scan.license_report(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.families for r in out} == want
    assert {r.doc_id: r.n_paragraphs for r in out} == {d: t.count("\n") + 1 for d, t in rows}


@pytest.mark.parametrize("min_docs,min_chars,shard_keys,salts,bits", [(10, 1, 1 << 18, 4, 1 << 23), (2, 3, 4, 2, 1 << 23),
                                                                      (2, 3, 4, 2, 64), (3, 0, 16, 1, 1 << 10)])
def test_line_dedup(docs, min_docs, min_chars, shard_keys, salts, bits):
    """One shard and many; bitmaps that let only some rows through, and (64 bits) nearly all."""
    got = line_dedup.line_report(docs, min_docs=min_docs, min_chars=min_chars, shard_keys=shard_keys, salts=salts, bits=bits)
    assert rows_of(got, *got.columns) == sorted(brute.lines(pairs(docs), min_docs, min_chars), key=repr)
    kept = line_dedup.drop_common_lines(docs, min_docs=min_docs, min_chars=min_chars)
    assert kept.columns[: len(docs.columns)] == docs.columns


@pytest.mark.parametrize("bits", [1 << 23, 64])
def test_only_texts_that_the_bitmap_misjudges_meet_their_lists(spark, bits):
    docs = spark.createDataFrame([(i, f"common {i % 5}\nown {i}\nother {i}") for i in range(300)], "doc_id long, text string")
    lines = line_dedup.stage_table(line_dedup.line_hashes(docs), "test-lines")
    hits = line_dedup.common_lines(lines, 3)
    marks = line_dedup.bitmap(hits, F.col("h"), bits, line_dedup._probes(F.col("h"), bits))
    found = {r.row for r in line_dedup.unsure_rows(lines, hits, spark.sparkContext.broadcast(marks), bits).collect()}
    drop = {r.h for r in hits.collect()}
    rows = [(r.row, r.h) for r in lines.collect()]
    let = line_dedup.in_lines(marks, np.array([h for _, h in rows], np.int64), bits)
    assert drop and all(x for x, (_, h) in zip(let, rows, strict=True) if h in drop)
    assert found == {r for x, (r, h) in zip(let, rows, strict=True) if x and h not in drop}
    assert bool(found) == (bits < 1 << 23)  # with room in the bitmap no text is moved


def test_line_dedup_of_odd_rows(spark):
    """Ids that are NULL or come twice, rows that come twice, NULL and empty texts, short lines; with a bitmap that is full, too."""
    rows = [(None, "a\nB \nzz"), (1, "b\nzz"), (1, "b\nzz"), (1, " B\n\nq"), (2, None), (2, ""), (None, None), (3, "\n\nzz\nzz"), (4, "x\u00e9\nX\u00e9")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for min_chars in (0, 1, 2):
        for bits in (1 << 23, 64):
            got = line_dedup.line_report(df, min_docs=3, min_chars=min_chars, bits=bits)
            assert rows_of(got, *got.columns) == sorted(brute.lines(rows, 3, min_chars), key=repr)


def test_perfect_hash_is_minimal_and_survives_bytes():
    rng = np.random.default_rng(2)
    for n in (0, 1, 5, 4000):
        keys = np.unique(rng.integers(0, 1 << 63, n, dtype=np.uint64) * np.uint64(2))
        counts = (np.arange(len(keys)) % 200 + 1).astype(np.uint8)
        made = line_dedup.PerfectHash.from_bytes(line_dedup.PerfectHash.build(keys, counts).to_bytes())
        assert sorted(made.slots(keys).tolist()) == list(range(len(keys)))
        assert (made.count(keys) == counts).all()
        strange = np.setdiff1d(rng.integers(0, 1 << 63, 3000, dtype=np.uint64), keys)
        assert (made.count(strange) > 0).mean() < 0.05  # 8-bit fingerprints


def test_bpe_round_trip(docs):
    import tiktoken

    path = vocab.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    got = rows_of(bpe.encode_documents(docs, path, vocab.PATTERN), "doc_id", "ids", "decoded")
    want = sorted(((d, own.encode_ordinary(t or ""), bytearray((t or "").encode())) for d, t in pairs(docs)), key=repr)
    assert sorted(got, key=repr) == want
    dig = bpe.digest(bpe.encode_documents(docs, path, vocab.PATTERN))
    assert rows_of(dig, *dig.columns) == sorted(
        ((d, len(i), brute.sha(",".join(map(str, i)).encode()), brute.sha(bytes(b))) for d, i, b in want), key=repr)


def test_bpe_on_random_and_long_texts():
    import tiktoken

    path = vocab.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.Encoder(path, vocab.PATTERN)
    own = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    rng = np.random.default_rng(4)
    letters = list("ab \n\t cé漢🙂'sll\x1c\x1f\x85\xa0 ​0१½_#")
    texts = ["".join(rng.choice(letters, rng.integers(0, 30))) for _ in range(3000)] + ["abcdefgh" * 4000 + "x" * 9000]
    assert enc.encode(texts) == [own.encode_ordinary(t) for t in texts]
    enc.cache.recent.most = enc.merged.most = 10  # caches that turn over all the time
    assert [enc.encode([t])[0] for t in texts[:500]] == [own.encode_ordinary(t) for t in texts[:500]]


@pytest.mark.parametrize("first,later", [("foo\n", ["a\n\n", "a\n\n\nb"]), ("foo\t", ["\t bar", "\t\nbar"]), ("foo\n\t", ["a\n\t b", "\n\t\n"])])
def test_white_space_at_an_end_is_not_taken_for_a_later_line(first, later):
    """Two calls of one encoder: the run that ends the first text is known when the later texts are cut."""
    import tiktoken
    from tokenizers import Tokenizer

    path = vocab.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    enc = token_files.Encoder(path)
    enc.encode([first])
    assert [x.tolist() for x in enc.encode(later)] == [[*own.encode(t, add_special_tokens=False).ids, token_files.END_ID] for t in later]
    path = vocab.path("byte_bpe_multi_50k.tiktoken")
    enc = bpe.Encoder(path, vocab.PATTERN)
    own = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=enc.ranks, special_tokens={})
    enc.encode([first])
    assert enc.encode(later) == [own.encode_ordinary(t) for t in later]


def test_pieces_of_random_white_space():
    """Many small texts through one cache: the runs are those of a fresh cut."""
    from dialoglab.llm import pieces

    rng = np.random.default_rng(11)
    texts = ["".join(rng.choice(list("ab  \n\n\t\r\u3000"), rng.integers(0, 7))) for _ in range(4000)]
    cache = pieces.PieceCache(lambda runs: [tuple(pieces._RUN.findall(r)) for r in runs])
    for t in texts:
        (got,) = cache.look_up([t])
        assert [r for x in got for r in x] == pieces._RUN.findall(t)


@pytest.mark.parametrize("min_group", [50, 3])
def test_quality(docs, min_group):
    measured = docs.select("doc_id", "lang", "source", quality.text_stats("text").alias("__q"))
    out = quality.judge(measured, "__q", quality.thresholds(quality.sketches(measured, "__q"), min_group))
    got = rows_of(out, "doc_id", "__q.n_words", "__q.word_chars", "__q.n_symbols", "__q.n_dup_lines", "__q.n_repeat_words",
                  quality.base_failed(F.col("__q")), "__kept")
    want = brute.quality(pairs(docs, "doc_id", "text", "lang", "source"), quality.RULES, quality.SKETCH_ERROR, min_group)
    assert got == sorted(want, key=repr)


def test_quality_filter_keeps_rows_as_they_are(docs):
    left = quality.keep_good(docs)
    assert left.columns == docs.columns
    want = brute.quality(pairs(docs, "doc_id", "text", "lang", "source"), quality.RULES, quality.SKETCH_ERROR, quality.MIN_GROUP)
    assert sorted((r.doc_id for r in left.collect()), key=repr) == sorted((w[0] for w in want if w[-1]), key=repr)


@pytest.mark.parametrize("section_ids,block_ids", [(1 << 21, 1 << 18), (2000, 500)])
def test_token_files(docs, tmp_path, section_ids, block_ids):
    from tokenizers import Tokenizer

    path = vocab.path("byte_bpe_50k.json")
    t = Tokenizer.from_file(path)
    token_files.write_ids(docs, path, str(tmp_path / "ids"), section_ids, block_ids)
    got = token_files.read_ids(docs.sparkSession, str(tmp_path / "ids")).orderBy("start").collect()
    rows = sorted(pairs(docs), key=lambda r: (r[0] is not None, r[0] or 0))
    assert [r.doc_id for r in got] == [d for d, _ in rows]
    start, want = 0, Counter()
    for r in got:
        assert r.start == start and r.n_tokens == len(r.ids)
        assert r.ids_crc32 == zlib.crc32(np.array(r.ids, "<u4").tobytes())
        start += r.n_tokens
    for d, x in rows:
        want[(d, tuple(t.encode(x or "", add_special_tokens=False).ids) + (0,))] += 1
    assert Counter((r.doc_id, tuple(r.ids)) for r in got) == want


def test_rans_round_trip_and_damage(spark, tmp_path, small):
    rng = np.random.default_rng(6)
    counts = rng.integers(0, 1000, 5000) ** 2
    counts[:4000] = 0
    freq = token_files.scaled(counts)
    assert int(freq.sum()) == 1 << token_files.SCALE and ((freq > 0) == (counts > 0)).all()
    assert (token_files.unpack_table(token_files.pack_table(freq)) == freq).all()
    coder = token_files.Rans(freq)
    for n, lanes in ((1, 1), (5, 3), (10_000, 64), (4097, 1024)):
        ids = rng.choice(np.flatnonzero(counts), n).astype(np.uint32)
        states, words = coder.encode(ids, lanes)
        assert (coder.decode(states, words, n) == ids).all()
    folder = str(tmp_path / "ids")
    token_files.write_ids(small, vocab.path("byte_bpe_50k.json"), folder)
    wrong = F.transform("blocks", lambda b: b.withField("crc32", b["crc32"] + 1))
    spark.read.parquet(f"{folder}/sections").withColumn("blocks", wrong).write.parquet(f"{folder}2/sections")
    spark.read.parquet(f"{folder}/parts").write.parquet(f"{folder}2/parts")
    with pytest.raises(Exception, match="checksum differs"):
        token_files.read_ids(spark, f"{folder}2").collect()


def test_token_counts(docs):
    import sentencepiece

    path = vocab.path("piece_bpe_32k.model")
    sp = sentencepiece.SentencePieceProcessor(model_file=path)
    got = token_count.count_tokens(docs, path, limit=50)
    want = [(d, len((t or "").encode()), n := len(sp.encode(t or "")), n > 50) for d, t in pairs(docs)]
    assert rows_of(got, *got.columns) == sorted(want, key=repr)


def test_token_counts_of_random_and_long_texts():
    import sentencepiece

    path = vocab.path("piece_bpe_32k.model")
    sp, own = sentencepiece.SentencePieceProcessor(model_file=path), token_count.Merger(path)
    rng = np.random.default_rng(8)
    letters = list("ab the \n\t cé漢🙂'sl▁ \x0001½_# <s>")
    texts = ["".join(rng.choice(letters, rng.integers(0, 40))) for _ in range(3000)]
    texts += ["abcdefgh" * 500 + "x" * 3000 + " " * 900 + "y" * 700, "e" * 600, "-" * 3000]
    assert own.count_texts(texts) == [len(sp.encode(t)) for t in texts]


def test_long_rows_of_made_up_models():
    """Rank-synchronous rounds against one merge at a time, where merges make pairs of lower, equal and higher rank."""
    rng = np.random.default_rng(4)
    for _ in range(400):
        size = int(rng.integers(3, 9))
        own = token_count.Merger.__new__(token_count.Merger)
        chosen = {(int(a), int(b)) for a, b in rng.integers(0, size, (int(rng.integers(1, 14)), 2))}
        pairs = {a * size + b: (int(rng.integers(0, 5)), int(rng.integers(0, size))) for a, b in chosen}
        own.size, own.keys = size, np.array(sorted(pairs), np.int64)
        own.rank = np.array([pairs[k][0] for k in sorted(pairs)] + [token_count.NO_RANK], np.int32)
        own.union = np.array([pairs[k][1] for k in sorted(pairs)] + [-1], np.int32)
        for _ in range(6):
            row = rng.integers(-1, size, rng.integers(2, 40)).tolist()
            want = list(row)
            while (best := min(((pairs[a * size + b][0], i) for i, (a, b) in enumerate(zip(want, want[1:]))
                                if a >= 0 <= b and a * size + b in pairs), default=None)) is not None:
                i = best[1]
                want[i : i + 2] = [pairs[want[i] * size + want[i + 1]][1]]
            assert own.merge_long(row) == len(want), (row, pairs)
            assert own.merge_rows([row]).tolist() == [len(want)]


def test_mixing_targets_and_taken_words(docs):
    out = mixing.mix_report(docs, block_words=50).collect()
    assert rows_of(mixing.mix_report(docs, block_words=50), "doc_id", "taken") == sorted(((r.doc_id, r.taken) for r in out), key=repr)
    size, biggest, source = Counter(), Counter(), {}
    for d, t, s in pairs(docs, "doc_id", "text", "source"):
        n = len(brute.WORD.findall(t or ""))
        size[s] += n
        biggest[s] = max(biggest[s], n)
    want = brute.mix_targets(size)
    taken = Counter()
    assert len(out) == docs.count()
    for r in out:
        assert r.taken == r["size"] * len(r.shards) and len(r.shards) <= 3
    by = defaultdict(Counter)
    for r in out:
        by[(r.source_size, round(r.target, 6))]["taken"] += r.taken
    if not out:
        return
    # repeated rows are taken alike, so the last step may be a few rows
    for s, target in want.items():
        taken = by[(size[s], round(target, 6))]["taken"]
        same = [x for x in want if size[x] == size[s] and round(want[x], 6) == round(target, 6)]
        assert abs(taken - sum(want[x] for x in same)) <= 3 * max(biggest.values())


def test_mixing_targets_closed_form(spark):
    rng = np.random.default_rng(9)
    for k in (1, 2, 7, 30):
        sizes = {f"s{i}": int(x) for i, x in enumerate(rng.lognormal(5, 2.5, k))}
        sizes[None] = 5
        df = spark.createDataFrame(list(sizes.items()), "source string, source_size long")
        got = {r.source: r.target for r in mixing.targets(df).collect()}
        want = brute.mix_targets(sizes)
        assert got.keys() == want.keys() and all(abs(got[s] - want[s]) < 1e-6 * max(1, want[s]) for s in want)


def test_mixture_repeats_rows_as_reported(docs):
    mix = mixing.mixture(docs, block_words=50)
    assert mix.columns == [*docs.columns, "__shard", "__order"]
    got = Counter((r.doc_id, r.text, r["__shard"]) for r in mix.collect())
    report = mixing.mix_report(docs, block_words=50)
    texts = defaultdict(set)
    for d, t in pairs(docs):
        texts[d].add(t)
    want = Counter()
    for r in report.collect():
        for s in r.shards:
            want[(r.doc_id, s)] += 1
    assert Counter({(d, s): sum(n for (e, _, z), n in got.items() if e == d and z == s) for d, s in want}) == want


def test_mixture_counts_words_once(small, capsys):
    mixing.mixture(small, block_words=50).explain()
    assert "regexp_replace" not in capsys.readouterr().out  # only the tables need sizes, and they are written by then


def test_a_text_has_words_where_some_are_counted(spark):
    texts = [None, "", " ", " \t\n\x0b\x0c\r", "a", " \n a ", "\u00a0", "\x00", "\x1c", "\u2003 x", " \u3000"]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = df.select(mixing.has_words(F.col("text")).alias("a"), (mixing.word_count(F.col("text")) > 0).alias("b")).collect()
    assert [r.a for r in got] == [r.b for r in got] and [r.a for r in got] == [False] * 4 + [True] * 7


def test_tree_quotas_add_up(small):
    out = mixing.mix_report(small, shards=5, block_words=200)
    shards = Counter(s for r in out.collect() for s in r.shards)
    assert set(shards) <= set(range(5)) and sum(shards.values()) > 0

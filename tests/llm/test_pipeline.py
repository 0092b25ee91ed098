"""The pipeline, stage by stage, against the plain versions."""

from collections import Counter

import brute
import pytest
from conftest import SF_SMALL
from messy import empty, messy, small  # noqa: F401

import corpus_pipeline
from dialoglab.llm import bpe, quality

vocab = pytest.importorskip("public_tokenizers")


@pytest.mark.parametrize("which", ["small", "messy", "empty"])
def test_stages_in_order(request, spark, which):
    import tiktoken

    docs = request.getfixturevalue(which)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality rules", "exact dedup", "n-gram Jaccard join", "mixing sources", "byte-level BPE"]
    rows = [tuple(r) for r in docs.select("doc_id", "text", "lang", "source").collect()]
    good = brute.quality(rows, quality.RULES, quality.SKETCH_ERROR, quality.MIN_GROUP)
    step = [r for r, g in zip(rows, good, strict=True) if g[-1]]
    out = docs
    cols = docs.columns
    out = corpus_pipeline.good_quality(spark, out, SF_SMALL).cache()
    assert out.columns == cols
    assert Counter((r.doc_id, r.text) for r in out.collect()) == Counter(r[:2] for r in step)

    out = corpus_pipeline.without_copies(spark, out, SF_SMALL).cache()
    kept = {(w[0], w[4]) for w in brute.exact([r[:2] for r in step]) if w[3]}
    assert {(r.doc_id, brute.exact([(0, r.text)])[0][4]) for r in out.collect()} == kept
    step = [(r.doc_id, r.text) for r in out.collect()]

    out = corpus_pipeline.without_near_copies(spark, out, SF_SMALL).cache()
    stays = {w[0] for w in brute.jaccard(step, 5, 4, 5) if w[0] == w[2] or w[0] is None}
    assert {r.doc_id for r in out.collect()} <= stays | {None}
    assert {w[0] for w in brute.jaccard(step, 5, 4, 5) if w[0] is not None and w[0] == w[2]} <= {r.doc_id for r in out.collect()}

    mixed = corpus_pipeline.mixed(spark, out, SF_SMALL).cache()
    assert mixed.columns == cols
    have = {(r.doc_id, r.text) for r in out.collect()}
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(times) <= have and all(n <= 3 for n in times.values())

    path = vocab.path("byte_bpe_multi_50k.tiktoken")
    own = tiktoken.Encoding("own", pat_str=vocab.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    ids = corpus_pipeline.token_ids(spark, mixed, SF_SMALL)
    want = Counter()
    for (d, t), n in times.items():
        i = own.encode_ordinary(t or "")
        want[(d, len(i), brute.sha(",".join(map(str, i)).encode()), brute.sha((t or "").encode()))] += n
    assert Counter(tuple(r) for r in ids.collect()) == want


def test_run(spark):
    out = corpus_pipeline.run(spark, SF_SMALL)
    assert out.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"] and out.count() > 50

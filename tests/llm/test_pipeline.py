"""The pipeline against brute force, stage by stage, on the smallest tables."""

import base64
from collections import Counter

import brute
import corpus_pipeline
import numpy as np
import public_tokenizers
import tiktoken
from test_documents import brute_lines, fill

from plumbline.llm import byte_bpe, mixing, quality
from plumbline.llm.common import table

FOLDER = "/root/testdata/sf0.001"


def test_pipeline(spark):
    docs = table(spark, FOLDER, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    model = quality.train(docs, table(spark, FOLDER, "labels"))
    coders = model.compressors()
    texts = {}
    for i, r in rows.items():
        if model.score(np.array([quality.saved(r.text, coders)]))[0] >= quality.ACCEPT:
            texts[i] = r.text
    assert 0.5 * len(rows) < len(texts) < len(rows)
    texts = brute_lines(sorted(texts.items()))
    named = brute.simhash_groups(sorted(texts.items()))
    texts = {i: texts[i] for i, _, first in named if i == first}
    sizes = Counter()
    for i, t in texts.items():
        sizes[rows[i].source] += len(t.encode().split())
    goal = fill(sizes)

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(public_tokenizers.path(byte_bpe.VOCABULARY), "rb"))}
    coder = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    out = corpus_pipeline.run(spark, FOLDER).collect()
    taken = Counter(r.doc_id for r in out)
    assert set(taken) <= set(texts) and max(taken.values()) <= 2
    for source, want in goal.items():
        own = {i: len(t.encode().split()) for i, t in texts.items() if rows[i].source == source}
        rate = want / sizes[source] if sizes[source] else 0
        assert all(taken[i] in (int(rate), int(rate) + 1, round(rate)) for i in own)
        assert abs(sum(taken[i] * n for i, n in own.items()) - want) <= 2 * max(own.values())
    for r in out:
        ids = coder.encode_ordinary(texts[r.doc_id])
        assert r.n_tokens == len(ids) and np.frombuffer(r.ids, "<u4").tolist() == ids
        assert (r.lang, r.source) == (rows[r.doc_id].lang, rows[r.doc_id].source)


def test_stages_keep_the_columns(spark):
    """Columns that documents have beside their own stay as they are, whatever their names."""
    names = ["place", "key", "_n", "score", "predicted", "n_lines", "n_removed", "fp", "row", "h1", "size", "copies", "_copies", "_kept", "hash"]
    docs = table(spark, FOLDER, "documents").limit(60).selectExpr("*", *[f"concat('{n}', doc_id) AS {n}" for n in names])
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, FOLDER)
        assert out.columns == docs.columns
        rows = out.collect()
        assert rows and all(r[n] == f"{n}{r.doc_id}" for r in rows for n in names)
    assert mixing.copies(docs).count() == 60

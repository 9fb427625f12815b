"""The pipeline against a plain reading of its stages, document by document."""

import os
import sys

import numpy as np
import pyarrow as pa

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__)))))

import corpus_pipeline
import test_decontam
import test_simhash
from veilspark.llm import langid, mixing, toxicity
from veilspark.llm.common import table
from veilspark.llm.octets import text_buffers


def toxic(model, text):
    data, ends = text_buffers(pa.array([text]))
    top = max([t for _, t, _, _ in toxicity._tagged(model, data, [(0, 0, int(ends[1]))])], default=-25.0)
    return 1 / (1 + np.exp(-(model["slope"] * top + model["offset"]))) >= toxicity.THRESHOLD


def clear_language(model, text):
    if not any(c.isalpha() for c in text or ""):
        return False
    data, ends = text_buffers(pa.array([text]))
    bits = np.zeros((1, len(model["names"])))
    langid._add(model, data, ends, [(0, 0, int(ends[1]))], bits)
    return 1 / np.exp2(bits.min() - bits).sum() >= langid.THRESHOLD


def test_like_plain_stages(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    spam = toxicity.trained(docs, table(spark, sf_dir, "labels"))
    tongue = langid.trained(docs)
    rows = [(d, t) for d, t in rows if not (spam and toxic(spam, t)) and clear_language(tongue, t)]
    first = {d: c for d, _, c in test_simhash.expected(rows)}
    rows = [(d, t) for d, t in rows if first[d] == d]
    items = [(r.item_id, r.text) for r in table(spark, sf_dir, "benchmark").collect()]
    bad = {r[0] for r in test_decontam.plain(rows, items) if r[5]}
    want = sorted(d for d, _ in rows if d not in bad)
    got = corpus_pipeline.run(spark, sf_dir).collect()
    assert sorted(r.doc_id for r in got) == want and 0 < len(want) < 200
    assert bad and len(first) > len(rows)
    order = sorted(got, key=lambda r: r.mix_pos)
    assert len({r.mix_pos for r in got}) == len(got)
    slots = {}
    for r in order:
        assert slots.setdefault(r.mix_slot, r.source) == r.source
    assert sorted(slots) == list(range(len(slots))) and len(got) <= mixing.BLOCK * len(slots)


def test_stages_keep_the_columns(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").limit(0)
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["toxicity", "language", "near-duplicates", "decontamination", "mixing"]
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, sf_dir)
        assert out.columns == docs.columns and out.count() == 0
    assert corpus_pipeline.STAGES[-1][1](spark, docs, sf_dir).count() == 0

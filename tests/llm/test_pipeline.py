"""The corpus pipeline, stage by stage against plain Python on the smallest tables, and on odd rows."""

from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from docengine.llm import decontaminate, mixing, quality, secrets, simhash
from tests.conftest import SF

from .test_dedup import components, plain_shingles, plain_template, plain_windows
from .test_scans import plain_secrets

ODD = "doc_id long, text string, lang string, source string, n_chars long, shard int, copy string, `order` string, slice string, tag long, s string, fp int, x double, name string, label string, block string, `a.b` int"


@pytest.fixture(scope="module")
def stages(spark):
    """(input, output) of each stage on whole documents."""
    out, docs = {}, spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        from docengine.llm.common import materialize

        new = materialize(stage(spark, docs, SF), name)
        out[name] = (docs.collect(), new.collect())
        docs = new
    return out


def test_quality_stage(spark, stages):
    docs, kept = stages["quality"]
    model = quality.train(spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet"))
    x = quality.document_statistics(pa.array([r.text for r in docs]))
    assert {r.doc_id for r in kept} == {r.doc_id for r, good in zip(docs, model.scores(x) >= 0.3, strict=True) if good}
    assert len(kept) < len(docs)


def test_near_dedup_stage(stages):
    docs, kept = stages["near_dedup"]
    sets = [plain_shingles(r.text) for r in docs]
    like = [[len(a & b) / len(a | b) if a | b else 1.0 for b in sets] for a in sets]
    n, ids = len(docs), [r.doc_id for r in docs]
    stay = {r.doc_id for r in kept}
    order = sorted(range(n), key=lambda i: ids[i])
    pairs = lambda least: [(a, b) for a in range(n) for b in range(a) if like[order[a]][order[b]] >= least]
    loose, exact = components(n, pairs(0.7)), components(n, pairs(1.0))
    # Everything that stays is the first of its exact copies; of every loose group at least its first stays.
    assert stay <= {ids[order[i]] for i in set(exact)} and {ids[order[i]] for i in set(loose)} <= stay


def test_decontaminate_stage(spark, stages):
    docs, kept = stages["decontaminate"]
    items = {r.text for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect() if r.text}
    sizes = {t: len(plain_template(t)) for t in items}
    windows = {t: list(plain_windows(t, [min(sizes[t], 5)])) for t in items if sizes[t]}
    gone = set()
    for r in docs:
        mine: dict = {}
        for width in {min(s, 5) for s in sizes.values() if s}:
            for p, w, h, b in plain_windows(r.text, [width]):
                mine.setdefault(h, []).append((p, w, b))
        for t, theirs in windows.items():
            m = [(p, q, w, a, b) for q, w, h, a in theirs for p, w2, b in mine.get(h, ()) if w2 == w]
            if any(ok and (c >= 20 or c / sizes[t] >= 0.8) for c, _, _, ok, _ in decontaminate.item_chains(m)):
                gone.add(r.doc_id)
    assert {r.doc_id for r in docs} - gone == {r.doc_id for r in kept}


def test_secrets_stage(stages):
    docs, clean = stages["secrets"]
    got = {r.doc_id: r for r in clean}
    for r in docs:
        out, at = "", 0
        for s, e in sorted({(s, e) for _, s, e in plain_secrets(r.text or "")} | set(secrets.lex_spans(r.text or "")), key=lambda x: (x[0], x[1])):
            if s >= at:
                out += (r.text or "")[at:s] + "[SECRET]"
            at = max(at, e)
        assert got[r.doc_id].text == (out + r.text[at:] if r.text is not None else None) and got[r.doc_id].n_chars == len(got[r.doc_id].text)


def test_mix_stage(stages):
    docs, drawn = stages["mix"]
    text = {r.doc_id: r.text for r in docs}
    words = Counter()
    for r in docs:
        words[r.source] += len(r.text.split())
    taken = Counter()
    for r in drawn:
        assert r.text == text[r.doc_id]
        taken[r.source] += len(r.text.split())
    assert set(Counter((r.doc_id, r.copy) for r in drawn).values()) == {1} and {r.copy for r in drawn} <= {1, 2}
    assert all(len({r.shard for r in drawn if r.doc_id == i}) == 1 for i in {r.doc_id for r in drawn})
    # Targets by a plain loop: shares of 150 percent by weight, capped at twice the size, the excess reshared.
    total, names = 1.5 * sum(words.values()), sorted(words, key=lambda s: (s is None, s or ""))
    weight = {s: mixing.WEIGHTS[i % 3] for i, s in enumerate(names)}
    open_, target = set(names), {}
    while open_:
        level = (total - sum(target.values())) / sum(weight[s] for s in open_)
        over = {s for s in open_ if level * weight[s] > 2 * words[s]}
        if not over:
            target |= {s: level * weight[s] for s in open_}
            break
        target |= {s: 2.0 * words[s] for s in over}
        open_ -= over
    largest = max(len(t.split()) for t in text.values())
    assert all(target[s] - largest <= taken[s] <= target[s] + 1e-6 for s in names)
    assert max(np.abs([taken[s] - target[s] for s in names])) < 0.1 * sum(words.values())


def test_stages_take_odd_rows(spark):
    """Nulls everywhere, empty and long texts, equal rows, clashing names; and no rows at all."""
    extra = (1, "c", "o", "sl", 2, "s", 3, 0.5, "n", "l", "b", 4)
    rows = [(1, "one two three", "en", "a", 13, *extra), (1, "one two three", "en", "a", 13, *extra), (None, None, None, None, None, *extra), (2, "", None, "a", 0, *extra), (3, None, "en", None, None, *extra), (4, "word " * 30_000 + "password = 'aB3xK9qLm2Zt77Qp'", "en", "b", 150_000, *extra), (None, "x", "en", "b", 1, *extra)]
    odd = spark.createDataFrame(rows, ODD)
    for name, stage in corpus_pipeline.STAGES:
        got = stage(spark, odd, SF)
        none = stage(spark, odd.where("false"), SF)
        assert none.count() == 0
        if name != "mix":
            assert got.columns == odd.columns == none.columns
        assert 0 < got.count() <= (2 * len(rows) if name == "mix" else len(rows)), name
    assert simhash.drop_near_duplicates(odd).where("doc_id = 1").count() == 1
    assert "[SECRET]" in secrets.redact(odd).where("doc_id = 4").first().text

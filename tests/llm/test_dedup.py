"""Operators 1, 2, 3, 5, 7 and 8 and the pipeline: brute force on small tables, planted cases, odd rows."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

from docengine.llm import chaining, decontaminate, mixing, simhash, suffix, topk
from tests.conftest import SF

DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp long"


def words(rng, n, size=4000):
    return [f"w{rng.randrange(size)}" for _ in range(n)]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "en", f"s{i % 3}", len(t or ""), 0) for i, t in enumerate(texts)], DOCS)


def components(n, links):
    label = list(range(n))

    def find(i):
        while label[i] != i:
            i = label[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        label[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text):
    w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text).encode().split()
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(b" ".join(w[i : i + 4]), 42) for i in range(max(1, len(w) - 3))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def test_simhash_is_brute_force(spark):
    rng = random.Random(1)
    texts = [None, "", " \n", "a b", "A b", "x " * 30_000]
    for _ in range(30):
        base = words(rng, 150)
        texts.append(" ".join(base))
        for _ in range(3):
            base = list(base)
            base[rng.randrange(150)] = "changed"
            texts.append(" ".join(base))
    prints = [plain_fingerprint(t or "") for t in texts]
    want = components(len(texts), [(i, j) for i in range(len(texts)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
    d = frame(spark, texts)
    got = {r.doc_id: r for r in simhash.near_duplicates(d).collect()}
    assert [got[i].fp % (1 << 64) for i in range(len(texts))] == prints
    assert [got[i].component for i in range(len(texts))] == want
    assert simhash.near_duplicates(d.where("false")).count() == 0


def plain_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_stage_drops_texts_of_similarity_08(spark):
    """Five-word shingles by brute force: pairs clearly above 0.8 lose a text, pairs clearly below lose none."""
    rng = random.Random(18)
    texts = [None, "", " \n", "a b", "A b", "x " * 30_000, "y z"]
    for change in [1] * 12 + [2] * 12 + [14] * 12:
        base = words(rng, 150, 100_000)
        other = list(base)
        for i in range(change):
            other[10 * i + 5] = "changed"
        texts += [" ".join(base), " ".join(other)]
    sets = [plain_shingles(t) for t in texts]
    like = [[(len(a & b) / len(a | b) if a | b else 1.0) for b in sets] for a in sets]
    n = len(texts)
    assert not any(0.55 < like[i][j] < 0.85 for i in range(n) for j in range(i))
    want = set(components(n, [(i, j) for i in range(n) for j in range(i) if like[i][j] >= 0.8]))
    d = frame(spark, texts).withColumn("s", F.lit(1)).withColumn("_key", F.lit(2))
    kept = simhash.drop_near_duplicates(d)
    got = {r.doc_id for r in kept.collect()}
    assert kept.columns == d.columns and want <= got and len(got - want) <= 1  # nine in ten of the pairs near the similarity, at least
    shared = frame(spark, ["one " * 9, "two words", "one " * 9]).withColumn("doc_id", F.lit(None).cast("long"))
    assert sorted(r.text for r in simhash.drop_near_duplicates(shared).collect()) == ["one " * 9, "two words"]


def test_stage_splits_hot_nodes(spark):
    rng = random.Random(19)
    base = words(rng, 400, 100_000)
    texts = []
    for i in range(60):
        other = list(base)
        other[rng.randrange(400)] = f"c{i}"
        texts.append(" ".join(other))
    classes = frame(spark, texts).select(F.col("doc_id").alias("fp"), simhash.sketch_udf("text").alias("s"))
    from docengine.llm.common import connected_components

    for node in (8, 4096):
        found = dict(connected_components(simhash.sketch_links(classes, simhash.stage_distance(), node, 1)).collect())
        assert found == dict.fromkeys(range(60), 0)


def test_simhash_odd_rows(spark):
    d = frame(spark, [None, "", " \n", "a b", "A b"])
    assert simhash.drop_near_duplicates(d.where("doc_id = 3").union(d.where("doc_id = 3"))).count() == 1


def test_hot_nodes_are_split(spark):
    rng = random.Random(2)
    prints = sorted({rng.getrandbits(6) | rng.getrandbits(4) << 40 for _ in range(300)})
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    from docengine.llm.common import connected_components

    for node in (16, 4096):
        links = simhash.fingerprint_links(df, node)
        got = dict(connected_components(links).collect())
        want = components(len(prints), [(i, j) for i in range(len(prints)) for j in range(i) if (prints[i] ^ prints[j]).bit_count() <= 4])
        assert [got.get(p, p) for p in prints] == [prints[i] for i in want]


def plain_removal(texts, length):
    data = [(t or "").encode() for t in texts]
    seen = Counter(t[i : i + length] for t in data for i in range(len(t) - length + 1))
    out = []
    for t in data:
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        spans = sum(g and (not i or not gone[i - 1]) for i, g in enumerate(gone))
        out.append((len(t), sum(gone), spans, hashlib.sha256(bytes(c for c, g in zip(t, gone, strict=True) if not g)).hexdigest()))
    return out


@pytest.mark.parametrize("hot,shard", [(4096, 2048), (4, 2)])
def test_suffix_is_brute_force(spark, hot, shard):
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(90))
    texts = [None, "", "abc", "z" * 150, "ab" * 60]
    texts += ["".join(rng.choice("abcdefgh é") for _ in range(rng.randrange(200))) + passage[rng.randrange(20) :] + "".join(rng.choice("abc") for _ in range(60)) for _ in range(30)]
    texts += [texts[-1], texts[-2]]
    d = frame(spark, texts)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix.remove_repeats(d, 40, hot, shard, 1).collect()}
    assert [got[i] for i in range(len(texts))] == plain_removal(texts, 40)
    assert suffix.remove_repeats(d.where("false")).count() == 0


def test_suffix_odd_rows(spark):
    """Ids that are null, repeated or strings, equal rows, a very long text, and columns named like the operator's own."""
    rng = random.Random(13)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(300))
    long = "".join(rng.choice("abcdefghijkl ") for _ in range(300_000)) + passage
    rows = [("a", "x" * 50 + passage), ("a", passage + "y"), (None, "z" + passage), ("b", "only once " * 3), ("c", "only once " * 3), ("c", "only once " * 3), (None, None), ("d", long)]
    want = sorted((i or "", *p) for (i, _), p in zip(rows, plain_removal([t for _, t in rows], 200), strict=True))
    for cast in ("string", "long"):
        ids = {None: None, "a": 1, "b": 2, "c": 3, "d": 4}
        d = spark.createDataFrame([(i if cast == "string" else ids[i], t, 1, 2, 3) for i, t in rows], f"doc_id {cast}, text string, uid int, h int, spans int")
        got = suffix.remove_repeats(d).collect()
        back = {v: k for k, v in ids.items()} | {k: k for k in ids}
        assert sorted((back[r.doc_id] or "", r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in got) == want


def test_suffix_arrays_decide_on_bytes():
    """Windows of runs that share an anchor only: classes are equal exactly where the bytes are."""
    rng = random.Random(14)
    texts = [("".join(rng.choice("ab") for _ in range(40)) + "anchor" * 8 + "".join(rng.choice("ab") for _ in range(40))).encode() for _ in range(20)]
    text, window, cls = suffix.repeated_windows(texts, 50)
    groups = {}
    for t, w, c in zip(text.tolist(), window.tolist(), cls.tolist(), strict=True):
        groups.setdefault(c, set()).add(texts[t][w : w + 50])
    assert all(len(g) == 1 for g in groups.values()) and len({x for g in groups.values() for x in g}) == len(groups)


def test_chaining_finds_pieces_that_stand_elsewhere(spark):
    """A passage whose every piece was seen first in another document."""
    rng = random.Random(15)
    for size in (20, 5):
        passage = words(rng, 120)
        texts = [" ".join(words(rng, 60) + passage[i : i + size] + words(rng, 60)) for i in range(0, 120, size)]
        n = len(texts)
        texts += [" ".join(words(rng, 60) + passage + words(rng, 60)) for _ in range(4)]
        got = {r.doc_id: r.component_id for r in chaining.repeated_passages(frame(spark, texts)).collect()}
        assert got == dict.fromkeys(range(n, n + 4), n)


def plain_passage(a, b):
    """Most words of a stretch of ``a`` and ``b`` of which four in five match, by trying every alignment (changed words only)."""
    best, a, b = 0, np.array(a), np.array(b)
    for shift in range(-len(b) + 40, len(a) - 39):
        ok = a[max(0, shift) : min(len(a), len(b) + shift)] == b[max(0, -shift) : min(len(b), len(a) - shift)]
        if ok.sum() >= 32:
            c = np.concatenate([[0], np.cumsum(ok - 0.8)])
            best = max(best, *(int(np.flatnonzero(c[i:] >= c[i] - 1e-9)[-1]) for i in range(len(c))))
    return best


def test_chaining_recall_against_brute_force(spark):
    """Fuzzy passages of 50 to 120 words, one word in twenty changed: nine in ten links, at least, and no false one."""
    rng = random.Random(16)
    texts = []
    for _ in range(25):
        passage = words(rng, rng.randrange(50, 120), 100_000)
        for _ in range(2):
            fuzzy = [rng.choice("xyz") if rng.random() < 0.05 else w for w in passage]
            texts.append(words(rng, rng.randrange(30, 90), 100_000) + fuzzy + words(rng, rng.randrange(30, 90), 100_000))
    want = {(i, j) for i in range(len(texts)) for j in range(i + 1, len(texts)) if plain_passage(texts[i], texts[j]) >= 45}
    got = {}
    d = frame(spark, [" ".join(t) for t in texts]).withColumn("uid", F.lit(1)).withColumn("word", F.lit(2))
    for r in chaining.repeated_passages(d).collect():
        got.setdefault(r.component_id, []).append(r.doc_id)
    links = {(min(g), x) for g in got.values() for x in g if x != min(g)}
    assert all(len(g) == 2 for g in got.values())
    assert len(want) >= 20 and len(want & links) >= 0.9 * len(want) and all(i // 2 == j // 2 for i, j in links)


def edited(rng, passage, kind):
    """Every fifth word changed, or about one in nine inserted, deleted or either."""
    out = []
    for i, w in enumerate(passage):
        what = kind if kind != "mixed" else rng.choice(["inserted", "deleted"])
        if kind == "changed":
            out.append(f"z{i}" if i % 5 == 4 else w)
        elif i % 9 == 8:
            out += [w, f"z{i}"] if what == "inserted" else []
        else:
            out.append(w)
    return out


@pytest.mark.parametrize("kind", ["changed", "inserted", "deleted", "mixed"])
def test_chaining_misses_no_passage_at_the_threshold(spark, kind):
    """Four words in five match, or six in seven with insertions and deletions: each pair is linked."""
    rng = random.Random(21)
    texts = []
    for _ in range(40):
        passage = words(rng, rng.randrange(50, 90), 100_000)
        for p in (passage, edited(rng, passage, kind)):
            texts.append(" ".join(words(rng, 60, 100_000) + p + words(rng, 60, 100_000)))
    got = {r.doc_id: r.component_id for r in chaining.repeated_passages(frame(spark, texts)).collect()}
    assert got == {i: i - i % 2 for i in range(80)}


def test_chaining_odd_rows(spark):
    rng = random.Random(17)
    passage = " ".join(words(rng, 100))
    long = " ".join(words(rng, 60_000, 10**6)) + " " + passage
    rows = [("a", passage), ("a", passage), (None, "x " + passage), ("b", long), ("c", None), ("d", "short")]
    got = chaining.repeated_passages(spark.createDataFrame(rows, "doc_id string, text string")).collect()
    assert sorted((r.doc_id or "") for r in got) == ["", "a", "b"] and {r.component_id for r in got} == {"a"}


def test_chaining_finds_passages(spark):
    rng = random.Random(4)
    passage = words(rng, 120)
    fuzzy = list(passage)
    fuzzy[40] = "other"
    del fuzzy[80]
    texts = [None, "", "few words"] + [" ".join(words(rng, 200)) for _ in range(10)]
    texts += [" ".join(words(rng, 60) + passage + words(rng, 60)), " ".join(words(rng, 30) + fuzzy + words(rng, 90)), " ".join(fuzzy)]
    got = {r.doc_id: r for r in chaining.repeated_passages(frame(spark, texts)).collect()}
    assert set(got) == {13, 14, 15} and {r.component_id for r in got.values()} == {13}
    assert all(r.n_words >= 100 for r in got.values())
    assert chaining.repeated_passages(frame(spark, texts).where("false")).count() == 0


def test_chaining_splits_hot_seeds(spark):
    rng = random.Random(5)
    passage = words(rng, 80)
    d = frame(spark, [" ".join(words(rng, 20) + passage + words(rng, 20)) for _ in range(40)])
    for hot in (4, 4096):
        got = chaining.repeated_passages(d, hot, 1).collect()
        assert len(got) == 40 and {r.component_id for r in got} == {0}


@pytest.mark.parametrize("hot", [4, 4096])
def test_chaining_finds_passages_of_frequent_lines(spark, hot):
    rng = random.Random(8)
    lines = [words(rng, 14) for _ in range(5)]
    passage = [w for line in lines for w in line]
    # Parts of the passage, two lines each, stand alone in earlier documents, so each seed is seen first elsewhere.
    texts = [" ".join(words(rng, 60) + lines[i] + lines[i + 1] + words(rng, 60)) for i in range(4) for _ in range(5)]
    texts += [" ".join(words(rng, 60) + passage + words(rng, 60)) for _ in range(2)]
    # The last has all its lines once alone before the passage.
    texts.append(" ".join([w for line in lines for w in words(rng, 30) + line] + words(rng, 30) + passage))
    got = {r.doc_id: r for r in chaining.repeated_passages(frame(spark, texts), hot, 1).collect()}
    assert set(got) == {20, 21, 22} and {r.component_id for r in got.values()} == {20}
    assert all(r.n_words >= len(passage) for r in got.values())


@pytest.mark.parametrize("block", [2048, 3])
def test_chaining_links_passages_of_frequent_seeds_only(spark, monkeypatch, block):
    """Ten pieces of five words, each frequent and seen first elsewhere, with another word after each: 50 of 60 words match."""
    monkeypatch.setattr(chaining, "BLOCK", block)
    rng = random.Random(31)
    pieces = [words(rng, 5, 10**6) for _ in range(10)]
    alone = [words(rng, 60, 10**6) + x + words(rng, 60, 10**6) for x in pieces for _ in range(40)]
    both = [words(rng, 60, 10**6) + [w for x in pieces for w in [*x, *words(rng, 1, 10**6)]] + words(rng, 60, 10**6) for _ in range(2)]
    # Half the pieces are too few.
    half = words(rng, 60, 10**6) + [w for x in pieces[:5] for w in [*x, *words(rng, 1, 10**6)]] + words(rng, 60, 10**6)
    got = {r.doc_id: r for r in chaining.repeated_passages(frame(spark, [" ".join(x) for x in [*alone, *both, half]]), 4, 1).collect()}
    assert {k: r.component_id for k, r in got.items()} == {400: 400, 401: 400}
    assert all(r.n_words >= 54 for r in got.values())


def test_chaining_words_shared_beside_a_run():
    rng = np.random.default_rng(8)
    near = rng.integers(0, 6, (50, chaining.LEFT + chaining.RIGHT)).astype(np.int32)
    near[rng.random(near.shape) < 0.5] = -1
    after = rng.integers(0, 5, 50)
    assert [chaining.beside(n) for n in (4, 7, 8, 15, 16, 23, 24, 31, 32, 39)] == [4, 4, 3, 3, 2, 2, 1, 1, 0, 0]
    for long, size in ((4, 4), (12, 3), (20, 2)):
        sides = [[r[: chaining.LEFT].tolist(), r[chaining.LEFT + long :][: chaining.REACH + chaining.DRIFT].tolist()] for r in near]
        grams = [{g for x in both for k in range(len(x)) if len(g := tuple(x[k : k + size])) == size and min(g) >= 0} for both in sides]
        want = {(i, j) for i, a in enumerate(grams) for j, b in enumerate(grams) if after[i] < after[j] and a & b}
        got = {(int(i), int(j)) for x, y in chaining.share_words(near, after, long, size) for i, j in zip(x, y, strict=True)}
        assert got == want and 0 < len(want)
    # Every fifth word changed at least, over passages of 40 to 79 words: some run beside any run is that long.
    for _ in range(2000):
        n = int(rng.integers(40, 80))
        miss = np.sort(rng.choice(n, n // 5, replace=False))
        runs = np.diff(np.concatenate([[-1], miss, [n]])) - 1
        for k, run in enumerate(runs.tolist()):
            assert run < chaining.SEED or run >= 40 or max([*runs[:k], *runs[k + 1 :]]) >= chaining.beside(run)


def test_chaining_stretches_of_many_rows():
    rng = np.random.default_rng(22)
    for wide in (50, 128, 230):
        ok = rng.random((40, wide)) < rng.choice([0.7, 0.78, 0.82, 0.9], (40, 1))
        lo, hi = rng.integers(0, wide // 3, 40), wide - rng.integers(0, wide // 3, 40)
        want = sorted((i, int(lo[i]) + s, int(lo[i]) + e, n) for i in range(40) for s, e, n in chaining.stretches(ok[i, lo[i] : hi[i]]))
        assert want and sorted(zip(*(c.tolist() for c in chaining.many_stretches(ok, lo, hi)), strict=True)) == want


def test_chaining_looks_before_it_aligns():
    """Some 32 to 63 words of which four in five stand in the other text, near the diagonal: by every window."""
    rng = np.random.default_rng(23)
    y = rng.integers(0, 50_000, (200, 128 + 2 * chaining.DRIFT)).astype(np.int32)
    x = y[:, chaining.DRIFT : -chaining.DRIFT].copy()
    for k in range(200):
        x[k] = np.where(rng.random(128) < rng.choice([0.6, 0.75, 0.8, 0.9]), x[k], -1)
        x[k, : rng.integers(0, 90)] = -1
    stands = [np.array([[x[k, i] in y[k, i : i + 2 * chaining.DRIFT + 1] for i in range(128)] for k in range(200)])]
    stands.append(np.array([[y[k, j] in x[k, max(0, j - 2 * chaining.DRIFT) : j + 1] for j in range(y.shape[1])] for k in range(200)]))
    enough = [[any(5 * side[k, i : i + n].sum() >= 4 * n for n in range(32, 64) for i in range(side.shape[1] - n + 1)) for k in range(200)] for side in stands]
    got = chaining.likely(x, y).tolist()
    assert got == [a and b for a, b in zip(*enough, strict=True)] and 20 < sum(got) < 180


def passages_of_a_hub(rng):
    """Passages of one text of 4000 words, each in three others, and a long one that is changed, in two."""
    hub = words(rng, 4000, 100_000)
    texts = [hub] + [words(rng, 50, 100_000) + hub[at : at + 60 + at % 40] + words(rng, 50, 100_000) for at in range(0, 3600, 150) for _ in range(3)]
    return [" ".join(t) for t in [*texts, edited(rng, hub[100:2000], "changed"), edited(rng, hub[100:2000], "mixed")]]


def test_chaining_moves_words_once_for_either_side(spark, monkeypatch):
    """From chains to passages two shuffles and no join with words, blocks or chains, so the cost doesn't grow with blocks of words."""
    plans, written = [], chaining.written

    def seen(df, name):
        plans.append((name, df._jdf.queryExecution().optimizedPlan().toString()))
        return written(df, name)

    monkeypatch.setattr(chaining, "written", seen)
    got = chaining.repeated_passages(frame(spark, passages_of_a_hub(random.Random(24)))).collect()
    assert len(got) == 75 and {r.component_id for r in got} == {0}
    name, plan = plans[-1]
    assert name == "passages" and plan.count("RepartitionByExpression") == 2
    joins = [line for _, p in plans for line in p.splitlines() if "Join " in line]
    assert all("strategy=broadcast" in line for line in joins), joins


def test_chaining_shares_a_text_among_tasks(spark, monkeypatch):
    """A text that many chains end in is worked on by several tasks, with the same result."""
    texts = passages_of_a_hub(random.Random(25))
    want = sorted(tuple(r) for r in chaining.repeated_passages(frame(spark, texts)).collect())
    monkeypatch.setattr(chaining, "MANY", 3)
    assert sorted(tuple(r) for r in chaining.repeated_passages(frame(spark, texts)).collect()) == want and len(want) == 75


def test_chaining_aligns_over_the_borders_of_batches(monkeypatch):
    rng = np.random.default_rng(26)
    rows = []
    for text in range(3):
        w = rng.integers(0, 1 << 16, 600).astype(np.uint16)
        rows.append((None, text, None, None, w.tobytes()))
        for at in (0, 30, 200, 540):
            a = np.concatenate([rng.integers(0, 1 << 16, 70).astype(np.uint16), w[at : at + 60], rng.integers(0, 1 << 16, 70).astype(np.uint16)])
            rows.append((100 + at, text, 70, np.array([70, at, 20 + at % 40], np.int32).tobytes(), a[70 - chaining.REACH :].tobytes()))
    rows += [(7, 99, *rows[1][2:])]  # chains without their text
    kinds = pa.schema([("uid", pa.int64()), ("partner", pa.int64()), ("q0", pa.int32()), ("frags", pa.binary()), ("words", pa.binary())])
    monkeypatch.setattr(chaining, "_gathered", lambda batches: batches)
    for size in (1, 2, 5, 100):
        got = [tuple(r.values()) for b in chaining._align_rows(iter(pa.Table.from_pylist([dict(zip(kinds.names, r, strict=True)) for r in rows], kinds).to_batches(max_chunksize=size))) for r in b.to_pylist()]
        assert sorted(got) == sorted((100 + at, text, 70, 130, at, at + 60, 60) for text in range(3) for at in (0, 30, 200, 540))


def test_mix(spark):
    d = frame(spark, [None, "", "a b c"] + [f"w{i} " * (i % 40) for i in range(600)]).withColumn("source", F.when(F.col("doc_id") % 50 == 7, None).otherwise(F.col("source")))
    once, again = (mixing.mix(d).orderBy("doc_id").collect() for _ in range(2))
    assert once == again and len(once) == d.count()
    taken, target, size = Counter(), {}, {}
    for r in once:
        taken[r.source] += r._copies * len((r.text or "").split())
        target[r.source], size[r.source] = r._target, r._source_size
        assert r._copies in (0, 1, 2) and (r._shard is not None) == (r._copies > 0)
    assert abs(sum(target.values()) - 1.5 * sum(size.values())) < 1
    assert all(target[s] <= 2 * size[s] + 1e-6 and target[s] - 40 <= taken[s] <= target[s] for s in target)
    assert mixing.mix(d.where("false")).count() == 0


def test_mix_tries_what_fits_after_a_long_document(spark):
    rng = random.Random(12)
    texts = [" ".join(words(rng, 6000))] + [" ".join(words(rng, rng.randrange(20, 60))) for _ in range(150)]
    d = frame(spark, texts).withColumn("source", F.when(F.col("doc_id") < 100, "a").otherwise("b"))
    got = mixing.mix(d).collect()
    for s in ("a", "b"):
        mine = [r for r in got if r.source == s]
        assert mine[0]._target - 60 <= sum(r._copies * len(r.text.split()) for r in mine) <= mine[0]._target


def test_mix_shards_come_from_the_tree(spark):
    d = frame(spark, [f"w{i} " * (1 + i % 40) for i in range(3000)])
    got = mixing.mix(d, shard_words=1 << 9).where("_copies > 0").collect()
    shards = Counter(r._shard for r in got)
    assert set(shards) <= set(range(256)) and len(shards) > 100
    assert len({(r.doc_id, r._shard) for r in got}) == len(got)
    units = spark.createDataFrame([(f"s{i % 3}", i // 3 + 1) for i in range(96)], "name string, unit int")
    tree = mixing.split_tree(units, 3).collect()
    assert Counter(r.shard for r in tree) == {k: 12 for k in range(8)} and Counter(r["name"] for r in tree) == {f"s{k}": 32 for k in range(3)}
    assert len({(r["name"], r.unit) for r in tree}) == 96


def test_mix_keeps_null_keys_and_clashing_names(spark):
    d = frame(spark, [f"w{i} " * 5 for i in range(60)]).withColumn("doc_id", F.when(F.col("doc_id") % 20 > 0, F.col("doc_id")))
    odd = ["target", "source_size", "rest", "whole", "shards", "name", "kid", "block", "size", "_name", "copies", "a.b"]
    for c in odd:
        d = d.withColumn(c, F.lit("x"))
    got = mixing.mix(d).collect()
    assert len(got) == 60 and sum(r.doc_id is None for r in got) == 3
    assert all(r._copies in (0, 1, 2) and r.target == "x" and r["a.b"] == "x" for r in got)


def test_topk_is_brute_force(spark):
    rng = random.Random(6)
    v = [(i, [rng.gauss(0, 1) for _ in range(8)]) for i in range(120)] + [(200, None), (201, [float("nan")] * 8), (202, [0.5] * 8), (203, [0.5] * 8), (204, [None] + [0.5] * 7)]
    df = topk.integer_vectors(spark.createDataFrame(v, "vec_id long, embedding array<double>"))
    plain = {r.vec_id: r.v for r in df.collect()}
    assert set(plain) == set(range(120)) | {202, 203}
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id % 20 = 2"), 5, 16, 3, 1).collect()}
    for q in (i for i in plain if i % 20 == 2):
        best = sorted((-sum(a * b for a, b in zip(plain[q], w, strict=True)), i) for i, w in plain.items() if i != q)[:5]
        assert [got[q, k + 1] for k in range(5)] == [(i, -s) for s, i in best]
    assert topk.top_k(df.where("false"), df).count() == 0


def test_topk_of_large_and_repeated_vectors(spark):
    big = [(i, [10**9 + i, -(10**9), i]) for i in range(40)] + [(3, [0, 0, 0])] + [(100, [1, 2])]
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in big], "vec_id long, v array<long>, score string, cell int")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, df.where("vec_id in (7, 100)")).collect()}
    plain = dict(big[:40]) | {3: [0, 0, 0]}
    best = sorted((-sum(a * b for a, b in zip(plain[7], v, strict=True)), i) for i, v in plain.items() if i != 7)[:5]
    assert got == {(7, k + 1): (i, -s) for k, (s, i) in enumerate(best)}
    over = spark.createDataFrame([(i, [1 << 40, 1 << 40]) for i in range(3)], "vec_id long, v array<long>")
    with pytest.raises(Exception, match="beyond a long"):
        topk.top_k(over, over).collect()


def test_topk_sums_beyond_floats_are_exact(spark):
    """Bounds between 53 and 61 bits are whole numbers too: no row is proved out by a rounded one."""
    for seed in range(20):
        rng = np.random.default_rng(seed)
        low, high = (1 << 25, 1 << 26) if seed % 2 else (1 << 27, 1 << 28)
        v = np.repeat(rng.integers(low, high, (1, 24)), 50, 0) + (rng.integers(0, 2, (50, 24)) if seed % 3 else 0)
        q = rng.integers(low, high, 24)
        rows, scores = topk.ImpactIndex(np.arange(50), v).search(q, 5, -1)
        want = sorted((sum(int(x) * int(y) for x, y in zip(r, q, strict=True)) for r in v), reverse=True)[:5]
        assert sorted(scores.tolist(), reverse=True)[:5] == want


def test_topk_takes_segments_by_impact():
    """Sums of impacts bound scores from above at any point, and the search stops early where the bounds allow it."""
    rng = np.random.default_rng(1)
    v = rng.integers(-50, 50, (3000, 8))
    v[:10] = 400
    index = topk.ImpactIndex(np.arange(3000), v)
    q = rng.integers(1, 9, 8)
    impact, base = index.impacts(q)
    assert (np.diff(index.start).sum() == v.size) and all((base + sum(int(impact[s]) for s in np.flatnonzero([r in index.postings[a:b] for a, b in zip(index.start, index.start[1:], strict=False)]))) >= int(v[r] @ q) for r in (0, 5, 77))
    rows, scores = index.search(q, 5, -1)
    assert len(rows) < 100 and set(np.argsort(-(v @ q), kind="stable")[:10]) <= set(rows.tolist()) and (scores == v[rows] @ q).all()


def test_decontaminate(spark):
    b = spark.createDataFrame([(0, "A farmer in Norway sold 12 kg of apples to Maria for 30 dollars and then bought 5 new baskets"), (1, ""), (2, None)], "item_id long, text string")
    rng = random.Random(7)
    filler = lambda: " ".join(words(rng, 40))
    item = b.first()["text"]
    other = item.replace("12 kg", "15 kg").replace("Norway", "Poland").replace("Maria", "Anna")
    d = frame(spark, [f"{filler()} {item} {filler()}", f"{filler()} {other} {filler()}", filler(), None, "", "A farmer sold apples."])
    got = {r.doc_id: r for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == {0, 1} and got[0].same_slots and not got[1].same_slots
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {2, 3, 4, 5}
    assert decontaminate.drop_contaminated(d, b.where("false")).count() == 6
    # Equal items are one: no row for each of them.
    again = b.union(b.select(F.lit(9).alias("item_id"), "text")).union(b.select(F.lit(10).alias("item_id"), "text"))
    assert {(r.doc_id, r.item_id, r.n_items) for r in decontaminate.contaminated(d, again).collect()} == {(0, 0, 3), (1, 0, 3)}


def plain_template(text):
    """(word in small letters, kind of placeholder) of each word that has a core."""
    out, before, end = [], None, 0
    for m in re.finditer(r"[^\x20\x09-\x0d]+", text or ""):
        core = re.sub(r"^[\x00-\x24\x26-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+|[\x00-\x24\x26-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+$", "", m[0])
        if not core:
            continue
        first = before is None or before[-1] in '.!?:"' or "\n" in text[end : m.start()]
        low = core.lower()
        number = bool(re.search("[0-9]", core) and re.fullmatch(r"[0-9.,:/%-]+", core)) or low in decontaminate.NUMBER_WORDS
        unit = not number and low in decontaminate.UNITS and out and out[-1][1] == "num"
        name = re.match(r"[A-Z]", core) and not first
        out.append((low, "unit" if unit else "num" if number else "name" if name else "", core))
        before, end = m[0], m.end()
    return out


def plain_windows(text, widths):
    t = plain_template(text)
    for width in widths:
        for i in range(len(t) - width + 1):
            part = t[i : i + width]
            slots = [w for w in part if w[1]]
            few = len(slots) > min(2, width - 1)
            yield i, width, tuple(w[0] if few or not w[1] else (w[1],) for w in part), [] if few else [f"{w[1]}:{w[2]}" for w in slots]


def test_decontaminate_is_brute_force(spark):
    rng = random.Random(11)
    filler = ["Tom", "sold", "12", "kg", "of", "apples", "in", "Rome", "for", "3", "dollars", "then", "he", "bought", "more", "seven", "pears", "and", "gave", "them", "away", "while", "she", "kept", "few"]
    sentence = lambda n: " ".join(rng.choice(filler) for _ in range(n)) + rng.choice([".", "?", "", "\n"])
    items = [" ".join(sentence(rng.randrange(6, 14)) for _ in range(2)) for _ in range(12)] + ["kg of pears", "", None]
    texts = [None, ""]
    for i in range(60):
        item = items[i % 13] or ""
        if i % 3 == 1:
            item = item.replace("12", "40").replace("Rome", "Oslo")
        if i % 5 == 2:
            item = item[: len(item) * 2 // 3]
        texts.append(f"{sentence(15)} {item} {sentence(15)}")
    rows = {i: t for i, t in enumerate(items) if t}
    want = set()
    for d, text in enumerate(texts):
        for i, item in rows.items():
            size = len(plain_template(item))
            widths = [min(size, 5)]
            mine = list(plain_windows(item, widths))
            m = [(p, q, w, a, b) for p, w, h, b in plain_windows(text, widths) for q, _, g, a in mine if g == h]
            if any(ok and (c >= 20 or c / size >= 0.8) for c, _, _, ok, _ in decontaminate.item_chains(m)):
                want.add((d, i))
    b = spark.createDataFrame(list(enumerate(items)), "item_id long, text string").withColumn("tag", F.lit(1)).withColumn("h", F.lit(2))
    got = {(r.doc_id, r.item_id) for r in decontaminate.contaminated(frame(spark, texts), b).collect()}
    assert got == want and len(want) > 20


def test_decontaminate_items_with_repeated_clauses(spark):
    clause = "the baker sold 3 loaves of brown bread before noon"
    item = f"when the shop opened {clause} and then later on {clause} so how many loaves did he sell altogether that day"
    b = spark.createDataFrame([(0, item)], "item_id long, text string")
    rng = random.Random(9)
    filler = lambda: " ".join(words(rng, 40))
    d = frame(spark, [f"{filler()} {t} {filler()}" for t in (item, item.replace(" 3 ", " 8 "), clause, item.replace(" 3 ", " 8 ", 1))])
    got = {r.doc_id: r for r in decontaminate.contaminated(d, b).collect()}
    assert set(got) == {0, 1} and got[0].same_slots and not got[1].same_slots
    assert got[0].coverage == 1 and (got[0].start_word, got[0].end_word) == (40, 40 + len(item.split()))
    assert {r.doc_id for r in decontaminate.drop_contaminated(d, b).collect()} == {2, 3}

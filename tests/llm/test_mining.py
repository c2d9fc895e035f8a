"""Operators 11, 12 and 13 against brute force, on odd rows, hot groups and small parts."""

import math
import random
import re
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docengine.llm import circulant, lexical, negatives
from docengine.llm.common import materialize
from tests.conftest import SF
from tests.test_oracle import TABLES, cells

from .test_dedup import components


@pytest.mark.parametrize("module", [negatives, lexical, circulant])
def test_matches_sql(spark, module):
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    for name, sql in module.ORACLE.items():
        got, want = module.QUERIES[name](spark, SF).toPandas(), con.sql(sql).df()
        assert sorted(got.columns) == sorted(want.columns) and len(got)
        assert cells(got, sorted(got.columns)) == cells(want, sorted(got.columns))


def plain_negatives(rows, every, k=5):
    out = []
    for a, la, va in (r for r in rows if r[0] % every == 0):
        s = {i: (label, sum(x * y for x, y in zip(va, v, strict=True))) for i, label, v in rows if i != a and len(v) == len(va)}
        best = lambda keep: sorted((-x, i) for i, (label, x) in s.items() if keep(label, x))[:k]
        for p, i in best(lambda label, x: label == la):
            out += [(a, i, n + 1, j, -p, -x) for n, (x, j) in enumerate(best(lambda label, x: label != la and 80 * -p <= 100 * x <= 100 * -p))]
    return sorted(out)


def test_hard_negatives_are_brute_force(spark):
    rng = random.Random(11)
    schema = "vec_id long, label long, v array<long>, cell int, kind string, scores int, `a.b` int"
    for size, n, block in ((3, 300, 64), (40, 200, 2048), (1 << 25, 150, 32), (1 << 28, 120, 1000), (1 << 40, 60, 16)):  # ties; past 24, 53 and 62 bits
        rows = [(i, rng.randrange(3), [rng.randrange(-size, size + 1) for _ in range(6)]) for i in range(n)]
        rows = [(i, lb, v if i % 11 else rows[0][2]) for i, lb, v in rows]
        if size > 1 << 30:
            rows = [(i, lb, [x >> 12 for x in v]) for i, lb, v in rows]
        rows += [(n + i, i % 3, rows[i][2][:4]) for i in range(40)]  # other lengths
        df = spark.createDataFrame([(*r, 1, "k", 2, 3) for r in rows + rows[:9]], schema)  # repeated rows
        got = negatives.hard_negatives(df, F.col("vec_id") % 10 == 0, block=block, group=7).collect()
        assert sorted(tuple(r) for r in got) == plain_negatives(rows, 10)
    assert negatives.hard_negatives(df.where("false"), F.col("vec_id") % 10 == 0).count() == 0


def test_hard_negatives_odd_rows(spark):
    bad = [(None, 1, [1.0]), (2, None, [1.0]), (3, 1, None), (4, 1, [None]), (5, 1, [float("nan")]), (6, 1, [float("inf")]), (100, 1, []), (200, 2, [0.5]), (201, 2, [0.5]), (202, 3, [0.5])]
    df = spark.createDataFrame(bad, "vec_id long, label int, embedding array<float>")
    got = negatives.hard_negatives(negatives.labelled_vectors(df), F.col("vec_id") % 100 == 0).collect()
    assert [tuple(r) for r in got] == [(200, 201, 1, 202, 128 * 128, 128 * 128)]


def test_bit_planes_drop_candidates_by_proof():
    rng = np.random.default_rng(1)
    v = rng.integers(-500, 500, (2000, 16))
    s = negatives.BitSlices(np.arange(2000), np.zeros(2000, np.int64), v)
    left: list[int] = []
    rows, score = s.refine(v[0], np.arange(1, 2000), lambda low, high: high >= np.sort(low)[-5], left)
    want = v[1:] @ v[0]
    assert sorted(score.tolist())[-5:] == sorted(want.tolist())[-5:]
    assert len(left) == s.bits and left[2] < 1999 and left[5] < 200  # most go long before the last plane


def plain_terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain_rank(docs, items, k=10):
    held = [(i, Counter(plain_terms(t))) for i, t in docs]
    held = [(i, c) for i, c in held if c]
    n, words = len(held), sum(c.total() for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = []
    for item in dict.fromkeys(i for i, _ in items):
        terms = {t for i, text in items if i == item for t in plain_terms(text)}
        scores = []
        for i, c in held:
            m = 10 + 90 * c.total() * n // words
            s = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * (1000000000 * c[t] // (1000 * c[t] + 8 * m)) for t in terms if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, rank + 1, i, -s) for rank, (s, _, _, i) in enumerate(sorted(scores)[:k])]
    return out


def test_ranked_is_brute_force(spark):
    rng = random.Random(12)
    vocabulary = ["the", "Éa", "éa", "x1", "naïve", "数据", "KK", "İx", *(f"w{i}" for i in range(60))]
    text = lambda n: "".join(rng.choice(vocabulary) + rng.choice(" ,.-_\n /") for _ in range(n))
    docs = [(i, text(rng.choice([1, 3, 20, 60]))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, " .,"), (None, text(30)), (203, "the " * 30000 + "w1"), (204, docs[0][1]), (205, docs[0][1]), (5, text(8))]
    items = [(1, text(6)), (2, text(40)), (3, None), (4, "zzz"), (None, "w1 w2"), (1, "w3")]
    d = spark.createDataFrame([(*r, "a", 1, 2, 3) for r in docs], "doc_id long, text string, term string, bucket int, n int, `a.b` int")
    b = spark.createDataFrame([(*r, "a") for r in items], "item_id long, text string, term string")
    want = sorted(plain_rank(docs, items), key=str)
    asked = materialize(lexical.item_terms(b), "items")
    for only, sent in ((asked, lexical.SENT), (None, lexical.SENT), (asked, 1)):
        got = lexical.rank(lexical.postings(d, only=only), asked, sent=sent).collect()
        assert sorted((tuple(r) for r in got), key=str) == want
    assert lexical.rank(lexical.postings(d.where("false")), asked).count() == 0
    assert lexical.rank(lexical.postings(d), asked.where("false")).count() == 0


def plain_set(text):
    ws = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(ws[i : i + 3]) for i in range(max(1, len(ws) - 2))} if ws else set()


def plain_components(docs):
    sets = [plain_set(t) for _, t in docs]
    links = [(i, j) for i in range(len(docs)) for j in range(i) if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j])]
    label = components(len(docs), links)
    return sorted((d, len(s), min(docs[j][0] for j in range(len(docs)) if label[j] == label[i])) for i, ((d, _), s) in enumerate(zip(docs, sets, strict=True)))


@pytest.mark.parametrize("part", [512, 4])
def test_minhash_is_brute_force(spark, part):
    """Families around the threshold, with members that only others than the first link, in parts of bounded size."""
    rng = random.Random(13)
    words = lambda n, size=5000: [f"w{rng.randrange(size)}" for _ in range(n)]
    docs = []
    for size in (60, 200, 40):
        base = words(size)
        for _ in range(40):
            new = list(base)
            for _ in range(rng.randrange(4)):
                new[rng.randrange(size)] = f"n{rng.randrange(10**6)}"
            docs.append(" ".join(new))
    walk = words(100)
    for _ in range(30):  # a chain: each is like the one before, not like the first
        walk = walk[2:] + words(2)
        docs.append("  ".join(walk))
    docs += [" ".join(words(50)) for _ in range(60)] + ["A b", "a  B", "a", "A ", "a b c", "", " \n", "Éa b c d", "éa b c d", " ", "x y z x y z x y z"]
    docs += [" ".join(words(20000, 10**6))] * 2
    rng.shuffle(docs)
    docs = [*enumerate(docs), (1000, None)]
    df = spark.createDataFrame([(*r, 1, "x", 2) for r in docs], "doc_id long, text string, n int, node string, `a.b` int")
    got = sorted(tuple(r) for r in circulant.near_duplicates(df, part=part).collect())
    assert got == plain_components(docs)
    kept = circulant.drop_near_duplicates(df)
    assert kept.columns == df.columns and sorted(r.doc_id for r in kept.collect()) == [d for d, _, c in got if d == c]


def test_minhash_odd_rows(spark):
    df = spark.createDataFrame([(None, "a b c d"), (7, "a b c d"), (None, "x"), (3, None), (3, None), (9, "q r s"), (9, "q r s")], "`k.1` long, text string")
    got = sorted(map(str, (tuple(r) for r in circulant.near_duplicates(df, "k.1").collect())))
    assert got == sorted(map(str, [(None, 2, 7), (7, 2, 7), (None, 1, None), (3, 0, 3), (3, 0, 3), (9, 1, 9), (9, 1, 9)]))
    assert circulant.near_duplicates(df.where("false"), "k.1").count() == 0


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    for share in (0.2, 0.5, 0.85):
        off = []
        for _ in range(60):
            n = 400
            both = round(2 * n * share / (1 + share))
            x = rng.integers(0, 1 << 63, 2 * n - both, dtype=np.int64).astype(np.uint64)
            h = np.concatenate([np.sort(x[:n]), np.sort(x[n - both :])])
            s = circulant.signatures(np.array([0, n]), h)
            off.append((s[0] == s[1]).mean() - both / (2 * n - both))
        deviation = math.sqrt(share * (1 - share) / s.shape[1])
        assert abs(np.mean(off)) < 4 * deviation / math.sqrt(60) and np.std(off) < 1.3 * deviation


def test_shingle_sets_are_of_whole_texts():
    texts = pa.array(["a b c a b c", None, "", "one", "Two  words", "É é x", "a b c d " * 300_000])
    got = {int(r): int(n) for rows, at, h in circulant.shingle_sets(texts) for r, n in zip(rows, np.diff(np.append(at, len(h))), strict=True)}
    assert got == {0: 3, 3: 1, 4: 1, 5: 1, 6: 4}

"""Spelling variants, nearest neighbours and reversed search against brute force, with the odd cases of each."""

from __future__ import annotations

import collections
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from pageloom.llm import lexical_search as L
from pageloom.llm import neighbours as V
from pageloom.llm import spelling as S

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
LOW = {c: c + 32 for c in range(65, 91)}


def frame(spark, rows):
    return spark.createDataFrame([(i, t, None, "s", None) for i, t in rows], SCHEMA).repartition(3)


def wide(docs):
    return docs.select("*", *(F.lit(i).alias(c) for i, c in enumerate("word n node asks cut ask_cut best root rank score part place vec ask first term times item_id query_id block".split())))


# spelling


def vocabulary(rows, least, every):
    out = collections.Counter()
    for i, t in rows:
        for w in re.findall("[A-Za-zÀ-ÿ]+", t or ""):
            w = w.translate(LOW)
            h = zlib.crc32(f"{'' if i is None else i}:{w}".encode())
            if h % every == 0:
                w = w[: h % len(w)] + w[h % len(w) + 1 :]
            if len(w) >= 6:
                out[w] += 1
    return {w: n for w, n in out.items() if n >= least}


def edits(a, b):
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    a, b = sorted((a, b), key=len)
    return len(b) - len(a) == 1 and any(b[:p] + b[p + 1 :] == a for p in range(len(b)))


def expected_variants(rows, least, every):
    v = vocabulary(rows, least, every)
    out, form = {}, {}
    for w in v:
        near = [x for x in v if x != w and edits(w, x)]
        best = min(near, key=lambda x: (-v[x], x), default=None)
        form[w] = best if best and v[best] >= 5 * v[w] else None
        out[w] = [len(near)]
    for w in v:
        root = w
        while form[root]:
            root = form[root]
        out[w] = (v[w], out[w][0], form[w], v.get(form[w]), root)
    return out


@pytest.fixture(scope="module")
def misspelt():
    rng = random.Random(11)
    letters = "abeénostüÿ"
    bases = ["".join(rng.choice(letters) for _ in range(rng.randrange(6, 10))) for _ in range(25)] + ["aaaaaa", "aaaaaaa", "Straßen", "ÉCOLES", "abcdef" * 40]
    rows = []
    for i in range(400):
        text = []
        for _ in range(rng.randrange(1, 40)):
            w = bases[min(int(rng.expovariate(0.25)), len(bases) - 1)]
            if rng.random() < 0.3:
                p = rng.randrange(len(w))
                w = rng.choice((w[:p] + w[p + 1 :], w[:p] + rng.choice("abe") + w[p:], w[:p] + rng.choice("abe") + w[p + 1 :], w.upper()))
            text.append(w)
        rows.append((i, rng.choice((" ", "1", ". ", "漢")).join(text)))
    rows += [(1000 + i, "kettena " + "kettenab " * 20 + "kettenabc " * 200) for i in range(12)]  # a form of a form
    rows += [(None, None), (None, "aaaaaa " * 7), (5, ""), (5, "  12 "), (3, rows[3][1]), (3, rows[3][1]), (900, "x" * 50_000 + " " + "abeabe " * 3000)]
    return rows


@pytest.mark.parametrize("cell", [20_000, 7])
def test_variants(spark, misspelt, cell):
    """Also with nodes cut into many parts."""
    got = {r.word: (r.n, r.n_near, r.form, r.form_n, r.root) for r in S.variants(frame(spark, misspelt), every=13, cell_words=cell).collect()}
    want = expected_variants(misspelt, 5, 13)
    assert got == want and any(x[4] != x[2] and x[2] for x in want.values())


def test_checksums_and_slices(spark, misspelt, monkeypatch):
    monkeypatch.setattr(S, "SLICE", 64)
    data, bounds = S.utf8(__import__("pyarrow").array([t for _, t in misspelt]))
    ids = [str(i).encode() for i, _ in misspelt]
    found = collections.Counter()
    for a, b in S.slices(bounds, 300):
        words, n = S.counted(data[bounds[a] : bounds[b]], bounds[a : b + 1] - bounds[a], ids[a:b], 6, 7)
        for w, k in zip(words.to_pylist(), n):
            found[w.decode()] += k
    assert found == vocabulary([(str(i), t) for i, t in misspelt], 1, 7)


def test_every_pair_is_found_once():
    rng = random.Random(3)
    found = list({"".join(rng.choice("abéx") for _ in range(rng.randrange(2, 7))) for _ in range(900)})
    left, right = S.near_words(found, found)
    pairs = collections.Counter(frozenset((found[a], found[b])) for a, b in zip(left, right))
    assert set(pairs.values()) == {1}
    assert set(pairs) == {frozenset((a, b)) for a in found for b in found if a < b and edits(a, b)}


def test_upper_levels_reach_every_edit(spark):
    words = ["banane", "bananen", "banene", "benane", "anbane", "bananz", "qanane"]
    table = spark.createDataFrame([(w,) for w in words], "word string").withColumn("n", F.lit(1).cast("long"))
    got = {r.word: r.n_near for r in S.near(table, 10**9).collect()}  # as deep as for a huge vocabulary
    assert got == {w: n for w in words if (n := sum(edits(w, x) for x in words))}


def test_forms_are_followed_to_the_last(spark):
    forms = spark.createDataFrame([(f"w{i}", f"w{i + 1}") for i in range(9)] + [("x", "y")], "word string, form string")
    assert {r.word: r.root for r in S.roots(forms, 9).collect()} == {**{f"w{i}": "w9" for i in range(9)}, "x": "y"}


# neighbours


def brute(rows, k, every):
    width = max((len(v) for _, v in rows), default=0)
    table = {(i, tuple([*v, *[0.0] * (width - len(v))])) for i, v in rows}
    out = {}
    for i, v in table:
        if i % every == 0:
            scores = sorted(((-float((np.array(v) * np.array(w)).sum()), j) for j, w in table if j != i))
            out[i, v] = [(j, -s) for s, j in scores[:k]]
    return out


@pytest.fixture(scope="module")
def points():
    rng = np.random.default_rng(5)
    rows = [(int(i), rng.normal(size=24).tolist()) for i in range(-100, 1500)]
    rows += [(2000 + i, rows[3][1]) for i in range(700)]  # a vector that a third of all rows hold
    rows += [(4000 + i, (np.array(rows[9][1]) * s).tolist()) for i, s in enumerate((0.5, 2.0, 30.0))]
    rows += [rows[5], rows[5], (20, rows[200][1])]  # repeated rows, another vector of one id
    odd = [(None, rows[0][1]), (6000, None), (6020, [0.0] * 24), (6040, [float("nan")] * 24), (6060, [math.inf] + [1.0] * 23), (6080, [None] + [1.0] * 23), (6100, [])]
    return rows, odd


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1) for i, v in rows], "vec_id long, embedding array<double>, label int").repartition(3)


def test_neighbours(spark, points):
    rows, odd = points
    got = collections.defaultdict(list)
    for r in V.search(vectors(spark, rows + odd), k=20, block_rows=400, query_rows=50).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.rank, r.vec_id, r.score))
    want = {i: x for (i, _), x in brute(rows, 20, 20).items() if i != 20}
    assert set(got) == {*want, 20} and all([r for r, _, _ in got[i]] == list(range(1, 21)) for i in want)
    values = {i: np.array(v) for i, v in rows if i != 20}
    for i in want:
        assert all(j != i and abs(s - values[i] @ values[j]) < 1e-9 for _, j, s in got[i] if j != 20)
        assert [(-s, j) for _, j, s in got[i]] == sorted((-s, j) for _, j, s in got[i])
    right = sum(len({j for _, j, _ in got[i]} & {j for j, _ in want[i]}) for i in want)
    assert right >= 0.95 * 20 * len(want)
    assert len(got[20]) == 40  # two vectors of one id are two queries


def test_neighbours_with_all_candidates_are_exact(spark, points):
    rows = [x for x in points[0] if x[0] != 20][:300]
    got = collections.defaultdict(list)
    for r in V.search(vectors(spark, rows), k=7, every=5, share=1.0, block_rows=64, query_rows=16).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, round(r.score, 9)))
    assert got == {i: [(j, round(s, 9)) for j, s in x] for (i, _), x in brute(rows, 7, 5).items()}


def test_few_vectors(spark, points):
    assert V.search(vectors(spark, points[1])).count() == 0
    one = V.search(vectors(spark, [(20, [1.0, 2.0])]))
    assert one.count() == 0
    two = V.search(wide(vectors(spark, [(20, [1.0, 2.0]), (40, [3.0]), (41, [1.0, 2.0])]))).orderBy("query_id", "rank").collect()
    assert [tuple(r) for r in two] == [(20, 1, 41, 5.0), (20, 2, 40, 3.0), (40, 1, 20, 3.0), (40, 2, 41, 3.0)]
    assert V.search(vectors(spark, [(1, [1.0]), (2, [1.0])])).count() == 0  # no query


def test_footrule():
    """The sums of common weights order rows as the footrule distance does."""
    rng = np.random.default_rng(0)
    for pivots, prefix in ((12, 5), (9, 9)):
        order = np.array([rng.permutation(pivots)[:prefix] for _ in range(50)])
        place = np.full((50, pivots), prefix)
        place[np.arange(50)[:, None], order] = np.arange(prefix)
        near = V.InvertedFile(order, pivots).nearness(order[0])
        assert (np.abs(place - place[0]).sum(axis=1) == prefix * (prefix + 1) - 2 * near.astype(int)).all()


def test_recall_on_the_table(spark, data):
    root = data.replace("sf0.001", "sf0.1")
    table = spark.read.parquet(f"{root}/embeddings.parquet")
    rows = [(r.vec_id, r.embedding) for r in table.collect()]
    ids, values = np.array([i for i, _ in rows]), np.array([v for _, v in rows], float)
    right = total = 0
    for r in V.search(table).groupBy("query_id").agg(F.collect_list("vec_id").alias("found")).collect():
        score = values @ values[ids == r.query_id][0]
        score[ids == r.query_id] = -np.inf
        right += len(set(ids[np.argsort(-score)[:20]]) & set(r.found))
        total += 20
    assert total == 20 * (ids % 20 == 0).sum() and right >= 0.95 * total


# reversed search


def expected_search(docs, items, k):
    cut = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", (t or "").translate(LOW))
    words = [collections.Counter(cut(t)) for _, t in docs]
    sizes = [sum(w.values()) for w in words]
    n, total = sum(s > 0 for s in sizes), sum(sizes)
    asked = collections.defaultdict(collections.Counter)
    for i, t in items:
        asked[i].update(cut(t))
    out = collections.Counter()
    for item, terms in asked.items():
        scores = []
        for (doc, _), own, size in zip(docs, words, sizes):
            if not size:
                continue
            m = 100 - 25 + 25 * size * n // total
            score = 0
            for term, times in terms.items():
                df = sum(term in w for w in words)
                w = math.floor(1000 * math.log((2 * n + 2) / (2 * df + 1)))
                score += times * w * (1_000_000_000 * own[term] // (1000 * own[term] + 12 * m))
            if score > 0:
                scores.append((-score, math.inf if doc is None else doc))
        for rank, (score, doc) in enumerate(sorted(scores)[:k], 1):
            out[item, rank, None if doc == math.inf else doc, -score] += 1
    return out


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(8)
    words = ["the", "of", "Élan", "漢字", "x1", "route", "Über", "9", "und", "café"] + [f"w{n}" for n in range(60)]
    say = lambda n: rng.choice((" ", ", ", "-_")).join(words[min(int(rng.expovariate(0.08)), len(words) - 1)] for _ in range(n))
    docs = [(i, say(rng.randrange(0, 80))) for i in range(300)]
    docs += [(400 + i, "the route of Élan") for i in range(150)]  # copies: equal scores
    docs += [(None, "the route of Élan"), (None, None), (7, docs[7][1]), (8, ""), (9, "-- !"), (10, say(30_000) + " W5")]
    items = [(i, say(rng.randrange(1, 30))) for i in range(12)] + [(1, "THE route"), (50, None), (51, "..."), (None, "route w3"), (52, "nowhere"), (53, "élan ÉLAN the the")]
    return docs, items


@pytest.mark.parametrize("pass_rows", [500_000, 9])
def test_search(spark, texts, pass_rows, monkeypatch):
    """Also with several passes of the index, and with few scores held at once."""
    docs, items = texts
    if pass_rows == 9:
        monkeypatch.setattr(L, "CELLS", 50)
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = L.search(wide(frame(spark, docs)), bench, pass_rows=pass_rows)
    assert collections.Counter(tuple(r) for r in got.collect()) == expected_search(docs, items, 20)


def test_search_of_nothing(spark, texts):
    docs, items = texts
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert L.search(frame(spark, []), bench).count() == 0
    assert L.search(frame(spark, [(1, None), (2, "")]), bench).count() == 0
    assert L.search(frame(spark, docs), bench.where("item_id in (50, 51)")).count() == 0

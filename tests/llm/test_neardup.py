import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest

from barline.llm import neardup


def grams(text, n=5):
    w = re.findall(r"[a-z0-9\x80-\U0010ffff]+", text.lower())
    if not w:
        return {("raw", text)}
    return {tuple(w[i:i + n]) for i in range(max(1, len(w) - n + 1))}


def brute_classes(docs, similarity=0.8):
    """Union of all pairs of documents at or above the similarity; rows of one key are one."""
    sets = [(d, grams(t)) for d, t in docs]
    parent = {d: d for d, _ in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x
    for i, (a, x) in enumerate(sets):
        for b, y in sets[:i]:
            if len(x & y) >= similarity * len(x | y):
                ra, rb = sorted((root(a), root(b)))
                parent[rb] = ra
    return {d: root(d) for d in parent}


def corpus(seed, groups=25, noise=60):
    rng = random.Random(seed)
    word = lambda: f"v{rng.randrange(3000)}"
    docs = [[word() for _ in range(rng.randrange(3, 200))] for _ in range(noise)]
    for _ in range(groups):
        base = [word() for _ in range(rng.randrange(30, 220))]
        for _ in range(rng.randrange(1, 7)):
            copy = list(base)
            for _ in range(rng.randrange(0, 8)):
                copy[rng.randrange(len(copy))] = word()
            docs.append(copy)
    rng.shuffle(docs)
    return [(i, " ".join(d)) for i, d in enumerate(docs)]


@pytest.mark.parametrize("seed", [1, 2])
def test_classes_match_all_pairs(spark, seed):
    docs = corpus(seed)
    got = neardup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    want = brute_classes(docs)
    assert {r.doc_id: r.class_id for r in got} == want
    sizes = Counter(want.values())
    assert all(r.class_size == sizes[r.class_id] and r.kept == (r.doc_id == r.class_id) for r in got)


def test_large_group_with_distant_members(spark):
    """Members of one group lie on both sides of the threshold from each other."""
    rng = random.Random(9)
    base = [f"b{i}" for i in range(120)]
    docs = []
    for i in range(150):
        copy = list(base)
        for _ in range(rng.randrange(0, 5)):
            copy[rng.randrange(len(copy))] = f"n{rng.randrange(10 ** 6)}"
        docs.append((i, " ".join(copy)))
    got = neardup.near_groups(spark.createDataFrame(docs, "doc_id long, text string")).collect()
    assert {r.doc_id: r.class_id for r in got} == brute_classes(docs)


def test_odd_rows(odd, none):
    rows, docs = neardup.near_groups(odd).collect(), odd.select("doc_id", "text").collect()
    assert len(rows) == len(docs)
    by = defaultdict(set)
    for r in rows:
        if r.doc_id is not None:
            by[r.doc_id].add(r.class_id)
    assert by[1] == by[2] and by[3] == by[4] == {3} and by[7] != by[8] and by[5] == by[9]
    assert neardup.near_groups(none).collect() == []
    kept = neardup.drop_near_copies(odd)
    assert kept.columns == odd.columns
    assert len({r.class_id for r in rows}) == kept.select("doc_id").distinct().count() - 0 or kept.count() >= 1
    assert neardup.drop_near_copies(none).collect() == []


def test_texts_under_one_id_keep_their_own_links(spark):
    rng = random.Random(4)
    text = lambda: [f"t{rng.randrange(10 ** 6)}" for _ in range(80)]
    near = lambda t: [*t[:-1], "other"]
    a, b, c, d = text(), text(), text(), text()
    docs = [(2, a), (5, near(a)), (5, b), (7, near(b)), (5, c), (9, d), (9, near(d)), (11, near(c))]
    docs = [(i, " ".join(t)) for i, t in docs]
    df = spark.createDataFrame(docs, "doc_id long, text string")
    got = Counter((r.doc_id, r.class_id, r.class_size) for r in neardup.near_groups(df).collect())
    assert got == Counter([(2, 2, 2), (5, 2, 2), (5, 5, 2), (7, 5, 2), (5, 5, 2), (9, 9, 2), (9, 9, 2), (11, 5, 2)])
    kept = Counter(map(tuple, neardup.drop_near_copies(df).collect()))
    nines = [r for r in docs if r[0] == 9 and r in kept]
    assert len(nines) == 1 and kept == Counter([docs[0], docs[2], docs[4], *nines])


def test_signatures_estimate_weighted_similarity():
    rng = np.random.default_rng(0)
    a = rng.integers(0, 2 ** 63, 400).astype(np.uint64)
    x, y = rng.uniform(0.1, 3, 400), rng.uniform(0.1, 3, 400)
    same = [(neardup.dart_min_hash([(a + np.uint64(i), x)]) == neardup.dart_min_hash([(a + np.uint64(i), y)])).mean()
            for i in range(30)]
    assert np.mean(same) == pytest.approx(np.minimum(x, y).sum() / np.maximum(x, y).sum(), abs=0.03)


def test_signatures_do_not_depend_on_the_batch():
    rng = np.random.default_rng(1)
    sets = [(rng.integers(0, 2 ** 63, n).astype(np.uint64), np.ones(n)) for n in (1, 3, 50, 700, 9000)]
    together = neardup.dart_min_hash(sets)
    assert (together != neardup.NONE).all()
    for s, row in zip(sets, together, strict=True):
        assert (neardup.dart_min_hash([s])[0] == row).all()


def test_shingles_match_across_blocks():
    texts = ["A b, c d e f", "", "a B c d e F!", "x", "??", "é ü a b c"]
    alone = [neardup.shingles([t])[0] for t in texts]
    for x, y in zip(alone, neardup.shingles(texts), strict=True):
        assert (x == y).all()
    assert (alone[0] == alone[2]).all() and len(alone[3]) == 1 and alone[1] != alone[4]

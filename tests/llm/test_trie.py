"""The conversation trie against a walk over all conversations in plain Python."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barline.llm import trie

SCHEMA = "conv_id long, turn long, role string, text string"
COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(rows):
    by = defaultdict(list)
    for c, t, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            tie = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).digest()
            by[c].append((t is not None, t or 0, tie, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in by.items()}
    paths = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        first = c - (c % 20 if c >= 0 else -(-c % 20))
        paths[c] = tuple(own.get(first, [])[:h] + turns[h:])
    members = defaultdict(list)
    for c, p in paths.items():
        for d in range(len(p) + 1):
            members[p[:d]].append(c)
    words = lambda t: len(re.findall(r"[^\x20\x09-\x0D]+", t))
    children = Counter(p[:-1] for p in members if p)
    leaves, saved = Counter(), Counter()
    for p, m in members.items():
        for d in range(len(p) + 1):
            leaves[p[:d]] += children[p] == 0
            saved[p[:d]] += (len(m) - 1) * (words(p[-1][1]) if p else 0)
    return Counter((min(m), len(p), min(members[p[:-1]]) if p else None, len(m), children[p], leaves[p], saved[p],
                    hashlib.sha256(",".join(map(str, sorted(c for c in m if len(paths[c]) == len(p)))).encode()).hexdigest())
                   for p, m in members.items())


def made(seed, convs, turns=6, variety=3):
    rng = random.Random(seed)
    rows = []
    for c in convs:
        for t in range(rng.randrange(1, turns)):
            rows.append((c, t, rng.choice(["user", "assistant"]) if t % 2 else "user",
                         " ".join(rng.choice(["a", "b"]) for _ in range(rng.randrange(1, variety)))))
    return rows


ODD = [(1, None, None, None), (1, None, "user", None), (1, 0, "user", "x  y\tz"), (None, 0, "user", "a"), (2, 5, "user", "a"),
       (2, 5, "user", "a"), (2, 5, "user", "b"), (-3, 0, "user", "a"), (-20, 0, "user", "p q"), (-39, 0, "r", "a"), (40, 0, "user", ""),
       (41, 0, "user", "one"), (42, 0, "user", "one"), (43, 1, "user", "one"), (47, 0, "user", "w " * 50_000), (7, 1, "", "user:a")]


@pytest.mark.parametrize("rows, width", [
    (ODD + made(4, range(100, 130)), None), (made(2, range(-50, 60), 9, 2) + made(3, range(60, 200, 3), 5, 6), 16),
    ([(5, 0, "user", "alone")], 1),
    ([(c, t, "user", "same words") for c in range(60) for t in range(4)]
     + [(c, t, "user", f"go {t * c}") for c in range(100, 140) for t in range(2)], None)])
def test_nodes_are_those_of_a_walk(spark, rows, width):
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("conv", "depth", "k1", "rank", "words", "ends", "n", "alone", "part"):
        df = df.withColumn(name, F.lit("extra"))
    got = trie.conversation_trie(df, width=width)
    assert tuple(got.columns) == COLUMNS
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_long_paths_are_cut_into_blocks(spark, monkeypatch):
    monkeypatch.setattr(trie, "BLOCK", 4)
    monkeypatch.setattr(trie, "RUN", 3)
    rows = [(c, t, "user", f"t {t if t < 30 or c % 3 else c}") for c in range(12) for t in range(40)] + made(5, range(20, 60))
    got = trie.conversation_trie(spark.createDataFrame(rows, SCHEMA))
    assert Counter(map(tuple, got.collect())) == brute(rows)


def test_no_conversations(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert trie.conversation_trie(df).collect() == []


def test_sketch_never_counts_too_low(spark):
    rows = spark.range(3000).select((F.xxhash64(F.col("id") % 700)).alias("k1"), F.xxhash64(F.col("id") % 700, F.lit(1)).alias("k2"))
    counts = trie.sketch(rows, 4096)
    keys = rows.distinct().toPandas()
    least = min(int(min(counts[i][x[j]] for i, x in enumerate(trie.buckets(keys.k1.to_numpy(), keys.k2.to_numpy(), 4096))))
                for j in range(len(keys)))
    assert least == 2 and counts.max() == 2
    single = spark.range(500).select(F.xxhash64("id").alias("k1"), F.xxhash64("id", F.lit(1)).alias("k2"), F.lit(1).alias("depth"),
                                     F.lit(0).cast("long").alias("a1"), F.lit(0).cast("long").alias("a2"))
    assert trie.screened(single).where("alone").count() >= 490

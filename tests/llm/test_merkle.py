"""The manifest against hashes taken one by one in plain Python."""

import hashlib
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from barline.llm import merkle
from barline.llm.common import fold

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(doc_id, text, lang, source, n_chars):
    return H(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)])


def proofs(nodes):
    """Siblings of each node level by level, and the last node."""
    kin = [[] for _ in nodes]
    at = list(range(len(nodes)))
    while len(nodes) > 1:
        for i, p in enumerate(at):
            run = range(p // 16 * 16, min(len(nodes), p // 16 * 16 + 16))
            kin[i].append(([nodes[j] for j in run if j < p], [nodes[j] for j in run if j > p]))
        nodes = [H(*nodes[j:j + 16]) for j in range(0, len(nodes), 16)]
        at = [p // 16 for p in at]
    return kin, nodes[0]


def climb(node, kin):
    for before, after in kin:
        node = H(*before, node, *after)
    return node


def brute(rows):
    by = defaultdict(list)
    for r in rows:
        by[r[3]].append(((r[0] is not None, r[0] or 0, leaf(*r)), r))
    names = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    found = {s: proofs([x[0][2] for x in sorted(by[s], key=lambda x: x[0])]) for s in names}
    above, root = proofs([found[s][1] for s in names]) if names else ([], None)
    out = Counter()
    for s, up in zip(names, above):
        for (key, r), kin in zip(sorted(by[s], key=lambda x: x[0]), found[s][0]):
            text = r[1]
            if text is not None and zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 5 == 0:
                text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
            folded = climb(climb(leaf(r[0], text, *r[2:]), kin), up)
            proof = H(*[x for b, a in kin + up for x in b + a])
            out[(r[0], key[2], found[s][1], root, proof, folded, folded == root)] += 1
    return out


def query(df):
    lower = F.when(fold(F.col("doc_id"), 5) == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    rows = merkle.verified(merkle.manifest(df, changed={"text": lower}))
    proof = F.concat(F.array_join("path", ""), F.array_join("source_path", ""))
    return Counter(map(tuple, rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256), "folded_root", "verified").collect()))


def rows_of(df):
    return [tuple(r) for r in df.select("doc_id", "text", "lang", "source", "n_chars").collect()]


def test_odd_rows(spark, odd, none):
    assert query(odd.withColumn("line", F.lit("extra")).withColumn("run", F.lit("extra"))) == brute(rows_of(odd))
    assert merkle.manifest(none).collect() == []


@pytest.mark.parametrize("sizes", [[1], [257, 1, 16, 17, 256], [4200, 3], [2] + [1] * 39])
def test_trees_of_many_shapes(spark, sizes):
    rows, n = [], 0
    for s, size in enumerate(sizes):
        for _ in range(size):
            n += 1
            rows.append((n * 7919 % 100_003, f"Text {n} Ä", "en", f"s{s}" if s else None, n))
    assert query(spark.createDataFrame(rows, SCHEMA)) == brute(rows)


def test_a_changed_field_breaks_only_its_own_row(spark):
    rows = [(i, f"t{i}", "en", "ab"[i % 2], i) for i in range(300)]
    df = spark.createDataFrame(rows, SCHEMA)
    bad = merkle.verified(merkle.manifest(df, changed={"n_chars": F.when(F.col("doc_id") == 17, 0).otherwise(F.col("n_chars"))}))
    assert [r.doc_id for r in bad.where("NOT verified").collect()] == [17]
    assert bad.where("verified").count() == 299
    paths = bad.where("doc_id = 17").first()
    assert [len(x) for x in paths.path] == [15 * 64, 9 * 64] and [len(x) for x in paths.source_path] == [64]

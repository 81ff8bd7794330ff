import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from barline.llm import exact, packing


def expected_groups(rows):
    by = defaultdict(list)
    for r in rows:
        by[r.text or ""].append(r.doc_id)
    out = Counter()
    for text, ids in by.items():
        keep = max((i for i in ids if i is not None), default=None)
        sha = hashlib.sha256(text.encode()).hexdigest()
        for n, i in enumerate(sorted(ids, key=lambda i: -1 if i is None else i, reverse=True)):
            out[(i, keep, len(ids), n == 0, sha)] += 1
    return out


@pytest.mark.parametrize("run_rows", [1, 2, 128])
def test_groups_match_brute_force_split_or_not(odd, run_rows):
    got = Counter(map(tuple, exact.exact_groups(odd, run_rows=run_rows).collect()))
    assert got == expected_groups(odd.select("doc_id", "text").collect())


def test_hot_text_is_split_and_whole_again(spark):
    df = spark.range(3000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', concat('t', id % 900)) AS text")
    got = Counter(map(tuple, exact.exact_groups(df, run_rows=16).collect()))
    assert got == expected_groups(df.collect())


def test_rows_that_repeat_key_and_text_are_split(spark):
    from pyspark.sql import functions as F
    df = spark.range(20_000, numPartitions=4).selectExpr("IF(id < 15000, 7, NULL) AS doc_id", "'same' AS text")
    runs = exact.decide(df, run_rows=64).select("run_keep", "run_size", "split").distinct().agg(F.max("run_size")).first()[0]
    assert runs < 64 * 3
    rows = exact.exact_groups(df, run_rows=64).groupBy("doc_id", "keep_id", "group_size", "kept").count().collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept, r["count"]) for r in rows} == {
        (7, 7, 20_000, True, 1), (7, 7, 20_000, False, 14_999), (None, 7, 20_000, False, 5_000)}


def test_dropping_keeps_columns_and_one_row_each(odd, none):
    kept = exact.drop_copies(odd)
    assert kept.columns == odd.columns
    rows = kept.select("doc_id", "text").collect()
    assert len(rows) == len({r.text or "" for r in rows}) == len({r.text or "" for r in odd.select("text").collect()})
    assert exact.drop_copies(none).collect() == [] == exact.exact_groups(none).collect()


def test_ids_are_those_of_the_tokenizer(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.vocabulary_path())
    encode = packing.encoder(packing.vocabulary_path())
    texts = ["", " ", "a  b\n\n c", "it's we'll 'tis", "ÀÖ ß Üx9²Ⅷ", "日本 語", "x\x1cy\x85z ", "tabs\t\t!",
             "a" * 3000, "1234 5,6", "\U0001F600é é", "’s “q”", "ab_c-d"]
    texts += [r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), "<u4").tolist() == ids, t


def test_added_tokens_in_a_text_keep_their_id(spark):
    from tokenizers import Tokenizer
    tok = Tokenizer.from_file(packing.vocabulary_path())
    encode = packing.encoder(packing.vocabulary_path())
    end = "<|endoftext|>"
    texts = [f"a {end} b", end, end * 3, f"{end}  x\n", f"tail  {end}", f"日本 {end}é it's{end}'ll", "<|endoftext| >", "<|end<|endoftext|>"]
    for t in texts:
        ids = tok.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(encode(t), "<u4").tolist() == ids, t
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.length for r in packing.pack(df).collect()}
    assert got == {i: len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def check_packed(rows, docs, size):
    encode = packing.encoder(packing.vocabulary_path())
    want = Counter()
    for d in docs:
        ids = encode(d.text or "") + packing.END
        n = len(ids) // 4
        cuts = [0, *range(n % size or size, n + 1, size)] if n > size else [0, n]
        for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)):
            want[(d.doc_id, k, a, b - a, zlib.crc32(ids[4 * a:4 * b]))] += 1
    assert Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    by = defaultdict(list)
    for r in rows:
        by[r.sequence_id].append((r.offset, r.length))
    for parts in by.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
    return len(by)


@pytest.mark.parametrize("size", [64, 1024])
def test_pieces_and_places(odd, size):
    rows = packing.pack(odd, size=size).collect()
    used = check_packed(rows, odd.select("doc_id", "text").collect(), size)
    assert used <= 1.02 * sum(r.length for r in rows) / size + 2


def test_hot_lengths_are_ranked_over_slots(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANK_ROWS", 50)
    df = spark.range(900).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'hot', repeat('a b ', int(id % 40))) AS text")
    check_packed(packing.pack(df, size=32).collect(), df.collect(), 32)


def test_sequences_hold_the_ids(odd, none):
    got = {r.sequence_id: r.ids for r in packing.sequences(packing.pack(odd, ids=True)).collect()}
    rows = packing.pack(odd).collect()
    for r in rows:
        part = got[r.sequence_id][r.offset:r.offset + r.length]
        assert zlib.crc32(np.array(part, "<u4").tobytes()) == r.ids_crc32
    assert packing.pack(none).collect() == []


def test_best_fit_equals_the_one_by_one_rule():
    rng = np.random.default_rng(3)
    for _ in range(20):
        lengths = sorted(rng.integers(1, 65, 200).tolist(), reverse=True)
        gaps = []
        for x in lengths:  # the plain algorithm
            fits = [g for g in gaps if g >= x]
            if fits:
                g = min(fits)
                gaps.remove(g)
                gaps.append(g - x)
            else:
                gaps.append(64 - x)
        matches = packing.best_fit(dict(Counter(lengths)), 64)
        assert 1 + max(f + (n - 1) // m for _, _, n, m, f, _ in matches) == len(gaps)


def test_fast_encoder_splits_every_character_as_the_tokenizer(spark):
    from tokenizers import Tokenizer
    path = packing.vocabulary_path()
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    rng = random.Random(3)
    every = [chr(c) for c in range(1, 0x11000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(f"{c}a {c} {c}1" for c in every[k:k + 500]) for k in range(0, len(every), 500)]
    texts += ["".join(rng.choice(["a", "B", " ", "  ", "\n", "'s", "’", "1", "é", "日", " ", " ", "!", "\t"])
                      for _ in range(200)) for _ in range(300)]
    texts += [" " * 12_000 + "x", "\n" * 30_000, "a" * 50_000]
    for t in texts:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t[:60]


def test_other_kinds_of_files_go_to_the_tokenizer_whole():
    import public_tokenizers
    from tokenizers import Tokenizer
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, encode = Tokenizer.from_file(path), packing.encoder(path)
    for t in ["", "Some Words, here", "ÀÉ 12"]:
        assert np.frombuffer(encode(t), "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids

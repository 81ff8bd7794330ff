"""Ids, spans and decoding against the library itself, for the given model and for copies of it
whose normaliser has the library's compiled character maps or other switches."""

import hashlib
import random

import pytest
import sentencepiece
from pyspark.sql import functions as F

from barline.llm import sentencepieces as sp

TEXTS = ["", " ", "   ", "a", " a", "a ", "  a  b ", "\tx\n y", " ﬁ ﬃ", "　x　　y", "áé", "é", "Å Å", "▁a ▁", "<s> </s> <unk>",
         "\x00a\x01", "日本語 テキスト", "ｶﾞｷﾞ ﾊﾟ", "①②Ⅷ ½", "\U0001F600\U0001F468‍\U0001F469", "x​y‏ z", "￥ＡＢＣ　１２", "¨¨ ̈ ¯",
         "ﷺ!", "가각 한글", "ạ́b", "line\r\nnext end\u0085", "﻿bom", "…—–", " x\xa0y ", "　", " 　 ",
         "tail 　", "¨", "x ¨ y", "�", "ZZ<own>ZZ <own> tail", "ab<ow", "own1own12own1"]


def varint(n):
    out = b""
    while n > 127:
        out, n = out + bytes([n & 127 | 128]), n >> 7
    return out + bytes([n])


def part(number, data):
    return bytes([number << 3 | 2]) + varint(len(data)) + data


def normaliser(rule=None, dummy=1, trim=0, escape=1):
    """A normaliser message; of several in a file the later fields count."""
    data = bytes([3 << 3, dummy, 4 << 3, trim, 5 << 3, escape])
    if rule:
        other = sentencepiece.SentencePieceNormalizer(rule_name=rule).serialized_model_proto()
        spec = dict(sp.message(dict(sp.message(other))[sp.NORMALIZER]))
        data += part(2, spec[sp.CHARACTER_MAP])
    return part(3, data)


def own_symbols(*symbols):
    return b"".join(part(1, part(1, s.encode()) + bytes([3 << 3, 4])) for s in symbols)


@pytest.fixture(scope="module")
def model():
    with open(sp.model_path(), "rb") as f:
        return f.read()


def wild(rng, n):
    pool = ["a", "b", " ", "  ", "\t", "\n", "é", "é", "ﬁ", "①", "　", "ｶ", "ﾞ", "日", "가", "가", "\U0001F600", "▁",
            "​", "¨", "Å", "1", "!", "<own>", "x̣́", "ﷺ", "\x00", "\xad"]
    return ["".join(rng.choice(pool) for _ in range(rng.randrange(1, 60))) for _ in range(n)]


@pytest.mark.parametrize("change", ["", "nfkc", "nfkc trimmed", "case folded", "trimmed", "bare", "unescaped trimmed", "own symbols", "suffix"])
def test_ids_and_spans_are_those_of_the_library(model, change):
    data = model + {"": b"", "nfkc": normaliser("nmt_nfkc"), "nfkc trimmed": normaliser("nmt_nfkc", trim=1),
                    "case folded": normaliser("nmt_nfkc_cf", trim=1), "trimmed": normaliser(trim=1), "bare": normaliser(dummy=0),
                    "unescaped trimmed": normaliser("nfkc", trim=1, escape=0),
                    "own symbols": own_symbols("<own>", "own1", "own12", "日本語x") + normaliser("nmt_nfkc", trim=1),
                    "suffix": part(2, bytes([24 << 3 & 127 | 128, 1, 1])) + normaliser("nmt_nfkc", trim=1)}[change]
    ours, library = sp.Encoder(data), sentencepiece.SentencePieceProcessor(model_proto=data)
    texts = TEXTS + wild(random.Random(len(change)), 400)
    for t, (ids, begins, ends) in zip(texts, ours.encode([t.encode() for t in texts]), strict=True):
        want = library.encode(t, return_type="proto")
        assert ids.tolist() == [p.id for p in want.pieces], t
        assert list(zip(begins, ends)) == [(p.begin, p.end) for p in want.pieces], (t, begins, ends)
    assert ours.decode([library.encode(t) for t in texts]) == [library.decode(library.encode(t)) for t in texts]


def test_every_compiled_rule_is_found(model):
    for rule in ("nmt_nfkc", "nfkc_cf"):
        ours = sp.Encoder(model + normaliser(rule))
        other = sentencepiece.SentencePieceNormalizer(rule_name=rule)
        every = [chr(c) for c in range(1, 0x30000) if not 0xD800 <= c < 0xE000]
        for k in range(0, len(every), 4000):
            text = "x".join(every[k:k + 4000])
            got, _ = ours.normalize(text.encode())
            assert got.decode().replace("▁", " ") == other.normalize(text).replace("▁", " ")


def test_documents_with_odd_rows(spark, odd, none):
    library = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    rows = sp.encoded(odd, decode=True).collect()
    texts = sorted(((r.doc_id is None, r.doc_id or 0), r.text or "") for r in odd.select("doc_id", "text").collect())
    got = sorted(((r.doc_id is None, r.doc_id or 0), r.decoded, tuple(r.ids)) for r in rows)
    assert got == sorted((k, library.decode(library.encode(t)), tuple(library.encode(t))) for k, t in texts)
    for r in rows:
        assert len(r.ids) == len(r.begins) == len(r.ends) and all(a <= b for a, b in zip(r.begins, r.ends))
    back = sp.decoded(sp.encoded(odd, spans=False).withColumn("other", F.lit(1))).collect()
    assert sorted(r.decoded for r in back) == sorted(r.decoded for r in rows)
    assert sp.encoded(none).collect() == [] == sp.decoded(sp.encoded(none)).collect()
    lost = spark.createDataFrame([(1, None)], "doc_id long, ids array<int>")
    assert [r.decoded for r in sp.decoded(lost).collect()] == [""]


def test_query_against_the_library(spark):
    from barline.llm.queries import QUERIES
    library = sentencepiece.SentencePieceProcessor(model_file=sp.model_path())
    sha = lambda t: hashlib.sha256(t.encode()).hexdigest()
    d = "/root/testdata/sf0.001"
    want = set()
    for r in spark.read.parquet(f"{d}/documents.parquet").collect():
        ids = library.encode(r.text or "")
        want.add((r.doc_id, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids))))
    assert {tuple(r) for r in QUERIES["op13_sentencepiece"](spark, d).collect()} == want

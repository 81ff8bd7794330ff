"""SentencePiece encoding that keeps offsets, and decoding.

A text is normalised first: at each place the longest prefix that the model file's compiled character
map (a double array over UTF-8 bytes) knows is replaced, or else one character is kept; spaces become
the space symbol. Every byte of the result remembers at which byte of the source its prefix began, so
a piece, which is a stretch of the normalised text, projects to a span of bytes of the source. The
map is walked for all places of a text at once, one byte deeper per numpy step. The merges themselves
run in the sentencepiece library, over the normalised text and with the library's own normaliser off.
"""

from __future__ import annotations

import functools
import re
import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import col

SPACE = "▁".encode()
# Kinds of pieces, and field numbers of the model file's messages.
UNKNOWN, USER_DEFINED, BYTE = 2, 4, 6
PIECES, TRAINER, NORMALIZER = 1, 2, 3
PIECE, KIND = 1, 3
SUFFIX_SPACE = 24
CHARACTER_MAP, DUMMY_PREFIX, NO_EXTRA_SPACES, ESCAPE_SPACES = 2, 3, 4, 5


def model_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("piece_bpe_32k.model")


def message(data: bytes):
    """(field number, value) of a serialised message: numbers, or bytes of strings and messages."""
    at = 0

    def number():
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value
    while at < len(data):
        tag = number()
        if tag & 7 == 0:
            yield tag >> 3, number()
        else:
            size = {1: 8, 5: 4}.get(tag & 7) or (number() if tag & 7 == 2 else 0)
            yield tag >> 3, data[at:at + size]
            at += size


class CharacterMap:
    """Longest-prefix replacement through a compiled map: byte size, double array, replacements."""

    def __init__(self, data: bytes):
        size = struct.unpack("<I", data[:4])[0] if data else 0
        self.units = np.frombuffer(data[4:4 + size], "<u4").astype(np.int64)
        self.texts = data[4 + size:]

    def longest(self, data: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For each start the length of the longest known prefix (0: none) and its replacement's place."""
        length, value = np.zeros(len(starts), np.int64), np.zeros(len(starts), np.int64)
        units, live, at = self.units, np.arange(len(starts)), starts
        jump = lambda u: (u >> 10) << ((u & 0x200) >> 6)
        node, depth = np.full(len(starts), jump(units[0])), 0
        while len(live):
            inside = at < len(data)
            live, at, node = live[inside], at[inside], node[inside]
            byte = data[at].astype(np.int64)
            node = node ^ byte
            unit = units[np.minimum(node, len(units) - 1)]
            ok = (node < len(units)) & ((unit & 0x800000FF) == byte)
            live, at, node, unit, depth = live[ok], at[ok] + 1, node[ok] ^ jump(unit[ok]), unit[ok], depth + 1
            leaf = (unit >> 8) & 1 == 1
            length[live[leaf]] = depth
            value[live[leaf]] = units[node[leaf]] & 0x7FFFFFFF
        return length, value

    def text(self, value: int) -> bytes:
        return self.texts[value:self.texts.index(b"\0", value)]


class Normalizer:
    def __init__(self, spec: dict, user_defined: list[bytes], suffix: bool):
        self.map = CharacterMap(spec.get(CHARACTER_MAP, b""))
        self.dummy, self.trim, self.escape = (bool(spec.get(k, 1)) for k in (DUMMY_PREFIX, NO_EXTRA_SPACES, ESCAPE_SPACES))
        self.suffix = suffix
        # Symbols of the user's own are kept as they are, the longest first.
        own = b"|".join(re.escape(s) for s in sorted(user_defined, key=len, reverse=True))
        self.own = re.compile(b"(?=(" + own + b"))") if own else None

    def units(self, text: bytes, data: np.ndarray):
        """Prefixes that are more or less than one plain character, left to right: (start, end, output)."""
        found = {}
        if len(self.map.units):
            starts = np.flatnonzero((data & 0xC0) != 0x80)
            length, value = self.map.longest(data, starts)
            for i in np.flatnonzero(length):
                found[int(starts[i])] = (int(length[i]), self.map.text(int(value[i])))
        if self.own:
            for m in self.own.finditer(text):
                found[m.start()] = (len(m[1]), m[1])
        end = 0
        for at in sorted(found):
            if at >= end:
                end = at + found[at][0]
                yield at, end, found[at][1]

    def __call__(self, text: bytes) -> tuple[bytes, np.ndarray]:
        """Normalised text, and for each of its bytes, and for its end, the source byte it belongs to."""
        data = np.frombuffer(text, np.uint8)
        out, source, lead, size, last = [], [], [], 0, 0

        def plain(a, b):
            nonlocal size
            if a < b:
                at = np.arange(a, b)
                first = np.maximum.accumulate(np.where((data[a:b] & 0xC0) != 0x80, at, a))  # its character's first byte
                out.append(data[a:b])
                source.append(first)
                lead.append(size + at - a)
                size += b - a
        for a, b, new in self.units(text, data):
            plain(last, a)
            new = np.frombuffer(new, np.uint8)
            spaces = len(new) - len(new.tobytes().lstrip(b" "))
            out.append(new)
            source.append(np.full(len(new), a))
            lead.append(np.where(np.arange(len(new)) < spaces, size, -1))
            size, last = size + len(new), b
        plain(last, len(data))
        if not size:
            return b"", np.zeros(1, np.int64) + (0 if self.trim else len(data))
        raw, source, lead = np.concatenate(out), np.concatenate(source), np.concatenate(lead)
        end = len(data)
        if self.trim:
            # Spaces that begin a prefix go if the text before it is none or ends with a space.
            after = (lead == 0) | (raw[np.maximum(lead - 1, 0)] == 32)
            keep = ~((raw == 32) & (lead >= 0) & after)
            raw, source = raw[keep], source[keep]
            if not len(raw):
                return b"", np.zeros(1, np.int64)
        space = SPACE if self.escape else b" "
        text = raw.tobytes()
        if self.escape:
            source = np.repeat(source, np.where(raw == 32, len(SPACE), 1))
            text = text.replace(b" ", SPACE)
        if self.dummy and not self.suffix:
            text, source = space + text, np.concatenate([np.full(len(space), source[0]), source])
        if self.trim:  # space symbols of the source's own go too
            body = len(text)
            while text.endswith(space, 0, body):
                body -= len(space)
            if body < len(text):
                text, end, source = text[:body], int(source[body]), source[:body]
        if self.dummy and self.suffix:
            text, source = text + space, np.concatenate([source, np.full(len(space), end)])
        return text, np.append(source, end)


class Encoder:
    def __init__(self, model: bytes):
        import sentencepiece
        kinds, user, spec, trainer = [], [], {}, {}
        for number, value in message(model):
            if number == PIECES:
                piece = dict(message(value))
                kinds.append((piece.get(KIND, 1), piece[PIECE]))
            elif number == NORMALIZER:
                spec |= dict(message(value))
            elif number == TRAINER:
                trainer |= dict(message(value))
        user = [p for k, p in kinds if k == USER_DEFINED]
        self.normalize = Normalizer(spec, user, bool(trainer.get(SUFFIX_SPACE)))
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        # The same model without a normaliser: fields that come later count, so its switches are appended.
        off = bytes([CHARACTER_MAP << 3 | 2, 0, DUMMY_PREFIX << 3, 0, NO_EXTRA_SPACES << 3, 0, ESCAPE_SPACES << 3, 0])
        self.merge = sentencepiece.SentencePieceProcessor(model_proto=model + bytes([NORMALIZER << 3 | 2, len(off)]) + off)
        self.size = np.array([1 if k == BYTE else -1 if k == UNKNOWN else len(p) for k, p in kinds], np.int64)

    def encode(self, texts: list[bytes]) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """ids, first and end byte in the source of each piece."""
        out = []
        normal = [self.normalize(t) for t in texts]
        ids = self.merge.encode([n for n, _ in normal], out_type=int, num_threads=1)
        for (text, source), one in zip(normal, ids, strict=True):
            one = np.array(one, np.int64)
            size = self.size[one]
            if (size < 0).any():  # an unknown piece is as long as its own text
                size = np.array([len(p.encode()) if s < 0 else s for s, p in
                                 zip(size, self.merge.encode(text, out_type=str, num_threads=1), strict=True)], np.int64)
            at = np.concatenate([[0], np.cumsum(size)])
            if at[-1] != len(text):
                raise ValueError("the pieces do not add up to the normalised text")
            span = source[at]
            out.append((one, span[:-1], span[1:]))
        return out

    def decode(self, ids: list[list[int]]) -> list[str]:
        return [self.library.decode(one) for one in ids]


@functools.lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    with open(path, "rb") as f:
        return Encoder(f.read())


def _lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.concatenate([[0], np.cumsum([len(a) for a in arrays])]).astype(np.int32)
    values = np.concatenate(arrays) if arrays else np.zeros(0)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values.astype(np.int32)))


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", path: str | None = None, spans: bool = True,
            decode: bool = False) -> DataFrame:
    """One row per document: key, ids, with ``spans`` also begins and ends (bytes of the text's UTF-8,
    end exclusive, of every piece) and with ``decode`` decoded, the text that the ids stand for.

    Ids are those of the library without begin or end ids and sampling. Null and empty texts have
    none. A character's byte pieces have empty spans but the last. Whole texts are read, rows repeating a
    key one by one; an empty table gives no rows; other columns, of any name, are ignored.
    """
    path = path or model_path()
    df = docs.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).cast("binary").alias("body"))

    def run(batches):
        model = encoder(path)
        for b in batches:
            got = model.encode([x.decode("utf-8", "replace").encode() for x in b.column("body").to_pylist()])
            out = {"id": b.column("id"), "ids": _lists([g[0] for g in got])}
            if spans:
                out |= {"begins": _lists([g[1] for g in got]), "ends": _lists([g[2] for g in got])}
            if decode:
                out["decoded"] = pa.array(model.decode([g[0].tolist() for g in got]), pa.string())
            yield pa.RecordBatch.from_pydict(out)

    kinds = f"id {df.schema['id'].dataType.simpleString()}, ids array<int>"
    kinds += ", begins array<int>, ends array<int>" * spans + ", decoded string" * decode
    return df.mapInArrow(run, kinds).withColumnRenamed("id", key)


def decoded(tokens: DataFrame, key: str = "doc_id", ids: str = "ids", path: str | None = None) -> DataFrame:
    """One row per row of ``tokens``: key, decoded. Null ids are none and decode to the empty text."""
    path = path or model_path()
    df = tokens.select(col(key).alias("id"), F.coalesce(col(ids).cast("array<int>"), F.array().cast("array<int>")).alias("ids"))

    def run(batches):
        model = encoder(path)
        for b in batches:
            yield pa.RecordBatch.from_pydict({
                "id": b.column("id"), "decoded": pa.array(model.decode(b.column("ids").to_pylist()), pa.string())})

    return df.mapInArrow(run, f"id {df.schema['id'].dataType.simpleString()}, decoded string").withColumnRenamed("id", key)

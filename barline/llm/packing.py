"""Best-fit packing of tokenised documents into sequences of a fixed length.

Documents and gaps are kept as sorted runs: all pieces of one length form a run, all open
sequences with the same gap form a run, and the members of a run are told apart by their rank. A
superstep takes the longest run of pieces left, finds by successor search the run with the
smallest gap that holds them, and matches rank against rank: sequence j takes pieces j m to
j m + m - 1, where m pieces fill its gap. Conflicts are thereby settled by rank, the gaps of the
run shrink at once, and the step repeats; where no gap is large enough, new sequences open. This is
best-fit decreasing without change, and its state is at most one count per length and gap,
however many documents there are. Only ranking and placing touch the pieces, as two Spark jobs.
"""

from __future__ import annotations

import bisect
import functools
import json
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import col, stage

SIZE = 1024
END = np.array([2], dtype="<u4").tobytes()
RANK_ROWS = 1_000
WHITE = 10_000  # longer runs of white space go to the tokenizer itself: the fast encoder's pattern cannot hold them

# Splitting rule of a byte-level vocabulary (fixed value).
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def vocabulary_path() -> str:
    import public_tokenizers
    return public_tokenizers.path("byte_bpe_50k.json")


def byte_ranks(spec: dict) -> dict[bytes, int] | None:
    """bytes -> id of a plain byte-level vocabulary whose merges come in the order of their ids, so
    that merging the pair with the smallest id first gives the tokenizer's result; otherwise None."""
    model, split = spec["model"], spec.get("pre_tokenizer") or {}
    if (model.get("type") != "BPE" or split.get("type") != "ByteLevel" or split.get("add_prefix_space")
            or not split.get("use_regex", True) or spec.get("normalizer") or model.get("dropout")
            or model.get("continuing_subword_prefix") or model.get("end_of_word_suffix") or model.get("ignore_merges")):
        return None
    vocab = model["vocab"]
    order = [vocab.get("".join(m if isinstance(m, list) else m.split(" "))) for m in model["merges"]]
    if None in order or any(a >= b for a, b in zip(order, order[1:])):
        return None
    # Printable bytes stand for themselves, the others for the letters from 256 on.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in printable]
    byte = {chr(b): b for b in printable} | {chr(256 + k): b for k, b in enumerate(others)}
    if not set(byte) <= set(vocab) or len(order) + 256 != len(vocab):
        return None
    return {bytes(map(byte.__getitem__, word)): i for word, i in vocab.items()}


@functools.lru_cache(maxsize=2)
def encoder(path: str):
    """text -> its ids as little-endian unsigned 32-bit bytes; nothing is kept from text to text.

    Added tokens of the file are found in the text first, as the tokenizer does, and what lies between
    them is merged by a byte-pair encoder that runs over the file's own vocabulary: the same ids at a
    sixth of the time. Texts with an added token that takes in its surroundings, with a very long run
    of white space, and all texts of a file of another kind go to the tokenizer as a whole."""
    import os
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    ranks = byte_ranks(spec)
    added = {t["content"]: t for t in spec.get("added_tokens") or []}
    greedy = [c for c, t in added.items() if t.get("lstrip") or t.get("rstrip") or t.get("single_word")]
    find = re.compile("(" + "|".join(re.escape(c) for c in sorted(added, key=len, reverse=True)) + ")")
    white = re.compile(rf"\s{{{WHITE}}}")

    @functools.cache
    def tokenizer():
        from tokenizers import Tokenizer
        return Tokenizer.from_file(path)

    def ids_of(text: str) -> bytes:
        return np.asarray(tokenizer().encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()

    if ranks is None:
        return ids_of
    import tiktoken
    fast = tiktoken.Encoding("file", pat_str=SPLIT, mergeable_ranks=ranks, special_tokens={})

    def plain(text: str) -> bytes:
        return np.array(fast.encode_ordinary(text), dtype="<u4").tobytes()

    def encode(text: str) -> bytes:
        if white.search(text) or any(c in text for c in greedy):
            return ids_of(text)
        if not any(c in text for c in added):
            return plain(text)
        # odd places hold the added tokens themselves
        return b"".join(np.uint32(added[x]["id"]).tobytes() if k % 2 else plain(x)
                        for k, x in enumerate(find.split(text)))

    return encode


def bounds(n: int, size: int) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces; only the first one may be shorter than ``size``."""
    if n <= size:
        return [(0, n)]
    first = n % size
    return ([(0, first)] if first else []) + [(s, size) for s in range(first, n, size)]


def pieces(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE,
           path: str | None = None, ids: bool = False) -> DataFrame:
    """Pieces of all documents: row struct, piece, start, length, ids_crc32 and, if asked for,
    the ids themselves. A null text is an empty one and becomes the end id alone."""
    path = path or vocabulary_path()
    df = docs.select(col(key).alias("id"), F.coalesce(col(text), F.lit("")).alias("body"))
    kind = df.schema["id"].dataType.simpleString()

    def cut(batches):
        encode = encoder(path)
        for b in batches:
            rows = []
            for i, body in enumerate(b.column("body").to_pylist()):
                packed = encode(body) + END
                for k, (s, n) in enumerate(bounds(len(packed) // 4, size)):
                    part = packed[4 * s:4 * (s + n)]
                    rows.append((i, k, s, n, zlib.crc32(part), part))
            at, k, s, n, crc, part = zip(*rows, strict=True) if rows else ([],) * 6
            out = {"id": b.column("id").take(pa.array(at, pa.int64())), "piece": pa.array(k, pa.int32()),
                   "start": pa.array(s, pa.int64()), "length": pa.array(n, pa.int64()),
                   "ids_crc32": pa.array(crc, pa.int64())}
            if ids:
                out["ids"] = pa.array([np.frombuffer(x, "<u4").astype(np.int32) for x in part],
                                      pa.list_(pa.int32()))
            yield pa.RecordBatch.from_pydict(out)

    return df.mapInArrow(cut, f"id {kind}, piece int, start long, length long, ids_crc32 long"
                         + ", ids array<int>" * ids)


def best_fit(counts: dict[int, int], size: int) -> list[tuple[int, int, int, int, int, int]]:
    """Matches of runs: (length, first rank, number, pieces per sequence, first sequence, offset)."""
    gaps: list[int] = []
    runs: dict[int, list[tuple[int, int]]] = {}
    out, opened = [], 0

    def put(gap, first, n):
        if n and gap:
            if gap not in runs:
                bisect.insort(gaps, gap)
                runs[gap] = []
            runs[gap].append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(gaps, length)
            if i < len(gaps):
                gap = gaps[i]
                first, n = runs[gap].pop()
                if not runs[gap]:
                    del runs[gap], gaps[i]
            else:
                gap, first, n = size, opened, -(-left // (size // length))
                opened += n
            each = gap // length
            full = min(n, left // each)
            part = left - full * each if full < n else 0
            for m, at, sequences in ((each, first, full), (part, first + full, 1)):
                if m and sequences:
                    out.append((length, rank, m * sequences, m, at, size - gap))
                    put(gap - m * length, at, sequences)
                    rank, left = rank + m * sequences, left - m * sequences
            used = full + bool(part)
            put(gap, first + used, n - used)
    return out


def place(parts: DataFrame, size: int = SIZE) -> DataFrame:
    """``parts`` (a written table with ``length`` and a ``row`` number) with sequence_id and offset."""
    spark = parts.sparkSession
    counts = {r[0]: r[1] for r in parts.groupBy("length").count().collect()}  # one row per length
    matches = best_fit(counts, size)
    if not matches:
        return parts.select("*", F.lit(0).cast("long").alias("sequence_id"),
                            F.lit(0).cast("long").alias("offset"))
    slots = spark.createDataFrame([(k, -(-n // RANK_ROWS)) for k, n in counts.items()],
                                  "length long, slots long")  # at most `size` rows
    df = (parts.join(F.broadcast(slots), "length")
          .withColumn("slot", F.pmod(F.xxhash64("row"), F.col("slots"))))
    lines = Window.partitionBy("length").orderBy("slot")
    before = (df.groupBy("length", "slot").agg(F.count("*").alias("n"))
              .select("length", "slot", (F.sum("n").over(lines) - F.col("n")).alias("before")))
    ranked = (df.withColumn("own", F.row_number().over(
        Window.partitionBy("length", "slot").orderBy("row")) - 1)
        .join(before, ["length", "slot"]).withColumn("rank", F.col("before") + F.col("own")))
    runs = spark.createDataFrame(matches, "of long, lo long, number long, m long, first long, used long")
    at = F.col("rank") - F.col("lo")
    return (ranked.join(F.broadcast(runs), (F.col("length") == F.col("of")) & (at >= 0)
                        & (at < F.col("number")))
            .select(*parts.columns, (F.col("first") + F.floor(at / F.col("m"))).alias("sequence_id"),
                    (F.col("used") + F.pmod(at, F.col("m")) * F.col("length")).alias("offset")))


def pack(docs: DataFrame, key: str = "doc_id", text: str = "text", size: int = SIZE,
         path: str | None = None, ids: bool = False) -> DataFrame:
    """All documents packed into sequences of at most ``size`` tokens; one row per piece: key,
    piece, start, length, ids_crc32, sequence_id, offset (and ids).

    A document is its ids and the end id. Longer ones are cut into pieces of ``size``, of which
    only the first may be shorter. Null and empty texts become the end id alone. Rows repeating a
    key are packed one by one. An added token of the vocabulary that a text holds becomes its own
    id. An empty table gives no rows; other columns, of any name, are ignored.
    """
    parts = stage(pieces(docs, key, text, size, path, ids)
                  .withColumn("row", F.monotonically_increasing_id()), "pieces")
    return place(parts, size).drop("row").withColumnRenamed("id", key)


def sequences(packed: DataFrame) -> DataFrame:
    """(sequence_id, ids) from :func:`pack` with ids; a sequence holds at most ``size`` of them."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return (packed.groupBy("sequence_id").agg(parts.alias("parts"))
            .select("sequence_id", F.flatten(F.col("parts.ids")).alias("ids")))

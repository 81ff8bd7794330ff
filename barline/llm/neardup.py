"""Near-duplicate classes by DartMinHash signatures, banded joins and exact verification.

Signatures. Every word shingle is an element with a weight. Darts are thrown at its region of the
(rank, weight) plane: along each unit slice of weight they fall as a Poisson process in rank, all
from hashes of (shingle, slice, dart number), so equal elements get equal darts in all documents.
A dart also names one of the k coordinates; each coordinate keeps its earliest dart. Ranks are
thrown up to k (ln k + c) expected darts per document whatever its length, and further only for
documents with an empty coordinate. Two documents share a coordinate with the probability of their
weighted Jaccard similarity.

Classes. Bands of six coordinates are joined by key. Nobody lists the pairs of a bucket: its members
are compared in full with the bucket's first member, best candidate first, and links are merged to
classes. Then only buckets that still hold several classes are looked at: members outside the
bucket's largest class meet the members of other classes in tiles that give out links only, unless
sizes or the triangle inequality of the Jaccard distance rule a pair out. So every pair of documents in one bucket with the asked
similarity ends in one class, while a bucket full of copies of each other costs one row per member.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from barline.llm.common import col, stage

WORDS = 5
SIMILARITY = 0.8
COORDINATES = 180
ROWS = 6
TILE_ROWS, TILE_COLUMNS = 64, 512
SPARE = 3.0  # c: a coordinate stays empty in the first throw with probability exp(-c)

# Odd multipliers of the 64-bit mixing steps (fixed values of the splitmix finaliser).
MIX_1, MIX_2, GOLD = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
WORD_BYTE = np.zeros(256, dtype=bool)
WORD_BYTE[[*b"abcdefghijklmnopqrstuvwxyz0123456789", *range(128, 256)]] = True


def mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * MIX_1
    x = (x ^ (x >> np.uint64(27))) * MIX_2
    return x ^ (x >> np.uint64(31))


BYTE_VALUE = mix(np.arange(1, 257, dtype=np.uint64) * GOLD)
BASE = 0x2545F4914F6CDD1D
POWERS = np.ones(1, dtype=np.uint64)
BLOCK_BYTES = 1 << 20
BLOCK_DARTS = 1 << 16
NONE = np.iinfo(np.uint64).max


def powers(n: int) -> np.ndarray:
    """The first n powers of BASE modulo 2^64, kept for the next call."""
    global POWERS
    if len(POWERS) < n:
        POWERS = np.full(max(n, 2 * len(POWERS)), BASE, dtype=np.uint64)
        POWERS[0] = 1
        POWERS = np.multiply.accumulate(POWERS)
    return POWERS[:n]


def shingles(texts: list[str], words: int = WORDS) -> list[np.ndarray]:
    """Hashes of all runs of ``words`` words of each text, repeats included. Words are runs of
    letters and digits without regard to case (non-ASCII characters count as letters). A text
    with fewer words is one shingle of all of them; one without a word is one of its own."""
    parts = [t.lower().encode("utf-8", "replace") + b" " for t in texts]
    border = np.cumsum([0] + [len(p) for p in parts])
    data = np.frombuffer(b"".join(parts), np.uint8)
    inside = np.zeros(len(data) + 1, dtype=np.int8)
    inside[1:] = WORD_BYTE[data]
    step = np.diff(inside)
    start, end = np.flatnonzero(step == 1), np.flatnonzero(step == -1)
    length = end - start
    letter = np.flatnonzero(inside[1:])
    word = np.zeros(0, dtype=np.uint64)
    if len(start):
        begin = np.cumsum(length) - length
        place = np.arange(len(letter)) - np.repeat(begin, length)
        word = mix(np.add.reduceat(BYTE_VALUE[data[letter]] * powers(int(length.max()))[place], begin)
                   + length.astype(np.uint64))
    first = np.searchsorted(start, border)
    run = np.zeros(max(0, len(word) - words + 1), dtype=np.uint64)
    for k in range(words if len(run) else 0):
        run = mix(run + GOLD + word[k:len(word) - words + 1 + k])
    out = []
    for i, text in enumerate(texts):
        lo, hi = first[i], first[i + 1]
        if hi - lo >= words:
            out.append(run[lo:hi - words + 1])
        else:
            value = np.zeros(1, dtype=np.uint64)
            own = word[lo:hi] if hi > lo else BYTE_VALUE[np.frombuffer(
                b"\0" + text.encode("utf-8", "replace"), np.uint8)]
            for w in own:
                value = mix(value + GOLD + w)
            out.append(value)
    return out


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform numbers in (0, 1) from hashes."""
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0 ** -53


def dart_min_hash(sets: list[tuple[np.ndarray, np.ndarray]], k: int = COORDINATES) -> np.ndarray:
    """One row of k values per weighted set (elements, weights), each with some positive weight."""
    best = np.full(len(sets) * k, NONE, dtype=np.uint64)
    weight = np.concatenate([w for _, w in sets])
    slices = np.ceil(weight).astype(np.int64)
    owner = np.repeat(np.repeat(np.arange(len(sets)), [len(w) for _, w in sets]), slices)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(slices) - slices, slices)
    part = np.minimum(np.repeat(weight, slices) - number, 1.0)
    seed = mix(np.repeat(np.concatenate([e for e, _ in sets]), slices) + GOLD * (number + 1).astype(np.uint64))
    limit = k * (math.log(k) + SPARE) / np.array([w.sum() for _, w in sets])
    rank, darts = np.zeros(len(seed)), np.zeros(len(seed), dtype=np.uint64)
    while len(seed):
        beyond = []
        while len(seed):
            # A block of further darts for every slice whose last dart was within the limit.
            width = max(1, min(64, BLOCK_DARTS // len(seed)))
            h = mix(seed[:, None] + GOLD * (darts[:, None] + np.arange(1, width + 1, dtype=np.uint64)))
            step = -np.log(unit(h))
            step[:, 0] += rank
            ranks = np.cumsum(step, axis=1)
            within = ranks <= limit[owner][:, None]
            at, _ = np.nonzero(within)
            _keep_earliest(best, owner[at] * k, ranks[within], part[at], mix(h[within] ^ MIX_1), k)
            # Darts beyond the limit are not used yet: they are thrown anew if the limit grows.
            used = within.sum(axis=1)
            rank = np.where(used > 0, ranks[np.arange(len(seed)), used - 1], rank)
            darts = darts + used.astype(np.uint64)
            on = used == width
            beyond.append((seed[~on], part[~on], owner[~on], rank[~on], darts[~on]))
            seed, part, owner, rank, darts = seed[on], part[on], owner[on], rank[on], darts[on]
        # Only sets with an empty coordinate go on, with twice the limit.
        empty = (best.reshape(-1, k) == NONE).any(axis=1)
        limit = limit * 2
        seed, part, owner, rank, darts = (np.concatenate(x) for x in zip(*beyond, strict=True))
        on = empty[owner]
        seed, part, owner, rank, darts = seed[on], part[on], owner[on], rank[on], darts[on]
    return best.reshape(-1, k)


def _keep_earliest(best, base, rank, part, h, k):
    """A dart counts if its weight within the slice lies under the element's weight. The rank
    leads the 64-bit value, so the smallest value of a coordinate is its earliest dart."""
    if (part < 1).any():
        under = unit(mix(h ^ MIX_2)) < part
        base, rank, h = base[under], rank[under], h[under]
    value = (rank.astype(np.float32).view(np.uint32).astype(np.uint64) << np.uint64(32)) \
        | (h & np.uint64(0xFFFFFFFF))
    np.minimum.at(best, base + ((h >> np.uint64(32)) % np.uint64(k)).astype(np.int64), value)


def blocks(texts: list[str]):
    """Slices of a batch of about BLOCK_BYTES characters, so that scratch arrays stay bounded."""
    lo = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > BLOCK_BYTES:
            yield texts[lo:i]
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield texts[lo:]


def band_keys(signatures: np.ndarray, rows: int = ROWS) -> np.ndarray:
    bands = signatures.reshape(len(signatures), -1, rows)
    key = np.tile(np.arange(1, bands.shape[1] + 1, dtype=np.uint64) * GOLD, (len(bands), 1))
    for j in range(rows):
        key = mix(key + bands[:, :, j])
    return key


def signed(df: DataFrame, words: int, counted: bool) -> DataFrame:
    """(doc, version, given, body) to doc, version, given, set_1 and set_2 (128-bit hash of the
    weighted set), size, bands."""

    def run(batches):
        for b in batches:
            one, two, size, bands = [], [], [], []
            for part in blocks(b.column("body").to_pylist()):
                sets = []
                for x in shingles(part, words):
                    element, count = np.unique(x, return_counts=True)
                    weight = count.astype(float) if counted else np.ones(len(element))
                    own = mix(element + GOLD * weight.astype(np.uint64))
                    one.append(own.sum(dtype=np.uint64).astype(np.int64))
                    two.append(mix(own ^ MIX_2).sum(dtype=np.uint64).astype(np.int64))
                    size.append(float(weight.sum()))
                    sets.append((element, weight))
                bands.extend(band_keys(dart_min_hash(sets)).view(np.int64))
            yield pa.RecordBatch.from_pydict({
                **{c: b.column(c) for c in ("doc", "version", "given")},
                "set_1": pa.array(one, pa.int64()), "set_2": pa.array(two, pa.int64()),
                "size": pa.array(size, pa.float64()), "bands": pa.array(bands, pa.list_(pa.int64()))})

    return df.mapInArrow(run, "doc long, version long, given boolean, set_1 long, set_2 long, size double, "
                         "bands array<long>")


def elements(df: DataFrame, words: int, counted: bool) -> DataFrame:
    """(node, body) to node and its elements; a repeated shingle counts as several elements."""

    def run(batches):
        for b in batches:
            out = []
            for part in blocks(b.column("body").to_pylist()):
                for x in shingles(part, words):
                    element, count = np.unique(x, return_counts=True)
                    if counted:
                        number = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
                        element = mix(np.repeat(element, count) + GOLD * number.astype(np.uint64))
                    out.append(element.view(np.int64))
            yield pa.RecordBatch.from_pydict({"node": b.column("node"),
                                              "items": pa.array(out, pa.list_(pa.int64()))})

    return df.mapInArrow(run, "node long, items array<long>")


def verified(pairs: DataFrame, sets: DataFrame, name: str) -> DataFrame:
    """Pairs (a, b) with their exact similarity."""
    both = (pairs.join(sets.select(F.col("node").alias("a"), F.col("items").alias("x")), "a")
            .join(sets.select(F.col("node").alias("b"), F.col("items").alias("y")), "b"))
    shared = F.size(F.array_intersect("x", "y"))
    return stage(both.select("a", "b", (shared / (F.size("x") + F.size("y") - shared)).alias("similarity")), name)


def cross_links(mine: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """Links (a, b) between classes inside the buckets of ``mine`` (bucket, node, label, main, far).

    Members outside a bucket's main class are the rows and all members the columns of a grid, cut
    into tiles of bounded size. A tile compares its sets in memory and gives out links only, one
    per row and class, so a group of documents that are almost alike lists no pairs.
    """
    counts = mine.groupBy("bucket").agg(
        F.ceil(F.count(F.when(F.col("label") != F.col("main"), 1)) / TILE_ROWS).cast("int").alias("down"),
        F.ceil(F.count("*") / TILE_COLUMNS).cast("int").alias("across"))
    mine = mine.join(counts, "bucket").join(sets, "node")
    part = lambda n: F.pmod(F.xxhash64("node"), F.col(n)).cast("int")
    spread = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    held = ["node", "label", "far", "items"]
    rows = mine.where("label <> main").select("bucket", part("down").alias("row"), spread("across").alias("column"), *held)
    columns = mine.select("bucket", part("across").alias("column"), spread("down").alias("row"), *held)
    rows, columns = rows.toDF(*rows.columns), columns.toDF(*columns.columns)  # no shared columns
    gap = 1 - similarity + 1e-9

    def compare(one: pa.Table, other: pa.Table) -> pa.Table:
        found = set()
        if one.num_rows and other.num_rows:
            mine_, theirs = ({c: t[c].to_numpy() for c in ("node", "label", "far")} for t in (one, other))
            x = [np.asarray(v, dtype=np.int64) for v in one["items"].to_numpy()]
            y = [np.asarray(v, dtype=np.int64) for v in other["items"].to_numpy()]
            vocabulary = np.unique(np.concatenate(x))
            has = np.zeros((len(x), len(vocabulary)), dtype=bool)
            for i, v in enumerate(x):
                has[i, np.searchsorted(vocabulary, v)] = True
            size = np.array([len(v) for v in x])
            for j, v in enumerate(y):
                # far is unknown (NaN) for members that were not compared with the bucket's head
                apart = np.abs(mine_["far"].astype(float) - float(np.nan if theirs["far"][j] is None else theirs["far"][j]))
                ok = ((mine_["label"] != theirs["label"][j]) & ~(apart > gap)
                      & (np.minimum(size, len(v)) >= similarity * np.maximum(size, len(v)) - 1e-9))
                if ok.any():
                    at = np.minimum(np.searchsorted(vocabulary, v), len(vocabulary) - 1)
                    shared = has[np.flatnonzero(ok)][:, at[vocabulary[at] == v]].sum(axis=1)
                    alike = shared / (size[ok] + len(v) - shared) >= similarity
                    for i in np.flatnonzero(ok)[alike]:
                        found.add((int(mine_["node"][i]), int(theirs["label"][j])))
        a, b = zip(*sorted(found), strict=True) if found else ((), ())
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    tile = ["bucket", "row", "column"]
    return (rows.groupBy(*tile).cogroup(columns.groupBy(*tile))
            .applyInArrow(compare, "a long, b long").distinct())


def components(links: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(node, label): the smallest node that each node reaches over ``links`` (a, b) and over the
    classes ``known``. Labels spread to neighbours and then jump to their label's label, round
    by round; each round is a written table."""
    edges = links.select("a", "b")
    if known is not None:
        edges = edges.unionByName(known.where("node <> label").select(F.col("node").alias("a"),
                                                                      F.col("label").alias("b")))
    edges = stage(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = stage(edges.groupBy(F.col("a").alias("node")).agg(F.least("node", F.min("b")).alias("label")), "labels")
    while True:
        near = (edges.join(labels.select(F.col("node").alias("b"), "label"), "b")
                .groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near")))
        down = (labels.join(near, "node")
                .select("node", F.col("label").alias("old"), F.least("label", "near").alias("label")))
        up = labels.select(F.col("node").alias("label"), F.col("label").alias("next"))
        new = stage(down.join(up, "label").select("node", "old", F.least("label", "next").alias("label")), "labels")
        if new.where("label <> old").isEmpty():
            return new.select("node", "label")
        labels = new.select("node", "label")


def labelled(df: DataFrame, labels: DataFrame, node: str, name: str) -> DataFrame:
    """``df`` with the label of ``node``; nodes without links are their own class."""
    return (df.join(labels.select(F.col("node").alias(node), F.col("label").alias(name)), node, "left")
            .withColumn(name, F.coalesce(name, node)))


def identified(docs: DataFrame, key: str, text: str, *more) -> DataFrame:
    """(doc, version, ...): the key, or a hash of the text for a null one, and the text's hash."""
    body = F.coalesce(col(text), F.lit(""))
    return docs.select(F.coalesce(col(key).cast("long"), F.xxhash64(body)).alias("doc"),
                       F.xxhash64(F.lit(1), body).alias("version"), *more)


def classes(docs: DataFrame, key: str, text: str, words: int, similarity: float, counted: bool) -> DataFrame:
    """(doc, version, given, node, class_node), one row per row of ``docs``: what :func:`identified`
    gives, whether the key is there, the node of the row's set and that of its class. Nodes are
    sets, numbered once, so rows that repeat a key with other texts keep links of their own."""
    df = identified(docs, key, text, col(key).cast("long").isNotNull().alias("given"),
                    F.coalesce(col(text), F.lit("")).alias("body"))
    sign = stage(signed(df, words, counted), "signatures")
    one = ["doc", "version"]
    first = stage(sign.groupBy("set_1", "set_2").agg(F.min(F.struct(*one)).alias("of"))
                  .select("set_1", "set_2", "of.*", F.monotonically_increasing_id().alias("node")), "nodes")
    member = stage(sign.select(*one, "given", "set_1", "set_2").join(first.drop(*one), ["set_1", "set_2"])
                   .select(*one, "given", "node"), "members")
    bands = (sign.join(first, [*one, "set_1", "set_2"]).dropDuplicates(["node"])
             .select("node", "size", F.explode("bands").alias("bucket")))
    full = (bands.groupBy("bucket").agg(F.min("node").alias("head"), F.count("*").alias("n"))
            .where("n > 1").select("bucket", "head"))
    shared = stage(bands.join(full, "bucket").select("bucket", "node", "size", "head"), "buckets")
    if shared.isEmpty():
        return member.withColumn("class_node", F.col("node"))
    needed = first.join(shared.select("node").distinct(), "node").select(*one, "node")
    sets = stage(elements(df.join(needed, one).dropDuplicates(["node"]).select("node", "body"), words, counted), "sets")

    star = (shared.where("node <> head").groupBy(F.col("node").alias("a"), F.col("head").alias("b"))
            .agg(F.count("*").alias("bands")))
    best = star.groupBy("a").agg(F.max(F.struct("bands", "b")).alias("best")).select("a", F.col("best.b").alias("b"))
    alike = F.col("similarity") >= similarity
    done = verified(best, sets, "first-links")
    labels = components(done.where(alike))
    rest = (labelled(labelled(star.join(done.select("a", "b"), ["a", "b"], "left_anti"), labels, "a", "la"),
                     labels, "b", "lb").where("la <> lb").select("a", "b"))
    more = verified(rest, sets, "further-links")
    if not more.where(alike).isEmpty():
        labels = components(more.where(alike), labels)

    # What is left: pairs of different classes inside one bucket.
    mine = labelled(shared, labels, "node", "label")
    parts = mine.groupBy("bucket", "label").agg(F.count("*").alias("n"))
    largest = (parts.groupBy("bucket").agg(F.max(F.struct("n", "label")).alias("top"), F.count("*").alias("classes"))
               .where("classes > 1").select("bucket", F.col("top.label").alias("main")))
    known = done.unionByName(more)
    mine = mine.join(largest, "bucket").join(
        known.select(F.col("a").alias("node"), F.col("b").alias("head"), "similarity"), ["node", "head"], "left")
    mine = stage(mine.withColumn("far", F.when(F.col("node") == F.col("head"), 0.0).otherwise(1 - F.col("similarity"))),
                 "mixed-buckets")
    last = stage(cross_links(mine, sets, similarity), "last-links")
    if not last.isEmpty():
        labels = components(last, labels)
    return labelled(member, labels, "node", "class_node")


def near_groups(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                similarity: float = SIMILARITY, counted: bool = False) -> DataFrame:
    """One row per document: key, class_id, class_size, kept.

    Documents are linked when the sets of their runs of ``words`` words have a Jaccard similarity
    of ``similarity`` or more (with ``counted``: the bags of runs); classes are what links connect.
    class_id is the smallest key of the class, whose document stays. Null counts as empty text;
    texts without a word are alike only if equal. Rows that repeat a key with the same text are one
    document and stay or go together; with other texts each has its own links and class, and if they
    meet in one class the text with the smallest hash stays. A null key is replaced by a hash of the
    text and stays null in the result. An empty table gives no rows; other columns are ignored.
    """
    of = stage(classes(docs, key, text, words, similarity, counted), "classes")
    return of.join(heads(of), "class_node").select(
        F.when(F.col("given"), F.col("doc")).alias(key), F.col("head.doc").alias("class_id"), "class_size",
        (F.struct("doc", "version") == F.col("head")).alias("kept"))


def heads(of: DataFrame) -> DataFrame:
    """(class_node, head, class_size): the document that stays and the rows of each class."""
    return of.groupBy("class_node").agg(F.min(F.struct("doc", "version")).alias("head"),
                                        F.count("*").alias("class_size"))


def drop_near_copies(docs: DataFrame, key: str = "doc_id", text: str = "text", words: int = WORDS,
                     similarity: float = SIMILARITY) -> DataFrame:
    """The rows of ``docs`` whose document stays, by the rules of :func:`near_groups`."""
    of = stage(classes(docs, key, text, words, similarity, False), "classes")
    gone = (of.join(heads(of), "class_node").where(F.struct("doc", "version") != F.col("head"))
            .select("doc", "version").distinct())
    row = identified(docs, key, text, F.struct(*map(col, docs.columns)).alias("row"))
    return row.join(gone, ["doc", "version"], "left_anti").select("row.*").toDF(*docs.columns)

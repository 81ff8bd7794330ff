"""The prefix trie of conversations, with count-min screening of the prefixes.

Every prefix of a conversation has a digest: the sum, position by position, of hashes of (depth, turn).
A sum adds up in any order, so a conversation of any length is cut into blocks of turns, summed apart
and carried on; no window runs over a whole conversation.

A count-min sketch counts all digests once. It never counts too low, so an estimate of one proves
that no other conversation has the prefix: such nodes, the tails of the trie, are emitted where they
are, with nothing shuffled but the first of a tail, which asks for its parent. All other prefixes may be
shared and are grouped exactly. Where the sketch is too full for its bound, more prefixes go the exact
way; the rows are the same.

Sums over a subtree need no walk. A node belongs to its smallest member, and a member's own
nodes are the lower end of its path: the sum over a subtree is that of the members' own totals, but for
its smallest member, of whose nodes only those from this depth on count.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import col, stage
from barline.plans.ranks import numbered

WORD = r"[^\x20\x09-\x0D]+"
FAMILY = 20         # conversations of one family share the first turns of its first one
BLOCK = 1024        # turns of a conversation, or nodes of a path, that one window holds
SKETCH_ROWS = 3
SKETCH_WIDTH = 1 << 24   # counters a row has at most, one byte each
CHUNK = 1 << 16     # counters that travel together
RUN = 4096          # ids joined to one text before the hash of a node's ends
HOT = 10_000        # nodes with more than 1 / HOT of the shared prefixes are looked up by broadcast
KEY, ABOVE = ["k1", "k2"], ["a1", "a2"]


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
            text: str = "text", shared: Column | None = None, family: int = FAMILY) -> tuple[DataFrame, DataFrame]:
    """The turns (conv, depth, turn_hash, words) and conversations (conv, length) after rebuilding.

    A conversation begins with the first h turns of its family's first conversation (id - id %
    ``family``; fewer if that has fewer, none if it is absent) and goes on with its own turns after
    its first h, where h is ``shared`` (over the column conv), by default crc32 of its id in
    decimal modulo 4, and at most 3. Turns stand by ``turn``, null first, then by the hash of role and text.
    """
    h = F.crc32(F.col("conv").cast("string").cast("binary")) % 4 if shared is None else shared
    role_, text_ = (F.coalesce(col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = conversations.where(col(conv).isNotNull()).select(
        col(conv).cast("long").alias("conv"), col(turn).alias("turn"),
        F.unhex(F.sha2(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_), 256)).alias("turn_hash"),
        F.regexp_count(text_, F.lit(WORD)).cast("long").alias("words"))
    rows = numbered(stage(rows, "turns"), "conv", [F.col("turn").asc_nulls_first(), F.col("turn_hash")],
                    "rank", "turns", "turn-order")
    rows = stage(rows.withColumn("h", h.cast("long")).drop("turn"), "ranked-turns")
    first = (rows.where((F.col("rank") < 3) & (F.col("conv") % family == 0)).groupBy(F.col("conv").alias("first"))
             .agg(F.array_sort(F.collect_list(F.struct("rank", "turn_hash", "words"))).alias("base")))  # 3 turns at most
    convs = (rows.where("rank = 0").select("conv", "turns", "h", (F.col("conv") - F.col("conv") % family).alias("first"))
             .join(first, "first", "left")
             .withColumn("base", F.coalesce(F.slice("base", F.lit(1), F.col("h").cast("int")), F.array()))
             .withColumn("k", F.size("base").cast("long"))
             .withColumn("length", F.col("k") + F.greatest(F.col("turns") - F.col("h"), F.lit(0))))
    convs = stage(convs.drop("first", "turns", "h"), "rebuilt-conversations")
    own = (rows.where("rank >= h").join(convs.select("conv", "k"), "conv")
           .select("conv", (F.col("rank") + 1 - F.col("h") + F.col("k")).alias("depth"), "turn_hash", "words"))
    lent = convs.select("conv", F.posexplode("base").alias("at", "x")).select(
        "conv", (F.col("at") + 1).cast("long").alias("depth"), "x.turn_hash", "x.words")
    return stage(own.unionByName(lent), "rebuilt-turns"), convs.select("conv", "length")


def _sums(df: DataFrame, group: str, by: str, values: list[str], backwards: bool = False) -> DataFrame:
    """Running sums of ``values`` along ``by`` inside ``group``, block by block, in place of the values."""
    df = df.withColumn("_block", F.floor(F.col(by) / BLOCK))
    order = (lambda c: F.col(c).desc()) if backwards else (lambda c: F.col(c))
    blocks = df.groupBy(group, "_block").agg(*[F.sum(v).alias(f"_{v}") for v in values])
    along = Window.partitionBy(group).orderBy(order("_block")).rowsBetween(Window.unboundedPreceding, -1)
    before = blocks.select(group, "_block", *[F.coalesce(F.sum(f"_{v}").over(along), F.lit(0)).alias(f"_{v}") for v in values])
    inside = Window.partitionBy(group, "_block").orderBy(order(by)).rowsBetween(Window.unboundedPreceding, 0)
    out = df.select(*[F.sum(v).over(inside).alias(v) if v in values else F.col(v) for v in df.columns])
    out = out.join(before, [group, "_block"])
    return out.select(*[(F.col(c) + F.col(f"_{c}")).alias(c) if c in values else F.col(c) for c in df.columns if c != "_block"])


def prefixes(turns: DataFrame, convs: DataFrame) -> DataFrame:
    """One row per conversation and depth from 0 on: conv, depth, the node's key (k1, k2), its
    parent's (a1, a2), words of the last turn, and whether the conversation ends there."""
    parts = ["s1", "s2", "s3", "s4"]
    low = F.lit(0xFFFFFFFF)
    x, y = F.xxhash64("turn_hash", "depth"), F.xxhash64("depth", "turn_hash", F.lit(7))
    df = turns.select("conv", "depth", "words", F.shiftrightunsigned(x, 32).alias("s1"), x.bitwiseAND(low).alias("s2"),
                      F.shiftrightunsigned(y, 32).alias("s3"), y.bitwiseAND(low).alias("s4"))
    own = [f"o{p}" for p in parts]
    df = _sums(df.select("*", *[F.col(p).alias(o) for p, o in zip(parts, own)]), "conv", "depth", parts)

    def key(sums, depth):
        return F.xxhash64(*sums, depth), F.xxhash64(depth, *reversed(sums), F.lit(11))
    here = key([F.col(p) for p in parts], F.col("depth"))
    above = key([F.col(p) - F.col(o) for p, o in zip(parts, own)], F.col("depth") - 1)
    zero = F.lit(0).cast("long")
    root = key([zero] * 4, zero)
    df = df.select("conv", "depth", here[0].alias("k1"), here[1].alias("k2"), above[0].alias("a1"), above[1].alias("a2"), "words")
    ends = convs.select("conv", "length")
    df = df.join(ends, "conv").select(*df.columns, (F.col("depth") == F.col("length")).alias("ends"))
    roots = ends.select("conv", zero.alias("depth"), root[0].alias("k1"), root[1].alias("k2"), zero.alias("a1"), zero.alias("a2"),
                        zero.alias("words"), (F.col("length") == 0).alias("ends"))
    return df.unionByName(roots)


def buckets(a: np.ndarray, b: np.ndarray, width: int) -> list[np.ndarray]:
    """A counter per sketch row for digests given as two halves; ``width`` is a power of two."""
    a, b = a.view(np.uint64), b.view(np.uint64) | np.uint64(1)
    return [((a + np.uint64(i) * b) >> np.uint64(20)) & np.uint64(width - 1) for i in range(SKETCH_ROWS)]


def sketch(rows: DataFrame, width: int) -> np.ndarray:
    """Count-min sketch of the keys, counters stopped at 2 (one or more is all that is asked):
    each task counts its rows, equal chunks of all tasks meet in one place and are added up, and
    SKETCH_ROWS x ``width`` bytes, at most 48 MB, reach the driver."""
    def count(batches):
        counts = np.zeros((SKETCH_ROWS, width), dtype=np.uint8)
        for b in batches:
            at = buckets(b.column("k1").to_numpy(), b.column("k2").to_numpy(), width)
            for i, x in enumerate(at):
                x = np.sort(x)
                new = np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1]])) if len(x) else np.zeros(0, int)
                n = np.diff(np.concatenate([new, [len(x)]])) if len(new) else new
                counts[i, x[new]] = np.minimum(2, counts[i, x[new]] + np.minimum(n, 2))
        flat = counts.reshape(-1)
        for c in range(0, len(flat), CHUNK):
            if flat[c:c + CHUNK].any():
                yield pa.RecordBatch.from_pydict({"chunk": pa.array([c // CHUNK], pa.int32()),
                                                  "counts": pa.array([flat[c:c + CHUNK].tobytes()], pa.binary())})

    def add(batches):
        now, total = None, None
        for b in batches:
            for c, x in zip(b.column("chunk").to_pylist(), b.column("counts").to_pylist(), strict=True):
                x = np.frombuffer(x, np.uint8)
                if c != now and now is not None:
                    yield out(now, total)
                total = np.minimum(2, total + x) if c == now else x
                now = c
        if now is not None:
            yield out(now, total)

    def out(chunk, counts):
        return pa.RecordBatch.from_pydict({"chunk": pa.array([chunk], pa.int32()), "counts": pa.array([counts.tobytes()], pa.binary())})

    kind = "chunk int, counts binary"
    parts = (rows.select("k1", "k2").mapInArrow(count, kind).repartition("chunk").sortWithinPartitions("chunk")
             .mapInArrow(add, kind).toArrow())
    flat = np.zeros(SKETCH_ROWS * width, dtype=np.uint8)
    for c, x in zip(parts["chunk"].to_pylist(), parts["counts"].to_pylist(), strict=True):
        flat[c * CHUNK:c * CHUNK + len(x)] = np.frombuffer(x, np.uint8)
    return flat.reshape(SKETCH_ROWS, width)


def screened(rows: DataFrame, width: int | None = None) -> DataFrame:
    """``rows`` with ``alone``: the sketch proves that the prefix is of this conversation only, and
    ``above_alone``: so for its parent. The width is some four counters a prefix, up to SKETCH_WIDTH."""
    if not width:
        width = 1 << max(10, min((4 * rows.count()).bit_length(), SKETCH_WIDTH.bit_length() - 1))
    counts = rows.sparkSession.sparkContext.broadcast(sketch(rows, width))

    def one(a, b):
        return np.minimum.reduce([counts.value[i][x] for i, x in enumerate(buckets(a, b, width))]) == 1

    def mark(batches):
        for b in batches:
            k1, k2, a1, a2 = (b.column(c).to_numpy() for c in KEY + ABOVE)
            alone, above = one(k1, k2), one(a1, a2) & (b.column("depth").to_numpy() > 0)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(alone), pa.array(above)],
                                             names=[*b.schema.names, "alone", "above_alone"])

    kinds = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in rows.schema)
    return rows.mapInArrow(mark, f"{kinds}, alone boolean, above_alone boolean")


def ends_hash(rows: DataFrame) -> DataFrame:
    """(k1, k2, ends_sha256) over the conversations of ``rows`` (k1, k2, conv), ascending and joined by
    commas. Tasks join sorted runs of ids to texts first; a hash takes its bytes in order, so the texts of
    one node, some ten bytes an id, then pass through one task, one at a time."""
    def joined(batches):
        key, ids = None, []
        for b in batches:
            for a, c, i in zip(*(b.column(x).to_pylist() for x in (*KEY, "conv")), strict=True):
                if ids and ((a, c) != key or len(ids) == RUN):
                    yield text(key, ids)
                    ids = []
                key = (a, c)
                ids.append(i)
        if ids:
            yield text(key, ids)

    def text(key, ids):
        return pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "first": [ids[0]], "ids": [",".join(map(str, ids))]})

    def hashed(batches):
        key, state = None, None
        for b in batches:
            for a, c, t in zip(*(b.column(x).to_pylist() for x in (*KEY, "ids")), strict=True):
                if (a, c) == key:
                    state.update(b"," + t.encode())
                else:
                    if key is not None:
                        yield out(key, state)
                    key, state = (a, c), hashlib.sha256(t.encode())
        if key is not None:
            yield out(key, state)

    def out(key, state):
        return pa.RecordBatch.from_pydict({"k1": [key[0]], "k2": [key[1]], "ends_sha256": [state.hexdigest()]})

    runs = (rows.select(*KEY, "conv").repartitionByRange(*KEY, "conv").sortWithinPartitions(*KEY, "conv")
            .mapInArrow(joined, "k1 long, k2 long, first long, ids string"))
    return (runs.repartition(*KEY).sortWithinPartitions(*KEY, "first")
            .mapInArrow(hashed, "k1 long, k2 long, ends_sha256 string"))


def trie(turns: DataFrame, convs: DataFrame, width: int | None = None) -> DataFrame:
    """The nodes of the conversations' prefix trie: conv_id (smallest member), depth, parent_conv_id,
    n_convs, n_children, n_leaves, saved_tokens, ends_sha256.

    ``turns`` holds conv, depth (from 1), turn_hash and words, ``convs`` conv and length, each
    conversation once; one without turns is a member of the root. Without conversations there is no node.
    """
    zero = F.lit(0).cast("long")
    rows = stage(screened(stage(prefixes(turns, convs), "prefixes"), width), "screened")
    single = rows.where("alone")
    tails = single.select(
        "conv", "depth", *ABOVE, (~F.col("above_alone") & (F.col("depth") > 0)).alias("asks"), F.lit(1).cast("long").alias("n_convs"),
        F.when(F.col("ends"), zero).otherwise(1).alias("n_children"), F.lit(1).cast("long").alias("n_leaves"), zero.alias("saved_tokens"),
        F.sha2(F.when(F.col("ends"), F.col("conv").cast("string")).otherwise(""), 256).alias("ends_sha256"))

    shared = rows.where("NOT alone").select("conv", "depth", *KEY, *ABOVE, "words", "ends", "above_alone")
    nodes = stage(shared.groupBy(*KEY).agg(
        F.min("conv").alias("conv"), F.count("*").alias("n_convs"), F.max("depth").alias("depth"), F.max("words").alias("words"),
        F.max("above_alone").alias("above_alone"), F.max("a1").alias("a1"), F.max("a2").alias("a2")), "shared-nodes")
    asks = (F.col("depth") > 0) & ~F.col("above_alone")
    children = (nodes.where(asks).select(*ABOVE).unionByName(tails.where("asks").select(*ABOVE))
                .groupBy(F.col("a1").alias("k1"), F.col("a2").alias("k2")).agg(F.count("*").alias("n_children")))
    nodes = nodes.join(children, KEY, "left").withColumn("n_children", F.coalesce("n_children", zero))
    nodes = stage(nodes.withColumn("worth", (F.col("n_convs") - 1) * F.col("words")), "nodes-children")

    # What a conversation adds to the nodes on its path: its own nodes' worth, and a leaf if it has one.
    adds = (nodes.select("conv", "worth", (F.col("n_children") == 0).cast("long").alias("leaf"))
            .unionByName(single.where("ends").select("conv", zero.alias("worth"), F.lit(1).cast("long").alias("leaf")))
            .groupBy("conv").agg(F.sum("worth").alias("worth"), F.sum("leaf").alias("leaf")))
    adds = stage(adds, "conversation-adds")
    sums = (shared.select(*KEY, "conv").join(adds, "conv", "left").groupBy(*KEY)
            .agg(F.sum("worth").alias("all_worth"), F.coalesce(F.sum("leaf"), zero).alias("n_leaves")))
    below = _sums(nodes.select(*KEY, "conv", "depth", "worth"), "conv", "depth", ["worth"], backwards=True)
    below = (below.withColumnRenamed("worth", "below").join(adds.select("conv", F.col("worth").alias("own")), "conv")
             .select(*KEY, (F.col("below") - F.col("own")).alias("less")))
    ends = ends_hash(shared.where("ends"))
    known = (nodes.join(sums, KEY).join(below, KEY).join(ends, KEY, "left")
             .select("conv", "depth", *ABOVE, asks.alias("asks"), "n_convs", "n_children", "n_leaves",
                     (F.col("all_worth") + F.col("less")).alias("saved_tokens"),
                     F.coalesce("ends_sha256", F.sha2(F.lit(""), 256)).alias("ends_sha256")))

    # Parents of shared nodes and of the first nodes of tails; those with very many members, fewer than
    # HOT nodes by this threshold, by broadcast. Below a node that is alone, the parent is of the same conversation.
    total = nodes.agg(F.sum("n_convs")).first()[0] or 0
    names = nodes.select(F.col("k1").alias("a1"), F.col("k2").alias("a2"), F.col("conv").alias("parent"), "n_convs")
    hot = names.where(F.col("n_convs") > total // HOT).select(*ABOVE, "parent")
    asking = stage(known.unionByName(tails.where("asks")), "asking")
    met = asking.where("asks").join(F.broadcast(hot), ABOVE, "left")
    cold = met.where("parent IS NULL").drop("parent").join(names.drop("n_convs"), ABOVE)
    own = asking.where("NOT asks").unionByName(tails.where("NOT asks"))
    done = (met.where("parent IS NOT NULL").unionByName(cold)
            .unionByName(own.withColumn("parent", F.when(F.col("depth") > 0, F.col("conv")))))
    return done.select(F.col("conv").alias("conv_id"), "depth", F.col("parent").alias("parent_conv_id"), "n_convs",
                       "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def conversation_trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role",
                      text: str = "text", width: int | None = None) -> DataFrame:
    """The trie of the rebuilt conversations, one row per node; see :func:`rebuilt` and :func:`trie`.

    A null role or text is an empty one, a null turn comes first, rows that repeat a turn stand by the
    hash of role and text and count one by one. Rows without a conversation's id belong to none and are
    left out. An empty table has no node, not even a root. Other columns, of any name, are ignored.
    """
    return trie(*rebuilt(conversations, conv, turn, role, text), width)

"""A Merkle manifest of a dataset: leaves, subroots per source, one root, and a proof per row.

The leaves of a source stand in the order of the key; every 16 consecutive nodes become one, until
one is left, the source's subroot; the subroots, in the order of the sources, become the root in the
same way. A node stands in a run (its position over 16) at a slot (the remainder), and the window of
its run supplies all that a level needs: ``lag`` and ``lead`` at the fixed offsets 1 to 15 are null
where the slot or the run's length has no such sibling, the others, from left to right, are its
siblings; and the first child's own hash with its leads is what the parent hashes.

Runs hold 16 rows, so a source with a third of all rows is spread over all tasks; the positions come
from sampled range partitions and their counts. Each level is a written table a sixteenth as large
as the one below. Going down again, a node adds its own siblings to those of its parent, met in the
same run, so that no list is looked up by source.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from barline.llm.common import col, stage
from barline.plans.ranks import numbered

WIDTH = 16
BITS = 4       # of WIDTH
DIGEST = 64    # characters of a digest in hex


def digest(*parts: Column) -> Column:
    """SHA-256, as lowercase hex, of the parts one after the other; digests go in as hex text."""
    return F.sha2(F.concat(*parts), 256)


def field(c: Column) -> Column:
    """A value as its UTF-8 byte count, a colon and its text, or ``-`` if null."""
    value = c.cast("string")
    return F.when(c.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(value).cast("string"), F.lit(":"), value))


def lower_ascii(c: Column) -> Column:
    return F.translate(c, string.ascii_uppercase, string.ascii_lowercase)


def _run(nodes: DataFrame) -> DataFrame:
    return (nodes.withColumn("run", F.shiftright("pos", BITS))
            .withColumn("slot", F.col("pos").bitwiseAND(WIDTH - 1)))


def _kin() -> tuple[list[Column], list[Column]]:
    """The hashes before and after a node in its run, each at its fixed offset."""
    along = Window.partitionBy("line", "run").orderBy("slot")
    return ([F.lag("hash", k).over(along) for k in range(WIDTH - 1, 0, -1)],
            [F.lead("hash", k).over(along) for k in range(1, WIDTH)])


def parents(nodes: DataFrame) -> DataFrame:
    """The level above ``nodes`` (line, pos, n, hash), for lines that have several of them."""
    _, after = _kin()
    return (_run(nodes.where("n > 1").select("line", "pos", "n", "hash"))
            .select("line", "run", "slot", "n", F.concat_ws("", F.col("hash"), *after).alias("children"))
            .where("slot = 0")
            .select("line", F.col("run").alias("pos"), F.shiftright(F.col("n") + (WIDTH - 1), BITS).alias("n"),
                    F.sha2("children", 256).alias("hash")))


def levels_of(leaves: DataFrame, name: str) -> list[DataFrame]:
    """``leaves`` (a written table) and the levels above it, up to one node per line."""
    out = [leaves]
    while True:
        up = stage(parents(out[-1]), f"{name}-{len(out)}")
        if up.isEmpty():
            return out
        out.append(up)


def tops(levels: list[DataFrame]) -> DataFrame:
    """(line, hash) of the last node of every line."""
    ends = [x.where("n = 1").select("line", "hash") for x in levels]
    out = ends[0]
    for x in ends[1:]:
        out = out.unionByName(x)
    return out


def with_paths(levels: list[DataFrame], ends: DataFrame, name: str) -> DataFrame:
    """The leaves with ``path``, the siblings' hashes of each level as one text, from the leaf's own
    level upwards, and the columns of ``ends`` (one row per line)."""
    more = [c for c in ends.columns if c != "line"]
    before, after = _kin()
    above = None
    for k in range(len(levels) - 1, -1, -1):
        nodes = levels[k]
        here = nodes.where("n = 1").join(ends, "line").withColumn("path", F.array().cast("array<string>"))
        if above is not None:
            up = above.select("line", F.col("pos").alias("run"), F.col("path").alias("_path"), *more)
            kin = (_run(nodes.where("n > 1")).withColumn("kin", F.concat_ws("", *before, *after))
                   .join(up, ["line", "run"]))
            here = here.unionByName(kin.withColumn("path", F.concat(F.array("kin"), F.col("_path")))
                                    .drop("kin", "_path", "run", "slot"))
        above = stage(here.select("line", "pos", "path", *more), f"{name}-{k}") if k else here
    return above


def climbed(leaf: Column, path: Column, pos: Column) -> Column:
    """The hash that a leaf reaches with the siblings of ``path``, from its position."""
    def step(a, kin):
        cut = a["p"].bitwiseAND(WIDTH - 1).cast("int") * DIGEST
        return F.struct(F.sha2(F.concat(F.substr(kin, F.lit(1), cut), a["h"], F.substr(kin, cut + 1)), 256).alias("h"),
                        F.shiftright(a["p"], BITS).alias("p"))
    return F.aggregate(path, F.struct(leaf.alias("h"), pos.cast("long").alias("p")), step)["h"]


def manifest(docs: DataFrame, key: str = "doc_id", source: str = "source",
             fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
             changed: dict[str, Column] | None = None) -> DataFrame:
    """One row per row of ``docs``: key, leaf, changed_leaf, pos, source_pos, subroot, root, path, source_path.

    A leaf hashes the ``fields`` in turn. ``changed`` gives other values of some fields; changed_leaf is
    the leaf with these. ``path`` holds the siblings of each level up to the subroot, ``source_path``
    those from there to the root, one text of hashes per level, empty where a run has one node;
    pos and source_pos are the places they start from.

    Null keys come first, rows that repeat a key stand in the order of their leaves (equal rows are
    equal leaves), the null source is a source and comes before the empty one. A single row is
    its own subroot, and a single subroot the root. An empty table gives no rows; other columns, of
    any name, take no part.
    """
    changed = changed or {}
    other = digest(*[field(changed.get(c, col(c))) for c in fields])
    name = F.when(col(source).isNull(), F.lit("0")).otherwise(F.concat(F.lit("1"), col(source).cast("string")))
    leaves = docs.select(name.alias("line"), col(key).alias("key"), digest(*[field(col(c)) for c in fields]).alias("hash"),
                         other.alias("changed"))
    leaves = stage(leaves.withColumn("changed", F.when(F.col("changed") != F.col("hash"), F.col("changed"))), "leaves")
    placed = numbered(leaves, "line", [F.col("key").asc_nulls_first(), F.col("hash")], name="merkle-order")
    levels = levels_of(stage(placed, "merkle-0"), "merkle")

    sources = tops(levels).select(F.lit("").alias("line"), F.col("line").alias("of"), "hash")
    sources = stage(numbered(sources, "line", [F.col("of")], name="merkle-sources"), "merkle-top-0")
    above = levels_of(sources, "merkle-top")
    root = tops(above).select("line", F.col("hash").alias("root"))
    ends = with_paths(above, root, "merkle-top-path").select(
        F.col("of").alias("line"), F.col("hash").alias("subroot"), F.col("pos").alias("source_pos"), "root",
        F.col("path").alias("source_path"))
    out = with_paths(levels, stage(ends, "merkle-ends"), "merkle-path")
    return out.select(F.col("key").alias(key), F.col("hash").alias("leaf"), F.coalesce("changed", "hash").alias("changed_leaf"),
                      "pos", "source_pos", "subroot", "root", "path", "source_path")


def verified(rows: DataFrame, leaf: str = "changed_leaf") -> DataFrame:
    """The rows of :func:`manifest` with folded_root, which ``leaf`` and the row's own siblings lead
    to, and whether it is the root."""
    folded = climbed(climbed(F.col(leaf), F.col("path"), F.col("pos")), F.col("source_path"), F.col("source_pos"))
    return rows.withColumn("folded_root", folded).withColumn("verified", F.col("folded_root") == F.col("root"))

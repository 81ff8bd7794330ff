"""The registered queries of this package and the SQL beside those that SQL can express."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from barline.llm import ann, exact, langid, merkle, mixing, neardup, packing, pii, quality, sentencepieces, sharding, toxicity, trie
from barline.llm.common import fold, ready, table

QUERIES = {}
ORACLES: dict[str, str] = {}


def query(fn):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return fn(ready(spark), sf_dir)
    run.__name__ = fn.__name__
    QUERIES[fn.__name__] = run
    return fn


@query
def op1_exact_dedup(spark, sf_dir):
    return exact.exact_groups(table(spark, sf_dir, "documents"))


ORACLES["op1_exact_dedup"] = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size,
       row_number() OVER (PARTITION BY coalesce(text, '') ORDER BY doc_id DESC NULLS LAST) = 1 AS kept,
       sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))"""


@query
def op2_best_fit_packing(spark, sf_dir):
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op3_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    model = langid.train(docs, fold(F.col("doc_id"), 5) != 0)
    return langid.predict(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 5) == 0).alias("held_out"), "lang_pred", "score")


@query
def op4_nearest(spark, sf_dir):
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)


@query
def op5_pii(spark, sf_dir):
    return pii.personal_data(table(spark, sf_dir, "documents"))


@query
def op6_near_dedup(spark, sf_dir):
    return neardup.near_groups(table(spark, sf_dir, "documents"))


@query
def op7_sharding(spark, sf_dir):
    return sharding.shards(table(spark, sf_dir, "documents"))


# The same rule in closed form: a document's shard is the shortest prefix of its hash whose documents
# fit or that no other document shares.
ORACLES["op7_sharding"] = f"""
WITH d AS (
  SELECT doc_id, CAST(coalesce(strlen(text), 0) AS BIGINT) AS bytes,
         lpad(bin(CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS BIGINT)),
              {sharding.BITS}, '0') AS hash
  FROM documents),
l AS (SELECT greatest(1, least({sharding.LIMIT}, CAST(ceil(sum(bytes) / {sharding.LEAST_SHARDS}e0) AS BIGINT))) AS lim FROM d),
p AS (SELECT doc_id, bytes, hash, k, substr(hash, 1, k) AS shard FROM d, unnest(range(0, {sharding.BITS} + 1)) AS u(k)),
s AS (SELECT k, shard, sum(bytes) AS shard_bytes, min(hash) = max(hash) AS alone FROM p GROUP BY ALL),
f AS (SELECT p.*, s.shard_bytes FROM p JOIN s USING (k, shard), l WHERE s.shard_bytes <= lim OR alone)
SELECT doc_id, bytes, shard, CAST(0 AS BIGINT) AS page, CAST(shard_bytes AS BIGINT) AS shard_bytes
FROM f QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY k) = 1"""


@query
def op8_toxicity(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = toxicity.train(docs, labels, fold(F.col("doc_id"), 3) != 1)
    return toxicity.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 3) == 1).alias("held_out"), "score", "predicted")


@query
def op9_quality(spark, sf_dir):
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = quality.train(docs, labels, fold(F.col("doc_id"), 4) != 2)
    return quality.score(docs, model).select(
        "doc_id", (fold(F.col("doc_id"), 4) == 2).alias("held_out"), "score", "predicted")


@query
def op10_mixing(spark, sf_dir):
    return mixing.mix_plan(table(spark, sf_dir, "documents"))


ORACLES["op10_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), '')) AS hash,
         CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rank FROM d GROUP BY source),
w AS (SELECT *, [3, 1, 2][1 + rank % 3] AS weight, [0.5e0, 0e0, -0.5e0][1 + rank % 3] AS a FROM s),
f AS (
  SELECT *, row_number() OVER fill AS place,
         ((SELECT sum(source_size) FROM w) * 1.5e0
          - 2 * coalesce(sum(source_size) OVER before, 0))
         / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0)) AS level
  FROM w WINDOW fill AS (ORDER BY CAST(source_size AS DOUBLE) / weight, rank),
                before AS (ORDER BY CAST(source_size AS DOUBLE) / weight, rank
                           ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT source, source_size, a, CASE WHEN source_size * 2 <= level * weight THEN source_size * 2e0
         ELSE (SELECT arg_min(level, place) FROM f WHERE source_size * 2 > level * weight) * weight END AS target
  FROM f),
p AS (
  SELECT d.*, source_size, target, a, CAST(floor(target) AS BIGINT) AS goal,
         CAST(sum(size) OVER (PARTITION BY d.source ORDER BY hash, size
                              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) - size AS place
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT *, greatest(least(goal - place, size), 0) AS first,
         greatest(least(goal - source_size - place, size), 0) AS second FROM p),
v AS (SELECT *, (place + first / 2e0) / goal AS q1, (source_size + place + second / 2e0) / goal AS q2 FROM u)
SELECT doc_id, size, source_size, target, first + second AS taken,
  CASE WHEN first > 0 THEN floor(2 * q1 / ((1 + a) + sqrt(greatest((1 + a) * (1 + a) - 4 * a * q1, 0e0)))
                                 * 1e9 + 0.5e0) / 1e9 END AS position,
  CASE WHEN second > 0 THEN floor(2 * q2 / ((1 + a) + sqrt(greatest((1 + a) * (1 + a) - 4 * a * q2, 0e0)))
                                  * 1e9 + 0.5e0) / 1e9 END AS position_2
FROM v"""


# crc32 of a decimal number's text in SQL: the table of the 256 bytes, then one step per character.
CRC32_TABLE = """(SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)),
  lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS crc32_of)"""


def crc32_sql(number: str) -> str:
    return f"""xor(4294967295, list_reduce(list_concat([4294967295], list_transform(
      string_split(coalesce(CAST({number} AS VARCHAR), ''), ''), lambda x: CASE WHEN x = '' THEN NULL ELSE CAST(ord(x) AS BIGINT) END)),
      lambda c, b: CASE WHEN b IS NULL THEN c ELSE xor(c // 256, crc32_of[1 + CAST(xor(c, b) % 256 AS BIGINT)]) END))"""


@query
def op11_conversation_trie(spark, sf_dir):
    return trie.conversation_trie(table(spark, sf_dir, "conversations"))


# A prefix as text: role and text of its turns, each behind its byte count, so that one prefix's text
# begins another's only if its turns do.
ORACLES["op11_conversation_trie"] = rf"""
WITH c AS {CRC32_TABLE},
t AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id
        ORDER BY turn NULLS FIRST, unhex(sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')))) AS i
      FROM conversations WHERE conv_id IS NOT NULL),
m AS (SELECT conv_id, max(i) AS n, max({crc32_sql("conv_id")} % 4) AS h FROM t, c GROUP BY conv_id),
k AS (SELECT m.*, least(m.h, coalesce(f.n, 0)) AS k FROM m LEFT JOIN m f ON f.conv_id = m.conv_id - m.conv_id % {trie.FAMILY}),
s AS (SELECT k.conv_id, i AS depth, role, text FROM k JOIN t ON t.conv_id = k.conv_id - k.conv_id % {trie.FAMILY} AND i <= k.k
      UNION ALL SELECT conv_id, i - h + k, role, text FROM k JOIN t USING (conv_id) WHERE i > h),
p AS (SELECT conv_id, depth, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
        string_agg(strlen(role) || ':' || role || strlen(text) || ':' || text, '') OVER (PARTITION BY conv_id ORDER BY depth) AS path FROM s
      UNION ALL SELECT conv_id, 0, 0, '' FROM k),
q AS (SELECT p.*, lag(path) OVER (PARTITION BY conv_id ORDER BY depth) AS above, depth = k + greatest(n - h, 0) AS ends
      FROM p JOIN k USING (conv_id)),
g AS (SELECT path, depth, min(conv_id) AS conv_id, any_value(above) AS above, count(*) AS n_convs, (count(*) - 1) * any_value(words) AS worth,
        sha256(coalesce(string_agg(conv_id, ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM q GROUP BY path, depth),
d AS (SELECT above AS path, depth - 1 AS depth, count(*) AS n_children FROM g WHERE depth > 0 GROUP BY ALL),
w AS (SELECT g.*, coalesce(n_children, 0) AS n_children FROM g LEFT JOIN d USING (path, depth)),
b AS (SELECT x.path, x.depth, CAST(sum(CASE WHEN y.n_children = 0 THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
        CAST(sum(y.worth) AS BIGINT) AS saved_tokens FROM w x JOIN w y ON starts_with(y.path, x.path) AND y.depth >= x.depth GROUP BY ALL)
SELECT w.conv_id, CAST(w.depth AS BIGINT) AS depth, u.conv_id AS parent_conv_id, w.n_convs, w.n_children, n_leaves, saved_tokens, w.ends_sha256
FROM w JOIN b USING (path, depth) LEFT JOIN w u ON u.path = w.above AND u.depth = w.depth - 1"""


@query
def op12_merkle_manifest(spark, sf_dir):
    lower = F.when(fold(F.col("doc_id"), 5) == 0, merkle.lower_ascii(F.col("text"))).otherwise(F.col("text"))
    rows = merkle.verified(merkle.manifest(table(spark, sf_dir, "documents"), changed={"text": lower}))
    proof = F.concat(F.array_join("path", ""), F.array_join("source_path", ""))
    return rows.select("doc_id", "leaf", "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", "verified")


def merkle_sql(depth: int = 6) -> str:
    """Level by level with string_agg per run of 16: up to 16 ** depth rows a source and sources."""
    enc = lambda c: f"coalesce(strlen(CAST({c} AS VARCHAR)) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(map(enc, ("doc_id", "source", "lang", "n_chars", text))) + ")"
    out = [f"""WITH c AS {CRC32_TABLE}, e AS (
  SELECT doc_id, CASE WHEN source IS NULL THEN '0' ELSE '1' || source END AS line, {leaf("text")} AS leaf,
    CASE WHEN {crc32_sql("doc_id")} % 5 = 0 THEN {leaf("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}
      END AS changed FROM documents, c),
d AS (SELECT *, row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos,
        count(*) OVER (PARTITION BY line) AS n FROM e),
a0 AS (SELECT line, pos, n, leaf AS hash FROM d)"""]
    for t, of in (("a", "b"), ("t", "u")):
        if t == "t":
            out.append("s AS (" + " UNION ALL ".join(f"SELECT line, hash FROM a{k} WHERE n = 1" for k in range(depth + 1)) + ")")
            out.append("""t0 AS (SELECT '' AS line, line AS name, row_number() OVER (ORDER BY line) - 1 AS pos,
  count(*) OVER () AS n, hash FROM s)""")
        for k in range(depth):
            out.append(f"""{of}{k} AS (SELECT line, pos // 16 AS run, n, string_agg(hash, '' ORDER BY pos) AS kin
  FROM {t}{k} WHERE n > 1 GROUP BY ALL),
{t}{k + 1} AS (SELECT line, run AS pos, (n + 15) // 16 AS n, sha256(kin) AS hash FROM {of}{k})""")
    out.append("r AS (" + " UNION ALL ".join(f"SELECT hash AS root FROM t{k} WHERE n = 1" for k in range(depth + 1)) + ")")
    out.append("""f0 AS (SELECT doc_id, line, leaf, s.hash AS subroot, root, pos, '' AS proof, coalesce(changed, leaf) AS hash
  FROM d JOIN s USING (line), r)""")
    last = "f0"
    for of in ("b", "u"):
        if of == "u":
            out.append(f"g0 AS (SELECT f.* REPLACE (t0.pos AS pos, '' AS line) FROM {last} f JOIN t0 ON f.line = t0.name)")
            last = "g0"
        for k in range(depth):
            cut = lambda x: f"left(kin, 64 * (f.pos % 16)) || {x} || substr(kin, 64 * (f.pos % 16) + 65)"
            new = f"{last[0]}{k + 1}"
            out.append(f"""{new} AS (SELECT f.* REPLACE (f.pos // 16 AS pos, coalesce(proof || {cut("''")}, proof) AS proof,
  coalesce(sha256({cut("f.hash")}), f.hash) AS hash) FROM {last} f LEFT JOIN {of}{k} x ON f.line = x.line AND f.pos // 16 = x.run)""")
            last = new
    return ",\n".join(out) + f"""
SELECT doc_id, leaf, subroot, root, sha256(proof) AS proof_sha256, hash AS folded_root, hash = root AS verified FROM {last}"""


ORACLES["op12_merkle_manifest"] = merkle_sql()


@query
def op13_sentencepiece(spark, sf_dir):
    out = sentencepieces.encoded(table(spark, sf_dir, "documents"), decode=True)
    return out.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                      F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
                      F.sha2("decoded", 256).alias("decoded_sha256"))

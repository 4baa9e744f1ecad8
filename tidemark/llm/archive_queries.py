"""Queries over whole tables as they are kept: their manifest, their vectors as codes, repeated byte strings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.manifest import merkle_manifest
from tidemark.llm.registry import query, table
from tidemark.llm.suffixes import remove_repeated_bytes
from tidemark.llm.vector_codes import ROUNDS, codebooks_digest, encode

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

_LEAF = "sha256(" + " || ".join(
    f"CASE WHEN {x} IS NULL THEN '-' ELSE strlen(CAST({x} AS VARCHAR)) || ':' || {x} END" for x in ("doc_id", "source", "lang", "n_chars", "{text}")
) + ")"

OP12_SQL = f"""
WITH RECURSIVE bits(i, k, c) AS (
  SELECT i, 0, i FROM range(256) t(i) UNION ALL SELECT i, k + 1, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END FROM bits WHERE k < 8),
crc_table AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
d AS (SELECT row_number() OVER () AS r, * FROM documents),
crcs(r, s, k, c) AS (
  SELECT r, CAST(doc_id AS VARCHAR), 0, CAST(4294967295 AS BIGINT) FROM d
  UNION ALL SELECT r, s, k + 1, xor(c >> 8, t[1 + xor(c & 255, ascii(s[k + 1]))]) FROM crcs, crc_table WHERE k < length(s)),
leaves AS (
  SELECT r, doc_id, dense_rank() OVER (ORDER BY source NULLS FIRST) - 1 AS tree, {_LEAF.format(text="text")} AS leaf,
         CASE WHEN xor(c, 4294967295) % 5 = 0 THEN {_LEAF.format(text=f"translate(text, '{UPPER}', '{LOWER}')")} END AS presented
  FROM d LEFT JOIN crcs USING (r) WHERE k IS NULL OR k = length(s)),
placed AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS idx, count(*) OVER (PARTITION BY tree) AS n FROM leaves),
nodes(lv, tree, idx, n, h) AS (
  SELECT 0, tree, idx, n, leaf FROM placed
  UNION ALL SELECT lv + 1, tree, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM nodes WHERE n > 1 GROUP BY lv, tree, idx // 16, n),
runs AS (SELECT lv, tree, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM nodes WHERE n > 1 GROUP BY ALL),
subroots AS (SELECT tree, h FROM nodes WHERE n = 1),
tops(lv, idx, n, h) AS (
  SELECT 0, tree, count(*) OVER (), h FROM subroots
  UNION ALL SELECT lv + 1, idx // 16, (n + 15) // 16, sha256(string_agg(h, '' ORDER BY idx)) FROM tops WHERE n > 1 GROUP BY lv, idx // 16, n),
top_runs AS (SELECT lv, idx // 16 AS run, list(h ORDER BY idx) AS hs FROM tops WHERE n > 1 GROUP BY ALL),
walk(r, tree, lv, idx, n, node, proof) AS (
  SELECT r, tree, 0, idx, n, coalesce(presented, leaf), '' FROM placed
  UNION ALL
  SELECT r, w.tree, w.lv + 1, idx // 16, (n + 15) // 16, sha256(array_to_string(hs[1:idx % 16], '') || node || array_to_string(hs[idx % 16 + 2:16], '')),
         proof || array_to_string(hs[1:idx % 16], '') || array_to_string(hs[idx % 16 + 2:16], '')
  FROM walk w JOIN runs u ON u.lv = w.lv AND u.tree = w.tree AND u.run = idx // 16 WHERE n > 1),
walk_up(r, lv, idx, n, node, proof) AS (
  SELECT r, 0, tree, (SELECT count(*) FROM subroots), node, proof FROM walk WHERE n = 1
  UNION ALL
  SELECT r, w.lv + 1, idx // 16, (n + 15) // 16, sha256(array_to_string(hs[1:idx % 16], '') || node || array_to_string(hs[idx % 16 + 2:16], '')),
         proof || array_to_string(hs[1:idx % 16], '') || array_to_string(hs[idx % 16 + 2:16], '')
  FROM walk_up w JOIN top_runs u ON u.lv = w.lv AND u.run = idx // 16 WHERE n > 1)
SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, node AS folded_root, node = t.h AS verified
FROM walk_up w JOIN leaves USING (r) JOIN subroots s USING (tree), tops t WHERE w.n = 1 AND t.n = 1
"""

# two hexadecimal digits a byte
OP11_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, lower(hex(encode(coalesce(text, '')))) AS t FROM documents),
p AS (SELECT r, doc_id, unnest(range(0, length(t) // 2 - 99)) AS i, t FROM d WHERE length(t) >= 200),
w AS (SELECT r, doc_id, i, md5_number(substr(t, 2 * i + 1, 200)) AS s FROM p),
early AS (SELECT s, doc_id, i, dense_rank() OVER (PARTITION BY s ORDER BY doc_id NULLS FIRST, i) > 1 AS late, r FROM w),
marked AS (SELECT r, i, lag(i) OVER (PARTITION BY r ORDER BY i) AS before FROM early WHERE late),
opened AS (SELECT r, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY r ORDER BY i) AS run FROM marked),
spans AS (SELECT r, min(i) AS a, max(i) + 100 AS b FROM opened GROUP BY r, run),
edges AS (SELECT r, list(a ORDER BY a) AS starts, list(b ORDER BY a) AS ends, CAST(sum(b - a) AS BIGINT) AS gone, count(*) AS n FROM spans GROUP BY r),
kept AS (SELECT r, doc_id, length(t) // 2 AS n_bytes, coalesce(gone, 0) AS n_removed, coalesce(n, 0) AS n_spans,
                CASE WHEN n IS NULL THEN t ELSE array_to_string(list_transform(range(1, n + 2), lambda k:
                  substr(t, 2 * (CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END) + 1,
                         2 * ((CASE WHEN k > n THEN length(t) // 2 ELSE starts[k] END) - (CASE WHEN k = 1 THEN 0 ELSE ends[k - 1] END)))), '') END AS rest
         FROM d LEFT JOIN edges USING (r))
SELECT doc_id, n_bytes, n_removed, n_spans, sha256(unhex(rest)) AS kept_sha256 FROM kept
"""


@query("op11_suffix_merge", OP11_SQL)
def suffix_merge(spark: SparkSession, folder: str) -> DataFrame:
    """All documents without the strings of 100 bytes that start earlier elsewhere."""
    return remove_repeated_bytes(table(spark, folder, "documents"), whole=False)


@query("op12_manifest", OP12_SQL)
def manifest(spark: SparkSession, folder: str) -> DataFrame:
    """The Merkle manifest of all documents; every fifth is presented with its text lower-cased."""
    docs = table(spark, folder, "documents")
    suspect = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 5 == 0
    out = merkle_manifest(
        docs, ["doc_id", "source", "lang", "n_chars", "text"], group="source", key="doc_id", suspect=suspect, altered={"text": F.translate(docs["text"], UPPER, LOWER)},
    )
    return out.drop("path", "proof")


def _op13_sql(rounds: int) -> str:
    """The rounds are written out: each assigns all distinct parts, then moves the entries."""
    steps = []
    for k in range(rounds + 1):
        steps.append(f"""
a{k} AS (SELECT part, p, w, struct_extract(min({{'d': d, 'e': e}}), 'e') AS e, min(d) AS d FROM (
  SELECT u.part, u.p, u.w, c.e, list_sum(list_transform(range(1, len(u.p) + 1), lambda i: (u.p[i] - c.p[i]) * (u.p[i] - c.p[i])))::BIGINT AS d FROM u JOIN c{k} c USING (part)) GROUP BY part, p, w)""")
        if k < rounds:
            steps.append(f"""
m{k} AS (SELECT part, e, list(v ORDER BY i) AS p FROM (
  SELECT part, e, i, CAST(floor(sum(w * p[i]) / sum(w)) AS BIGINT) AS v FROM a{k}, range(1, (SELECT len(p) FROM u LIMIT 1) + 1) t(i) GROUP BY part, e, i) GROUP BY part, e),
c{k + 1} AS (SELECT part, e, coalesce(m.p, c.p) AS p FROM c{k} c LEFT JOIN m{k} m USING (part, e))""")
    return f"""
WITH kept AS (
  SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS r, vec_id, label, list_transform(embedding, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings WHERE len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
cut AS (SELECT r, part, v[part * (len(v) // 8) + 1:(part + 1) * (len(v) // 8)] AS p FROM kept, range(8) t(part)),
u AS (SELECT part, p, count(*) AS w FROM cut GROUP BY part, p),
c0 AS (SELECT part, r AS e, p FROM cut WHERE r < 16),{",".join(steps)},
coded AS (SELECT r, string_agg(printf('%02x', e), '' ORDER BY part) AS code, CAST(sum(d) AS BIGINT) AS error FROM cut JOIN a{rounds} USING (part, p) GROUP BY r),
books AS (SELECT sha256(string_agg(array_to_string(p, ','), ',' ORDER BY part, e)) AS digest FROM c{rounds})
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, digest AS codebooks_sha256 FROM kept JOIN coded USING (r), books
"""


@query("op13_vector_codes", _op13_sql(ROUNDS))
def vector_codes(spark: SparkSession, folder: str) -> DataFrame:
    """All embeddings as codes of eight parts, with what the codes lose."""
    out, codebooks = encode(table(spark, folder, "embeddings"), "vec_id", "embedding", "label")
    code = F.array_join(F.transform("codes", lambda x: F.lower(F.lpad(F.hex(x), 2, "0"))), "")
    return out.select("vec_id", code.alias("code"), "error", "label_error", F.lit(codebooks_digest(codebooks)).alias("codebooks_sha256"))

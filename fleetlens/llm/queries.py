"""One query per text operator over the whole sample tables, with its SQL where SQL can say the same."""

import public_tokenizers
from pyspark.sql import functions as F

from fleetlens.llm import (
    block_naming,
    bpe,
    collocations,
    decontaminate,
    hard_negatives,
    language_id,
    licenses,
    mixing,
    paragraphs,
    simhash,
    suffix_dedup,
    toxicity,
    warc,
)
from fleetlens.llm.common import read_table
from fleetlens.session import run_dir

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ'"
LOWER = "'abcdefghijklmnopqrstuvwxyz'"


def op1_decontaminate(spark, sf_dir):
    """Words of each document that stand in a window of 10 words of a test item."""
    hits = decontaminate.benchmark_hits(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    n_hit = F.expr("aggregate(spans, 0L, (n, s) -> n + s.last - s.first + 1)")
    return hits.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


OP1_SQL = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), {UPPER}, {LOWER}),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS s
    FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM b WHERE len(w) > 0)),
ks AS (SELECT DISTINCT k FROM win),
pos AS (SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS s
    FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, ks WHERE len(w) >= k)),
hit AS (SELECT pos.doc_id, pos.k, pos.i, win.item_id FROM pos JOIN win ON pos.k = win.k AND pos.s = win.s),
n AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS j FROM hit) GROUP BY 1),
it AS (SELECT doc_id, count(*) AS n_items, string_agg(t, ',' ORDER BY t) AS items
    FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS t FROM hit) GROUP BY 1)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN it ON d.doc_id = it.doc_id
"""


def op2_warc(spark, sf_dir):
    """Pages written as WARC records, and what the archives say when they are read back."""
    path = run_dir(spark, "warc")
    warc.write_warc(read_table(spark, sf_dir, "pages"), path)
    records = warc.read_records(spark, path)
    return records.select(
        F.col("record_id").try_cast("long").alias("page_id"), "payload_bytes", "payload_digest", "record_type",
        F.col("refers_to").try_cast("long").alias("refers_to"), "intact",
    )


OP2_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS keep FROM p WHERE strlen(h) >= 1000 GROUP BY h)
SELECT page_id, strlen(p.h) AS payload_bytes, sha1(p.h) AS payload_digest,
  CASE WHEN page_id <> keep THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> keep THEN keep END AS refers_to, true AS intact
FROM p LEFT JOIN g ON p.h = g.h
"""


def op3_language_id(spark, sf_dir):
    """Language of each document."""
    return language_id.identify_languages(read_table(spark, sf_dir, "documents"))


def op4_paragraph_minhash(spark, sf_dir):
    """Paragraphs of each document that stand elsewhere too, lines of any length."""
    return paragraphs.repeated_paragraphs(read_table(spark, sf_dir, "documents"), min_words=1)


def op5_toxicity_chain(spark, sf_dir):
    """Probability of each category for each document."""
    return toxicity.toxicity(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))


def op6_suffix_dedup(spark, sf_dir):
    """Bytes of each document that stand in a string of 200 bytes found elsewhere too."""
    return suffix_dedup.dedup_substrings(read_table(spark, sf_dir, "documents"))


def op7_mix_sources(spark, sf_dir):
    """How much of each document the mix takes."""
    return mixing.mix_sources(read_table(spark, sf_dir, "documents"))


def op8_simhash(spark, sf_dir):
    """Fingerprint and component of each document."""
    return simhash.simhash_groups(read_table(spark, sf_dir, "documents"))


def op9_block_naming(spark, sf_dir):
    """Which copy of each text stays."""
    return block_naming.exact_dedup(read_table(spark, sf_dir, "documents"))


OP9_SQL = f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), {UPPER}, {LOWER}) AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(d.t) AS text_sha256 FROM d JOIN g ON d.t = g.t
"""

def op10_licenses(spark, sf_dir):
    """License labels of each document."""
    return licenses.scan_licenses(read_table(spark, sf_dir, "documents")).drop("detections")



def op11_hard_negatives(spark, sf_dir):
    """Hard negatives of each positive of every hundredth vector."""
    rows = read_table(spark, sf_dir, "embeddings")
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives.mine_hard_negatives(rows.withColumn("label", label), F.col("vec_id") % 100 == 0)


OP11_SQL = """
WITH v AS (SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    [floor(256 * CAST(x AS DOUBLE)) FOR x IN embedding] AS q
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0),
s AS (SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same,
    CAST(list_inner_product(a.q, b.q) AS BIGINT) AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND b.vec_id <> a.vec_id),
p AS (SELECT anchor_id, other_id AS positive_id, score AS positive_score, CAST(row_number() OVER
    (PARTITION BY anchor_id ORDER BY score DESC, other_id) AS INTEGER) AS positive_rank FROM s WHERE same QUALIFY positive_rank <= 5)
SELECT anchor_id, positive_id, CAST(row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)
    AS INTEGER) AS rank, other_id AS negative_id, positive_score, score AS negative_score, positive_rank
FROM p JOIN s USING (anchor_id) WHERE NOT same AND 100 * score BETWEEN 30 * positive_score AND 90 * positive_score
QUALIFY rank <= 10
"""


def op12_collocations(spark, sf_dir):
    """Phrases of two and three words of each language whose words come together."""
    return collocations.collocations(read_table(spark, sf_dir, "documents"))


OP12_SQL = rf"""
WITH t AS (SELECT doc_id, coalesce(lang, 'und') AS lang, regexp_split_to_array(translate(coalesce(text, ''), {UPPER}, {LOWER}),
    '[.,;:!?\x0A-\x0D]') AS ps FROM documents),
pc AS (SELECT lang, regexp_extract_all(p, '[^\x20\x09]+') AS w FROM (SELECT lang, unnest(ps) AS p FROM t)),
places AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM pc),
f AS (SELECT lang, m, s, count(*) AS n FROM (SELECT lang, m, array_to_string(w[i : i + m - 1], ' ') AS s
    FROM places, (VALUES (1), (2), (3)) AS sizes (m) WHERE i + m - 1 <= len(w)) GROUP BY ALL),
c AS (SELECT lang, m, s, n AS a, string_split(s, ' ') AS w FROM f WHERE m > 1 AND n >= 10),
cut AS (SELECT c.lang, c.m, c.s, a, k, x.n AS l, y.n AS r,
    (1000000::HUGEINT * a * a) // (x.n::HUGEINT * y.n) AS score
  FROM (SELECT *, unnest(range(1, m)) AS k FROM c) c
  JOIN f x ON x.lang = c.lang AND x.m = k AND x.s = array_to_string(w[1 : k], ' ')
  JOIN f y ON y.lang = c.lang AND y.m = c.m - k AND y.s = array_to_string(w[k + 1 : c.m], ' ')),
best AS (SELECT * FROM cut QUALIFY row_number() OVER (PARTITION BY lang, s ORDER BY score, k) = 1),
gone AS (SELECT DISTINCT b.lang, b.s FROM c JOIN c b ON b.lang = c.lang AND c.m = 3 AND b.m = 2
    AND b.s IN (array_to_string(c.w[1 : 2], ' '), array_to_string(c.w[2 : 3], ' ')) AND 100 * c.a >= 50 * b.a),
total AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM pc GROUP BY lang)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, s) AS rank, s AS phrase, a, l, r, total.n AS n,
  CAST(score AS BIGINT) AS score, CAST(m AS INTEGER) AS words, CAST(k AS INTEGER) AS cut
FROM best JOIN total USING (lang) WHERE NOT EXISTS (SELECT 1 FROM gone WHERE gone.lang = best.lang AND gone.s = best.s)
QUALIFY rank <= 2000
"""


def op13_bpe(spark, sf_dir):
    """Token ids of each document, and what they decode to."""
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    docs = read_table(spark, sf_dir, "documents")
    rows = bpe.encode(docs, path, public_tokenizers.PATTERN, with_offsets=False).select(
        "doc_id", "ids", F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
    )
    rows = bpe.decode(rows, path, keep=("n_tokens", "ids_sha256"), with_text=False)
    return rows.select("doc_id", "n_tokens", "ids_sha256", F.sha2("data", 256).alias("decoded_sha256"))


#: name -> (query, SQL or None)
CASES = {
    "op1_decontaminate": (op1_decontaminate, OP1_SQL),
    "op2_warc": (op2_warc, OP2_SQL),
    "op3_language_id": (op3_language_id, None),
    "op4_paragraph_minhash": (op4_paragraph_minhash, None),
    "op5_toxicity_chain": (op5_toxicity_chain, None),
    "op6_suffix_dedup": (op6_suffix_dedup, None),
    "op7_mix_sources": (op7_mix_sources, None),
    "op8_simhash": (op8_simhash, None),
    "op9_block_naming": (op9_block_naming, OP9_SQL),
    "op10_licenses": (op10_licenses, None),
    "op11_hard_negatives": (op11_hard_negatives, OP11_SQL),
    "op12_collocations": (op12_collocations, OP12_SQL),
    "op13_bpe": (op13_bpe, None),
}

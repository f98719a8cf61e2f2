"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelog.llm import audit, bpe, exact, jaccard, language, lines, nearest, packing, quality, substring, suffixes, toxicity, turns

CAPACITY = 2048


def vocabulary(name: str) -> str:
    """Path of a public vocabulary file, installed on every machine."""
    import public_tokenizers

    return public_tokenizers.path(name)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = vocabulary("byte_bpe_50k.tiktoken")
    encoded = bpe.encode_documents(documents(spark, sf_dir).select("doc_id", "text"), path, public_tokenizers.PATTERN).drop("text")
    decoded = bpe.decode_documents(encoded, path)
    digits = F.array_join(F.transform("ids", lambda i: i.cast("string")), " ")
    return decoded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(digits, 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def packed(docs: DataFrame) -> DataFrame:
    rows = packing.pieces(docs, vocabulary("byte_bpe_50k.json"), CAPACITY)
    narrow = rows.select("doc_id", "piece", "start", "length", F.crc32("ids").alias("ids_crc32"))
    return packing.pack(narrow, CAPACITY, ["doc_id", "piece"])


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(documents(spark, sf_dir))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = quality.classify(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))
    return found.select("doc_id", "held_out", "score", "predicted")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = toxicity.classify(documents(spark, sf_dir).select("doc_id", "text"), labels(spark, sf_dir))
    return found.select("doc_id", "held_out", "score", "predicted")


def op5_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = substring.deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    spans = F.array_join(F.transform("removed", lambda s: F.concat_ws("+", s.start.cast("string"), s.length.cast("string"))), ",")
    keep = F.array_join(F.transform("removed", lambda s: s.keep_id.cast("string")), ",")
    return found.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), spans.alias("removed_spans"), keep.alias("keep_ids"))


def op6_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.deduplicate(documents(spark, sf_dir))


OP6_SQL = """
WITH normal AS (
  SELECT doc_id, length(coalesce(text, '')) AS points,
    regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g') AS norm FROM documents
)
SELECT doc_id, first_value(doc_id) OVER best AS keep_id, count(*) OVER (PARTITION BY norm) AS group_size,
  row_number() OVER best = 1 AS kept, sha256(norm) AS text_sha256
FROM normal WINDOW best AS (PARTITION BY norm ORDER BY points DESC, doc_id)
"""


def op7_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


OP7_SQL = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON q.vec_id <> c.vec_id WHERE q.vec_id % 50 = 0
),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM scored)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM ranked WHERE rank <= 5
"""


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lines.deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    places = F.array_join(F.transform("removed", lambda i: i.cast("string")), ",")
    return found.select("doc_id", "text", F.size("removed").cast("long").alias("n_removed"), places.alias("removed_lines"))


# A line goes if any run of three lines over it starts at a later place than an equal run.
OP8_SQL = """
WITH units AS (
  SELECT doc_id, i - 1 AS pos, trim(string_split(text, chr(10))[i], ' ' || chr(9) || chr(13) || chr(11) || chr(12)) AS line
  FROM documents, unnest(range(1, len(string_split(text, chr(10))) + 1)) AS u(i)
),
runs AS (
  SELECT doc_id, pos, [line, lead(line, 1) OVER d, lead(line, 2) OVER d] AS run, lead(pos, 2) OVER d AS last
  FROM units WINDOW d AS (PARTITION BY doc_id ORDER BY pos)
),
later AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, row_number() OVER (PARTITION BY run ORDER BY doc_id, pos) AS k FROM runs WHERE last IS NOT NULL)
  WHERE k > 1
),
gone AS (SELECT DISTINCT doc_id, pos + k AS pos FROM later, range(0, 3) AS r(k)),
per_doc AS (
  SELECT doc_id, count(*) AS n, list(pos) AS places, string_agg(CAST(pos AS VARCHAR), ',' ORDER BY pos) AS removed FROM gone GROUP BY doc_id
)
SELECT d.doc_id,
  CASE WHEN g.n IS NULL THEN d.text ELSE
    array_to_string(list_filter(string_split(d.text, chr(10)), lambda x, i: NOT list_contains(g.places, i - 1)), chr(10)) END AS text,
  coalesce(g.n, 0) AS n_removed, coalesce(g.removed, '') AS removed_lines
FROM documents d LEFT JOIN per_doc g USING (doc_id)
"""


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = language.identify(documents(spark, sf_dir).select("doc_id", "text", "lang"))
    return found.select("doc_id", "held_out", "lang_pred", "score")


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.join(documents(spark, sf_dir).select("doc_id", "text"))


def op11_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffixes.deduplicate(documents(spark, sf_dir).select("doc_id", "text"))
    removed = F.aggregate("removed", F.lit(0).cast("long"), lambda n, s: n + s.length)
    return found.select("doc_id", "n_bytes", removed.alias("n_removed"), F.size("removed").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"))


# Bytes as pairs of hexadecimal digits; a string of 50 bytes is 100 digits.
OP11_SQL = """
WITH docs AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
strings AS (SELECT doc_id, i, substring(h, 2 * i + 1, 100) AS s FROM docs, unnest(range(0, len(h) // 2 - 49)) AS u(i)),
firsts AS (SELECT s, min(doc_id) AS first FROM strings GROUP BY s HAVING min(doc_id) < max(doc_id)),
marks AS (SELECT doc_id, i FROM strings JOIN firsts USING (s) WHERE first < doc_id),
runs AS (
  SELECT doc_id, i, sum(new) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM (
    SELECT doc_id, i, CASE WHEN i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= 50 THEN 0 ELSE 1 END AS new FROM marks)
),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS b FROM runs GROUP BY doc_id, run),
gaps AS (
  SELECT doc_id, b AS a, lead(a) OVER (PARTITION BY doc_id ORDER BY a) AS b FROM spans
  UNION ALL SELECT doc_id, 0 AS a, min(a) AS b FROM spans GROUP BY doc_id
),
kept AS (
  SELECT doc_id, string_agg(substring(h, 2 * a + 1, 2 * (coalesce(b, len(h) // 2) - a)), '' ORDER BY a) AS k
  FROM gaps JOIN docs USING (doc_id) GROUP BY doc_id
),
sums AS (SELECT doc_id, sum(b - a) AS n, count(*) AS k FROM spans GROUP BY doc_id)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, CAST(coalesce(s.k, 0) AS BIGINT) AS n_spans,
  sha256(unhex(coalesce(t.k, h))) AS kept_sha256
FROM docs d LEFT JOIN sums s USING (doc_id) LEFT JOIN kept t USING (doc_id)
"""


def op12_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.interactions(audit.failures(documents(spark, sf_dir), "lang"), labels(spark, sf_dir))


OP12_SQL = """
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS text,
    list_filter(string_split_regex(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda w: w <> '') AS words FROM documents
),
firsts AS (SELECT text, min(doc_id) AS first FROM docs GROUP BY text),
known AS (SELECT doc_id, max(CAST(quality = 1 AS INTEGER)) AS good, max(CAST(toxic = 1 AS INTEGER)) AS bad FROM labels GROUP BY doc_id),
flags AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(bad, 0) AS bad,
    CASE WHEN len(words) < 100 THEN 'A' ELSE '' END ||
    CASE WHEN 100 * len(list_distinct(words)) < 80 * len(words) THEN 'B' ELSE '' END ||
    CASE WHEN 100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text) THEN 'C' ELSE '' END ||
    CASE WHEN regexp_matches(text, '[#$%&*|]') THEN 'D' ELSE '' END ||
    CASE WHEN docs.doc_id > first THEN 'E' ELSE '' END AS fails
  FROM docs JOIN firsts USING (text) LEFT JOIN known USING (doc_id)
),
cells AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(bad) AS bad FROM flags GROUP BY ALL),
orders AS (
  SELECT '' AS o UNION ALL SELECT o || f FROM orders, unnest(['A', 'B', 'C', 'D', 'E']) AS t(f) WHERE NOT contains(o, f)
),
steps AS (SELECT o AS filter_order, CAST(k AS INTEGER) AS step, o[k:k] AS f, o[1:k - 1] AS before FROM orders, range(1, 6) AS r(k) WHERE length(o) = 5),
hits AS (
  SELECT part, filter_order, step, f, fails, n, good, bad,
    contains(fails, f) AS fit, regexp_matches(fails, '[' || before || '_]') AS gone FROM cells, steps
),
counted AS (
  SELECT part, filter_order, step, any_value(f) AS f,
    coalesce(sum(n) FILTER (NOT fit AND NOT gone), 0) AS kept, coalesce(sum(n) FILTER (fit AND NOT gone), 0) AS removed,
    coalesce(sum(n) FILTER (fit AND gone), 0) AS redundant, coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(good) FILTER (fit AND NOT gone), 0) AS good_lost, coalesce(sum(bad) FILTER (fit AND NOT gone), 0) AS toxic_lost
  FROM hits GROUP BY part, filter_order, step
)
SELECT part, filter_order, step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
  CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
  CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM counted
"""


def op13_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return turns.prefix_trie(*turns.rebuilt(spark.read.parquet(f"{sf_dir}/conversations.parquet")))


# DuckDB has no CRC-32; it is computed bit by bit.
OP13_SQL = """
WITH turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) - 1 AS i,
    {'role': coalesce(role, ''), 'text': coalesce(text, '')} AS item
  FROM conversations WHERE conv_id IS NOT NULL
),
originals AS (SELECT conv_id, list(item ORDER BY i) AS items FROM turns GROUP BY conv_id),
sums AS (
  SELECT conv_id, xor(list_reduce([4294967295] || list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ord(x) AS BIGINT)),
    lambda c, x: list_reduce([xor(c, x)] || range(1, 9), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a // 2, 3988292384) ELSE a // 2 END)), 4294967295) % 9 AS h
  FROM originals
),
built AS (
  SELECT o.conv_id, list_concat(coalesce(b.items[1:h], []), o.items[h + 1:]) AS items
  FROM originals o JOIN sums USING (conv_id) LEFT JOIN originals b ON b.conv_id = o.conv_id - o.conv_id % 5
),
paths AS (SELECT conv_id, d AS depth, items[1:d] AS prefix, len(items) = d AS ends FROM built, unnest(range(0, len(items) + 1)) AS r(d)),
nodes AS (
  SELECT prefix, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
    sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256,
    CASE WHEN depth = 0 THEN 0 ELSE (count(*) - 1) * strlen(prefix[depth].text) END AS saved
  FROM paths GROUP BY prefix, depth
),
kids AS (SELECT prefix[1:depth - 1] AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY 1),
subtrees AS (
  SELECT u.prefix[1:d] AS prefix, sum(CASE WHEN k.n IS NULL THEN 1 ELSE 0 END) AS n_leaves, sum(u.saved) AS saved_tokens
  FROM nodes u LEFT JOIN kids k USING (prefix), unnest(range(0, u.depth + 1)) AS r(d) GROUP BY 1
)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n, 0) AS n_children,
  CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, n.ends_sha256
FROM nodes n JOIN subtrees s USING (prefix) LEFT JOIN kids k USING (prefix)
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = n.prefix[1:n.depth - 1]
"""


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


QUERIES = {f.__name__: f for f in (op1_bpe, op2_packing, op3_quality, op4_toxicity, op5_substring_dedup, op6_exact_dedup, op7_topk, op8_line_dedup, op9_language, op10_jaccard_join, op11_suffix_dedup, op12_filter_audit, op13_prefix_trie, pipeline)}
ORACLE = {"op6_exact_dedup": OP6_SQL, "op7_topk": OP7_SQL, "op8_line_dedup": OP8_SQL, "op11_suffix_dedup": OP11_SQL, "op12_filter_audit": OP12_SQL, "op13_prefix_trie": OP13_SQL}

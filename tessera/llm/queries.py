"""The registered queries of this subpackage and their SQL twins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm import bpe, token_store
from tessera.llm.decontaminate import contamination
from tessera.llm.exact_dedup import exact_groups
from tessera.llm.jaccard_join import similar_components
from tessera.llm.langid import languages
from tessera.llm.line_dedup import dedup_lines
from tessera.llm.merkle import verified_manifest
from tessera.llm.quality import quality_scores
from tessera.llm.ranked_search import ranked_documents
from tessera.llm.secret_scan import scan
from tessera.llm.setsketch import near_components
from tessera.llm.shared import new_path
from tessera.llm.suffix_dedup import remove_repeats

#: Where the public tokenizers' files are; a parameter of the two operators.
TOKENIZERS = "/opt/tokenizers"


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op2_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = new_path(spark, "token-store")
    token_store.write_store(_table(spark, sf_dir, "documents"), path, f"{TOKENIZERS}/word_bpe_49k.json", end_id=1)
    return token_store.checksums(spark, path)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(_table(spark, sf_dir, "documents"))


def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings carry a digest of the candidate, never the candidate."""
    found = scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "word", "place", F.sha2("candidate", 256).alias("candidate_sha256"), "score", "is_secret", "held_out")


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = remove_repeats(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op8_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return languages(_table(spark, sf_dir, "documents"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_groups(_table(spark, sf_dir, "documents"))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = f"{TOKENIZERS}/byte_bpe_50k.json"
    coded = bpe.decode(bpe.encode(_table(spark, sf_dir, "documents"), path), path)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op11_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_documents(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verified_manifest(_table(spark, sf_dir, "documents"))


def op13_setsketch(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_components(_table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_decontamination, op2_token_store, op3_line_dedup, op4_jaccard_join, op5_secret_scan, op6_suffix_dedup, op7_quality, op8_language, op9_exact_dedup, op10_bpe, op11_ranked_search, op12_merkle_manifest, op13_setsketch)}

OP1_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
items AS (
  SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS k, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT k FROM windows),
grams AS (
  SELECT doc_id, k, i, array_to_string(w[i : i + k - 1], ' ') AS words
  FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, sizes WHERE len(w) >= k)),
occ AS (SELECT g.doc_id, g.i, g.k, n.item_id FROM grams g JOIN windows n USING (k, words)),
hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM occ)) GROUP BY 1),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM occ) GROUP BY 1)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM words LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

OP3_SQL = r"""
WITH lines AS (
  SELECT doc_id, i, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents)),
frequent AS (SELECT key, max(doc_id) AS keeper FROM lines WHERE length(key) >= 20 GROUP BY 1 HAVING count(DISTINCT doc_id) >= 3),
marked AS (SELECT doc_id, i, line, keeper IS NOT NULL AND keeper <> doc_id AS gone FROM lines LEFT JOIN frequent USING (key))
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""

OP4_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
shingles AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY 1),
shared AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE 100 * k >= 80 * (a.n + b.n - k)),
edges AS (SELECT x AS u, y AS v FROM links UNION ALL SELECT y, x FROM links),
reach(node, label) AS (SELECT u, u FROM edges UNION SELECT e.v, r.label FROM reach r JOIN edges e ON e.u = r.node WHERE r.label < e.v),
labels AS (SELECT node, min(label) AS label FROM reach GROUP BY 1)
SELECT d.doc_id, coalesce(n, 0) AS n_shingles, coalesce(label, d.doc_id) AS component_id FROM documents d LEFT JOIN sizes USING (doc_id) LEFT JOIN labels ON node = d.doc_id
"""

OP13_SQL = OP4_SQL.replace("w[i : i + 4]", "w[i : i + 3]").replace("greatest(len(w) - 4, 1)", "greatest(len(w) - 3, 1)").replace(
    "coalesce(label, d.doc_id) AS component_id", "coalesce(label, d.doc_id) AS component_id, coalesce(label, d.doc_id) = d.doc_id AS kept"
)

OP6_SQL = """
WITH bytes AS (SELECT doc_id, encode(coalesce(text, '')) AS x FROM documents),
windows AS (SELECT doc_id, i, hash(x[i : i + 399]) AS h FROM (SELECT doc_id, x, unnest(range(1, octet_length(x) - 398)) AS i FROM bytes WHERE octet_length(x) >= 400)),
twice AS (SELECT h FROM windows GROUP BY 1 HAVING count(*) > 1),
hit AS (SELECT doc_id, i, CASE WHEN i - lag(i) OVER w <= 400 THEN 0 ELSE 1 END AS opens FROM windows SEMI JOIN twice USING (h) WINDOW w AS (PARTITION BY doc_id ORDER BY i)),
spans AS (SELECT doc_id, min(i) AS a, max(i) + 399 AS b FROM (SELECT doc_id, i, sum(opens) OVER (PARTITION BY doc_id ORDER BY i) AS g FROM hit) GROUP BY doc_id, g),
pieces AS (
  SELECT doc_id, lag(b, 1, 0) OVER (PARTITION BY doc_id ORDER BY a) + 1 AS f, a - 1 AS t FROM spans
  UNION ALL SELECT doc_id, coalesce(max(b), 0) + 1, 2147483647 FROM bytes LEFT JOIN spans USING (doc_id) GROUP BY doc_id),
kept AS (SELECT doc_id, string_agg(hex(x[f : t]), '' ORDER BY f) AS k FROM pieces JOIN bytes USING (doc_id) WHERE f <= t AND f <= octet_length(x) GROUP BY 1),
sums AS (SELECT doc_id, sum(b - a + 1) AS n, count(*) AS c FROM spans GROUP BY 1)
SELECT doc_id, octet_length(x) AS n_bytes, CAST(coalesce(n, 0) AS BIGINT) AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(k, ''))) AS kept_sha256
FROM bytes LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

OP9_SQL = """
SELECT doc_id, max(doc_id) OVER same AS keep_id, count(*) OVER same AS group_size, doc_id = max(doc_id) OVER same AS kept, sha256(coalesce(text, '')) AS text_sha256
FROM documents WINDOW same AS (PARTITION BY coalesce(text, ''))
"""

OP11_SQL = r"""
WITH words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
sizes AS (SELECT count(*) AS n_docs, sum(len(w)) AS n_terms FROM words WHERE len(w) > 0),
asked AS (
  SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS term FROM benchmark)
  GROUP BY 1, 2),
postings AS (
  SELECT doc_id, n, term, count(*) AS tf FROM (SELECT doc_id, len(w) AS n, unnest(w) AS term FROM words) SEMI JOIN asked USING (term) GROUP BY 1, 2, 3),
weights AS (SELECT term, CAST(floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1))) AS BIGINT) AS weight FROM postings, sizes GROUP BY term, n_docs),
scores AS (
  SELECT item_id, doc_id, CAST(sum(times * weight * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
  FROM asked JOIN postings USING (term) JOIN weights USING (term), sizes GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM scores WHERE score > 0
WINDOW w AS (PARTITION BY item_id ORDER BY score DESC, doc_id) QUALIFY rank <= 20
"""


def _field(x: str) -> str:
    return f"CASE WHEN {x} IS NULL THEN '-' ELSE octet_length(encode(CAST({x} AS VARCHAR))) || ':' || {x} END"


_HEAD = " || ".join(_field(c) for c in ("doc_id", "source", "lang", "n_chars"))
OP12_SQL = f"""
WITH RECURSIVE leaves AS (
  SELECT doc_id, coalesce('=' || lang, '') AS g, sha256({_HEAD} || {_field("text")}) AS leaf,
    sha256({_HEAD} || {_field("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")}) AS lower_leaf FROM documents),
placed AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i, count(*) OVER (PARTITION BY g) AS n FROM leaves),
tree(g, level, i, n, digest) AS (
  SELECT g, 0, i, n, leaf FROM placed
  UNION ALL SELECT g, level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, level, n, i // 8),
subroots AS (SELECT g, digest AS subroot, row_number() OVER (ORDER BY encode(g)) - 1 AS i, count(*) OVER () AS n FROM tree WHERE n = 1),
upper(level, i, n, digest) AS (
  SELECT 0, i, n, subroot FROM subroots
  UNION ALL SELECT level + 1, i // 8, (n + 7) // 8, sha256(string_agg(digest, '' ORDER BY i)) FROM upper WHERE n > 1 GROUP BY level, n, i // 8),
sides AS (
  SELECT kind, g, level, i, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS before, coalesce(string_agg(digest, '') OVER (w ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS after
  FROM (SELECT 0 AS kind, g, level, i, n, digest FROM tree UNION ALL SELECT 1, '', level, i, n, digest FROM upper) WHERE n > 1 WINDOW w AS (PARTITION BY kind, g, level, i // 8 ORDER BY i)),
steps AS (
  SELECT g, i, row_number() OVER (PARTITION BY g, i ORDER BY kind, level) AS k, before, after FROM (
    SELECT p.g, p.i, kind, level, before, after FROM placed p JOIN sides s ON kind = 0 AND s.g = p.g AND s.i = p.i >> (3 * level)
    UNION ALL SELECT p.g, p.i, kind, level, before, after FROM placed p JOIN subroots r ON r.g = p.g JOIN sides s ON kind = 1 AND s.i = r.i >> (3 * level))),
proofs AS (SELECT g, i, sha256(string_agg(before || after, '' ORDER BY k)) AS proof_sha256 FROM steps GROUP BY g, i),
crc AS (SELECT c, CAST(c AS BIGINT) AS x, 0 AS k FROM range(256) t(c) UNION ALL SELECT c, CASE WHEN x % 2 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END, k + 1 FROM crc WHERE k < 8),
sums(doc_id, x, k) AS (
  SELECT DISTINCT doc_id, 4294967295, 0 FROM documents WHERE doc_id IS NOT NULL
  UNION ALL SELECT s.doc_id, xor(s.x >> 8, crc.x), s.k + 1 FROM sums s JOIN crc ON crc.k = 8 AND c = xor(s.x & 255, ascii(substr(CAST(doc_id AS VARCHAR), s.k + 1, 1))) WHERE s.k < length(CAST(doc_id AS VARCHAR))),
chosen AS (SELECT doc_id FROM sums WHERE k = length(CAST(doc_id AS VARCHAR)) AND xor(x, 4294967295) % 3 = 0),
fold(g, i, k, digest) AS (
  SELECT g, i, 0, CASE WHEN c.doc_id IS NULL THEN leaf ELSE lower_leaf END FROM placed p LEFT JOIN chosen c ON c.doc_id = p.doc_id
  UNION ALL SELECT f.g, f.i, f.k + 1, sha256(before || digest || after) FROM fold f JOIN steps s ON s.g = f.g AND s.i = f.i AND s.k = f.k + 1),
ends AS (SELECT g, i, arg_max(digest, k) AS folded_root FROM fold GROUP BY g, i)
SELECT doc_id, leaf, subroot, u.digest AS root, coalesce(proof_sha256, sha256('')) AS proof_sha256, folded_root, folded_root = u.digest AS verified
FROM placed p JOIN subroots r USING (g) JOIN upper u ON u.n = 1 LEFT JOIN proofs q ON q.g = p.g AND q.i = p.i JOIN ends e ON e.g = p.g AND e.i = p.i
"""

ORACLE_SQL = {"op1_decontamination": OP1_SQL, "op3_line_dedup": OP3_SQL, "op4_jaccard_join": OP4_SQL, "op6_suffix_dedup": OP6_SQL, "op9_exact_dedup": OP9_SQL, "op11_ranked_search": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_setsketch": OP13_SQL}

"""The thirteen operators and the pipeline as queries over whole tables, and their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import centroids, decontaminate, idfile, jaccard, lines, mixing, packing, pii, quality, secrets, spelling, urls, warc
from .common import table


def vocabulary(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_token_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Start, count and CRC of every document's ids, read back from id files. Null text is empty; rows with tied or null ids get a row each, null ids first."""
    return idfile.read_shards(idfile.write_shards(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json")))


def op2_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and all spans of personal data of every document. Null text is empty; one row out for each row in."""
    return pii.digest(table(spark, sf_dir, "documents"))


def op3_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and the verdict of the quality rules for every document. Null text has no words and is not kept."""
    return quality.quality(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of every document, those dropped, and the digest of what stays. Null text is one empty line; rows with a null id pass unchanged."""
    return lines.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op5_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base counts and all spans of secrets of every document. Null text is empty; a text that many rows hold is scanned once and answered for each."""
    return secrets.digest(table(spark, sf_dir, "documents"))


def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Host, path, rule and verdict of every page. A null URL, or one without a scheme, has neither host nor path; the trees judge it."""
    return urls.judge(table(spark, sf_dir, "pages").select("page_id", "url")).drop("url")


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page written as a WARC record and read back. Null html is an empty payload; repeated rows get a record each."""
    return warc.read_archives(warc.write_archives(table(spark, sf_dir, "pages")))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pieces of every document in sequences of at most 2048 tokens. Null text is the end id alone."""
    return packing.digest(packing.pack(table(spark, sf_dir, "documents"), vocabulary("byte_bpe_50k.json")))


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside benchmark passages, and the items they come from. Null text has no words."""
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shingles and component of every document. Texts that are null or have no words are their own component."""
    return jaccard.near_duplicates(table(spark, sf_dir, "documents")).drop("cls")


def op11_centroids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cluster and squared distance of every whole vector, and the facts of its cluster. Vectors with a null or infinite component are left out."""
    return centroids.cluster(table(spark, sf_dir, "embeddings"))


def op12_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word that occurs twice or more, its near words and its commoner form. Null text has no words."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words that the mix takes of every document, and where it is met first. Null text has no words and is not taken."""
    return mixing.digest(*mixing.mix(table(spark, sf_dir, "documents")))


QUERIES = {f.__name__: f for f in (op1_token_ids, op2_pii, op3_quality, op4_line_dedup, op5_secrets, op6_url_filter, op7_warc, op8_packing, op9_decontamination, op10_ngram_jaccard, op11_centroids, op12_spelling, op13_mixing)}

_STOP = "[" + ", ".join(f"'{w}'" for w in quality.STOP_WORDS) + "]"

_D2 = "list_sum(list_transform(range(1, 65), lambda i: (v.v[i] - c.c[i]) * (v.v[i] - c.c[i])))"


def _kmeans() -> str:
    out = ["""v AS MATERIALIZED (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)""", "c0 AS MATERIALIZED (SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id)) - 1 AS k, v AS c FROM v ORDER BY sha256('1:' || vec_id) LIMIT 16)"]  # fmt: skip
    for r in range(4):
        out.append(f"a{r} AS MATERIALIZED (SELECT vec_id, v, k, d FROM (SELECT vec_id, v, k, {_D2} AS d, row_number() OVER (PARTITION BY vec_id ORDER BY {_D2}, k) AS nth FROM v, c{r} c) WHERE nth = 1)")
        out.append(f"m{r} AS (SELECT k, i, CAST(floor(sum(v[i]) / count(*)) AS BIGINT) AS x FROM a{r}, (SELECT unnest(range(1, 65)) AS i) GROUP BY k, i)")
        out.append(f"c{r + 1} AS MATERIALIZED (SELECT c.k, coalesce(n.c, c.c) AS c FROM c{r} c LEFT JOIN (SELECT k, list(x ORDER BY i) AS c FROM m{r} GROUP BY k) n USING (k))")
    return "WITH " + ", ".join(out[:-2]) + """ SELECT vec_id, CAST(k AS INTEGER) AS cluster, CAST(d AS BIGINT) AS distance, CAST(sum(d) OVER (PARTITION BY k) AS BIGINT) AS cluster_inertia, CAST(sum(d) OVER () AS BIGINT) AS inertia,
sha256(array_to_string(c.c, ',')) AS centroid_sha256 FROM a3 JOIN c3 c USING (k)"""


_KMEANS = _kmeans()
#: crc32 by a table of 256, over the bytes of the text in hexadecimal.
_SPELLING = """WITH RECURSIVE b AS (SELECT i AS byte, CAST(i AS BIGINT) AS c, 0 AS step FROM range(256) t(i) UNION ALL SELECT byte, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, step + 1 FROM b WHERE step < 8),
t AS MATERIALIZED (SELECT list(c ORDER BY byte) AS t FROM b WHERE step = 8),
r AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\u00C0-\u00FF]{7,}')) AS run FROM documents),
x AS (SELECT run, hex(encode(doc_id || ':' || run)) AS x FROM r),
h AS (SELECT run, xor(list_reduce(list_transform(range(1, len(x), 2), lambda i: CAST(('0x' || substr(x, i, 2)) AS BIGINT)), lambda c, y: xor(c // 256, t[xor(c % 256, y) + 1]), CAST(4294967295 AS BIGINT)), 4294967295) AS h FROM x, t),
w AS (SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word FROM h),
v AS MATERIALIZED (SELECT word, count(*) AS n FROM w WHERE length(word) >= 7 GROUP BY word HAVING count(*) >= 2),
d AS MATERIALIZED (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS less FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM v)),
p AS MATERIALIZED (SELECT a.word, b.word AS other, b.n AS other_n FROM d a JOIN d b ON a.i = b.i AND a.less = b.less AND a.word <> b.word UNION SELECT d.word, v.word, v.n FROM d JOIN v ON v.word = d.less UNION SELECT v.word, d.word, d.n FROM d JOIN v ON v.word = d.less),
f AS MATERIALIZED (SELECT v.word, v.n, m.n_near, CASE WHEN m.best.n >= 10 * v.n THEN m.best.other END AS form, CASE WHEN m.best.n >= 10 * v.n THEN m.best.n END AS form_n FROM v LEFT JOIN (SELECT word, count(*) AS n_near, max_by({'n': other_n, 'other': other}, other_n ORDER BY other) AS best FROM p GROUP BY word) m USING (word)),
g(word, root) AS (SELECT word, word FROM f UNION ALL SELECT g.word, f.form FROM g JOIN f ON f.word = g.root WHERE f.form IS NOT NULL)
SELECT f.word, f.form, g.root, f.n, CAST(coalesce(f.n_near, 0) AS BIGINT) AS n_near, CAST(f.form_n AS BIGINT) AS form_n FROM f JOIN g USING (word) JOIN f z ON z.word = g.root WHERE z.form IS NULL"""
_MIXING = """WITH RECURSIVE d AS MATERIALIZED (SELECT doc_id, source, CAST(len(list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')) AS BIGINT) AS size FROM documents),
s AS MATERIALIZED (SELECT source, size, nth, [5, 2, 1][nth + 1] AS w FROM (SELECT source, sum(size) AS size, CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) AS nth FROM d GROUP BY source)),
r(k, rest, w) AS (SELECT 0, (SELECT sum(size) FROM s), (SELECT sum(w) FROM s) UNION ALL SELECT k + 1, (SELECT sum(size) FROM s) - coalesce((SELECT sum(3 * size) FROM s WHERE s.w * r.rest > 3 * s.size * r.w), 0), (SELECT sum(s.w) FROM s WHERE s.w * r.rest <= 3 * s.size * r.w) FROM r WHERE k < 40),
l AS (SELECT rest, w AS all_w FROM r ORDER BY k DESC LIMIT 1),
t AS (SELECT source, size AS source_size, nth, CASE WHEN w * rest > 3 * size * all_w THEN CAST(3 * size AS DOUBLE) ELSE CAST(w * rest AS DOUBLE) / all_w END AS target FROM s, l),
c AS (SELECT doc_id, d.size, CAST(source_size AS BIGINT) AS source_size, nth, target, CAST(round(target) AS BIGINT) AS q, CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY md5('1:' || doc_id), doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (SELECT *, before / q AS u, (q // source_size) * d.size + greatest(0, least(d.size, q % source_size - before)) AS taken FROM c d WHERE q > 0),
z AS (SELECT *, CASE nth WHEN 0 THEN 2.0 * u / (1.5 + sqrt(2.25 - 2.0 * u)) WHEN 2 THEN 2.0 * u / (0.5 + sqrt(0.25 + 2.0 * u)) WHEN 1 THEN CASE WHEN u < 0.5 THEN 2.0 * u / (0.5 + sqrt(0.25 + 4.0 * u)) ELSE 0.5 + 2.0 * (u - 0.5) / (1.5 + sqrt(2.25 - 4.0 * (u - 0.5))) END END AS place FROM u)
SELECT doc_id, size, source_size, target, taken, CASE WHEN taken > 0 THEN round(place, 9) END AS position FROM z"""

ORACLE_SQL = {
    "op3_quality": f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
a AS (SELECT doc_id, t, list_filter(regexp_split_to_array(t, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w,
      list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS l FROM d),
g AS (SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM a)),
r AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM g),
p AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, (SELECT unnest([0, 1, 2]) AS k) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT a.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
      CAST(length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(l) - len(list_distinct(l)) AS BIGINT) AS n_dup_lines,
      CAST(coalesce(p.n, 0) AS BIGINT) AS n_repeat_words, len(l) AS n_lines,
      len(list_filter(l, lambda x: regexp_matches(x, '(\\.\\.\\.|…)[\\x20\\x09-\\x0D]*$'))) AS n_ellipsis,
      len(list_filter(w, lambda x: list_contains({_STOP}, lower(x)))) AS n_stop FROM a LEFT JOIN p USING (doc_id)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / greatest(n_words, 1) BETWEEN 2 AND 14 AND n_symbols / greatest(n_words, 1) <= 0.5
  AND n_dup_lines / greatest(n_lines, 1) <= 0.5 AND n_ellipsis / greatest(n_lines, 1) <= 0.5 AND n_stop >= 1 AS kept FROM f""",
    "op4_line_dedup": """
WITH l AS (SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS i FROM documents),
k AS (SELECT *, translate(regexp_replace(regexp_replace(line, '^[\\x20\\x09-\\x0D]+', ''), '[\\x20\\x09-\\x0D]+$', ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
s AS (SELECT key, min(doc_id) AS first FROM k WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1),
m AS (SELECT k.doc_id, i, line, s.first IS NOT NULL AND s.first <> k.doc_id AS gone FROM k LEFT JOIN s USING (key))
SELECT doc_id, count(*) AS n_lines, CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT gone), '')) AS kept_sha256 FROM m GROUP BY doc_id""",
    "op7_warc": """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages), d AS (SELECT page_id, CAST(octet_length(encode(h)) AS BIGINT) AS payload_bytes, sha1(h) AS payload_digest FROM p),
k AS (SELECT payload_digest, max(page_id) AS keeper FROM d WHERE payload_bytes >= 1000 GROUP BY payload_digest)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < keeper THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < keeper THEN keeper END AS refers_to FROM d LEFT JOIN k USING (payload_digest)""",
    "op9_decontamination": """
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
b AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS g FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
dw AS (SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n)),
h AS (SELECT doc_id, i, n, item_id FROM dw JOIN bw USING (n, g)),
c AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM h)) GROUP BY doc_id),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM h GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(names, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM w LEFT JOIN c USING (doc_id) LEFT JOIN t USING (doc_id)""",
    "op10_ngram_jaccard": """
WITH RECURSIVE w AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i : i + 4], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y USING (g) WHERE x.doc_id < y.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n na ON a = na.doc_id JOIN n nb ON b = nb.doc_id WHERE 100 * c >= 80 * (na.n + nb.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r(doc_id, c) AS (SELECT a, a FROM u UNION SELECT u.b, r.c FROM r JOIN u ON u.a = r.doc_id AND r.c < u.b),
m AS (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, least(w.doc_id, coalesce(m.c, w.doc_id)) AS component_id FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id)""",
    "op11_centroids": _KMEANS,
    "op12_spelling": _SPELLING,
    "op13_mixing": _MIXING,
}

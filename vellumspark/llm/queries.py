"""The registered query of every operator, over its whole table and with production parameters, and SQL where SQL can say the same."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, embed_dedup, jaccard_join, line_dedup, packing, pii, quality, sharding, url_filter, warc
from .common import delete, materialise, new_path

SHARDS = [f"shard-{i:03d}" for i in range(64)]
SLOTS = 65537
VOCABULARY = "byte_bpe_50k.json"
URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


def vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path(VOCABULARY)


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(read(spark, sf_dir, "documents"), ["doc_id"], SHARDS, SLOTS).select("doc_id", "slot", "shard")


def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(read(spark, sf_dir, "documents"), vocabulary()).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = read(spark, sf_dir, "pages")
    kind = pages.schema["page_id"].dataType.simpleString()
    path = new_path(spark, "warc")
    warc.write_warc(pages, path)
    r = warc.read_warc(spark, path)
    response = F.col("record_type") == "response"
    digests = r.select(
        warc.key_of(F.col("record_id"), kind).alias("page_id"),
        F.when(response, F.octet_length("payload").cast("long")).otherwise(F.col("payload_length")).alias("payload_bytes"),
        F.when(response, F.sha2("payload", 256)).otherwise(F.substring_index("payload_digest", ":", -1)).alias("payload_digest"),
        "record_type",
        warc.key_of(F.col("refers_to"), kind).alias("refers_to"),
    )
    done = materialise(digests, "pages")
    delete(spark, path)
    return done


OP3_SQL = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
q AS (SELECT page_id, CAST(strlen(h) AS BIGINT) AS payload_bytes, sha256(h) AS payload_digest FROM p),
r AS (SELECT *, min(page_id) OVER (PARTITION BY payload_digest) AS first_id FROM q)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM r
"""


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.filter_urls(read(spark, sf_dir, "pages"), URL_RULES).select(F.col("id").alias("page_id"), "host", "path", "rule", "verdict")


def op4_sql() -> str:
    """Counts by context length, probabilities from the shortest context up, a table a length."""
    k_max, bos = url_filter.ORDER, "chr(2)"
    rule = "CASE " + " ".join(f"WHEN (host = '{r.host}' OR ends_with(host, '.{r.host}')) AND starts_with(path, '{r.path}') THEN '{r.text}'" for r in sorted(URL_RULES, key=lambda r: -len(r.text))) + " END"
    label = "CASE rule " + " ".join(f"WHEN '{r.text}' THEN {int(r.verdict == 'allow')}" for r in URL_RULES) + " END"
    levels = []
    for k in range(k_max + 1):
        cut = lambda n: f"right(h, {n})" if n else "''"
        below = "CROSS JOIN (SELECT 1.0 / greatest(count(DISTINCT c), 1) AS q1, 1.0 / greatest(count(DISTINCT c), 1) AS q0 FROM grams) u" if not k else f"JOIN (SELECT h AS hs, c AS cs, p1 AS q1, p0 AS q0 FROM p{k - 1}) u ON substr(l.h, 2) = hs AND l.c = cs"
        p = ", ".join(f"CASE WHEN t{x} > 0 THEN (n{x} + d{x} * q{x}) / (t{x} + d{x}) ELSE q{x} END AS p{x}" for x in (1, 0))
        levels.append(f"""
l{k} AS MATERIALIZED (SELECT {cut(k)} AS h, c, CAST(sum(n1) AS DOUBLE) AS n1, CAST(sum(n0) AS DOUBLE) AS n0 FROM grams GROUP BY 1, 2),
a{k} AS MATERIALIZED (SELECT h AS ha, sum(n1) AS t1, sum(n0) AS t0, CAST(count(*) FILTER (n1 > 0) AS DOUBLE) AS d1, CAST(count(*) FILTER (n0 > 0) AS DOUBLE) AS d0 FROM l{k} GROUP BY h),
p{k} AS MATERIALIZED (SELECT l.h, l.c, {p} FROM l{k} l {below} JOIN a{k} ON ha = l.h)""")
    gram = " || ".join(f"a[i + {k}]" for k in range(k_max))
    return f"""
WITH u0 AS (SELECT row_number() OVER () AS u, page_id, coalesce(url, '') AS url FROM pages),
u1 AS (SELECT *, translate(regexp_extract(url, '://([^/?#]*)', 1), '{url_filter.UPPER}', '{url_filter.LOWER}') AS host, regexp_extract(url, '://[^/?#]*([^?#]*)', 1) AS path FROM u0),
u2 AS (SELECT *, {rule} AS rule, CAST('0x' || substr(md5(url), 1, 8) AS BIGINT) % {url_filter.FOLDS} = 0 AS held FROM u1),
u3 AS MATERIALIZED (SELECT *, {label} AS label, [{", ".join([bos] * k_max)}] || list_filter(string_split(url, ''), lambda x: x <> '') || [chr(3)] AS a FROM u2),
g AS MATERIALIZED (SELECT u, unnest(list_transform(range(1, len(a) - {k_max} + 1), lambda i: {gram})) AS h, unnest(a[{k_max + 1}:]) AS c FROM u3),
grams AS MATERIALIZED (SELECT h, c, count(*) FILTER (label = 1 AND NOT held) AS n1, count(*) FILTER (label = 0 AND NOT held) AS n0 FROM g JOIN u3 USING (u) GROUP BY h, c),{",".join(levels)},
gain AS (SELECT h, c, CAST(round((ln(p1) - ln(p0)) * {url_filter.MICRO}) AS BIGINT) AS x FROM p{k_max}),
s AS MATERIALIZED (SELECT u, CAST(trunc(CAST(sum(x) AS DOUBLE) / count(*)) AS BIGINT) AS score FROM g JOIN gain USING (h, c) GROUP BY u),
b AS (SELECT CAST(floor(score / {url_filter.BIN}) AS BIGINT) AS bin, count(*) FILTER (label = 1) AS na, count(*) FILTER (label = 0) AS nr FROM s JOIN u3 USING (u) WHERE held AND label IS NOT NULL GROUP BY 1),
cum AS (SELECT bin, sum(na) OVER (ORDER BY bin) - na AS ba, sum(nr) OVER (ORDER BY bin) - nr AS br, sum(na) OVER () AS ta, sum(nr) OVER () AS tr FROM b),
best AS (SELECT bin FROM cum WHERE ta > 0 AND tr > 0 ORDER BY CAST(ta - ba AS DOUBLE) / ta + CAST(br AS DOUBLE) / tr DESC, bin LIMIT 1),
th AS (SELECT coalesce((SELECT bin FROM best), 0) * {url_filter.BIN} AS at_least)
SELECT page_id, host, path, rule, CASE WHEN coalesce(label, CASE WHEN score >= at_least THEN 1 ELSE 0 END) = 1 THEN 'allow' ELSE 'block' END AS verdict FROM u3 JOIN s USING (u), th
"""


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(read(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", *(count(k).alias(f"n_{name}") for k, name in enumerate(pii.KINDS)), F.sha2(pii.span_text(F.col("base")), 256).alias("base_sha256"), pii.span_text(F.col("spans")).alias("spans"))


def op6_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embed_dedup.near_vectors(read(spark, sf_dir, "embeddings"))


OP6_SQL = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
ok AS (SELECT * FROM v WHERE e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
link AS (SELECT p.vec_id AS a, q.vec_id AS b FROM ok p JOIN ok q ON p.vec_id <> q.vec_id AND len(p.e) = len(q.e) AND list_cosine_similarity(p.e, q.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM v UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
grp AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
deg AS (SELECT a AS vec_id, count(*) AS n FROM link GROUP BY a)
SELECT grp.vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, component_id = grp.vec_id AS kept FROM grp LEFT JOIN deg ON grp.vec_id = deg.vec_id
"""


def op7_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = line_dedup.dedup_lines(read(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    return out.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


OP7_SQL = r"""
WITH cut AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS ln, generate_subscripts(string_split(text, chr(10)), 1) AS i FROM documents),
lines AS (SELECT *, trim(ln, chr(32) || chr(9) || chr(13) || chr(11) || chr(12)) AS k FROM cut),
bad AS (SELECT k AS bk, min(doc_id) AS keeper FROM lines WHERE k <> '' GROUP BY k
        HAVING count(DISTINCT source) >= CASE WHEN len(string_split_regex(k, '[ \t]+')) < 5 THEN 8 ELSE 3 END),
judged AS (SELECT lines.*, bk IS NOT NULL AND doc_id IS DISTINCT FROM keeper AS gone FROM lines LEFT JOIN bad ON k = bk),
made AS (SELECT doc_id, count(*) FILTER (k <> '') AS n_lines, count(*) FILTER (gone) AS n_removed, string_agg(ln, chr(10) ORDER BY i) FILTER (NOT gone) AS t FROM judged GROUP BY doc_id)
SELECT documents.doc_id, CAST(coalesce(n_lines, 0) AS BIGINT) AS n_lines, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed,
       CASE WHEN text IS NOT NULL THEN sha256(coalesce(t, '')) END AS kept_sha256
FROM documents LEFT JOIN made ON documents.doc_id = made.doc_id
"""


def op8_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.similar_texts(read(spark, sf_dir, "documents"))


OP8_SQL = r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') AS w FROM documents),
s AS (SELECT doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 2)), lambda i: array_to_string(w[i:i+4], ' ')))) AS g FROM w WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
both_ AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY 1, 2),
link AS (SELECT a, b FROM both_ JOIN n p ON a = p.doc_id JOIN n q ON b = q.doc_id WHERE 5 * c >= 4 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM documents UNION SELECT reach.a, link.b FROM reach JOIN link ON reach.b = link.a),
cls AS (SELECT a AS doc_id, min(b) AS class_id FROM reach GROUP BY a),
deg AS (SELECT a AS doc_id, count(*) AS n_links FROM link GROUP BY a)
SELECT cls.doc_id, class_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, class_id = cls.doc_id AS kept FROM cls LEFT JOIN deg ON cls.doc_id = deg.doc_id
"""


def op9_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    back = bpe.round_trip(read(spark, sf_dir, "documents"), vocabulary())
    return back.select(F.col("id").alias("doc_id"), F.expr("cast(octet_length(ids) div 4 as bigint)").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged = quality.judge_quality(read(spark, sf_dir, "documents"))
    return judged.select(F.col("id").alias("doc_id"), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op10_sql(rounds: int = 25) -> str:
    """Counts by windows, votes as a list, and the estimation as a chain of small tables, one a round."""
    start = [x for _ in range(quality.RULES) for c in quality.START for x in c]
    index = ", ".join(f"({k}, {k // 6}, {k % 6 // 3}, {k % 3 - 1}, {x!r})" for k, x in enumerate(start))
    steps = []
    for i in range(1, rounds + 1):
        steps.append(f"""
g{i} AS MATERIALIZED (SELECT votes, n, 1 / (1 + exp(-(ln(prior / (1 - prior)) + list_sum(list_transform(range(0, {quality.RULES}), lambda j: ln(p[j * 6 + votes[j + 1] + 2] / p[j * 6 + votes[j + 1] + 5])))))) AS g FROM pat, m{i - 1}),
t{i} AS MATERIALIZED (SELECT sum(n * g) AS good, sum(n) - sum(n * g) AS bad, 0.01 * sum(n) + 1 AS wt FROM g{i}),
e{i} AS MATERIALIZED (SELECT k, c, st, sum(CASE WHEN votes[j + 1] = x THEN n * CASE WHEN c = 0 THEN g ELSE 1 - g END ELSE 0 END) AS e FROM idx, g{i} GROUP BY k, c, st),
q{i} AS MATERIALIZED (SELECT list((e + wt * st) / (CASE WHEN c = 0 THEN good ELSE bad END + wt) ORDER BY k) AS np FROM e{i}, t{i}),
m{i} AS MATERIALIZED (SELECT CASE WHEN stop THEN prior ELSE least(0.95, greatest(0.05, (good + 1) / (good + bad + 2))) END AS prior, CASE WHEN stop THEN p ELSE np END AS p, stop OR list_max(list_transform(range(1, {len(start) + 1}), lambda z: abs(np[z] - p[z]))) < 1e-4 AS stop FROM m{i - 1}, t{i}, q{i})""")
    gap, mark = r"[\x20\x09-\x0D]+", r"[#*$%&|<>]"
    rule = lambda good, bad: f"CASE WHEN {bad} THEN -1 WHEN {good} THEN 1 ELSE 0 END"
    rules = [
        rule("n_words BETWEEN 60 AND 100000", "n_words < 50"),
        rule("word_chars / n BETWEEN 3 AND 10", "word_chars / n < 2 OR word_chars / n > 15"),
        rule("n_symbols / n <= 0.05", "n_symbols / n > 0.2"),
        rule("n_dup_lines / greatest(n_lines, 1) <= 0.1", "n_dup_lines / greatest(n_lines, 1) > 0.3 AND n_dup_lines >= 3"),
        rule("n_repeat_words / n <= 0.2", "n_repeat_words / n > 0.4"),
        rule("n_alpha / n >= 0.8", "n_alpha / n < 0.6"),
        rule("n_marked / n <= 0.05", "n_marked / n > 0.2"),
        rule("n_distinct >= 0.25 * n", "n_distinct < 0.1 * n AND n < 2000"),
    ]
    return f"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS t, list_filter(string_split_regex(coalesce(text, ''), '{gap}'), lambda x: x <> '') AS w, list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^{gap[1:-1]}')) AS ln FROM documents),
gr AS (SELECT doc_id, unnest(list_transform(range(1, greatest(len(w) - 1, 1)), lambda i: w[i] || chr(1) || w[i + 1] || chr(1) || w[i + 2])) AS g, unnest(range(1, greatest(len(w) - 1, 1))) AS i FROM w),
dup AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS c FROM gr) WHERE c > 1),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS r FROM dup, (SELECT unnest([0, 1, 2]) AS k) GROUP BY doc_id),
f AS (SELECT w.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(length(array_to_string(w, '')) AS BIGINT) AS word_chars, CAST(length(t) - length(regexp_replace(t, '{mark}', '', 'g')) AS BIGINT) AS n_symbols, CAST(len(ln) - len(list_distinct(ln)) AS BIGINT) AS n_dup_lines,
  CAST(coalesce(r, 0) AS BIGINT) AS n_repeat_words, len(ln) AS n_lines, len(list_distinct(w)) AS n_distinct, len(list_filter(w, lambda x: regexp_matches(x, '\\p{{L}}'))) AS n_alpha, len(list_filter(w, lambda x: regexp_matches(x, '^{mark}|{mark}$'))) AS n_marked, CAST(greatest(len(w), 1) AS DOUBLE) AS n FROM w LEFT JOIN rep ON w.doc_id = rep.doc_id),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, [{", ".join(rules)}] AS votes FROM f),
pat AS MATERIALIZED (SELECT votes, count(*) AS n FROM v GROUP BY votes),
idx(k, j, c, x, st) AS MATERIALIZED (VALUES {index}),
m0 AS MATERIALIZED (SELECT CAST(0.7 AS DOUBLE) AS prior, CAST({start} AS DOUBLE[]) AS p, false AS stop),{",".join(steps)}
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND ln(prior / (1 - prior)) + list_sum(list_transform(range(0, {quality.RULES}), lambda j: ln(p[j * 6 + votes[j + 1] + 2] / p[j * 6 + votes[j + 1] + 5]))) >= 0 AS kept FROM v, m{rounds}
"""


QUERIES = {f.__name__: f for f in (op1_sharding, op2_packing, op3_warc, op4_url_filter, op5_pii, op6_embedding_dedup, op7_line_dedup, op8_ngram_jaccard, op9_bpe, op10_quality)}
ORACLES = {"op3_warc": OP3_SQL, "op4_url_filter": op4_sql(), "op6_embedding_dedup": OP6_SQL, "op7_line_dedup": OP7_SQL, "op8_ngram_jaccard": OP8_SQL, "op10_quality": op10_sql()}

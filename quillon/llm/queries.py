"""The queries of the corpus operators: thin wrappers that give each operator its whole table and the contract's columns."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quillon.llm import decontaminate, html_text, licenses, mixing, sentence_dedup, simhash, suffix_dedup, toxicity, vector_dedup, warc

#: Score from which a document is predicted toxic.
TOXIC_FROM = 0.7


def _read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_sentence_span_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = sentence_dedup.remove_repeated_spans(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select("doc_id", "n_sentences", "n_removed", "text")


def op2_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op3_toxicity_counterfactual(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    scored = toxicity.score_texts(docs, toxicity.train(docs, _read(spark, sf_dir, "labels")))
    return scored.select(F.col("id").alias("doc_id"), toxicity.held_out("id").alias("held_out"), "score", (F.col("score") >= TOXIC_FROM).cast("int").alias("predicted"))


def op4_suffix_array_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.repeated_bytes(_read(spark, sf_dir, "documents")).withColumnRenamed("id", "doc_id")


def op5_simhash_ball(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.simhash_components(_read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


def op6_html_tree_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extract(_read(spark, sf_dir, "pages")).withColumnRenamed("id", "page_id")


def op7_warc_derivatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages as response records, and from these their derivatives: identifiers, digests, and what the records hold."""
    found = warc.derivatives(warc.responses(_read(spark, sf_dir, "pages")))
    return found.select(F.col("id").alias("page_id"), "url", "response_id", "payload_digest", "digest_valid", "complete", "metadata_id", "metadata_digest", F.length("metadata").cast("long").alias("metadata_bytes"), "conversion_id", "conversion_digest", F.length("conversion").cast("long").alias("conversion_bytes"), "n_links", "text")


def op8_vector_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_dedup.near_duplicates(_read(spark, sf_dir, "embeddings")).withColumnsRenamed({"id": "vec_id", "component": "component_id"})


def op9_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets: each dimension's shares of tokens, tempered. The tables have no topic; the kind of text (``topic_of``) is the third dimension."""
    docs = _read(spark, sf_dir, "documents")
    mixed = mixing.mix(docs.select("doc_id", "text", "source", "lang"), [F.col("source"), F.col("lang"), mixing.topic_of()])
    m = "__mix"
    return mixed.select("doc_id", F.col(f"{m}.d0").alias("source"), F.col(f"{m}.d1").alias("lang"), F.col(f"{m}.d2").alias("topic"), F.col(f"{m}.tokens").alias("tokens"), F.round(f"{m}.weight", 6).alias("weight"), F.col(f"{m}.probability").alias("probability"), F.col(f"{m}.sampled").alias("sampled"))


def op10_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("runs", F.lit(0).cast("long"), lambda a, r: a + r["end"] - r["start"])
    names = F.array_join(F.sort_array(F.transform("items", lambda x: x.cast("string"))), ",")
    return found.select(F.col("id").alias("doc_id"), "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(names, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


QUERIES = {f.__name__: f for f in (op1_sentence_span_dedup, op2_license_scan, op3_toxicity_counterfactual, op4_suffix_array_dedup, op5_simhash_ball, op6_html_tree_scoring, op7_warc_derivatives, op8_vector_forest, op9_mix_sources, op10_decontaminate)}

_WORDS = r"regexp_extract_all(translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

_OP1_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, text,
    regexp_extract_all(coalesce(text, ''), '[ \t\r\f\v]*[^ \t\r\f\v\n.!?]+[.!?]*|[ \t\r\f\v]*[.!?\n]+|[ \t\r\f\v]+') AS p FROM documents),
u AS (SELECT r, k, unnest(p) AS piece, unnest(range(len(p))) AS i FROM d),
w AS (SELECT r, k, i, piece, ltrim(piece, ' ' || chr(9) || chr(11) || chr(12) || chr(13)) AS word FROM u),
x AS MATERIALIZED (SELECT *, NOT (word = '' OR word[1] IN ('.', '!', '?', chr(10))) AS is_word,
    word = '' OR word[1] IN ('.', '!', '?', chr(10)) OR word[-1] IN ('.', '!', '?') OR substr(md5(word), 1, 1) < '4' AS ends FROM w),
y AS (SELECT *, coalesce(sum(ends::INT) OVER (PARTITION BY r ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS g FROM x),
s AS (SELECT r, k, g, min(i) AS a, max(i) AS b, string_agg(word, ' ' ORDER BY i) AS t FROM y WHERE is_word GROUP BY r, k, g),
n AS MATERIALIZED (SELECT *, row_number() OVER v AS j, sum(greatest(len(t) - len(replace(t, ' ', '')) + 1, strlen(t) // 12)) OVER v AS c FROM s WINDOW v AS (PARTITION BY r ORDER BY g ROWS UNBOUNDED PRECEDING)),
m AS (SELECT r, count(*) AS n, list(t ORDER BY j) AS parts FROM n GROUP BY r),
z AS (SELECT n.r, n.k, n.j, coalesce(lag(n.c) OVER (PARTITION BY n.r ORDER BY n.j), 0) + 25 AS need FROM n),
e AS (SELECT z.r, z.k, z.j, greatest(n.j, z.j + 2) AS stop FROM z ASOF JOIN n ON z.r = n.r AND n.c >= z.need),
f AS (SELECT e.r, e.k, e.j, e.stop FROM e JOIN m USING (r) WHERE e.stop <= m.n),
v AS (SELECT * FROM f UNION ALL SELECT r, d.k, 1, m.n FROM m JOIN d USING (r) WHERE r NOT IN (SELECT r FROM f)),
h AS MATERIALIZED (SELECT v.r, v.k, v.j, v.stop, md5(array_to_string(list_slice(m.parts, v.j, v.stop), chr(10))) AS h FROM v JOIN m USING (r)),
o AS (SELECT h, min({'k': k, 'j': j}) AS first FROM h GROUP BY h HAVING count(*) > 1),
q AS (SELECT DISTINCT r, unnest(range(j, stop + 1)) AS j FROM h JOIN o USING (h) WHERE k <> first.k OR j <> first.j),
c AS (SELECT r, count(*) AS n FROM q GROUP BY r),
l AS (SELECT DISTINCT r, unnest(range(a, b + 1)) AS i FROM q JOIN n USING (r, j)),
t AS (SELECT u.r, string_agg(piece, '' ORDER BY u.i) AS kept FROM u ANTI JOIN l ON u.r = l.r AND u.i = l.i GROUP BY u.r)
SELECT doc_id, CAST(coalesce(m.n, 0) AS BIGINT) AS n_sentences, CAST(coalesce(c.n, 0) AS BIGINT) AS n_removed, CASE WHEN text IS NULL THEN NULL ELSE coalesce(kept, '') END AS text
FROM d LEFT JOIN m USING (r) LEFT JOIN c USING (r) LEFT JOIN t USING (r)"""

#: Kept as hexadecimal text, two digits for each byte.
_OP4_SQL = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS k, lower(hex(encode(coalesce(text, '')))) AS x FROM documents),
e AS (SELECT r, k, o, substr(x, 2 * o + 1, 1098) AS x FROM (SELECT r, k, x, unnest(range(0, CAST(len(x) / 2 AS BIGINT) - 49, 500)) AS o FROM d WHERE len(x) >= 100)),
w AS (SELECT r, k, o + p AS p, md5(substr(x, 2 * p + 1, 100)) AS h FROM (SELECT r, k, o, x, unnest(range(CAST(len(x) / 2 AS BIGINT) - 49)) AS p FROM e)),
f AS (SELECT h, min(k) AS first FROM w GROUP BY h HAVING min(k) < max(k)),
g AS (SELECT r, p FROM w JOIN f USING (h) WHERE k > first),
n AS (SELECT r, p, CASE WHEN p <= lag(p) OVER (PARTITION BY r ORDER BY p) + 50 THEN 0 ELSE 1 END AS new FROM g),
s AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (SELECT r, p, sum(new) OVER (PARTITION BY r ORDER BY p) AS i FROM n) GROUP BY r, i),
t AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM s),
c AS (SELECT t.r, sum(b - a) AS n_removed, count(*) AS n_spans, max(b) AS stop, string_agg(substr(x, 2 * before + 1, 2 * (a - before)), '' ORDER BY a) AS kept FROM t JOIN d USING (r) GROUP BY t.r)
SELECT doc_id, CAST(len(x) / 2 AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans,
       sha256(unhex(CASE WHEN stop IS NULL THEN x ELSE kept || substr(x, 2 * stop + 1) END)) AS kept_sha256
FROM d LEFT JOIN c USING (r)"""


def _count(mark: str) -> str:
    return f"(length(coalesce(text, '')) - length(replace(coalesce(text, ''), '{mark}', '')))"


_ASKED = f"({_count('?')} + {_count('!')})"
_TOPIC = f"CASE WHEN {_count('|')} >= 5 THEN 'table' WHEN {_ASKED} > 0 AND {_ASKED} * 2 >= {_count('.')} THEN 'questions' WHEN length(coalesce(text, '')) < 400 THEN 'brief' ELSE 'prose' END"


def _op9_sql() -> str:
    """Fitting unrolled: one step for each round and dimension."""
    dims = ("source", "lang", "topic")
    sql = f"""
WITH d AS MATERIALIZED (SELECT doc_id, coalesce(source, '(other)') AS source, coalesce(lang, '(other)') AS lang,
    {_TOPIC} AS topic, len(regexp_extract_all(coalesce(text, ''), '[^ \\t\\n\\r\\f\\v]+')) AS tokens FROM documents),
v0 AS MATERIALIZED (SELECT source, lang, topic, CAST(sum(tokens) AS DOUBLE) AS w, CAST(sum(tokens) AS DOUBLE) / sum(sum(tokens)) OVER () AS now FROM d GROUP BY ALL HAVING sum(tokens) > 0)"""
    for x in dims:
        sql += f",\nt_{x} AS MATERIALIZED (SELECT {x}, pow(sum(w), 0.7) / sum(pow(sum(w), 0.7)) OVER () AS share FROM v0 GROUP BY {x})"
    step = 0
    for _ in range(mixing.ROUNDS):
        for x in dims:
            sql += f",\nv{step + 1} AS MATERIALIZED (SELECT v.source, v.lang, v.topic, w, now * share / sum(now) OVER (PARTITION BY v.{x}) AS now FROM v{step} v JOIN t_{x} t ON v.{x} = t.{x})"
            step += 1
    return sql + f""",
f AS MATERIALIZED (SELECT source, lang, topic, now / (w / sum(w) OVER ()) AS weight FROM v{step}),
p AS MATERIALIZED (SELECT source, lang, topic, weight, round(weight / max(weight) OVER (), 6) AS probability FROM f)
SELECT doc_id, d.source, d.lang, d.topic, CAST(tokens AS BIGINT) AS tokens, round(coalesce(weight, 0.0), 6) AS weight, coalesce(probability, 0.0) AS probability,
       CAST(('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8)) AS BIGINT) / 4294967296.0 < coalesce(probability, 0.0) AS sampled
FROM d LEFT JOIN p ON d.source = p.source AND d.lang = p.lang AND d.topic = p.topic"""


ORACLE_SQL: dict[str, str] = {
    "op1_sentence_span_dedup": _OP1_SQL,
    "op4_suffix_array_dedup": _OP4_SQL,
    "op9_mix_sources": _op9_sql(),
    "op10_decontaminate": f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, array_to_string(list_slice(w, p, p + least(len(w), 10) - 1), ' ') AS s
       FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS p FROM b WHERE len(w) > 0)),
dw AS (SELECT r, n, p, array_to_string(list_slice(w, p, p + n - 1), ' ') AS s
       FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS p FROM d, (SELECT DISTINCT n FROM bw))),
m AS (SELECT r, p, dw.n, item_id FROM dw JOIN bw ON dw.s = bw.s AND dw.n = bw.n),
h AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(p, p + n)) AS q FROM m) GROUP BY r),
i AS (SELECT r, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS names FROM m GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (r) LEFT JOIN i USING (r)""",
}

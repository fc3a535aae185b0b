"""One registered query for each operator, over whole tables, and the SQL that must give the same rows."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dailies.llm import chat, divergence, interaction, langid, licenses, minmax, naming, ngramjoin, pfor, pieces, secrets, sharding, winnowing
from dailies.session import ensure_checkpoint_dir

QUERIES, ORACLES = {}, {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql.strip()
        return fn

    return add


def docs_of(spark: SparkSession, d: str) -> DataFrame:
    return spark.read.parquet(f"{d}/documents.parquet")


#: Words of lower-cased text in DuckDB.
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"

CONTAMINATION = rf"""
WITH iw AS (SELECT item_id, {WORDS} AS w FROM benchmark),
wins AS (SELECT DISTINCT item_id, array_to_string(w[s:s + least(len(w), 10) - 1], ' ') AS win, least(len(w), 10) AS n
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS s FROM iw WHERE len(w) > 0)),
dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
hits AS (SELECT doc_id, s, n, item_id FROM (
  SELECT doc_id, s, n, array_to_string(w[s:s + n - 1], ' ') AS win FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM dw, (SELECT DISTINCT n FROM wins))) JOIN wins USING (win, n)),
words_hit AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(s, s + n)) AS p FROM (SELECT DISTINCT doc_id, s, n FROM hits)) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS ids FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS i FROM hits) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN words_hit USING (doc_id) LEFT JOIN items USING (doc_id)"""


@query(CONTAMINATION)
def op1_winnowing(spark: SparkSession, d: str) -> DataFrame:
    return winnowing.contamination(docs_of(spark, d), spark.read.parquet(f"{d}/benchmark.parquet"), span=10).drop("spans")


SHARDS = r"""
WITH RECURSIVE tab(i, c, k) AS (SELECT i, i, 0 FROM range(256) t(i) UNION ALL
  SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM tab WHERE k < 8),
crc AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM tab WHERE k = 8),
dist AS (SELECT DISTINCT coalesce(text, '') AS text FROM documents),
hx AS (SELECT text, hex(encode(text)) AS h FROM dist),
sums AS (SELECT text, xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(length(h) // 2), lambda p: ('0x' || h[p * 2 + 1:p * 2 + 2])::BIGINT)),
  lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295) AS text_crc32 FROM hx, crc),
a AS (SELECT doc_id, strlen(coalesce(d.text, '')) + 1 AS size, text_crc32, CASE WHEN source IS NULL THEN 'n' ELSE 's' || source END AS stratum, md5('17:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents d JOIN sums s ON s.text = coalesce(d.text, '')),
b AS (SELECT *, (2 * row_number() OVER (PARTITION BY stratum ORDER BY key, doc_id, text_crc32, size) - 1)::DOUBLE / (2 * count(*) OVER (PARTITION BY stratum))::DOUBLE AS frac FROM a),
c AS (SELECT *, row_number() OVER (ORDER BY frac, stratum, key, doc_id, text_crc32, size) - 1 AS pos, count(*) OVER () AS n FROM b)
SELECT doc_id, size::BIGINT AS size, text_crc32::BIGINT AS text_crc32, 'rows' AS law, (pos * 8 // n)::INTEGER AS shard, (pos - ((pos * 8 // n) * n + 7) // 8)::BIGINT AS slot, NULL::INTEGER AS grown_shard FROM c"""


@query(SHARDS)
def op4_interleaving(spark: SparkSession, d: str) -> DataFrame:
    out = sharding.interleave_shards(docs_of(spark, d), n_shards=8).drop("source")
    return out.withColumn("law", F.lit("rows")).withColumn("grown_shard", F.lit(None).cast("int"))


NEAR = r"""
WITH RECURSIVE dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + least(len(w), 2) - 1], ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(len(w), 2) + 2)) AS i FROM dw WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
e AS MATERIALIZED (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * c >= 80 * (a.n + b.n - c)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, e.y FROM reach JOIN e ON reach.y = e.x)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, r.c AS component_id, d.doc_id = r.c AS kept
FROM documents d LEFT JOIN n USING (doc_id) JOIN (SELECT x AS doc_id, min(y) AS c FROM reach GROUP BY x) r USING (doc_id)"""


@query(NEAR)
def op5_minmax_hashing(spark: SparkSession, d: str) -> DataFrame:
    return minmax.near_duplicates(docs_of(spark, d), shingle=2).drop("h", "stays")


EXACT = r"""
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS t FROM documents)
SELECT doc_id, min(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
  row_number() OVER (PARTITION BY t ORDER BY doc_id) = 1 AS kept, sha256(t) AS text_sha256 FROM n"""


@query(EXACT)
def op7_block_naming(spark: SparkSession, d: str) -> DataFrame:
    return naming.exact_dedup(docs_of(spark, d))


def _sql_list(words) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


LICENSES = rf"""
WITH dw AS (SELECT doc_id, {WORDS} AS w FROM documents),
ph(label, p) AS (VALUES {", ".join(f"('{k}', {_sql_list(v.split())})" for k, v in licenses.PHRASES.items())}),
tm(label, t) AS (VALUES {", ".join(f"('{k}', {_sql_list(sorted(set(t.split())))})" for k, ts in licenses.TEMPLATES.items() for t in ts)}),
pl AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, label, p, w, unnest(range(1, len(w) - len(p) + 2)) AS i FROM dw, ph) WHERE w[i:i + len(p) - 1] = p),
bl AS (SELECT doc_id, list_distinct(w[b * 32 + 1:b * 32 + 64]) AS b FROM (SELECT doc_id, w, unnest(range(0, (len(w) + 31) // 32)) AS b FROM dw)),
tc AS (SELECT doc_id, label, len(list_intersect(b, t)) / len(t) AS share FROM bl, tm WHERE len(list_intersect(b, t)) >= ceil(0.8::DOUBLE * len(t) - 1e-9)),
a AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM pl GROUP BY 1),
l AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM (SELECT doc_id, label, 1.0::DOUBLE AS share FROM pl UNION ALL SELECT * FROM tc) GROUP BY 1)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word, coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM dw LEFT JOIN a USING (doc_id) LEFT JOIN l USING (doc_id)"""


@query(LICENSES)
def op3_license_scan(spark: SparkSession, d: str) -> DataFrame:
    return licenses.license_scan(docs_of(spark, d))


@query()
def op10_secret_scan(spark: SparkSession, d: str) -> DataFrame:
    out = secrets.secret_scan(docs_of(spark, d))
    said = lambda c: F.array_join(F.transform(c, lambda x: F.concat_ws(":", x["kind"], x["start"].cast("string"), x["end"].cast("string"))), ",")
    return out.select("doc_id", "n_assign", "n_access", "n_hex", F.sha2(said("base_spans"), 256).alias("base_sha256"), said("spans").alias("spans"))


@query()
def op8_string_kernels(spark: SparkSession, d: str) -> DataFrame:
    docs = docs_of(spark, d).select("doc_id", "text", "lang")
    docs = docs.withColumn("held_out", F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1)
    model = langid.train(docs.filter(~F.coalesce("held_out", F.lit(False))))
    return langid.predict(docs, model, keep=("doc_id", "held_out"))


@query()
def op6_viterbi(spark: SparkSession, d: str) -> DataFrame:
    ids = pieces.encode(docs_of(spark, d).select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("given", F.sha2("text", 256)), keep=("doc_id", "given"))
    back = pieces.decode(ids.withColumn("n_tokens", F.size("ids").cast("bigint")).withColumn("ids_hash", F.xxhash64("ids")), keep=("doc_id", "given", "n_tokens", "ids_hash", "ids"))
    return back.select("doc_id", "ids", "n_tokens", "ids_hash", F.char_length("text").cast("bigint").alias("n_chars"), (F.sha2("text", 256) == F.col("given")).alias("same_text"))


@query()
def op9_token_pages(spark: SparkSession, d: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/tokens-{uuid.uuid4().hex}"
    pfor.write_tokens(docs_of(spark, d), path)
    return pfor.token_index(spark, path)


@query()
def op2_chat_windows(spark: SparkSession, d: str) -> DataFrame:
    turns = spark.read.parquet(f"{d}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = F.lit("</s>[INST] ok [/INST]").alias("text")
    more = spark.range(2).select(F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), said)
    return chat.conversation_digests(chat.read_windows(chat.chat_windows(turns.unionByName(more))))


INTERACTION = r"""
WITH w AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
lab AS (SELECT doc_id, bool_or(quality = 1) AS good, bool_or(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
rows AS (SELECT part, coalesce(good, false) AS good, coalesce(toxic, false) AS toxic, len(w) < 50 AS A, 100 * len(list_distinct(w)) < 65 * len(w) AS B,
  100 * len(regexp_replace(t, '[^A-Z]', '', 'g')) > 5 * len(t) AS C, regexp_matches(t, '[#$%&*|]') AS D, coalesce(w.doc_id > min(w.doc_id) OVER (PARTITION BY t), false) AS E
  FROM w LEFT JOIN lab USING (doc_id)),
masks AS (SELECT part, good, toxic, A::INT + 2 * B::INT + 4 * C::INT + 8 * D::INT + 16 * E::INT AS m, count(*) AS n FROM rows GROUP BY ALL),
f(x) AS (VALUES ('A'), ('B'), ('C'), ('D'), ('E')),
o AS (SELECT a.x || b.x || c.x || d.x || e.x AS filter_order FROM f a, f b, f c, f d, f e WHERE len(list_distinct([a.x, b.x, c.x, d.x, e.x])) = 5),
s AS (SELECT filter_order, step::INT AS step, (1 << (ascii(substr(filter_order, step::INT, 1)) - 65))::INT AS own,
  list_sum([(1 << (ascii(y) - 65))::INT FOR y IN string_split(filter_order, '')[:step::INT - 1]]) AS prior FROM o, range(1, 6) r(step)),
c AS (SELECT part, filter_order, step, own, sum(n) FILTER (m & (own + coalesce(prior, 0)::INT) = 0) AS kept, sum(n) FILTER (m & own <> 0 AND m & coalesce(prior, 0)::INT = 0) AS removed,
  sum(n) FILTER (m & own <> 0 AND m & coalesce(prior, 0)::INT <> 0) AS redundant, sum(n) FILTER (m = own) AS unique_fails,
  sum(n) FILTER (good AND m & own <> 0 AND m & coalesce(prior, 0)::INT = 0) AS good_lost, sum(n) FILTER (toxic AND m & own <> 0 AND m & coalesce(prior, 0)::INT = 0) AS toxic_lost
  FROM masks, s GROUP BY 1, 2, 3, 4)
SELECT part, filter_order, step, coalesce(kept, 0)::BIGINT AS kept, coalesce(removed, 0)::BIGINT AS removed, coalesce(redundant, 0)::BIGINT AS redundant, coalesce(unique_fails, 0)::BIGINT AS unique_fails,
  coalesce(good_lost, 0)::BIGINT AS good_lost, coalesce(toxic_lost, 0)::BIGINT AS toxic_lost, sum(coalesce(removed, 0)) OVER (PARTITION BY part, own)::BIGINT AS shapley FROM c"""


@query(INTERACTION)
def op13_posting_lists(spark: SparkSession, d: str) -> DataFrame:
    return interaction.interaction_audit(docs_of(spark, d), spark.read.parquet(f"{d}/labels.parquet"))


DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
  regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
t AS (SELECT row, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term FROM t GROUP BY 1, 2 HAVING count(DISTINCT row) >= 10),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
full_ AS (SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n FROM g JOIN kept ON kept.lang = g.lang LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
p AS (SELECT lang, source, term, n, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang, source) + 2 * v) AS p FROM full_ JOIN v USING (lang)),
lang_n AS (SELECT lang, term, sum(n) AS n FROM full_ GROUP BY 1, 2),
q AS (SELECT lang, term, 1 + (1000000000::HUGEINT * (n + 2)) // (sum(n) OVER (PARTITION BY lang) + 2 * v) AS q FROM lang_n JOIN v USING (lang)),
pair AS (SELECT a.lang, a.source, b.source AS item, (SELECT coalesce(sum(((x.p - y.p) * (x.p - y.p)) // (x.p + y.p)), 0) FROM p x JOIN p y ON x.lang = y.lang AND x.term = y.term WHERE x.lang = a.lang AND x.source = a.source AND y.source = b.source) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source),
term AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM p JOIN q USING (lang, term) WHERE n > 0 AND p > q),
r AS (SELECT lang, source, 'pair' AS part, item, value FROM pair UNION ALL SELECT lang, source, 'term', item, value FROM term)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM r)
WHERE part = 'pair' OR rank <= 10"""


@query(DIVERGENCE)
def op12_perfect_hash(spark: SparkSession, d: str) -> DataFrame:
    return divergence.divergence(docs_of(spark, d))


JACCARD = NEAR.replace("least(len(w), 2)", "least(len(w), 5)").replace(", d.doc_id = r.c AS kept", "")


@query(JACCARD)
def op11_ngram_join(spark: SparkSession, d: str) -> DataFrame:
    return ngramjoin.jaccard_components(docs_of(spark, d)).drop("h")

"""Catalogue, rule, place and boundary queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailies.functions import rules
from dailies.functions.text import slug
from dailies.operators import catalogue as cat
from dailies.operators import segment
from dailies.workload.adapter import SEGMENTS, WORDS, clips, segments, table, transcripts, words
from dailies.workload.interval_queries import ANALYSIS, analysis
from dailies.workload.layout_queries import MUTES, PLACED, SOUNDED, mutes, placed, sounded
from dailies.workload.registry import query
from dailies.workload.text_queries import CLIP, SENT, SETS, pairs_sql, sentences

OVER = "s.project_id = i.project_id AND s.clip_id = i.clip_id AND s.s_us < i.e_us AND s.e_us > i.s_us"


def instruction_spans(spark, d):
    return analysis(spark, d).select(*CLIP, F.inline("instructions"))


def attempts(spark, d):
    takes = analysis(spark, d).select(*CLIP, F.posexplode("takes").alias("take", "t"))
    return takes.select(*CLIP, "take", F.size("t.attempts").alias("n_attempts"), F.col("t.keep").alias("keep"), F.posexplode("t.attempts").alias("i", "a")).select(
        *CLIP, "take", "n_attempts", "keep", "i", "a.s_us", "a.e_us"
    )


@query("flag_instructions", f"""WITH {SENT}, {ANALYSIS} SELECT s.project_id, s.clip_id, s.n, EXISTS (SELECT 1 FROM instr i WHERE {OVER} AND i.e_us > i.s_us) AS instruction FROM sent s""")
def flag_instructions(spark, d):
    return cat.flag_instructions(sentences(spark, d).drop("instruction"), instruction_spans(spark, d)).select(*CLIP, "n", "instruction")


RETAKE = """kp AS (SELECT *, CASE WHEN coalesce(CASE WHEN keep < 0 THEN keep + 3 ELSE keep END, 2) BETWEEN 0 AND 2 THEN coalesce(CASE WHEN keep < 0 THEN keep + 3 ELSE keep END, 2) ELSE 2 END AS kk FROM att),
tg AS (SELECT s.project_id, s.clip_id, min(s.n) AS target FROM sent s JOIN kp i ON {o} AND i.i = i.kk GROUP BY ALL),
rt AS (SELECT DISTINCT s.project_id, s.clip_id, s.n, target AS retake_of FROM sent s JOIN kp i ON {o} AND i.i <> i.kk JOIN tg ON tg.project_id = s.project_id AND tg.clip_id = s.clip_id WHERE s.n <> target)""".format(o=OVER)


@query("retake_pointers", f"WITH {SENT}, {ANALYSIS}, {RETAKE} SELECT * FROM rt")
def retake_pointers(spark, d):
    return cat.retake_pointers(sentences(spark, d), attempts(spark, d))


CATALOGUE_SETS = SETS.replace("(clip_id + n) % 11 = 0 AS instruction FROM sent", f"EXISTS (SELECT 1 FROM instr i WHERE {OVER} AND i.e_us > i.s_us) AS instruction FROM sent s").replace("SENT", "")


@query("sentence_catalogue", f"""WITH {ANALYSIS}, {CATALOGUE_SETS}, {RETAKE}, {pairs_sql('project_id', 4, 70)},
h AS (SELECT p.project_id, p.ord, min_by(q.sentence_id, q.ord) AS duplicate_of FROM m p JOIN sim ON sim.x = p.cid JOIN m q ON q.cid = sim.y AND q.ord > p.ord AND NOT q.instruction GROUP BY ALL)
SELECT ws.project_id, ws.clip_id, ws.n, instruction, retake_of, duplicate_of, NOT instruction AND retake_of IS NULL AND duplicate_of IS NULL AS keep_default
FROM ws LEFT JOIN rt ON rt.project_id = ws.project_id AND rt.clip_id = ws.clip_id AND rt.n = ws.n LEFT JOIN h ON h.project_id = ws.project_id AND h.ord = ws.ord""")
def sentence_catalogue(spark, d):
    full = cat.sentence_catalogue(sentences(spark, d), instruction_spans(spark, d), attempts(spark, d))
    return full.select(*CLIP, "n", "instruction", "retake_of", "duplicate_of", "keep_default")


RNG = "rg AS (SELECT source AS project_id, doc_id AS clip_id, doc_id * 10 + k AS rid, k * 4100000 + doc_id % 7 * 300000 AS s_us, k * 4100000 + doc_id % 7 * 300000 + 3300000 AS e_us FROM documents, range(6) r(k))"


def spans(spark, d):
    base = table(spark, d, "documents").select(F.col("source").alias("project_id"), F.col("doc_id").alias("clip_id"), F.explode(F.sequence(F.lit(0), F.lit(5))).alias("k"))
    s = (F.col("k") * 4_100_000 + F.col("clip_id") % 7 * 300_000).cast("bigint")
    return base.select(*CLIP, (F.col("clip_id") * 10 + F.col("k")).alias("rid"), s.alias("s_us"), (s + 3_300_000).alias("e_us"))


IN_RANGE = f"""ir AS (SELECT i.project_id, i.clip_id, i.rid, s.n, i.s_us, i.e_us, s.s_us AS t_s, s.e_us AS t_e, least(i.e_us, s.e_us) - greatest(i.s_us, s.s_us) AS ov FROM rg i JOIN sent s ON {OVER})"""


@query("sentences_in_range", f"WITH {SENT}, {RNG}, {IN_RANGE} SELECT project_id, clip_id, rid, n, s_us, e_us, t_s, t_e, ov * 1000 // (t_e - t_s) AS covered_milli, ov * 100 >= (t_e - t_s) * 50 AS kept FROM ir")
def sentences_in_range(spark, d):
    return cat.sentences_in_range(spans(spark, d), sentences(spark, d), "rid")


@query("range_extension", f"""WITH {SENT}, {RNG}, {IN_RANGE}, k AS (SELECT project_id, clip_id, rid, greatest(s_us - min(t_s), 0) + greatest(max(t_e) - e_us, 0) AS extra_us FROM ir WHERE ov * 100 >= (t_e - t_s) * 50 GROUP BY project_id, clip_id, rid, s_us, e_us) SELECT * FROM k WHERE extra_us > 500000""")
def range_extension(spark, d):
    return cat.range_extension(spans(spark, d), sentences(spark, d), "rid")


@query("nearest_sentence_end", f"""WITH {SENT}, {RNG}, f AS (SELECT project_id, clip_id, min(s_us) AS f FROM sent GROUP BY ALL),
c AS (SELECT rg.project_id, rg.clip_id, rid, rg.s_us AS t_us, min_by(struct_pack(n := s.n, d := abs(s.e_us - rg.s_us)), (abs(s.e_us - rg.s_us), s.n)) AS b FROM rg JOIN sent s ON s.project_id = rg.project_id AND s.clip_id = rg.clip_id GROUP BY ALL)
SELECT c.project_id, c.clip_id, rid, t_us, CASE WHEN t_us > f THEN b.n END AS after_n, CASE WHEN t_us > f THEN b.d END AS distance_us FROM c JOIN f ON f.project_id = c.project_id AND f.clip_id = c.clip_id""")
def nearest_sentence_end(spark, d):
    pts = spans(spark, d).select(*CLIP, "rid", F.col("s_us").alias("t_us"))
    return cat.nearest_sentence_end(pts, sentences(spark, d), "t_us")


@query("first_seen_distinct", f"""WITH {WORDS}, k AS (SELECT project_id, lower(text) AS k, min_by(text, [clip_id, pos]) AS text, min([clip_id, pos]) AS p FROM words GROUP BY ALL)
SELECT project_id, text, row_number() OVER (PARTITION BY project_id ORDER BY p) AS n FROM k""")
def first_seen_distinct(spark, d):
    w = words(spark, d).select("project_id", "text", F.struct("clip_id", "pos").alias("at"))
    return cat.first_seen_distinct(w, ["project_id"], "text", "at")


def title_of(spark, d):
    return table(spark, d, "documents").select("doc_id", "lang", F.regexp_replace("text", "\\s+", " ").alias("title"))


# titles and thumbnail texts are whole texts
TITLES = "t AS (SELECT doc_id, lang, regexp_replace(text, '\\s+', ' ', 'g') AS title FROM documents)"
B = "(?:^|[^\\p{L}\\p{N}_])"
STOP = ", ".join(f"'{w}'" for w in rules.STOPWORDS)


@query("title_keywords", f"""WITH {TITLES}, k AS (SELECT doc_id, unnest(regexp_extract_all(lower(title), '[\\p{{L}}\\p{{N}}\\p{{M}}_]{{4,}}')) AS w FROM t), r AS (SELECT doc_id, w FROM k WHERE w NOT IN ({STOP}) GROUP BY ALL HAVING count(*) > 1)
SELECT t.doc_id, length(title) AS n_chars, regexp_matches(title, '\\p{{Nd}}') AS has_number, coalesce((SELECT string_agg(w, ',' ORDER BY w) FROM r WHERE r.doc_id = t.doc_id), '') AS repeated FROM t""")
def title_keywords(spark, d):
    t = title_of(spark, d)
    return t.select("doc_id", F.length("title").cast("bigint").alias("n_chars"), F.array_contains(rules.title_tags(F.col("title")), "number").alias("has_number"), F.array_join(rules.repeated_keywords(F.col("title")), ",").alias("repeated"))


# word signs and the ends of words for SQL, whose own \\b and \\w know ASCII only
W = "\\p{L}\\p{N}\\p{M}_"
WB, WE = f"(?:^|[^{W}])", f"(?:$|[^{W}])"
CURIOUS = f"(?i){WB}(?:dlaczego{WE}|jak\\s|co\\s+si[eę]{WE}|nikt{WE}|sekret|nie\\s+uwierzysz{WE}|naprawd[eę]{WE}|czego{WE}|okazuje\\s+si[eę]{WE}|nie\\s+spodziewa|why{WE}|how{WE}|what\\s+happen|nobody{WE}|secret{WE})|\\?"
SUPERLATIVE = f"(?i){WB}(?:naj[{W}]|jedyn[{W}]|szalon[{W}]|ekstremaln[{W}]|(?:nigdy|best|worst|most|cheapest|only|ever){WE})"
CHANGE = f"(?i){WB}(?:(?:od|z)\\s+[{W}]+\\s+do\\s+[{W}]|zmieni|przemian|w\\s+\\p{{Nd}}+\\s*(?:godzin|dni|dzie[nń]|minut)|from\\s+[{W}]+\\s+to\\s+[{W}]|turned\\s+into{WE}|transform)"


@query("title_issues", f"""WITH {TITLES}, x AS (SELECT doc_id, trim(coalesce(title, '')) AS t FROM t), k AS (SELECT doc_id, unnest(regexp_extract_all(lower(t), '[{W}]{{4,}}')) AS w FROM x),
r AS (SELECT doc_id FROM (SELECT doc_id, w FROM k WHERE w NOT IN ({STOP}) GROUP BY ALL HAVING count(*) > 1) GROUP BY doc_id)
SELECT x.doc_id, unnest(CASE WHEN t = '' THEN ['empty'] ELSE list_filter([CASE WHEN length(t) < 55 THEN 'short' WHEN length(t) > 100 THEN 'over_hard_max' WHEN length(t) > 70 THEN 'long' END,
 CASE WHEN NOT (regexp_matches(t, '\\p{{Nd}}') OR regexp_matches(t, '{CURIOUS}') OR regexp_matches(t, '{SUPERLATIVE}') OR regexp_matches(t, '{CHANGE}')) THEN 'no_formula' END,
 CASE WHEN r.doc_id IS NOT NULL THEN 'repeated_keyword' END], lambda y: y IS NOT NULL) END) AS issue FROM x LEFT JOIN r ON r.doc_id = x.doc_id""")
def title_issues(spark, d):
    t = title_of(spark, d)
    return t.select("doc_id", F.explode(rules.title_issues(F.col("title"))).alias("issue"))


@query("thumbnail_text_issues", f"""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS x FROM documents), w AS (SELECT doc_id, x, string_split(x, ' ') AS ws FROM t)
SELECT doc_id, array_to_string(CASE WHEN x = '' THEN ['empty'] ELSE list_filter([CASE WHEN len(ws) > 5 THEN 'too_many_words' END, CASE WHEN length(x) > 30 THEN 'too_long' END, CASE WHEN list_max(list_transform(ws, lambda y: length(y))) > 14 THEN 'long_word' END,
 CASE WHEN regexp_matches(x, '[^\\p{{L}}\\p{{N}}\\s!?.,:''\\-–—&%€$]') THEN 'illegal_characters' END], lambda y: y IS NOT NULL) END, ',') AS issues FROM w""")
def thumbnail_text_issues(spark, d):
    line = F.trim(F.regexp_replace("text", "\\s+", " "))
    return table(spark, d, "documents").select("doc_id", F.array_join(rules.thumbnail_issues(line), ",").alias("issues"))


@query("instruction_phrases", f"""WITH {SENT}, s AS (SELECT sent.project_id, sent.clip_id, n, lower(trim(CASE n % 5 WHEN 0 THEN 'Use this as ' WHEN 1 THEN 'Wytnij ' WHEN 2 THEN 'to na ' ELSE '' END || sent.text)) AS t, d.lang FROM sent JOIN documents d ON d.doc_id = sent.clip_id)
SELECT project_id, clip_id, n FROM s WHERE CASE WHEN lang = 'en' THEN regexp_matches(t, '^insert\\s+this|^use\\s+this\\s+(as|for)|^cut\\s+this|^discard\\s+this') ELSE regexp_matches(t, '^to\\s+wstaw|^to\\s+na\\b|^u[żz]yj|^wytnij|^to\\s+wytnij|^to\\s+wykorzystaj|^to\\s+jako\\b') END""")
def instruction_phrases(spark, d):
    s = segment.split_sentences(transcripts(spark, d), [*CLIP, "lang"])
    lead = F.when(F.col("n") % 5 == 0, "Use this as ").when(F.col("n") % 5 == 1, "Wytnij ").when(F.col("n") % 5 == 2, "to na ").otherwise("")
    return s.where(rules.is_instruction(F.concat(lead, "text"), F.col("lang"))).select(*CLIP, "n")


@query("crop_origins", """SELECT p_partkey, greatest(0, least((1920 * greatest(least(p_size * 3 - 20, 95), 5) * 2 - 60800) // 200 * 1, 1312)) - greatest(0, least((1920 * greatest(least(p_size * 3 - 20, 95), 5) * 2 - 60800) // 200 * 1, 1312)) % 2 AS x FROM part""")
def crop_origins(spark, d):
    pct = F.col("p_size").cast("bigint") * 3 - 20
    return table(spark, d, "part").select("p_partkey", rules.crop_origin(pct, F.lit(1920).cast("bigint"), F.lit(608).cast("bigint")).alias("x"))


@query("wrap_captions", f"""WITH RECURSIVE {SENT}, s AS (SELECT project_id, clip_id, n, string_split(text, ' ') AS w FROM sent),
f AS (SELECT project_id, clip_id, n, w, 1 AS i, w[1] AS cur, ''::VARCHAR AS line1 FROM s UNION ALL
 SELECT project_id, clip_id, n, w, i + 1, CASE WHEN line1 = '' AND length(cur || ' ' || w[i+1]) > 34 THEN w[i+1] ELSE cur || ' ' || w[i+1] END, CASE WHEN line1 = '' AND length(cur || ' ' || w[i+1]) > 34 THEN cur ELSE line1 END FROM f WHERE i < len(w))
SELECT project_id, clip_id, n, CASE WHEN line1 = '' THEN cur ELSE line1 || chr(10) || cur END AS wrapped FROM f WHERE i = len(w)""")
def wrap_captions(spark, d):
    s = segment.split_sentences(transcripts(spark, d))
    return s.select(*CLIP, "n", rules.wrap_caption(F.col("text")).alias("wrapped"))


@query("place_slugs", "SELECT doc_id, trim(regexp_replace(strip_accents(lower(text)), '[^0-9a-z]+', '-', 'g'), '-') AS slug FROM documents")
def place_slugs(spark, d):
    return table(spark, d, "documents").select("doc_id", slug(F.col("text")).alias("slug"))


@query("fit_and_transition", """SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, CASE WHEN l_partkey % 3 = 0 THEN 'blur-fill' ELSE 'cover' END AS fit, CASE l_returnflag WHEN 'R' THEN 'xfade' WHEN 'A' THEN 'fade' ELSE 'cut' END AS transition, CASE WHEN l_returnflag IN ('R','A') THEN l_suppkey * 10000 ELSE 0 END AS length_us FROM lineitem""")
def fit_and_transition(spark, d):
    kind = F.when(F.col("l_returnflag") == "R", "xfade").when(F.col("l_returnflag") == "A", "fade").otherwise("wipe")
    name, length = rules.transition_rule(kind, F.col("l_suppkey") * 10_000)
    w = F.when(F.col("l_partkey") % 3 == 0, 1080).otherwise(1920)
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", rules.fit_rule(w, F.lit(1920)).alias("fit"), name.alias("transition"), length.alias("length_us"))


@query("even_samples", """WITH b AS (SELECT o_orderkey, o_custkey % 40 AS n FROM orders), p AS (SELECT o_orderkey, n, CASE WHEN n <= 7 THEN range(0, n) ELSE list_distinct([CAST(round_even((n - 1) * i / 6.0::DOUBLE, 0) AS BIGINT) for i in range(0, 7)]) END AS l FROM b)
SELECT o_orderkey, n, array_to_string(list_sort(l), ',') AS picks FROM p""")
def even_samples(spark, d):
    n = F.col("o_custkey") % 40
    return table(spark, d, "orders").select("o_orderkey", n.alias("n"), F.array_join(F.transform(rules.even_sample(n, 7), lambda x: x.cast("string")), ",").alias("picks"))


PLACES = """pl AS (SELECT source AS project_id, doc_id AS pos, CASE WHEN doc_id % 4 <> 0 THEN 'NATION_' || doc_id % 25 END AS name, 'City' || doc_id % 2 AS city, 'X' AS country, (doc_id % 10) / 10.0::DOUBLE AS confidence FROM documents)"""


def places(spark, d):
    k = F.col("doc_id")
    return table(spark, d, "documents").select(
        F.col("source").alias("project_id"), k.alias("pos"), F.when(k % 4 != 0, F.concat(F.lit("NATION_"), (k % 25).cast("string"))).alias("name"),
        F.concat(F.lit("City"), (k % 2).cast("string")).alias("city"), F.lit("X").alias("country"), ((k % 10) / F.lit(10.0)).alias("confidence"))


GROUPS = f"""{PLACES}, g AS (SELECT project_id, name, city, country, min(pos) AS first_pos, count(*) AS clips FROM pl WHERE name IS NOT NULL GROUP BY ALL), gr AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY first_pos) - 1 AS group_id FROM g)"""


@query("place_groups", f"WITH {GROUPS} SELECT * FROM gr")
def place_groups(spark, d):
    return cat.place_groups(places(spark, d))


@query("assign_places", f"""WITH {GROUPS}, a AS (SELECT project_id, group_id, first_pos % 3 AS r, 'p' || group_id || '-' || first_pos % 3 AS place_id FROM gr WHERE group_id % 4 <> 0)
SELECT gr.project_id, gr.group_id, name, coalesce(a.place_id, trim(regexp_replace(lower(name), '[^0-9a-z]+', '-', 'g'), '-')) AS place_id, CASE WHEN a.place_id IS NULL THEN name ELSE 'Label ' || gr.group_id END AS label FROM gr LEFT JOIN a USING (project_id, group_id)""")
def assign_places(spark, d):
    g = cat.place_groups(places(spark, d))
    a = g.where(F.col("group_id") % 4 != 0).select("project_id", "group_id", F.explode(F.sequence(F.lit(0), (F.col("first_pos") % 3).cast("int"))).alias("answer_pos")).select(
        "project_id", "group_id", "answer_pos", F.concat(F.lit("p"), F.col("group_id").cast("string"), F.lit("-"), F.col("answer_pos").cast("string")).alias("place_id"), F.concat(F.lit("Label "), F.col("group_id").cast("string")).alias("label"))
    return cat.assign_places(g, a)


@query("inherit_places", f"""WITH {PLACES}, n AS (SELECT * FROM pl WHERE name IS NOT NULL)
SELECT project_id, pos, name AS place, confidence, CASE WHEN name IS NOT NULL THEN name WHEN confidence < 0.5 THEN (SELECT min_by(n.name, (abs(n.pos - pl.pos), n.pos)) FROM n WHERE n.project_id = pl.project_id) END AS resolved FROM pl""")
def inherit_places(spark, d):
    return cat.inherit_places(places(spark, d).select("project_id", "pos", F.col("name").alias("place"), "confidence"))


@query("uncovered_music", f"""WITH {PLACED}, {MUTES}, fl AS (SELECT l.doc_id AS clip_id, l.doc_id AS flag, l.doc_id % 6 * 1000000 AS s_us, l.doc_id % 6 * 1000000 + 2500000 AS e_us FROM labels l),
mu AS (SELECT *, -(mute % 3) * 6 AS gain_db FROM mutes), u AS (SELECT project_id, pos, p.clip_id, flag, greatest(in_us, s_us) AS us, least(out_us, e_us) AS ue FROM placed p JOIN fl ON fl.clip_id = p.clip_id AND s_us < out_us AND e_us > in_us),
c AS (SELECT u.project_id, u.pos, u.clip_id, u.flag, ue - us AS used_us, least(coalesce(sum(least(ue, m.e_us) - greatest(us, m.s_us)) FILTER (WHERE m.clip_id IS NOT NULL), 0), ue - us)::BIGINT AS covered_us FROM u LEFT JOIN mu m ON m.clip_id = u.clip_id AND gain_db <= -6 AND m.s_us < ue AND m.e_us > us GROUP BY u.project_id, u.pos, u.clip_id, u.flag, us, ue)
SELECT * FROM c WHERE covered_us * 100 < used_us * 90""")
def uncovered_music(spark, d):
    k = F.col("doc_id")
    flags = table(spark, d, "labels").select(k.alias("clip_id"), k.alias("flag"), (k % 6 * 1_000_000).alias("s_us"), (k % 6 * 1_000_000 + 2_500_000).alias("e_us"))
    return cat.uncovered_music(flags, placed(spark, d), mutes(spark, d).withColumn("gain_db", -(F.col("mute") % 3) * 6))


@query("match_styles", f"""WITH w AS (SELECT page_id AS request, unnest(list_distinct(list_filter(regexp_split_to_array(lower(html), '[^a-z0-9]+'), lambda x: length(x) > 2))) AS tok FROM pages),
st(style, tags) AS (VALUES ('calm-road', ['the','and','calm']), ('bright-div', ['div','class','bright']), ('night', ['href','span','night'])),
sc AS (SELECT request, style, sum(p) AS half_points FROM (SELECT request, style, 2 AS p FROM w JOIN (SELECT style, unnest(tags) AS tok FROM st) USING (tok) UNION ALL SELECT request, style, 1 FROM w JOIN st ON contains(replace(style, '-', ''), tok)) GROUP BY ALL),
b AS (SELECT *, row_number() OVER (PARTITION BY request ORDER BY half_points DESC, style) AS r FROM sc) SELECT page_id AS request, coalesce(style, 'calm-road') AS style, coalesce(half_points, 0)::BIGINT AS half_points FROM pages LEFT JOIN b ON b.request = page_id AND r = 1""")
def match_styles(spark, d):
    toks = F.filter(F.split(F.lower("html"), "[^a-z0-9]+"), lambda x: F.length(x) > 2)
    req = table(spark, d, "pages").select(F.col("page_id").alias("request"), toks.alias("tokens"))
    styles = spark.createDataFrame([("calm-road", ["the", "and", "calm"]), ("bright-div", ["div", "class", "bright"]), ("night", ["href", "span", "night"])], "style string, tags array<string>")
    return cat.match_styles(req, styles, fallback="calm-road")


BOUND = f"""{PLACED.replace("placed AS (", "pictured AS (")}, {SOUNDED.replace("FROM placed", "FROM pictured")}, placed AS (SELECT project_id, pos, end_us, muted, a_clip AS clip_id, a_in AS in_us, a_out AS out_us FROM heard), {WORDS}, e AS (SELECT * FROM (SELECT *, lead(pos) OVER w AS b_pos, lead(clip_id) OVER w AS b_clip, lead(in_us) OVER w AS b_in, lead(out_us) OVER w AS b_out, lead(muted) OVER w AS b_muted FROM placed WINDOW w AS (PARTITION BY project_id ORDER BY pos))
 WHERE b_pos IS NOT NULL AND NOT (clip_id = b_clip AND abs(b_in - out_us) <= 33334 AND NOT muted AND NOT b_muted) AND NOT (muted AND b_muted)),
la AS (SELECT e.project_id, e.pos, max_by(struct_pack(t := w.text, s := w.s_us, e := w.e_us), w.s_us) AS a FROM e JOIN words w ON NOT e.muted AND w.clip_id = e.clip_id AND w.s_us < e.out_us AND w.e_us > e.in_us GROUP BY ALL),
fb AS (SELECT e.project_id, e.pos, min_by(struct_pack(t := w.text, s := w.s_us, e := w.e_us), w.s_us) AS b FROM e JOIN words w ON NOT e.b_muted AND w.clip_id = e.b_clip AND w.s_us < e.b_out AND w.e_us > e.b_in GROUP BY ALL),
bd AS (SELECT e.project_id, e.pos, end_us AS at_us, a.t AS last_word, out_us - a.e AS out_margin_us, b.t AS first_word, b.s - b_in AS in_margin_us, CASE WHEN clip_id = b_clip AND NOT muted AND NOT b_muted THEN greatest(out_us - b_in, 0) ELSE 0 END AS replayed_us,
 coalesce(a.s < out_us - 20000 AND a.e > out_us + 20000, false) AS f1, coalesce(b.s < b_in - 20000 AND b.e > b_in + 20000, false) AS f2 FROM e LEFT JOIN la ON la.project_id = e.project_id AND la.pos = e.pos LEFT JOIN fb ON fb.project_id = e.project_id AND fb.pos = e.pos)"""
BFLAGS = "list_filter([CASE WHEN f1 THEN 'out inside word' END, CASE WHEN f2 THEN 'in inside word' END, CASE WHEN replayed_us > 50000 THEN 'replayed' END], lambda x: x IS NOT NULL)"


@query("cut_boundaries", f"WITH {BOUND} SELECT project_id, pos, at_us, last_word, out_margin_us, first_word, in_margin_us, replayed_us, array_to_string({BFLAGS}, ',') AS flags FROM bd")
def cut_boundaries(spark, d):
    return cat.cut_boundaries(sounded(spark, d), words(spark, d)).withColumn("flags", F.array_join("flags", ","))


@query("boundary_flag_counts", f"WITH {BOUND}, x AS (SELECT project_id, pos, unnest({BFLAGS}) AS flag FROM bd) SELECT flag, count(*) AS boundaries FROM x GROUP BY 1")
def boundary_flag_counts(spark, d):
    b = cat.cut_boundaries(sounded(spark, d), words(spark, d))
    return b.select(F.explode("flags").alias("flag")).groupBy("flag").agg(F.count("*").alias("boundaries"))


@query("render_context", f"""WITH {WORDS}, q AS (SELECT o_orderkey AS query, o_orderkey % (SELECT count(*) FROM documents) AS clip_id, o_custkey * 9973 AS at_us FROM orders),
g AS (SELECT q.*, (SELECT max(e_us) FROM words w WHERE w.clip_id = q.clip_id AND e_us <= at_us + 50000) AS be, (SELECT min(s_us) FROM words w WHERE w.clip_id = q.clip_id AND s_us >= at_us - 50000) AS a_s,
 EXISTS (SELECT 1 FROM words w WHERE w.clip_id = q.clip_id AND s_us < at_us - 80000 AND e_us > at_us + 80000) AS chopped FROM q)
SELECT query, clip_id, at_us, CASE WHEN be > at_us - 2500000 AND a_s < at_us + 2500000 THEN a_s - be END AS gap_us, chopped, coalesce(be > at_us - 2500000 AND a_s < at_us + 2500000 AND a_s - be < 350000, false) AS no_air FROM g""")
def render_context(spark, d):
    q = table(spark, d, "orders").select(F.col("o_orderkey").alias("query"), (F.col("o_orderkey") % clips(spark, d)).alias("clip_id"), (F.col("o_custkey") * 9_973).alias("at_us"))
    return cat.render_context(q, words(spark, d).select("clip_id", "s_us", "e_us"), ["clip_id"], "at_us")


@query("clamp_times", """WITH s AS (SELECT doc_id AS clip_id, i, s, e, 12000000 + doc_id % 5 * 1000000 AS d FROM documents, LATERAL (VALUES (0, (doc_id%7*2000+1000)*1000, (doc_id%7*2000+2500)*1000), (1, (doc_id%7*9000+30000)*1000, (doc_id%7*9000+31000-doc_id%7*400)*1000)) v(i, s, e))
SELECT clip_id, i, least(s, d) AS s_us, greatest(least(e, d), least(s, d)) AS e_us FROM s""")
def clamp_times(spark, d):
    lim = F.lit(12_000_000) + F.col("clip_id") % 5 * 1_000_000
    fix = F.transform("instructions", lambda x: F.struct(F.least(x["s_us"], lim).alias("s_us"), F.greatest(F.least(x["e_us"], lim), F.least(x["s_us"], lim)).alias("e_us")))
    return analysis(spark, d).select("clip_id", F.posexplode(fix).alias("i", "x")).select("clip_id", "i", "x.s_us", "x.e_us")

"""Words, sentences, cues and repeated speech over the documents."""

from __future__ import annotations

from pyspark.sql import functions as F

from dailies.functions import text as tx
from dailies.functions.arith import idiv
from dailies.operators import dedupe, segment
from dailies.workload.adapter import TOKENS, WORDS, table, transcripts, words
from dailies.workload.registry import query

CLIP = ["project_id", "clip_id"]
ENDS = "right(trim({}), 1) IN ('.', '?', '!', '…')"


def sentence_cte(name: str = "sent", words: str = "words", fresh: str | None = None) -> str:
    fresh = fresh or f"pe IS NULL OR s_us - pe > 1200000 OR {ENDS.format('pt')}"
    return f"""{name}_l AS (SELECT *, lag(e_us) OVER w AS pe, lag(text) OVER w AS pt FROM {words} WINDOW w AS (PARTITION BY project_id, clip_id ORDER BY pos)),
{name}_n AS (SELECT *, sum(CASE WHEN {fresh} THEN 1 ELSE 0 END) OVER (PARTITION BY project_id, clip_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS n FROM {name}_l),
{name} AS (SELECT project_id, clip_id, n::BIGINT AS n, min(pos) AS first, max(pos) AS last, min(s_us) AS s_us, max(e_us) AS e_us, count(*) AS n_words, string_agg(text, ' ' ORDER BY pos) AS text FROM {name}_n GROUP BY project_id, clip_id, n)"""


SENT = WORDS + ",\n" + sentence_cte()
SETS = SENT + """,
ws AS (SELECT project_id, clip_id, n, clip_id * 1048576 + n AS ord, clip_id || '#' || n AS sentence_id, text,
  list_sort(list_distinct(regexp_extract_all(lower(text), '[\\p{L}\\p{N}\\p{M}_]+'))) AS toks, (clip_id + n) % 11 = 0 AS instruction FROM sent)"""


def sentences(spark, d):
    return segment.sentence_ids(segment.split_sentences(transcripts(spark, d))).withColumns({
        "ord": F.col("clip_id") * 1_048_576 + F.col("n"), "instruction": (F.col("clip_id") + F.col("n")) % 11 == 0,
    })


@query("sentence_split", f"WITH {SENT} SELECT project_id, clip_id, n, first, last, s_us, e_us, n_words, text FROM sent")
def sentence_split(spark, d):
    return segment.split_sentences(transcripts(spark, d))


@query("capped_sentence_split", f"""WITH {WORDS}, {sentence_cte('s1', fresh="pe IS NULL OR s_us - pe > 1200000 OR regexp_matches(pt, '[.!?…]+[\"''”»)\\]]*$')")},
c AS (SELECT s1_n.*, pos - min(pos) OVER (PARTITION BY project_id, clip_id, n) AS k FROM s1_n)
SELECT project_id, clip_id, min(pos) AS first, max(pos) AS last, min(s_us) AS s_us, max(e_us) AS e_us, count(*) AS n_words, string_agg(text, ' ' ORDER BY pos) AS text FROM c GROUP BY project_id, clip_id, n, k // 12""")
def capped_sentence_split(spark, d):
    return segment.split_sentences(transcripts(spark, d), max_words=12, closing=True).drop("n")


@query("sentence_marks", f"WITH {WORDS} SELECT project_id, clip_id, bool_or({ENDS.format('text')}) AS has_marks, count(*) FILTER (WHERE {ENDS.format('text')}) AS n_ends FROM words GROUP BY ALL")
def sentence_marks(spark, d):
    ends = lambda w: tx.ends_sentence(w["text"])
    return transcripts(spark, d).where(F.size("words") > 0).select(
        *CLIP, F.exists("words", ends).alias("has_marks"), F.size(F.filter("words", ends)).alias("n_ends")
    )


NUM = ", ".join(f"('{k}', '{v}')" for k, v in tx.NUMBER_WORDS.items())


def fold_sql(col: str) -> str:
    return f"regexp_replace(strip_accents(lower({col})), '[^0-9a-z]+', '', 'g')"


@query("fold_tokens", f"""WITH {WORDS}, num(w, dgt) AS (VALUES {NUM}), f AS (SELECT {fold_sql('text')} AS bare FROM words)
SELECT coalesce(dgt, bare) AS token, count(*) AS uses FROM f LEFT JOIN num ON bare = w GROUP BY 1""")
def fold_tokens(spark, d):
    return words(spark, d).groupBy(tx.fold_token(F.col("text")).alias("token")).agg(F.count("*").alias("uses"))


@query("sentence_word_sets", f"WITH {SETS} SELECT project_id, clip_id, n, len(toks) AS n_distinct, array_to_string(toks, ' ') AS key FROM ws")
def sentence_word_sets(spark, d):
    return sentences(spark, d).select(*CLIP, "n", F.array_sort(tx.word_set(F.col("text"))).alias("t")).select(
        *CLIP, "n", F.size("t").alias("n_distinct"), F.array_join("t", " ").alias("key")
    )


@query("neighbour_jaccard", f"""WITH {SETS}, p AS (SELECT *, lead(toks) OVER (PARTITION BY project_id, clip_id ORDER BY n) AS nt FROM ws)
SELECT project_id, clip_id, n, CASE WHEN len(toks) + len(nt) = 0 THEN 0.0 ELSE len(list_intersect(toks, nt))::DOUBLE / len(list_distinct(list_concat(toks, nt)))::DOUBLE END AS jaccard FROM p WHERE nt IS NOT NULL""")
def neighbour_jaccard(spark, d):
    from dailies.operators.ordered import running

    sets = sentences(spark, d).select(*CLIP, "n", tx.word_set(F.col("text")).alias("t"))
    near = running(sets, CLIP, ["n"], {"nt": ("lead", F.col("t"))}).where(F.col("nt").isNotNull())
    return near.select(*CLIP, "n", tx.jaccard(F.col("t"), F.col("nt")).alias("jaccard"))


ISO = ", ".join(f"('{k}', '{v}')" for k, v in tx.LANGUAGES.items())


@query("language_check", f"""WITH {TOKENS}, iso(a, b) AS (VALUES {ISO}),
t AS (SELECT project_id, clip_id, len(t) AS n_words, CASE clip_id % 3 WHEN 0 THEN lang WHEN 1 THEN upper(lang) || '_XX' ELSE (SELECT b FROM iso WHERE a = lang) END AS detected, (clip_id % 10) / 10.0::DOUBLE AS prob FROM toks),
c AS (SELECT *, lower(split_part(replace(detected, '_', '-'), '-', 1)) AS code FROM t),
i AS (SELECT c.*, CASE WHEN len(code) = 3 THEN code ELSE coalesce((SELECT b FROM iso WHERE a = code), code) END AS iso3,
  CASE WHEN len(code) = 2 THEN code ELSE coalesce((SELECT a FROM iso WHERE b = code), code) END AS iso1 FROM c)
SELECT project_id, clip_id, iso1, iso3, n_words >= 3 AND prob > 0.6 AND iso1 <> 'en' AS mismatch FROM i""")
def language_check(spark, d):
    clip = F.col("clip_id")
    detected = (
        F.when(clip % 3 == 0, F.col("lang")).when(clip % 3 == 1, F.concat(F.upper("lang"), F.lit("_XX"))).otherwise(tx.to_iso3(F.col("lang")))
    )
    t = transcripts(spark, d).select(*CLIP, F.size("words").alias("n_words"), detected.alias("lang"), ((clip % 10) / F.lit(10.0)).alias("prob"))
    return t.select(
        *CLIP, tx.to_iso1(F.col("lang")).alias("iso1"), tx.to_iso3(F.col("lang")).alias("iso3"),
        tx.language_mismatch(F.col("lang"), F.lit("en"), F.col("prob"), F.col("n_words")).alias("mismatch"),
    )


CUE_STEP = """f AS (SELECT project_id, clip_id, pos, s_us AS st, 1 AS k, 1::BIGINT AS cue, {first_close} AS closed FROM u WHERE rn = 1
 UNION ALL SELECT u.project_id, u.clip_id, u.pos, CASE WHEN {flush} THEN u.s_us ELSE f.st END, CASE WHEN {flush} THEN 1 ELSE f.k + 1 END,
   f.cue + CASE WHEN {flush} THEN 1 ELSE 0 END, {close} FROM f JOIN u ON u.project_id = f.project_id AND u.clip_id = f.clip_id AND u.rn = f.rn + 1)"""


@query("simple_cues", f"""WITH RECURSIVE {WORDS}, u AS (SELECT *, regexp_matches(trim(text), '[.!?…]+["''”»)\\]]*$') AS cl, pos + 1 AS rn FROM words),
f AS (SELECT project_id, clip_id, rn, s_us AS st, 1 AS k, 1::BIGINT AS cue, false AS done FROM u WHERE rn = 1
 UNION ALL SELECT project_id, clip_id, rn, st, k, cue, (k >= 5 OR e_us - st >= 4000000 OR (cl AND k >= 3)) FROM
  (SELECT u.project_id, u.clip_id, u.rn, u.e_us, u.cl, CASE WHEN f.done THEN u.s_us ELSE f.st END AS st, CASE WHEN f.done THEN 1 ELSE f.k + 1 END AS k, f.cue + CASE WHEN f.done THEN 1 ELSE 0 END AS cue
   FROM f JOIN u ON u.project_id = f.project_id AND u.clip_id = f.clip_id AND u.rn = f.rn + 1)),
c AS (SELECT f.project_id, f.clip_id, f.cue, min(u.s_us) AS s, max(u.e_us) AS e, count(*) AS n_words, string_agg(u.text, ' ' ORDER BY u.pos) AS text FROM f JOIN u USING (project_id, clip_id, rn) GROUP BY ALL),
l AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY project_id, clip_id ORDER BY cue), e + 1000000) AS lim FROM c)
SELECT project_id, clip_id, cue, s AS s_us, greatest(CASE WHEN e - s < 1000000 THEN least(greatest(e, s + 1000000), greatest(lim, e)) ELSE e END, s + 50000) AS e_us, n_words, text FROM l""")
def simple_cues(spark, d):
    return segment.simple_cues(words(spark, d))


@query("gap_cues", f"""WITH RECURSIVE {WORDS}, g0 AS (SELECT *, CASE WHEN s_us - lag(e_us) OVER (PARTITION BY project_id, clip_id ORDER BY pos) <= 800000 THEN 0 ELSE 1 END AS fresh FROM words),
g1 AS (SELECT *, sum(fresh) OVER (PARTITION BY project_id, clip_id ORDER BY pos) AS isl FROM g0),
u AS (SELECT *, row_number() OVER (PARTITION BY project_id, clip_id, isl ORDER BY pos) AS rn, regexp_matches(text, '[.!?]$') AS cl FROM g1),
f AS (SELECT project_id, clip_id, isl, rn, s_us AS st, 1 AS k, 1::BIGINT AS cue FROM u WHERE rn = 1
 UNION ALL SELECT project_id, clip_id, isl, rn, CASE WHEN fresh THEN s_us ELSE st END, CASE WHEN fresh THEN 1 WHEN shut THEN 0 ELSE k + 1 END, cue + CASE WHEN fresh THEN 1 ELSE 0 END FROM
  (SELECT u.project_id, u.clip_id, u.isl, u.rn, u.s_us, f.st, f.k, f.cue, (f.k = 0 OR u.e_us - f.st > 4000000 OR f.k >= 5) AS fresh, (f.k >= 3 AND u.cl) AS shut
   FROM f JOIN u ON u.project_id = f.project_id AND u.clip_id = f.clip_id AND u.isl = f.isl AND u.rn = f.rn + 1)),
c AS (SELECT f.project_id, f.clip_id, f.isl, f.cue, min(u.s_us) AS s, max(u.e_us) AS e, count(*) AS n_words, string_agg(u.text, ' ' ORDER BY u.pos) AS text FROM f JOIN u USING (project_id, clip_id, isl, rn) GROUP BY ALL),
l AS (SELECT *, coalesce(lead(s) OVER (PARTITION BY project_id, clip_id ORDER BY s), e + 1000000) AS lim FROM c)
SELECT project_id, clip_id, s AS s_us, least(CASE WHEN e - s < 1000000 THEN least(s + 1000000, greatest(e, lim)) ELSE e END, s + 4000000) AS e_us, n_words, text FROM l""")
def gap_cues(spark, d):
    return segment.gap_cues(words(spark, d))


def keep_flags(spark, d):
    return words(spark, d).select(*CLIP, "pos", "s_us", "e_us", "text", (((F.col("pos") * 7 + F.col("clip_id")) % 13) > 1).alias("keep"))


@query("keep_ranges", f"""WITH {WORDS}, k AS (SELECT *, (pos * 7 + clip_id) % 13 > 1 AS keep FROM words),
l AS (SELECT *, lag(keep) OVER w AS pk, lag(e_us) OVER w AS pe, lead(keep) OVER w AS nk, lead(s_us) OVER w AS ns FROM k WINDOW w AS (PARTITION BY project_id, clip_id ORDER BY pos)),
f AS (SELECT *, sum(CASE WHEN coalesce(pk, false) AND s_us - pe <= 800000 THEN 0 ELSE 1 END) OVER (PARTITION BY project_id, clip_id ORDER BY pos) AS n FROM l WHERE keep),
r AS (SELECT project_id, clip_id, n::BIGINT AS n, min(s_us) AS s, max(e_us) + CASE WHEN bool_or(coalesce(nk AND ns - e_us > 800000, false)) THEN 500000 ELSE 0 END AS e FROM f GROUP BY ALL)
SELECT project_id, clip_id, n, CASE WHEN n = 1 THEN greatest(s - 300000, 0) ELSE s END AS s_us, CASE WHEN n = max(n) OVER (PARTITION BY project_id, clip_id) THEN e + 450000 ELSE e END AS e_us FROM r""")
def keep_ranges(spark, d):
    return segment.keep_ranges(keep_flags(spark, d))


@query("drop_stutters", f"""WITH {WORDS}, k AS (SELECT *, right(rtrim(text), 1) = '-' AS cut, regexp_replace(lower(text), '[^\\p{{L}}\\p{{N}}]', '', 'g') AS norm FROM words),
p AS (SELECT *, lag(norm) OVER (PARTITION BY project_id, clip_id ORDER BY pos) AS pn FROM k WHERE NOT cut)
SELECT project_id, clip_id, pos, 'stutter_cutoff' AS reason FROM k WHERE cut UNION ALL SELECT project_id, clip_id, pos, 'stutter_repeat' FROM p WHERE norm <> '' AND norm = pn""")
def drop_stutters(spark, d):
    return dedupe.drop_stutters(words(spark, d), CLIP).where(F.col("reason").isNotNull()).select(*CLIP, "pos", "reason")


PAIRS = """cls AS (SELECT {scope}, toks, len(toks) AS sz, row_number() OVER () AS cid FROM (SELECT DISTINCT {scope}, toks FROM ws WHERE len(toks) >= {least} {extra})),
inv AS (SELECT {scope}, cid, sz, unnest(toks) AS tok FROM cls),
cmn AS (SELECT a.cid AS x, b.cid AS y, a.sz AS sx, b.sz AS sy, count(*) AS c FROM inv a JOIN inv b ON {on} AND a.tok = b.tok AND a.cid < b.cid AND a.sz * 100 >= b.sz * {pct} AND b.sz * 100 >= a.sz * {pct} GROUP BY ALL),
sim AS (SELECT x, y FROM cmn WHERE c * 100 >= (sx + sy - c) * {pct} UNION ALL SELECT y, x FROM cmn WHERE c * 100 >= (sx + sy - c) * {pct} UNION ALL SELECT cid, cid FROM cls),
m AS (SELECT ws.*, cls.cid FROM ws JOIN cls ON {onc} AND ws.toks = cls.toks)"""


def pairs_sql(scope, least, pct, extra=""):
    cols = [c.strip() for c in scope.split(",")]
    return PAIRS.format(scope=scope, least=least, pct=pct, extra=extra, on=" AND ".join(f"a.{c} = b.{c}" for c in cols),
                        onc=" AND ".join(f"ws.{c} = cls.{c}" for c in cols))


@query("near_duplicates", f"""WITH {SETS}, {pairs_sql('project_id', 4, 70)},
h AS (SELECT p.project_id, p.ord, min_by(q.sentence_id, q.ord) AS duplicate_of FROM m p JOIN sim ON sim.x = p.cid JOIN m q ON q.cid = sim.y AND q.ord > p.ord AND NOT q.instruction GROUP BY ALL)
SELECT * FROM h""")
def near_duplicates(spark, d):
    return dedupe.near_duplicates(sentences(spark, d))


@query("superseded_takes", f"""WITH {SETS}, {pairs_sql('project_id, clip_id', 1, 60, 'AND NOT instruction')}
SELECT DISTINCT p.project_id, p.clip_id, p.ord, p.sentence_id FROM m p JOIN sim ON sim.x = p.cid JOIN m q ON q.cid = sim.y AND q.ord > p.ord AND NOT q.instruction WHERE NOT p.instruction""")
def superseded_takes(spark, d):
    return dedupe.superseded_takes(sentences(spark, d), CLIP)


@query("repeats_of_first_take", f"""WITH RECURSIVE {SETS}, {pairs_sql('project_id, clip_id', 1, 60, 'AND NOT instruction')},
s AS (SELECT *, row_number() OVER (PARTITION BY project_id, clip_id ORDER BY ord) AS rn FROM m WHERE NOT instruction),
e AS (SELECT q.project_id, q.clip_id, q.ord, q.rn, p.ord AS po FROM s p JOIN sim ON sim.x = p.cid JOIN s q ON q.cid = sim.y AND q.ord > p.ord),
nb AS (SELECT s.project_id, s.clip_id, s.ord, s.rn, s.sentence_id, coalesce(list(e.po) FILTER (WHERE e.po IS NOT NULL), []) AS near FROM s LEFT JOIN e ON s.ord = e.ord GROUP BY ALL),
f AS (SELECT DISTINCT project_id, clip_id, 0::BIGINT AS rn, []::BIGINT[] AS kept, NULL::VARCHAR AS sentence_id, NULL::BIGINT AS ord, true AS keep FROM nb
 UNION ALL SELECT nb.project_id, nb.clip_id, nb.rn, CASE WHEN list_has_any(f.kept, nb.near) THEN f.kept ELSE list_append(f.kept, nb.ord) END, nb.sentence_id, nb.ord, NOT list_has_any(f.kept, nb.near)
  FROM f JOIN nb ON nb.project_id = f.project_id AND nb.clip_id = f.clip_id AND nb.rn = f.rn + 1)
SELECT project_id, clip_id, ord, sentence_id FROM f WHERE NOT keep""")
def repeats_of_first_take(spark, d):
    return dedupe.repeats_of_first_take(sentences(spark, d), CLIP)


FOLDED = WORDS + f""", num(w, dgt) AS (VALUES {NUM}), fd AS (SELECT project_id, clip_id, pos, s_us, e_us, text, coalesce(dgt, bare) AS tok FROM (SELECT *, {fold_sql('text')} AS bare FROM words) LEFT JOIN num ON bare = w),
fw AS (SELECT *, row_number() OVER (PARTITION BY project_id, clip_id ORDER BY pos) - 1 AS i, count(*) OVER (PARTITION BY project_id, clip_id) AS n FROM fd WHERE tok <> ''),
gr AS (SELECT project_id, clip_id, i, n, s_us, tok || ' ' || lead(tok, 1) OVER w || ' ' || lead(tok, 2) OVER w || ' ' || lead(tok, 3) OVER w AS gram FROM fw WINDOW w AS (PARTITION BY project_id, clip_id ORDER BY i)),
sd AS (SELECT project_id, clip_id, i AS a, lead(i) OVER w AS b, s_us, lead(s_us) OVER w AS bs FROM gr WHERE gram IS NOT NULL AND n >= 8 WINDOW w AS (PARTITION BY project_id, clip_id, gram ORDER BY i)),
seeds AS (SELECT project_id, clip_id, a, b FROM sd WHERE b - a >= 4 AND bs - s_us <= 60000000)"""


@query("repeated_grams", f"WITH {FOLDED} SELECT * FROM seeds")
def repeated_grams(spark, d):
    return dedupe.repeated_grams(dedupe.folded_words(transcripts(spark, d))).drop("gram_at")


@query("grown_repeats", f"""WITH RECURSIVE {FOLDED}, arr AS (SELECT project_id, clip_id, list(tok ORDER BY i) AS t FROM fw GROUP BY ALL),
g AS (SELECT s.project_id, s.clip_id, a, b, 4 AS len, 0 AS bk, false AS fdone, t FROM seeds s JOIN arr USING (project_id, clip_id)
 UNION ALL SELECT project_id, clip_id, a, b, CASE WHEN fwd THEN len + 1 ELSE len END, CASE WHEN fwd THEN bk ELSE bk + 1 END, NOT fwd, t FROM
  (SELECT *, NOT fdone AND a + len < b AND b + len < len(t) AND t[a + len + 1] = t[b + len + 1] AS fwd, a - bk - 1 >= 0 AND b - bk - 1 >= a + len AND t[a - bk] = t[b - bk] AS bwd FROM g) WHERE fwd OR bwd)
SELECT project_id, clip_id, a - bk AS a, b - bk AS b, max(len + bk)::INTEGER AS len FROM (SELECT *, row_number() OVER (PARTITION BY project_id, clip_id, a, b ORDER BY len + bk DESC) AS r FROM g) WHERE r = 1 GROUP BY project_id, clip_id, a, b, bk""")
def grown_repeats(spark, d):
    docs = dedupe.folded_words(transcripts(spark, d))
    return dedupe.grown_repeats(docs, dedupe.repeated_grams(docs)).select(*CLIP, "a", "b", "len")


@query("repeated_takes")
def repeated_takes(spark, d):
    docs = dedupe.folded_words(transcripts(spark, d))
    return dedupe.take_groups(docs, dedupe.repeated_grams(docs))


@query("cue_text", f"""WITH {SENT}, m AS (SELECT *, (s_us + 500) // 1000 AS sm, (e_us + 500) // 1000 AS em FROM sent)
SELECT project_id, clip_id, string_agg(n || chr(10) || printf('%02d:%02d:%02d,%03d', sm // 3600000, sm % 3600000 // 60000, sm % 60000 // 1000, sm % 1000) || ' --> ' ||
 printf('%02d:%02d:%02d,%03d', em // 3600000, em % 3600000 // 60000, em % 60000 // 1000, em % 1000) || chr(10) || text || chr(10), chr(10) ORDER BY n) AS srt FROM m GROUP BY ALL""")
def cue_text(spark, d):
    from dailies.sources.sinks import srt_documents

    return srt_documents(segment.split_sentences(transcripts(spark, d)), CLIP, "n")

"""Secret scans with linking of multipart credentials."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dailies.llm.common import join_keyed, keyed
from dailies.session import materialize

#: Base patterns; leftmost, not overlapping within a kind. A look-ahead spares the alternation where no name can begin.
ASSIGN = r"""(?=[pstaPSTA])(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]{16,}"
#: The method's parts, weak alone: identifiers and hosts of services, and keys of mixed signs.
IDENTIFIER = r"(?=[AGacu])(?:ASIA[A-Z0-9]{8,}|AIza[A-Za-z0-9_-]{16,}|(?i:access_?key_?id|client_?id|user_?name)[\"']?\x20*[:=]\x20*[\"']?[A-Za-z0-9+/_.@-]{4,})"
ENDPOINT = r"(?=[fhmprsw])(?:https?|ftp|mongodb|mysql|postgres|redis|s3|wss?)://[A-Za-z0-9._~:@%-]+"
KINDS = ("assign", "access", "hex", "identifier", "weak_secret", "endpoint")
#: Code points between parts that can still belong together.
SCOPE = 200
MIN_ASSIGN, MIN_ACCESS, WEAK_ACCESS, WEAK_ASSIGN = 12, 18, 12, 6


def _cuts(text: Column, pattern: str, kind: int) -> Column:
    """Matches of a pattern in order as (kind, nth, gap, length, value): gap is the code points since the match before.

    The pieces between matches and the matches alternate, so their lengths give every place without a position function.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    pieces = F.when(F.size(found) > 0, F.split(text, pattern, -1))
    return F.transform(
        found,
        lambda m, i: F.struct(
            F.lit(kind).alias("kind"), i.alias("nth"), F.length(F.get(pieces, i)).alias("gap"), F.length(m).alias("length"),
            F.length(F.regexp_extract(m, ASSIGN, 1)).alias("value") if kind == 0 else F.length(m).alias("value"),
        ),
    )


def _parts(docs: DataFrame) -> DataFrame:
    """Every match with its place: doc_id, h, copies, kind (null: none in the text), start, end, value."""
    patterns = {0: ASSIGN, 1: ACCESS, 2: HEX, 3: IDENTIFIER, 5: ENDPOINT}
    cuts = F.concat(*[_cuts(F.col("text"), p, k) for k, p in patterns.items()])
    rows = keyed(docs).select("doc_id", "h", F.explode_outer(cuts).alias("m")).select("doc_id", "h", "m.*")
    rows = rows.groupBy("doc_id", "h", "kind", "nth", "gap", "length", "value").agg(F.count("*").alias("copies"))
    before = Window.partitionBy("doc_id", "h", "kind").orderBy("nth")
    end = F.sum(F.col("gap") + F.col("length")).over(before)
    return rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("length")).select("doc_id", "h", "copies", "kind", "start", "end", "value")


def secret_scan(docs: DataFrame, scope: int = SCOPE) -> DataFrame:
    """Secrets in the whole text of each row of ``docs`` (doc_id, text): one row per row.

    Base spans stand alone: assignments whose value has 12 signs, AKIA keys of 18, hex runs of 16. Weak candidates
    (shorter values and AKIA keys, other identifiers, endpoints) are parts of a credential only together: an
    identifier and a secret are reported when one begins at most ``scope`` code points after the other's end (also
    where they overlap or one lies in the other), an endpoint when it is as near to both. Base spans count as parts:
    access keys as identifiers, assignments and hex runs as secrets. Parts meet in an equi-join on cells of ``scope``
    code points, so no two distant parts are paired; a span is posted to as many cells as it and its scope cover.

    Returns doc_id, n_assign, n_access, n_hex, base_spans and spans (arrays of kind, start, end; code points, end
    exclusive; by start, then kind in the order of KINDS). Null text is empty; repeated rows each give a row; an
    empty table gives none.
    """
    parts = _parts(docs)
    value, long_ = F.col("value"), F.col("end") - F.col("start")
    kind = (
        F.when((F.col("kind") == 0) & (value < MIN_ASSIGN), F.when(value >= WEAK_ASSIGN, 4))
        .when((F.col("kind") == 1) & (long_ < MIN_ACCESS), F.when(long_ >= WEAK_ACCESS, 3)).otherwise(F.col("kind"))
    )
    parts = materialize(parts.select("doc_id", "h", "copies", kind.alias("kind"), "start", "end"))
    role = F.when(F.col("kind").isin(1, 3), "identifier").when(F.col("kind") == 5, "endpoint").otherwise("secret")
    own = parts.filter(F.col("kind").isNotNull()).select("doc_id", "h", "kind", "start", "end", role.alias("role"))
    # the first cell that two spans share is that of the later start, so only there does the later one of a pair wait
    cells = F.sequence(F.floor(F.col("start") / scope), F.floor((F.col("end") + scope) / scope))
    left = own.select("doc_id", "h", F.struct("kind", "start", "role").alias("a"), F.col("end").alias("a_end"), F.explode(cells).alias("cell"))
    right = own.select("doc_id", "h", F.struct("kind", "start", "role").alias("b"), F.floor(F.col("start") / scope).alias("cell"))
    later = (F.col("b.start") > F.col("a.start")) | ((F.col("b.start") == F.col("a.start")) & (F.col("b.kind") > F.col("a.kind")))
    near = F.col("b.start") - F.col("a_end") <= scope  # below 0 where they overlap or nest
    pairs = join_keyed(left, right, names=("doc_id", "h", "cell")).filter(later & near & (F.col("a.role") != F.col("b.role")))
    sides = F.explode(F.array(F.struct(F.col("a").alias("me"), F.col("b.role").alias("other")), F.struct(F.col("b").alias("me"), F.col("a.role").alias("other")))).alias("x")
    met = pairs.select("doc_id", "h", sides).select("doc_id", "h", "x.me.kind", "x.me.start", "x.me.role", "x.other").filter(F.col("kind") > 2)
    met = met.groupBy("doc_id", "h", "kind", "start", "role").agg(F.collect_set("other").alias("others"))
    wanted = F.when(F.col("role") == "identifier", F.array_contains("others", "secret")).when(F.col("role") == "secret", F.array_contains("others", "identifier"))
    wanted = wanted.otherwise(F.array_contains("others", "secret") & F.array_contains("others", "identifier"))
    linked = met.filter(wanted).select("doc_id", "h", "kind", "start", F.lit(True).alias("linked"))
    rows = join_keyed(parts, linked, "left", ("doc_id", "h", "kind", "start"))
    base = F.col("kind") <= 2
    span = F.struct("start", "kind", "end")

    def ordered(spans: Column) -> Column:
        return F.transform(F.sort_array(spans), lambda x: F.struct(F.get(F.lit(list(KINDS)), x["kind"]).alias("kind"), x["start"].alias("start"), x["end"].alias("end")))

    out = rows.groupBy("doc_id", "h").agg(
        F.max("copies").alias("copies"), *[F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{KINDS[k]}") for k in range(3)],
        ordered(F.collect_list(F.when(base, span))).alias("base_spans"), ordered(F.collect_list(F.when(base | F.col("linked"), span))).alias("spans"),
    )
    return out.select("doc_id", "n_assign", "n_access", "n_hex", "base_spans", "spans", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy")).drop("copy")

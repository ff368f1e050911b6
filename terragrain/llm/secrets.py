"""Secret scans with corpus-wide ownership frequency.

Patterns give candidates and their places. The candidates' hashes are then counted over the whole
corpus, by distinct repositories and owners: a value that several owners hold, or that its owner has
in many repositories, is a copied example; one that keeps to its owner and to few repositories and
looks random is taken for a live credential. That tells examples from credentials among the pattern
matches, and adds bare tokens that no keyword announces.

A document is a repository and its source the owner; copies of a text are one repository.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import hot_keys, keep, materialise, scratch, split_join

# Kind, pattern, group that is the secret, least length of the secret.
# A run of hexadecimal digits or token characters is matched from its start and as a whole.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    ("access", r"AKIA[A-Z0-9]+", 0, 16),
    ("hex", r"(?<![0-9a-f])[0-9a-f]{32,}+", 0, 32),
    ("owned", r"(?<![A-Za-z0-9_+/-])[A-Za-z0-9_+/-]{20,}+", 0, 20),
)
#: From so many owners, or repositories, on a value is a widely copied example.
EXAMPLE_OWNERS, EXAMPLE_REPOSITORIES = 3, 20
#: Different characters that a random-looking value has, at least.
LIVE_CHARACTERS = 8


def _matches(text: Column, pattern: str, group: int) -> Column:
    """Every match: gap (characters since the last match), width, value. Only texts that match are split."""
    whole, own = F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), F.regexp_extract_all(text, F.lit(pattern), F.lit(group))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(whole))
    each = F.transform(F.arrays_zip(gaps.alias("g"), whole.alias("w"), own.alias("v")), lambda x: F.struct(F.length(x["g"]).alias("gap"), F.length(x["w"]).alias("width"), x["v"].alias("value")))
    none = F.array().cast("array<struct<gap:int,width:int,value:string>>")
    return F.when(F.regexp_like(text, F.lit(pattern)), each).otherwise(none)


def looks_live(value: Column) -> Column:
    """Whether a value looks random: digits and letters, and many different characters."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= LIVE_CHARACTERS)


def candidates(docs: DataFrame, text: str = "text", owner: str = "source") -> tuple[DataFrame, DataFrame]:
    """All rows (row_id, doc_id), and all candidates (row_id, repository, owner, kind, start, end, value)."""
    scanned = docs.select("doc_id", F.col(owner).alias("owner"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    found = scanned.select(F.monotonically_increasing_id().alias("row_id"), "doc_id", "owner", F.xxhash64("t").alias("repository"), *[_matches(F.col("t"), p, g).alias(kind) for kind, p, g, _ in KINDS])
    found = materialise(found, "secret-matches")
    each = found.select("row_id", "repository", "owner", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), F.col(kind).alias("matches")) for k, (kind, *_) in enumerate(KINDS)])).alias("s"))
    each = each.where(F.size("s.matches") > 0).select("row_id", "repository", "owner", F.col("s.kind").alias("kind"), F.posexplode("s.matches").alias("k", "m"))
    so_far = Window.partitionBy("row_id", "kind").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    placed = each.withColumn("end", F.sum(F.col("m.gap") + F.col("m.width")).over(so_far))
    least = F.element_at(F.array(*[F.lit(n) for *_, n in KINDS]), F.col("kind") + 1)
    kept = placed.where(F.length("m.value") >= least)
    return found.select("row_id", "doc_id"), kept.select("row_id", "repository", "owner", "kind", (F.col("end") - F.col("m.width")).alias("start"), "end", F.col("m.value").alias("value"))


def ownership(found: DataFrame) -> DataFrame:
    """Per candidate hash: owners (null is one), repositories and n (candidates); counts are summed before they are dealt."""
    by_repository = found.groupBy("hash", "owner", "repository").agg(F.count(F.lit(1)).alias("n"))
    by_owner = by_repository.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("repositories"), F.sum("n").alias("n"))
    # A text that several owners have is a repository of each.
    return by_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("repositories").alias("repositories"), F.sum("n").alias("n"))


def is_example(owners: Column, repositories: Column) -> Column:
    return (owners >= EXAMPLE_OWNERS) | (repositories >= EXAMPLE_REPOSITORIES)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(kind) for kind, *_ in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_secrets(docs: DataFrame) -> DataFrame:
    """Per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_example, n_live.

    Null text is empty; documents without a match have zero counts and no spans; repeated rows are
    scanned each, but equal texts of an owner are one repository; a null source is one owner.
    ``owned`` spans, the method's own, are bare tokens that overlap no other match, look live, and are
    no example: fewer than EXAMPLE_OWNERS owners and EXAMPLE_REPOSITORIES repositories have them.
    An empty table gives an empty result.
    """
    with scratch(docs.sparkSession):
        return keep(_scan(docs), "secrets")


def _scan(docs: DataFrame) -> DataFrame:
    rows, found = candidates(docs)
    found = materialise(found.withColumn("hash", F.xxhash64("value")), "secret-candidates")
    owned = materialise(ownership(found), "secret-owners")
    judged = split_join(found, owned.drop("n"), ["hash"], "row_id", hot_keys(owned, ["hash"])).withColumn("example", is_example(F.col("owners"), F.col("repositories")))
    bare = len(KINDS) - 1
    spread = Window.partitionBy("row_id").orderBy("start", "kind")
    # A bare token inside or around another match is that match: these are disjoint by kind, so the ends so far and the next starts tell.
    ends = F.max(F.when(F.col("kind") != bare, F.col("end"))).over(spread.rowsBetween(Window.unboundedPreceding, 0))
    starts = F.min(F.when(F.col("kind") != bare, F.col("start"))).over(spread.rowsBetween(0, Window.unboundedFollowing))
    apart = judged.withColumn("ends", ends).withColumn("starts", starts)
    overlaps = F.coalesce(F.col("ends") > F.col("start"), F.lit(False)) | F.coalesce(F.col("starts") < F.col("end"), F.lit(False))
    kept = apart.where((F.col("kind") != bare) | (~overlaps & ~F.col("example") & looks_live(F.col("value"))))
    spans = F.sort_array(F.collect_list(F.struct("start", "kind", "end")))
    live = ~F.col("example") & looks_live(F.col("value"))
    by_row = kept.groupBy("row_id").agg(spans.alias("all"), F.count_if("example").alias("n_example"), F.count_if(live).alias("n_live"))
    base = F.filter("all", lambda s: s["kind"] != bare)
    count = lambda k: F.coalesce(F.size(F.filter("all", lambda s: s["kind"] == k)), F.lit(0)).cast("long")
    none = F.array().cast("array<struct<start:bigint,kind:int,end:bigint>>")
    return (
        rows.join(by_row, "row_id", "left").withColumn("all", F.coalesce("all", none))
        .select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(_joined(base), 256).alias("base_sha256"), _joined(F.col("all")).alias("spans"), F.coalesce("n_example", F.lit(0)).alias("n_example"), F.coalesce("n_live", F.lit(0)).alias("n_live"))
    )


def _sql_kind(k: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
  SELECT rid, source, copy, {k} AS kind, unnest(range(1, len(w) + 1)) AS i, g, w, v, {least} AS least FROM (
    SELECT rid, source, copy, string_split_regex(t, '{quoted}') AS g, regexp_extract_all(t, '{quoted}', 0) AS w, regexp_extract_all(t, '{quoted}', {group}) AS v
    FROM d WHERE regexp_matches(t, '{quoted}'))"""


SQL = (
    "WITH d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t, md5(coalesce(text, '')) AS copy FROM documents),\nm AS ("
    + "\n  UNION ALL".join(_sql_kind(k, p.replace("(?<![0-9a-f])", "").replace("(?<![A-Za-z0-9_+/-])", "").replace("}+", "}"), g, n) for k, (_, p, g, n) in enumerate(KINDS))
    + """),
p AS (
  SELECT rid, source, copy, kind, v[i] AS value, least, length(w[i]) AS width,
         sum(length(g[i]) + length(w[i])) OVER (PARTITION BY rid, kind ORDER BY i) AS fin FROM m),
c AS (SELECT rid, source, copy, kind, value, CAST(fin - width AS BIGINT) AS start, CAST(fin AS BIGINT) AS fin FROM p WHERE length(value) >= least),
o AS (SELECT value, count(DISTINCT {'s': source}) AS owners, count(DISTINCT {'s': source, 'c': copy}) AS repositories FROM c GROUP BY value),
j AS (
  SELECT c.*, owners >= 3 OR repositories >= 20 AS example,
    regexp_matches(c.value, '[0-9]') AND regexp_matches(c.value, '[A-Za-z]') AND len(list_distinct(string_split(c.value, ''))) >= 8 AS live
  FROM c JOIN o USING (value)),
s AS (
  SELECT * FROM j WHERE kind <> 3 OR (live AND NOT example AND NOT EXISTS (
    SELECT 1 FROM j b WHERE b.rid = j.rid AND b.kind <> 3 AND b.start < j.fin AND b.fin > j.start))),
r AS (
  SELECT rid, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || fin, ',' ORDER BY start, kind) AS spans,
    string_agg(['assign', 'access', 'hex', 'owned'][kind + 1] || ':' || start || ':' || fin, ',' ORDER BY start, kind) FILTER (kind <> 3) AS base,
    count(*) FILTER (example) AS n_example, count(*) FILTER (live AND NOT example) AS n_live
  FROM s GROUP BY rid)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_example, 0) AS n_example, coalesce(n_live, 0) AS n_live
FROM d LEFT JOIN r USING (rid)
"""
)

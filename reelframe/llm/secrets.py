"""Secret scans (operator 2): an incremental ledger of scanned blobs, with DataFrame functions only.

A history holds versions of texts under paths. A version's text is a blob, known by its content address (SHA-256).
The ledger tells for each pair of blob and rule version that was scanned the spans found, also where there are none; a
scan appends one row for each blob that had pairs missing, with those pairs alone. So a new version of a text is scanned by
every rule, and a new rule, or a new version of one, scans the known blobs by itself. Findings then join back to every path
and version that holds the blob. Scans that race may leave a pair twice; it counts once.

Spans come from splitting a text at a rule's matches: lengths of what lies between and of the matches add up to
code-point offsets, in two linear passes of the regular expression and without Python.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reelframe.llm.common import documents, let, shared_dir


@dataclass(frozen=True)
class Rule:
    """A kind of secret. A match counts if its group (0: whole) has at least so many characters."""

    kind: str
    version: int
    pattern: str
    group: int
    least: int


# The kinds of secrets, in the order that breaks ties.
RULES = (
    Rule("assign", 1, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Rule("access", 1, r"AKIA[A-Z0-9]+", 0, 20),
    Rule("hex", 1, r"[0-9a-f]+", 0, 24),
    # Added by the ledger to the three above.
    Rule("pem", 1, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1),
)

SPAN = "array<struct<start:int,kind:int,end:int>>"
PLACES = "array<struct<start:int,end:int>>"


def spans(text: Column, rule: Rule) -> Column:
    """The rule's spans in a text, in order: leftmost matches that don't overlap, less those too short."""
    short_ok = rule.pattern
    if rule.group == 0 and rule.pattern.endswith("+"):
        # Runs of a class: a run that is too short can't hold a longer match, so it needn't be looked at.
        fixed = 4 if rule.pattern.startswith("AKIA") else 0
        short_ok = f"{rule.pattern[:-1]}{{{rule.least - fixed},}}"
    between = F.transform(F.split(text, short_ok), F.length)
    whole = F.regexp_extract_all(text, F.lit(short_ok), F.lit(0))
    sized = F.transform(whole, F.length)
    counted = F.regexp_extract_all(text, F.lit(short_ok), F.lit(rule.group)) if rule.group else whole
    counted = F.transform(counted, F.length)
    parts = F.arrays_zip(between.alias("gap"), sized.alias("size"), counted.alias("counted"))
    none = F.struct(F.lit(0).alias("at"), F.array().cast(PLACES).alias("out"))

    def add(acc: Column, x: Column) -> Column:
        a = acc["at"] + x["gap"]
        z = a + F.coalesce(x["size"], F.lit(0))
        one = F.array(F.struct(a.alias("start"), z.alias("end")))
        return F.struct(z.alias("at"), F.when(x["counted"] >= rule.least, F.concat(acc["out"], one)).otherwise(acc["out"]).alias("out"))

    # A fold copies its list at every match, so it goes over groups of about as many matches as there are groups; then
    # each group's places move on by the lengths of the groups before it.
    def grouped(xs: Column) -> Column:
        each = F.ceil(F.sqrt(F.size(xs))).cast("int")
        return F.transform(F.sequence(F.lit(0), ((F.size(xs) - 1) / each).cast("int")), lambda g: F.aggregate(F.slice(xs, g * each + 1, each), none, add))

    def placed(groups: Column) -> Column:
        begin = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("firsts"))
        firsts = F.aggregate(groups, begin, lambda acc, g: F.struct((acc["at"] + g["at"]).alias("at"), F.concat(acc["firsts"], F.array(acc["at"])).alias("firsts")), lambda acc: acc["firsts"])
        moved = F.zip_with(groups, firsts, lambda g, by: F.transform(g["out"], lambda p: F.struct((p["start"] + by).alias("start"), (p["end"] + by).alias("end"))))
        return F.flatten(moved)

    found = let(let(parts, grouped), placed)
    return F.when(text.rlike(short_ok), found).otherwise(F.array().cast(PLACES))


#: Rows of the ledger: pairs of the blob and a rule version, with the places found.
LEDGER = f"blob string, pairs array<struct<rule:string,places:{PLACES}>>"


def name_of(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def scan(history: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES, ledger: str | None = None) -> DataFrame:
    """The history with columns blob (its address) and spans, one row for each row of it.

    ledger: a folder of Parquet that is read, and to which newly scanned pairs are appended; none: all are new. A null
    text is an empty one. Rows with equal texts share one scan. The input's columns of the two names are replaced, all
    others stay. An empty history scans nothing.
    """
    spark, history = history.sparkSession, history.drop(*({"blob", "spans"} - {text}))
    content = F.coalesce(F.col(text), F.lit(""))
    fresh = ledger is None
    ledger = ledger or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    blobs = history.select(F.sha2(content, 256).alias("blob"), content.alias("content")).groupBy("blob").agg(F.first("content").alias("content"))
    if not fresh:
        have = read_ledger(spark, ledger).select("blob", F.explode("pairs.rule").alias("rule")).groupBy("blob").agg(F.collect_set("rule").alias("have"))
        blobs = blobs.join(have, "blob", "left").where(F.coalesce(F.size(F.array_except(F.array(*[F.lit(name_of(r)) for r in rules]), "have")) > 0, F.lit(True)))
    wanted = []
    for r in rules:
        pair = F.struct(F.lit(name_of(r)).alias("rule"), spans(F.col("content"), r).alias("places"))
        wanted.append(pair if fresh else F.when(~F.coalesce(F.array_contains("have", name_of(r)), F.lit(False)), pair))
    pairs = F.array(*wanted)
    blobs.select("blob", (pairs if fresh else F.array_compact(pairs)).alias("pairs")).write.mode("append").parquet(ledger)
    kinds = F.create_map(*[F.lit(x) for k, r in enumerate(rules) for x in (name_of(r), k)])
    hits = read_ledger(spark, ledger).select("blob", F.filter("pairs", lambda p: p["rule"].isin([name_of(r) for r in rules]) & (F.size(p["places"]) > 0)).alias("pairs")).where("size(pairs) > 0")
    each = F.transform("pairs", lambda p: F.transform(p["places"], lambda s: F.struct(s["start"].alias("start"), F.element_at(kinds, p["rule"]).alias("kind"), s["end"].alias("end"))))
    hits = hits.select("blob", F.flatten(each).alias("spans"))
    if not fresh:
        hits = hits.groupBy("blob").agg(F.array_distinct(F.flatten(F.collect_list("spans"))).alias("spans"))
    found = history.withColumn("blob", F.sha2(content, 256)).join(hits.withColumnRenamed("spans", "__s"), "blob", "left")
    return found.withColumn("spans", F.coalesce(F.array_sort("__s"), F.array().cast(SPAN))).drop("__s")


def read_ledger(spark: SparkSession, path: str) -> DataFrame:
    """The ledger's rows; none if the folder has no files yet."""
    from pyspark.errors import AnalysisException

    try:
        return spark.read.schema(LEDGER).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], LEDGER)


def listed(found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """Spans as kind:start:end, comma-joined."""
    kinds = F.array(*[F.lit(r.kind) for r in rules])
    return F.array_join(F.transform(found, lambda s: F.concat_ws(":", F.get(kinds, s["kind"]), s["start"], s["end"])), ",")


def op2_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts, digest and list of secrets in every document; each document is a path with one version.

    Every row gives one, repeated ones too; a null or empty text has none; an empty table stays empty.
    """
    found = scan(documents(spark, sf_dir).select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["kind"] < 3)
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long")
    return found.select("doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"), F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def _kind_sql(kind: str, number: int, pattern: str, group: int, least: int) -> str:
    quoted = pattern.replace("'", "''")
    return f"""
{kind}_g AS (SELECT doc_id, string_split_regex(t, '{quoted}') AS gaps, regexp_extract_all(t, '{quoted}') AS ms, regexp_extract_all(t, '{quoted}', {group}) AS vs FROM d),
{kind}_i AS (SELECT doc_id, gaps, ms, vs, unnest(generate_series(1, len(ms))) AS i FROM {kind}_g WHERE len(ms) > 0),
{kind} AS (SELECT doc_id, '{kind}' AS kind, {number} AS k,
  (list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0))::BIGINT AS a,
  length(ms[i]) AS n, length(vs[i]) AS v FROM {kind}_i WHERE length(vs[i]) >= {least}),"""


OP2_SQL = (
    "WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),"
    + _kind_sql("assign", 0, r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6)
    + _kind_sql("access", 1, r"AKIA[A-Z0-9]+", 0, 20)
    + _kind_sql("hex", 2, r"[0-9a-f]+", 0, 24)
    + _kind_sql("pem", 3, r"-----BEGIN [A-Z ]*PRIVATE KEY-----", 0, 1)
    + """
s AS (FROM assign UNION ALL FROM access UNION ALL FROM hex UNION ALL FROM pem),
j AS (SELECT doc_id, kind, k, a, kind || ':' || a || ':' || (a + n) AS x FROM s),
g AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
  coalesce(string_agg(x, ',' ORDER BY a, k) FILTER (k < 3), '') AS base, string_agg(x, ',' ORDER BY a, k) AS spans FROM j GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN g USING (doc_id)
"""
)

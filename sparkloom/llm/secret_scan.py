"""Operator 4: an incremental ledger of blobs that were scanned for secrets, in DataFrame functions only.

Every version of every path is named by the SHA-256 of its text. The ledger has
which pairs of a blob and a rule's version were scanned, the spans they gave, and
which blobs each path ever held; a run scans each blob only by the rules that its
pairs lack, once however many paths hold it, and appends to the ledger. Findings of
the rule versions asked for are joined back to the rows of the run (``scan``) or to
all paths of all runs (``history``); those of a rule's older versions stay in the
ledger but are no longer reported.

Spans are code points from the start of the text, the end not included. Matches of
a rule are leftmost and don't overlap: ``split`` gives the text between them and
``regexp_extract_all`` the matches, so running sums of lengths place them. A match
whose group is shorter than the rule's least length is dropped, though it keeps its
place.

Defined cases: a null text is empty and has no findings; repeated rows get the
same findings each; a null path stays; an empty table gives no rows; further
columns are ignored. Spans of one start are listed in the order of the rules.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.storage import written


class Rule(NamedTuple):
    kind: str
    version: int
    pattern: str
    group: int = 0
    least: int = 1

    @property
    def name(self) -> str:
        return f"{self.kind}@{self.version}"


#: In the order in which spans with one start are listed. A whole run of hex digits or of a key's signs is a match or
#: fails, so its least length may stand in the pattern; a short assignment can hide a longer one and must be matched.
BASE = (
    Rule("assign", 1, r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    Rule("access", 1, r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", 1, r"[0-9a-f]{16,}"),
)
RULES = (
    *BASE,
    # to its end line, or else to the end of its lines
    Rule("private_key", 2, r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----(?:[A-Za-z0-9+/=:,\s-]*?-----END [A-Z ]{0,30}PRIVATE KEY-----|(?:\s+[A-Za-z0-9+/=]{40,})*)"),
    Rule("code_host", 1, r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("chat", 1, r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("web_token", 1, r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}"),
)
SPAN = "struct<start:int,place:int,kind:string,end:int,rule:string>"
PAIRS, VERSIONS = f"blob string, done array<string>, spans array<{SPAN}>", "path string, blob string"
#: Matches that one running sum goes over; sums of longer lists go over blocks of so many.
BLOCK = 256


def _running(lengths: Column) -> Column:
    """The sum of the numbers before each one of a short list."""
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out"))
    return F.aggregate(lengths, start, lambda acc, n: F.struct((acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])


def rule_spans(text: Column, rule: Rule, place: int) -> Column:
    """The spans of a rule's matches in a text; texts with none are left after one look."""
    pattern, nothing = F.lit(rule.pattern), F.array().cast(f"array<{SPAN}>")
    matches = F.regexp_extract_all(text, pattern, F.lit(0))
    groups = F.regexp_extract_all(text, pattern, F.lit(rule.group)) if rule.group else matches
    between = F.slice(F.split(text, rule.pattern, -1), F.lit(1), F.size(matches))
    steps = F.zip_with(F.zip_with(between, matches, lambda b, m: F.struct(F.length(b).alias("b"), F.length(m).alias("m"))), groups, lambda s, g: F.struct(s["b"].alias("b"), s["m"].alias("m"), (F.length(g) >= rule.least).alias("kept")))

    def spans(block: Column, first: Column) -> Column:
        before = _running(F.transform(block, lambda s: s["b"] + s["m"]))

        def span(s: Column, at: Column) -> Column:
            start = first + at + s["b"]
            return F.struct(start.alias("start"), F.lit(place).alias("place"), F.lit(rule.kind).alias("kind"), (start + s["m"]).alias("end"), F.lit(rule.name).alias("rule"), s["kept"].alias("kept"))

        every = F.filter(F.zip_with(block, before, span), lambda s: s["kept"])
        return F.transform(every, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "place", "kind", "end", "rule")]))

    def in_blocks(steps: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(steps) - 1) / BLOCK).cast("int")), lambda i: F.slice(steps, i * BLOCK + 1, F.lit(BLOCK)))
        sums = F.transform(blocks, lambda block: F.aggregate(block, F.lit(0), lambda acc, s: acc + s["b"] + s["m"]))
        return F.flatten(F.zip_with(blocks, _running(sums), spans))

    found = F.when(F.size(steps) > BLOCK, in_blocks(steps)).when(F.size(steps) > 0, spans(steps, F.lit(0))).otherwise(nothing)
    return F.when(F.rlike(text, pattern), found).otherwise(nothing)


def scan_blobs(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and sorted spans of every blob with findings among those of ``versions`` (path, text) and earlier ones; the ledger's pairs grow by what is new."""
    spark, names = versions.sparkSession, F.array(*[F.lit(r.name) for r in rules])
    old = read_pairs(spark, ledger)
    blobs = named(versions).groupBy("blob").agg(F.any_value("text").alias("text"))
    if old is None:
        pairs = blobs.withColumn("done", names)
    else:
        known = old.groupBy("blob").agg(F.flatten(F.collect_list("done")).alias("known"))
        todo = F.array_except(names, F.coalesce("known", F.array().cast("array<string>")))
        pairs = blobs.join(known, "blob", "left").withColumn("done", todo).where(F.size("done") > 0)
    nothing = F.array().cast(f"array<{SPAN}>")
    spans = F.concat(*[F.when(F.array_contains("done", r.name), rule_spans(F.col("text"), r, i)).otherwise(nothing) for i, r in enumerate(rules)])
    pairs.select("blob", "done", F.array_sort(spans).alias("spans")).write.mode("append").option("compression", "zstd").parquet(f"{ledger}/pairs")
    return written(findings(spark, ledger, rules), "findings")


def findings(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """blob and sorted spans of every blob of the ledger in which these versions of the rules found something."""
    current = read_pairs(spark, ledger).where(F.size("spans") > 0)
    one = current.select("blob", F.explode("spans").alias("s")).where(F.col("s.rule").isin([r.name for r in rules]))
    return one.groupBy("blob").agg(F.array_sort(F.collect_set("s")).alias("spans"))


def named(versions: DataFrame) -> DataFrame:
    """path, text (null: empty) and the blob's name."""
    return versions.select("path", F.coalesce("text", F.lit("")).alias("text")).withColumn("blob", F.sha2("text", 256))


def scan(versions: DataFrame, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path, blob and all sorted spans of every row of ``versions`` (path, text); the ledger's paths grow by what is new."""
    spark = versions.sparkSession
    rows = written(named(versions).select("path", "blob"), "versions")
    now, old = rows.select(F.col("path").cast("string").alias("path"), "blob").distinct(), _read(spark, f"{ledger}/versions", VERSIONS)
    if old is not None:
        now = now.alias("n").join(old.alias("o"), (F.col("n.blob") == F.col("o.blob")) & F.col("n.path").eqNullSafe(F.col("o.path")), "left_anti")
    now.write.mode("append").option("compression", "zstd").parquet(f"{ledger}/versions")
    return _joined(rows, scan_blobs(versions, ledger, rules))


def history(spark: SparkSession, ledger: str, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """path (as text), blob and all sorted spans of every version that the ledger knows."""
    return _joined(_read(spark, f"{ledger}/versions", VERSIONS), findings(spark, ledger, rules))


def _joined(rows: DataFrame, found: DataFrame) -> DataFrame:
    return rows.join(found, "blob", "left").select("path", "blob", F.coalesce("spans", F.array().cast(f"array<{SPAN}>")).alias("spans"))


def read_pairs(spark: SparkSession, ledger: str) -> DataFrame | None:
    """Which rules scanned which blobs, and what they found, or None where the ledger isn't begun."""
    return _read(spark, f"{ledger}/pairs", PAIRS)


def _read(spark: SparkSession, folder: str, schema: str) -> DataFrame | None:
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    if not path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
        return None
    return spark.read.schema(schema).parquet(folder)


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def redacted(text: Column, spans: Column, mark: str = "[REDACTED]") -> Column:
    """The text with every run of overlapping sorted spans replaced."""
    done = F.aggregate(
        spans,
        F.struct(F.lit(0).alias("at"), F.lit("").alias("out")),
        lambda acc, s: F.struct(
            F.greatest(acc["at"], s["end"]).alias("at"),
            F.when((s["start"] >= acc["at"]) | (acc["at"] == 0), F.concat(acc["out"], F.substring(text, acc["at"] + 1, s["start"] - acc["at"]), F.lit(mark))).otherwise(acc["out"]).alias("out"),
        ),
    )
    return F.when(F.size(spans) == 0, text).otherwise(F.concat(done["out"], F.substring(text, done["at"] + 1, F.length(text))))


def report(findings: DataFrame, base: tuple[Rule, ...] = BASE) -> DataFrame:
    """path, the number of each base kind, the digest of the base spans and all spans as text."""
    kinds = [r.kind for r in base]
    own = F.filter("spans", lambda s: s["kind"].isin(kinds))
    counts = [F.expr(f"cast(size(filter(spans, s -> s.kind = '{k}')) as long) n_{k}") for k in kinds]
    return findings.select("path", *counts, F.sha2(listed(own), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"))


def spans_sql(rules: tuple[Rule, ...] = RULES) -> str:
    """DuckDB SQL for ``report(scan(...))`` over the table documents."""
    one = """
    list_filter(list_transform(regexp_extract_all(text, '{p}', {g}), lambda m, i: {{
        'start': CAST(coalesce(list_sum(list_transform(string_split_regex(text, '{p}')[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(regexp_extract_all(text, '{p}', 0)[1:i-1], lambda x: length(x))), 0) AS INTEGER),
        'place': {i}, 'kind': '{k}', 'size': length(m), 'width': length(regexp_extract_all(text, '{p}', 0)[i])}}), lambda s: s.size >= {least})"""
    parts = []
    for i, r in enumerate(rules):
        p = r.pattern.replace("'", "''")
        parts.append(f"CASE WHEN regexp_matches(text, '{p}') THEN {one.format(p=p, g=r.group, i=i, k=r.kind, least=r.least)} ELSE [] END AS s{i}")
    text = "lambda s: s.kind || ':' || s.start || ':' || (s.start + s.width)"
    kinds = ", ".join(f"CAST(len(s{i}) AS BIGINT) AS n_{r.kind}" for i, r in enumerate(BASE))
    every = " || ".join(f"s{i}" for i in range(len(rules)))
    base = " || ".join(f"s{i}" for i in range(len(BASE)))
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
m AS (SELECT doc_id, {", ".join(parts)} FROM t)
SELECT doc_id, {kinds},
  sha256(array_to_string(list_transform(list_sort({base}), {text}), ',')) AS base_sha256,
  array_to_string(list_transform(list_sort({every}), {text}), ',') AS spans
FROM m"""

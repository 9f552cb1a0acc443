"""Secret scans with an incremental blob ledger; DataFrame expressions only.

Every historical version of a text is a *blob*, addressed by its SHA-256.  The
ledger has a row for each (blob, rule version) that was scanned, with its
findings.  A run scans only the pairs that the ledger lacks, each blob once
however many paths hold it, and joins the findings back to all paths.

Matches are leftmost and non-overlapping for each rule.  Spark's expressions
give the matched strings in order, and by splitting the strings between them; a
match's place is the running sum of those lengths, a window over the matches of
one blob, so that the work grows in proportion to them.

Defined results: a null text is the empty blob; a blob without findings still
has its ledger row; copies get the findings of their blob; a pair that stands
in the ledger twice counts once.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Scratch
from .texts import others


@dataclass(frozen=True)
class Rule:
    """A pattern (Java syntax; it matches a character at least), and the group that must have ``least`` characters."""

    kind: str
    pattern: str
    group: int = 0
    least: int = 1
    base: bool = True


RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 1, 12),
    # a run shorter than the least has no longer one inside it, so the least can stand in the pattern
    Rule("access", r"AKIA[A-Z0-9]{14,}"),
    Rule("hex", r"[0-9a-f]{16,}"),
    # kinds that the ledger adds to the base ones
    Rule("private_key", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", base=False),
    # one start for each run of these letters, and no run is given back, so that long runs aren't searched again and again
    Rule("web_token", r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+\.[A-Za-z0-9_-]{10,}+", base=False),
)

SPAN = "array<struct<start:int,rank:int,end:int,kind:string,base:boolean>>"


def rules_version(rules: tuple[Rule, ...]) -> str:
    """Changes whenever the rules do; findings of other versions are not reused."""
    return hashlib.sha256(repr(rules).encode()).hexdigest()[:16]


def rule_matches(text: Column, rule: Rule, rank: int) -> Column:
    """``(rank, gaps, sizes, ok)`` of a rule's matches in order: the characters before each, its own, and whether it counts; null without a match."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    part = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group)) if rule.group else found
    sizes = lambda x: F.transform(x, lambda s: F.length(s))
    ok = F.transform(part, lambda s: F.length(s) >= rule.least)
    # only texts with a match pay for more than one search
    return F.when(text.rlike(rule.pattern), F.struct(F.lit(rank).alias("rank"), sizes(F.split(text, rule.pattern)).alias("gaps"), sizes(found).alias("sizes"), ok.alias("ok")))


def blob_spans(blobs: DataFrame, rules: tuple[Rule, ...], scratch: Scratch) -> DataFrame:
    """``blobs(blob, t)``, each blob once -> ``(blob, spans)``: all rules' spans in code points, end exclusive, by start, then in the order of the rules."""
    matches = F.array_compact(F.array(*(rule_matches(F.col("t"), r, k) for k, r in enumerate(rules))))
    scanned = scratch.save(blobs.select("blob", matches.alias("matches")))
    each = scanned.select("blob", F.explode("matches").alias("m"))
    each = each.select("blob", "m.rank", F.posexplode(F.arrays_zip("m.gaps", "m.sizes", "m.ok")).alias("k", "x")).filter("x.sizes is not null")
    upto = Window.partitionBy("blob", "rank").orderBy("k").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("x.gaps") + F.col("x.sizes")).over(upto).cast("int")
    of = lambda values: F.get(F.array(*map(F.lit, values)), F.col("rank"))
    placed = each.select("blob", "rank", "x.ok", end.alias("end"), F.col("x.sizes").alias("size")).filter("ok")
    span = F.struct((F.col("end") - F.col("size")).alias("start"), "rank", "end", of([r.kind for r in rules]).alias("kind"), of([r.base for r in rules]).alias("base"))
    spans = placed.groupBy("blob").agg(F.array_sort(F.collect_list(span)).cast(SPAN).alias("spans"))
    return scanned.select("blob").join(spans, "blob", "left").select("blob", F.coalesce("spans", F.expr(f"cast(array() as {SPAN})")).alias("spans"))


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def scan(df: DataFrame, text_col: str = "text", ledger: DataFrame | None = None, rules: tuple[Rule, ...] = RULES) -> tuple[DataFrame, DataFrame]:
    """``(findings, ledger rows)`` for all rows of ``df``: each row is a path that holds a version of a text.

    ``findings`` is ``df`` without its text, with ``blob`` and ``spans``.
    The second table ``(blob, rule_version, spans)`` holds what this run scanned;
    append it to the ledger.  ``ledger`` has those columns, of earlier runs.
    """
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    keep = others(df, text_col, "blob", "spans")
    scratch, version = Scratch(df.sparkSession, "secrets"), F.lit(rules_version(rules)).alias("rule_version")
    # a blob's address stands for its text in the exchange's key
    unseen = df.select(F.sha2(text, 256).alias("blob"), text.alias("t")).groupBy("blob").agg(F.first("t").alias("t"))
    known = None
    if ledger is not None:
        # a pair that is in the ledger twice counts once
        known = ledger.filter(F.col("rule_version") == version).dropDuplicates(["blob"])
        unseen = unseen.join(known, "blob", "left_anti")
    new = scratch.save(blob_spans(unseen, rules, scratch).select("blob", version, "spans"))
    found = new if known is None else new.unionByName(known.select(new.columns))
    found = found.filter(F.size("spans") > 0).select(F.col("blob").alias("\x00blob"), F.col("spans").alias("\x00spans"))
    paths = df.select(*keep, F.sha2(text, 256).alias("blob"))
    got = paths.join(found, F.col("blob") == F.col("\x00blob"), "left")
    return got.select(*keep, "blob", F.coalesce("\x00spans", F.expr(f"cast(array() as {SPAN})")).alias("spans")), new


def scan_with_ledger(df: DataFrame, folder: str, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """The findings of :func:`scan`, with the ledger kept as a table in ``folder``: what this run scans is appended."""
    spark = df.sparkSession
    path = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = path.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).exists(path)
    found, new = scan(df, text_col, spark.read.parquet(folder) if there else None, rules)
    new.write.mode("append").parquet(folder)
    return found

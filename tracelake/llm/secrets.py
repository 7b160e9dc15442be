"""Secret scans with an incremental blob ledger, in DataFrame functions only.

Every text version is addressed by its SHA-256.  The ledger holds, for each blob, the rule versions it was scanned
under and what was found; a run scans only pairs of blob and rule version that the ledger lacks, appends them, and
joins the findings back to every row that carries the blob.

Defined results: null text counts as empty and has no findings; equal texts share one scan; repeated rows each get
the findings; an empty table adds nothing; columns other than id and text are ignored.
"""

from __future__ import annotations

import uuid
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from tracelake.sources.shared import shared_dir


class Rule(NamedTuple):
    kind: str
    version: str
    pattern: str
    #: The group whose length counts, and the least length.
    group: int = 0
    least: int = 1


# The kinds in their listed order; the base kinds first.
BASE = [
    Rule("assign", "1", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 8),
    Rule("access", "1", r"AKIA[A-Z0-9]+", 0, 16),
    Rule("hex", "1", r"[0-9a-f]{32,}", 0, 32),
]
#: What the method adds: private key headers, and tokens with a telling prefix.
ADDED = [
    Rule("pem", "1", r"-----BEGIN [A-Z ]{0,24}PRIVATE KEY-----", 0, 1),
    Rule("prefixed", "1", r"(?:ghp|gho|ghs|xoxb|xoxp|sk_live)_?-?[A-Za-z0-9]{20,}", 0, 1),
]
RULES = BASE + ADDED
SPAN = "struct<start:int,ord:int,end:int,kind:string,version:string>"


STEP = "array<struct<ord:int,at:int,gap:int,size:int,long:boolean>>"


def steps(text: Column, rule: Rule, order: int) -> Column:
    """The matches of a rule in a text: each with its number, the code points between the last one and it, its own, and
    whether it is long enough.  The pieces between matches and the matches alternate, so their lengths add up to places."""
    found = F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(0))
    told = found if rule.group == 0 else F.regexp_extract_all(text, F.lit(rule.pattern), F.lit(rule.group))
    pieces = F.arrays_zip(F.slice(F.split(text, rule.pattern), 1, F.size(found)).alias("gap"), found.alias("match"), told.alias("told"))
    walked = F.transform(pieces, lambda x, i: F.struct(
        F.lit(order).alias("ord"), i.alias("at"), F.length(x["gap"]).alias("gap"), F.length(x["match"]).alias("size"), (F.length(x["told"]) >= rule.least).alias("long")))
    return F.when(text.rlike(rule.pattern), walked.cast(STEP)).otherwise(F.array().cast(STEP))


def key(rule: Rule) -> str:
    return f"{rule.kind}@{rule.version}"


def blob_of(text: Column) -> Column:
    return F.unhex(F.sha2(F.coalesce(text, F.lit("")), 256))


def scan_unseen(versions: DataFrame, ledger: DataFrame | None, text: str = "text", rules: list[Rule] = RULES) -> DataFrame:
    """Ledger rows (blob, scanned array<string>, spans) for the pairs of blob and rule version that ledger lacks."""
    blobs = versions.select(blob_of(F.col(text)).alias("blob"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    wanted = F.array(*[F.lit(key(r)) for r in rules])
    if ledger is not None:
        seen = ledger.groupBy("blob").agg(F.flatten(F.collect_list("scanned")).alias("seen"))
        blobs = blobs.join(seen, "blob", "left").withColumn("todo", F.array_except(wanted, F.coalesce("seen", F.array().cast("array<string>")))).where("size(todo) > 0")
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text"), F.first("todo").alias("todo"))
    else:
        blobs = blobs.groupBy("blob").agg(F.first("text").alias("text")).withColumn("todo", wanted)
    found = [F.when(F.array_contains("todo", key(r)), steps(F.col("text"), r, i)).otherwise(F.array().cast(STEP)) for i, r in enumerate(rules)]
    # a blob's matches stay in its partition: places are running sums, so the work grows with the matches, not their square
    each = blobs.select("blob", F.col("todo").alias("scanned"), F.explode_outer(F.concat(*found)).alias("s")).select("blob", "scanned", "s.*")
    run = Window.partitionBy("blob", "ord").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = each.withColumn("end", F.sum(F.col("gap") + F.col("size")).over(run).cast("int"))
    name = lambda field: F.get(F.array(*[F.lit(getattr(r, field)) for r in rules]), F.col("ord"))
    span = F.when(F.col("long"), F.struct((F.col("end") - F.col("size")).alias("start"), "ord", "end", name("kind").alias("kind"), name("version").alias("version")))
    return placed.groupBy("blob").agg(F.first("scanned").alias("scanned"), F.collect_list(span).cast(f"array<{SPAN}>").alias("spans"))


def findings(versions: DataFrame, ledger: DataFrame, text: str = "text", rules: list[Rule] = RULES, keep: list[str] = ("doc_id",)) -> DataFrame:
    """Each row of versions: its kept columns and the sorted spans of the current rule versions found in its blob."""
    current = [key(r) for r in rules]
    told = ledger.where("size(spans) > 0").groupBy("blob").agg(F.flatten(F.collect_list("spans")).alias("spans"))
    told = told.withColumn("spans", F.sort_array(F.filter("spans", lambda s: F.concat(s["kind"], F.lit("@"), s["version"]).isin(current))))
    told = told.withColumn("spans", F.filter("spans", lambda s, i: (i == 0) | (F.get("spans", i - 1) != s)))  # each once
    rows = versions.select(*[F.col(k) for k in keep], blob_of(F.col(text)).alias("blob"))
    return rows.join(told, "blob", "left").withColumn("spans", F.coalesce("spans", F.array().cast(f"array<{SPAN}>"))).drop("blob")


def told(of: Column) -> Column:
    return F.array_join(F.transform(of, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scan_documents(docs: DataFrame, ledger_path: str | None = None) -> DataFrame:
    """Scans what the ledger at ledger_path (default: a new one in the shared folder) lacks, appends it there, and
    returns (doc_id, n_assign, n_access, n_hex, base_sha256, spans) for every row."""
    spark = docs.sparkSession
    path = ledger_path or f"{shared_dir(spark)}/ledger-{uuid.uuid4().hex}"
    rows = docs.select("doc_id", "text")
    scan_unseen(rows, spark.read.parquet(path) if ledger_path and _there(spark, path) else None).write.mode("append").parquet(path)
    found = findings(rows, spark.read.parquet(path))
    base = F.filter("spans", lambda s: s["ord"] < len(BASE))
    count = lambda i: F.size(F.filter("spans", lambda s: s["ord"] == i)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(told(base), 256).alias("base_sha256"), told(F.col("spans")).alias("spans"),
    )


def _there(spark, path: str) -> bool:
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()).exists(where)

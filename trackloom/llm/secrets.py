"""Secret scans over an incremental blob ledger.

Every version of every path is addressed by the digest of its content. The ledger says which
(blob, rule version) pairs were scanned and what was found. A scan looks only at pairs that the
ledger lacks, whatever the number of paths and versions that hold the blob, and joins the findings
back to all of them. A changed rule gets a new version and scans old blobs again, for that rule only.

Everything is column expressions. Null content counts as empty. Repeated rows come back as often as
they come in. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trackloom.llm.common import chosen, stored
from trackloom.llm.spans import SPAN, found, listed

# The patterns of the base rules.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ASSIGN_LEAST = 8
# A run of these is matched as a whole, so a lower bound on its length is the same as dropping short ones.
ACCESS = r"AKIA[A-Z0-9]{12,}"
HEX = r"[0-9a-f]{32,}"
# Rules the method adds.
PEM = r"-----BEGIN (?:[A-Z]{1,20} ){0,3}PRIVATE KEY-----"
JWT = r"eyJ[A-Za-z0-9_-]{10,}\.eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}"


@dataclass(frozen=True)
class Rule:
    """A kind of secret: its version changes when its spans would."""

    kind: str
    version: int
    spans: Callable[[Column], Column]

    @property
    def key(self) -> str:
        return f"{self.kind}@{self.version}"


def _assignments(text: Column) -> Column:
    long = lambda s: F.length(F.regexp_extract(s["text"], ASSIGN, 2)) >= ASSIGN_LEAST
    return F.filter(found(text, ASSIGN), long)


BASE_RULES = (
    Rule("assign", 1, _assignments),
    Rule("access", 1, lambda text: found(text, ACCESS, when=text.contains("AKIA"))),
    Rule("hex", 1, lambda text: found(text, HEX)),
)
RULES = (
    *BASE_RULES,
    Rule("pem", 1, lambda text: found(text, PEM, when=text.contains("-----BEGIN "))),
    Rule("jwt", 1, lambda text: found(text, JWT, when=text.contains("eyJ"))),
)


def scan_blobs(blobs: DataFrame, rules: tuple[Rule, ...]) -> DataFrame:
    """Ledger rows ``(blob, rule, spans)`` of ``(blob, content, todo)`` rows.

    ``todo`` lists the rules to run. A pair without findings gets a row with an empty list: it was
    scanned.
    """
    results = F.array(*(
        F.struct(
            F.lit(rule.key).alias("rule"),
            F.when(F.array_contains("todo", rule.key), rule.spans(F.col("content"))).cast(SPAN).alias("spans"),
        )
        for rule in rules
    ))
    return blobs.select("blob", F.inline(results)).where(F.col("spans").isNotNull())


def scan_versions(
    versions: DataFrame, rules: tuple[Rule, ...] = RULES, ledger: DataFrame | None = None
) -> tuple[DataFrame, DataFrame]:
    """Scan ``(path, version, content)`` rows.

    Returns (places, ledger): every (path, version) with its blob, and the ledger with the new rows
    added. ``findings`` joins them.
    """
    addressed = chosen(versions, "path", "version", "content").withColumn("content", F.coalesce("content", F.lit("")))
    addressed = addressed.withColumn("blob", F.sha2("content", 256))
    places = addressed.select("path", "version", "blob")
    todo = F.array(*(F.lit(r.key) for r in rules))
    # copies meet inside map tasks first, so one common blob does not gather in one place
    blobs = addressed.select("blob", "content").dropDuplicates(["blob"])
    if ledger is None:
        new = scan_blobs(blobs.withColumn("todo", todo), rules)
        return places, stored(new)
    keys = [r.key for r in rules]
    scanned = ledger.where(F.col("rule").isin(keys)).groupBy("blob").agg(F.collect_set("rule").alias("_done"))
    missing = F.array_except(todo, F.coalesce("_done", F.array().cast("array<string>")))
    unseen = blobs.join(scanned, "blob", "left").withColumn("todo", missing).where(F.size("todo") > 0)
    new = stored(scan_blobs(unseen.select("blob", "content", "todo"), rules))
    return places, ledger.select("blob", "rule", "spans").unionByName(new)


def findings(places: DataFrame, ledger: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All paths and versions with their spans ``(start, order, kind, end, text)``, by start and rule order."""
    order = F.create_map(*(F.lit(x) for i, r in enumerate(rules) for x in (r.key, i)))
    kind = F.create_map(*(F.lit(x) for r in rules for x in (r.key, r.kind)))
    hits = ledger.where(F.col("rule").isin([r.key for r in rules]) & (F.size("spans") > 0))
    per_blob = hits.select("blob", F.transform("spans", lambda s: F.struct(
        s["start"].alias("start"), order[F.col("rule")].alias("order"), kind[F.col("rule")].alias("kind"),
        s["end"].alias("end"), s["text"].alias("text"),
    )).alias("spans")).groupBy("blob").agg(F.array_sort(F.flatten(F.collect_list("spans"))).alias("spans"))
    none = F.array().cast("array<struct<start:int,order:int,kind:string,end:int,text:string>>")
    return places.join(per_blob, "blob", "left").withColumn("spans", F.coalesce("spans", none))


def digest(found_spans: DataFrame) -> DataFrame:
    """Counts and digests of ``findings``; base spans are those of the base rules."""
    base = F.filter("spans", lambda s: s["kind"].isin([r.kind for r in BASE_RULES]))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found_spans.select(
        "path", *(count(r.kind).alias(f"n_{r.kind}") for r in BASE_RULES),
        F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("spans")).alias("spans"),
    )

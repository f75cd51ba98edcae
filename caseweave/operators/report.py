"""What reports show: order, subsets, projections, sentences, provenance; and findings of scanners run elsewhere."""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from caseweave import config as C
from caseweave.operators.rollups import top_domains
from caseweave.operators.scoring import provenance, severity

# The columns of the exposure inventory.
EXPOSURE_COLUMNS = ("first_access_utc", "accesses", "access_type", "throttled", "client_ip", "session_id", "subject", "sender", "has_attachment", "in_corpus", "message_id", "path")
#: URLs of a message in a report.
URL_CAP = 15


def candidate_order(confirmed: str = "confirmed", score: str = "score", sec: str = "sec") -> list[Column]:
    """Sort keys of every candidate list: recorded facts first, then the score, then time (unknown last), then the path."""
    return [F.desc(F.coalesce(F.col(confirmed), F.lit(False))), F.desc(score), F.asc_nulls_last(sec), F.col("path").asc()]


def report_subset(messages: DataFrame, verdict: DataFrame, k: int = 200) -> DataFrame:
    """The messages of a report: the first k candidates, all of Tier 1, and those that the verdict names, each once."""
    top = messages.filter("score > 0 OR coalesce(confirmed, false)").orderBy(*candidate_order()).limit(k).select("path")
    wanted = top.union(messages.filter("tier = 1").select("path")).union(verdict.select("path")).distinct()
    return messages.join(wanted, "path", "left_semi")


def console(frames: dict[str, DataFrame], k: int = 10) -> dict[str, DataFrame]:
    """What a console shows of a case, by title: how many messages each tier has, and the first k candidates, domains, campaigns,
    indicators, signals and lines of the timeline."""
    m = frames["messages"]
    return {
        "tiers": m.groupBy("tier").agg(F.count("*").alias("messages")).orderBy("tier"),
        "candidates": m.filter("score > 0 OR coalesce(confirmed, false)").orderBy(*candidate_order()).limit(k).select("tier", "score", "confirmed", "sender", "subject", "path"),
        "domains": top_domains(m, k), "campaigns": frames["campaigns"].orderBy(F.desc("score"), F.desc("size"), "campaign").limit(k).select("campaign", "size", "score", "confidence", "senders", "origin"),
        "indicators": frames["iocs"].orderBy("best_tier", F.desc("occurrences"), "type", "value").limit(k).select("type", "value", "occurrences", "best_tier"),
        "signals": frames["statistics"].orderBy(F.desc("fires"), "signal").limit(k), "timeline": frames["timeline"].orderBy(F.asc_nulls_last("sec"), "source", "ref").limit(k), "verdict": frames["verdict"],
    }


def slim_urls(analyses: Column, cap: int = URL_CAP) -> Column:
    """The riskiest analysis of each domain (of each URL without one), riskiest first, `cap` at most.
    analyses: array of structs url, domain, score; ties stay in their order."""
    placed = F.transform(F.coalesce(analyses, F.array().cast("array<struct<url:string,domain:string,score:int>>")), lambda x, i: F.struct((-x["score"]).alias("less"), i.alias("at"), x.alias("x"), F.when(F.coalesce(x["domain"], F.lit("")) != "", x["domain"]).otherwise(x["url"]).alias("key")))
    ranked = F.array_sort(placed)
    keys = F.transform(ranked, lambda r: r["key"])
    first = F.filter(ranked, lambda r, i: F.array_position(keys, r["key"]) == i + 1)
    return F.slice(F.transform(first, lambda r: r["x"]), 1, cap)


def strip_private(df: DataFrame) -> DataFrame:
    """Without columns that begin with an underscore."""
    return df.drop(*[c for c in df.columns if c.startswith("_")])


def exposure_inventory(scope: DataFrame, messages: DataFrame) -> DataFrame:
    """EXPOSURE_COLUMNS, one row for each message that the attacker read, by first access. scope: message_id, accesses,
    first_sec, access_type, throttled, client_ip, session_id; messages: message_id, path, subject, sender, attachments."""
    m = messages.groupBy(F.lower("message_id").alias("id")).agg(F.min_by(F.struct("subject", "sender", F.col("path"), (F.size("attachments") > 0).alias("has")), "path").alias("m"))
    s = scope.join(m, F.lower("message_id") == F.col("id"), "left")
    when = F.date_format(F.timestamp_seconds("first_sec"), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    cols = {"first_access_utc": when, "subject": F.coalesce("m.subject", F.lit("")), "sender": F.coalesce("m.sender", F.lit("")), "has_attachment": F.coalesce("m.has", F.lit(False)), "in_corpus": F.col("m").isNotNull(), "path": F.coalesce("m.path", F.lit(""))}
    return s.withColumns(cols).select(*EXPOSURE_COLUMNS).orderBy(F.asc_nulls_last("first_access_utc"), "message_id")


def narrative_summary(scenario: str, phases: list[dict]) -> str:
    """A paragraph for a report. phases: phase, description, and for initial_access sender, subject, when."""
    if not phases:
        return "Insufficient signal to reconstruct an attack narrative."
    shape = "account-takeover" if scenario == "ato" else "impersonation / vendor-compromise"
    by = {p["phase"]: p for p in phases}
    said = [f"This has the shape of an {shape} business email compromise."]
    if entry := by.get("initial_access"):
        said.append(f"Likely entry point: {entry['sender']} - \"{entry['subject']}\" ({entry['when']}).")
    return " ".join(said + [by[k]["description"] for k in ("compromise", "persistence", "fraud") if k in by])


def config_deltas(t: C.Thresholds) -> dict:
    """The thresholds that differ from the defaults."""
    usual = asdict(C.DEFAULTS)
    return {k: v for k, v in asdict(t).items() if usual[k] != v}


def scan_fingerprint(rules: dict[str, bytes], want_qr: bool, tiers: tuple[int, ...]) -> str:
    """A digest of a scan's configuration: rule files by content, whatever their names and order, and the options."""
    told = {"rules": sorted(hashlib.sha256(b).hexdigest() for b in rules.values()), "qr": bool(want_qr), "tiers": sorted(set(tiers))}
    return hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()


def scan_targets(attachments: DataFrame, tiers: DataFrame, upto: int = 2) -> DataFrame:
    """Attachments (path, ...) of the messages in tiers 1 to `upto`: what a scanner is given."""
    return attachments.join(tiers.filter(F.col("tier") <= upto).select("path"), "path", "left_semi")


def scanner_findings(hits: DataFrame, kind: str) -> DataFrame:
    """Findings of a scanner's hits, in the shape of scoring.findings(): path, filename, detail (rule names or a URL).
    kind: yara (weight 10) or qr (weight 6); either lifts its message to Tier 1."""
    weight, text = {"yara": (10, "Attachment matches scan rules: "), "qr": (6, "QR code in attachment leads to ")}[kind]
    each = hits.groupBy("path", "filename").agg(F.array_join(F.array_sort(F.collect_set("detail")), ", ").alias("detail"))
    seq = F.row_number().over(_by_file())
    signal = F.concat(F.lit(text), "detail", F.lit(" ("), "filename", F.lit(")"))
    w = F.lit(weight).cast("long")
    return each.select("path", F.lit("scan").alias("stage"), seq.alias("seq"), signal.alias("signal"), F.lit("attachment").alias("category"), F.lit(f"attachment:{kind}").alias("source"), w.alias("weight"), severity(w).alias("severity"), provenance(F.lit(f"attachment:{kind}")).alias("provenance"))


def _by_file():
    from pyspark.sql.window import Window

    return Window.partitionBy("path").orderBy("filename")


def lift_scanned(tiers: DataFrame, hits: DataFrame) -> DataFrame:
    """path, tier, with messages that a scanner hit in Tier 1."""
    hit = hits.select("path").distinct().withColumn("hit", F.lit(True))
    return tiers.join(hit, "path", "left").select("path", F.when(F.col("hit"), 1).otherwise(F.col("tier")).alias("tier"))


def completeness(deleted: DataFrame) -> DataFrame:
    """One row: how many messages the log says were deleted, how many of them the corpus lacks, and whether it is whole.
    deleted: message_id, n, present (joins.deleted_absent)."""
    r = deleted.agg(F.count("*").alias("deleted"), F.count_if(~F.col("present")).alias("absent"))
    return r.withColumn("complete", F.col("absent") == 0)


def diagnostic(statistics: DataFrame, messages: DataFrame) -> DataFrame:
    """section, name, n: how often each signal fired (signals as templates), and how many messages each tier and each band of
    scores has. Nothing in it names anyone."""
    from caseweave.functions.text import template

    signals = statistics.groupBy(F.lit("signal").alias("section"), template(F.col("signal")).alias("name")).agg(F.sum("fires").cast("long").alias("n"))
    tiers = messages.groupBy(F.lit("tier").alias("section"), F.col("tier").cast("string").alias("name")).agg(F.count("*").alias("n"))
    bands = messages.groupBy(F.lit("score").alias("section"), (F.floor(F.col("score") / 5) * 5).cast("string").alias("name")).agg(F.count("*").alias("n"))
    return signals.unionByName(tiers).unionByName(bands)


def source_provenance(sources: dict[str, DataFrame]) -> DataFrame:
    """kind, rows, first_sec, last_sec of each source that a case was made from."""
    out = None
    for kind, df in sorted(sources.items()):
        sec = F.col("sec") if "sec" in df.columns else F.lit(None).cast("long")
        row = df.agg(F.count("*").alias("rows"), F.min(sec).alias("first_sec"), F.max(sec).alias("last_sec")).select(F.lit(kind).alias("kind"), "rows", "first_sec", "last_sec")
        out = row if out is None else out.unionByName(row)
    return out

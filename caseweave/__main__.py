"""python -m caseweave MAIL [options]: a folder of .eml files or an mbox file, and exports, to a folder of reports."""

from __future__ import annotations

import argparse
import sys
from dataclasses import replace
from datetime import datetime, timezone

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from caseweave import config as C
from caseweave import sinks
from caseweave.operators import report
from caseweave.operators import scenario as S
from caseweave.plans import case
from caseweave.sources import evidence, mail


# Kinds of export by their flag.
KINDS = {
    "message-trace": "trace", "directory-users": "users", "accepted-domains": "domains", "mailbox-rules": "rules", "mailbox-permissions": "permissions", "transport-rules": "transport", "mailbox-audit-status": "audit_status",
    "entra-audit": "entra_audit", "oauth-permissions": "oauth", "mfa-export": "mfa", "devices": "devices", "role-activity": "roles", "risk-detections": "risk",
}
EXPORTS = {
    "message-trace": "message trace: what left the mailbox", "directory-users": "accounts of the tenant", "accepted-domains": "the tenant's domains", "mailbox-rules": "inbox rules as they are now", "mailbox-permissions": "delegated access to mailboxes",
    "transport-rules": "mail flow rules", "mailbox-audit-status": "audit settings of mailboxes", "entra-audit": "directory audit log", "oauth-permissions": "OAuth grants as they are now", "mfa-export": "registered methods", "devices": "registered devices",
    "role-activity": "role assignments", "risk-detections": "detections of the identity provider",
}


def _moment(value: str | None) -> int | None:
    """An ISO time, in seconds; without a zone it is UTC."""
    if not value:
        return None
    t = datetime.fromisoformat(value.replace("Z", "+00:00"))
    return int((t if t.tzinfo else t.replace(tzinfo=timezone.utc)).timestamp())


def _list(values: list[str] | None) -> tuple[str, ...]:
    return tuple(x.strip() for v in values or () for x in v.split(",") if x.strip())


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="caseweave", description=__doc__)
    p.add_argument("mail", help="folder of .eml files, or an mbox file")
    p.add_argument("--csv", help="folder for the messages as CSV")
    p.add_argument("--json", help="folder for all sections as JSON lines")
    p.add_argument("--ioc", help="folder for the indicators as CSV")
    p.add_argument("--audit-log", help="unified audit log: CSV, JSON or JSON lines")
    p.add_argument("--signin-logs", help="sign-in log: CSV, JSON or JSON lines")
    p.add_argument("--evidence", help="folder of exports, told apart by name and columns; the logs above win")
    for kind, what in EXPORTS.items():
        p.add_argument(f"--{kind}", help=what)
    p.add_argument("--config", help="JSON file of thresholds")
    p.add_argument("--exposure-csv", help="folder for the messages that the attacker read, as CSV")
    p.add_argument("--html", help="folder for the report as a page")
    p.add_argument("--html-limit", type=int, default=1000, help="candidates in the page besides Tier 1 and the verdict")
    p.add_argument("--diagnostic", help="folder for signal frequencies and score distributions that name nobody")
    p.add_argument("--signin-window-minutes", type=int, default=20, help="how long before a token its lure may have come")
    p.add_argument("--containment-date", help="ISO time from which the audit log shows the responders")
    p.add_argument("--scenario", choices=("auto", "ato", "impersonation"), default="auto")
    p.add_argument("--compromise-date", help="ISO time of the attacker's first known action")
    p.add_argument("--lookback-days", type=int, default=90)
    p.add_argument("--campaign-threshold", type=float, help="similarity from which two messages are one campaign")
    p.add_argument("--tier1-threshold", type=int, help="score from which an inbound message of the window is Tier 1")
    for name in ("impersonated", "fraud-account", "victim-domain", "attacker-ip", "attacker-address", "attacker-domain", "attacker-subject", "rule-keyword", "owner-ip", "allowlist"):
        p.add_argument(f"--{name}", action="append", help="may be repeated, or a list with commas")
    p.add_argument("--fail-on-tier", type=int, default=0, help="exit with 3 if a message is in this tier or a higher one")
    return p


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("caseweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    anchors = S.Anchors(
        compromise_sec=_moment(a.compromise_date), lookback_days=a.lookback_days, scenario="" if a.scenario == "auto" else a.scenario, attacker_ips=_list(a.attacker_ip), attacker_addresses=_list(a.attacker_address),
        rule_keywords=_list(a.rule_keyword), fraud_accounts=_list(a.fraud_account), impersonated=_list(a.impersonated), subjects=tuple(a.attacker_subject or ()), attacker_domains=_list(a.attacker_domain),
    )
    said = {"campaign_threshold": a.campaign_threshold, "tier1": a.tier1_threshold}
    t = replace(C.load(a.config) if a.config else C.DEFAULTS, **{k: v for k, v in said.items() if v is not None})
    read = mail.read_mbox if a.mail.lower().endswith((".mbox", ".mbx")) else mail.read_eml
    found = evidence.collect(spark, a.evidence, {"audit": a.audit_log, "signin": a.signin_logs, **{KINDS[k]: getattr(a, k.replace("-", "_")) for k in EXPORTS}})
    got = case.investigate(
        read(spark, a.mail), anchors, found.sources.get("audit"), _list(a.owner_ip), t, _list(a.victim_domain), found.sources.get("signin"), evidence={k: v for k, v in found.sources.items() if k not in ("audit", "signin")},
        allowlist=_list(a.allowlist), containment_sec=_moment(a.containment_date), lure_window_sec=60 * max(1, a.signin_window_minutes),
    )
    if a.csv:
        sinks.write_messages_csv(got.messages, a.csv)
    if a.ioc:
        sinks.write_iocs_csv(got.iocs, a.ioc)
    if a.exposure_csv and "exposure" in got.frames:
        scope = got.exposure.select("message_id", F.col("reads").alias("accesses"), "first_sec", F.col("first_access").alias("access_type"), F.col("lower_bound").alias("throttled"), F.lit("").alias("client_ip"), F.lit("").alias("session_id"))
        sinks.write_exposure_csv(report.exposure_inventory(scope, got.messages), a.exposure_csv)
    if a.html:
        sinks.write_html(report.report_subset(got.messages, got.verdict, a.html_limit).select("path", "sec", "sender", "subject", "score", "tier", "confirmed"), a.html)
    if a.diagnostic:
        sinks.write_diagnostic(report.diagnostic(got.statistics, got.messages), a.diagnostic)
    if a.json:
        sinks.write_json({k: v for k, v in got.frames.items() if k not in ("messages",)}, a.json)
    for title, df in report.console(got.frames).items():
        print(title)
        df.show(truncate=80)
    if a.fail_on_tier and not got.tiers.filter(f"tier <= {a.fail_on_tier}").isEmpty():
        return 3
    return 0


if __name__ == "__main__":
    sys.exit(main())

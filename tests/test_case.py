from email.message import EmailMessage

import pytest

from caseweave.__main__ import main
from caseweave.operators.scenario import Anchors
from caseweave.plans import case
from caseweave.sources import evidence, exports, mail


def put(folder, i, sender, subject, body, day=1, reply=None, result="pass", **headers):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = sender, "vic@corp.example", subject
    m["Date"] = f"{day:02} Jan 2024 10:{i:02}:00 +0000"
    m["Message-ID"] = f"<m{i}@x.example>"
    m["Authentication-Results"] = f"mx; dmarc={result}"
    m["Received"] = f"from a by b; {day:02} Jan 2024 10:{i:02}:00 +0000"
    m["Received"] = f"from c by a; {day:02} Jan 2024 10:{i:02}:00 +0000"
    if reply:
        m["In-Reply-To"] = f"<m{reply}@x.example>"
    for k, v in headers.items():
        m[k.replace("_", "-")] = v
    m.set_content(body)
    (folder / f"{i:03}.eml").write_bytes(m.as_bytes())


@pytest.fixture(scope="module")
def corpus(tmp_path_factory):
    d = tmp_path_factory.mktemp("case")
    for i in range(8):
        put(d, i, "Pat <pat@partner.example>", f"Minutes {i}", "Here are the minutes of our meeting.")
    put(d, 20, "Help <it@c0rp-login.example>", "Security alert", "Unusual activity: verify your account at http://203.0.113.9/login?next=x", day=5, result="fail")
    put(d, 21, "Help <it@c0rp-login.example>", "Security alert", "Unusual activity: verify your account at http://203.0.113.9/login?next=x", day=6, result="fail")
    put(d, 22, "Pat <pat@partner.example>", "Re: Minutes 1", "Thanks!", day=7, reply=1)
    (d / "audit.jsonl").write_text(
        '{"CreationTime": "2024-01-08T00:00:00Z", "Operation": "New-InboxRule", "UserId": "vic@corp.example", "ClientIP": "198.51.100.66", "SessionId": "s1", "Parameters": [{"Name": "Name", "Value": "."}, {"Name": "ForwardTo", "Value": "x@evil.example"}]}\n'
        '{"CreationTime": "2024-01-08T00:05:00Z", "Operation": "HardDelete", "UserId": "vic@corp.example", "ClientIP": "198.51.100.67", "SessionId": "s1", "AffectedItems": [{"InternetMessageId": "<m21@x.example>"}]}\n'
        '{"CreationTime": "2024-01-02T00:05:00Z", "Operation": "Send", "UserId": "vic@corp.example", "ClientIP": "192.0.2.1", "SessionId": "s0"}\n'
    )
    return d


def test_with_an_audit_log(spark, corpus):
    got = case.investigate(mail.read_eml(spark, str(corpus)), audit=exports.read_audit(spark, str(corpus / "audit.jsonl")), victim_domains=("corp.example",))
    assert got.anchors.attacker_ips == ("198.51.100.66", "198.51.100.67") and got.anchors.scenario == "ato"
    tiers = {r.path.rsplit("/", 1)[-1]: r.tier for r in got.tiers.collect()}
    assert tiers["021.eml"] == 1 and tiers["020.eml"] == 2 and tiers["003.eml"] == 3
    v = got.verdict.collect()
    assert len(v) == 1 and v[0].path.endswith("020.eml")
    assert {r.path.rsplit("/", 1)[-1] for r in got.message_events.filter("confirmed").collect()} == {"021.eml"}
    threads = {r.path.rsplit("/", 1)[-1]: r.thread for r in got.threads.collect()}
    assert threads["022.eml"] == threads["001.eml"] == "<m1@x.example>"
    assert {(r.type, r.value) for r in got.iocs.collect()} >= {("sender_domain", "c0rp-login.example"), ("url", "http://203.0.113.9/login?next=x")}
    sums = {r.path: r.s for r in got.findings.groupBy("path").agg({"weight": "sum"}).withColumnRenamed("sum(weight)", "s").collect()}
    scored = {r.path: r for r in got.messages.collect()}
    assert all(scored[p].base_score >= 0 for p in sums)
    assert [r.is_attacker for r in got.sessions.orderBy("session_id").collect()] == [False, True]
    assert [r.size for r in got.campaigns.filter("size = 2").collect()] == [2]


def test_without_logs_and_empty(spark, corpus, tmp_path):
    got = case.investigate(mail.read_eml(spark, str(corpus)), Anchors(attacker_addresses=("it@c0rp-login.example",)))
    assert got.anchors.attacker_ips == () and got.verdict.count() == 1
    none = case.investigate(mail.read_eml(spark, str(corpus)).limit(0))
    assert all(f.count() == 0 for n, f in none.frames.items() if n != "case_page")
    assert {r.answer for r in none.case_page.collect()} == {"not established"}


def test_command_line(spark, corpus, tmp_path):
    code = main([str(corpus), "--audit-log", str(corpus / "audit.jsonl"), "--victim-domain", "corp.example", "--csv", str(tmp_path / "c"), "--ioc", str(tmp_path / "i"), "--fail-on-tier", "1"], spark)
    assert code == 3
    assert spark.read.option("header", True).csv(str(tmp_path / "i")).count() > 2


@pytest.fixture(scope="module")
def folder(tmp_path_factory):
    d = tmp_path_factory.mktemp("evidence")
    (d / "EntraAuditLogs.json").write_text('[{"id": "1", "activityDisplayName": "Consent to application", "result": "success", "activityDateTime": "2024-01-08T01:00:00Z", "initiatedBy": {"user": {"userPrincipalName": "vic@corp.example", "ipAddress": "198.51.100.66"}}, "targetResources": [{"displayName": "Evil App", "modifiedProperties": [{"displayName": "x", "newValue": "Mail.Read offline_access", "oldValue": ""}]}]}]')
    (d / "OAuthPermissions.csv").write_text("ClientDisplayName,Permission,PrincipalDisplayName,ConsentType,ClientId\nEvil App,Mail.Send,vic,Principal,9\nTame,openid,vic,Principal,8\n")
    (d / "MailboxRules.csv").write_text("Name,Mailbox,ForwardTo,MoveToFolder,DeleteMessage,SubjectContainsWords\n.,vic@corp.example,x@evil.example,,False,\nquiet,vic@corp.example,,RSS Feeds,False,wire\nfiled,vic@corp.example,,Archive,False,\n")
    (d / "MailboxPermissions.csv").write_text("Identity,User,AccessRights,IsInherited\nvic@corp.example,out@evil.example,FullAccess,False\nvic@corp.example,NT AUTHORITY\\SELF,FullAccess,False\n")
    (d / "TransportRules.csv").write_text("Name,State,RedirectMessageTo\nleak,Enabled,y@evil.example\nplain,Enabled,\n")
    (d / "MessageTrace.csv").write_text("MessageId,SenderAddress,RecipientAddress,Subject,Status,FromIP,Received\n<gone@x>,vic@corp.example,a@bank.example,pay,Delivered,198.51.100.66,2024-01-08T02:00:00Z\n<m1@x.example>,vic@corp.example,b@corp.example,in,Delivered,,2024-01-08T02:00:00Z\n<lost@x>,vic@corp.example,c@far.example,pay,Failed,,2024-01-08T02:00:00Z\n<early@x>,vic@corp.example,d@old.example,pay,Delivered,,2024-01-01T02:00:00Z\n")
    (d / "Users.csv").write_text("UserPrincipalName,DisplayName,ProxyAddresses\nvic@corp.example,Vic Tim,\npat@corp.example,Pat Partner,\n")
    (d / "AcceptedDomains.csv").write_text("DomainName\ncorp.example\n")
    (d / "MailboxAuditStatus.csv").write_text("Identity,AuditEnabled,AuditOwner\nvic@corp.example,True,MailItemsAccessed\n")
    (d / "Devices.csv").write_text("DisplayName,DeviceId,TrustType,RegisteredOwners\nphone,d1,Workplace,vic@corp.example\n")
    (d / "SignInLogs.json").write_text('[{"createdDateTime": "2024-01-08T00:00:00Z", "userPrincipalName": "vic@corp.example", "correlationId": "c", "isInteractive": true, "ipAddress": "198.51.100.67", "status": {"errorCode": 0}, "deviceDetail": {"deviceId": "d1"}}]')
    return d


def test_with_an_evidence_folder(spark, corpus, folder):
    found = evidence.collect(spark, str(folder), {"audit": str(corpus / "audit.jsonl")})
    assert set(found.sources) == {"audit", "signin", "entra_audit", "oauth", "rules", "permissions", "transport", "trace", "users", "domains", "audit_status", "devices"} and not found.unrecognised
    rest = {k: v for k, v in found.sources.items() if k not in ("audit", "signin")}
    got = case.investigate(mail.read_eml(spark, str(corpus)), audit=found.sources["audit"], victim_domains=("corp.example",), signins=found.sources["signin"], evidence=rest)
    assert got.anchors.attacker_ips == ("198.51.100.66",)  # a device of the owner's vouches for the other
    assert sorted((r.source, r.target, r.by_attacker) for r in got.persistence.collect()) == [("entra_audit", "Evil App", True), ("oauth_permissions", "Evil App", True)]
    assert sorted((r.kind, r.target) for r in got.drift.collect()) == [("delegation", "out@evil.example -> vic@corp.example"), ("inbox_rule", "quiet"), ("transport_rule", "leak")]
    plan = got.remediation.orderBy("rank").collect()
    assert (plan[0].kind, plan[0].sources, len(plan)) == ("oauth_consent", "entra_audit,oauth_permissions", 4)
    assert sorted(r.id for r in got.trace_gap.collect()) == ["gone@x", "lost@x"]
    assert [tuple(r) for r in got.notification.collect()] == [("bank.example", 1, 1)]
    assert [(r.from_ip, r.status, r.messages) for r in got.attacker_sent.collect()] == [("198.51.100.66", "delivered", 1)]
    assert [(r.users, r.accepted_domains) for r in got.directory.collect()] == [(2, 1)]
    assert [tuple(r) for r in got.audit_status.collect()] == [("vic@corp.example", True, True)]
    assert got.rule_cleanup.count() == 0 and got.delegates.count() == 0 and got.impersonation.count() == 0
    page = {r.question: r.answer for r in got.case_page.collect()}
    assert len(page) == 9 and page["when"] == "2024-01-08T00:00:00Z" and page["notified"] == "1 recipients in 1 external domains" and page["persistence"].endswith("2 of them the attacker's")
    told = got.narrative.collect()
    assert [r.phase for r in told] == ["initial access", "account access", "persistence"] and told[0].ref.endswith("020.eml")


def test_containment_allowlist_and_anchors(spark, corpus):
    read = mail.read_eml(spark, str(corpus))
    got = case.investigate(read, Anchors(attacker_domains=("c0rp-login.example",), impersonated=("pat",)), exports.read_audit(spark, str(corpus / "audit.jsonl")), containment_sec=1704067200)
    assert got.anchors.attacker_ips == () and got.anchors.rule_keywords == ()
    hits = {r.path.rsplit("/", 1)[-1]: r.anchors for r in got.messages.collect()}
    assert hits["020.eml"] == 1 and hits["003.eml"] == 1
    rule = lambda allow: {n for n, *_ in case.base_rules(read, case.C.DEFAULTS, allow)}
    assert rule(()) == rule(("x.example",))


def test_diagnostic_names_nobody(spark, corpus, folder, tmp_path):
    code = main([str(corpus), "--audit-log", str(corpus / "audit.jsonl"), "--message-trace", str(folder / "MessageTrace.csv"), "--diagnostic", str(tmp_path / "d"), "--html", str(tmp_path / "h")], spark)
    assert code == 0 and spark.read.json(str(tmp_path / "d")).filter("section = 'tier'").agg({"n": "sum"}).first()[0] == 11

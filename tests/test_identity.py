from pyspark.sql import functions as F

from caseweave.operators import graph, identity, scenario

AUDIT = "id long, activity string, result string, sec long, actor string, ip string, target string, permission string"


def rows(spark):
    return spark.createDataFrame([
        (1, "Consent to application", "success", 100, "vic@x.example", "203.0.113.5", "Evil App", "Mail.Read offline_access"),
        (2, "Consent to application", "success", 100, "admin", "198.51.100.1", "Nice App", "openid.x profile"),
        (3, "Consent to application", "success", 100, "admin", "198.51.100.1", "Dark App", "unreadable"),
        (4, "Add member to role", "failure", 100, "admin", "", "r", ""),
        (5, "Set domain authentication on d", "success", 50, "admin", "", "d.example", ""),
        (6, "Add device", None, 120, "VIC@x.example", "", "laptop", None),
        (7, "Something else", "success", 1, "", "", "", ""),
    ], AUDIT)


def test_persistence_and_plan(spark):
    grants = spark.createDataFrame([(10, "evil app ", "Mail.Send", "someone", 5), (11, "Other", "User.Read", "x", 5)], "id long, app string, permission string, principal string, sec long")
    events = identity.directory_audit(rows(spark)).unionByName(identity.oauth_grants(grants))
    got = {r.id: r for r in identity.persistence(events, ("203.0.113.5",), 90, 200, ("vic@x",)).collect()}
    assert set(got) == {1, 3, 5, 6, 10}
    assert {i for i, r in got.items() if r.by_attacker} == {1, 6, 10}
    assert (got[1].severity, got[5].severity, got[6].severity) == ("high", "high", "low")
    plan = identity.remediation_plan(identity.persistence(events, ("203.0.113.5",), 90, 200, ("vic@x",)))
    p = [(r["rank"], r.kind, r.target.strip(), r.sources) for r in plan.orderBy("rank").collect()]
    assert (*p[0][:2], p[0][2].lower(), p[0][3]) == (1, "oauth_consent", "evil app", "entra_audit,oauth_permissions") and p[1][1] == "device" and p[2][1] == "federation"


def test_scopes(spark):
    df = spark.createDataFrame([("Mail.Read, Files.Read.All;offline_access",), ("hello",), (None,)], "p string")
    got = [r[0] for r in df.select(identity.classify_scopes(F.col("p"))).collect()]
    assert (got[0].mail, got[0].high, got[0].durable, got[0].readable) == (["mail.read"], ["files.read.all"], ["offline_access"], True)
    assert not got[1].readable and not got[2].readable


def test_directory(spark):
    users = identity.directory_users(spark.createDataFrame([("ann@x.example", "Ann B. Lee", "CFO", "SMTP:ann@x.example;smtp:a.lee@x.example")], "user_principal_name string, display_name string, title string, proxy_addresses string"))
    m = spark.createDataFrame([(1, "Lee, Ann", "ann@evil.example"), (2, "Ann Lee", "A.Lee@x.example"), (3, "Ann", "z@z")], "path long, sender_name string, sender string")
    assert [tuple(r) for r in identity.impersonation(m, users).collect()] == [(1, "Ann B. Lee")]


def test_rules_and_permissions(spark):
    r = identity.mailbox_rules(spark.createDataFrame([(".", "v", "smtp:out@evil.example", "", "no", '"wire"; invoice'), ("Sorting", "v", "", "RSS Feeds", "", "")], "name string, mailbox string, forward_to string, move_to string, delete string, words string"))
    got = r.orderBy("name").collect()
    assert (got[0].forwards, got[0].words, got[0].conceals) == (["out@evil.example"], ["wire", "invoice"], True) and got[1].conceals
    f = identity.rule_findings(r.withColumns({"mark_read": F.lit(False), "stop": F.lit(False)}))
    assert sorted((x.name, x.odd_name, x.suspicious) for x in f.collect()) == [(".", True, True), ("Sorting", False, True)]
    p = spark.createDataFrame([("m", "NT AUTHORITY\\SELF", "Full", "False"), ("m", "Eve", "Full", "False"), ("m", "Dan", "Full", "True")], "mailbox string, user string, rights string, inherited string")
    assert [x.user for x in identity.mailbox_permissions(p).collect()] == ["eve"]
    s = spark.createDataFrame([(1, "A", "True"), (2, "a", "False"), (3, "b", "True")], "seq long, mailbox string, enabled string")
    assert [x.enabled for x in identity.audit_status(s, "A").collect()] == [False] and identity.audit_status(s, "c").count() == 0


def test_owner_and_geo(spark):
    s = spark.createDataFrame([("U", "1.0.0.1", True, "d1"), ("u", "1.0.0.2", False, "d1"), ("w", "1.0.0.3", True, "d1")], "user string, ip string, interactive boolean, device_id string")
    d = spark.createDataFrame([("d1", "u")], "device_id string, owner string")
    assert [r.ip for r in identity.owner_addresses(s, d).collect()] == ["1.0.0.1"]
    ranges = spark.createDataFrame([(16777216, 16777216 + 65535, "AA"), (16777216 + 65536 * 2, 16777216 + 65536 * 4, "BB")], "lo long, hi long, country string")
    ips = spark.createDataFrame([("1.0.0.9",), ("1.3.0.1",), ("9.9.9.9",)], "ip string")
    assert sorted((r.ip, r.country) for r in identity.geo_lookup(ips, ranges).collect()) == [("1.0.0.9", "AA"), ("1.3.0.1", "BB"), ("9.9.9.9", None)]


def test_initial_score(spark):
    cols = ", ".join(f"{f} boolean" for f in scenario.FLAGS)

    def row(path, text="", inbound=True, anchors=0, sec=50, **on):
        return (path, text, inbound, anchors, sec, *[on.get(f, False) for f in scenario.FLAGS])

    a = scenario.Anchors(compromise_sec=100)
    df = spark.createDataFrame([
        row(1, "please verify your account", has_url=True), row(2, "please verify your account", inbound=False), row(3, auth_anomaly=True), row(4, auth_anomaly=True, lookalike=True),
        row(5, "hello", established=True, reply_to_mismatch=True), row(6, sec=200, lookalike=True), row(7, anchors=2, sec=50),
    ], f"path long, text string, inbound boolean, anchors int, sec long, {cols}")
    got = [r[0] for r in df.orderBy("path").select(scenario.initial_score(df, True, a)).collect()]
    assert got == [10, 0, 1, 11, 1, 0, 16]
    money = spark.createDataFrame([row(1, "urgent payment to our new bank")], f"path long, text string, inbound boolean, anchors int, sec long, {cols}")
    assert money.select(scenario.initial_score(money, False, a)).first()[0] == 4 + 5 + 2


def test_anchors(spark):
    a = scenario.Anchors(attacker_ips=("1",), compromise_sec=10).merged(scenario.Anchors(attacker_ips=("2", "1"), compromise_sec=99, scenario="ato"))
    assert (a.attacker_ips, a.compromise_sec, a.scenario) == (("1", "2"), 10, "ato")
    df = spark.createDataFrame([(1, "pay DE12-34 56", "Evil@x", "Re: Deal")], "path long, body string, sender string, subject string")
    a = scenario.Anchors(attacker_addresses=("evil@x",), fraud_accounts=("de1234 56",), subjects=("deal",))
    assert len(df.select(scenario.anchor_matches(df, a)).first()[0]) == 3


def test_case_page_and_narrative(spark):
    t = spark.createDataFrame([("a lure",)], "text string")
    rows = scenario.case_page({"entry": t, "read": t.limit(0)}).collect()
    assert [r.question for r in rows] == list(scenario.QUESTIONS) and rows[0].answer == "a lure" and rows[4].answer == "not established"
    e = spark.createDataFrame([(5, "m1", "lure")], "sec long, ref string, what string")
    assert [r.phase for r in scenario.narrative(e, e.limit(0), e, e).collect()] == ["initial access", "persistence", "impact"]


def test_thread_roots_with_cycles_and_gaps(spark):
    df = spark.createDataFrame([("a", None), ("b", "a"), ("c", "b"), ("d", "gone"), ("x", "y"), ("y", "z"), ("z", "x"), ("w", "x")], "id string, parent string")
    got = {r.id: (r.root, r.steps) for r in graph.thread_roots(df, rounds=5).collect()}
    assert {k: got[k] for k in "abcd"} == {"a": ("a", 0), "b": ("a", 1), "c": ("a", 2), "d": ("d", 0)}
    assert {got[k][0] for k in "xyz"} == {"x"} and got["x"][1] is None


def test_components_ignore_order(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7)]
    for e in (links, links[::-1]):
        got = {r.node: r.component for r in graph.components(spark.createDataFrame(e, "a long, b long")).collect()}
        assert got == {**{i: 0 for i in range(41)}, 100: 100, 101: 100}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []

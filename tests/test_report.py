import dataclasses
import random
import re

from pyspark.sql import functions as F

from caseweave import config as C
from caseweave import signins, sinks
from caseweave.functions import auth, files, text
from caseweave.operators import audit as A
from caseweave.operators import baseline as B
from caseweave.operators import body as X
from caseweave.operators import campaigns as K
from caseweave.operators import identity as I
from caseweave.operators import report as Q
from caseweave.operators import signin as S
from caseweave.operators import threads as T
from caseweave.plans import signin_case
from caseweave.sources import evidence, mail


def test_templates_equal_pythons(spark):
    rows = ["at 2024-01-02T03:04:05Z on 2024-01-02 12:30", "me@a.example 10.0.0.1 fe80::1:2 https://x.y/z a.b.example c.com", r"C:\x\y /etc/passwd <a@b> 'it' \"q\" abcdef123456789 (x1) (purges) within 0h, 1,234", "deadbeefdeadbeefdead", "attachment_0", ""]
    rng = random.Random(3)
    rows += ["".join(rng.choice(["a", "1", ".", ":", "@", "/", "'", '"', "(", ")", " ", "ab12", "2024-01-01", "-", "<", ">"]) for _ in range(30)) for _ in range(300)]
    got = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i long, t string").select("i", text.template(F.col("t")).alias("x")).orderBy("i").collect()
    for r, row in zip(got, rows):
        for pattern, mask in text.TEMPLATE_RULES:
            row = re.sub(pattern, lambda m, mask=mask: mask, row, flags=re.ASCII)
        assert r.x == re.sub(r"\s+", " ", row).strip()


def test_alike_names_share_a_key(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("ab0o1lrnmvw.") for _ in range(rng.randint(4, 8))) for _ in range(60)]
    edits = [n[:i] + rng.choice(["", rng.choice("ab0o"), n[i : i + 1] + rng.choice("ab0o")]) + n[i + 1 :] for n in base for i in (0, 3, len(n) - 1)]
    names = sorted({*base, *edits})
    df = spark.createDataFrame([(n,) for n in names], "name string")
    want = df.alias("a").crossJoin(df.alias("b")).filter(text.looks_alike(F.col("a.name"), F.col("b.name"))).select("a.name", "b.name").collect()
    got = B.lookalikes(df, df).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 20


def test_campaign_pairs_without_caps_equal_all_pairs(spark):
    rng = random.Random(5)
    rows = [(i, rng.choice("xy"), rng.choice("de"), rng.sample(["aaa", "bbb", "ccc", "ddd"], rng.randint(0, 3)), rng.sample(["t1", "t2", "t3"], rng.randint(0, 2)), rng.sample(["u1", "u2"], rng.randint(0, 1)), rng.randint(0, 60)) for i in range(120)]
    f = spark.createDataFrame(rows, "path long, sender string, domain string, subject_tokens array<string>, terms array<string>, urls array<string>, day long").withColumns({c: F.array().cast("array<string>") for c in ("files", "hashes", "recipients")})
    keys = {"sender": (F.array("sender"), False), "domain": (F.array("domain"), True), "url": (F.col("urls"), False), "term": (F.col("terms"), True)}
    got = K.campaign_links(f, keys).collect()
    s = f.select("path", F.struct(*f.columns).alias("f"))
    every = s.alias("x").join(s.alias("y"), F.col("x.path") < F.col("y.path")).select(F.col("x.f").alias("a"), F.col("y.f").alias("b")).withColumn("similarity", K.similarity("a", "b"))
    share = (F.col("a.sender") == F.col("b.sender")) | (F.col("a.domain") == F.col("b.domain")) | F.arrays_overlap("a.urls", "b.urls") | F.arrays_overlap("a.terms", "b.terms")
    want = every.filter(share & (F.col("similarity") >= C.DEFAULTS.campaign_threshold)).select("a.path", "b.path", "similarity").collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and len(got) > 300
    small = K.candidate_pairs(f, keys, part=8).select("a.path", "b.path").collect()
    assert sorted(map(tuple, small)) == sorted((tuple(r)) for r in every.filter(share).select("a.path", "b.path").collect())


def test_join_of_campaign_pairs_is_compiled_and_equals_all_pairs(spark):
    rng = random.Random(7)
    some = lambda of, n: [rng.choice(of) for _ in range(rng.randint(0, n))]
    rows = [(i, rng.choice(["x", "y", ""]), rng.choice(["d", "e"]), some("abcdef", 6), some(["t1", "t2", "t3"], 3), some(["u1", "u2", "u3"], 4), some(["f"], 1), some(["h1", "h2", "h3"], 1), some(["r1", "r2"], 2), rng.choice([None, *range(60)])) for i in range(150)]
    rows = [(*r[:3], sorted(set(r[3])), *r[4:]) for r in rows]
    f = spark.createDataFrame(rows, "path long, sender string, domain string, subject_tokens array<string>, terms array<string>, urls array<string>, files array<string>, hashes array<string>, recipients array<string>, day long")
    keys = {"sender": (F.array("sender"), False), "domain": (F.array("domain"), True), "url": (F.col("urls"), False), "term": (F.col("terms"), True)}
    s = f.select("path", F.struct(*f.columns).alias("f"))
    every = s.alias("x").join(s.alias("y"), F.col("x.path") < F.col("y.path")).select(F.col("x.f").alias("a"), F.col("y.f").alias("b")).withColumn("similarity", K.similarity("a", "b"))
    share = ((F.col("a.sender") == F.col("b.sender")) & (F.col("a.sender") != "")) | (F.col("a.domain") == F.col("b.domain")) | F.arrays_overlap("a.urls", "b.urls") | F.arrays_overlap("a.terms", "b.terms")
    want = sorted(map(tuple, every.filter(share & (F.col("similarity") >= C.DEFAULTS.campaign_threshold)).select("a.path", "b.path", "similarity").collect()))
    assert sorted(map(tuple, K.campaign_links(f, keys).collect())) == want and len(want) > 300
    members = K._members(K._sketched(f), keys, C.DEFAULTS, K.COMPARED)
    small = K._linked(members, C.DEFAULTS.campaign_threshold, ["path"], part=16).select(F.least("x_path", "y_path"), F.greatest("x_path", "y_path"), "similarity")
    assert sorted(map(tuple, small.collect())) == want
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        plan = K.campaign_links(f.withColumns({c: F.array().cast("array<string>") for c in ("urls", "files", "hashes", "recipients")}), keys)._jdf.queryExecution().executedPlan()
        assert re.search(r"\*\(\d+\) ShuffledHashJoin \[cell", plan.toString())
        sizes = re.findall(r"maxMethodCodeSize:(\d+)", getattr(getattr(spark._jvm.org.apache.spark.sql.execution.debug, "package$"), "MODULE$").codegenString(plan))
        assert sizes and max(map(int, sizes)) < 8000
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_small_expressions(spark):
    d = spark.createDataFrame([(["mx; dmarc=fail reason=\"p reject\"; spf=pass; dkim=none"],), (["mx; spf=pass"],)], "h array<string>")
    assert [r[0] for r in d.select(auth.fail_reason(auth.auth_detail(F.col("h")))).collect()] == ["dmarc=fail p reject; dkim=none", ""]
    d = spark.createDataFrame([("Bonn", "DE"), ("", "DE"), (None, None)], "a string, b string")
    assert [r[0] for r in d.select(S.location(F.col("a"), F.col("b"))).collect()] == ["Bonn, DE", "DE", "?"]
    d = spark.createDataFrame([([("u1", "d", 1), ("u2", "d", 9), ("u3", "", 5), ("u3", "", 5)],)], "a array<struct<url:string,domain:string,score:int>>")
    assert [x.url for x in d.select(Q.slim_urls(F.col("a")).alias("x")).first().x] == ["u2", "u3"]
    a = spark.createDataFrame([([("x.docm", "zip", ["macro extension"]), (None, "", ["executable in archive"])],)], "a array<struct<filename:string,sniffed_type:string,flags:array<string>>>")
    assert a.select(files.threat_notes(F.col("a")).alias("x")).first().x == ["macro-enabled attachment x.docm", "archive (unnamed) contains executable/script files"]
    d = spark.createDataFrame([('{"user": {"userPrincipalName": "a@b", "ipAddress": "1.2.3.4"}}', "", ""), ("@{user=@{userPrincipalName=c@d; x=1}}", None, "9.9.9.9"), ("plain", "", ""), (None, "z", None)], "i string, a string, p string")
    assert [tuple(r[0]) for r in d.select(I.initiator(F.col("i"), F.col("a"), F.col("p"))).collect()] == [("a@b", "1.2.3.4"), ("c@d", "9.9.9.9"), ("plain", ""), ("z", "")]
    d = spark.createDataFrame([('[{"displayName": "App", "modifiedProperties": [{"displayName": "X.Y", "newValue": "Mail.Read", "oldValue": ""}]}, {"id": "7"}]',), ("Some app",), (None,)], "t string")
    assert [(r[0].names, r[0].permission.strip()) for r in d.select(I.targets(F.col("t"))).collect()] == [(["App", "7"], "Mail.Read"), (["Some app"], "Some app"), ([], "")]


def test_page_cap(spark):
    def of(*n):
        rows = S.page_cap(spark.createDataFrame([(f"f{i:02}", x) for i, x in enumerate(n)], "file string, n long")).collect()
        return rows[0].suspected if rows else None

    assert [of(1000, 1000), of(1000, 1000, 312), of(1000), of(1000, 312, 1000), of(1000, 1000, 1000, 1000, 7, 1000), of(1000, 1000, 2000), of(12, 40), of(500, 1000)] == [True, False, False, False, True, False, False, False]
    assert of() is None and of(999, 999, 999, 999, 999, 999, 999, 999, 10, 11) is True


def test_signin_case(spark):
    row = {"ip": "9.9.9.9", "asn": "1", "country": "DE", "agent": "curl/8", "app": "x", "transfer": "", "protocol": "", "requirement": "", "token_type": "", "client_app": "", "risk": "", "code": "", "ok": True, "interactive": True, "device_id": "", "file_name": "f"}
    rows = [row | {"sec": 1000 + i, "user": "vic@corp", "corr": "c1", "transfer": "deviceCodeFlow", "ip": ip} for i, ip in enumerate(("9.9.9.9", "8.8.8.8"))]
    rows += [row | {"sec": 5000, "user": "ann@corp", "corr": "c2", "protocol": "deviceCode", "ip": "6.6.6.6"}, row | {"sec": 10, "user": "vic@corp", "corr": ""}]
    got = signin_case.analyze(spark.createDataFrame(rows), ("6.6.6.6",))
    assert {(r.corr, r.verdict, tuple(r.matched_ips)) for r in got["groups"].collect()} == {("c1", "attack", ()), ("c2", "attack", ("6.6.6.6",))}
    m = spark.createDataFrame([("p1", "go to microsoft.com/devicelogin with code ABCD1234", 500, ["VIC@corp"]), ("p2", "hello", 500, ["vic@corp"]), ("p3", "see microsoft.com/devicelogin", 9999, ["vic@corp"])], "path string, body string, sec long, recipients array<string>")
    assert [r.path for r in signin_case.confirmed_lures(m, got["tokens"]).collect()] == ["p1"]
    assert got["log"].filter("device_code").count() == 3 and got["aitm"].filter("user = 'ann@corp'").count() == 0
    assert S.leg_rows(got["log"]).filter("client = 'curl/8' AND location = 'DE'").count() == 4


def test_bodies(spark):
    tail = "This footer stands below every message that our company sends to anyone at all."
    rows = [(f"p{i}", f"s{i % 4}", 100 + i * 3, f"Own words number {i}, which are long enough to be a block of their own here.\n\n{tail}\n-- \nname") for i in range(12)]
    rows += [("q", "s1", 100, "Thanks!\n\nOn Monday X wrote:\n> old"), ("e", "s1", 100, "")]
    got = {r.path: r for r in X.prepare_bodies(spark.createDataFrame(rows, "path string, sender string, day long, body string")).collect()}
    assert all(tail not in got[f"p{i}"].body and f"number {i}," in got[f"p{i}"].body and "name" not in got[f"p{i}"].body for i in range(12))
    assert got["q"].body == "Thanks!" and "old" in got["q"].quoted and got["e"].body == "" and not got["q"].burst


def test_precursor_indicators_and_subjects(spark):
    m = spark.createDataFrame([("a", 1, 0, "initial_contact", "", ["d1"], [], ["Login link"]), ("b", 2, 40, "initial_contact", "", ["d1"], [], []), ("c", 0, 0, "x", "", ["d2"], [], ["Payment asked", "Login"]), ("d", 0, 99, "x", "", [], [], ["Login"])], "path string, sec long, score int, stage string, campaign string, domains array<string>, hashes array<string>, evidence array<string>")
    r = T.shared_precursor(m).collect()
    assert [(x.path, x.shared_with, x.confidence) for x in r] == [("a", 1, "medium")]
    k = spark.createDataFrame([("k", "1", "s", "d", 20, True, ["u"], ["a.pdf"]), ("k", "2", "s", "e", 1, False, ["u"], []), ("l", "3", "t", "", 1, False, [], [])], "campaign string, path string, sender string, domain string, score int, precursor boolean, urls array<string>, files array<string>")
    got = {r.campaign: r.indicators for r in K.campaign_indicators(k).collect()}
    assert len(got["k"]) == 5 and got["l"] == [] and got["k"][0] == "Repeated sender identity across campaign"
    e = spark.createDataFrame([("send", 10, "1.1.1.1", ["RE: Invoice 7"]), ("send", 1, "2.2.2.2", ["Invoice 7"]), ("update", 10, "3.3.3.3", ["Invoice 7"]), ("send", None, "4.4.4.4", ["invoice  7"])], "op_lower string, sec long, ip string, subjects array<string>")
    assert {r.ip for r in A.subject_senders(e, ("Invoice 7",), 5).collect()} == {"1.1.1.1", "4.4.4.4"} and A.subject_senders(e, ()).collect() == []
    rules = spark.createDataFrame([({"Subject": ["Bank "]}, []), ({}, ["bank", "pay"]), (None, ["pay"])], "conditions map<string,array<string>>, keywords array<string>")
    assert {r.keyword: r.fields for r in B.rule_keyword_fields(rules).collect()} == {"bank": ["subject"], "pay": ["body", "subject"]}


def test_report_and_scanners(spark, tmp_path):
    m = spark.createDataFrame([("a", 1, 5, 3, None), ("b", 2, 0, 1, False), ("c", 3, 0, 3, True), ("d", 4, 0, 3, False), ("e", 5, 9, 3, False)], "path string, sec long, score int, tier int, confirmed boolean")
    v = spark.createDataFrame([("d",)], "path string")
    assert [r.path for r in m.orderBy(*Q.candidate_order()).collect()][:3] == ["c", "e", "a"]
    subset = Q.report_subset(m, v, 1)
    assert {r.path for r in subset.collect()} == {"b", "c", "d"}
    sinks.write_html(subset, str(tmp_path / "h"))
    page = "".join(r.value for r in spark.read.text(str(tmp_path / "h")).collect())
    assert '"path":"c"' in page and page.count("</script>") == 2
    hits = spark.createDataFrame([("a", "x.doc", "R2"), ("a", "x.doc", "R1")], "path string, filename string, detail string")
    f = Q.scanner_findings(hits, "yara").first()
    assert (f.signal, f.weight, f.severity) == ("Attachment matches scan rules: R1, R2 (x.doc)", 10, "high")
    assert {(r.path, r.tier) for r in Q.lift_scanned(m.select("path", "tier"), hits).collect()} >= {("a", 1), ("c", 3)}
    assert Q.scan_fingerprint({"a": b"1", "b": b"2"}, True, (2, 1)) == Q.scan_fingerprint({"z": b"2", "y": b"1"}, True, (1, 2)) != Q.scan_fingerprint({"a": b"1"}, True, (1, 2))
    assert Q.strip_private(m.withColumn("_x", F.lit(1))).columns == m.columns
    assert Q.config_deltas(C.DEFAULTS) == {} and Q.narrative_summary("ato", []).startswith("Insufficient")
    assert "Likely entry point: a - \"s\" (t)." in Q.narrative_summary("ato", [{"phase": "initial_access", "sender": "a", "subject": "s", "when": "t", "description": ""}])
    scope = spark.createDataFrame([("<M1>", 2, 100, "bind", False, "1.1.1.1", "s"), ("<m9>", 1, None, "sync", True, "", "")], "message_id string, accesses long, first_sec long, access_type string, throttled boolean, client_ip string, session_id string")
    msgs = spark.createDataFrame([("<m1>", "p", "subj", "from", ["x"])], "message_id string, path string, subject string, sender string, attachments array<string>")
    rows = Q.exposure_inventory(scope, msgs).collect()
    assert [(r.message_id, r.in_corpus, r.path, r.first_access_utc) for r in rows] == [("<M1>", True, "p", "1970-01-01T00:01:40Z"), ("<m9>", False, "", None)]
    assert Q.completeness(spark.createDataFrame([("a", 1, True), ("b", 1, False)], "message_id string, n long, present boolean")).first().absent == 1
    assert {(r.kind, r["rows"], r.first_sec) for r in Q.source_provenance({"mail": m, "x": v}).collect()} == {("mail", 5, 1), ("x", 1, None)}
    assert B.corpus_span(m.withColumn("sec", F.col("sec") * 86400)).first().days == 4 and B.corpus_span(v.withColumn("sec", F.lit(1))).first().days is None


def test_directory_and_drift(spark):
    users = spark.createDataFrame([("a@x", "Ann B. Lee", "SMTP:a@x;smtp:ann@x", "True"), ("b@x", "Lee, Ann", None, "no")], "user_principal_name string, display_name string, proxy_addresses string, enabled string")
    s = I.directory_stats(users, spark.createDataFrame([("x",)], "domain string")).first()
    assert (s.users, s.enabled, s.addresses, s.names, s.accepted_domains) == (2, 1, 3, 1, 1)
    rules = spark.createDataFrame([("r", True)], "name string, external boolean")
    transport = spark.createDataFrame([("t", ["z@evil"]), ("u", [])], "name string, redirects array<string>")
    grants = spark.createDataFrame([("m", "x@evil", True), ("m", "y@corp", False)], "mailbox string, user string, external boolean")
    got = I.remediation_plan(I.drift_actions(rules, transport, grants)).collect()
    assert {(r.kind, r.target) for r in got} == {("inbox_rule", "r"), ("transport_rule", "t"), ("delegation", "x@evil -> m")}
    ev = spark.createDataFrame([(5, "Consent", "App", "a@x"), (None, "Consent", "App", "a@x")], "sec long, activity string, target string, actor string")
    assert [(r.what, r.ref) for r in I.timeline_rows(ev).collect()] == [("Consent: App", "a@x")]


def test_mbox_bytes_and_equal_messages(spark, tmp_path):
    one = b"From a@b Mon Jan 01 00:00:00 2024\nFrom: A <a@b.example>\nSubject: x\nContent-Type: text/plain; charset=iso-8859-1\nContent-Transfer-Encoding: 8bit\n\ncaf\xe9 \xfcber\n>From here\n\n"
    (tmp_path / "m.mbox").write_bytes(one * 3 + one.replace(b"Subject: x", b"Subject: y"))
    got = mail.read_mbox(spark, str(tmp_path / "m.mbox")).collect()
    assert len(got) == 4 and len({r.path for r in got}) == 4
    assert {r.body.strip() for r in got} == {"café über\nFrom here"} and sorted(r.subject for r in got) == ["x", "x", "x", "y"]
    assert {(r.kind, r.length > 0) for r in evidence.find_containers(spark, str(tmp_path)).collect()} == {("mbox", True)}


def test_evidence_folder_and_cache(spark, tmp_path):
    (tmp_path / "SignInLogs.json").write_text('[{"createdDateTime": "2024-01-01T00:00:00Z", "userPrincipalName": "a@b", "correlationId": "c", "isInteractive": true}]')
    (tmp_path / "users.csv").write_text("UserPrincipalName,DisplayName,ProxyAddresses\na@b,Ann,\n")
    (tmp_path / "notes.txt").write_text("nothing\n")
    got = evidence.collect(spark, str(tmp_path))
    assert set(got.sources) == {"signin", "users"} and len(got.unrecognised) == 1
    assert {(r.kind, r.files, r["rows"]) for r in got.manifest(spark).collect()} == {("signin", 1, 1), ("users", 1, 1)}
    other = evidence.collect(spark, None, {"users": str(tmp_path / "users.csv")})
    assert set(other.sources) == {"users"}
    assert [(r.folder, r.first, r.last) for r in evidence.folder_ranges(spark.createDataFrame([("b", 2), ("a", 3), ("a/x", 1)], "folder string, n long")).orderBy("first").collect()] == [("a", 0, 2), ("a/x", 3, 3), ("b", 4, 5)]
    stored = spark.createDataFrame([("p1", 1, 1, "h1", "x"), ("p2", 1, 1, "h2", "y"), ("p3", 1, 1, "h3", "z")], "path string, length long, modificationTime long, sha256 string, subject string")
    listing = spark.createDataFrame([("p1", 1, 1, None), ("moved", 1, 9, "h2"), ("p3", 2, 2, "h9")], "path string, length long, modificationTime long, sha256 string")
    assert {(r.path, r.subject) for r in mail.reused_messages(listing, stored).collect()} == {("p1", "x"), ("moved", "y")}
    assert {(r.path, r.subject) for r in mail.upserted(stored, stored.filter("path = 'p1'").withColumn("subject", F.lit("n"))).collect()} == {("p1", "n"), ("p2", "y"), ("p3", "z")}


def test_prunable(spark):
    listing = spark.createDataFrame([("file:/x/out/a.eml", 1), ("file:/x/out/b.eml", 2), ("file:/x/out/c.eml", 3), ("file:/x/own/d.eml", 4), ("file:/x/out/e.eml", 5)], "path string, length long")
    tiers = spark.createDataFrame([("file:/x/out/a.eml", 3), ("file:/x/out/b.eml", 2), ("file:/x/out/c.eml", 3), ("file:/x/own/d.eml", 3)], "path string, tier int")
    hits = spark.createDataFrame([("file:/x/out/c.eml",)], "path string")
    assert [tuple(r) for r in mail.prunable(listing, tiers, hits, "/x/out").collect()] == [("file:/x/out/a.eml", 1)]


def test_sign_ins_on_their_own(spark, tmp_path, capsys):
    log = tmp_path / "SignIns.json"
    log.write_text('[{"createdDateTime": "2024-01-08T00:00:00Z", "userPrincipalName": "a@b", "correlationId": "c", "isInteractive": true, "ipAddress": "198.51.100.67", "originalTransferMethod": "deviceCodeFlow", "status": {"errorCode": 0}, "deviceDetail": {"deviceId": "d1"}}]')
    (tmp_path / "d.csv").write_text("DisplayName,DeviceId,RegisteredOwners\nphone,d1,a@b\n")
    assert signins.main([str(log), "--devices", str(tmp_path / "d.csv"), "--json", str(tmp_path / "o")], spark) == 0
    assert "198.51.100.67" in capsys.readouterr().out
    assert spark.read.json(str(tmp_path / "o" / "owner_addresses")).count() == 1


def _mail(spark, n, seed):
    rng = random.Random(seed)
    pick = lambda xs, k: rng.sample(xs, rng.randint(0, k))
    rows = [(i - i % 40 // 39, rng.choice(["x", "y", "z", "", None]), rng.choice(["d", "e", "", None]), pick([f"w{j}" for j in range(6)], 5), pick(["t1", "t2", "t3"], 2), pick(["u1", "u2"], 1), rng.choice([None, *range(0, 90, 3)])) for i in range(n)]
    f = spark.createDataFrame(rows, "path long, sender string, domain string, subject_tokens array<string>, terms array<string>, urls array<string>, day long").withColumns({c: F.array().cast("array<string>") for c in ("files", "hashes", "recipients")})
    return f, {"sender": (F.array("sender"), False), "domain": (F.array("domain"), True), "url": (F.col("urls"), False), "term": (F.col("terms"), True)}


def test_campaign_links_shuffle_no_pairs_and_come_once(spark):
    f, keys = _mail(spark, 160, 7)
    got = K.campaign_links(f, keys)
    s = f.select("path", F.struct(*f.columns).alias("f"))
    every = s.alias("x").join(s.alias("y"), F.col("x.path") < F.col("y.path")).select(F.col("x.f").alias("a"), F.col("y.f").alias("b")).withColumn("similarity", K.similarity("a", "b"))
    share = F.coalesce((F.col("a.sender") == F.col("b.sender")) & (F.col("a.sender") != ""), F.lit(False)) | F.coalesce((F.col("a.domain") == F.col("b.domain")) & (F.col("a.domain") != ""), F.lit(False)) | F.arrays_overlap("a.urls", "b.urls") | F.arrays_overlap("a.terms", "b.terms")
    # rows that repeat a path share its keys, as in the SQL
    paths = every.filter(share).select(F.col("a.path").alias("p"), F.col("b.path").alias("q")).distinct()
    want = every.join(paths, (F.col("a.path") == F.col("p")) & (F.col("b.path") == F.col("q"))).filter(F.col("similarity") >= C.DEFAULTS.campaign_threshold).select("a.path", "b.path", "similarity").collect()
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want)) and len(want) > 300
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not any(x in plan.split("Join Inner")[0] for x in ("Aggregate", "Window", "Repartition"))


def test_campaign_members_equal_components_of_all_links(spark):
    for n, seed, t in ((160, 7, C.DEFAULTS), (40, 8, C.DEFAULTS), (90, 9, dataclasses.replace(C.DEFAULTS, campaign_threshold=0.6))):
        f, keys = _mail(spark, n, seed)
        want = K.campaigns(K.campaign_links(f, keys, t)).collect()
        assert sorted(map(tuple, K.campaign_members(f, keys, t).collect())) == sorted(map(tuple, want)) and want

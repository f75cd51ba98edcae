from pyspark.sql import functions as F

from caseweave.operators import enrich, joins
from caseweave.sources import exports


def test_forged(spark):
    rows = [("NotApplicable", "", "", "", ""), ("Teams", "Graph", "x", "Federated (ADFS)", "Forms Authentication"), ("Teams", "not set", "urn:federation:MicrosoftOnline", "", ""), ("", "Graph", "", "federated (adfs)", "")]
    df = spark.createDataFrame(rows, "a string, r string, i string, t string, m string")
    assert [r[0] for r in df.select(enrich.looks_forged(F.col("a"), F.col("r"), F.col("i"), F.col("t"), F.col("m"))).collect()] == [True, False, True, True]


def test_lookalikes(spark):
    df = spark.createDataFrame([("c0rp.example", "corp.example", 5, 100), ("c0rp.example", "corp.example", 6, 101), ("vend0r.example", "vendor.example", 400, 100), ("new.example", "", 1, 100), ("unknown.example", "x.example", None, 100)], "domain string, lookalike_of string, age_days int, day int")
    got = {r.domain: (r.messages, r.score, r.indicated) for r in enrich.lookalike_infrastructure(df, ("corp.example",), 110).collect()}
    assert got == {"c0rp.example": (2, 11, True), "vend0r.example": (1, 2, False)}


def test_names(spark):
    df = spark.createDataFrame([("Ann Lee", "ann.l@x"), ("Ann Lee", "x99@y"), ("Ann", "q@y"), ("The Inc", "q@y"), (None, None)], "n string, a string")
    assert [r[0] for r in df.select(enrich.name_mismatch(F.col("n"), F.col("a"))).collect()] == [False, True, False, False, False]
    m = spark.createDataFrame([(1, "Ann Lee", "ann@corp", "corp"), (2, "ann lee ", "z@evil", "evil"), (3, "Zed Q", "z@evil", "evil")], "path long, sender_name string, sender string, sender_domain string")
    internal = spark.createDataFrame([("corp",)], "domain string")
    assert [r.path for r in enrich.display_name_spoof(m, internal).collect()] == [2]


def test_device_code(spark):
    df = spark.createDataFrame([("go to https://microsoft.com/devicelogin, code: ABCD1234",), ("see microsoft.com/devicelogin",), ("hello",), (None,)], "t string")
    got = [r[0] for r in df.select(enrich.device_code_lure(F.col("t"))).collect()]
    assert (got[0].code, got[1].code, got[2], got[3]) == ("ABCD1234", "", None, None)


def test_places(spark):
    hops = spark.createDataFrame([(1, "a", "DE", "Good Net"), (1, "b", "ru", "x"), (2, "c", "DE", "FlokiNET ltd"), (3, "d", None, None)], "path long, ip string, country string, org string")
    assert sorted((r.path, r.weight, r.countries) for r in enrich.geo_findings(hops, ("de",)).collect()) == [(1, 2, "RU"), (2, 4, "")]
    act = spark.createDataFrame([("i1", "U", "DE"), ("i2", "u", "FR"), ("i3", "w", "FR")], "ip string, user string, country string")
    hist = spark.createDataFrame([("u", "de")], "user string, country string")
    assert sorted(tuple(r) for r in enrich.address_countries(act, hist, ("US",)).collect()) == [("i1", "DE", False, "user"), ("i2", "FR", True, "user"), ("i3", "FR", True, "global")]


def test_drift(spark):
    schema = "name string, forwards array<string>, words array<string>, move_to string, conceals boolean"
    rules = spark.createDataFrame([("a", ["x@evil"], [], "", True), ("b", ["in@corp"], [], "", True), ("c", [], [], "RSS", True), ("d", [], [], "", False)], schema)
    rec = spark.createDataFrame([("r", [], [], "rss", True)], schema)
    assert sorted(tuple(r) for r in enrich.config_drift(rules, rec, ("corp",)).collect()) == [("a", True), ("b", False)]
    second = spark.createDataFrame([("e", ["x@evil", "y@evil"], ["w"], "", True), ("f", ["w"], [], "", True)], schema)
    known = spark.createDataFrame([("r", ["y@evil"], ["w"], "", True)], schema)  # an address at another place explains; a word that equals an address doesn't
    assert [tuple(r) for r in enrich.config_drift(second, known, ("corp",)).collect()] == [("f", True)]
    p = spark.createDataFrame([("m", "eve@evil", "FullAccess"), ("m", "dan@corp", "SendAs"), ("m", "x", "Owner")], "mailbox string, user string, rights string")
    assert sorted((r.user, r.external) for r in enrich.delegations(p, ("corp",)).collect()) == [("dan@corp", False), ("eve@evil", True)]


def test_readers(spark, tmp_path):
    def put(name, text):
        (tmp_path / name).write_text(text)
        return str(tmp_path / name)

    assert exports.read_trace(spark, put("trace.csv", "Received,SenderAddress,RecipientAddress,MessageId,Status\n2024-01-01T00:00:00Z,A@x,B@y.example,<m>,Deli-vered\n")).first().recipient_domain == "y.example"
    assert exports.read_devices(spark, put("devices.csv", "DeviceName,DeviceId,Owner\nlap,d1,U@x\n")).first().owner == "u@x"
    assert exports.read_users(spark, put("users.csv", "UserPrincipalName,DisplayName,ProxyAddresses\nu@x,U,smtp:v@x\n")).first().proxy_addresses == "smtp:v@x"
    assert [r.domain for r in exports.read_domains(spark, put("domains.csv", "DomainName\n@Corp.example\n")).collect()] == ["corp.example"]
    assert exports.read_roles(spark, put("roles.csv", "RoleName,User\nAdmin,u\n")).first().role == "Admin"
    assert exports.read_mfa(spark, put("mfa.csv", "User,MFAMethods\nu,app\n")).first().methods == "app"
    assert exports.read_risk(spark, put("risk.csv", "RiskEventType,User,RiskLevel\nleaked,u,high\n")).first().level == "high"
    assert exports.read_transport_rules(spark, put("transport.csv", "Name,RedirectMessageTo\nr,x@evil.example\n")).first().conceals
    kinds = {r.path.rsplit("/", 1)[-1]: r.kind for r in exports.discover(spark, str(tmp_path)).collect()}
    assert kinds["trace.csv"] == "trace" and kinds["devices.csv"] == "devices" and kinds["domains.csv"] == "domains" and kinds["mfa.csv"] == "mfa"


def test_first_of_tied_copies_does_not_depend_on_the_order_of_rows(spark):
    rows = [("t", "n", 1, "t-1", sha, "s", "d") for sha in ("c", "a", "b", None)] + [("t", "n", 2, "t-2", "z", "s", "e")]
    for r in (rows, rows[::-1]):
        df = spark.createDataFrame(r, "thread string, name string, day int, path string, sha string, sender string, domain string").coalesce(1)
        got = joins.attachment_substitution(df, 2).collect()
        assert sorted((x.original_sha, x.sha, x.score) for x in got) == [("a", "b", 0), ("a", "c", 0), ("a", "z", 6)]

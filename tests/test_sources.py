import io
import zipfile
from email.message import EmailMessage

import pytest
from pyspark.sql import functions as F

from caseweave import sinks
from caseweave.functions import auth, files, timeparse
from caseweave.sources import exports, mail


def message(i, **more):
    m = EmailMessage()
    m["From"] = more.get("sender", f"Ann Lee <Ann{i}@Mail.Example>")
    m["To"] = "Bob <bob@corp.example>, carl@corp.example"
    m["Subject"] = more.get("subject", f"Hello {i}")
    m["Date"] = more.get("date", f"Mon, 0{i} Jan 2024 10:00:00 +0200")
    m["Message-ID"] = f"<M{i}@mail.example>"
    m["Authentication-Results"] = "mx.corp.example; spf=pass smtp.mailfrom=x; dkim=fail reason=\"bad sig\"; dmarc=fail action=none"
    m["Received"] = "from b by mx.corp.example; Mon, 01 Jan 2024 09:00:05 +0000"
    m["Received"] = "from [198.51.100.7] by b; Mon, 01 Jan 2024 09:00:00 +0000"
    m.set_content(more.get("body", "See https://login.example.top/verify?next=1, thanks."))
    if more.get("zip"):
        b = io.BytesIO()
        with zipfile.ZipFile(b, "w") as z:
            z.writestr("inner/run.exe", b"MZ")
        m.add_attachment(b.getvalue(), maintype="application", subtype="zip", filename="invoice.zip")
        m.add_attachment(b"MZ\x90\x00", maintype="application", subtype="pdf", filename="paper.pdf")
    return m.as_bytes()


@pytest.fixture(scope="module")
def box(spark, tmp_path_factory):
    d = tmp_path_factory.mktemp("mail")
    (d / "sub").mkdir()
    (d / "a.eml").write_bytes(message(1, zip=True))
    (d / "sub" / "b.eml").write_bytes(message(2, sender="no brackets", date="nonsense"))
    (d / "c.eml").write_bytes(b"\xff\xfe broken")
    mbox = b"".join(b"From x@y Mon Jan  1 00:00:00 2024\n" + message(i, body="line\n>From the start") + b"\n" for i in (1, 2, 3))
    (d / "box.mbox").write_bytes(mbox)
    return d


def test_eml(spark, box):
    rows = {r.path.rsplit("/", 1)[-1]: r for r in mail.read_eml(spark, str(box)).collect()}
    assert set(rows) == {"a.eml", "b.eml", "c.eml"}
    a = rows["a.eml"]
    assert (a.sender_email, a.sender_domain, a.message_id) == ("ann1@mail.example", "mail.example", "<m1@mail.example>")
    assert a.recipients == ["bob@corp.example", "carl@corp.example"]
    assert a.date_ts.isoformat() == "2024-01-01T08:00:00" and a.arrival_ts.isoformat() == "2024-01-01T09:00:05"
    assert a.auth.spf_pass and a.auth.dkim_fail and a.auth.dmarc_fail and a.auth_state == "failed"
    assert a.origin_ip == "198.51.100.7" and a.urls == ["https://login.example.top/verify?next=1"]
    assert [(x.sniffed_type, x.flags) for x in a.attachments] == [("zip", ["executable in archive"]), ("pe_executable", ["disguised executable"])]
    assert rows["b.eml"].date_ts is None and rows["c.eml"].attachments == []


def test_mbox(spark, box):
    rows = mail.read_mbox(spark, str(box / "box.mbox")).collect()
    assert sorted(r.message_id for r in rows) == ["<m1@mail.example>", "<m2@mail.example>", "<m3@mail.example>"]
    assert all("line\nFrom the start" in r.body for r in rows)


def test_resume(spark, box):
    listing = spark.read.format("binaryFile").option("pathGlobFilter", "*.eml").option("recursiveFileLookup", True).load(str(box)).select("path", "length", "modificationTime")
    known = listing.filter("path LIKE '%a.eml'")
    assert mail.new_messages(listing, known).count() == 2


def one(spark, col, schema="x string", rows=(("",),)):
    return [r[0] for r in spark.createDataFrame(list(rows), schema).select(col).collect()]


def test_times(spark):
    def iso(*v):
        return [x and x.isoformat() for x in one(spark, timeparse.parse_iso(F.col("x"), True), rows=[(t,) for t in v])]

    assert iso("2024-01-02T03:04:05.1234567Z", "2024-01-02 03:04:05", "1/2/2024 3:04:05", "25/12/2024 01:00:00", "null", "", None, "x") == ["2024-01-02T03:04:05.123456", "2024-01-02T03:04:05", "2024-01-02T03:04:05", "2024-12-25T01:00:00", None, None, None, None]
    rfc = [x and x.isoformat() for x in one(spark, timeparse.parse_rfc2822(F.col("x")), rows=[("Tue, 2 Jan 2024 03:04:05 +0100 (CET)",), ("2 Jan 2024 03:04 GMT",), ("later",)])]
    assert rfc == ["2024-01-02T02:04:05", "2024-01-02T03:04:00", None]


def test_received_chain(spark):
    def hop(h):
        return f"from x by y; Mon, 01 Jan 2024 {h}:00:00 +0000"

    rows = [([hop("10"), hop("09")], True), ([hop("08"), hop("09")], True), ([hop("10")], True), ([hop("10")], False), ([], True)]
    assert one(spark, auth.received_anomaly(F.col("r"), F.col("e")), "r array<string>, e boolean", rows) == ["", "out of order", "single hop", "", "missing"]


def test_file_names(spark):
    rows = [("Offer (2).pdf",), ("offer - Copy.pdf",), ("a.pdf.exe",), ("x‮fdp.exe",)]
    assert one(spark, files.attachment_key(F.col("x")), rows=rows)[:2] == ["offer.pdf", "offer.pdf"]
    flags = one(spark, files.name_flags(F.col("x"), F.lit(""), F.lit(None).cast("array<string>")), rows=rows)
    assert flags[2] == ["double extension", "executable extension"] and "right-to-left name" in flags[3]


def test_base64_urls(spark):
    import base64

    hidden = base64.b64encode(b"go to https://evil.example/login now!!").decode()
    assert one(spark, files.base64_urls(F.col("x")), rows=[(f"text {hidden} text",), ("data:image/png;base64," + hidden,)]) == [["https://evil.example/login"], []]


def test_exports(spark, tmp_path):
    (tmp_path / "a.csv").write_text("CreationDate;Operations;UserIds;AuditData\n2024-01-01T00:00:00Z;New-InboxRule;U@x.example;\"{\"\"ClientIP\"\": \"\"203.0.113.9:443\"\", \"\"Parameters\"\": [{\"\"Name\"\": \"\"Name\"\", \"\"Value\"\": \"\".\"\"}], \"\"AffectedItems\"\": [{\"\"InternetMessageId\"\": \"\"<A@b>\"\"}]}\"\n")
    a = exports.read_audit(spark, str(tmp_path / "a.csv")).collect()[0]
    assert (a.sec, a.op_lower, a.actor, a.ip, a.message_ids, a.parameters) == (1704067200, "new-inboxrule", "u@x.example", "203.0.113.9", ["<a@b>"], {"name": "."})
    (tmp_path / "s.json").write_text('{"value": [{"createdDateTime": "2024-01-01T00:00:00Z", "userPrincipalName": "u", "ipAddress": "198.51.100.1", "isInteractive": true, "status": {"errorCode": 0}, "location": {"countryOrRegion": "DE"}}, {"createdDateTime": "2024-01-01T00:01:00Z", "userPrincipalName": "v", "status": {"errorCode": 50126}}]}')
    s = exports.read_signins(spark, str(tmp_path / "s.json")).orderBy("sec").collect()
    assert [(r.user, r.ok, r.code, r.country, r.interactive) for r in s] == [("u", True, "", "DE", True), ("v", False, "50126", "", False)]
    (tmp_path / "l.json").write_text('{"Operation": "Send", "UserId": "a", "CreationTime": "2024-01-01T00:00:00"}\n{"Operation": "Send", "UserId": "b"}\n')
    assert sorted(r.actor for r in exports.read_audit(spark, str(tmp_path / "l.json")).collect()) == ["a", "b"]


def test_identify():
    assert exports.identify("x_SignIn_log.json", ["correlationId"]) == "signin"
    assert exports.identify("export.csv", ["SenderAddress", "RecipientAddress"]) == "trace"
    assert exports.identify("export.csv", ["nothing"]) == ""


def test_sinks(spark, tmp_path, box):
    sinks.write_messages_csv(mail.read_eml(spark, str(box)), str(tmp_path / "csv"))
    assert spark.read.option("header", True).option("multiLine", True).option("escape", '"').csv(str(tmp_path / "csv")).count() >= 3
    clean = spark.createDataFrame([("twelve messages",)], "text string")
    sinks.write_diagnostic(clean, str(tmp_path / "d"))
    with pytest.raises(ValueError):
        sinks.write_diagnostic(spark.createDataFrame([("from a@b.example",)], "text string"), str(tmp_path / "e"))


def test_attachments_in_depth(spark, tmp_path):
    m = EmailMessage()
    m["From"], m["To"], m["Subject"] = "a@b.example", "c@d.example", "See https://own.example/x"
    m.set_content("text")
    inner = EmailMessage()
    inner["Subject"] = "Fwd https://inner.example/s"
    inner.set_content("go to https://inner.example/b now")
    m.add_attachment(inner, filename="old.eml")
    m.add_attachment("<html><a href='https://form.example/in'>x</a><form><input type='password'></form>", subtype="html", filename="login.html")
    m.add_attachment("<p>see https://link.example/y", subtype="html", filename="page.htm")
    b = io.BytesIO()
    with zipfile.ZipFile(b, "w") as z:
        z.writestr("word/vbaProject.bin", b"x")
    m.add_attachment(b.getvalue(), maintype="application", subtype="zip", filename="plain.docx")
    m.add_attachment(b"Rar!\x1a\x07x", maintype="application", subtype="zip", filename="a.rar")
    m.add_attachment(b"  " + b"x" * 150 + b"<script>", maintype="application", subtype="octet-stream", filename="late")
    m.add_attachment(b"", maintype="application", subtype="zip", filename="empty.zip")
    (tmp_path / "m.eml").write_bytes(m.as_bytes())
    r = mail.read_eml(spark, str(tmp_path)).collect()[0]
    assert [(a.filename, a.sniffed_type, a.flags, a.urls) for a in r.attachments] == [
        ("old.eml", "", ["forwarded message"], ["https://inner.example/s", "https://inner.example/b"]),
        ("login.html", "html", ["web page", "credential form"], ["https://form.example/in"]),
        ("page.htm", "", ["web page", "links in web page"], ["https://link.example/y"]),
        ("plain.docx", "zip", ["embedded macro"], []),
        ("a.rar", "rar", ["archive not inspected"], []),
        ("late", "html", [], []),
        ("empty.zip", "", ["archive not inspected"], []),
    ]
    assert r.urls[0] == "https://own.example/x" and set(r.urls) >= {"https://inner.example/s", "https://form.example/in", "https://link.example/y"}
    assert len({a.sha256 for a in r.attachments}) == 7

"""Mail: folders of .eml files and mbox files, as rows."""

from __future__ import annotations

import hashlib
import io
import re
import zipfile
from collections.abc import Iterator
from email import message_from_bytes, policy
from email.header import decode_header, make_header
from email.message import Message
from email.utils import getaddresses, parseaddr

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.functions import auth
from caseweave.functions.address import domain_of, normalize_message_id
from caseweave.functions.files import name_flags, sniff
from caseweave.functions.html import html_to_text
from caseweave.functions.timeparse import parse_rfc2822
from caseweave.functions.url import urls_in

#: Attachments over this many bytes are hashed, not inspected.
INSPECTED = 30 * 1024 * 1024
#: Messages of so many bytes leave the parser together.
BATCH_BYTES = 8 << 20
#: Headers kept as lists, by column.
LISTS = {"authentication_results": "Authentication-Results", "received_spf": "Received-SPF", "dkim_signatures": "DKIM-Signature", "received": "Received", "x_originating_ip": "X-Originating-IP"}
TEXTS = {"message_id": "Message-ID", "in_reply_to": "In-Reply-To", "references": "References", "subject": "Subject", "date_raw": "Date", "return_path": "Return-Path", "reply_to": "Reply-To", "list_unsubscribe": "List-Unsubscribe", "precedence": "Precedence", "x_folder": "X-Folder"}
_ATTACHMENT = pa.struct([("filename", pa.string()), ("content_type", pa.string()), ("size", pa.int64()), ("sha256", pa.string()), ("head", pa.binary()), ("entries", pa.list_(pa.string())), ("web", pa.string())])
_SCHEMA = pa.schema([("path", pa.string()), ("sender_name", pa.string()), ("sender_email", pa.string()), ("recipients", pa.list_(pa.string())), ("cc", pa.list_(pa.string())), ("plain", pa.string()), ("html", pa.string()), *[(c, pa.string()) for c in TEXTS], *[(c, pa.list_(pa.string())) for c in LISTS], ("attachments", pa.list_(_ATTACHMENT))])
_DDL = "path string, sender_name string, sender_email string, recipients array<string>, cc array<string>, plain string, html string, " + ", ".join(f"`{c}` string" for c in TEXTS) + ", " + ", ".join(f"{c} array<string>" for c in LISTS) + ", attachments array<struct<filename:string,content_type:string,size:bigint,sha256:string,head:binary,entries:array<string>,web:string>>"


def _text(value: object) -> str:
    """A header as text, whatever is wrong with its encoding."""
    raw = str(value or "")
    try:
        return str(make_header(decode_header(raw)))
    except (LookupError, UnicodeError, ValueError):
        return raw


def _decoded(part: Message) -> str:
    payload = part.get_payload(decode=True) or b""
    for charset in (part.get_content_charset() or "utf-8", "utf-8", "latin-1"):
        try:
            return payload.decode(charset)
        except (LookupError, UnicodeDecodeError):
            continue
    return payload.decode("utf-8", "replace")


def _addresses(values: list) -> list[str]:
    return list(dict.fromkeys(a.lower() for _, a in getaddresses([_text(v) for v in values]) if "@" in a))


def _entries(payload: bytes) -> list[str] | None:
    """The names in a ZIP container; None if it can't be read, or is none."""
    if not payload.startswith(b"PK"):
        return None
    try:
        with zipfile.ZipFile(io.BytesIO(payload)) as z:
            return z.namelist()
    except (zipfile.BadZipFile, NotImplementedError, OSError, ValueError):
        return None


def _attachment(part: Message, filename: str) -> dict:
    """What is read of one attachment: its first bytes, a ZIP's entries, and the text of a web page or of a forwarded message.
    Payloads over INSPECTED bytes are only hashed."""
    kind = part.get_content_type()
    entries = web = None
    if part.is_multipart():
        inner = next((p for p in part.get_payload() if isinstance(p, Message)), None)
        payload = b"" if inner is None else _flat(inner)
        if inner is not None:
            web = "\n".join([_text(inner.get("Subject")), *(_decoded(p) for p in inner.walk() if not p.is_multipart() and p.get_content_type() in ("text/plain", "text/html"))])
    else:
        payload = part.get_payload(decode=True) or b""
        if len(payload) <= INSPECTED:
            entries = _entries(payload)
            if kind in ("text/html", "application/xhtml+xml") or filename.lower().endswith((".html", ".htm", ".shtml")):
                web = _decoded(part)
    head = payload[:512] if len(payload) <= INSPECTED and not part.is_multipart() else b""
    return {"filename": filename, "content_type": kind, "size": len(payload), "sha256": hashlib.sha256(payload).hexdigest(), "head": head, "entries": entries, "web": web}


def _flat(m: Message) -> bytes:
    try:
        return m.as_bytes()
    except (AttributeError, LookupError, TypeError, ValueError):  # headers or charsets that can't be written again
        return b""


def parse(path: str, raw: bytes) -> dict:
    """One message as a dict of _SCHEMA's columns. Never fails: what can't be read is empty."""
    m = message_from_bytes(raw, policy=policy.compat32)
    name, sender = parseaddr(_text(m.get("From")))
    plain, html, files = [], [], []
    for part in m.walk():
        filename = _text(part.get_filename() or "")
        kind = part.get_content_type()
        attached = bool(filename) or part.get_content_disposition() == "attachment"
        if part.is_multipart():
            if attached and kind == "message/rfc822":
                files.append(_attachment(part, filename))
        elif attached:
            files.append(_attachment(part, filename))
        elif kind == "text/plain":
            plain.append(_decoded(part))
        elif kind == "text/html":
            html.append(_decoded(part))
    out = {"path": path, "sender_name": name, "sender_email": sender.lower(), "recipients": _addresses(m.get_all("To", [])), "cc": _addresses(m.get_all("Cc", [])), "plain": "\n".join(plain), "html": "\n".join(html), "attachments": files}
    out |= {c: _text(m.get(h)) for c, h in TEXTS.items()}
    out |= {c: [_text(v) for v in m.get_all(h, [])] for c, h in LISTS.items()}
    return out


def _unboxed(raw: bytes) -> bytes:
    """A message of an mbox file, without its separator line and the marks before `From `."""
    head, _, rest = raw.partition(b"\n")
    return re.sub(rb"(?m)^>(>*From )", rb"\1", rest if head.startswith(b"From ") or b":" not in head.split(b" ")[0] else raw)


def _parsed(raw: DataFrame, unbox: bool = False) -> DataFrame:
    """Rows path, content (binary) as typed messages."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows, size = [], 0
            for i in range(b.num_rows):
                content = b.column("content")[i].as_py() or b""
                rows.append(parse(b.column("path")[i].as_py(), _unboxed(content) if unbox else content))
                size += len(content)
                if size >= BATCH_BYTES:
                    yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)
                    rows, size = [], 0
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=_SCHEMA)

    m = raw.select("path", "content").mapInArrow(run, _DDL)
    body = F.when(F.trim("plain") != "", F.col("plain")).otherwise(html_to_text(F.col("html")))
    m = m.withColumns({"message_id": normalize_message_id(F.col("message_id")), "in_reply_to": normalize_message_id(F.col("in_reply_to")), "sender_domain": domain_of(F.col("sender_email")), "body": body, "date_ts": parse_rfc2822(F.col("date_raw"))})
    refs = F.transform(F.regexp_extract_all("references", F.lit(r"(<[^>]+>)"), F.lit(1)), F.lower)
    flags = auth.auth_flags(auth.auth_detail(F.col("authentication_results")), F.col("received_spf"))
    m = m.withColumns({"references": refs, "arrival_ts": auth.arrival(F.col("received"), F.col("date_ts")), "auth": flags, "auth_state": auth.auth_state(flags), "origin_ip": auth.origin_ip(F.col("x_originating_ip"), F.col("received"))})
    bulk = (F.col("list_unsubscribe") != "") | F.lower("precedence").isin("bulk", "list", "junk")
    page = lambda a: F.struct(a["filename"].alias("filename"), a["content_type"].alias("content_type"), a["size"].alias("size"), a["sha256"].alias("sha256"), sniff(a["head"]).alias("sniffed_type"), name_flags(a["filename"], sniff(a["head"]), a["entries"], a["content_type"], a["web"]).alias("flags"), urls_in(a["web"]).alias("urls"))
    files = F.transform("attachments", page)
    seed = F.coalesce(F.try_element_at("references", F.lit(1)), F.nullif("in_reply_to", F.lit("")), F.nullif("message_id", F.lit("")))
    m = m.withColumns({"bulk_mail": bulk, "attachments": files, "thread_seed": seed})
    # first wins: the text, then its links, then what is attached
    return m.withColumn("urls", F.array_distinct(F.concat(urls_in(F.concat_ws("\n", "subject", "body", "html")), F.flatten(F.transform("attachments", lambda a: a["urls"]))))).drop("plain")


def read_eml(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """All .eml files below a path, one row each. MIME is parsed in Arrow batches where the files are read."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path)
    return _parsed(files)


def read_mbox(spark: SparkSession, path: str) -> DataFrame:
    """The messages of mbox files. Files of any size are split at their `From ` lines by Spark's text reader, so no task
    holds a whole mailbox. The reader only cuts bytes and doesn't decode them, so bodies of any charset come whole. path is the
    file's name, the message's hash and its place in the reading, so that equal messages have paths of their own."""
    x = spark.read.option("lineSep", "\nFrom ").text(path).select(F.col("_metadata.file_name").alias("file"), F.col("value").cast("binary").alias("content"))
    x = x.withColumn("at", F.monotonically_increasing_id()).filter(F.length("content") > 1)
    raw = x.select(F.concat_ws("#", "file", F.substring(F.sha2("content", 256), 1, 16), F.col("at").cast("string")).alias("path"), "content")
    m = _parsed(raw, unbox=True)
    folder = F.when(F.col("x_folder") != "", F.element_at(F.split("x_folder", r"[/\\]"), -1)).otherwise("")
    return m.withColumn("folder", folder)


def new_messages(listing: DataFrame, known: DataFrame) -> DataFrame:
    """Rows of a listing (path, length, modificationTime) that an earlier run hasn't stored: what is left to parse."""
    return listing.join(known.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_anti")


def reused_messages(listing: DataFrame, stored: DataFrame) -> DataFrame:
    """Stored rows that still hold: files of the same path, length and time; else files of the same content (sha256) that
    have moved, under their new path. listing: path, length, modificationTime, sha256 (may be null: not read yet)."""
    same = stored.join(listing.select("path", "length", "modificationTime"), ["path", "length", "modificationTime"], "left_semi")
    left = listing.join(same.select("path"), "path", "left_anti").filter("sha256 IS NOT NULL")
    moved = stored.dropDuplicates(["sha256"]).drop("path", "length", "modificationTime").join(left.select("path", "length", "modificationTime", "sha256"), "sha256")
    return same.unionByName(moved.select(*same.columns))


def upserted(stored: DataFrame, new: DataFrame) -> DataFrame:
    """Stored rows with new ones in place of those of the same path."""
    return stored.join(new.select("path"), "path", "left_anti").unionByName(new)


def prunable(listing: DataFrame, tiers: DataFrame, hits: DataFrame, extracted: str, keep_tiers: tuple[int, ...] = (1, 2)) -> DataFrame:
    """path, length of the files that may go once a case is closed: below the folder of extracted mail, in no kept tier, and
    without a scanner's hit. Files that no tier knows stay. listing: path, length; tiers: path, tier; hits: path."""
    below = listing.filter(F.regexp_replace("path", "^file:/+", "/").startswith(extracted.removeprefix("file:").rstrip("/") + "/"))
    go = tiers.filter(~F.col("tier").isin(*keep_tiers)).select("path").distinct()
    return below.join(go, "path", "left_semi").join(hits.select("path"), "path", "left_anti").select("path", "length")


def attachment_payloads(spark: SparkSession, path: str, pattern: str = "*.eml") -> DataFrame:
    """path, filename, content of every attachment below a path, read again for a scanner."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", True).load(path).select("path", "content")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i in range(b.num_rows):
                found = []
                for part in message_from_bytes(b.column("content")[i].as_py() or b"", policy=policy.compat32).walk():
                    name = _text(part.get_filename() or "")
                    if not part.is_multipart() and (name or part.get_content_disposition() == "attachment"):
                        found.append((name, part.get_payload(decode=True) or b""))
                yield pa.RecordBatch.from_arrays([pa.array([b.column("path")[i].as_py()] * len(found), pa.string()), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.binary())], ["path", "filename", "content"])

    return files.mapInArrow(run, "path string, filename string, content binary")

"""Attachments: what bytes are, and whether that fits their name."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from caseweave.functions.html import has_login_form
from caseweave.functions.url import urls_in

# Leading bytes (hex) of file kinds.
MAGIC = (
    ("4D5A", "pe_executable"), ("7F454C46", "elf_executable"), ("25504446", "pdf"), ("504B0304", "zip"), ("504B0506", "zip"), ("504B0708", "zip"), ("D0CF11E0A1B11AE1", "ole"), ("526172211A07", "rar"),
    ("377ABCAF271C", "7z"), ("1F8B", "gzip"), ("474946383761", "gif"), ("474946383961", "gif"), ("89504E470D0A1A0A", "png"), ("FFD8FF", "jpeg"), ("424D", "bmp"),
)
# Kinds that run, and the kind that an extension stands for.
EXECUTABLE_KINDS = ("pe_executable", "elf_executable", "script")
KINDS = {
    "pdf": "pdf", "zip": "zip", "jar": "zip", "apk": "zip", "docx": "zip", "xlsx": "zip", "pptx": "zip", "docm": "zip", "xlsm": "zip", "pptm": "zip", "doc": "ole", "xls": "ole", "ppt": "ole", "msg": "ole",
    "png": "png", "jpg": "jpeg", "jpeg": "jpeg", "gif": "gif", "bmp": "bmp", "rar": "rar", "7z": "7z", "gz": "gzip", "tgz": "gzip", "exe": "pe_executable", "dll": "pe_executable", "scr": "pe_executable",
}
# Extensions by danger, and those that are dangerous or worth a note inside an archive.
EXECUTABLE = ("hta", "js", "jse", "vbs", "vbe", "wsf", "lnk", "scr", "exe", "com", "pif", "cpl", "msi", "jar", "ps1", "bat", "cmd", "iso", "img", "vhd")
MACRO = ("docm", "xlsm", "xlsb", "pptm", "dotm", "xltm")
MACRO_INSPECTED = ("docm", "xlsm", "pptm", "dotm", "xltm", "potm", "xlam")
ARCHIVE = ("zip", "rar", "7z", "gz", "tar", "cab", "ace")
WEB = ("html", "htm", "shtml", "mht", "mhtml")
INSIDE_DANGEROUS = ("exe", "scr", "com", "pif", "bat", "cmd", "js", "jse", "vbs", "vbe", "wsf", "wsh", "hta", "lnk", "ps1", "jar", "msi", "dll", "cpl", "reg")
INSIDE_NESTED = ("zip", "7z", "rar", "gz", "iso", "img", "cab")
DOUBLE_EXTENSION = r"(?i)\.(?:pdf|docx?|xlsx?|pptx?|jpe?g|png|gif|txt|html?|zip)\s*\.(?:exe|scr|js|jse|vbs|vbe|bat|cmd|com|pif|ps1|hta|lnk|iso|img)\b"
#: Flags that make an archive suspicious, on any attachment of its message.
RISKY_FLAGS = ("executable in archive", "disguised executable", "embedded macro", "double extension", "executable extension", "macro extension")


def extension(name: Column) -> Column:
    return F.lower(F.regexp_extract(F.coalesce(name, F.lit("")), r"\.([A-Za-z0-9]+)\s*$", 1))


def sniff(payload: Column) -> Column:
    """The kind of a payload by its first 512 bytes: one of MAGIC's, script, html, or empty."""
    head = F.hex(F.substring(payload, 1, 16))
    latin = F.decode(F.coalesce(F.substring(payload, 1, 512), F.lit(b"")), "ISO-8859-1")
    text = F.regexp_replace(latin, r"^\s+", "")
    low = F.lower(F.substring(text, 1, 256))
    out = None
    for magic, kind in MAGIC:
        out = F.when(head.startswith(magic), kind) if out is None else out.when(head.startswith(magic), kind)
    return out.when(text.startswith("#!"), "script").when(low.startswith("<!doctype html") | low.startswith("<html") | low.contains("<script"), "html").otherwise("")


def name_flags(name: Column, kind: Column, entries: Column, content_type: Column | None = None, web: Column | None = None) -> Column:
    """What is wrong with an attachment, as an array: its name, its content against the name, an archive's entries (null: no
    reader for it), and a forwarded message's or a web page's text (web, null if it has none)."""
    n, ext = F.coalesce(name, F.lit("")), extension(name)
    content_type = F.lit("") if content_type is None else F.coalesce(content_type, F.lit(""))
    web = F.lit(None).cast("string") if web is None else web
    declared = F.element_at(F.create_map(*[F.lit(x) for kv in KINDS.items() for x in kv]), ext)
    listed = F.coalesce(entries, F.array().cast("array<string>"))
    files = F.filter(listed, lambda e: ~e.endswith("/"))
    differs, runs = (kind != "") & declared.isNotNull() & (declared != kind), kind.isin(*EXECUTABLE_KINDS)
    macro = (ext.isin(*MACRO_INSPECTED) & ~ext.isin(*MACRO)) | F.exists(listed, lambda e: F.lower(e).contains("vbaproject.bin"))
    forwarded, form = content_type == "message/rfc822", has_login_form(web)
    page = content_type.isin("text/html", "application/xhtml+xml") | ext.isin("html", "htm", "shtml")
    flags = [
        (n.contains("‮"), "right-to-left name"), (n.rlike(DOUBLE_EXTENSION), "double extension"), (ext.isin(*EXECUTABLE), "executable extension"), (ext.isin(*MACRO), "macro extension"), (forwarded, "forwarded message"),
        (differs & runs, "disguised executable"), (differs & ~runs, "content does not match the extension"), (macro, "embedded macro"),
        ((ext == "zip") & F.exists(files, lambda e: extension(e).isin(*INSIDE_DANGEROUS)), "executable in archive"), ((ext == "zip") & F.exists(files, lambda e: extension(e).isin(*INSIDE_NESTED)), "nested archive"),
        (ext.isin("7z", "rar") | ((ext == "zip") & entries.isNull()), "archive not inspected"), (ext.isin(*WEB), "web page"), (page & form, "credential form"), (page & ~form & (F.size(urls_in(web)) > 0), "links in web page"),
    ]
    return F.filter(F.array(*[F.when(F.coalesce(c, F.lit(False)), F.lit(t)) for c, t in flags]), lambda f: f.isNotNull())


def attachment_key(name: Column) -> Column:
    """A name to compare by: lower case, without copy marks."""
    low = F.lower(F.trim(F.coalesce(name, F.lit(""))))
    return F.regexp_replace(F.regexp_replace(low, r"\s*\(\d+\)(?=\.|$)", ""), r"\s*-\s*copy(?=\.|$)", "")


def base64_urls(text: Column) -> Column:
    """URLs hidden in base64 runs of 24 to 4096 characters of a text."""
    runs = F.regexp_extract_all(F.regexp_replace(F.coalesce(text, F.lit("")), r"data:[a-z/+.-]+;base64,[A-Za-z0-9+/=]+", " "), F.lit(r"([A-Za-z0-9+/]{24,4096}={0,2})"), F.lit(1))
    plain = F.transform(F.filter(runs, lambda r: F.length(r) % 4 == 0), lambda r: F.coalesce(F.try_to_binary(r, F.lit("base64")).cast("string"), F.lit("")))
    return F.array_distinct(F.flatten(F.transform(plain, lambda p: F.regexp_extract_all(p, F.lit(r"(https?://[\x21-\x7E]+)"), F.lit(1)))))


def threat_notes(attachments: Column) -> Column:
    """What is dangerous about a message's attachments (filename, sniffed_type, flags), as sentences."""
    def notes(a: Column) -> Column:
        name = F.when(F.coalesce(a["filename"], F.lit("")) == "", "(unnamed)").otherwise(a["filename"])
        deceptive, macro = F.concat(F.lit("deceptively named attachment "), name), F.concat(F.lit("macro-enabled attachment "), name)
        kind = F.when(a["sniffed_type"] == "", "unexpected").otherwise(a["sniffed_type"])
        other = F.concat(F.lit("attachment "), name, F.lit(" content is "), kind, F.lit(", not what its name claims"))
        rules = [
            ("credential form", F.concat(F.lit("credential form in attachment "), name)), ("macro extension", macro), ("embedded macro", macro), ("right-to-left name", deceptive), ("double extension", deceptive),
            ("forwarded message", F.concat(F.lit("forwarded message attached ("), name, F.lit(")"))), ("disguised executable", other), ("content does not match the extension", other),
            ("executable in archive", F.concat(F.lit("archive "), name, F.lit(" contains executable/script files"))),
        ]
        return F.filter(F.array(*[F.when(F.array_contains(a["flags"], f), t) for f, t in rules]), lambda x: x.isNotNull())

    return F.array_distinct(F.flatten(F.transform(attachments, notes)))

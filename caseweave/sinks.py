"""Reports as files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# What no sanitised report may hold.
IDENTIFIERS = (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", r"\b[0-9]{1,3}(\.[0-9]{1,3}){3}\b", r"https?://", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", r"[A-Za-z]:\\\\", r"/(home|Users)/")


def write_messages_csv(messages: DataFrame, path: str) -> None:
    """One row for each message by UTC time, unknown times last; lists joined by |. Written by all tasks, as part files in order."""
    flat = messages.select(*[F.array_join(c, "|").alias(c) if t.startswith("array<string") else F.col(c) for c, t in messages.dtypes if not t.startswith(("array<struct", "struct", "map", "binary"))])
    flat.orderBy(F.asc_nulls_last("date_ts"), "path").write.mode("overwrite").option("header", True).csv(path)


def write_iocs_csv(iocs: DataFrame, path: str) -> None:
    iocs.orderBy("best_tier", F.desc("occurrences"), "type", "value").write.mode("overwrite").option("header", True).csv(path)


def write_json(sections: dict[str, DataFrame], path: str) -> None:
    """A folder of JSON lines for each section."""
    for name, df in sections.items():
        df.write.mode("overwrite").json(f"{path}/{name}")


def leaks(report: DataFrame) -> DataFrame:
    """Rows of a sanitised report that still hold an identifier."""
    text = F.to_json(F.struct(*[F.col(f"`{c}`") for c in report.columns]))
    bad = F.lit(False)
    for p in IDENTIFIERS:
        bad |= text.rlike(p)
    return report.filter(bad)


def write_diagnostic(report: DataFrame, path: str) -> None:
    """Writes a sanitised report, or refuses if anything in it identifies someone."""
    found = leaks(report).limit(1).collect()
    if found:
        raise ValueError("the report holds an identifier")
    report.write.mode("overwrite").json(path)


def manifest(sections: dict[str, DataFrame], settings: dict) -> str:
    """How many rows each section has, and the settings, as JSON."""
    return json.dumps({"rows": {n: d.count() for n, d in sections.items()}, "settings": settings}, sort_keys=True, default=str)


def write_exposure_csv(inventory: DataFrame, path: str) -> None:
    """report.exposure_inventory() as CSV."""
    inventory.write.mode("overwrite").option("header", True).csv(path)


PAGE = """<!doctype html><meta charset="utf-8"><title>Case</title><style>body{font:14px sans-serif;margin:2em}td,th{padding:.2em .6em;text-align:left;border-bottom:1px solid #ddd}</style>
<h1>Case</h1><input id="q" placeholder="filter"><table><thead></thead><tbody></tbody></table><script type="application/json" id="data">%s</script><script>
const rows=JSON.parse(document.getElementById("data").textContent),cols=rows.length?Object.keys(rows[0]):[],head=document.querySelector("thead"),body=document.querySelector("tbody");
const line=(cells,tag)=>{const tr=document.createElement("tr");cells.forEach(c=>{const x=document.createElement(tag);x.textContent=typeof c==="object"?JSON.stringify(c):c;tr.append(x)});return tr};
const show=()=>{const q=document.getElementById("q").value.toLowerCase();body.replaceChildren(...rows.filter(r=>JSON.stringify(r).toLowerCase().includes(q)).map(r=>line(cols.map(c=>r[c]??""),"td")))};
head.append(line(cols,"th"));document.getElementById("q").addEventListener("input",show);show();</script>"""


def write_html(subset: DataFrame, path: str, most: int = 5000) -> None:
    """One page with the messages of report.report_subset() in it as JSON, in a folder. A report is read by people: the first
    `most` rows in the order of candidates, which the page says if there are more."""
    from caseweave.operators.report import candidate_order

    rows = subset.orderBy(*candidate_order()).limit(most).toJSON().collect()
    text = (PAGE % ("[" + ",".join(rows) + "]").replace("</", "<\\/")).replace("\n", " ")
    if len(rows) == most:
        text = text.replace("<h1>Case</h1>", f"<h1>Case</h1><p>The first {most} messages.</p>")
    subset.sparkSession.createDataFrame([(text,)], "value string").coalesce(1).write.mode("overwrite").text(path)

"""An evidence folder: every export in it by kind, read by its kind's reader."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from caseweave.sources import exports

READERS: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "signin": exports.read_signins, "audit": exports.read_audit, "users": exports.read_users, "devices": exports.read_devices, "mfa": exports.read_mfa, "roles": exports.read_roles, "risk": exports.read_risk,
    "domains": exports.read_domains, "trace": exports.read_trace, "transport": exports.read_transport_rules, "entra_audit": exports.read_entra_audit, "oauth": exports.read_oauth,
    "rules": exports.read_mailbox_rules, "permissions": exports.read_permissions, "audit_status": exports.read_audit_status,
}


@dataclass
class Evidence:
    """What a folder holds: frames by kind, paths by kind, and the paths that no kind fits."""

    sources: dict[str, DataFrame] = field(default_factory=dict)
    paths: dict[str, list[str]] = field(default_factory=dict)
    unrecognised: list[str] = field(default_factory=list)

    def manifest(self, spark: SparkSession) -> DataFrame:
        """kind, files, rows (null where no reader takes the kind), consumed."""
        rows = [(k, len(p), self.sources[k].count() if k in self.sources else None, k in self.sources) for k, p in sorted(self.paths.items())]
        return spark.createDataFrame(rows, "kind string, files long, rows long, consumed boolean")


def collect(spark: SparkSession, root: str | None, overrides: dict[str, str] | None = None) -> Evidence:
    """Every source below a folder. An override (kind to path) replaces what was found for its kind.

    Only the listing comes to the driver: a path and a kind for each file."""
    out = Evidence()
    if root:
        for r in exports.discover(spark, root).orderBy("path").collect():
            if r.kind:
                out.paths.setdefault(r.kind, []).append(r.path)
            else:
                out.unrecognised.append(r.path)
    out.paths |= {k: [p] for k, p in (overrides or {}).items() if p}
    for kind, paths in out.paths.items():
        if kind in READERS:
            frames = [READERS[kind](spark, p) for p in paths]
            merged = frames[0]
            for f in frames[1:]:
                merged = merged.unionByName(f, allowMissingColumns=True)
            out.sources[kind] = merged
    return out


def find_containers(spark: SparkSession, root: str, suffixes: tuple[str, ...] = (".pst", ".ost", ".mbox", ".mbx"), skip: tuple[str, ...] = ("_extracted",)) -> DataFrame:
    """path, length, kind of the mail containers below a folder, but for those in folders that extraction made."""
    name = F.lower("path")
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "length")
    kind = F.regexp_extract(name, r"\.([a-z]+)$", 1)
    keep = F.concat(F.lit("."), kind).isin(*suffixes)
    for s in skip:
        keep &= ~F.col("path").contains(f"/{s}/")
    return files.filter(keep).select("path", "length", kind.alias("kind"))


def folder_ranges(folders: DataFrame) -> DataFrame:
    """folder, first, last: the numbers of each folder's messages, depth first. folders: folder (a path), n. What a reader
    of containers is given, so that its parts number messages alike."""
    from pyspark.sql.window import Window

    before = F.coalesce(F.sum("n").over(Window.orderBy("folder").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return folders.withColumn("first", before).select("folder", "first", (F.col("first") + F.col("n") - 1).alias("last"))

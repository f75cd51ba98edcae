"""python -m caseweave.signins LOG [options]: a sign-in log on its own, without mail."""

from __future__ import annotations

import argparse
import sys

from pyspark.sql import SparkSession

from caseweave import sinks
from caseweave.operators import identity
from caseweave.plans import signin_case
from caseweave.sources import exports

#: What is shown, in this order.
SECTIONS = ("groups", "single_legs", "aitm", "fatigue", "spray", "legacy", "owner_addresses")


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    p = argparse.ArgumentParser(prog="caseweave.signins", description=__doc__)
    p.add_argument("log", help="sign-in log: a file or a folder of CSV, JSON or JSON lines")
    p.add_argument("--devices", help="registered devices, whose owners' addresses are told apart")
    p.add_argument("--json", help="folder for all sections as JSON lines")
    p.add_argument("--rows", type=int, default=20, help="rows shown of each section")
    a = p.parse_args(argv)
    spark = spark or SparkSession.builder.appName("caseweave").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    found = signin_case.analyze(exports.read_signins(spark, a.log))
    if a.devices:
        found["owner_addresses"] = identity.owner_addresses(found["log"], exports.read_devices(spark, a.devices))
    if found["log"].isEmpty():
        print("no sign-ins found", file=sys.stderr)
        return 1
    shown = {k: found[k] for k in SECTIONS if k in found}
    for name, df in shown.items():
        print(name)
        df.show(a.rows, truncate=False)
    if a.json:
        sinks.write_json(shown, a.json)
    return 0


if __name__ == "__main__":
    sys.exit(main())

"""The driver's contract, and what plans must not hold."""

import re

import __spark_entry__ as entry
import pytest

from caseweave.plans import registry

SF = "/root/testdata/sf0.001"


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and "session_id" in df.columns


def test_every_query_has_its_sql():
    assert set(registry.QUERIES) - set(registry.ORACLES) == {"signal_template"}  # its patterns look around
    assert set(registry.ORACLES) < set(registry.QUERIES) <= set(entry.queries())
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", registry.QUERIES)
def test_plans(spark, name):
    """No Python, and no product of two tables unless one side is broadcast."""
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert not re.search("EvalPython|MapInArrow|MapInPandas|InPandas|InArrow", plan)
    assert "CartesianProduct" not in plan


@pytest.mark.parametrize("name", ["session_rollup", "term_document_frequency", "domain_baseline", "url_risk"])
def test_scans_read_only_what_they_use(spark, name):
    plan = registry.QUERIES[name](spark, SF)._jdf.queryExecution().executedPlan().toString()
    schemas = [x.split("ReadSchema: ")[1].split("\n")[0] for x in plan.split("FileScan parquet")[1:] if "ReadSchema: " in x]
    assert schemas and not any("html" in s for s in schemas if name != "html_links") and not any("o_totalprice" in s for s in schemas)

"""The driver's entry works with and without the training-data subpackage."""

import subprocess
import sys

import __spark_entry__ as driver


def test_entry(spark):
    assert driver.entry(spark).count() == 192


def test_oracles_belong_to_queries():
    assert set(driver.oracle_sql()) <= set(driver.queries())


def test_without_the_subpackage():
    code = (
        "import sys; sys.modules['extractlab.llm'] = None; sys.modules['corpus_pipeline'] = None\n"
        "import __spark_entry__ as d; names = d.queries(); assert 'risk_coverage' in names and not any(n.startswith('op') for n in names), names"
    )
    subprocess.run([sys.executable, "-c", code], check=True, timeout=120)

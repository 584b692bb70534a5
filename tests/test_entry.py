import os
import subprocess
import sys

import pytest

import __spark_entry__ as entry

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
HAVE = os.path.isdir("/root/testdata/sf0.001")


def test_names_agree():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.skipif(not HAVE, reason="no test tables")
def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_core_stands_alone():
    code = "import sys; sys.modules['paperloom.llm'] = None; import __spark_entry__ as e; q = e.queries(); assert 'op_filter' in q and 'p1_found' in q and 'p2_found' not in q; assert 'p2_found' not in e.oracle_sql()"
    subprocess.run([sys.executable, "-c", code], cwd=ROOT, check=True)


def test_core_names_nothing_of_llm():
    for folder, _, names in os.walk(os.path.join(ROOT, "paperloom")):
        if os.path.basename(folder) == "llm":
            continue
        for name in names:
            if name.endswith(".py"):
                with open(os.path.join(folder, name)) as f:
                    assert "paperloom.llm" not in f.read() or name == "never"

"""Driver contract."""

import os
import subprocess
import sys

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def test_contract_imports_without_spark():
    code = ("import __spark_entry__ as E; q = E.queries(); s = E.oracle_sql(); "
            "assert set(s) <= set(q); print(len(q), len(s))")
    out = subprocess.run([sys.executable, "-c", code], cwd=ROOT, capture_output=True, text=True, timeout=120)
    assert out.returncode == 0, out.stderr[-2000:]
    n_q, n_s = map(int, out.stdout.split())
    assert n_q >= 60 and n_s >= 55


def test_entry_smoke(spark):
    import __spark_entry__ as E
    df = E.entry(spark)
    assert df.columns[:4] == ["window_id", "window_start_us", "timestamp", "source_ip"]
    assert df.count() > 0

import os
import subprocess
import sys
import tempfile

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


def _run(*args, timeout=300):
    return subprocess.run([sys.executable, "-m", "ledgerline", *args], cwd=ROOT, capture_output=True, text=True,
                          timeout=timeout)


def test_cli_lists_every_registered_query():
    from ledgerline.plans.registry import QUERIES
    out = _run("list")
    assert out.returncode == 0 and out.stdout.split() == list(QUERIES)


def test_cli_runs_a_query_to_parquet():
    dest = os.path.join(tempfile.mkdtemp(prefix="ll-cli-"), "dash")
    out = _run("run", "executive_dashboard", "--data", "/root/testdata/sf0.001", "--out", dest)
    assert out.returncode == 0, out.stderr[-2000:]
    assert any(f.endswith(".parquet") for f in os.listdir(dest))

"""Executors needn't have the package: its functions travel by value."""
import os
import subprocess
import sys
from pathlib import Path

CODE = """
import sys
sys.path.insert(0, {root!r})
from tidewin.session import session
spark = session("away", "local[2]", spark__sql__shuffle__partitions="2", spark__ui__showConsoleProgress="false")
spark.sparkContext.setLogLevel("OFF")
from tidewin.plans.catalogue import QUERIES
for name in ("features_all", "band_rms_fft", "bootstrap_ci_1000", "streaming_n_of_m", "sql_window_function"):
    assert QUERIES[name](spark, "/root/testdata/sf0.001").count() > 0, name
print("all ran")
"""


def test_from_another_folder(tmp_path):
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    root = str(Path(__file__).resolve().parent.parent)
    done = subprocess.run([sys.executable, "-c", CODE.format(root=root)], cwd=tmp_path, env=env, capture_output=True, text=True, timeout=300)
    assert "all ran" in done.stdout, done.stderr[-2000:]

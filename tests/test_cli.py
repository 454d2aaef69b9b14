"""The command line runs the evaluation job end to end."""

import json
import os
import subprocess
import sys
import tempfile

from aspectspark.sources import corpus as io
from aspectspark.sources import fixtures as fx
from tests.conftest import ROOT, SF001


def test_cli_evaluate(spark):
    root = tempfile.mkdtemp(prefix="cli-")
    io.write_corpus(fx.gold_corpus(spark, SF001), f"{root}/gold")
    io.write_predictions(fx.member_predictions(spark, SF001, [0]).drop("member"), f"{root}/pred")
    out = subprocess.run(
        [sys.executable, "-m", "aspectspark", "--master", "local[2]", "evaluate",
         f"{root}/gold", f"{root}/pred"],
        cwd=ROOT, capture_output=True, text=True, timeout=600,
        env={**os.environ, "PYTHONPATH": ROOT})
    assert out.returncode == 0, out.stderr[-2000:]
    rows = [json.loads(x) for x in out.stdout.splitlines() if x.startswith("{")]
    assert [r["result"] for r in rows] == ["category extraction result", "entire pipeline result"]
    assert all(0.0 < r["f1"] <= 1.0 for r in rows)

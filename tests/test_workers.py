"""Worker functions load where this package is not installed."""

import os
import subprocess
import sys

import numpy as np
from pyspark import cloudpickle

from netspark.ml.boundary import FourierMap
from netspark.ml.forest import IsolationForest, _grow
from netspark.operators.metric_index import distances
from netspark.sources.captures import records

LOAD = """
import pickle, sys
forest, rows, extra = pickle.load(open(sys.argv[1], "rb"))
assert len(forest.raw_scores(rows)) == len(rows) == len(extra[0](rows))
assert list(extra[2](b"")) and extra[1](rows, rows).shape == (len(rows), len(rows))
assert "netspark" not in sys.modules
"""


def test_functions_travel_by_value(tmp_path):
    import pandas as pd

    rows = np.arange(12.0).reshape(6, 2)
    nodes = pd.DataFrame(
        _grow(rows, 1, 0, 3),
        columns=["node", "feature", "threshold", "left", "right", "path"],
    ).assign(tree=0)
    forest = IsolationForest.from_nodes(nodes, 6)
    extra = (FourierMap.draw(2, 0.5), distances, records)
    (tmp_path / "task").write_bytes(cloudpickle.dumps((forest, rows, extra)))
    environment = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    run = subprocess.run(
        [sys.executable, "-c", LOAD, str(tmp_path / "task")],
        cwd=tmp_path,
        env=environment,
        capture_output=True,
        text=True,
    )
    assert run.returncode == 0, run.stderr

import subprocess
import sys
from pathlib import Path
from types import SimpleNamespace

import pytest

from panelforge import session

REPO = Path(__file__).resolve().parent.parent


def fake(master, named=None):
    conf = SimpleNamespace(get=lambda key, default=None: named if key == "spark.checkpoint.dir" else default)
    context = SimpleNamespace(master=master, applicationId=master, getConf=lambda: conf)
    return SimpleNamespace(conf=conf, sparkContext=context)


def test_the_named_folder_is_used_everywhere():
    assert session.shared_folder(fake("yarn", "hdfs:///x/")) == "hdfs:///x"
    assert session.scratch_path(fake("local[2]", "/shared"), "t").startswith("/shared/panelforge/t-")


def test_a_local_folder_is_made_for_a_local_master_only():
    made = session.shared_folder(fake("local[2]"))
    assert Path(made).is_dir() and session.shared_folder(fake("local[2]")) == made
    for master in ("yarn", "spark://host:1", "local-cluster[2,1,1024]"):
        with pytest.raises(RuntimeError, match="spark.checkpoint.dir"):
            session.shared_folder(fake(master))


def test_udf_helpers_travel_with_the_udf():
    """A worker that cannot import the package can still load the pickled helpers."""
    from pyspark import cloudpickle

    from panelforge.functions.spline import fit_series
    from panelforge.functions.tails import tukey_sf

    blob = cloudpickle.dumps((fit_series, tukey_sf)).hex()
    code = (
        "import sys, pickle\n"
        "fit, tail = pickle.loads(bytes.fromhex(sys.stdin.read()))\n"
        "print(fit([[float(i) for i in range(30)]], [[1.0] * 30], 5.0)[0][0][3], tail(3.877, 3, 10))\n"
        "assert 'panelforge' not in sys.modules\n"
    )
    done = subprocess.run(
        [sys.executable, "-c", code], input=blob, capture_output=True, text=True, cwd="/", check=False
    )
    assert done.returncode == 0, done.stderr
    level, p = map(float, done.stdout.split())
    assert level == pytest.approx(1.0) and p == pytest.approx(0.05, abs=1e-3)
    assert str(REPO) not in done.stderr

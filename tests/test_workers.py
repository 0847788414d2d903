"""Functions shipped to Python workers must not need this package there."""

import subprocess
import sys

from pyspark import cloudpickle

from tramline.operators import match


def test_shipped_functions_stand_alone(tmp_path):
    file = tmp_path / "f.pkl"
    file.write_bytes(cloudpickle.dumps(lambda: match.closest_names(["abcd"], ["abce"], 0.6)))
    code = f"import pickle; print(pickle.load(open({str(file)!r}, 'rb'))()[0][1])"
    done = subprocess.run([sys.executable, "-c", code], cwd="/", env={"PATH": ""}, capture_output=True, text=True, check=False)
    assert done.stdout.strip() == "abce", done.stderr

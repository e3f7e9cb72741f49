"""What runs on workers must not need this package to be installed there."""

import base64
import subprocess
import sys

import pytest
from pyspark import cloudpickle

from jobtide.operators.handlers import Deadline, noop
from jobtide.streaming.timers import DueRetries, StuckRuns


@pytest.mark.parametrize("thing", [noop, Deadline, StuckRuns(), DueRetries()])
def test_loads_without_the_package(thing, tmp_path):
    text = base64.b64encode(cloudpickle.dumps(thing)).decode()
    code = f"import base64, pickle, sys; pickle.loads(base64.b64decode('{text}')); assert 'jobtide' not in sys.modules"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True, timeout=60)

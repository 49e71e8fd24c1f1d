"""What the driver has freed goes back to the system between the steps of a query."""

import os
import re
import subprocess
import sys
from pathlib import Path

import pytest

from tidemark.llm.staging import release

pytestmark = pytest.mark.skipif(not Path("/proc/self/smaps_rollup").exists(), reason="reads a process's memory from Linux")


def _anonymous_mb(pid: int | str) -> float:
    return int(re.search(r"\nPss_Anon:\s+(\d+)", Path(f"/proc/{pid}/smaps_rollup").read_text())[1]) / 1024


def _native_before_and_after() -> tuple[float, float]:
    from tidemark.session import session

    spark = session(**{"spark.master": "local[1]", "spark.ui.enabled": "false"})
    jvm = spark._jvm
    release(spark)
    pid = jvm.java.lang.ProcessHandle.current().pid()
    blocks = [jvm.java.util.zip.Deflater() for _ in range(400)]  # some 260 kB each, outside the heap
    for i, b in enumerate(blocks):
        if i % 20:
            b.end()
    for _ in range(2):
        jvm.System.gc()
    before = _anonymous_mb(pid)
    release(spark)
    return before, _anonymous_mb(pid)


def test_release_returns_native_memory_of_the_jvm():
    """Freed blocks between some still held stay with the C library unless it is told. In a new process: a used heap's own changes hide it."""
    env = os.environ | {"PYTHONPATH": str(Path(__file__).parents[2])}
    done = subprocess.run([sys.executable, __file__], env=env, capture_output=True, text=True, timeout=120)
    before, after = map(float, done.stdout.split()[-2:])
    assert after < before - 40


def test_release_returns_memory_of_the_drivers_python(spark):
    release(spark)
    blocks = [b"x" * 60_000 for _ in range(1_500)]
    held = blocks[::20]
    del blocks
    before = _anonymous_mb("self")
    release(spark)
    assert _anonymous_mb("self") < before - 40
    assert len(held) == 75


if __name__ == "__main__":
    print(*_native_before_and_after())

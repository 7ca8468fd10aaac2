"""What the driver's JVM has freed goes back to the system."""

import re
from pathlib import Path

import pytest

from featurelab.llm.common import materialize


def _resident_mb(pid: int) -> int:
    return int(re.search(r"RssAnon:\s+(\d+)", Path(f"/proc/{pid}/status").read_text())[1]) // 1024


def test_freed_native_memory_of_the_driver_is_given_back(spark):
    pid = spark._jvm.java.lang.ProcessHandle.current().pid()
    if not Path(f"/proc/{pid}/status").exists():
        pytest.skip("resident memory can't be read here")
    materialize(spark.range(9), "warm").count()
    before = _resident_mb(pid)
    made = [spark._jvm.java.util.zip.Deflater(9) for _ in range(1000)]  # each has about 256 KB outside the heap
    for d in made:
        d.setInput(bytearray(b"x" * 100_000))
        d.deflate(spark.sparkContext._gateway.new_array(spark._jvm.byte, 100))
    held = _resident_mb(pid)
    for k, d in enumerate(made):
        if k % 10 != 9:  # those that stay keep the C library from returning whole ends of its regions
            d.end()
    freed = _resident_mb(pid)
    assert held - before > 100 and freed > before + 60, (before, held, freed)
    materialize(spark.range(9), "after")
    assert _resident_mb(pid) < freed - 50, (before, held, freed, _resident_mb(pid))
    for d in made[9::10]:
        d.end()

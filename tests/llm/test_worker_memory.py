"""A worker that has ended a task of the pipeline doesn't keep what the task took."""

import subprocess
import sys
from pathlib import Path

import pytest

ROOT = Path(__file__).resolve().parents[2]
#: Spark's frame stands aside: the function that its workers call gets batches and is measured in a process of its own.
TASKS = """
import re, sys
from pathlib import Path
import pyarrow as pa
from featurelab.llm import language_id, packing
from featurelab.llm.common import tokenizer_path

class Frame:
    select = lambda self, *a: self
    mapInArrow = lambda self, task, schema: task

def resident_mb():
    return int(re.search(r"RssAnon:\\s+(\\d+)", Path("/proc/self/status").read_text())[1]) // 1024

def batches(n):
    for b in range(n):
        texts = [" ".join(f"w{b}x{k}y{i}" for i in range(150)) for k in range(250)]
        yield pa.record_batch({"doc_id": pa.array(range(250), pa.int64()), "text": pa.array(texts)})

task = packing.token_pieces(Frame(), tokenizer_path(), ranks=tokenizer_path("byte_bpe_50k.tiktoken"), remember=150_000)
assert sum(x.num_rows for x in task(batches(1))) >= 250
before = resident_mb()
highest = 0
for x in task(batches(4)):
    highest = max(highest, resident_mb())
print(before, highest, resident_mb())
"""


def test_a_packing_worker_gives_back_what_its_task_took():
    if not Path("/proc/self/status").exists():
        pytest.skip("resident memory can't be read here")
    run = subprocess.run([sys.executable, "-c", TASKS], cwd=ROOT, capture_output=True, text=True, timeout=300, check=True)
    before, highest, after = map(int, run.stdout.split())
    assert highest > before + 30, (before, highest, after)
    assert after < before + 15 and after < highest - 40, (before, highest, after)

import subprocess
import sys

import pytest

from quire.llm.workers import releasing

SCRIPT = """
import re
import sys

import pyarrow as pa

from quire.llm import decontaminate, neardup
from quire.llm.workers import release


def held():
    with open("/proc/self/smaps_rollup") as f:
        return int(re.search(r"Pss_Anon:\\s+(\\d+)", f.read())[1]) >> 10


def batches(columns):
    for k in range(4):
        texts = [" ".join(f"w{(d * d + k * i * 7919) % 50021}" for i in range(600)) for d in range(1000)]
        both = pa.RecordBatch.from_arrays([pa.array(range(1000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
        yield both.select(columns)
        del texts, both


for run, columns in ((decontaminate._frequencies, ["text"]), (neardup._describe(5, 48), ["doc_id", "text"])):
    for _ in run(batches(columns)):
        pass
    del _
    kept = held()
    release()
    print(kept - held())
"""


@pytest.mark.skipif(sys.platform != "linux", reason="reads /proc")
def test_a_worker_waits_with_what_it_needs_only():
    out = subprocess.run([sys.executable, "-c", SCRIPT], capture_output=True, text=True, check=True).stdout
    assert all(int(mb) < 16 for mb in out.split()) and len(out.split()) == 2, out


def test_releasing_passes_rows_on_and_closes():
    ended = []

    def run(batches):
        try:
            for b in batches:
                yield b + 1
        finally:
            ended.append(True)

    assert list(releasing(run)(iter([1, 2, 3]))) == [2, 3, 4]
    early = releasing(run)(iter([1, 2, 3]))
    assert next(early) == 2
    early.close()
    assert ended == [True, True]

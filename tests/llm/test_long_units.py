"""Unbroken runs of letters: the windows change nothing, and the cost is linear."""

import os
import random
import subprocess
import sys
import time

import pyarrow as pa

from babelcask.llm import piece_lattice as P


def run_of(n, seed=1):
    rng = random.Random(seed)
    return "".join(rng.choice("abcdefghijklmnopqrstuvwxyzäß") for _ in range(n))


def test_windows_give_the_same_pieces(spark, monkeypatch):
    texts = [run_of(n, n) for n in (1, 40, 63, 64, 65, 128, 700, 3000)] + ["word " * 30 + run_of(200) + " end", "▁" * 70 + "x"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")

    def ids():
        return {r["doc_id"]: r["ids"] for r in P.encode(df).collect()}
    cut = ids()
    monkeypatch.setattr(P, "WINDOW", 5000)
    assert ids() == cut


def test_texts_are_spelled_some_at_a_time(spark, monkeypatch):
    df = spark.createDataFrame([(i, run_of(i * 37, i)) for i in range(30)] + [(99, None), (100, "")], "doc_id long, text string")
    whole = sorted(map(str, P.encode(df).collect()))
    monkeypatch.setattr(P, "PART_IDS", 50)
    assert sorted(map(str, P.encode(df).collect())) == whole
    assert all(r["round_trip"] for r in P.round_trip(df).collect())


def test_a_million_letters_cost_their_length(spark):
    spent = []
    for n in (1000, 100_000, 1_000_000):
        start = time.time()
        row = P.round_trip(spark.createDataFrame([(1, run_of(n))], "doc_id long, text string")).first()
        spent.append(time.time() - start)
        assert row["round_trip"] and row["n_pieces"] > n / 4
    assert spent[2] - spent[0] < 25 * max(1.0, spent[1] - spent[0]) + 10


def test_a_task_that_makes_blocks_gives_its_memory_back(scratch):
    """What a worker keeps after a task (a process of its own here, as a worker is): not the memory of its arrays."""
    rng = random.Random(3)
    words = [run_of(rng.randint(2, 9), i) for i in range(5000)]
    texts = [" ".join(rng.choices(words, k=350)) for _ in range(8000)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(8000), pa.int64()), pa.array(texts)], names=["doc_id", "text"])
    with pa.OSFile(f"{scratch}/docs", "wb") as sink, pa.ipc.new_stream(sink, batch.schema) as out:
        out.write_batch(batch)
    code = f"""
import re
import numpy as np
import pyarrow as pa
from babelcask.llm import piece_lattice as P
def held():
    return sum(map(int, re.findall("Pss_(?:Anon|Shmem): +([0-9]+)", open("/proc/self/smaps_rollup").read()))) >> 10
joins = np.zeros((256, 256), bool)
joins[33:, 33:] = joins[32, 33:] = True
def batches():
    with open("{scratch}/docs", "rb") as f:
        yield from pa.ipc.open_stream(f)
before, n = held(), 0
run = P.releasing(P._make_blocks(joins))
for b in run(batches()):
    n += b.num_rows
    del b
print(n, held() - before)
"""
    here = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    blocks, kept = map(int, subprocess.run([sys.executable, "-c", code], cwd=here, capture_output=True, text=True, check=True).stdout.split())
    assert blocks > 1 and kept < 60

"""What the stages hold in an executor's Python workers."""

import tracemalloc
from types import SimpleNamespace

import numpy as np
import pyarrow as pa

from colonnade.llm import decontam as d, pii


def test_a_shard_takes_few_bytes_a_word(monkeypatch):
    rng = np.random.default_rng(3)
    vocab = np.array([f"word{k}" for k in range(5_000)])
    texts = [" ".join(rng.choice(vocab, 500)) for _ in range(800)]
    item = d.TestBlock([("1", " ".join(texts[7].split()[20:40]).encode())], 10)
    runs = []
    monkeypatch.setattr(d, "SHARD_BYTES", sum(map(len, texts)) // 2)  # two shards of some 200,000 words
    monkeypatch.setattr(d, "_passes", lambda *_: [[SimpleNamespace(value=item)]])
    monkeypatch.setattr(d, "map_rows", lambda docs, run: runs.append(run) or docs)
    d.remove(SimpleNamespace(columns=["text"]), None)
    batch = pa.RecordBatch.from_pydict({"text": texts})
    tracemalloc.start()
    kept = [b.num_rows for b in runs[0]([batch])]
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert sum(kept) == 799 and len(kept) >= 2
    assert most < 50 * 200_000


def test_the_key_starts_no_python_worker(spark):
    out = pii.pseudonymize(spark.createDataFrame(pa.table({"text": ["8.8.8.8"]})), "KEY")
    assert out.count() == 1 and "ExistingRDD" not in out._jdf.queryExecution().toString()

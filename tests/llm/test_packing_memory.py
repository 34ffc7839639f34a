"""What packing holds of texts and words in a worker is bounded."""

from types import SimpleNamespace

import pyarrow as pa

from quotemill.llm import packing, tokens
from quotemill.llm.common import BATCH_ROWS, keep


def test_packing_remembers_few_words_and_encodes_little_at_once(monkeypatch):
    monkeypatch.setattr(packing, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))
    held, taken, made = [], [], tokens.Encoder

    class Watched(made):
        def _encode_some(self, texts):
            taken.append(sum(map(len, texts)))
            out = super()._encode_some(texts)
            held.append(len(self.numbers))
            return out

    monkeypatch.setattr(tokens, "Encoder", Watched)
    tokens._ENCODERS["of an earlier stage"] = object()
    texts = [" ".join(f"w{i}x{k}" for k in range(200)) for i in range(300)]
    batch = pa.RecordBatch.from_arrays([pa.array(range(300)), pa.array(texts)], ["doc_id", "text"])
    out = [pa.Table.from_batches(packing._pieces(p)(iter([batch]))) for p in (packing.Packing(), packing.Packing(words=5_000, documents=16, characters=20_000))]
    assert not tokens._ENCODERS and out[0].equals(out[1])
    few = held[-len(held) // 2 :]
    assert max(taken) > 100_000 and max(few) < 15_000 and max(taken[-10:]) < 25_000


def test_keep_hands_python_few_rows_at_once(spark):
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(name)
    sizes = keep(spark, spark.range(0, 9000, 1, 1).mapInArrow(lambda batches: (pa.RecordBatch.from_arrays([pa.array([b.num_rows])], ["n"]) for b in batches), "n bigint"), "sizes")
    got = [r["n"] for r in sizes.collect()]
    assert sum(got) == 9000 and max(got) <= BATCH_ROWS and spark.conf.get(name) == before

"""What a Python worker keeps from one task to the next."""

import public_tokenizers
import pyarrow as pa

from likewise.llm import bpe, minhash, toxicity, workers


def test_a_task_drops_what_other_operators_remember(monkeypatch):
    monkeypatch.setattr(workers, "_CACHES", {})
    made = []

    @workers.remembered("one")
    def model(name):
        made.append(name)
        return name

    workers.begin("one")
    assert [model("a"), model("a")] == ["a", "a"] and made == ["a"]
    workers.begin("one")
    model("a")
    assert made == ["a"]
    workers.begin("two")
    assert model.cache_info().currsize == 0
    assert model("a") == "a" and made == ["a", "a"]


def test_minhash_tasks_begin_without_vocabularies_and_models():
    bpe.vocabulary(public_tokenizers.path("byte_bpe_50k.tiktoken"))
    batch = pa.RecordBatch.from_arrays([pa.array([1]), pa.array(["a few words of a text"])], names=["doc_id", "text"])
    for task in (minhash._prints(5, 20, 4), minhash._sets(5)):
        assert [b.num_rows for b in task(iter([batch]))] == [1]
        for held in (bpe.vocabulary, toxicity._numbers, toxicity._weights, toxicity._index):
            assert held.cache_info().currsize == 0

import gc
import weakref
from types import SimpleNamespace

import public_tokenizers

from deploylens import scratch as core
from deploylens.llm import common, near_dedup, packing


def run_task(fn):
    """What a worker does for a task of ``fn`` without rows."""
    return list(common.map_batches(SimpleNamespace(mapInArrow=lambda each, schema: each(iter([]))), fn, "a long"))


def test_a_worker_keeps_words_for_its_own_operator_only():
    path = public_tokenizers.path("word_bpe_49k.json")
    packing.word_tokens(path).ids("some words to remember")
    held = weakref.ref(packing.word_tokens(path))
    run_task(packing.plan)
    assert packing.word_tokens(path) is held() and held().memo
    run_task(near_dedup.shingles)
    gc.collect()
    assert held() is None
    assert packing.word_tokens(path).ids("some words to remember") == packing.WordTokens(path).ids("some words to remember")


def test_spent_tables_start_no_python_workers(spark, monkeypatch):
    def refused(*args, **more):
        raise AssertionError("rows from the driver go through Python workers of their own")

    for kind in (common.Scratch, core.Scratch):
        scratch = kind(spark)
        table = scratch.written(spark.range(5), "five")
        (path,) = getattr(scratch, "paths", None) or scratch.tables
        with monkeypatch.context() as m:
            m.setattr(type(spark), "createDataFrame", refused)
            scratch.spent(table)
        assert spark.read.parquet(path).count() == 0

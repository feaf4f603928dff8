"""What workers keep, and the batches that rows go to Python in."""

from __future__ import annotations

import gc
import weakref

import pyarrow as pa
import public_tokenizers

from tripweave.llm import shared
from tripweave.llm.tokens import pieces


def test_nothing_kept_frees_what_refers_to_itself():
    gc.disable()
    try:
        encoder = pieces(public_tokenizers.path("word_bpe_49k.json"))
        encoder.encode(["some words to keep"])
        gone = weakref.ref(encoder)
        del encoder
        shared.nothing_kept()
        assert gone() is None
        first = pieces(public_tokenizers.path("word_bpe_49k.json"))
        gone = weakref.ref(first)
        del first
        pieces(public_tokenizers.path("byte_bpe_50k.json"))
        assert gone() is None
    finally:
        gc.enable()
        shared.nothing_kept()


def test_batches_are_bounded_in_bytes(spark):
    rows = spark.range(0, 400, 1, 1).selectExpr("id", "repeat('x', 100000) as text")

    def sizes(batches):
        for b in batches:
            yield pa.RecordBatch.from_pydict({"n": [b.num_rows], "size": [b.nbytes]})

    got = shared.in_batches(rows, sizes, "n long, size long").collect()
    assert sum(r["n"] for r in got) == 400
    assert max(r["size"] for r in got) <= shared.BATCH_BYTES + 200_000

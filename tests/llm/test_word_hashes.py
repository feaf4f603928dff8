"""Word hashes of long texts, worked out a piece at a time."""

from __future__ import annotations

import tracemalloc

from tripweave.llm import decontaminate


def test_hash_of_a_word_is_the_same_in_any_place():
    words = [b"a", b"bb" * 70, b"c9", "\u00e9\u00e8".encode(), b"z" * (decontaminate.PIECE_BYTES + 5)] * 3
    _, start, end, h = decontaminate.words_of(b" ".join(words))
    assert [int(e - s) for s, e in zip(start, end)] == [len(w) for w in words]
    alone = [int(decontaminate.words_of(w)[3][0]) for w in words]
    assert h.tolist() == alone and len(set(alone)) == 5
    assert all(len(x) == 0 for x in decontaminate.words_of(b" ,. ")[1:])


def test_memory_of_a_shard_of_text():
    raw = b"some words of a text " * 100_000
    tracemalloc.start()
    decontaminate.words_of(raw)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * len(raw)

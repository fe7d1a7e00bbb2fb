import tracemalloc

import pyarrow as pa
from tablog.llm.words import CHUNK_BYTES, text_bytes, text_chunks


def test_text_chunks_hold_one_chunk_at_a_time():
    """Made at once, the texts of a batch took as much memory again as the batch."""
    column = pa.array(["x" * 100_000, None, "", "é" * 100_000] * 100)
    whole = text_bytes(column)
    tracemalloc.start()
    got, ends = 0, []
    for a, b, texts in text_chunks(column):
        got += texts == whole[a:b] and b - a
        ends.append((a, b))
    most = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert got == len(column)
    assert [a for a, _ in ends] == [0, *[b for _, b in ends[:-1]]]
    assert sum(map(len, whole)) > 7 * CHUNK_BYTES
    assert most < 3 * CHUNK_BYTES


def test_text_chunks_of_no_rows():
    assert list(text_chunks(pa.array([], pa.string()))) == []

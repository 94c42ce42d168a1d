"""Runs of certain ASCII characters in texts, from the bytes of an Arrow array at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa


def byte_set(characters: str) -> np.ndarray:
    held = np.zeros(256, bool)
    held[list(characters.encode("ascii"))] = True
    return held


def runs(texts: pa.Array, held: np.ndarray) -> tuple[pa.DictionaryArray, np.ndarray]:
    """The longest runs of the held characters in the texts, in order, and the place of each run's text."""
    texts = texts.cast(pa.string()).fill_null("")
    if not len(texts):
        return pa.array([], pa.string()).dictionary_encode(), np.zeros(0, np.int64)
    _, ends, data = texts.buffers()
    ends = np.frombuffer(ends, np.int32)[texts.offset : texts.offset + len(texts) + 1]
    data = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None else np.zeros(0, np.uint8)
    ends = ends - ends[0]
    inside = held[data]
    begins = inside.copy()
    begins[1:] &= ~inside[:-1]
    heads = ends[:-1][ends[:-1] < len(data)]
    begins[heads] = inside[heads]  # a run does not go on into the next text
    starts = np.flatnonzero(begins)
    text = np.repeat(np.arange(len(texts)), np.diff(np.searchsorted(starts, ends)))
    offsets = np.append(np.flatnonzero(begins[inside]), np.count_nonzero(inside)).astype(np.int32)
    found = pa.StringArray.from_buffers(len(starts), pa.py_buffer(offsets), pa.py_buffer(data[inside]))
    return found.dictionary_encode(), text

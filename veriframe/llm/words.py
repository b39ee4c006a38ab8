"""Words of many texts at once, as byte strings; A-Z are lower-cased, nothing else is."""

from __future__ import annotations

import numpy as np
import pyarrow as pa

from veriframe.llm.rolling import text_bytes

_CODES = np.arange(256)
#: Bytes inside terms: all but the ASCII ranges 00-2F, 3A-40, 5B-60, 7B-7F. In UTF-8 every byte of another character is
#: above them, so bytes split as characters do.
TERM_BYTES = (_CODES >= 0x80) | ((_CODES >= 0x30) & (_CODES <= 0x39)) | ((_CODES >= 0x41) & (_CODES <= 0x5A)) | ((_CODES >= 0x61) & (_CODES <= 0x7A))
#: Bytes inside words: all but space and 09-0D.
WORD_BYTES = ~((_CODES == 0x20) | ((_CODES >= 0x09) & (_CODES <= 0x0D)))
_LOWER = np.where((_CODES >= 0x41) & (_CODES <= 0x5A), _CODES + 32, _CODES).astype(np.uint8)


def split_words(texts: pa.Array, inside: np.ndarray) -> tuple[pa.LargeBinaryArray, np.ndarray]:
    """The maximal runs of ``inside`` bytes of every text in order, and each one's text. Null texts have none."""
    raw, ends = text_bytes(texts)
    if not len(raw):
        return pa.array([], pa.large_binary()), np.zeros(0, dtype=np.int64)
    mask = inside[raw]
    start = mask.copy()
    start[1:] &= ~mask[:-1]
    heads = ends[:-1][ends[:-1] < len(raw)]
    start[heads] = mask[heads]  # no word goes on in the next text
    at = np.flatnonzero(start)
    kept = _LOWER[raw[mask]]
    offsets = np.append((np.cumsum(mask) - mask)[at], len(kept)).astype(np.int64)
    words = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(at), [None, pa.py_buffer(offsets), pa.py_buffer(kept)])
    return words, np.searchsorted(ends, at, side="right") - 1

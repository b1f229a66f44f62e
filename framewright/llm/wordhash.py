"""Words of many texts as codes into their distinct words, and hashes of words.

Arrow splits and codes the words of a batch, so Python sees each distinct word
of a batch once, however often it occurs.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash

try:
    _LIBC = ctypes.CDLL("libc.so.6") if hasattr(ctypes.CDLL("libc.so.6"), "malloc_trim") else None
except OSError:  # no GNU C library here
    _LIBC = None

#: Bytes of text that are coded together; one longer text stands alone.
GROUP_BYTES = 8_000_000
#: Longs that are mixed at a time.
_MIX_ROWS = 1 << 16


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective mixer of 64-bit words (the finaliser of splitmix64)."""
    return mix_in_place(x.astype(np.uint64, copy=True))


def mix_in_place(x: np.ndarray) -> np.ndarray:
    """:func:`mix` of a contiguous uint64 array without a copy, a stretch that fits the cache after the other."""
    for first in range(0, len(x), _MIX_ROWS):
        part = x[first : first + _MIX_ROWS]
        part ^= part >> np.uint64(30)
        part *= np.uint64(0xBF58476D1CE4E5B9)
        part ^= part >> np.uint64(27)
        part *= np.uint64(0x94D049BB133111EB)
        part ^= part >> np.uint64(31)
    return x


def give_back() -> None:
    """Return freed memory to the system: workers live on from stage to stage."""
    pa.default_memory_pool().release_unused()
    if _LIBC is not None:
        _LIBC.malloc_trim(0)


def groups(texts: pa.Array, most: int = GROUP_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """(first row, texts) in runs of about ``most`` bytes; nulls become empty."""
    sizes = np.concatenate([[0], np.cumsum(np.asarray(pc.fill_null(pc.binary_length(texts), 0)), dtype=np.int64)])
    first = 0
    while first < len(texts):
        last = max(first + 1, int(np.searchsorted(sizes, sizes[first] + most, side="right")) - 1)
        # A copy that starts at its own first byte: string kernels misread a slice that was cast in place.
        own = texts.slice(first, last - first).take(pa.array(np.arange(last - first)))
        yield first, pc.fill_null(own.cast(pa.large_string()), "")
        first = last
    give_back()


def coded(texts: pa.Array, lower: bool = False) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    r"""Words ``[^\x20\x09-\x0D]+`` of texts without nulls.

    Returns the code of each word in order, the first word of each text (one
    entry more than texts), and the distinct words as UTF-8.  ``lower`` maps
    A-Z only.
    """
    lists = pc.ascii_split_whitespace(pc.ascii_lower(texts) if lower else texts)
    flat, offsets = lists.flatten(), lists.offsets.to_numpy().astype(np.int64)
    offsets -= offsets[0] if len(offsets) else 0
    keep = np.asarray(pc.binary_length(flat)) > 0
    before = np.concatenate([[0], np.cumsum(keep)])
    one = flat.filter(pa.array(keep)).dictionary_encode()
    one = one.combine_chunks() if isinstance(one, pa.ChunkedArray) else one
    return one.indices.to_numpy(zero_copy_only=False).astype(np.int64), before[offsets], one.dictionary.cast(pa.large_binary()).to_pylist()


def hashes(distinct: list[bytes]) -> np.ndarray:
    """64-bit hashes of distinct words; index them with the codes."""
    return np.fromiter(map(xxhash.xxh3_64_intdigest, distinct), np.uint64, len(distinct))

"""Texts of an Arrow column as one array of code points, and back, without a call per row."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text worked on at once; a longer single text is a piece of its own.
PIECE_BYTES = 1 << 20


def decode(column: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """``(code points, offsets, valid)``: text i is ``code points[offsets[i]:offsets[i + 1]]``; null texts are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("") if column.null_count else column.cast(pa.large_string())
    valid = np.ones(len(column), bool)
    _, at, data = column.buffers()
    ends = np.frombuffer(at, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]] if data is not None and len(column) else np.zeros(0, np.uint8)
    points = np.frombuffer(raw.tobytes().decode("utf-8", "surrogatepass").encode("utf-32-le", "surrogatepass"), np.uint32)
    if len(points) == len(raw):
        return points, ends - ends[0] if len(ends) else np.zeros(1, np.int64), valid
    starts = np.concatenate([[0], np.cumsum((raw & 0xC0) != 0x80)])
    return points, starts[ends - ends[0]], valid


def encode(points: np.ndarray, offsets: np.ndarray, null: np.ndarray | None = None) -> pa.Array:
    """The Arrow strings of ``points`` cut at ``offsets``; rows of ``null`` come out null."""
    points = points.astype(np.uint32, copy=False)
    raw = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
    width = 1 + (points > 0x7F) + (points > 0x7FF) + (points > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width, dtype=np.int64)])[offsets].astype(np.int32)
    out = pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends), pa.py_buffer(raw))
    if null is None or not null.any():
        return out
    return pa.StringArray.from_buffers(len(offsets) - 1, pa.py_buffer(ends), pa.py_buffer(raw), pa.py_buffer(np.packbits(~null, bitorder="little")))


def is_null(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.is_null().to_numpy(zero_copy_only=False)


def rows_of(offsets: np.ndarray) -> np.ndarray:
    """Row number of each code point."""
    return np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))


def moved(offsets: np.ndarray, kept: np.ndarray) -> np.ndarray:
    """The offsets after each code point became ``kept`` of them (0 for a dropped one)."""
    return np.concatenate([[0], np.cumsum(kept, dtype=np.int64)])[offsets]


def pieces(column: pa.Array, size: int = PIECE_BYTES) -> Iterator[tuple[int, pa.Array]]:
    """``(first row, piece)`` of the column, each of a bounded number of bytes or one row."""
    sizes = np.concatenate([[0], np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False), dtype=np.int64)])
    at = 0
    while at < len(column):
        end = max(at + 1, int(np.searchsorted(sizes, sizes[at] + size, "right")) - 1)
        yield at, column.slice(at, end - at)
        at = end

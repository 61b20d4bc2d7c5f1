"""Encoding of a whole corpus with a byte-level BPE vocabulary (problem 6).

Method. Texts of an Arrow batch become one array of code points. A table gather gives each its class (letter, number,
white space, other); where a token starts follows from associative scans (running maxima of the last class change)
over the classes, so no regular expression runs. The slices, as ranges of UTF-8 bytes, are looked up in a cache of
encoded slices; those not yet in it are merged all at once: each pass finds the lowest-ranked pair of every slice and
joins it. Offsets of the slices are kept, so ids decode to the exact bytes of the text.

The vocabulary is a rank file (``base64 rank`` a line) whose path is a parameter; executors read it at that path.
"""

import base64
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from inkmill.llm import codepoints

OTHER, SPACE, LETTER, NUMBER = 0, 1, 2, 3
#: Code points that the pattern's ``\\s`` means besides the separators (category Z).
CONTROL_SPACE = [9, 10, 11, 12, 13, 0x85]
#: Letters after an apostrophe that make a token of their own.
CONTRACTIONS = ["s", "t", "re", "ve", "m", "ll", "d"]
#: Slices kept in a worker's cache before it starts anew.
CACHE_SLICES = 400_000


@lru_cache(1)
def classes() -> np.ndarray:
    """Class of every code point, from the Unicode categories."""
    out = np.zeros(0x110000, np.uint8)
    for a, b in ((0x3400, 0x4DC0), (0x4E00, 0xA000), (0xAC00, 0xD7A4), (0x20000, 0x2A6E0), (0x2A700, 0x2B73A), (0x2B740, 0x2B81E), (0x2B820, 0x2CEA2), (0x2CEB0, 0x2EBE1), (0x30000, 0x3134B)):
        out[a:b] = LETTER
    for a, b in ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0xD800), (0xF900, 0x20000), (0x2A6E0, 0x323B0)):
        kinds = [unicodedata.category(chr(c))[0] for c in range(a, b)]
        out[a:b] = [LETTER if k == "L" else NUMBER if k == "N" else SPACE if k == "Z" else OTHER for k in kinds]
    out[CONTROL_SPACE] = SPACE
    return out


def starts(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """True where a token starts."""
    n = len(points)
    if not n:
        return np.zeros(0, bool)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[offsets] = True
    first = first[:n]
    last = np.ones(n, bool)
    last[:-1] = first[1:]
    change = first.copy()
    change[1:] |= kind[1:] != kind[:-1]
    start = change.copy()
    # The last blank of a run before a token is its own token, or part of the next one if it is U+0020.
    space = kind == SPACE
    before = np.zeros(n, bool)
    before[:-1] = space[:-1] & ~space[1:] & ~last[:-1]
    start |= before
    joined = np.zeros(n, bool)
    joined[1:] = (before & (points == 32))[:-1]
    start &= ~joined
    # A contraction: an apostrophe that starts a token (none of its run before it), then one of the endings.
    quote = np.flatnonzero((points == 39) & change & ~joined)
    if len(quote):
        padded = np.concatenate([points, np.zeros(2, points.dtype)])
        row_end = offsets[np.searchsorted(offsets, quote, "right")]
        done = np.zeros(len(quote), bool)
        for word in CONTRACTIONS:
            hit = ~done & (quote + len(word) < row_end)
            for i, ch in enumerate(word):
                hit &= padded[np.minimum(quote + 1 + i, n)] == ord(ch)
            at = quote[hit]
            start[at + 1] = False
            after = at + 1 + len(word)
            after = after[after < n]
            start[after] |= ~joined[after]
            done |= hit
    return start


@lru_cache(4)
def _vocabulary(path: str) -> tuple[dict[bytes, int], np.ndarray, np.ndarray, np.ndarray]:
    """Ranks; the id of each byte; sorted keys of mergeable pairs of ids and the id of each."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f if x.strip())}
    keys, ids = [], []
    for word, i in ranks.items():
        for cut in range(1, len(word)):
            a, b = ranks.get(word[:cut]), ranks.get(word[cut:])
            if a is not None and b is not None:
                keys.append((a << 20) | b)
                ids.append(i)
    order = np.argsort(np.array(keys, np.int64))
    return ranks, np.array([ranks[bytes([b])] for b in range(256)], np.int32), np.array(keys, np.int64)[order], np.array(ids, np.int32)[order]


@lru_cache(4)
def _pair_table(path: str) -> tuple[np.ndarray, np.ndarray, int]:
    """Open-addressed table of the pairs, so that a lookup is a few gathers."""
    _, _, keys, ids = _vocabulary(path)
    bits = int(np.ceil(np.log2(len(keys) * 4)))
    slots, values = np.full(1 << bits, -1, np.int64), np.full(1 << bits, _NONE, np.int32)
    slot, left = _slot(keys, bits), np.arange(len(keys))
    while len(left):
        at = slot[left]
        free = slots[at] < 0
        slots[at[free]] = keys[left[free]]
        won = slots[at] == keys[left]
        values[at[won]] = ids[left[won]]
        left = left[~won]
        slot[left] = (slot[left] + 1) & ((1 << bits) - 1)
    return slots, values, bits


_NONE = np.int32(2**31 - 1)


def _slot(keys: np.ndarray, bits: int) -> np.ndarray:
    return ((keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - bits)).astype(np.int64)


def _pair_ids(a: np.ndarray, b: np.ndarray, path: str) -> np.ndarray:
    """Id of each joined pair, ``_NONE`` where it is no token."""
    slots, values, bits = _pair_table(path)
    keys = (a.astype(np.int64) << 20) | b
    at = _slot(keys, bits)
    out = np.full(len(keys), _NONE, np.int32)
    left = np.arange(len(keys))
    while len(left):
        there = slots[at]
        hit = there == keys[left]
        out[left[hit]] = values[at[hit]]
        more = ~hit & (there >= 0)
        left, at = left[more], (at[more] + 1) & ((1 << bits) - 1)
    return out


def merge(raw: np.ndarray, lengths: np.ndarray, path: str) -> tuple[np.ndarray, np.ndarray]:
    """Merge many slices at once: their bytes one after the other and their lengths give the ids and their counts."""
    _, byte_ids, _, _ = _vocabulary(path)
    ids, word = byte_ids[raw], np.repeat(np.arange(len(lengths)), lengths)
    done_ids, done_words = [], []
    pair = np.full(len(ids), _NONE, np.int32)
    inner = np.flatnonzero(word[1:] == word[:-1])
    pair[inner] = _pair_ids(ids[inner], ids[inner + 1], path)
    while len(ids):
        begin = np.flatnonzero(np.concatenate([[True], word[1:] != word[:-1]]))
        best = np.minimum.reduceat(pair, begin)
        size = np.diff(np.concatenate([begin, [len(ids)]]))
        live = np.repeat(best < _NONE, size)
        if not live.all():
            done_ids.append(ids[~live])
            done_words.append(word[~live])
            ids, word, pair = ids[live], word[live], pair[live]
            size, best = size[best < _NONE], best[best < _NONE]
            if not len(ids):
                break
        at = np.flatnonzero(pair == np.repeat(best, size))
        # Of overlapping equal pairs the left one is joined: every second of a run of neighbours.
        if len(at) > 1:
            run = np.concatenate([[True], np.diff(at) != 1])
            nth = np.arange(len(at)) - np.maximum.accumulate(np.where(run, np.arange(len(at)), 0))
            at = at[nth % 2 == 0]
        ids[at] = pair[at]
        keep = np.ones(len(ids), bool)
        keep[at + 1] = False
        fresh = np.zeros(len(ids), bool)
        fresh[at] = True
        ids, word, pair, fresh = ids[keep], word[keep], pair[keep], fresh[keep]
        fresh[:-1] |= fresh[1:]
        redo = np.flatnonzero(fresh)
        pair[redo] = _NONE
        redo = redo[redo + 1 < len(ids)]
        redo = redo[word[redo] == word[redo + 1]]
        pair[redo] = _pair_ids(ids[redo], ids[redo + 1], path)
    ids, words = np.concatenate(done_ids or [ids]), np.concatenate(done_words or [word])
    order = np.argsort(words, kind="stable")
    return ids[order], np.bincount(words, minlength=len(lengths))


class Encoder:
    """Encodes batches of texts; keeps the ids of slices it has seen."""

    def __init__(self, path: str):
        self.path = path
        self.ranks = _vocabulary(path)[0]
        self._forget()

    def _forget(self) -> None:
        self.seen: dict[bytes, int] = {}
        self.pool, self.ends = np.zeros(1 << 16, np.int32), np.zeros(1 << 14, np.int64)

    def _learn(self, words: list[bytes]) -> None:
        """Merge new slices and keep their ids in the pool."""
        ids, counts = merge(np.frombuffer(b"".join(words), np.uint8), np.fromiter(map(len, words), np.int64, len(words)), self.path)
        n = len(self.seen)
        used = self.ends[n]
        if used + len(ids) > len(self.pool):
            self.pool = np.concatenate([self.pool[:used], np.zeros(used + 2 * len(ids), np.int32)])
        if n + len(words) + 1 > len(self.ends):
            self.ends = np.concatenate([self.ends[: n + 1], np.zeros(n + 2 * len(words), np.int64)])
        self.pool[used : used + len(ids)] = ids
        self.ends[n + 1 : n + 1 + len(words)] = used + np.cumsum(counts)
        self.seen.update(zip(words, range(n, n + len(words))))

    def slices(self, points: np.ndarray, offsets: np.ndarray) -> tuple[bytes, np.ndarray, np.ndarray]:
        """``(UTF-8 bytes, byte offsets of the slices, slices before each row)``."""
        start = starts(points, offsets)
        raw = points.tobytes().decode("utf-32-le", "surrogatepass").encode("utf-8", "surrogatepass")
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        ends = np.concatenate([[0], np.cumsum(width)])
        at = np.flatnonzero(start)
        return raw, np.concatenate([ends[at], ends[-1:]]), np.searchsorted(at, offsets)

    def encode(self, points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all rows and their offsets."""
        raw, cut, before = self.slices(points, offsets)
        bounds = cut.tolist()
        words = [raw[a:b] for a, b in zip(bounds, bounds[1:])]
        if len(self.seen) > CACHE_SLICES:
            self._forget()
        which = np.fromiter(map(self.seen.get, words, repeat(-1)), np.int64, len(words))
        fresh = np.flatnonzero(which < 0).tolist()
        if fresh:
            self._learn(list(dict.fromkeys(words[i] for i in fresh)))
            which[fresh] = [self.seen[words[i]] for i in fresh]
        begin, size = self.ends[which], self.ends[which + 1] - self.ends[which]
        ends = np.cumsum(size)
        total = int(ends[-1]) if len(ends) else 0
        ids = self.pool[np.repeat(begin - (ends - size), size) + np.arange(total)]
        return ids, np.concatenate([[0], ends])[before]


def encode_array(column: pa.Array, encoder: Encoder) -> pa.Array:
    """List of ids of each text; null and empty texts have an empty list."""
    lists = []
    for _, piece in codepoints.pieces(column):
        points, offsets, _ = codepoints.decode(piece)
        ids, at = encoder.encode(points, offsets)
        lists.append(pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(ids, pa.int32())))
    return pa.concat_arrays(lists) if lists else pa.array([], pa.list_(pa.int32()))


@lru_cache(4)
def _spelled(path: str) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of all tokens one after the other, by id, and where each begins."""
    by_id = _by_id(path)
    sizes = np.zeros(max(by_id) + 2, np.int64)
    for i, w in by_id.items():
        sizes[i + 1] = len(w)
    return np.frombuffer(b"".join(by_id.get(i, b"") for i in range(len(sizes) - 1)), np.uint8), np.cumsum(sizes)


def token_starts(ids: pa.ListArray, path: str) -> pa.Array:
    """Where each token begins in the UTF-8 bytes of its text."""
    begins = _spelled(path)[1]
    flat, at = ids.flatten().to_numpy(), ids.offsets.to_numpy().astype(np.int64)
    ends = np.concatenate([[0], np.cumsum(begins[flat + 1] - begins[flat])])
    return pa.ListArray.from_arrays(pa.array(at - at[0], pa.int32()), pa.array(ends[:-1] - np.repeat(ends[at[:-1] - at[0]], np.diff(at)), pa.int32()))


def decode_array(ids: pa.ListArray, path: str) -> pa.Array:
    """The text of each list of ids: token bytes gathered at the tokens' offsets; null stays null."""
    pool, begins = _spelled(path)
    flat, at = ids.flatten().to_numpy(zero_copy_only=False), ids.offsets.to_numpy().astype(np.int64)
    size = begins[flat + 1] - begins[flat]
    ends = np.concatenate([[0], np.cumsum(size)])
    raw = pool[np.repeat(begins[flat] - ends[:-1], size) + np.arange(ends[-1])]
    cut = ends[at - at[0]]
    valid = None if not ids.null_count else pa.py_buffer(np.packbits(~codepoints.is_null(ids), bitorder="little"))
    return pa.LargeStringArray.from_buffers(len(ids), pa.py_buffer(cut), pa.py_buffer(np.ascontiguousarray(raw)), valid).cast(pa.string())


def with_ids(frame: DataFrame, path: str, text: str = "text", into: str = "ids", begins: str | None = None) -> DataFrame:
    """Replace ``text`` by ``into``, its token ids (array of int); other columns stay as they are.

    With ``begins`` a column of that name says where each token begins in the UTF-8 bytes of the text. Null and empty
    texts have empty lists; special tokens' strings are ordinary text; repeated rows come out again.
    """
    made = [into] if begins is None else [into, begins]
    names = [x for x in frame.columns if x not in (text, *made)]
    schema = T.StructType([*[frame.schema[x] for x in names], *[T.StructField(x, T.ArrayType(T.IntegerType())) for x in made]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(path)
        for b in batches:
            ids = encode_array(b.column(text), encoder)
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], ids, *([] if begins is None else [token_starts(ids, path)])], names=[*names, *made])

    return frame.select(*names, text).mapInArrow(run, schema)


def with_text(frame: DataFrame, path: str, ids: str = "ids", into: str = "text") -> DataFrame:
    """Replace ``ids`` by the text they stand for; an empty list is an empty text, null stays null."""
    names = [x for x in frame.columns if x not in (ids, into)]
    schema = T.StructType([*[frame.schema[x] for x in names], T.StructField(into, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], decode_array(b.column(ids), path)], names=[*names, into])

    return frame.select(*names, ids).mapInArrow(run, schema)


def decode_ids(ids: list[int], path: str) -> str:
    """The text of ``ids``."""
    by_id = _by_id(path)
    return b"".join(by_id[i] for i in ids).decode("utf-8", "surrogatepass")


@lru_cache(4)
def _by_id(path: str) -> dict[int, bytes]:
    return {i: w for w, i in _vocabulary(path)[0].items()}

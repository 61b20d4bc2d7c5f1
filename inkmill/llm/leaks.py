"""Evaluation passages inside a training corpus (problem 7).

Method: spaced-seed hashing. A text becomes its letters and digits in one case and one form. Fixed masks, some of
whose positions are ignored, slide over the letters; hashes of the evaluation side and of the corpus are joined, and
around every hit the overlap is extended over single changed, missing or additional letters and measured.

Hashes come from a running polynomial sum modulo 2^64, so any mask and any common extension is a few differences of
whole arrays. The evaluation items are the stated query set: they are taken in blocks of at most ``block_letters``
letters. A block's hashes are sent to the tasks, with a filter sized by their number, its result is written, and they
are released before the next block is read, so the driver and the tasks hold one block at a time. The corpus is read once
a block (4,000 items of 500 letters are one). Phrases that many texts and items share have many hits, so candidates are
verified where they are found and never shuffled.

Of equal hashes that overlap one another, as in a letter repeated ten thousand times, only the first and the last stand
for the run, and pairs of positions are verified a bounded number at a time.
"""

import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, reduce

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm import codepoints
from inkmill.llm.canonical import canonical_points
from inkmill.sources.tables import materialise

#: Letters a passage must have, by the language of the item.
PASSAGE, PASSAGE_OF = 45, {"en": 80}
#: A whole item counts from this many letters on; below, it is a phrase.
WHOLE_ITEM = 20
#: Masks as (start, end) of the positions that count, for short passages and for those of 80 letters.
SHORT_MASKS = [((0, 12),), ((0, 5), (6, 12)), ((0, 4), (5, 9), (10, 14))]
LONG_MASKS = [((0, 20),), ((0, 10), (11, 21)), ((0, 7), (8, 15), (16, 23))]
#: Letters that must agree after a changed, missing or additional one.
RESUME, RESUME_LONG = 5, 8
BLOCK_LETTERS = 2_000_000
_B = 0x9E3779B97F4A7C15 | 1
#: Slots of a mask's filter, at least and at most (as powers of two); eight or more for each hash in between.
FILTER_BITS = 18, 26
#: Pairs of positions that are verified at once.
PAIRS = 1 << 20


@lru_cache(1)
def _letters_table() -> np.ndarray:
    """Lower case of each letter or digit, 0 for everything else."""
    out = np.arange(0x110000, dtype=np.uint32)
    for a, b in ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xD7A4, 0x20000), (0xE0000, 0x110000)):
        for c in range(a, min(b, 0x1FFFF) if a < 0xE0000 else a):
            ch = chr(c)
            low = ch.lower()
            out[c] = (ord(low) if len(low) == 1 else c) if unicodedata.category(ch)[0] in "LN" else 0
    out[0xD800:0xF900] = 0
    out[0xE0000:] = 0
    return out


def letters(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Letters and digits of each text in one form and case: code points and offsets."""
    points, offsets = canonical_points(*codepoints.decode(column)[:2])
    low = _letters_table()[points]
    keep = low > 0
    return low[keep], codepoints.moved(offsets, keep)


@lru_cache(8)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """B^i and B^-i modulo 2^64, for i below n (a power of two)."""
    def of(base: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) < n:
            out = np.concatenate([out, out * np.uint64(pow(base, len(out), 1 << 64))])
        return out
    return of(_B), of(pow(_B, -1, 1 << 64))


def _sums(points: np.ndarray) -> np.ndarray:
    """Running polynomial sums, the hash of any range times B^start."""
    x = points.astype(np.uint64)
    x = (x + np.uint64(0x632BE59BD9B4E019)) * np.uint64(0xD6E8FEB86659FD93)
    x ^= x >> np.uint64(32)
    x *= np.uint64(0xCA5A826395121157)
    power, _ = _powers(1 << max(10, int(len(points)).bit_length()))
    return np.concatenate([np.zeros(1, np.uint64), np.cumsum(x * power[: len(x)], dtype=np.uint64)])


def seeds(sums: np.ndarray, offsets: np.ndarray, mask: tuple, wanted: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of ``mask`` at every position where it fits into its text (and whose top bits are ``wanted``), and these positions."""
    n, span = len(sums) - 1, mask[-1][1]
    if n < span:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    total = np.zeros(n - span + 1, np.uint64)
    for a, b in mask:
        total += sums[b : n - span + 1 + b]
        total -= sums[a : n - span + 1 + a]
    _, inverse = _powers(1 << max(10, n.bit_length()))
    total *= inverse[: len(total)]
    at = np.arange(len(total)) if wanted is None else np.flatnonzero(wanted[total >> np.uint64(65 - len(wanted).bit_length())])
    at = at[at + span <= offsets[np.searchsorted(offsets, at, "right")]]
    return total[at], at


def _ends_of_runs(h: np.ndarray, at: np.ndarray, row: np.ndarray, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes in order, with their positions; of equal ones of a text that overlap one another only the first and the last.

    A passage that goes on beyond a periodic run on one side lies as the run's end on that side does, and within runs any
    two ends give the same length, so nothing is lost.
    """
    order = np.lexsort((at, h))
    h, at, row = h[order], at[order], row[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1]) | (at[1:] - at[:-1] > span)
    last = np.ones(len(h), bool)
    last[:-1] = new[1:]
    return h[new | last], at[new | last]


def _common(a: np.ndarray, i: np.ndarray, a_left: np.ndarray, b: np.ndarray, j: np.ndarray, b_left: np.ndarray, back: bool = False) -> np.ndarray:
    """Letters that agree from position i of a and j of b on (before them if ``back``), at most the letters left."""
    low, high = np.zeros(len(i), np.int64), np.minimum(a_left, b_left)
    _, inverse = _powers(1 << max(10, max(len(a), len(b)).bit_length()))
    while True:
        live = np.flatnonzero(low < high)
        if not len(live):
            return low
        mid = (low[live] + high[live] + 1) // 2
        x, y = i[live], j[live]
        if back:
            x, y = x - mid, y - mid
        same = (a[x + mid] - a[x]) * inverse[x] == (b[y + mid] - b[y]) * inverse[y]
        low[live[same]] = mid[same]
        high[live[~same]] = mid[~same] - 1


@dataclass(frozen=True)
class Items:
    """One block of the evaluation side: letters' sums, offsets, ids, thresholds and the hashes of all masks."""

    sums: np.ndarray
    offsets: np.ndarray
    ids: np.ndarray
    long: np.ndarray
    need: np.ndarray
    tables: tuple


def index_items(ids: list, texts: list, langs: list) -> Items:
    points, offsets = letters(pa.array(texts, pa.string()))
    sums = _sums(points)
    short = np.array([(x or "").lower() for x in langs])
    need = np.array([PASSAGE_OF.get(x, PASSAGE) for x in short], np.int64)
    size = np.diff(offsets)
    need = np.where((size < need) & (size >= WHOLE_ITEM), size, need)
    long = np.array([PASSAGE_OF.get(x, PASSAGE) > PASSAGE for x in short], bool)
    row = codepoints.rows_of(offsets)
    tables = []
    for masks, of in ((SHORT_MASKS, ~long), (LONG_MASKS, long)):
        for mask in masks:
            h, at = seeds(sums, offsets, mask)
            own = of[row[at]]
            h, at = _ends_of_runs(h[own], at[own], row[at[own]], mask[-1][1])
            size = min(max((8 * len(h)).bit_length(), FILTER_BITS[0]), FILTER_BITS[1])
            bits = np.zeros(1 << size, bool)
            bits[(h >> np.uint64(64 - size)).astype(np.int64)] = True
            bits = np.packbits(bits, bitorder="little")
            tables.append((mask, h, at, bits))
    return Items(sums, offsets, np.array(ids, np.int64), long, need, tuple(tables))


def passages(points: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(row of the text, item) of every text with a passage that is long enough."""
    sums, width = _sums(points), len(items.sums)
    rows = codepoints.rows_of(offsets)
    pairs, held, found = [], 0, []
    for mask, h, at, bits in items.tables:
        if not len(h):
            continue
        mine, here = seeds(sums, offsets, mask, np.unpackbits(bits, bitorder="little").view(bool))
        left = np.searchsorted(h, mine, "left")
        known = h[np.minimum(left, len(h) - 1)] == mine
        mine, here = _ends_of_runs(mine[known], here[known], rows[here[known]], mask[-1][1])
        left = np.searchsorted(h, mine, "left")
        n = np.searchsorted(h, mine, "right") - left
        ends, low = np.cumsum(n), 0
        while low < len(n):
            high = max(low + 1, int(np.searchsorted(ends, (ends[low - 1] if low else 0) + PAIRS, "right")))
            own = n[low:high]
            pair = np.repeat(here[low:high], own) * width + at[np.repeat(left[low:high] - (np.cumsum(own) - own), own) + np.arange(own.sum())]
            pair.sort()
            # A hit one letter after another on the same diagonal lies in the same run of equal letters.
            before = np.minimum(np.searchsorted(pair, pair - (width + 1)), len(pair) - 1)
            pairs.append(pair[pair[before] != pair - (width + 1)])
            held += len(pairs[-1])
            if held > PAIRS:
                found.append(_long_enough(np.unique(np.concatenate(pairs)), sums, offsets, items))
                pairs, held = [], 0
            low = high
    if held:
        found.append(_long_enough(np.unique(np.concatenate(pairs)), sums, offsets, items))
    if not found:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = np.unique(np.concatenate([r * len(items.ids) + i for r, i in found]))
    return np.divmod(both, len(items.ids))


def _long_enough(pair: np.ndarray, sums: np.ndarray, offsets: np.ndarray, items: Items) -> tuple[np.ndarray, np.ndarray]:
    """(row, item) of the hits, as position of the text times width plus that of the item, around which a passage is long enough."""
    width = len(items.sums)
    d, q = np.divmod(pair, width)
    row, item = np.searchsorted(offsets, d, "right") - 1, np.searchsorted(items.offsets, q, "right") - 1

    def bounds(d: np.ndarray, q: np.ndarray, row: np.ndarray, item: np.ndarray, back: bool) -> tuple[np.ndarray, np.ndarray]:
        return (d - offsets[row], q - items.offsets[item]) if back else (offsets[row + 1] - d, items.offsets[item + 1] - q)

    # A hit lies in a run of equal letters around the mask's first block; hits of one run are one.
    back = _common(sums, d, *bounds(d, q, row, item, True)[:1], items.sums, q, bounds(d, q, row, item, True)[1], back=True)
    d, q = np.divmod(np.unique((d - back) * width + q - back), width)
    row, item = np.searchsorted(offsets, d, "right") - 1, np.searchsorted(items.offsets, q, "right") - 1
    resume = np.where(items.long[item], RESUME_LONG, RESUME)
    run = _common(sums, d, bounds(d, q, row, item, False)[0], items.sums, q, bounds(d, q, row, item, False)[1])
    length = run.copy()
    for back in (False, True):
        x, y = (d.copy(), q.copy()) if back else (d + run, q + run)
        live = np.arange(len(d))
        while len(live):
            best, by_x, by_y = np.zeros(len(live), np.int64), np.zeros(len(live), np.int64), np.zeros(len(live), np.int64)
            for sx, sy in ((1, 1), (0, 1), (1, 0)):
                left_x, left_y = bounds(x[live], y[live], row[live], item[live], back)
                can = np.flatnonzero((left_x > sx) & (left_y > sy))
                if not len(can):
                    continue
                one = -1 if back else 1
                more = _common(sums, x[live[can]] + one * sx, left_x[can] - sx, items.sums, y[live[can]] + one * sy, left_y[can] - sy, back)
                better = more > best[can]
                best[can[better]], by_x[can[better]], by_y[can[better]] = more[better], sx, sy
            on = best >= resume[live]
            live, best, by_x, by_y = live[on], best[on], by_x[on], by_y[on]
            step = -1 if back else 1
            x[live] += step * (best + by_x)
            y[live] += step * (best + by_y)
            length[live] += best + by_y
    enough = length >= items.need[item]
    return row[enough], item[enough]


def leaks(documents: DataFrame, items: DataFrame, block_letters: int = BLOCK_LETTERS) -> DataFrame:
    """``(doc, item)`` of every document that holds an item or a long enough passage of it.

    ``documents`` has ``doc, text`` and ``items`` has ``item, text, lang``; other columns are ignored. Null and empty
    texts on either side give no case, items below ``WHOLE_ITEM`` letters neither; repeated rows give one case; an
    empty table gives an empty result. ``doc`` and ``item`` are BIGINT.
    """
    found, blocks = [], _blocks(items, block_letters)
    block = next(blocks, None)
    while block:
        after = next(blocks, None)
        hits, sent = _scan(documents, index_items(*block))
        if after or found:  # more than one block: let go of each before the next
            hits = materialise(hits.distinct(), "leaks")
            sent.unpersist()
        found.append(hits)
        block = after
    if not found:
        return documents.select(F.col("doc").cast("bigint")).limit(0).withColumn("item", F.lit(None).cast("bigint"))
    return reduce(DataFrame.unionByName, found).distinct()


def _blocks(items: DataFrame, block_letters: int) -> Iterator[tuple[list, list, list]]:
    """Items in blocks of a bounded size, one on the driver at a time."""
    ids, texts, langs, size = [], [], [], 0
    for r in items.where("text is not null and text <> '' and item is not null").select("item", "text", "lang").toLocalIterator():
        if ids and size + len(r.text) > block_letters:
            yield ids, texts, langs
            ids, texts, langs, size = [], [], [], 0
        ids.append(r.item)
        texts.append(r.text)
        langs.append(r.lang)
        size += len(r.text)
    if ids:
        yield ids, texts, langs


def _scan(documents: DataFrame, block: Items) -> tuple[DataFrame, Broadcast]:
    """Hits of one block, and what was sent to the tasks for it."""
    sent = documents.sparkSession.sparkContext.broadcast(block)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, piece in codepoints.pieces(b.column("text")):
                row, item = passages(*letters(piece), sent.value)
                yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(row + at)), pa.array(sent.value.ids[item], pa.int64())], names=["doc", "item"])

    return documents.where("text is not null and text <> ''").select(F.col("doc").cast("bigint"), "text").mapInArrow(run, "doc bigint, item bigint"), sent

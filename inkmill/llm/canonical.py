"""One consistent form for text that looks the same (problem 3).

Method: Arrow text becomes one array of code points; a lookup table says into how many code points each expands and
where these are; gathers at expansion offsets write them; marks are put in canonical order and composed with their
base by a searched table, all over the whole batch and without a call per row.

The form keeps every visible difference. It drops invisible characters, turns line ends into LF and blanks of any
width into a space, wide and narrow forms into the plain sign, radicals, compatibility ideographs, ligatures and
Roman numeral signs into the signs they look like, and look-alike letters into the Latin ones.
"""

import sys
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from inkmill.llm import codepoints
from inkmill.sources.tables import materialise

# Letters and signs of other scripts that look like these (public confusables data).
LOOKALIKES = {
    "A": "АΑ", "B": "ВΒ", "C": "СϹ", "E": "ЕΕ", "G": "Ԍ", "H": "НΗ", "I": "ІΙӀ", "J": "ЈͿ", "K": "КΚ", "M": "МΜ", "N": "Ν", "O": "ОΟ", "P": "РΡ", "Q": "Ԛ",
    "S": "Ѕ", "T": "ТΤ", "W": "Ԝ", "X": "ХΧ", "Y": "ҮΥ", "Z": "Ζ", "a": "а", "c": "сϲ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ",
    "o": "оο", "p": "р", "q": "ԛ", "s": "ѕ", "v": "ѵν", "w": "ԝ", "x": "х", "y": "у", "〇": "○◯", "—": "―", "-": "‐‑", "·": "‧",
}
#: Invisible though not format characters: fillers, joiners, variation selectors.
INVISIBLE = [0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0x180B, 0x1810), *range(0xFE00, 0xFE10), *range(0xE0100, 0xE01F0)]
#: Format characters that show a sign.
VISIBLE_FORMAT = {*range(0x0600, 0x0606), 0x06DD, 0x070F, 0x0890, 0x0891, 0x08E2, 0x110BD, 0x110CD}
LINE_ENDS = {0x0D, 0x85, 0x2028, 0x2029, 0x0B, 0x0C}
#: Blocks whose compatibility decomposition looks the same: digraphs, Roman numerals, radicals, Latin ligatures.
SAME_LOOK = [(0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0x2E80, 0x2FDF), (0xFB00, 0xFB06)]
#: Where code points with a decomposition or a property of interest lie; hangul syllables decompose by arithmetic.
BLOCKS = [(0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xF900, 0x10000), (0x10000, 0x17000), (0x1B000, 0x20000), (0x2F800, 0x2FA20), (0xE0000, 0xE0200)]
SPECIAL = {"Zs", "Zl", "Zp", "Cf", "Cc"}
_BASE, _LEFT, _VOWEL, _TAIL = 0xAC00, 0x1100, 0x1161, 0x11A7


def _expand(c: int) -> str:
    """What code point ``c`` stands for, before composition."""
    ch = chr(c)
    if c in LINE_ENDS:
        return "\n"
    kind = unicodedata.category(ch)
    if kind == "Zs" or c == 9:
        return " "
    if (kind == "Cf" and c not in VISIBLE_FORMAT) or (kind == "Cc" and c != 10):
        return ""
    tag, _, rest = unicodedata.decomposition(ch).partition(" ")
    if tag in ("<wide>", "<narrow>") or (tag == "<compat>" and any(a <= c <= b for a, b in SAME_LOOK)):
        return "".join(_expand(int(x, 16)) for x in rest.split())
    return unicodedata.normalize("NFD", ch)


@lru_cache(1)
def tables() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Expansion length, start and pool; combining class; sorted (base, mark) pairs and what they compose to."""
    top = sys.maxunicode + 1
    length, start, cls = np.ones(top, np.uint8), np.arange(top, dtype=np.uint32), np.zeros(top, np.uint8)
    alike = {ord(x): c for c, xs in LOOKALIKES.items() for x in xs}
    hidden = set(INVISIBLE)
    at, extra, pairs = top, [], {}
    for c in (c for a, b in BLOCKS for c in range(a, b)):
        ch = chr(c)
        both = unicodedata.decomposition(ch)
        kind = unicodedata.category(ch)
        if not both and kind not in SPECIAL and c not in alike and c not in hidden:
            cls[c] = unicodedata.combining(ch) if kind[0] == "M" else 0
            continue
        cls[c] = unicodedata.combining(ch)
        to = "" if c in hidden else "".join(alike.get(ord(x), x) for x in _expand(c))
        if to != ch:
            length[c], start[c] = len(to), at
            extra += map(ord, to)
            at += len(to)
        if both and both[0] != "<" and len(both := both.split()) == 2 and unicodedata.normalize("NFC", ch) == ch:
            x, y = (int(x, 16) for x in both)
            key = (ord(alike.get(x, chr(x))) << 21) | y
            pairs[key] = min(c, pairs.get(key, c))
    s = np.arange(11172, dtype=np.uint32)
    jamo = np.stack([_LEFT + s // 588, _VOWEL + s % 588 // 28, _TAIL + s % 28], 1)
    length[_BASE : _BASE + 11172], start[_BASE : _BASE + 11172] = 2 + (s % 28 > 0), at + 3 * s
    extra += jamo.ravel().tolist()
    keys = np.array(sorted(pairs), np.uint64)
    return length, start, np.concatenate([np.arange(top, dtype=np.uint32), np.array(extra, np.uint32)]), cls, keys, np.array([pairs[int(k)] for k in keys], np.uint32)


def _compose(points: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Put marks in canonical order and join each with the base right before it, one mark of every base a pass."""
    _, _, _, cls, keys, made = tables()
    ccc = cls[points]
    marks = np.flatnonzero(ccc)
    if len(marks) > 1 and ((np.diff(marks) == 1) & (ccc[marks[1:]] < ccc[marks[:-1]])).any():
        run = np.cumsum(np.concatenate([[1], np.diff(marks) != 1]))
        points = points.copy()
        points[marks] = points[marks[np.lexsort((ccc[marks], run))]]
        ccc = cls[points]
    while len(points) > 1:
        hit = np.flatnonzero(ccc[1:]) if ccc.any() else np.zeros(0, np.int64)
        hit = hit[(ccc[hit] == 0) & (row[hit + 1] == row[hit])]
        key = (points[hit].astype(np.uint64) << np.uint64(21)) | points[hit + 1]
        k = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
        ok = keys[k] == key
        to, hit = made[k[ok]], hit[ok]
        jamo = np.flatnonzero(points[1:] - np.uint32(_VOWEL) < 21)
        jamo = jamo[(points[jamo] - np.uint32(_LEFT) < 19) & (row[jamo + 1] == row[jamo])]
        lv = np.flatnonzero(points[1:] - np.uint32(_TAIL + 1) < 27)
        lv = lv[(points[lv] - np.uint32(_BASE) < 11172) & ((points[lv] - np.uint32(_BASE)) % 28 == 0) & (row[lv + 1] == row[lv])]
        if not len(hit) + len(jamo) + len(lv):
            break
        points = points.copy()
        gone = np.zeros(len(points), bool)
        syllable = _BASE + (points[jamo] - _LEFT) * 588 + (points[jamo + 1] - _VOWEL) * 28
        closed = points[lv] + points[lv + 1] - _TAIL
        points[hit], points[jamo], points[lv] = to, syllable, closed
        gone[hit + 1] = gone[jamo + 1] = gone[lv + 1] = True
        points, row, ccc = points[~gone], row[~gone], cls[points][~gone]
    return points, row


def canonical_points(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The form of a batch of code points."""
    length, start, pool, _, _, _ = tables()
    if len(points):  # CR before LF is part of the same line end
        drop = np.zeros(len(points), bool)
        drop[:-1] = (points[:-1] == 13) & (points[1:] == 10)
        drop[offsets[1:-1][(offsets[1:-1] > 0) & (offsets[1:-1] < len(points))] - 1] = False
        n = length[points].astype(np.int64)
        n[drop] = 0
    else:
        n = np.zeros(0, np.int64)
    ends = np.cumsum(n)
    total = int(ends[-1]) if len(ends) else 0
    source = np.repeat(start[points].astype(np.int64) - (ends - n), n) + np.arange(total)
    row = np.repeat(codepoints.rows_of(offsets), n)
    out, row = _compose(pool[source], row)
    return out, np.searchsorted(row, np.arange(len(offsets)))


def canonical_array(column: pa.Array) -> pa.Array:
    """The form of each text; null stays null."""
    out = []
    for _, piece in codepoints.pieces(column):
        points, offsets, _ = codepoints.decode(piece)
        out.append(codepoints.encode(*canonical_points(points, offsets), codepoints.is_null(piece)))
    return pa.concat_arrays(out) if out else pa.array([], pa.string())


def with_form(frame: DataFrame, text: str = "text", into: str = "form") -> DataFrame:
    """Add ``into``, the consistent form of ``text``; null stays null, empty stays empty, other columns stay as they are."""
    schema = T.StructType([*[x for x in frame.schema.fields if x.name != into], T.StructField(into, T.StringType())])
    names = [x for x in frame.columns if x != into]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*[b.column(x) for x in names], canonical_array(b.column(text))], names=[*names, into])

    return frame.mapInArrow(run, schema)


def alike_pairs(frame: DataFrame) -> DataFrame:
    """``(tab, row_a, row_b)``: rows of one group whose fields differ but have the same form.

    ``frame`` has ``tab, row, place, field``; rows with a null ``place`` or a null or empty field are no case; repeated
    rows count once. Only hashes are written and shuffled. Rows of one place, form and field are one class. Classes of
    one form pair up first, and only those that have a partner are joined with their rows, so no group is gathered in
    one task, however many copies it has.
    """
    hashed = materialise(
        with_form(frame.where("place is not null and field is not null and field <> ''").select("tab", "row", "place", "field"), "field")
        .select("tab", "row", "place", F.xxhash64("form").alias("k"), F.hash("form").alias("k2"), F.xxhash64("field").alias("f"), F.hash("field").alias("f2"))
        .distinct(),
        "forms",
    )
    form = ["tab", "place", "k", "k2"]
    classes = hashed.select(*form, F.struct("f", "f2").alias("c")).distinct()
    several = classes.join(classes.groupBy(*form).count().where("count > 1").drop("count"), form, "left_semi")
    pairs = several.withColumnRenamed("c", "a").join(several.withColumnRenamed("c", "b"), form).where("a < b")
    rows = hashed.select(*form, F.struct("f", "f2").alias("c"), "row")
    both = pairs.join(rows.withColumnRenamed("c", "a").withColumnRenamed("row", "x"), [*form, "a"]).join(rows.withColumnRenamed("c", "b").withColumnRenamed("row", "y"), [*form, "b"])
    return both.select("tab", F.least("x", "y").alias("row_a"), F.greatest("x", "y").alias("row_b")).distinct()

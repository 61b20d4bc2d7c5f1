"""Text that was decoded with the wrong character encoding (problem 5).

Method. (1) Frequencies of all characters of the corpus are counted. (2) In all records, spans that some pair of
encodings (written in one, read in another) could have garbled are looked for; the records with such spans are joined
with near-twins, records of the same place whose text is equal once all non-ASCII characters are left out, and the
differing parts of garbled and clean twin are aligned and say which pairs map one to the other. Spans that become
clearly more frequent text give the same evidence where a pair has no twin. (3) The learned pairs are undone in the
records of (2): a span counts as garbled if its bytes are well-formed in the encoding it was written in and
make clearly more frequent text, and it is replaced by that, again while anything is found, for text garbled twice.
Replacement characters and C1 controls mark text that cannot be recovered.

Spans are found over whole batches of code points: per pair a few gathers give bytes or mapped characters and running
sums say where they are well-formed or gain. A record that some learned pair garbled has spans of a possible pair, so
the records written in (2) are all that (3) has to read. Only the character table (bounded by the number of code points)
and the list of pairs are broadcast.
"""

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm import codepoints
from inkmill.sources.tables import materialise

#: Encodings a text may have been written in, and those it may have been read in.
WRITTEN = ["utf-8", "gb18030", "big5", "shift_jis", "euc_jp", "euc_kr", "cp1251", "koi8_r", "cp1252", "cp1256", "cp874"]
READ = ["cp1252", "latin_1", "cp1251", "koi8_r", "mac_roman", "gb18030", "big5", "shift_jis", "euc_jp", "euc_kr", "cp1250", "cp437", "cp850", "cp866"]
#: One-byte encodings whose letters are Latin: text of another one-byte encoding read in these shows.
LATIN = ["cp1252", "latin_1", "mac_roman", "cp437", "cp850"]
#: Encodings of one script: text of one read in the other.
CYRILLIC = ["cp1251", "koi8_r"]
#: Gain of log frequency, in sum and mean a character, from which a mapped span of two-byte characters counts.
GAIN_SUM, GAIN_MEAN = 10.0, 1.5
#: The same, mean, for spans whose form already speaks for the pair.
GAIN_FORM = 0.5
#: Share (log) from which a character is known to the corpus.
KNOWN = -12.5
#: Different spans of three characters (longer ones count twice) that a pair must explain to be learned.
MIN_SUPPORT = 3
ROUNDS = 3
_LOST = "�"


@lru_cache(64)
def _single(codec: str) -> tuple[dict[str, int], list[str]] | None:
    """Byte of each character and character of each byte of a one-byte encoding; undefined bytes are the C1 controls."""
    if codec not in ("cp1252", "latin_1", "cp1251", "koi8_r", "mac_roman", "cp1250", "cp437", "cp850", "cp866", "cp874", "cp1256"):
        return None
    chars = []
    for b in range(256):
        try:
            chars.append(bytes([b]).decode(codec))
        except UnicodeDecodeError:
            chars.append(chr(b))
    return {c: b for b, c in reversed(list(enumerate(chars)))}, chars


def to_bytes(text: str, codec: str) -> tuple[bytes, int]:
    """The bytes that were read as ``text`` by ``codec``, and how many characters it has no bytes for (left out)."""
    table = _single(codec)
    if table is None:
        try:
            return text.encode(codec), 0
        except UnicodeEncodeError:
            pass
        out, lost = [], 0
        for c in text:
            try:
                out.append(c.encode(codec))
            except UnicodeEncodeError:
                lost += 1
        return b"".join(out), lost
    got = [table[0].get(c) for c in text]
    return bytes(b for b in got if b is not None), got.count(None)


def misread(text: str, written: str, read: str) -> str | None:
    """``text`` written in one encoding and read in another; None where it cannot be written."""
    try:
        raw = text.encode(written)
    except UnicodeEncodeError:
        return None
    table = _single(read)
    return "".join(table[1][b] for b in raw) if table else raw.decode(read, "replace")


def undo(text: str, written: str, read: str) -> tuple[str, int]:
    """What ``text`` was before it was misread, and the number of its places that cannot be read back."""
    raw, lost = to_bytes(text, read)
    out = raw.decode(written, "replace")
    if written == "utf-8" and _LOST in out and b"\xef\xbf\xbd" in raw:
        lost -= raw.count(b"\xef\xbf\xbd")
    return out, lost + out.count(_LOST)


def differing(a: str, b: str) -> tuple[str, str]:
    """``a`` and ``b`` without their common beginning and end."""
    n = min(len(a), len(b))
    i = next((k for k in range(n) if a[k] != b[k]), n)
    j = next((k for k in range(n - i) if a[-1 - k] != b[-1 - k]), n - i)
    return a[i : len(a) - j], b[i : len(b) - j]


def explain(garbled: str, clean: str) -> list[tuple[str, str]]:
    """Transformations (written, read) that turn ``clean`` into ``garbled``, places apart that were lost."""
    found = []
    for g, c in zip(*(x.split("\n") for x in (garbled, clean))):
        if g == c:
            continue
        g, c = differing(g.rstrip("\r"), c.rstrip("\r"))
        if len(c) < 2 or c.isascii() or g.isascii():
            continue
        for written in WRITTEN:
            for read in READ:
                if written == read or (d := misread(c, written, read)) is None or d == c:
                    continue
                if d.replace(_LOST, "") == g.replace(_LOST, "") != "":
                    found.append((written, read))
        if found:
            break
    return found


@lru_cache(64)
def _bytes_table(codec: str) -> tuple[np.ndarray, np.ndarray]:
    """First and second byte of every character of the basic plane (0 where there is none)."""
    first, second = np.zeros(0x10000, np.uint8), np.zeros(0x10000, np.uint8)
    table = _single(codec)
    if table:
        for c, b in table[0].items():
            first[ord(c)] = b
        return first, second
    for lead in range(0x81, 0xFF):
        for trail in range(0x40, 0xFF):
            try:
                c = bytes([lead, trail]).decode(codec)
            except UnicodeDecodeError:
                continue
            if len(c) == 1 and ord(c) < 0x10000 and not first[ord(c)]:
                first[ord(c)], second[ord(c)] = lead, trail
    return first, second


@lru_cache(64)
def _by_bytes(written: str) -> np.ndarray:
    """Character of each pair of bytes in a two-byte encoding (0 where none)."""
    first, second = _bytes_table(written)
    out = np.zeros(0x10000, np.uint16)
    have = np.flatnonzero(second)
    out[(first[have].astype(np.int64) << 8) | second[have]] = have
    return out


@lru_cache(64)
def _mapped(written: str, read: str) -> np.ndarray:
    """What each character of ``read`` is in ``written``, both of one or both of two bytes (0 where nothing)."""
    first, second = _bytes_table(read)
    if _single(read):
        chars = _single(written)[1]
        out = np.array([ord(chars[b]) for b in first], np.uint16)
        out[first < 0x80] = 0
        return out
    out = _by_bytes(written)[(first.astype(np.int64) << 8) | second]
    out[second == 0] = 0
    return out


def _spans(hit: np.ndarray, row: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the groups of positions, of one row, at most ``gap`` apart."""
    if not len(hit):
        return hit, hit
    cut = np.flatnonzero((np.diff(hit) > gap) | (row[hit[1:]] != row[hit[:-1]]))
    return hit[np.concatenate([[0], cut + 1])], hit[np.concatenate([cut, [len(hit) - 1]])] + 1


def _passages(hit: np.ndarray, row: np.ndarray, line: np.ndarray, gap: int) -> tuple[np.ndarray, np.ndarray]:
    """The spans within lines and those that go over several lines of a row."""
    a, b = _spans(hit, line, gap)
    if not len(a):
        return a, b
    c, d = _spans(hit, row, gap)
    over = line[c] != line[d - 1]
    return np.concatenate([a, c[over]]), np.concatenate([b, d[over]])


def _utf8_cover(data: np.ndarray, row: np.ndarray, log_share: np.ndarray) -> np.ndarray:
    """True for the bytes of well-formed UTF-8 sequences, within a row, of characters the corpus has."""
    n = len(data)
    cover = np.zeros(n, bool)
    cont = (data & 0xC0) == 0x80
    for size, low, high in ((2, 0xC2, 0xDF), (3, 0xE0, 0xEF), (4, 0xF0, 0xF4)):
        at = np.flatnonzero((data >= low) & (data <= high))
        at = at[at + size <= n]
        ok = row[at] == row[at + size - 1]
        for k in range(1, size):
            ok &= cont[at + k]
        at = at[ok]
        point = data[at].astype(np.int64) & (0x7F >> size)
        for k in range(1, size):
            point = (point << 6) | (data[at + k] & 0x3F)
        point = np.minimum(point, 0x10FFFF)
        at = at[(log_share[point] > KNOWN) | (point == 0xFFFD) | (point < 0x100)]
        for k in range(size):
            cover[at + k] = True
    return cover


class Repairer:
    """Finds spans that learned pairs garbled and undoes them, judged by the log frequency of characters."""

    def __init__(self, log_share: np.ndarray, pairs: list[tuple[str, str]]):
        self.log_share = log_share
        self.pairs = pairs
        self._gains: dict[tuple[str, str], np.ndarray] = {}

    def gains(self, written: str, read: str) -> np.ndarray:
        """Per character of ``read``, what its log share gains as that of ``written``, both of one or both of two bytes."""
        if (written, read) not in self._gains:
            to = _mapped(written, read)
            self._gains[written, read] = np.where(to > 0, self.log_share[to] - self.log_share[: len(to)], np.float32(0))
        return self._gains[written, read]

    def score(self, text: str) -> float:
        """Mean log share of the non-ASCII characters; that of plain ASCII is high."""
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        points = points[points > 127]
        return float(np.add.reduce(self.log_share[points]) / len(points)) if len(points) else -3.0

    def candidates(self, points: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[tuple[str, str], np.ndarray, np.ndarray]]:
        """Per pair, the spans (start, end) that it may have garbled, of single lines and of passages of several."""
        n = len(points)
        row = codepoints.rows_of(offsets).astype(np.int32)
        line = row + np.cumsum(points == 10, dtype=np.int32)
        basic = np.where(points < 0x10000, points, 0).astype(np.uint16)
        high = np.flatnonzero(points > 127)
        if not len(high):
            return
        basic, at_row, own = basic[high], row[high], self.log_share[points[high]]
        for written, read in self.pairs:
            first, second = _bytes_table(read)
            if _single(read) and written == "utf-8":
                data = first[basic]
                at = np.flatnonzero(data >= 0x80)
                if not len(at):
                    continue
                group = np.cumsum(np.concatenate([[True], (np.diff(high[at]) != 1) | (at_row[at][1:] != at_row[at][:-1])]))
                cover = _utf8_cover(data[at], group, self.log_share)
                yield (written, read), *_passages(high[at[cover]], row, line, 4)
            elif _single(read) and not _single(written):
                # Two characters make one; they pair up from the start of a run of high bytes.
                data = first[basic]
                at = np.flatnonzero(data >= 0xA0 if written != "shift_jis" else data >= 0x80)
                if len(at) < 4:
                    continue
                new = np.concatenate([[True], (np.diff(high[at]) != 1) | (at_row[at][1:] != at_row[at][:-1])])
                begin = np.maximum.accumulate(np.where(new, np.arange(len(at)), 0))
                lead = np.flatnonzero((np.arange(len(at)) - begin) % 2 == 0)
                lead = lead[lead + 1 < len(at)]
                lead = lead[~new[lead + 1]]
                code = _by_bytes(written)[(data[at[lead]].astype(np.int64) << 8) | data[at[lead + 1]]]
                gain = np.where(code > 0, 2 * self.log_share[code] - own[at[lead]] - own[at[lead + 1]], -4.0)
                known = (code > 0) & (self.log_share[code] > KNOWN)
                pos = high[at[lead]]
                a, b = _passages(np.sort(np.concatenate([pos[known], pos[known] + 1])), row, line, 3)
                if len(a):
                    total = np.concatenate([[0], np.cumsum(gain)])
                    i, j = np.searchsorted(pos, a), np.searchsorted(pos, b)
                    good = (b - a >= 4) & (total[j] - total[i] > 0)
                    yield (written, read), a[good], b[good]
            elif written == "utf-8":
                x, y = first[basic], second[basic]
                two = y > 0
                if two.sum() < 1:
                    continue
                at = np.flatnonzero(two)
                data = np.empty(2 * len(at), np.uint8)
                data[0::2], data[1::2] = x[at], y[at]
                group = np.cumsum(np.concatenate([[True], (np.diff(high[at]) > 1)]) | np.concatenate([[True], at_row[at][1:] != at_row[at][:-1]]))
                cover = _utf8_cover(data, np.repeat(group, 2), self.log_share)
                full = cover[0::2] & cover[1::2]
                a, b = _passages(high[at[full]], row, line, 3)
                long = b - a >= 4
                yield (written, read), a[long], b[long]
                # An accented letter is one two-byte character, next to a plain letter.
                pair = np.flatnonzero((x >= 0xC3) & (x <= 0xC5) & two & (y >= 0x80) & (y <= 0xBF))
                pos = high[pair]
                before = np.where(pos > 0, points[np.maximum(pos - 1, 0)], 0)
                latin = ((before | 32) >= 97) & ((before | 32) <= 122) & (row[np.maximum(pos - 1, 0)] == row[pos]) & (pos > 0)
                yield (written, read), pos[latin], pos[latin] + 1
            elif bool(_single(written)) == bool(_single(read)):
                gain = self.gains(written, read)[basic]
                start = gain > 2
                # Groups of gaining characters, with at most two others between them.
                a, b = _passages(high[start], row, line, 3)
                if len(a):
                    total = np.concatenate([[0], np.cumsum(gain)])
                    i, j = np.searchsorted(high, a), np.searchsorted(high, b)
                    sums = total[j] - total[i]
                    good = (sums >= GAIN_SUM) & (sums >= GAIN_MEAN * (j - i))
                    a, b = a[good], b[good]
                    good = np.array([len(set(points[x:y].tolist())) > 2 for x, y in zip(a, b)], bool)
                    if read in CYRILLIC:  # capitals within words show it, as the two encodings swap the cases
                        good &= np.array([_SWAPPED.search(points[x:y].tobytes().decode("utf-32-le", "surrogatepass")) is not None for x, y in zip(a, b)], bool)
                    yield (written, read), a[good], b[good]

    def verify(self, text: str, pair: tuple[str, str]) -> tuple[str, float] | None:
        """The span before it was misread, and what that gains; None if it is no such text."""
        written, read = pair
        out, lost = undo(text, written, read)
        seen = [c for c in out if c > "\x7f" and c != _LOST]
        if out == text or _odd(out):
            return None
        if not seen:
            return (out, 20.0) if _LOST in out and written == "utf-8" and lost <= 2 + len(text) // 3 else None
        single = _single(read) is not None
        if written == "utf-8" and single:
            # Well-formed UTF-8 among one-byte characters hardly comes by chance.
            if lost > len(out) // 8:
                return None
            gain = self.score("".join(seen)) - self.score(text)
            return (out, gain + 3) if gain > -1.5 or len(seen) > 3 else None
        if lost > 1 + len(out) // 4 or (single and len(set(seen)) < 3):
            return None
        gain = self.score("".join(seen)) - self.score(text)
        known = sum(self.log_share[ord(c)] > KNOWN for c in seen) / len(seen)
        need = GAIN_FORM if single and not _single(written) or written == "utf-8" else GAIN_MEAN
        return (out, gain) if known > 0.8 and gain >= need else None

    def lines_of(self, points: np.ndarray, x: int, y: int, pair: tuple[str, str]) -> list[tuple[float, int, int, str]]:
        """(gain, start, end, restored) of the lines of a garbled passage, some of which may be too short to show by themselves."""
        whole = self.verify(points[x:y].tobytes().decode("utf-32-le", "surrogatepass"), pair)
        out = []
        if whole:
            ends = [x - 1, *(x + np.flatnonzero(points[x:y] == 10)).tolist(), y]
            for i, j in ((p + 1, q) for p, q in zip(ends, ends[1:])):
                part = points[i:j].tobytes().decode("utf-32-le", "surrogatepass").rstrip("\r")
                fixed, lost = undo(part, *pair)
                if part and fixed != part and not lost and not _odd(fixed):
                    out.append((whole[1], i, i + len(part), fixed))
        return out

    def find(self, points: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, str, tuple[str, str]]]:
        """(row, start, end, restored, pair) of the garbled spans of a batch, the best where they overlap, in order."""
        raw: list[tuple[float, int, int, int, str, tuple[str, str]]] = []
        for pair, a, b in self.candidates(points, offsets):
            if not len(a):
                continue
            rows = np.searchsorted(offsets, a, "right") - 1
            alone: dict[int, list[tuple[int, int]]] = {}  # the pair's spans that show by themselves
            for r, x, y in zip(rows.tolist(), a.tolist(), b.tolist()):
                if 10 in points[x:y]:
                    raw += [(gain * (j - i), r, i, j, fixed, pair) for gain, i, j, fixed in self.lines_of(points, x, y, pair) if all(j <= p or i >= q for p, q in alone.get(r, ()))]
                    continue
                low, high = int(offsets[r]), int(offsets[r + 1])
                best = None
                edges = ((x, y),) if _single(pair[1]) and pair[0] == "utf-8" else ((x, y), (x - 1, y), (x, y + 1), (x - 1, y + 1), (x + 1, y))
                for i, j in edges:
                    if i < low or j > high or j <= i or 10 in points[i:j]:
                        continue
                    got = self.verify(points[i:j].tobytes().decode("utf-32-le", "surrogatepass"), pair)
                    if got:
                        value = got[1] - 0.5 * got[0].count(_LOST)
                        if best is None or value > best[0]:
                            best = (value, r, i, j, got[0], pair)
                if best:
                    alone.setdefault(r, []).append(best[2:4])
                    raw.append((best[0] * (best[3] - best[2]), *best[1:]))
        raw.sort(key=lambda x: -x[0])
        taken, spans = {}, []
        for _, r, i, j, fixed, pair in raw:
            if all(j <= p or i >= q for p, q in taken.get(r, ())):
                taken.setdefault(r, []).append((i, j))
                spans.append((r, i - int(offsets[r]), j - int(offsets[r]), fixed, pair))
        return sorted(spans, key=lambda x: x[:2])

    def repair(self, texts: list[str], spans: list[list[tuple[int, int, int, str, tuple[str, str]]]]) -> list[str]:
        """``texts`` with their spans restored, then whatever is garbled in the results; the texts of a round are searched at once."""
        texts, left = list(texts), {k: x for k, x in enumerate(spans) if x}
        for _ in range(ROUNDS):
            if not left:
                break
            for k, own in left.items():
                out, done = [], 0
                for _, i, j, fixed, _ in own:
                    out += [texts[k][done:i], fixed]
                    done = j
                texts[k] = "".join([*out, texts[k][done:]])
            at = list(left)
            points, offsets, _ = codepoints.decode(pa.array([texts[k] for k in at], pa.string()))
            left = {}
            for x in self.find(points, offsets):
                left.setdefault(at[x[0]], []).append(x)
        return texts


def _within(sizes: np.ndarray) -> np.ndarray:
    """0, 1, .. size - 1 for each size."""
    return np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)


def _odd(text: str) -> bool:
    """Whether ``text`` has control or private characters, which no restored text has."""
    return _ODD.search(text) is not None


_ODD = re.compile("[\x00-\x08\x0b\x0c\x0e-\x1f\x80-\x9f\ue000-\uf8ff]")
_SWAPPED = re.compile("[а-яё][А-ЯЁ]{2}")
_MARKS = re.compile("(?m)(?:^|(?<=\\s))\\?{3,}(?=\\s|\\d|$)|[\ufffd\x80-\x84\x86-\x9f]|锟斤拷|ï¿½")


def possible_pairs() -> list[tuple[str, str]]:
    """Pairs that are looked for: not one-byte text read in two bytes, and one-byte text only where it shows."""
    one = lambda w, r: (r in LATIN and w not in LATIN) or (w in CYRILLIC and r in CYRILLIC)
    return [(w, r) for w in WRITTEN for r in READ if w != r and (not _single(w) or (_single(r) and one(w, r)))]


def character_counts(records: DataFrame) -> DataFrame:
    """``(point, n)`` of every code point of ``text``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(0x110000, np.int64)
        for b in batches:
            for _, piece in codepoints.pieces(b.column("text")):
                got = np.bincount(codepoints.decode(piece)[0])
                total[: len(got)] += got
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], names=["point", "n"])

    return records.select("text").mapInArrow(run, "point bigint, n bigint").groupBy("point").agg(F.sum("n").alias("n"))


def log_shares(counts: DataFrame) -> np.ndarray:
    """Log share of every code point among the non-ASCII ones; its size is bounded by the number of code points."""
    got = counts.toArrow()
    point, n = got.column("point").to_numpy(), got.column("n").to_numpy()
    share = np.full(0x110000, 0.5)
    share[point] += n
    return np.log(share / max(1, n[point > 127].sum() if len(n) else 1)).astype(np.float32)


def _spans_of(batches: Iterator[pa.RecordBatch], fixer: Repairer) -> Iterator[tuple[pa.RecordBatch, dict[int, list]]]:
    """Pieces of the batches with the garbled spans of their rows."""
    for b in batches:
        for at, piece in codepoints.pieces(b.column("text")):
            points, offsets, _ = codepoints.decode(piece)
            found: dict[int, list] = {}
            for x in fixer.find(points, offsets):
                found.setdefault(x[0], []).append(x)
            lost = (points == 0xFFFD) | ((points >= 0x80) & (points < 0xA0) & (points != 0x85))
            lost[:-2] |= (points[:-2] == 63) & (points[1:-1] == 63) & (points[2:] == 63)  # looked at more closely by _MARKS
            lost = np.flatnonzero(lost)
            for r in np.unique(np.searchsorted(offsets, lost, "right") - 1).tolist():
                if r not in found and _MARKS.search(piece[r].as_py()):
                    found[r] = []
            yield b.slice(at, len(piece)), found


def _evidence(text: str, spans: list) -> list[dict[str, str]]:
    """The pair that explains most of a record's garbled text, with its spans of three characters and more."""
    length: dict[tuple[str, str], int] = {}
    for _, i, j, _, pair in spans:
        length[pair] = length.get(pair, 0) + j - i
    if not length:
        return []
    main = max(sorted(length), key=lambda p: length[p])
    return [{"pair": "|".join(main), "span": text[i:j]} for _, i, j, _, pair in spans if pair == main and j - i >= 3]


def suspects(records: DataFrame, log_share: np.ndarray) -> DataFrame:
    """``(tab, row, place, text, own)``: all records with spans of any possible pair, or with lost characters, and their evidence."""
    sent = records.sparkSession.sparkContext.broadcast((log_share, possible_pairs()))

    def spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer = Repairer(*sent.value)
        for b, found in _spans_of(batches, fixer):
            rows = sorted(found)
            own = [_evidence(t, found[i]) for i, t in zip(rows, b.column("text").take(pa.array(rows, pa.int64())).to_pylist())]
            yield pa.RecordBatch.from_arrays([*[b.column(c).take(pa.array(rows, pa.int64())) for c in ("tab", "row", "place", "text")], pa.array(own, pa.list_(pa.struct([("pair", pa.string()), ("span", pa.string())])))], names=["tab", "row", "place", "text", "own"])

    return materialise(records.mapInArrow(spans, "tab string, row bigint, place bigint, text string, own array<struct<pair: string, span: string>>"), "garbled-suspects")


def learn(records: DataFrame, garbled: DataFrame, min_support: int = MIN_SUPPORT) -> list[tuple[str, str]]:
    """Pairs of encodings with enough support, from twins and from spans that explain themselves; ``garbled`` are the suspects of ``records``."""
    bare = F.xxhash64(F.regexp_replace("text", r"[^\x21-\x7e]", "")).alias("bare")
    keys = garbled.where("place is not null").select("tab", "row", "place", bare, F.col("text").alias("garbled"))
    # The keys grow with the input, so the planner chooses the joins by their size.
    near = records.where("place is not null").select("tab", "row", "place", bare, "text").join(keys.select("place", "bare").distinct(), ["place", "bare"], "left_semi")
    clean = near.join(keys.select("tab", "row"), ["tab", "row"], "left_anti").groupBy("place", "bare").agg(F.min("text").alias("clean"))
    twins = keys.join(clean, ["place", "bare"]).select("garbled", "clean")

    def aligned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [(f"{w}|{r}", g) for g, c in zip(b.column("garbled").to_pylist(), b.column("clean").to_pylist()) for w, r in explain(g, c)]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found], pa.string()) for k in (0, 1)], names=["pair", "span"])

    evidence = twins.mapInArrow(aligned, "pair string, span string").unionAll(garbled.select(F.explode("own").alias("x")).select("x.pair", "x.span")).distinct()
    support = evidence.groupBy("pair").agg(F.sum(F.when(F.length("span") > 3, 2).otherwise(1)).alias("n")).where(F.col("n") >= min_support)
    return [tuple(r.pair.split("|")) for r in sorted(support.collect(), key=lambda r: (-r.n, r.pair))]


def garbled(records: DataFrame, min_support: int = MIN_SUPPORT) -> DataFrame:
    """``(tab, row, text, spans, whole)``: records with wrongly decoded characters, their restored text, how many spans
    were restored at first and whether nothing is left that cannot be.

    ``records`` has ``tab, row, place, text``; ``place`` (BIGINT) says which records may be versions of one text and
    may be null; other columns are ignored. Null and empty texts are no case; repeated rows come out again; an empty
    table gives an empty result.
    """
    records = records.where("text is not null and text <> ''").select("tab", "row", "place", "text")
    log_share = log_shares(character_counts(records))
    found = suspects(records, log_share)
    sent = records.sparkSession.sparkContext.broadcast((log_share, learn(records, found, min_support)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fixer = Repairer(*sent.value)
        for b, found in _spans_of(batches, fixer):
            rows = sorted(found)
            texts = fixer.repair(b.column("text").take(pa.array(rows, pa.int64())).to_pylist(), [found[i] for i in rows])
            yield pa.RecordBatch.from_arrays(
                [b.column("tab").take(pa.array(rows, pa.int64())), b.column("row").take(pa.array(rows, pa.int64())), pa.array(texts, pa.string()), pa.array([len(found[i]) for i in rows], pa.int32()), pa.array([not _MARKS.search(t) for t in texts], pa.bool_())],
                names=["tab", "row", "text", "spans", "whole"],
            )

    return found.select("tab", "row", "text").mapInArrow(run, "tab string, row bigint, text string, spans int, whole boolean")

"""Personal information inside free text (problem 8).

Method: a character-level bidirectional LSTM with CRF transitions, trained in numpy from labelled spans. Lines longer
than ``WINDOW`` are cut into overlapping windows; every window is decoded on its own and the spans are reconciled over
the whole text: of overlapping spans that differ, the one further from an edge of its window stays, and spans that a
cut may have shortened fall out for those that lie whole in the next window. An exact check of the form follows for
mail addresses, phone and identity numbers, whose ends are well-defined.

The labelled spans are sentences with drawn values (see ``pii_labels``), mixed with lines of the corpus as text without
personal data: about ``SAMPLE_LINES`` of all lines of all documents, picked by a hash, less those with words or forms
that go with values. Training takes ``EXAMPLES`` examples on the driver, and its result is kept in the shared folder
under a hash of what it was trained on; tagging covers every character of every text inside Spark tasks.
"""

import hashlib
import pickle
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from inkmill.llm import codepoints, pii_labels
from inkmill.llm.blas import one_thread
from inkmill.llm.pii_labels import KINDS, examples
from inkmill.llm.tagger import Tagger, best_paths, emissions, new_tagger, train, undecided
from inkmill.sources.tables import shared_folder

#: Lines of the corpus that training may see, and characters of one (a longer one gives a stretch of it, placed by a hash).
SAMPLE_LINES, LINE_LENGTH = 12_000, 400
EXAMPLES = 20_000
EPOCHS = 8
BATCH = 96
RATE = 0.009
#: Characters of a window, and how many two neighbours share; longer than any value with its surroundings.
WINDOW, OVERLAP = 192, 56
#: Longest labelled line.
EXAMPLE_LENGTH = 120
#: A character is a vocabulary entry of its own from this many occurrences in the examples on.
MIN_COUNT = 4
#: Share of characters that stand for their class in training, so that unseen ones are met.
DROP = 0.15
PIECE = 1 << 19
#: Digits count as one of these private code points, by how many stand in a row.
RUNS, LONGEST_RUN = 0xF0000, 20
TAGS = 1 + 2 * len(KINDS)
_CLASSES = ["pad", "newline", "space", "digit", "lower", "upper", "cyrillic lower", "cyrillic upper", "greek", "han", "hiragana", "katakana", "hangul", "thai", "letter", "mark", "dash", "open", "close", "quote", "dot", "symbol", "other"]


def _class_of(c: int) -> int:
    ch = chr(c)
    kind = unicodedata.category(ch)
    name = lambda x: _CLASSES.index(x)
    if kind == "Nd":
        return name("digit")
    if kind[0] == "Z" or c == 9:
        return name("space")
    if c in (10, 13):
        return name("newline")
    if kind[0] == "L":
        if 0x3040 <= c < 0x30A0:
            return name("hiragana")
        if 0x30A0 <= c < 0x3100 or 0xFF66 <= c < 0xFFA0:
            return name("katakana")
        if 0x2E80 <= c < 0xA000 or 0xF900 <= c < 0xFB00 or c >= 0x20000:
            return name("han")
        if 0xAC00 <= c < 0xD7B0:
            return name("hangul")
        if 0x0E00 <= c < 0x0E80:
            return name("thai")
        if 0x0400 <= c < 0x0530:
            return name("cyrillic upper" if kind == "Lu" else "cyrillic lower")
        if 0x0370 <= c < 0x0400:
            return name("greek")
        if c < 0x250 or 0x1E00 <= c < 0x1F00:
            return name("upper" if kind == "Lu" else "lower")
        return name("letter")
    return name({"Mn": "mark", "Mc": "mark", "Pd": "dash", "Ps": "open", "Pe": "close", "Pi": "quote", "Pf": "quote", "Po": "dot", "Sm": "symbol", "So": "symbol", "Sc": "symbol", "Sk": "symbol"}.get(kind, "other"))


@lru_cache(1)
def _folded() -> tuple[np.ndarray, np.ndarray]:
    """Class of every code point, and the code point it counts as (wide ASCII forms as ASCII, digits as 0)."""
    kind = np.full(0x110000, _CLASSES.index("other"), np.int32)
    for a, b, c in ((0x3400, 0xA000, "han"), (0xAC00, 0xD7A4, "hangul"), (0x20000, 0x323B0, "han")):
        kind[a:b] = _CLASSES.index(c)
    for a, b in ((0, 0x3400), (0x4DC0, 0x4E00), (0xA000, 0xAC00), (0xF900, 0x1F000)):
        kind[a:b] = [_class_of(c) for c in range(a, b)]
    point = np.arange(0x110000, dtype=np.uint32)
    point[0xFF01:0xFF5F] -= 0xFEE0
    point[0x3000] = 32
    kind[0xFF01:0xFF5F] = kind[0x21:0x7F]
    point[kind == _CLASSES.index("digit")] = 48
    kind[RUNS : RUNS + LONGEST_RUN + 1] = _CLASSES.index("digit")
    return kind, point


def read(points: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """What the tagger reads of a batch of code points: wide forms as plain ones, digits by the length of their run."""
    out = _folded()[1][points]
    digit = out == 48
    at = np.flatnonzero(digit)
    if len(at):
        starts = np.zeros(len(points) + 1, bool)
        starts[offsets] = True
        new = np.concatenate([[True], np.diff(at) != 1]) | starts[at]
        run = np.cumsum(new) - 1
        out[at] = RUNS + np.minimum(np.bincount(run)[run], LONGEST_RUN)
    return out


def fit(corpus_lines: list[str], n: int = EXAMPLES, epochs: int = EPOCHS, seed: int = 5) -> Tagger:
    """Train a tagger on ``n`` labelled lines, some of them from the corpus."""
    rng = np.random.default_rng(seed)
    labelled = [(t.replace("\n", " ")[:EXAMPLE_LENGTH], [x for x in s if x[1] <= EXAMPLE_LENGTH]) for t, s in examples(n, corpus_lines, seed) if t]
    kind = _folded()[0]
    texts = [read(np.frombuffer(t.encode("utf-32-le", "surrogatepass"), np.uint32), np.zeros(1, np.int64)) for t, _ in labelled]
    seen, count = np.unique(np.concatenate(texts), return_counts=True)
    own = seen[count >= MIN_COUNT]
    vocabulary = kind.copy()
    vocabulary[own] = len(_CLASSES) + np.arange(len(own))
    vocabulary = vocabulary.astype(np.int32)
    model = new_tagger(vocabulary, len(_CLASSES) + len(own), TAGS, rng)
    size = np.array([len(t) for t in texts])

    def batches(epoch: int):
        order = np.argsort(size + rng.random(len(size)) * 12)
        groups = [order[i : i + BATCH] for i in range(0, len(order), BATCH)]
        for g in rng.permutation(len(groups)):
            pick = groups[g]
            width = int(size[pick].max())
            ids, tags, mask = np.zeros((len(pick), width), np.int64), np.zeros((len(pick), width), np.int64), np.zeros((len(pick), width), bool)
            for r, i in enumerate(pick):
                x = texts[i]
                ids[r, : len(x)] = np.where(rng.random(len(x)) < DROP, kind[x], vocabulary[x])
                mask[r, : len(x)] = True
                for a, b, k in labelled[i][1]:
                    tags[r, a:b] = 2 + 2 * k
                    if a < width:
                        tags[r, a] = 1 + 2 * k
                tags[r, len(x) :] = 0
            yield ids, tags, mask

    with one_thread():
        train(model, batches, epochs, RATE)
    return model


def windows(points: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(row, start, size, cut) of the windows: lines, or overlapping parts of long ones. Bits of ``cut``: left, right."""
    breaks = np.flatnonzero((points == 10) | (points == 13))
    edges = np.unique(np.concatenate([offsets, breaks, breaks + 1]))
    a, b = edges[:-1], edges[1:]
    keep = (b > a) & ~((b - a == 1) & ((points[np.minimum(a, max(len(points) - 1, 0))] == 10) | (points[np.minimum(a, max(len(points) - 1, 0))] == 13)))
    a, b = a[keep], b[keep]
    step = WINDOW - OVERLAP
    parts = np.maximum(1, -(-(b - a - OVERLAP) // step))
    nth = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
    start = np.repeat(a, parts) + nth * step
    end = np.minimum(start + WINDOW, np.repeat(b, parts))
    cut = (nth > 0).astype(np.int8) + 2 * (nth < np.repeat(parts, parts) - 1).astype(np.int8)
    return np.searchsorted(offsets, start, "right") - 1, start, end - start, cut


def tagged(model: Tagger, points: np.ndarray, offsets: np.ndarray) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) of the reconciled spans; positions count from the start of the batch."""
    row, start, size, cut = windows(points, offsets)
    if not len(start):
        return []
    emit = emissions(model, read(points, offsets), start, size)
    begin = np.cumsum(size) - size
    window = np.repeat(np.arange(len(size)), size)
    unsure = undecided(model, emit, begin, size)
    if not len(unsure):
        return []
    # Stretches of characters that may be inside a value; around them the tag is known.
    new = np.concatenate([[True], (np.diff(unsure) != 1) | (window[unsure[1:]] != window[unsure[:-1]])])
    low = unsure[new]
    high = unsure[np.concatenate([new[1:], [True]])] + 1
    own = window[low]
    paths = best_paths(model, emit, low, high - low, low == begin[own], high == begin[own] + size[own])
    found = []
    for w in np.unique(window[np.flatnonzero(paths)]).tolist():
        path = paths[begin[w] : begin[w] + size[w]].tolist()
        i, n = 0, len(path)
        while i < n:
            if not path[i]:
                i += 1
                continue
            k, j = (path[i] - 1) // 2, i + 1
            while j < n and path[j] == 2 + 2 * k:
                j += 1
            left, right = (i if cut[w] & 1 else n), (n - j if cut[w] & 2 else n)
            found.append((-min(left, right), int(row[w]), int(start[w]) + i, int(start[w]) + j, int(k)))
            i = j
    # Reconcile: spans furthest from a cut first; what overlaps a kept span goes.
    found.sort()
    kept: dict[int, list[tuple[int, int]]] = {}
    out = []
    for _, r, a, b, k in found:
        if all(b <= x or a >= y for x, y in kept.get(r, ())):
            kept.setdefault(r, []).append((a, b))
            out.append((r, a, b, k))
    return sorted(out)


_MAIL = re.compile(r"[A-Za-z0-9][\w.+-]*(?:\s?@\s?|\s?[\[(]at[\])]\s?)[A-Za-z0-9-]+(?:(?:\.|\s?[\[(]dot[\])]\s?)[A-Za-z0-9-]+)+", re.A)
_PHONE = re.compile(r"(?:\(?\+\d{1,3}\)?[ -]?)?(?:\(\d{2,4}\)[ -]?)?\d(?:[ ./-]?\d){5,}(?:\s?(?:转|ext\.?)\s?\d+)?|[〇零一二三四五六七八九]{7,}")
_NUMBER = re.compile(r"\d(?:[ -]?\d){6,}[Xx]?|\d(?:[ -]?\d){6,}[ -]?[\dXx]")
_FORMS = {KINDS.index("email"): _MAIL, KINDS.index("phone"): _PHONE, KINDS.index("id_number"): _NUMBER}
_TRIM = " \t　\xa0，。、；：！？,;:!?\"'“”‘’「」『』（）()《》<>—…"


def _plain(text: str) -> str:
    """Wide forms as plain ones and all digits as ASCII, character for character."""
    return "".join(chr(ord(c) - 0xFEE0) if "！" <= c <= "～" else " " if c == "　" else str(unicodedata.digit(c)) if c.isdecimal() and c > "9" else c for c in text)


def checked(line: str, a: int, b: int, kind: int) -> tuple[int, int] | None:
    """The exact span of a value in its line, None where the form is not one of its kind."""
    form = _FORMS.get(kind)
    if form is None:
        while a < b and line[a] in _TRIM:
            a += 1
        while b > a and line[b - 1] in _TRIM.replace(")", "") and not (line[b - 1] == "." and kind == KINDS.index("address")):
            b -= 1
        if kind == KINDS.index("address"):
            return (a, b) if b - a >= 4 and any(c.isdigit() for c in line[a:b]) else None
        return (a, b) if b - a >= 2 and any(c.isalpha() for c in line[a:b]) and not any(c.isdigit() for c in line[a:b]) else None
    best = None
    for m in form.finditer(_plain(line)):
        common = min(b, m.end()) - max(a, m.start())
        if common > 0 and 2 * common >= min(b - a, m.end() - m.start()) and (best is None or common > best[0]):
            best = (common, m.start(), m.end())
    return best[1:] if best else None


def found_spans(model: Tagger, column: pa.Array) -> list[tuple[int, int, int, int]]:
    """(row, start, end, kind) of the values of a column, positions counted in code points from the start of a text."""
    out = []
    for at, piece in codepoints.pieces(column, PIECE):
        points, offsets, _ = codepoints.decode(piece)
        with one_thread():
            spans = tagged(model, points, offsets)
        for r, a, b, k in spans:
            low, high = int(offsets[r]), int(offsets[r + 1])
            x, y = a, b
            while x > low and points[x - 1] not in (10, 13):
                x -= 1
            while y < high and points[y] not in (10, 13):
                y += 1
            span = checked(points[x:y].tobytes().decode("utf-32-le", "surrogatepass"), a - x, b - x, k)
            if span:
                item = (at + r, x + span[0] - low, x + span[1] - low, k)
                if not out or out[-1][0] != item[0] or item[1] >= out[-1][2]:
                    out.append(item)
    return out


def corpus_lines(documents: DataFrame, n: int = SAMPLE_LINES) -> list[str]:
    """About ``n`` lines (at most twice that) of all lines of the corpus, by a hash of document and line; only for training."""
    lines = F.split("text", r"[\r\n]+")
    texts = documents.where("text is not null and text <> ''")
    total = texts.select(F.sum(F.size(lines))).first()[0] or 0
    each = texts.select("doc", F.posexplode(lines).alias("nth", "line")).withColumn("h", F.xxhash64("doc", "nth", "line"))
    part = F.substring("line", (F.lit(1) + F.pmod(F.shiftrightunsigned("h", 20), F.greatest(F.length("line") - LINE_LENGTH, F.lit(1)))).cast("int"), F.lit(LINE_LENGTH))
    share = min(1.0, n / max(1, total))
    picked = each.where((F.pmod("h", F.lit(1_000_000)) < F.lit(int(share * 1_000_000))) & (F.trim("line") != "")).select("h", part.alias("line"))
    return [r.line for r in sorted(picked.limit(2 * n).collect(), key=lambda r: (r.h, r.line))]


def trained(documents: DataFrame) -> Tagger:
    """The tagger for a corpus, from the shared folder where one was trained on the same lines before."""
    spark = documents.sparkSession
    lines = corpus_lines(documents)
    with open(pii_labels.__file__, "rb") as f:
        made_of = repr([lines, EXAMPLES, EPOCHS, BATCH, DROP, MIN_COUNT, EXAMPLE_LENGTH]).encode("utf-8", "surrogatepass") + f.read()
    path = f"{shared_folder(spark).rstrip('/')}/tagger-{hashlib.sha256(made_of).hexdigest()[:32]}"
    try:
        return pickle.loads(spark.read.parquet(path).first()[0])
    except AnalysisException:
        model = fit(lines)
        spark.createDataFrame([(pickle.dumps(model),)], "model binary").coalesce(1).write.mode("overwrite").parquet(path)
        return model


def personal_data(documents: DataFrame, model: Tagger | None = None) -> DataFrame:
    """``(doc, start_pos, end_pos, kind)`` of every value.

    ``documents`` has ``doc, text``; other columns are ignored. Null and empty texts have none; repeated rows come out
    again; an empty table gives an empty result. Without a ``model`` one is trained.
    """
    model = model or trained(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            spans = found_spans(sent.value, b.column("text"))
            yield pa.RecordBatch.from_arrays(
                [b.column("doc").take(pa.array([x[0] for x in spans], pa.int64())), pa.array([x[1] for x in spans], pa.int32()), pa.array([x[2] for x in spans], pa.int32()), pa.array([KINDS[x[3]] for x in spans], pa.string())],
                names=["doc", "start_pos", "end_pos", "kind"],
            )

    return documents.where("text is not null and text <> ''").select("doc", "text").mapInArrow(run, f"doc {documents.schema['doc'].dataType.simpleString()}, start_pos int, end_pos int, kind string")


def masked(documents: DataFrame, model: Tagger | None = None) -> DataFrame:
    """``(doc, text, values)``: each text with ``<EMAIL>``, ``<PHONE>``, ``<ID_NUMBER>``, ``<ADDRESS>`` and ``<PERSON>`` for its values.

    Null stays null and empty stays empty, both without values; repeated rows come out again.
    """
    model = model or trained(documents)
    sent = documents.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column("text").to_pylist()
            spans: dict[int, list] = {}
            for x in found_spans(sent.value, b.column("text")):
                spans.setdefault(x[0], []).append(x)
            for i, xs in spans.items():
                done, parts = 0, []
                for _, a, z, k in xs:
                    parts += [texts[i][done:a], f"<{KINDS[k].upper()}>"]
                    done = z
                texts[i] = "".join([*parts, texts[i][done:]])
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(texts, pa.string()), pa.array([len(spans.get(i, ())) for i in range(len(texts))], pa.int32())], names=["doc", "text", "values"])

    return documents.select("doc", "text").mapInArrow(run, f"doc {documents.schema['doc'].dataType.simpleString()}, text string, values int")

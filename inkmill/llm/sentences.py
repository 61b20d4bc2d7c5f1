"""Sentences across languages and scripts (problem 2).

Method: sentence-break rules on character properties. A line end always ends a sentence. Within a line, a run of the
terminators of any script (property Sentence_Terminal, by which the marks are found) is a candidate; what is before
and after it decides: abbreviations and initials of the languages, numbers, list numbers, headings, versions and names
of files suppress a full stop; text inside matched quotation marks, brackets and title marks is never split; a closing
quotation mark right after a terminator ends the sentence too, unless the clause that reports the speech follows.

Every text is worked on in its own row inside ``mapInArrow`` batches, so the plan has no shuffle; only candidates of a
line are looked at one by one.
"""

import re
from bisect import bisect_right
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from inkmill.llm import codepoints
from inkmill.llm.canonical import LOOKALIKES

#: All code points of property Sentence_Terminal, and marks of lesser pauses that end sentences in their scripts.
MARKS = "".join(dict.fromkeys(regex.findall(r"\p{STerm}", "".join(chr(c) for a, b in ((0, 0xD800), (0xE000, 0x20000)) for c in range(a, b))) + list("፨᠃᠉꓿‼︒")))
#: Those that are full stops by look, which abbreviations and numbers have as well.
WEAK = ".．﹒․"
STRONG = "".join(c for c in MARKS if c not in WEAK)
# Opening and closing marks that belong together.
PAIRS = {"“": "”", "„": "“”", "«": "»", "‹": "›", "「": "」", "『": "』", "《": "》", "〈": "〉", "（": "）", "(": ")", "[": "]", "【": "】", "〔": "〕", "｢": "｣", "‘": "’", "〝": "〞〟", "{": "}", "［": "］"}
QUOTES = set("”“»›」』｣〞〟’\"＂")
# Abbreviations (without the point) that a name or number follows, so that they end no sentence.
TITLES = set(
    "mr mrs ms dr prof capt st sr sra srta jr gen col lt sgt rev hon mme mlle m mm mgr me vol pp p no nr nos fig ch sec ed eds op cf vs ca bzw vgl bd s str hr fr hrn frl z zt u d h g e i b art abs kap lic ing av avda núm ud uds ул пер пл пр просп г гг им д кв стр т тт с рис табл гл др проф св корп руб тыс млн р о оз стр п пп डॉ श्री प्रो".split()
)
# Abbreviations that only a number follows, and those of months, which a number or a year follows.
BEFORE_NUMBER = set("no nos fig sec art ch".split())
MONTHS = set("jan feb mar apr jun jul aug sep sept oct nov dec янв февр апр авг сент окт нояб дек ene abr ago dic janv févr avr juil déc okt dez".split())
# Words by which a line is English; there these abbreviations of other languages are words.
_ENGLISH = regex.compile(r"\b(?:the|and|of|was|with|that|he|she|they|we|you|his|her|is|are|come|not)\b", regex.I)
ENGLISH_WORDS = {"me", "art", "d", "h", "fr", "do"}

# Abbreviations that may close a sentence: over only if what follows begins one.
OPEN_END = set("etc a.m p.m am pm usw u.s.w z.b d.h i.e e.g lb oz kg inc ltd co corp bros dept approx ib ibid etw ggf evtl bspw dgl ff т.е т.д т.п т.к и.т.д p.ej ej".split())
_RUN = re.compile(f"[{re.escape(MARKS)}](?:[{re.escape(MARKS)}…])*")
_LATIN = {ord(x.lower()): c.lower() for c, xs in LOOKALIKES.items() for x in xs if c.isascii() and c.isalpha()}
_ELLIPSIS = re.compile(r"\.{2,}$|．{2,}$")
_WORD = regex.compile(r"[\p{L}\p{M}.]*[\p{L}\p{M}]$")
_NUMERAL = re.compile(r"\s*(?:[IVXLC]+\b|[A-Z]\b|[#№])")
_HIDDEN = regex.compile(r"\p{Cf}")
_KNOWN = regex.compile(r"[\p{L}\p{N}]")
_THAI = re.compile("(?<=[\u0e01-\u0e3a\u0e40-\u0e4e])[ \u00a0\u2000-\u200a\u202f\u205f\u3000]+(?=[\u0e01-\u0e3a\u0e40-\u0e4e])")
_LISTED = re.compile(r"\s*[-*>#\s]*(?:\w{1,12}\s+)?[(（]?[0-9０-９]{1,4}$|\s*[-*>#\s]*[(（]?[A-Za-z]$|\s*[-*>#\s]*[(（]?[ivxIVX]{1,5}$")
_MONTHS = regex.compile(r"\s*(?:Januar|Jänner|Februar|März|April|Mai|Juni|Juli|August|September|Oktober|November|Dezember|Jahrhundert|января|февраля|марта|апреля|мая|июня|июля|августа|сентября|октября|ноября|декабря)\b")
_CJK = regex.compile(r"[\p{Han}\p{Hiragana}\p{Katakana}ー々〇]")
# Verbs of speech, after the names and adverbs that may come before them.
_REPORTS = [
    regex.compile(r"\s*[^\s，。！？；：、“”「」『』\"…—,.!?;:]{1,14}?(?<![追不])(?:说|説|道|问|問|喊|答|叫|嚷|吼|骂|曰|喝|叹|笑)(?:道|着|了|了一句|一声)?(?=[，。：；！,.:;!“「『\"]|……|\s*$)"),
    regex.compile(r"\s*(?:と|って|など(?:と)?)"),
    regex.compile(r"\s*(?:(?:\p{Hangul}+(?:이|가|은|는)|\p{Hangul}+)\s+)?(?:\p{Hangul}+(?:게|히|으로|로|며)\s+){0,2}(?:말했|물었|외쳤|대답했|속삭였|중얼거렸|소리쳤|덧붙였|라고|하고)"),
    regex.compile(r"\s*[-–—]?\s*(?:\p{Lu}[\p{L}’'.-]*\s+){1,3}(?:said|asked|cried|replied|answered|whispered|shouted|muttered|called|murmured|added|laughed|sighed|sagte|fragte|rief|antwortete|flüsterte|dit|demanda|répondit|cria|murmura|dijo|preguntó|respondió|gritó|сказал|сказала|спросил|спросила|ответил|ответила|крикнул|крикнула|прошептал|прошептала)\b"),
    regex.compile(r"\s*(?:قال|قالت|سأل|سألت|صاح|أجاب|همس)"),
]
#: A quotation that is part of a clause goes on with what it is.
_GOES_ON = regex.compile(r"\s*(?:[一二两三四五六七八九十几数\d]+[个個]?(?:字|词|詞)|的|这|這|那句|二字|字样|字樣|之|という|との|などの|を|に|が|は|も|で|라는|라고|이라)")


def _matched(line: str) -> list[tuple[int, int]]:
    """(position of the opening, of the closing mark) of the outermost matched marks."""
    stack, found, straight = [], [], -1
    for i, c in enumerate(line):
        if stack and c in stack[-1][1]:
            a, _ = stack.pop()
            found.append((a, i))
        elif c in PAIRS:
            stack.append((i, PAIRS[c]))
        elif c in ('"', "＂"):
            if straight < 0:
                straight = i
            else:
                found.append((straight, i))
                straight = -1
        elif c in "”»」』》）)]】〕’" and stack:
            for k in range(len(stack) - 1, -1, -1):  # an opening mark in between was never closed
                if c in stack[k][1]:
                    found.append((stack[k][0], i))
                    del stack[k:]
                    break
    found.sort(key=lambda x: (x[0], -x[1]))
    outer: list[tuple[int, int]] = []
    for a, b in found:
        if not outer or a > outer[-1][1]:
            outer.append((a, b))
    return outer


def _stop_ends(line: str, i: int, j: int) -> bool:
    """Whether the full stop ``line[i:j]`` (one character) may end a sentence, by what is around it."""
    before, after = line[:i], line[j:]
    last, following = before[-1:], after[:1]
    if not last or not after.strip():
        return True
    if following.isdigit() and last.isdigit():
        return False
    if _LISTED.match(before) and (last.isdigit() or len(before.strip(" -*>#(（\t　")) <= 5):
        return False
    if _CJK.match(last):
        return not (following.isascii() and following.isalnum()) or following.isupper()
    if "฀" <= last <= "๿":
        return False
    if not (following.isspace() or following in QUOTES or following in ")]）】" or _CJK.match(following) or following in PAIRS):
        return False  # inside a version, an address, the name of a file
    word = _WORD.search(before)
    text = word[0] if word else ""
    low = text.lower().strip(".")
    alike = low.translate(_LATIN)  # an abbreviation may be written with letters that look like its own
    if alike != low and (alike in TITLES or alike in OPEN_END):
        low = alike
    following = after.lstrip()[:1]
    tail = low.rsplit(".", 1)[-1]
    if low in OPEN_END or (tail in OPEN_END and "." in low):
        return following.isupper() or not following.isalnum() or bool(_CJK.match(following))
    if low in MONTHS and following.isdigit():
        return False
    if low in BEFORE_NUMBER and not (following.isdigit() or _NUMERAL.match(after)):
        return not following.islower()
    if low in ENGLISH_WORDS and len(low) > 1 and following.isupper() and _ENGLISH.search(before[: -len(text) - 1]):
        return True
    if text and (low in TITLES or tail in TITLES and "." in low) and not (len(tail) > 1 and following and not following.isalnum()):
        return False
    if len(tail) == 1 and text[-1:].isupper():
        return False
    if last.isdigit() and _MONTHS.match(after):
        return False
    return not following.islower()


def sentences_of_line(line: str) -> list[tuple[int, int]]:
    """Spans of the sentences of one line (without its line end)."""
    if not _KNOWN.search(line):
        return []
    hidden = [m.start() for m in _HIDDEN.finditer(line)]
    if hidden:  # decide on what a reader sees
        gone = set(hidden)
        at = [i for i in range(len(line)) if i not in gone]
        seen = "".join(line[i] for i in at)
    else:
        at, seen = None, line
    outer = _matched(seen)
    opens, cuts = [a for a, _ in outer], []

    def inside(i: int) -> tuple[int, int] | None:
        k = bisect_right(opens, i) - 1
        return outer[k] if k >= 0 and opens[k] < i < outer[k][1] else None

    for m in _RUN.finditer(seen):
        i, j = m.span()
        run = m[0]
        if _ELLIPSIS.match(run) and len(run) > 1 and not any(c in STRONG for c in run):
            continue
        if run[0] in WEAK and len(run) == 1 and not _stop_ends(seen, i, j):
            continue
        held = inside(i)
        if held is None:
            # Closing marks without an opening one stay with the sentence.
            while j < len(seen) and (seen[j] in "”»」』’" or (seen[j] == '"' and not any(a == j for a, _ in outer))) and j not in opens:
                j += 1
            following = seen[j:].lstrip()[:1]
            if following.islower() and not _CJK.match(following) and seen[j - 1] not in "。！？｡।":
                continue
            if following and following in "，、；：,;:":
                continue
            cuts.append(j)
            continue
        a, b = held
        between = seen[j:b].strip()
        if seen[b] not in QUOTES or any(c not in QUOTES for c in between):
            continue  # a bracket or title, or not the end of what is quoted
        end, rest = b + 1, seen[b + 1 :]
        following = rest.lstrip()[:1]
        if following and (following in "，、；：,;:—–-…)）】" or following in STRONG + "."):
            continue
        if following.islower() and not _CJK.match(following):
            continue
        before = seen[a - 1 : a]
        if any(p.match(rest) for p in _REPORTS):
            continue
        if before and _KNOWN.match(before) and _GOES_ON.match(rest):
            continue
        cuts.append(end)
    for m in _THAI.finditer(seen):
        if inside(m.start()) is None:
            cuts.append(m.end())
    spans, start = [], 0
    for cut in [*sorted(set(cuts)), len(seen)]:
        part = seen[start:cut]
        if _KNOWN.search(part):
            a, b = start + len(part) - len(part.lstrip()), start + len(part.rstrip())
            spans.append((a, b))
        elif spans and part.strip():
            spans[-1] = (spans[-1][0], start + len(part.rstrip()))
        start = cut
    if at is None:
        return spans
    return [(at[a], at[b - 1] + 1) for a, b in spans]


def sentences(text: str) -> list[tuple[int, int]]:
    """Spans of the sentences of a text, in order, by code points."""
    out, at = [], 0
    for line in text.split("\n"):
        body = line[:-1] if line.endswith("\r") else line
        out += [(at + a, at + b) for a, b in sentences_of_line(body)]
        at += len(line) + 1
    return out


def split_sentences(documents: DataFrame) -> DataFrame:
    """``(doc, n, start_pos, end_pos)``: the sentences of every document, ``n`` counting from 0.

    ``documents`` has ``doc, text``; other columns are ignored. Null and empty texts and texts without letter or digit
    have none; repeated rows come out again; an empty table gives an empty result.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at, piece in codepoints.pieces(b.column("text")):
                rows, n, start, end = [], [], [], []
                for i, text in enumerate(piece.to_pylist()):
                    for k, (x, y) in enumerate(sentences(text)):
                        rows.append(at + i)
                        n.append(k)
                        start.append(x)
                        end.append(y)
                yield pa.RecordBatch.from_arrays([b.column("doc").take(pa.array(rows, pa.int64())), *[pa.array(x, pa.int64()) for x in (n, start, end)]], names=["doc", "n", "start_pos", "end_pos"])

    return documents.where("text is not null and text <> ''").select("doc", "text").mapInArrow(run, f"doc {documents.schema['doc'].dataType.simpleString()}, n bigint, start_pos bigint, end_pos bigint")

"""Segments and scenes: ordered folds within a chapter.

Paragraphs are gathered per (document, chapter), which is bounded by one document's text. The folds look only at
lengths and kinds, in one Arrow call a batch of chapters; text never goes through Python.
"""

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from inkmill.functions import text as T
from inkmill.operators import chapters as C
from inkmill.operators import paragraphs as P


@dataclass(frozen=True)
class Limits:
    """Lengths in characters."""

    segment: int = 800
    absorb: int = 50
    target: int = 1200
    dialogue_target: int = 1500
    code_target: int = 800
    hard: int = 3000
    can_split: int = 1800
    #: One target for all scenes instead of one by what they hold.
    fixed: bool = False
    prefix: int = 200


# Codes of kinds in the folds.
NARRATION, DIALOGUE, HEADER, CODE = 0, 1, 2, 3
END_SIGNS = ["。", "”", "！", "？", ".", "}"]


def segment_numbers(kinds: list[int], types: list[str], sizes: list[int], limits: Limits = Limits(), absorb: bool = True) -> list[int]:
    """Segment of each paragraph of a chapter.

    A new one starts where the kind differs from that of the segment's first paragraph, unless a short neighbour of
    narration and dialogue is absorbed; at every header and change of anchor type; and for text once the segment is
    longer than the limit. Without ``absorb`` only kind and length count.
    """
    out, n, first, size = [], -1, -1, 0
    for i, (kind, kind_type, length) in enumerate(zip(kinds, types, sizes)):
        anchor = kind >= HEADER
        if n < 0:
            split = True
        elif not absorb:
            split = kind != first or size > limits.segment
        elif anchor:
            split = kind == HEADER or types[i - 1] != kind_type
        else:
            near = sizes[i - 1] if first == NARRATION else length
            merge = kinds[i - 1] < HEADER and {first, kind} == {NARRATION, DIALOGUE} and near < limits.absorb
            split = (kind != first and not merge) or size > limits.segment
        if split:
            n, first, size = n + 1, kind, 0
        size += length
        out.append(n)
    return out


def scene_numbers(segments: list[int], kinds: list[int], sizes: list[int], limits: Limits = Limits()) -> list[int]:
    """Scene of each paragraph: a scene ends before the segment that comes after it reached its target length.

    The target depends on what the scene holds: code, mostly dialogue, or other text.
    """
    out, scene, length, held, talk, code, last = [], 0, 0, 0, 0, False, None
    for segment, kind, size in zip(segments, kinds, sizes):
        if segment != last:
            target = limits.target if not held or limits.fixed else limits.code_target if code else limits.dialogue_target if talk / held > 0.5 else limits.target
            if held and (length >= target or length >= limits.hard):
                scene, length, held, talk, code = scene + 1, 0, 0, 0, False
            held, talk, code, last = held + 1, talk + (kind == DIALOGUE), code or kind == CODE, segment
        length += size
        out.append(scene)
    return out


def _numbered(paras: DataFrame, limits: Limits, absorb: bool) -> DataFrame:
    """Paragraphs (``doc, chapter_index, para_index, content, para_type, kind``) with ``segment`` and ``scene``; empty ones go."""

    @F.pandas_udf("array<struct<segment:int,scene:int>>")
    def fold(kinds: pd.Series, types: pd.Series, sizes: pd.Series) -> pd.Series:
        out = []
        for k, t, s in zip(kinds, types, sizes):
            k, t, s = list(k), list(t), list(s)
            seg = segment_numbers(k, t, s, limits, absorb)
            out.append([{"segment": a, "scene": b} for a, b in zip(seg, scene_numbers(seg, k, s, limits))])
        return pd.Series(out)

    code = F.when(F.col("kind") == "NARRATION", NARRATION).when(F.col("kind") == "DIALOGUE", DIALOGUE).when(F.col("kind") == "HEADER", HEADER).otherwise(CODE)
    item = F.struct("para_index", "content", "kind", "para_type", code.alias("code"), F.length("content").alias("size"))
    # A chapter's title is its first paragraph that is not empty.
    title = F.min_by(F.when(F.col("is_title"), F.col("content")).otherwise(F.lit(C.PREFACE)), "para_index")
    grouped = paras.where("not is_empty").groupBy("doc", "chapter_index").agg(F.sort_array(F.collect_list(item)).alias("p"), title.alias("chapter_title"))
    numbers = fold(F.col("p.code"), F.col("p.para_type"), F.col("p.size"))
    zipped = grouped.withColumn("numbers", numbers).select("doc", "chapter_index", "chapter_title", F.explode(F.arrays_zip("p", "numbers")).alias("z"))
    return zipped.select("doc", "chapter_index", "chapter_title", "z.p.para_index", "z.p.content", "z.p.kind", "z.numbers.segment", "z.numbers.scene")


def prepared(documents: DataFrame, profile: str = "split") -> DataFrame:
    """Typed paragraphs of ``documents(doc, text)`` with chapter and kind, by one of the two profiles."""
    paras = P.paragraphs(documents, profile)
    paras = P.typed(paras) if profile == "split" else P.untyped(paras)
    return P.with_kind(C.with_chapter(paras, profile))


def segments(documents: DataFrame, profile: str = "split", limits: Limits = Limits(), absorb: bool = True) -> DataFrame:
    """``(doc, chapter_index, segment, seg_type, start_para, end_para, seg_len, n_paras)``; the type is that of the first paragraph."""
    n = _numbered(prepared(documents, profile), limits, absorb)
    return n.groupBy("doc", "chapter_index", "segment").agg(
        F.min_by("kind", "para_index").alias("seg_type"), F.min("para_index").alias("start_para"), F.max("para_index").alias("end_para"), F.sum(F.length("content")).alias("seg_len"), F.count(F.lit(1)).alias("n_paras")
    )


def scenes(documents: DataFrame, profile: str = "split", version: str = "v1", limits: Limits = Limits()) -> DataFrame:
    """Scenes of ``documents(doc, text)`` with text, place, density, quality and the end of the scene before.

    The id is a hash of document, version, chapter and first paragraph, so the same text always has the same ids.
    """
    n = _numbered(prepared(documents, profile), limits, True)
    by = F.struct("para_index", "content")
    first = F.col("para_index") == F.min("para_index").over(Window.partitionBy("doc", "chapter_index", "segment"))
    rows = n.withColumn("opens", first)
    out = rows.groupBy("doc", "chapter_index", "scene").agg(
        F.min("para_index").alias("start_para"),
        F.max("para_index").alias("end_para"),
        F.concat(F.array_join(F.transform(F.sort_array(F.collect_list(by)), lambda x: x["content"]), "\n"), F.lit("\n")).alias("text"),
        F.first("chapter_title").alias("chapter_title"),
        F.sum(F.when(F.col("opens"), 1).otherwise(0)).alias("n_segments"),
        F.sum(F.when(F.col("opens") & (F.col("kind") == "DIALOGUE"), 1).otherwise(0)).alias("n_dialogue"),
    )
    body = F.substring("text", 1, F.length("text") - 1)
    w = Window.partitionBy("doc", "chapter_index").orderBy("scene")
    out = out.select(
        F.sha2(F.concat_ws("|", F.col("doc").cast("string"), F.lit(version), "chapter_index", "start_para"), 256).substr(1, 24).alias("id"),
        "doc", "chapter_index", F.col("scene").cast("int").alias("scene"), "start_para", "end_para", "text",
        F.length("text").alias("word_count"),
        (F.length("text") > limits.can_split).alias("can_split"),
        (1 - F.col("n_dialogue") / F.col("n_segments")).alias("density_score"),
        F.when(F.substring(body, -1, 1).isin(END_SIGNS), 1.0).otherwise(0.7).alias("quality_score"),
        T.trim_ascii(F.coalesce(T.tail(F.lag("text").over(w), limits.prefix), F.lit(""))).alias("prefix_context"),
        F.lit(version).alias("version"),
        "chapter_title",
    )
    return out


def first_scenes(frame: DataFrame, n: int, key: str = "doc") -> DataFrame:
    """The first ``n`` scenes of each document in its order; all for ``n`` of 0 or less."""
    if n <= 0:
        return frame
    w = Window.partitionBy(key).orderBy("chapter_index", "start_para")
    return frame.withColumn("_n", F.row_number().over(w)).where(F.col("_n") <= n).drop("_n")

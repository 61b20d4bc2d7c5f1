"""A table of vectors: keeping, deleting, normalising and exact search."""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows and queries of one product of matrices, and rows that a task gathers before it looks at them.
BLOCK, TOGETHER, HELD = 4096, 256, 1 << 15
#: Slices the rows of one value of ``within`` are spread over.
SALT = 4


def latest(store: DataFrame, key: str, at: str, row: str) -> DataFrame:
    """One row per key: that with the latest ``at``, of equal ones that with the larger ``row``; null keys go."""
    keep = F.max_by(F.struct(*[F.col(c) for c in store.columns]), F.struct(F.col(at), F.col(row)))
    return store.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("_key")).agg(keep.alias("x")).select("x.*")


def upsert(store: DataFrame, new: DataFrame, key: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``store`` with the rows of ``new`` in place of those with the same key; of equal new keys one stays.

    Where a column of ``keep`` is null in a new row, what the old one (the smallest, if several) has there stays.
    """
    fresh = new.where(F.col(key).isNotNull()).dropDuplicates([key])
    rest = store.join(fresh.select(key), key, "left_anti")
    if keep:
        old = store.where(F.col(key).isNotNull()).groupBy(key).agg(*[F.min(c).alias(f"_{c}") for c in keep])
        fresh = fresh.join(old, key, "left").select(*[F.coalesce(c, f"_{c}").alias(c) if c in keep else F.col(c) for c in new.columns])
    return rest.unionByName(fresh)


def with_vectors(scenes: DataFrame, vectors: DataFrame) -> DataFrame:
    """A batch to store: ``scenes(id, ..)`` with ``vectors(id, embedding)``; raises unless both have the same number of rows.

    Scenes with a null id go, as do vectors without a scene.
    """
    n, m = scenes.count(), vectors.count()
    if n != m:
        raise ValueError(f"{n} scenes and {m} vectors")
    return scenes.where("id is not null").join(vectors, "id")


def delete(store: DataFrame, known: tuple[str, ...] = ("novel", "version"), **equal: str) -> DataFrame:
    """``store`` without rows that equal all given values; nothing given deletes nothing, unknown keys raise."""
    return store if not equal else store.where(~matching(known, **equal))


def matching(known: tuple[str, ...] = ("novel", "version"), **equal: str) -> Column:
    """Condition that holds where all given values are equal (null equals null)."""
    if unknown := set(equal) - set(known):
        raise ValueError(f"unknown filter keys: {sorted(unknown)}")
    out = F.lit(True)
    for k, v in equal.items():
        out = out & F.col(k).eqNullSafe(F.lit(v))
    return out


def is_usable(vector: Column, size: int) -> Column:
    """True for vectors of ``size`` finite numbers that are not all zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce((F.size(vector) == size) & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision; vectors of different sizes raise."""
    total = F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)
    return F.when(F.size(a) == F.size(b), total).otherwise(F.raise_error(F.lit("vectors differ in size")).cast("double"))


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def normalised(a: Column) -> Column:
    """The vector at length 1; a zero vector stays as it is."""
    n = norm(a)
    return F.when(n == 0, F.transform(a, lambda x: x.cast("double"))).otherwise(F.transform(a, lambda x: x.cast("double") / n))


def cosine(a: Column, b: Column) -> Column:
    """Cosine, 0 if either is zero."""
    return F.coalesce(F.try_divide(dot(a, b), norm(a) * norm(b)), F.lit(0.0))


def top_k(store: DataFrame, query: list[float], k: int, vector: str = "embedding", row: str = "row") -> DataFrame:
    """The ``k`` rows most similar to one query vector; ties go to the smaller row. Plans as take-ordered."""
    score = F.round(cosine(F.col(vector), F.array(*[F.lit(float(x)) for x in query])), 9)
    return store.select(row, score.alias("score")).orderBy(F.desc("score"), row).limit(max(k, 0))


def slices(cores: int, limited: bool) -> int:
    """A multiple of ``cores``, so no core waits for others at the end. Every slice gives ``k`` rows a query and learns each bound anew, so slices of one size are few; those of limited queries differ in size."""
    return cores * (max(2, -(-16 // cores)) if limited else -(-12 // cores))


def top_k_of_each(store: DataFrame, queries: DataFrame, k: int, size: int = 64, within: tuple[str, ...] = ()) -> DataFrame:
    """``(query, row, score, rank)``: exact top ``k`` of every query vector over all of ``store``.

    ``store`` has ``row, embedding``, ``queries`` has ``query, embedding``; unusable vectors take no part. A column of
    ``within`` limits a query to the rows that have the same there, unless it is null in the query. Every row of the store
    is sent to one of ``n`` slices and every query to each of them; a query limited by all columns only to the ``SALT``
    slices its rows are in. A task holds the queries and sees its rows go by, and at most ``k`` rows a query leave it.
    """
    cores = store.sparkSession.sparkContext.defaultParallelism
    n = slices(cores, bool(within))
    salt = F.pmod(F.xxhash64("row"), F.lit(SALT if within else n))
    at = lambda keys, salt: F.pmod(F.xxhash64(keys, salt), F.lit(n)) if within else salt
    usable = store.where(is_usable(F.col("embedding"), size)).select(F.col("row").cast("bigint").alias("row"), "embedding", F.array(*[F.xxhash64(c) for c in within]).cast("array<bigint>").alias("own"))
    asked = queries.where(is_usable(F.col("embedding"), size)).select(F.col("query").cast("bigint").alias("row"), "embedding", F.array(*[F.when(F.col(c).isNotNull(), F.xxhash64(c)) for c in within]).cast("array<bigint>").alias("own"))
    everywhere = F.sequence(F.lit(0), F.lit(n - 1)).cast("array<bigint>")
    limited = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(SALT - 1)).cast("array<bigint>"), lambda i: at(F.col("own"), i)))
    sent = F.when(F.exists("own", lambda x: x.isNull()), everywhere).otherwise(limited) if within else everywhere
    # Queries come first in each slice.
    both = asked.withColumn("slice", F.explode(sent)).withColumn("stored", F.lit(False)).unionByName(usable.withColumn("slice", at(F.col("own"), salt)).withColumn("stored", F.lit(True)))
    sliced = both.where(F.lit(k > 0)).repartitionById(n, F.col("slice").cast("int")).sortWithinPartitions("stored")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries, blocks, held, best = [], [], 0, None

        def seen() -> None:
            nonlocal best, blocks, held
            if best is None:
                best = Best(*_joined(queries), k)
                queries.clear()
            if held:
                best.see(*_joined(blocks))
            blocks, held = [], 0

        for b in batches:
            stored = b.column("stored").to_numpy(zero_copy_only=False)
            first = int(np.searchsorted(stored, True))
            for low, high, into in ((0, first, queries), (first, len(stored), blocks)):
                if high > low:
                    into.append(_arrays(b.slice(low, high - low), size))
            if best is None and not queries:
                return  # rows that no query looks for
            held += len(stored) - first
            if held >= HELD:
                seen()
        if queries or held:
            seen()
        if best is not None:
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in best.found()], names=["query", "row", "score"])

    w = Window.partitionBy("query").orderBy(F.desc("score"), "row")
    return sliced.select("row", "embedding", "own", "stored").mapInArrow(scan, "query bigint, row bigint, score double").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def _arrays(batch: pa.RecordBatch, size: int) -> tuple[np.ndarray, ...]:
    """Rows, vectors at length 1 and own values (0 where free) of a batch, and which are free."""
    x = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).reshape(-1, size).astype(np.float64)
    own = batch.column("own").flatten()
    shape = (batch.num_rows, len(own) // batch.num_rows)
    free = own.is_null().to_numpy(zero_copy_only=False).reshape(shape)
    return batch.column("row").to_numpy(), x / np.sqrt((x * x).sum(1))[:, None], own.fill_null(0).to_numpy(zero_copy_only=False).reshape(shape), free


def _joined(parts: list[tuple[np.ndarray, ...]]) -> tuple[np.ndarray, ...]:
    return tuple(np.concatenate(x) for x in zip(*parts))


class Best:
    """The ``k`` best rows of each query among those seen so far.

    Scores are computed in single precision first; what is within their error of a query's k-th best is computed again in
    double precision and rounded, and of equal scores the smaller row stays, so the result is that of exact scores.
    """

    def __init__(self, ids: np.ndarray, units: np.ndarray, own: np.ndarray, free: np.ndarray, k: int):
        self.ids, self.units, self.own, self.free, self.k = ids, units, own, free, k
        self.short = units.astype(np.float32)
        # Twice the bound of a single-precision product's error, and what rounding to 9 places may add.
        self.margin = np.float32(2.2 * (units.shape[1] + 4) * 2.0**-24 + 4e-9)
        self.least = np.full(len(ids), -np.inf, np.float32)  # what a score in single precision must reach
        self.kept = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query's place, row, score

    def see(self, rows: np.ndarray, units: np.ndarray, own: np.ndarray, _: np.ndarray) -> None:
        short = units.astype(np.float32)
        new = [self.kept]
        for mine, theirs in self._groups(own):
            for low in range(0, len(mine), TOGETHER):
                who, which = self._near(mine[low : low + TOGETHER], theirs, short)
                for i in range(0, len(who), 1 << 16):
                    a, b = who[i : i + (1 << 16)], which[i : i + (1 << 16)]
                    new.append((a, rows[b], np.round(np.einsum("ij,ij->i", self.units[a], units[b]), 9)))
        who, which, score = _joined(new)
        order, nth = _first(who, which, score, self.k)
        who, which, score = self.kept = who[order], which[order], score[order]
        last = nth == self.k - 1
        self.least[who[last]] = np.maximum(self.least[who[last]], score[last].astype(np.float32) - self.margin)

    def _groups(self, own: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Places of queries, and of the rows they may find."""
        if not own.shape[1]:
            yield np.arange(len(self.ids)), np.arange(len(own))
            return
        for form in np.unique(self.free, axis=0):
            asks = np.flatnonzero((self.free == form).all(1))
            _, key = np.unique(np.concatenate([self.own[asks], own])[:, ~form], axis=0, return_inverse=True) if not form.all() else (None, np.zeros(len(asks) + len(own), np.int64))
            mine, theirs = key[: len(asks)], key[len(asks) :]
            order, turn = np.argsort(theirs, kind="stable"), np.argsort(mine, kind="stable")
            begins = np.flatnonzero(np.diff(mine[turn], prepend=-1))
            low, high = (np.searchsorted(theirs[order], mine[turn][begins], side) for side in ("left", "right"))
            for i in np.flatnonzero(high > low).tolist():
                yield asks[turn[begins[i] : begins[i + 1] if i + 1 < len(begins) else None]], order[low[i] : high[i]]

    def _near(self, mine: np.ndarray, theirs: np.ndarray, short: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs whose score may be among the ``k`` best."""
        q, least = self.short[mine], self.least[mine]
        who, which, score = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.float32)
        new, count, low = [], 0, 0
        while low < len(theirs):
            high = low + (BLOCK if low else BLOCK // 4)  # few rows first, for a bound
            part = theirs[low:high]
            s = q @ (short[part[0] : part[-1] + 1] if part[-1] - part[0] == len(part) - 1 else short[part]).T
            if self.k < s.shape[1] and not low:
                edge = np.partition(s, s.shape[1] - self.k, axis=1)[:, s.shape[1] - self.k]
                least = np.maximum(least, edge - self.margin)
            at = _few(s >= least[:, None])
            if len(at):
                new.append((at // s.shape[1], part[at % s.shape[1]], s.ravel()[at]))
                count += len(at)
            low = high
            if count and (count > 2 * self.k * len(mine) or low >= len(theirs)):
                who, which, score = _joined([(who, which, score), *new])
                new, count = [], 0
                order = np.lexsort((-score, who))
                who, which, score = who[order], which[order], score[order]
                last = np.arange(len(who)) - np.searchsorted(who, who) == self.k - 1
                least[who[last]] = np.maximum(least[who[last]], score[last] - self.margin)
                fit = score >= least[who]
                who, which, score = who[fit], which[fit], score[fit]
        return mine[who], which

    def found(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        who, which, score = self.kept
        return self.ids[who], which, score


def _few(mask: np.ndarray) -> np.ndarray:
    """Places of the few True of a mask: eight are looked at together first."""
    flat = mask.ravel()
    n = len(flat) // 8 * 8
    eight = np.flatnonzero(flat[:n].view(np.uint64))
    which, place = np.nonzero(flat[:n].reshape(-1, 8)[eight])
    return np.concatenate([eight[which] * 8 + place, n + np.flatnonzero(flat[n:])])


def _first(who: np.ndarray, rows: np.ndarray, score: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the ``k`` best scores of each query in order, and how many of its own come before each; ties go to the smaller row."""
    order = np.lexsort((rows, -score, who))
    nth = np.arange(len(who)) - np.searchsorted(who[order], who[order])
    return order[nth < k], nth[nth < k]


def best_of(score: np.ndarray, rows: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Query and column of the ``k`` best finite scores of each query; ties go to the smaller row."""
    if score.shape[1] > k:
        edge = np.partition(score, score.shape[1] - k, axis=1)[:, score.shape[1] - k, None]
        who, which = np.nonzero((score >= edge) & np.isfinite(score))
    else:
        who, which = np.nonzero(np.isfinite(score))
    order, _ = _first(who, rows[which], score[who, which], k)
    return who[order], which[order]


def hashed_embedding(texts: DataFrame, size: int = 64) -> DataFrame:
    """``(doc, embedding)``: counts of neighbouring character pairs in hashed buckets, at length 1.

    ``texts`` has ``doc, text``; texts of less than two characters have no row. Deterministic, JVM-side, pre-aggregated
    before the shuffle.
    """
    chars = F.split("text", "")
    n = F.greatest(F.length("text") - 1, F.lit(0))
    pairs = F.zip_with(F.slice(chars, 1, n), F.slice(chars, 2, n), lambda a, b: F.concat(a, b))
    bucket = F.conv(F.substring(F.md5("pair"), 1, 8), 16, 10).cast("bigint") % size
    counts = texts.where(F.length("text") > 1).select("doc", F.explode(pairs).alias("pair")).groupBy("doc", bucket.cast("int").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))
    filled = counts.groupBy("doc").agg(F.map_from_entries(F.collect_list(F.struct("bucket", "n"))).alias("m"), F.sqrt(F.sum(F.col("n") * F.col("n"))).alias("z"))
    return filled.select("doc", F.transform(F.sequence(F.lit(0), F.lit(size - 1)), lambda i: F.coalesce(F.try_element_at("m", i), F.lit(0)) / F.col("z")).alias("embedding"))


def character_ids(texts: DataFrame, vocabulary: DataFrame, unknown: int = 100, start: int = 101, end: int = 102, longest: int = 512) -> DataFrame:
    """``(doc, ids, n)``: start id, one id a character up to the longest size, end id; ``n`` counts them.

    ``vocabulary`` has ``token, id``; only tokens of one character count, so what is sent to the tasks is bounded by the
    number of code points. Null texts have no row; empty ones only start and end.
    """
    ids = np.full(0x110000, unknown, np.int64)
    known = vocabulary.where(F.length("token") == 1).select(F.ascii("token").alias("point"), F.col("id").cast("bigint").alias("id")).groupBy("point").agg(F.min("id").alias("id")).toArrow()
    ids[known.column("point").to_numpy()] = known.column("id").to_numpy()
    sent = texts.sparkSession.sparkContext.broadcast(ids)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in b.column("text").to_pylist():
                points = np.frombuffer(text[: longest - 2].encode("utf-32-le", "surrogatepass"), np.uint32)
                out.append(np.concatenate([[start], sent.value[points], [end]]))
            yield pa.RecordBatch.from_arrays([b.column("doc"), pa.array(out, pa.list_(pa.int32())), pa.array([len(x) for x in out], pa.int32())], names=["doc", "ids", "n"])

    return texts.where("text is not null").select("doc", "text").mapInArrow(run, f"doc {texts.schema['doc'].dataType.simpleString()}, ids array<int>, n int")


def vocabulary_of(spark: SparkSession, path: str) -> DataFrame:
    """``(token, id)`` of a JSON file: a tokenizer's ``model.vocab``, a ``vocab``, or the map itself; a missing file raises."""
    whole = spark.read.text(path, wholetext=True).select("value")
    of = lambda at: F.from_json(F.get_json_object("value", at), "map<string,bigint>")
    return whole.select(F.explode(F.coalesce(of("$.model.vocab"), of("$.vocab"), F.from_json("value", "map<string,bigint>"))).alias("token", "id"))

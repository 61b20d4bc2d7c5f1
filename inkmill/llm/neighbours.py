"""The most similar vectors of every vector (problem 4).

Method: score-aware (anisotropic) quantisation. Unit vectors are cut into cells around centroids; the residual to the
centroid is coded with four bits for each pair of dimensions, where the codebooks and the codes weigh the error
parallel to the vector more than the error across it. A query scans the packed codes with its tables of inner products
(16-bit entries, two codes a byte), and the best of the scan are ranked again by the exact cosine in double precision.

Two levels. Centroids and codebooks of the first are fitted on a sample (``sample`` rows, or ``PER_CELL`` a cell where
that is more, by a hash of the row number); the number of cells grows with the collection, to ``top`` vectors a cell. A
cell that turns out denser than ``BLOCK`` gets centroids of its own. Every vector goes to its cell and asks there and in
the ``probes - 1`` next ones; the task that holds a cell cuts it again into parts of about ``CELL`` vectors and a query
scans only the ``PARTS`` nearest, so what a query costs does not grow with the collection. Where vectors cannot be told
apart by centroids a cell is cut into blocks by hash, so no task holds an unbounded group.

Vectors of exactly one direction are one class: of a class only the k + 1 smallest rows can be anybody's neighbour
(equal cosines go to the smaller row), so these are indexed and one row asks for all.

Classes and the latest row of a chunk are found on row numbers and hashes alone. The vectors themselves are shuffled
once to the index and once per probe.
"""

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from inkmill.llm.blas import one_thread
from inkmill.sources.tables import materialise

#: Vectors of a cell and of a part of it, and how many parts of a cell a query scans.
TOP, CELL, PARTS = 16_384, 256, 4
SAMPLE, PER_CELL = 20_000, 16
PROBES = 5
#: Vectors or queries of a cell that one task takes.
BLOCK = 49_152
#: Candidates of a part that are kept, and of a cell that are ranked exactly.
KEEP, RERANK = 48, 120
#: The threshold T of the score-aware loss: weight of the parallel error is (d - 1) T^2 / (1 - T^2).
THRESHOLD = 0.2
ROUNDS = 8
SALTS = 16


@dataclass(frozen=True)
class Quantiser:
    """Centroids (cells x d) and codebooks (d / 2 x 16 x 2)."""

    centroids: np.ndarray
    books: np.ndarray
    weight: float

    def cells(self, unit: np.ndarray, n: int = 1) -> np.ndarray:
        """The nearest cells by inner product, best first."""
        score = unit.astype(np.float32) @ self.centroids.T
        n = min(n, score.shape[1])
        best = np.argpartition(-score, n - 1, axis=1)[:, :n]
        order = np.argsort(-np.take_along_axis(score, best, 1), axis=1, kind="stable")
        return np.take_along_axis(best, order, 1)

    def encode(self, unit: np.ndarray, cell: np.ndarray, passes: int = 2) -> np.ndarray:
        """Codes (n x d / 2) that minimise the score-aware loss by coordinate descent."""
        unit = unit.astype(np.float32)
        residual = (unit - self.centroids[cell]).reshape(len(unit), -1, 2)
        along = unit.reshape(len(unit), -1, 2)
        return _assign(residual, along, self.books, self.weight, passes)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """The coded residuals."""
        return self.books[np.arange(self.books.shape[0]), codes].reshape(len(codes), -1)

    def tables(self, unit: np.ndarray) -> np.ndarray:
        """Inner products of queries with the codebooks, (d / 2) x queries x 16, in 16-bit steps of a query's own size.

        The steps are such that the sum over all codes stays within 16 bits.
        """
        parts = unit.astype(np.float32).reshape(len(unit), -1, 2).transpose(1, 0, 2) @ self.books.transpose(0, 2, 1)
        parts *= 30_000 / np.maximum(np.abs(parts).max(2).sum(0), 1e-9)[:, None]
        return np.rint(parts).astype(np.int16)


def scanned(tables: np.ndarray, packed: np.ndarray) -> np.ndarray:
    """Sums of the tables' entries (d / 2 x 16 x queries) over packed codes, codes x queries: for each code a gather of whole rows."""
    score = np.zeros((len(packed), tables.shape[2]), np.int16)
    row = np.empty_like(score)
    for s in range(len(tables)):
        code = packed[:, s >> 1] >> 4 if s & 1 else packed[:, s >> 1] & 15
        score += np.take(tables[s], code, axis=0, out=row, mode="clip")
    return score


def _assign(residual: np.ndarray, along: np.ndarray, books: np.ndarray, weight: float, passes: int) -> np.ndarray:
    n, parts, _ = residual.shape
    codes = np.zeros((n, parts), np.uint8)
    for at in range(0, n, 1024):  # a block's products stay in the cache
        r, u = (np.ascontiguousarray(x[at : at + 1024].transpose(1, 2, 0)) for x in (residual, along))  # parts x 2 x rows
        error = (books**2).sum(2)[:, :, None] - 2 * (books @ r)  # parts x 16 x rows, less |r|^2
        own = (r * u).sum(1)[:, None] - books @ u  # parallel error of each choice
        code = error.argmin(1)
        parallel = np.take_along_axis(own, code[:, None], 1)[:, 0]
        total = parallel.sum(0)
        for _ in range(passes):
            for s in range(parts):
                whole = own[s] + (total - parallel[s])
                whole *= whole
                whole *= weight - 1
                whole += error[s]
                code[s] = whole.argmin(0)
                fresh = np.take_along_axis(own[s], code[s][None], 0)[0]
                total += fresh - parallel[s]
                parallel[s] = fresh
        codes[at : at + 1024] = code.T
    return codes


def fit(unit: np.ndarray, cells: int, seed: int = 7) -> Quantiser:
    """Spherical k-means and score-aware codebooks of a sample of unit vectors."""
    rng = np.random.default_rng(seed)
    unit = unit.astype(np.float32)
    d = unit.shape[1]
    unit = unit[rng.permutation(len(unit))]
    centroids = _parts(unit, cells, ROUNDS)[0]
    cell = np.argmax(unit @ centroids.T, 1)
    order = np.argsort(cell, kind="stable")
    at = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
    centroids[cell[order][at]] = np.add.reduceat(unit[order], at, axis=0) / np.diff([*at, len(unit)])[:, None]
    residual = (unit - centroids[cell]).reshape(len(unit), d // 2, 2)
    along = unit.reshape(len(unit), d // 2, 2)
    weight = (d - 1) * THRESHOLD**2 / (1 - THRESHOLD**2)
    books = np.stack([residual[rng.choice(len(unit), 16, replace=len(unit) < 16), s] for s in range(d // 2)])
    for _ in range(ROUNDS):
        codes = _assign(residual, along, books, weight, 1)
        picked = books[np.arange(d // 2), codes]
        parallel = ((residual - picked) * along).sum(2)
        total = parallel.sum(1)
        for s in range(d // 2):
            # Normal equations of sum |r - c|^2 + (w - 1) (rest + <r - c, u>)^2 over the vectors of a code.
            u, rest = along[:, s], total - parallel[:, s]
            right = residual[:, s] + (weight - 1) * u * (rest + (residual[:, s] * u).sum(1))[:, None]
            left = np.eye(2)[None] + (weight - 1) * u[:, :, None] * u[:, None, :]
            of = (codes[:, s] == np.arange(16)[:, None]).astype(np.float64)
            a, b = (of @ left.reshape(-1, 4)).reshape(16, 2, 2), of @ right
            used = of.any(1)
            books[s, used] = np.linalg.solve(a[used], b[used][:, :, None])[:, :, 0]
    return Quantiser(centroids, books.astype(np.float32), weight)


def _units(column: pa.Array, d: int) -> np.ndarray:
    x = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), d)
    return x / np.sqrt((x * x).sum(1))[:, None]


def usable(rows: DataFrame, d: int) -> DataFrame:
    """Rows whose embedding has ``d`` finite numbers that are not all zero."""
    return rows.where(_is_usable(d))


def _is_usable(d: int) -> Column:
    v = F.col("embedding")
    big = float(np.finfo(np.float32).max)
    return F.coalesce((F.size(v) == d) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) <= big)) & F.exists(v, lambda x: x != 0), F.lit(False))


def _direction(unit: np.ndarray) -> np.ndarray:
    """Two 64-bit hashes of each direction (to 13 digits)."""
    x = (np.round(unit, 13) + 0.0).view(np.uint64)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
    x ^= x >> np.uint64(29)
    odd = np.random.default_rng(1).integers(0, 1 << 63, (2, x.shape[1]), np.uint64) * np.uint64(2) + np.uint64(1)
    return np.stack([(x * o).sum(1, dtype=np.uint64) for o in odd]).view(np.int64)


def live_rows(store: DataFrame, d: int) -> DataFrame:
    """``(row, c1, c2)``: the latest row of each chunk, if its embedding takes part, with the hashes of its direction.

    Ties in time go to the larger row, null times are oldest; rows with a null chunk or row take no part.
    """

    def keyed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ok = b.column("ok").to_numpy(zero_copy_only=False)
            c = np.zeros((2, b.num_rows), np.int64)
            if ok.any():
                c[:, ok] = _direction(_units(b.column("embedding").filter(b.column("ok")), d))
            yield pa.RecordBatch.from_arrays([b.column("row"), b.column("chunk"), b.column("at"), b.column("ok"), pa.array(c[0]), pa.array(c[1])], names=["row", "chunk", "at", "ok", "c1", "c2"])

    rows = store.where("chunk is not null and row is not null").select("row", "chunk", F.coalesce(F.col("at"), F.lit(0).cast("timestamp")).alias("at"), "embedding", _is_usable(d).alias("ok"))
    chunk = store.schema["chunk"].dataType.simpleString()
    rows = rows.mapInArrow(keyed, f"row bigint, chunk {chunk}, at timestamp, ok boolean, c1 bigint, c2 bigint")
    return rows.groupBy("chunk").agg(F.max_by(F.struct("row", "ok", "c1", "c2"), F.struct("at", "row")).alias("x")).where("x.ok").select("x.row", "x.c1", "x.c2")


def _parts(x: np.ndarray, n: int, rounds: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Centroids of ``n`` parts of unit vectors, and the part of each vector."""
    n = max(1, min(n, len(x)))
    centre = x[np.linspace(0, len(x) - 1, n).astype(np.int64)].copy()
    for _ in range(rounds if n > 1 else 0):
        part = np.argmax(x @ centre.T, 1)
        order = np.argsort(part, kind="stable")
        at = np.flatnonzero(np.concatenate([[True], np.diff(part[order]) != 0]))
        sums = np.add.reduceat(x[order], at, axis=0)
        centre[part[order][at]] = sums / np.maximum(np.linalg.norm(sums, axis=1, keepdims=True), 1e-12)
    return centre, np.argmax(x @ centre.T, 1) if n > 1 else np.zeros(len(x), np.int64)


def _nearest(q: Quantiser, x: np.ndarray, packed: np.ndarray, rows: np.ndarray, y: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows (queries x at most k + 1) and cosines of the values nearest to the queries; missing ones are -1."""
    x32 = x.astype(np.float32)
    centre, part = _parts(x32, len(x) // CELL)
    order = np.argsort(part, kind="stable")
    low, high = np.searchsorted(part[order], np.arange(len(centre))), np.searchsorted(part[order], np.arange(len(centre)), "right")
    reach = min(PARTS, len(centre))
    near, exact = np.full((len(y), k + 1), -1, np.int64), np.full((len(y), k + 1), -2.0)
    for at in range(0, len(y), 2048):
        ask = y[at : at + 2048]
        ask32 = ask.astype(np.float32)
        score = ask32 @ centre.T
        probe = np.argpartition(-score, reach - 1, axis=1)[:, :reach] if reach < len(centre) else np.tile(np.arange(reach), (len(ask), 1))
        found = np.full((len(ask), reach, KEEP), -1, np.int64)
        value = np.full((len(ask), reach, KEEP), -(1 << 15), np.int16)
        flat = np.argsort(probe.ravel(), kind="stable")
        ends = np.searchsorted(probe.ravel()[flat], np.arange(len(centre) + 1))
        tables = q.tables(ask32)
        for c in range(len(centre)):
            who, nth = np.divmod(flat[ends[c] : ends[c + 1]], reach)
            mine = order[low[c] : high[c]]
            if not len(who) or not len(mine):
                continue
            got = np.ascontiguousarray(scanned(np.ascontiguousarray(tables[:, who].transpose(0, 2, 1)), packed[mine]).T)
            n = min(KEEP, len(mine))
            best = np.argpartition(got, len(mine) - n, axis=1)[:, len(mine) - n :]
            found[who, nth, :n] = mine[best]
            value[who, nth, :n] = np.take_along_axis(got, best, 1)
        found, value = found.reshape(len(ask), -1), value.reshape(len(ask), -1)
        if found.shape[1] > RERANK:
            best = np.argpartition(-value.astype(np.int32), RERANK - 1, axis=1)[:, :RERANK]
            found = np.take_along_axis(found, best, 1)
        rough = np.where(found >= 0, np.matmul(x32[found], ask32[:, :, None])[:, :, 0], -2)
        if found.shape[1] > 2 * k + 8:  # single precision leaves no doubt about the others
            found = np.take_along_axis(found, np.argpartition(-rough, 2 * k + 7, axis=1)[:, : 2 * k + 8], 1)
        cosine = np.where(found >= 0, np.einsum("ijk,ik->ij", x[found], ask), -2.0)
        names = np.where(found >= 0, rows[found], np.iinfo(np.int64).max)
        best = np.lexsort((names, -np.round(cosine, 12)), axis=1)[:, : k + 1]
        n = best.shape[1]
        near[at : at + 2048, :n] = np.where(np.take_along_axis(found, best, 1) >= 0, np.take_along_axis(names, best, 1), -1)
        exact[at : at + 2048, :n] = np.take_along_axis(cosine, best, 1)
    return near, exact


def _index(indexed: DataFrame, total: int, d: int, top: int, sample: int, probes: int) -> tuple[DataFrame, Broadcast, DataFrame]:
    """The placed vectors, the quantiser and the sizes (``cell, v, q``) of its cells; cells beyond BLOCK get centroids of their own."""
    spark = indexed.sparkSession
    cells = -(-total // top)
    wanted = max(sample, PER_CELL * cells)
    share = int(min(1.0, wanted / total) * 1_000_000)
    picked = indexed.where(F.pmod(F.xxhash64("row"), F.lit(1_000_000)) < share).select("row", "embedding").limit(2 * wanted).toArrow().sort_by("row")
    with one_thread():
        quantiser = fit(_units(picked.column("embedding").combine_chunks(), d), cells)
    sent = spark.sparkContext.broadcast(quantiser)
    while True:
        held = sent

        def place(batches: Iterator[pa.RecordBatch], held: Broadcast = held) -> Iterator[pa.RecordBatch]:
            q = held.value
            for b in batches:
                if not b.num_rows:
                    continue
                unit = _units(b.column("embedding"), d)
                with one_thread():
                    cells = q.cells(unit, probes).astype(np.int32)
                    codes = q.encode(unit, cells[:, 0])
                packed = codes[:, 0::2] | (codes[:, 1::2] << 4)
                bounds = np.arange(len(packed) + 1, dtype=np.int32) * packed.shape[1]
                code = pa.Array.from_buffers(pa.binary(), len(packed), [None, pa.py_buffer(bounds), pa.py_buffer(np.ascontiguousarray(packed))])
                near = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * cells.shape[1]), pa.array(cells.ravel()))
                yield pa.RecordBatch.from_arrays([b.column("row"), b.column("embedding"), b.column("asks"), code, near], names=["row", "embedding", "asks", "code", "cells"])

        placed = materialise(indexed.mapInArrow(place, "row bigint, embedding array<float>, asks boolean, code binary, cells array<int>"), "placed")
        sizes = placed.select(F.posexplode("cells").alias("p", "cell"), "asks").groupBy("cell").agg(F.sum((F.col("p") == 0).cast("int")).alias("v"), F.sum(F.col("asks").cast("int")).alias("q"))
        dense = sizes.where(F.col("v") > BLOCK)
        # Of each dense cell a sample that grows with its size; a cell whose vectors are too alike to be told apart stays.
        chosen = placed.join(dense.select("cell", (F.lit(PER_CELL) / top).alias("share")), F.col("cells")[0] == F.col("cell")).where(F.pmod(F.xxhash64("row"), F.lit(1_000_003)) < F.col("share") * 1_000_003).select("cell", "row", "embedding")
        inner = chosen.limit(2 * PER_CELL * cells).toArrow().sort_by([("cell", "ascending"), ("row", "ascending")])
        if not inner.num_rows:
            return placed, sent, sizes
        of, unit = inner.column("cell").to_numpy(), _units(inner.column("embedding").combine_chunks(), d).astype(np.float32)
        centroids, before = [quantiser.centroids], len(quantiser.centroids)
        for c in np.unique(of):
            mine = unit[of == c]
            centre, part = _parts(mine, len(mine) // PER_CELL)
            own = [mine[part == i].mean(0) for i in np.unique(part)]
            if len(own) > 1 and np.ptp(np.stack(own) @ own[0]) > 1e-4:
                centroids.append(np.stack(own))
        grown = np.concatenate(centroids)
        if len(grown) == before or before > 4 * cells:
            return placed, sent, sizes
        quantiser = Quantiser(grown, quantiser.books, quantiser.weight)
        sent = spark.sparkContext.broadcast(quantiser)


def neighbours(store: DataFrame, k: int = 5, d: int = 64, sample: int = SAMPLE, probes: int = PROBES, top: int = TOP) -> DataFrame:
    """``(row, near, cosine, rank)``: the k most similar other rows of every live row.

    ``store`` has ``row, chunk, embedding, at``; other columns are ignored. Null, zero, non-finite and wrong-sized
    embeddings take no part; equal cosines (to 1e-12) go to the smaller row; repeated rows of one chunk count once;
    with fewer than k other rows all of them come out, and an empty table gives an empty result.
    """
    spark = store.sparkSession
    live = materialise(live_rows(store, d), "live")
    first = materialise(live.withColumn("n", F.row_number().over(Window.partitionBy("c1", "c2").orderBy("row"))).where(F.col("n") <= k + 1), "classes")
    total = first.count()
    if not total:
        return spark.createDataFrame([], "row bigint, near bigint, cosine double, rank int")
    vectors = usable(store.where("chunk is not null and row is not null").select("row", "embedding"), d)
    indexed = vectors.join(first.select("row", (F.col("n") == 1).alias("asks")), "row").dropDuplicates(["row"])
    placed, sent, sizes = _index(materialise(indexed, "indexed"), total, d, top, sample, probes)
    cuts = sizes.select("cell", F.ceil(F.col("v") / BLOCK).cast("int").alias("vb"), F.ceil(F.col("q") / (probes * BLOCK)).cast("int").alias("qb")).where("vb > 0")
    h = F.xxhash64("row")
    others = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    # A vector asks in its own cell where it lies; only for other cells, or where a cell is in blocks, it is sent as a query.
    alone = (F.col("vb") == 1) & (F.col("qb") <= 1)
    values = placed.select("row", "embedding", "code", "asks", F.col("cells")[0].alias("cell")).join(cuts, "cell").select("row", "embedding", "code", (F.col("asks") & alone).alias("asks"), "cell", F.pmod(h, F.col("vb")).cast("int").alias("v"), F.explode(F.sequence(F.lit(0), F.greatest("qb", F.lit(1)) - 1)).alias("q"))
    asks = placed.where("asks").select("row", "embedding", F.lit(None).cast("binary").alias("code"), F.lit(True).alias("asks"), F.posexplode("cells").alias("p", "cell")).join(cuts, "cell").where((F.col("p") > 0) | ~alone).select("row", "embedding", "code", "asks", "cell", others("vb").alias("v"), F.pmod(h, F.col("qb")).cast("int").alias("q"))

    def scan(block: pa.Table) -> pa.Table:
        mine, theirs = block.filter(block.column("code").is_valid()), block.filter(block.column("asks"))
        if not mine.num_rows or not theirs.num_rows:
            return pa.table({"row": pa.array([], pa.int64()), "near": pa.array([], pa.int64()), "cosine": pa.array([], pa.float64())})
        packed = np.frombuffer(b"".join(mine.column("code").to_pylist()), np.uint8).reshape(mine.num_rows, -1)
        x, y = _units(mine.column("embedding").combine_chunks(), d), _units(theirs.column("embedding").combine_chunks(), d)
        with one_thread():
            near, cosine = _nearest(sent.value, x, packed, mine.column("row").to_numpy(), y, k)
        keep = near.ravel() >= 0
        return pa.table({"row": np.repeat(theirs.column("row").to_numpy(), k + 1)[keep], "near": near.ravel()[keep], "cosine": cosine.ravel()[keep]})

    found = values.unionByName(asks).groupBy("cell", "v", "q").applyInArrow(scan, "row bigint, near bigint, cosine double")
    by_score = Window.partitionBy("row").orderBy(F.round("cosine", 12).desc(), "near")
    best = found.withColumn("n", F.row_number().over(by_score)).where(F.col("n") <= k + 1)
    lists = materialise(best.groupBy("row").agg(F.sort_array(F.collect_list(F.struct("n", "near", "cosine"))).alias("top")), "lists")
    # One row asked for its class; every row of the class leaves itself out. The classes with more rows are salted.
    heads = first.where("n = 1").select("row", "c1", "c2")
    more = live.join(heads.select("row"), "row", "left_anti").withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int"))
    shared = lists.join(heads.join(first.where("n = 2").select("c1", "c2"), ["c1", "c2"], "left_semi"), "row").select("c1", "c2", "top", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])).alias("salt"))
    whole = lists.select("row", "top").unionByName(more.join(shared, ["c1", "c2", "salt"]).select("row", "top"))
    whole = whole.select("row", F.slice(F.filter("top", lambda x: x["near"] != F.col("row")), 1, k).alias("top"))
    return whole.select("row", F.posexplode("top").alias("rank", "x")).select("row", "x.near", "x.cosine", (F.col("rank") + 1).alias("rank"))


def neighbour_pairs(store: DataFrame, k: int = 5, **more: int) -> DataFrame:
    """``(row_a, row_b)``, row_a < row_b, where one is among the k nearest of the other."""
    return neighbours(store, k, **more).select(F.least("row", "near").alias("row_a"), F.greatest("row", "near").alias("row_b")).distinct()

"""Exact top-k by inner product in three phases with a uniform threshold.

The components of the vectors are cut into a few lists; a vector's score for a query is the sum of its partial scores
in the lists. Phase 1 takes the best k of each list among the vectors of each block that lie in the direction of the
query; the k-th best total among what was seen is a safe cutoff. Phase 2 hands each query its cutoff: a vector that
reaches it has at least ``cutoff / lists`` in one list, so only lists that may hold entries from that uniform threshold on
are multiplied, one after the other, and a vector is dropped once what it has so far and the bounds of its other lists fall
short of the cutoff. Phase 3 resolves the missing scores of those that are left, pair by pair. The bounds come from the
groups around pivots that a block's vectors are in: a list's partial score is that of the group's centre and at most the
product of the query's length and the vector's distance from the centre, both within the list.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Rows of a block of candidates and of a block of queries: 32 MB and 128 KB at 64 components of 16 bits.
CANDIDATE_ROWS, QUERY_ROWS = 262_144, 1024
BLOCK = "part long, dim int, kind string, ids binary, vectors binary, cuts binary"
#: Vectors of a group on average; scores that are held at a time.
GROUP, CHUNK = 512, 4_000_000
#: Share of a portion's pairs up to which their missing scores are resolved pair by pair, and pairs at a time.
FEW, PAIRS = 1 / 16, 1 << 18
#: Vectors that phase 1 looks at for a query in each block: this share of them, and some times k.
SHARE, TIMES = 16, 4


def vectors(table: DataFrame, id_col: str, vector_col: str, scale: float) -> DataFrame:
    """(id, v): floor(scale * x) as doubles. Rows with a null id, a null or empty vector, or a null or non-finite
    component take no part."""
    x = F.col(vector_col).cast("array<double>")
    fine = F.forall(x, lambda e: e.isNotNull() & ~F.isnan(e) & (F.abs(e) != float("inf")))
    usable = table.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & (F.size(x) > 0) & fine)
    return usable.select(F.col(id_col).cast("long").alias("id"), F.transform(x, lambda e: e * F.lit(scale)).alias("v"))


def grouped(values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order of the rows in which those nearest to the same pivot, out of rows at even distances, lie together; and
    where each such group begins, with the number of rows at the end."""
    n = len(values)
    many = n // GROUP
    if many < 2 or not np.isfinite(values).all() or np.abs(values).max() > 1e100:
        return np.arange(n), np.array([0, n])
    pivots = values[np.linspace(0, n - 1, many).astype(int)].astype(float)
    half = (pivots**2).sum(axis=1) / 2
    near = np.concatenate([(values[k : k + 8192].astype(float) @ pivots.T - half).argmax(axis=1) for k in range(0, n, 8192)])
    order = np.argsort(near, kind="stable")
    return order, np.append(np.flatnonzero(np.append(True, np.diff(near[order]) != 0)), n)


def packed(ids: np.ndarray, values: np.ndarray) -> dict:
    """A block: its vectors in groups, with 16 bits a component where that holds them."""
    order, cuts = grouped(values)
    kind = "<i2" if not values.size or np.abs(values).max() < 32768 else "<f8"
    return {"kind": kind, "ids": ids[order].astype("<i8").tobytes(), "vectors": values[order].astype(kind).tobytes(), "cuts": cuts.astype("<i8").tobytes()}


def blocks(rows: DataFrame, size: int, n: int) -> DataFrame:
    """Rows dealt evenly into ``n`` parts, each packed into blocks of at most ``size`` vectors of one length."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}

        def out(dim: int) -> pa.RecordBatch:
            ids = np.concatenate([x[0] for x in held[dim]])
            values = np.concatenate([x[1] for x in held[dim]])
            held[dim] = []
            return pa.RecordBatch.from_pylist([{"part": TaskContext.get().partitionId(), "dim": dim} | packed(ids, values)], SCHEMA)

        for batch in batches:
            ids = batch.column("id").to_numpy(zero_copy_only=False)
            column = batch.column("v")
            dims = np.diff(column.offsets.to_numpy())
            flat = np.floor(column.flatten().to_numpy(zero_copy_only=False))
            first = np.cumsum(dims) - dims
            for dim in np.unique(dims).tolist():
                own = np.flatnonzero(dims == dim)
                for k in range(0, len(own), size):
                    some = own[k : k + size]
                    held.setdefault(dim, []).append((ids[some], flat[first[some][:, None] + np.arange(dim)]))
                    if sum(len(x[0]) for x in held[dim]) >= size:
                        yield out(dim)
        for dim in list(held):
            if held[dim]:
                yield out(dim)

    return rows.repartition(n).mapInArrow(run, BLOCK)


SCHEMA = pa.schema([("part", pa.int64()), ("dim", pa.int32()), ("kind", pa.string()), ("ids", pa.binary()), ("vectors", pa.binary()), ("cuts", pa.binary())])


def unpack(row: dict, side: str) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(row[f"{side}_ids"], "<i8"), np.frombuffer(row[f"{side}_vectors"], row[f"{side}_kind"]).reshape(-1, row["dim"])


def exact(q: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Both in a type in which all sums of their products are exact: floating point where it holds them, else Python
    integers."""
    bound = float(np.abs(q.astype(float)).max(initial=0)) * float(np.abs(c.astype(float)).max(initial=0)) * q.shape[1]
    if bound < 2**53:
        kind = np.float32 if bound < 2**24 else np.float64
        return q.astype(kind), c.astype(kind)
    whole = np.frompyfunc(int, 1, 1)
    return whole(q.astype(float)), whole(c.astype(float))


def spans(dim: int, lists: int) -> list[slice]:
    """The components of each list."""
    return [slice(int(at[0]), int(at[-1]) + 1) for at in np.array_split(np.arange(dim), min(lists, dim))]


def all_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Partial scores of every query with every candidate."""
    return q @ c.T


def pair_products(q: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Partial scores of each query with the candidate beside it."""
    return (q * c).sum(axis=1)


def cells(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """(query ids, query vectors, candidate ids, candidate vectors, where their groups begin, row) of each cell."""
    for batch in batches:
        for row in batch.to_pylist():
            yield *unpack(row, "q"), *unpack(row, "c"), np.frombuffer(row["c_cuts"], "<i8"), row


def portions(cuts: np.ndarray, wanted: np.ndarray) -> Iterator[tuple[int, np.ndarray, slice]]:
    """(group, queries, candidates) of each group that some query wants, in pieces whose scores fit in memory.
    ``wanted``: queries x groups."""
    for g, (start, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
        own = np.flatnonzero(wanted[:, g])
        step = max(1, CHUNK // max(1, len(own)))
        for k in range(start, end if len(own) else start, step):
            yield g, own, slice(k, min(end, k + step))


def centres(c: np.ndarray, cuts: np.ndarray, of: list[slice]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean of each group; per group and list the greatest distance of its vectors from that; the greatest in all."""
    mean, radius, whole = np.zeros((len(cuts) - 1, c.shape[1])), np.zeros((len(cuts) - 1, len(of))), np.zeros(len(cuts) - 1)
    with np.errstate(all="ignore"):
        for g, (start, end) in enumerate(zip(cuts[:-1].tolist(), cuts[1:].tolist())):
            own = c[start:end].astype(float)
            mean[g] = own.mean(axis=0)
            away = (own - mean[g]) ** 2
            radius[g] = [np.sqrt(away[:, at].sum(axis=1).max()) for at in of]
            whole[g] = np.sqrt(away.sum(axis=1).max())
    return mean, radius, whole


def best_of(found: list[tuple], k: int) -> tuple:
    """Of (query, id, score) arrays each query's ``k`` highest scores, ties to smaller ids."""
    if not found:
        return np.zeros(0, int), np.zeros(0, int), np.zeros(0)
    query, ids, score = (np.concatenate(x) for x in zip(*found))
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.append(True, np.diff(query) != 0)
    place = np.arange(len(query)) - np.flatnonzero(first)[np.cumsum(first) - 1] if len(query) else np.zeros(0, int)
    return query[place < k], ids[place < k], score[place < k]


def kept(found: list[tuple], k: int) -> list[tuple]:
    """``found``, cut to the best once it has grown, so that it stays within memory."""
    return [best_of(found, k)] if sum(len(x[0]) for x in found) > CHUNK else found


def long(x) -> int:
    return int(max(-(2**63), min(2**63 - 1, int(x))))


def local_lists(k: int, lists: int):
    """Phase 1: for each query and block, of the groups whose centres score best the vectors that are among the best k
    of a list; totals of these, the best k of them per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, q, ci, c, cuts, row in cells(batches):
            of = spans(q.shape[1], lists)
            with np.errstate(all="ignore"):
                order = np.argsort(-np.nan_to_num(q.astype(float) @ centres(c, cuts, of)[0].T), axis=1, kind="stable")
            sizes = np.diff(cuts)[order]
            near = np.cumsum(sizes, axis=1) - sizes < max(TIMES * (k + 1), len(ci) // SHARE)
            wanted = np.zeros(order.shape, bool)
            np.put_along_axis(wanted, order, near, axis=1)
            found: list[tuple] = []
            for _, own, at in portions(cuts, wanted):
                qs, cs = exact(q[own], c[at])
                parts = [all_products(qs[:, x], cs[:, x]) for x in of]
                tops = [np.argpartition(-p, k - 1, axis=1)[:, :k] if p.shape[1] > k else np.broadcast_to(np.arange(p.shape[1]), p.shape) for p in parts]
                seen = np.sort(np.concatenate(tops, axis=1), axis=1)
                totals = sum((np.take_along_axis(p, seen, axis=1) for p in parts[1:]), np.take_along_axis(parts[0], seen, axis=1))
                once = np.append(np.ones((len(own), 1), bool), np.diff(seen, axis=1) != 0, axis=1) & (ci[at][seen] != qi[own][:, None])
                r, n = np.nonzero(once)
                found = kept([*found, (own[r], ci[at][seen[r, n]], totals[r, n])], k)
            r, _, score = best_of(found, k)
            yield pa.RecordBatch.from_arrays([pa.array(qi[r], pa.int64()), pa.array(np.full(len(r), row["q_part"]), pa.int64()), pa.array([long(x) for x in score.tolist()], pa.int64())], ["query_id", "q_part", "score"])

    return run


def collect(q: np.ndarray, c: np.ndarray, of: list[slice], mean: np.ndarray, radius: np.ndarray, cutoff: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Phases 2 and 3 for the vectors of one group: (query, vector, total) of all pairs that may reach the cutoff, with
    exact totals. ``mean`` and ``radius`` (per list) are the group's.

    Bounds are in floating point, so they are widened by more than it can be off. Where sums need Python integers,
    nothing is dropped."""
    q, c = exact(q, c)
    total = np.zeros((len(q), len(c)), q.dtype)
    if q.dtype == object:
        for at in of:
            total = total + all_products(q[:, at], c[:, at])
        r, v = np.indices(total.shape).reshape(2, -1)
        return r, v, total[r, v]
    x, away = q.astype(float), (c - mean) ** 2
    centre = np.stack([x[:, at] @ mean[at] for at in of], axis=1)
    length = np.stack([np.sqrt((x[:, at] ** 2).sum(axis=1)) for at in of], axis=1)
    apart = np.stack([np.sqrt(away[:, at].sum(axis=1)) for at in of])
    size = np.sqrt((x**2).sum(axis=1)) * np.sqrt((c.astype(float) ** 2).sum(axis=1).max(initial=0))
    cut = cutoff - 1e-6 - (1e-5 if q.dtype == np.float32 else 1e-9) * size - np.where(np.isfinite(cutoff), np.abs(cutoff), 0) * 1e-12
    threshold = cut / len(of)
    high = centre + length * radius >= threshold[:, None]  # the list may hold an entry from the threshold on
    missing = np.ones(centre.shape)
    beside = np.vstack([apart, np.ones(len(c))]).astype(q.dtype)

    def reachable(rows: np.ndarray | slice) -> np.ndarray:
        left = missing[rows]
        need = np.column_stack([-left * length[rows], cut[rows] - (left * centre[rows]).sum(axis=1)])
        return total[rows] >= need.astype(q.dtype) @ beside

    everything = slice(None)
    alive = reachable(everything)
    entry = np.zeros(alive.shape, bool)
    # lists of much weight come first, as they leave the least to bounds
    for n in np.argsort(-(length.mean(axis=0) * apart.mean(axis=1)), kind="stable").tolist():
        if alive.mean() <= FEW:
            break
        rows, columns = alive.any(axis=1) & high[:, n], alive.any(axis=0)
        if rows.mean() > 0.5 and columns.mean() > 0.5:
            part = all_products(q[:, of[n]], c[:, of[n]])
            total += part
            rows = columns = everything
        elif rows.any():
            part = all_products(q[rows][:, of[n]], c[columns][:, of[n]])
            total[np.ix_(rows, columns)] += part
        else:
            continue
        missing[rows, n] = 0
        alive[rows] &= reachable(rows)
        if not high.all():
            seen = part >= threshold[rows][:, None]
            if rows is everything:
                entry |= seen
            else:
                entry[np.ix_(rows, columns)] |= seen
    else:
        # a vector that has no entry from the threshold on, nor a list left that may hold one, falls short
        alive &= entry | ~missing.any(axis=1)[:, None]
    r, v = np.nonzero(alive)
    sums = total[r, v]
    for k in range(0, len(r), PAIRS):
        for n, at in enumerate(of):
            some = k + np.flatnonzero(missing[r[k : k + PAIRS], n])
            sums[some] += pair_products(q[r[some]][:, at], c[v[some]][:, at])
    return r, v, sums


def sufficient(k: int, lists: int):
    """Phases 2 and 3: of the groups that may hold a vector from the cutoff on, the entries from the uniform threshold
    on, their exact totals, and of those that reach the cutoff the best k per cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for qi, q, ci, c, cuts, row in cells(batches):
            # the least 64-bit score may stand for a lower one
            known = {x["query_id"]: x["cutoff"] for x in row["cutoffs"] or [] if x["cutoff"] > -(2**63)}
            whole_cutoff = np.array([known.get(i, -np.inf) for i in qi.tolist()], object)
            cutoff = whole_cutoff.astype(float)
            of = spans(q.shape[1], lists)
            mean, radius, whole = centres(c, cuts, of)
            with np.errstate(all="ignore"):
                length = np.sqrt((q.astype(float) ** 2).sum(axis=1))[:, None]
                reach = length * (whole + 1e-9 * (whole + np.sqrt((mean**2).sum(axis=1)))) + np.where(np.isfinite(cutoff), np.abs(cutoff), 0)[:, None] * 1e-12
                # also true where a bound isn't a number
                wanted = ~(q.astype(float) @ mean.T + reach + 1e-6 < cutoff[:, None])
            found: list[tuple] = []
            for g, own, at in portions(cuts, wanted):
                r, v, total = collect(q[own], c[at], of, mean[g], radius[g], cutoff[own])
                enough = total >= (whole_cutoff if total.dtype == object else cutoff)[own][r]
                fits = (ci[at][v] != qi[own][r]) & enough.astype(bool)
                found = kept([*found, (own[r[fits]], ci[at][v[fits]], total[fits])], k)
            r, ids, score = best_of(found, k)
            yield pa.RecordBatch.from_arrays([pa.array(qi[r], pa.int64()), pa.array(ids, pa.int64()), pa.array([long(x) for x in score.tolist()], pa.int64())], ["query_id", "vec_id", "score"])

    return run


def top_k(table: DataFrame, queries: DataFrame, k: int = 20, lists: int = 4, scale: float = 64.0, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """The ``k`` rows of ``table`` with the highest integer inner product for each row of ``queries``: query_id, rank
    (from 1), vec_id, score; ties go to the smaller id.

    A row never answers a query of its own id. Vectors of another length than the query's take no part, nor do rows
    with a null id or vector or with null or non-finite components. Repeated rows of ``table`` count as often as they
    are there; queries of the same id count once, with the largest vector. Fewer candidates than ``k`` are all
    returned; empty tables give an empty result; other columns are ignored. Scores beyond 64 bits are returned as the
    nearest 64-bit integer.

    Query blocks meet candidate blocks through a join on the candidate part; a block has a bounded number of vectors
    and a cell gives at most k rows per query, so neither equal vectors nor ties add rows. Cutoffs travel with the
    block of their queries; nothing is collected or broadcast.
    """
    rows = vectors(table, id_col, vector_col, scale)
    asked = vectors(queries, id_col, vector_col, scale).groupBy("id").agg(F.max("v").alias("v"))
    n_rows, n_asked, cores = rows.count(), asked.count(), table.sparkSession.sparkContext.defaultParallelism
    n = max(1, -(-n_rows // CANDIDATE_ROWS), min(2 * cores, -(-n_rows // 2048)))
    candidate = blocks(rows, CANDIDATE_ROWS, n).select("part", "dim", *[F.col(c).alias(f"c_{c}") for c in ("kind", "ids", "vectors", "cuts")])
    asked_blocks = blocks(asked, QUERY_ROWS, max(1, -(-n_asked // QUERY_ROWS))).select(F.col("part").alias("q_part"), "dim", *[F.col(c).alias(f"q_{c}") for c in ("kind", "ids", "vectors")])

    def grid(asked_blocks: DataFrame) -> DataFrame:
        dealt = asked_blocks.withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long"))))
        return dealt.join(candidate, ["part", "dim"])

    local = grid(asked_blocks).mapInArrow(local_lists(k, lists), "query_id long, q_part long, score long")
    by_score = Window.partitionBy("query_id").orderBy(F.col("score").desc())
    kth = local.withColumn("at", F.row_number().over(by_score)).where(F.col("at") <= k)
    # a query with fewer than k entries so far has no cutoff: everything is sufficient
    cutoffs = kth.groupBy("query_id").agg(F.max("q_part").alias("cut_part"), F.min("score").alias("cutoff"), F.count(F.lit(1)).alias("n")).where(F.col("n") == k)
    per_block = cutoffs.groupBy("cut_part").agg(F.collect_list(F.struct("query_id", "cutoff")).alias("cutoffs"))
    informed = asked_blocks.join(per_block, F.col("q_part") == F.col("cut_part"), "left").drop("cut_part")
    entries = grid(informed).mapInArrow(sufficient(k, lists), "query_id long, vec_id long, score long")
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return entries.withColumn("rank", F.row_number().over(best)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def query(spark, sf_dir: str) -> DataFrame:
    """The 20 best of all ``embeddings`` for each row whose vec_id is divisible by 20."""
    table = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_k(table, table.where(F.col("vec_id") % 20 == 0))


SQL = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 20 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""

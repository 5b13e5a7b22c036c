"""Mixing sources to target weights with hash-threshold histograms; DataFrame operations only.

Each source gets a number of words as its target. A document is repeated ``floor(target / source size)`` times, and
what is then still missing comes from the documents whose hash lies below the source's threshold. The threshold is
found without sorting documents: their sizes are summed by source and hash bucket, the bucket in which the budget
ends is cut into finer buckets, and so on until the boundary holds one document.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..shared import discard, store

WORD = r"[^\x20\x09-\x0D]+"
HASH_BITS, LEVEL_BITS = 60, 12
#: Threshold tables of more sources than this are joined by a shuffle, not broadcast.
BROADCAST_SOURCES = 4096
#: Copies of one row that are numbered at a time.
COPIES = 65_536


def word_count(text):
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def selection_hash(doc_id, text):
    """60 bits that depend on id and text only, so that reruns agree and rows with a null id still differ."""
    own = F.md5(F.coalesce(text, F.lit("")))
    return F.conv(F.substring(F.md5(F.concat(F.coalesce(doc_id.cast("string"), F.lit("")), F.lit("|"), own)), 1, 15), 16, 10).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[int, ...], share: float, cap: float) -> DataFrame:
    """(source, source_size) -> the same with ``target``. Weights repeat over the sources in code-point order, null
    last. What exceeds ``cap`` times a source's size goes to the others by weight, until none is above: the level
    ``lam`` at which min(cap, lam * weight) adds up to the whole, found from running sums over the sorted sources."""
    order = Window.orderBy(F.col("source").asc_nulls_last())
    weight = F.element_at(F.array(*map(F.lit, weights)), ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int"))
    x = sizes.withColumn("w", weight.cast("double")).withColumn("cap", cap * F.col("source_size"))
    by_level = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    before = F.coalesce(F.sum("cap").over(by_level.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    left = F.sum("w").over(by_level.rowsBetween(0, Window.unboundedFollowing))
    everything = Window.partitionBy()
    x = x.withColumn("lam_i", (share * F.sum("source_size").over(everything) - before) / left)
    lam = F.max(F.when(F.col("lam_i") <= F.col("cap") / F.col("w"), F.col("lam_i"))).over(everything)
    return x.withColumn("lam", lam).select("source", "source_size", F.least(F.col("cap"), F.coalesce(F.col("lam") * F.col("w"), F.col("cap"))).alias("target"))


class Mix:
    """The thresholds of one mix, and their application to tables with the columns ``source`` and ``hash``."""

    def __init__(self, sized: DataFrame, weights: tuple[int, ...], share: float, cap: float):
        """``sized``: source, size, hash; small rows that are read once per level."""
        self.sized, self.cap, self.bits = sized, cap, 0
        targets = source_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
        base = F.coalesce(F.floor(F.col("target") / F.nullif(F.col("source_size"), F.lit(0))), F.lit(0)).cast("long")
        bounds = targets.withColumn("base", base).withColumn("rest", F.col("target") - F.col("base") * F.col("source_size"))
        nothing = F.lit(0).cast("long")
        self.bounds = store(bounds.select("source", "source_size", "target", "base", "rest", nothing.alias("prefix"), nothing.alias("unit"), nothing.alias("rows")), "mix-bounds")
        self.few = self.bounds.count() <= BROADCAST_SOURCES
        single = False
        while self.bits < HASH_BITS and not single:
            single = self._refine()
        self.ties = not single

    def _joined(self, rows: DataFrame, bounds: DataFrame) -> DataFrame:
        b = bounds.select(*[F.col(c).alias(f"__mix_{c}") for c in bounds.columns])
        return rows.join(F.broadcast(b) if self.few else b, F.col("source").eqNullSafe(F.col("__mix_source")))

    def _refine(self) -> bool:
        """Cut each source's boundary bucket into 2^LEVEL_BITS; True when every boundary is a single row at most."""
        at, self.bits = self.bits, self.bits + LEVEL_BITS
        inside = self._joined(self.sized, self.bounds).where(F.shiftright("hash", HASH_BITS - at) == F.col("__mix_prefix"))
        histogram = inside.groupBy("source", F.shiftright("hash", HASH_BITS - self.bits).alias("bucket")).agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("n"))
        so_far = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
        running = histogram.withColumn("before", F.coalesce(F.sum("words").over(so_far), F.lit(0)))
        crossed = self._joined(running, self.bounds).where(F.col("before") + F.col("words") > F.col("__mix_rest"))
        first = crossed.groupBy(F.col("source").alias("crossed")).agg(F.min(F.struct("bucket", "before", "words", "n")).alias("x"))
        coarser = self.bounds
        self.bounds = store(
            # where no bucket crosses the budget, every document lies below the threshold
            self.bounds.join(first, F.col("source").eqNullSafe(F.col("crossed")) & F.col("x").isNotNull(), "left").select(
                "source", "source_size", "target", "base",
                (F.col("rest") - F.coalesce("x.before", F.lit(0))).alias("rest"),
                F.coalesce("x.bucket", F.lit(1 << self.bits)).alias("prefix"),
                F.coalesce("x.words", F.lit(0)).alias("unit"),
                F.coalesce("x.n", F.lit(0)).alias("rows"),
            ),
            "mix-bounds",
        )
        discard(coarser)
        return (self.bounds.agg(F.max("rows")).first()[0] or 0) <= 1

    def copies(self, rows: DataFrame) -> DataFrame:
        """``rows`` with __mix_copies (and the bounds' columns, all prefixed), but for those that ``tied`` gives."""
        place = F.shiftright("hash", HASH_BITS - self.bits)
        at_bound = place == F.col("__mix_prefix")
        boundary = at_bound & (2 * F.col("__mix_rest") > F.col("__mix_unit"))
        once_more = ((place < F.col("__mix_prefix")) | boundary) & (F.col("__mix_base") < self.cap)
        found = self._joined(rows, self.bounds)
        if self.ties:
            found = found.where(~(at_bound & (F.col("__mix_rows") > 1)))
        return found.withColumn("__mix_copies", F.col("__mix_base") + F.when(once_more, 1).otherwise(0))

    def tied(self, rows: DataFrame, row: str) -> DataFrame:
        """The rows of boundaries that hold repeated rows only, one for all that are equal in the column ``row``, with the
        bounds' columns, their number __mix_n, and of how many of them one copy more is taken, __mix_more."""
        at_bound = F.shiftright("hash", HASH_BITS - self.bits) == F.col("__mix_prefix")
        found = self._joined(rows, self.bounds).where(at_bound & (F.col("__mix_rows") > 1))
        kind = F.sha2(F.to_json(F.struct(row)), 256).alias("__mix_kind")
        others = [F.first(c).alias(c) for c in found.columns if c != "source"]
        kinds = found.groupBy("source", kind).agg(F.count(F.lit(1)).alias("__mix_n"), *others)
        before = F.coalesce(F.sum("__mix_n").over(Window.partitionBy("source").orderBy("__mix_kind").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        wanted = F.when(F.col("__mix_base") < self.cap, F.ceil(F.col("__mix_rest") * F.col("__mix_rows") / F.col("__mix_unit") - 0.5)).otherwise(0)
        return kinds.withColumn("__mix_more", F.greatest(F.lit(0), F.least(F.col("__mix_n"), wanted - before)))


def times(rows: DataFrame, n) -> DataFrame:
    """Each row ``n`` times, in blocks, so that no array of the numbers of all copies is made."""
    blocks = rows.withColumn("__mix_n", n).where("__mix_n > 0").withColumn("__mix_block", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__mix_n") - 1) / COPIES))))
    last = F.least(F.col("__mix_n"), (F.col("__mix_block") + 1) * COPIES)
    return blocks.withColumn("__mix_copy", F.explode(F.sequence(F.col("__mix_block") * COPIES + 1, last)))


def _sized(docs: DataFrame) -> DataFrame:
    hashed = selection_hash(F.col("doc_id"), F.col("text")).alias("hash")
    return store(docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), hashed), "mix-sizes")


def mix(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """How often each document goes into the mix.

    ``docs`` needs doc_id, text and source; other columns are ignored. Returns doc_id, source, size, source_size,
    target, copies, taken, one row per input row.

    A null text has size 0; a null source is a source of its own and comes last. Documents of size 0 are copied with
    the rest but take no words. Rows of equal id and text share a hash; where they are at the boundary, as many of them
    as the target needs are taken, whichever, as they are equal: so a source misses its target by half of its boundary
    document. An empty table gives an empty result. Documents are never sorted or collected: a histogram has at most
    4096 rows per source, after partial aggregation, however many rows a source holds. Only the sources themselves, one
    row each, go through one task, as their order gives their weights.
    """
    sized = _sized(docs)
    plan = Mix(sized.select("source", "size", "hash"), weights, share, cap)
    wanted = ["doc_id", "source", "size", F.col("__mix_source_size").alias("source_size"), F.col("__mix_target").alias("target"), F.col("__mix_copies").alias("copies"), (F.col("__mix_copies") * F.col("size")).alias("taken")]
    out = plan.copies(sized).select(*wanted)
    if plan.ties:
        tied = plan.tied(sized.withColumn("__mix_row", F.struct("doc_id", "size")), "__mix_row")
        more = times(tied, F.col("__mix_more")).withColumn("__mix_copies", F.col("__mix_base") + 1)
        fewer = times(tied, F.col("__mix_n") - F.col("__mix_more")).withColumn("__mix_copies", F.col("__mix_base"))
        out = out.union(more.select(*wanted)).union(fewer.select(*wanted))
    return out


def mixed(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The mix itself: the rows of ``docs`` with all their columns, each as often as ``mix`` says. Once the thresholds
    are known, documents are filtered where they are read; texts are not shuffled, but for repeated rows at a boundary.
    Of those that differ in other columns only, the ones taken once more are chosen by a digest of the whole row.
    Columns of any name are carried along."""
    plan = Mix(_sized(docs).select("source", "size", "hash"), weights, share, cap)
    key = selection_hash(F.col("doc_id"), F.col("text"))
    packed = docs.select("source", key.alias("hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("__mix_row"))
    chosen = plan.copies(packed).where(F.col("__mix_copies") > 0)
    out = chosen.withColumn("__mix_copy", F.explode(F.sequence(F.lit(1), F.col("__mix_copies").cast("int")))).select("__mix_row.*")
    if plan.ties:
        tied = plan.tied(packed, "__mix_row")
        out = out.union(times(tied, F.col("__mix_base") * F.col("__mix_n") + F.col("__mix_more")).select("__mix_row.*"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """The mix of all ``documents`` by source: words taken of each."""
    out = mix(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return out.select("doc_id", "size", "source_size", F.round("target", 4).alias("target"), "taken")


SQL = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '') || '|' || md5(coalesce(text, ''))), 1, 15))::BIGINT AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (
  SELECT *, CASE (rn - 1) % 3 WHEN 0 THEN 3.0 WHEN 1 THEN 1.0 ELSE 2.0 END::DOUBLE AS w, 2.0::DOUBLE * source_size AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(w) OVER (ORDER BY cap / w, rn ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lam_i FROM w),
t AS (
  SELECT source, source_size, least(cap, coalesce(max(CASE WHEN lam_i <= cap / w THEN lam_i END) OVER () * w, cap)) AS target FROM l),
b AS (
  SELECT *, coalesce(floor(target / nullif(source_size, 0)), 0)::BIGINT AS base FROM t),
o AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY h) AS place FROM d),
u AS (
  SELECT *, sum(size) OVER (PARTITION BY source ORDER BY place) AS upto FROM o),
x AS (
  SELECT u.doc_id, u.size, b.source_size, b.target, b.base,
         CASE WHEN b.base >= 2 THEN 0
              WHEN upto <= target - base * source_size THEN 1
              WHEN upto - size > target - base * source_size THEN 0
              WHEN 2 * (target - base * source_size - (upto - size)) > size THEN 1 ELSE 0 END AS extra
  FROM u JOIN b ON u.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, round(target, 4) AS target, ((base + extra) * size)::BIGINT AS taken FROM x
"""

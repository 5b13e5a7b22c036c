"""Near-duplicate classes of documents: weighted signatures, banded candidates, exact verification, components.

Shingles of five words are weighted by how often the document holds them; two documents are linked if their weighted
Jaccard similarity is 0.8 or more, and a class is a connected component of the links. Copies whose words are equal are
one node from the start.

Documents that share a band are candidates. A bucket's members are first compared with one of them only, the one that
meets most others in its buckets: of a group of copies that is their original, or what is nearest to it. What that links
becomes one component. Buckets that then still hold several components form groups, through the nodes that they share. A
group has one centre; members of different components can be similar only if they share enough of what the centre
lacks, and they are looked for by the rarest shingles of that. So the rows grow with the members, not with their pairs.

A bucket, group or label may hold a large part of all rows. Spark splits such a key in a join only if both sides come
straight from a shuffle, which a side that has just been aggregated by that key doesn't; so these are stored first. It
splits between the tasks that a key's rows come from, so labels are stored in files of bounded rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import shared
from ..shared import discard
from .common import pieces, slices
from .dartminhash import U, mix, signatures

WORDS = 5
#: 38 bands of 8 coordinates find a pair of similarity 0.8 with probability 0.999, one of 0.3 with 0.0025.
BANDS, ROWS = 38, 8
#: Similarity from which documents are linked, as a fraction.
LINK = (4, 5)
#: Rows of a file of labels, at most.
FILE = 50_000
#: Bytes of texts in a slice (one text at least), and characters that are looked at at a time.
SLICE, PIECE = 400_000, 250_000
SIGNED = "doc_id long, text_hash long, node long, bands array<long>, size long, shingles binary, counts binary"


def store(df: DataFrame, name: str) -> DataFrame:
    """``shared.store``; labels go into several files where they are many."""
    return shared.store(df, name, FILE if name == "dup-labels" else 0)


@lru_cache(maxsize=1)
def letters() -> tuple[np.ndarray, np.ndarray]:
    """By code point: whether it belongs to a word, and a random number for its lower case."""
    n = 0x110000
    lower, inside = np.arange(n, dtype=np.uint64), np.zeros(n, bool)
    for c in range(0x33480):
        s = chr(c)
        inside[c] = s.isalnum()
        if inside[c] and len(s.lower()) == 1:
            lower[c] = ord(s.lower())
    return inside, mix(lower + U(0x9E3779B97F4A7C15))


ODD = U(0xD6E8FEB86659FD93)
INVERSE = U(pow(int(ODD), -1, 2**64))


def powers(base: U, n: int) -> np.ndarray:
    out = np.full(n, base, U)
    out[:1] = 1
    return np.cumprod(out, dtype=U)


def hashed_words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Number of the text and hash of each word, in order."""
    inside, codes = letters()
    found = [(np.zeros(0, np.int32), np.zeros(0, U))]
    for parts, of, _ in pieces(texts, PIECE):
        sizes = np.array([len(t) for t in parts], np.int64)
        raw = np.frombuffer((" " + " ".join(parts) + " ").encode("utf-32-le", "surrogatepass"), "<u4")
        word = inside[raw]
        change = np.diff(word.astype(np.int8))
        start, end = np.flatnonzero(change == 1) + 1, np.flatnonzero(change == -1) + 1
        part = np.searchsorted(np.cumsum(sizes + 1) - sizes, start, "right") - 1
        sums = np.concatenate([[U(0)], np.cumsum(np.where(word, codes[raw], U(0)) * powers(ODD, len(raw)), dtype=U)])
        found.append((np.array(of, np.int32)[part], mix((sums[end] - sums[start]) * powers(INVERSE, len(raw) + 1)[start])))
    return np.concatenate([x for x, _ in found]), np.concatenate([x for _, x in found])


def shingled(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Digest of each text's words in order (0: no words), and (text, shingle, count) rows, sorted by text.

    Words are runs of letters and digits in lower case. Texts of under five words have one shingle, of all of them."""
    text, hashed = hashed_words(texts)
    n = np.bincount(text, minlength=len(texts))
    first = np.cumsum(n) - n
    at = np.arange(len(text)) - first[text]
    digest = np.zeros(len(texts), U)
    np.add.at(digest, text, mix(hashed ^ mix((at + 1).astype(U))))
    digest = np.where(n > 0, np.maximum(mix(digest + n.astype(U)), U(1)), U(0))
    window = np.zeros(max(0, len(text) - WORDS + 1), U)
    for k in range(WORDS):
        window = window * ODD + hashed[k : len(text) - WORDS + 1 + k]
    whole = text[: len(window)] == text[WORDS - 1 :] if len(window) else np.zeros(0, bool)
    short = np.flatnonzero((n > 0) & (n < WORDS))
    owner = np.concatenate([text[: len(window)][whole], short])
    shingle = np.concatenate([mix(window[whole]), digest[short]])
    order = np.lexsort((shingle, owner))
    owner, shingle = owner[order], shingle[order]
    new = np.flatnonzero(np.append(True, (np.diff(owner) != 0) | (shingle[1:] != shingle[:-1]))) if len(owner) else np.zeros(0, np.int64)
    return digest, owner[new], shingle[new], np.diff(np.append(new, len(owner)))


def sign(docs: DataFrame) -> DataFrame:
    """SIGNED: a node id (equal for equal words; null without words), a hash per band, and the weighted shingles."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text", SLICE):
            digest, owner, shingle, count = shingled([t or "" for t in batch.column("text").to_pylist()])
            nodes, first, back = np.unique(digest, return_index=True, return_inverse=True)
            rank = np.full(len(digest), -1)
            rank[first[nodes > 0]] = np.arange((nodes > 0).sum())
            own = np.flatnonzero(rank[owner] >= 0)  # one copy of each, in the order of the nodes
            own = own[np.argsort(rank[owner[own]], kind="stable")]
            owner, shingle, count = rank[owner[own]], shingle[own], count[own]
            n = int((nodes > 0).sum())
            drawn = signatures(owner, shingle, count.astype(float), n, BANDS * ROWS).reshape(n, BANDS, ROWS)
            bands = np.zeros((n, BANDS), U)
            for k in range(ROWS):
                bands = bands * ODD + mix(drawn[:, :, k])
            bands = mix(bands + mix(np.arange(1, BANDS + 1).astype(U)))
            parts = np.split(np.arange(len(owner)), np.cumsum(np.bincount(owner, minlength=n))[:-1]) if n else []
            small = (shingle >> U(32)).astype(np.uint32)
            sizes = np.bincount(owner, count, n).astype(np.int64).tolist() if n else []
            sets, weights = [], []
            for part in parts:
                values, place = np.unique(small[part], return_inverse=True)
                amounts = np.bincount(place, count[part]).astype("<u4")
                sets.append(values.astype("<u4").tobytes())
                weights.append(amounts.tobytes() if (amounts > 1).any() else b"")
            spare = int((nodes == 0).any())
            place = back.ravel() - spare
            values = bands.view(np.int64)
            rows = {
                "doc_id": batch.column("doc_id"),
                "text_hash": batch.column("text_hash"),
                "node": pa.array(digest.view(np.int64), mask=digest == 0),
                "bands": pa.array([values[p] if p >= 0 else [] for p in place.tolist()], pa.list_(pa.int64())),
                "size": pa.array([sizes[p] if p >= 0 else 0 for p in place.tolist()], pa.int64()),
                "shingles": pa.array([sets[p] if p >= 0 else b"" for p in place.tolist()], pa.binary()),
                "counts": pa.array([weights[p] if p >= 0 else b"" for p in place.tolist()], pa.binary()),
            }
            yield pa.RecordBatch.from_pydict(rows)

    return docs.selectExpr("cast(doc_id as long) as doc_id", "xxhash64(text) as text_hash", "text").mapInArrow(run, SIGNED)


def similar(a: bytes, a_counts: bytes, b: bytes, b_counts: bytes) -> float | None:
    """The weighted Jaccard similarity if it is LINK or more; exact but for clashes of 32-bit shingle hashes."""
    x, y = np.frombuffer(a, "<u4"), np.frombuffer(b, "<u4")
    m = np.frombuffer(a_counts, "<u4") if a_counts else np.ones(len(x), np.int64)
    n = np.frombuffer(b_counts, "<u4") if b_counts else np.ones(len(y), np.int64)
    total = int(m.sum()) + int(n.sum())
    if LINK[1] * min(int(m.sum()), int(n.sum())) < LINK[0] * max(int(m.sum()), int(n.sum())):
        return None
    _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
    common = int(np.minimum(m[i], n[j]).sum())
    return common / (total - common) if LINK[1] * common >= LINK[0] * (total - common) else None


def with_sets(rows: DataFrame, sets: DataFrame, *keys: str) -> DataFrame:
    """``rows`` with the shingles and counts of the node in each of the columns ``keys``."""
    for key in keys:
        rows = rows.join(sets.select(F.col("node").alias(key), F.col("shingles").alias(f"{key}_shingles"), F.col("counts").alias(f"{key}_counts")), key)
    return rows


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The (a, b) out of ``pairs`` that are similar, with their similarity."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns = [batch.column(c).to_pylist() for c in ("a_shingles", "a_counts", "b_shingles", "b_counts")]
            found = pa.array([similar(*row) for row in zip(*columns)], pa.float64())
            yield batch.select(["a", "b"]).append_column("similarity", found).filter(found.is_valid())

    return with_sets(pairs, sets, "a", "b").mapInArrow(run, "a long, b long, similarity double")


def contracted(links: DataFrame, labels: DataFrame) -> DataFrame:
    """The links (a, b) between labels, each once; those within a label are left out. A node without a label is its own."""
    for end in ("a", "b"):
        links = links.join(labels.select(F.col("node").alias(end), F.col("label").alias(f"{end}_label")), end, "left")
    ends = [F.coalesce(f"{end}_label", end) for end in ("a", "b")]
    return links.select(F.least(*ends).alias("a"), F.greatest(*ends).alias("b")).where("a <> b").distinct()


def relabelled(labels: DataFrame, later: DataFrame) -> DataFrame:
    """``labels`` (node, label), where labels that have a row in ``later`` are replaced by theirs. Both are stored tables."""
    return labels.join(later.select(F.col("node").alias("label"), F.col("label").alias("next")), "label", "left").select("node", F.coalesce("next", "label").alias("label"))


def components(links: DataFrame, labels: DataFrame | None) -> DataFrame:
    """(node, label): the least node of each component of the ``links`` (a, b) and of those that ``labels``, if given, are
    the result of.

    Links are contracted: every node takes the first of itself and its neighbours in an order that is drawn anew for every
    second round, and the links are carried over to what was taken, until none is left between different nodes. About half
    of a chain's nodes go in a round and a star is done in two, so all rounds together join few more rows than the first.
    What was taken is then followed from the last round back to the first."""
    if labels is not None:
        found = components(contracted(links, labels), None)
        added = found.join(labels, "node", "left_anti").select("node", "label")
        now = store(relabelled(labels, found).union(added), "dup-labels")
        discard(found)
        return now
    rest, taken = store(links.select("a", "b").where("a <> b"), "dup-links"), []
    while not taken or rest.limit(1).count():
        first = lambda c: F.struct(F.xxhash64(c, F.lit(len(taken) // 2)).alias("place"), F.col(c).alias("label"))
        ends = rest.select(F.col("a").alias("node"), F.col("b").alias("other")).union(rest.select("b", "a"))
        near = ends.groupBy("node").agg(F.min(first("other")).alias("near"))
        taken.append(store(near.select("node", F.least("near", first("node"))["label"].alias("label")), "dup-labels"))
        last, rest = rest, store(contracted(rest, taken[-1]), "dup-links")
        discard(last)
    discard(rest)
    now = taken.pop()
    while taken:
        last, before = now, taken.pop()
        now = store(relabelled(before, last), "dup-labels")
        discard(last)
        discard(before)
    names = store(now.groupBy("label").agg(F.min("node").alias("least")), "dup-least")
    named = store(now.join(names, "label").select("node", F.col("least").alias("label")), "dup-labels")
    discard(now)
    discard(names)
    return named


def classified(docs: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """The signed rows, (node, doc_id, text_hash, label) with one row per node: the row of its least id stands for it, and
    nodes of one class have the same label; and the verified links (a, b, similarity) between nodes."""
    signed = store(sign(docs), "dup-signed")
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("x")
    nodes = signed.where("node is not null").groupBy("node").agg(least, F.min("bands").alias("bands"))
    nodes = store(nodes.select("node", "x.doc_id", "x.text_hash", "bands"), "dup-nodes")
    placed = nodes.select("node", F.explode("bands").alias("bucket"))
    shared = store(placed.groupBy("bucket").agg(F.count(F.lit(1)).alias("n")).where("n > 1"), "dup-buckets")
    members = store(placed.join(shared, "bucket"), "dup-members")
    meets = members.groupBy("node").agg(F.sum("n").alias("meets"))
    members = store(members.join(meets, "node"), "dup-members")
    chosen = nodes.join(members.select("node").distinct(), "node").select(*[F.col(c).alias(f"own_{c}") for c in ("node", "doc_id", "text_hash")])
    own_row = (F.col("node") == F.col("own_node")) & F.col("doc_id").eqNullSafe(F.col("own_doc_id")) & (F.col("text_hash") == F.col("own_text_hash"))
    sets = store(signed.join(chosen, own_row).select("node", "size", "shingles", "counts").dropDuplicates(["node"]), "dup-sets")
    labels, links = linked(members, sets)
    known = nodes.select("node", "doc_id", "text_hash").join(labels, "node", "left")
    return signed, known.withColumn("label", F.coalesce("label", "node")), links


REST = "group long, node long, label long, size long, held long, need double, tokens array<struct<token: long, weight: long>>"
_TOKENS = pa.list_(pa.struct([("token", pa.int64()), ("weight", pa.int64())]))


def amounts(shingles: bytes, counts: bytes) -> tuple[np.ndarray, np.ndarray]:
    x = np.frombuffer(shingles, "<u4")
    return x, np.frombuffer(counts, "<u4").astype(np.int64) if counts else np.ones(len(x), np.int64)


def remainders(members: DataFrame, sets: DataFrame) -> DataFrame:
    """REST, one row per row of ``members`` (group, node, label, size, centre, least): what the node holds beyond the
    centre, how much it shares with it (held), and how much of the rest it must share with a similar one (need).

    Two nodes share at most the lesser held and what their rests share, and to be similar they must share 4/9 of the sum
    of their sizes. A similar node of the group has ``least`` or more, the least size there, and 4/5 of the node's own.
    So the rests share 4/9 (size + that) - held at least; where that is 0 or less they need share nothing."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for r in batch.to_pylist():
                (x, m), (y, n) = amounts(r["node_shingles"], r["node_counts"]), amounts(r["centre_shingles"], r["centre_counts"])
                _, i, j = np.intersect1d(x, y, assume_unique=True, return_indices=True)
                common = np.zeros(len(x), np.int64)
                common[i] = np.minimum(m[i], n[j])
                size, held, rest = r["size"], int(common.sum()), m - common
                need = LINK[0] * (size + max(r["least"], LINK[0] * size / LINK[1])) / (LINK[0] + LINK[1]) - held - 1e-6
                at = np.flatnonzero(rest)
                tokens = [{"token": t, "weight": w} for t, w in zip(x[at].tolist(), rest[at].tolist())]
                out.append((r["group"], r["node"], r["label"], size, held, need, tokens))
            kinds = [pa.int64()] * 5 + [pa.float64(), _TOKENS]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], ["group", "node", "label", "size", "held", "need", "tokens"])

    return with_sets(members, sets, "node", "centre").mapInArrow(run, REST)


def others(rest: DataFrame) -> DataFrame:
    """(a, b): nodes of one group and different components whose rests may share enough.

    Only shingles that several components hold count. A node's are put in the order of how many hold them, rarest first;
    similar nodes have one in common before what is left of either in that order weighs less than its need. From the
    first one in common on, they share no more than the lesser of what is left of each."""
    held = rest.select("group", "node", "label", "size", "held", "need", F.explode("tokens").alias("t")).select("group", "node", "label", "size", "held", "need", "t.token", "t.weight")
    several = held.groupBy("group", "token").agg(F.count(F.lit(1)).alias("n"), F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("group", "token", "n")
    several = store(several, "dup-several")
    ahead = Window.partitionBy("group", "node").orderBy("n", "token").rowsBetween(0, Window.unboundedFollowing)
    kept = held.join(several, ["group", "token"]).withColumn("left", F.sum("weight").over(ahead)).where("left >= need")
    kept = store(kept.select("group", "token", "node", "label", "size", "held", "left"), "dup-rest")
    x, y = (kept.select("group", "token", *[F.col(c).alias(f"{s}_{c}") for c in ("node", "label", "size", "held", "left")]) for s in "xy")
    total = F.col("x_size") + F.col("y_size")
    enough = (LINK[0] + LINK[1]) * (F.least("x_held", "y_held") + F.least("x_left", "y_left")) >= LINK[0] * total
    near = LINK[1] * F.least("x_size", "y_size") >= LINK[0] * F.greatest("x_size", "y_size")
    pairs = x.join(y, ["group", "token"]).where((F.col("x_label") < F.col("y_label")) & near & enough)
    return pairs.select(F.least("x_node", "y_node").alias("a"), F.greatest("x_node", "y_node").alias("b")).distinct()


def divided(members: DataFrame) -> DataFrame:
    """The ``members`` (group, label, ...) of groups with several labels."""
    several = members.groupBy("group").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("group")
    return members.join(store(several, "dup-divided"), "group")


def linked(members: DataFrame, sets: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, label) of the components of all links, and the links that were verified for it: (a, b, similarity), each pair
    once. ``members``: bucket, node, n (the bucket's number of nodes) and meets (the sum of n over the node's buckets)."""
    best = members.groupBy("bucket").agg(F.max(F.struct("meets", "node")).alias("x")).select("bucket", F.col("x.node").alias("centre"))
    best = store(best, "dup-centres")
    met = store(members.join(best, "bucket").where(F.col("node") != F.col("centre")).select("bucket", "n", "node", "centre"), "dup-met")
    pairs = store(met.select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b")).distinct(), "dup-pairs")
    links = store(verified(pairs, sets), "dup-verified")
    labels = components(links, None)
    # the pair of a bucket of two has been tested; other buckets are done when their other members are of one component
    told = met.where("n > 2").join(labels, "node", "left").select("bucket", "node", F.coalesce("label", "node").alias("label"))
    several = told.groupBy("bucket").agg(F.min("label").alias("low"), F.max("label").alias("high")).where("low <> high").select("bucket")
    several = store(several, "dup-split")
    open_ = store(met.join(several, "bucket").select(F.col("centre").alias("a"), F.col("node").alias("b")).distinct(), "dup-open")
    if not open_.limit(1).count():
        return labels, links
    sizes = sets.select("node", "size")
    weights = members.select("node", "meets").distinct()
    groups = store(components(open_, None).select(F.col("label").alias("group"), "node").join(sizes, "node").join(weights, "node"), "dup-groups")
    # Nodes that need share nothing beyond the centre are grouped anew, around the smallest of them: what then still need
    # share nothing with the others is similar to it, and so of its component.
    for chosen in (F.max_by("node", F.struct("meets", "node")), F.min_by("node", F.struct("size", "node"))):
        centres = store(groups.groupBy("group").agg(chosen.alias("centre"), F.min("size").alias("least")), "dup-centres")
        around = store(groups.join(centres, "group"), "dup-around")
        spokes = around.where("node <> centre").select(F.least("node", "centre").alias("a"), F.greatest("node", "centre").alias("b"))
        links, labels = joined(links, labels, verified(spokes.join(pairs, ["a", "b"], "left_anti"), sets))
        known = around.join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        rest = store(remainders(divided(known), sets), "dup-rest")
        links, labels = joined(links, labels, verified(others(rest).join(pairs, ["a", "b"], "left_anti"), sets))
        free = rest.where("need <= 0").select("group", "node")
        known = groups.join(free, ["group", "node"]).join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        groups = store(divided(known).select("group", "node", "size", "meets"), "dup-groups")
        if not groups.limit(1).count():
            break
    return labels, links


def joined(links: DataFrame, labels: DataFrame, more: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links and labels after ``more`` links have been found."""
    more = store(more, "dup-verified")
    if not more.limit(1).count():
        return links, labels
    return links.union(more), components(more, labels)


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, node, class_id, linked_id, similarity, n_links, one row per input row: documents of one class have the same
    class_id, its least doc_id.

    ``n_links`` is the number of links between different texts that were verified in the class; they connect all of it, but
    pairs that weren't needed for that are not counted. ``linked_id`` is the document (the least id of its text) that this
    row's text was verified against, of several the most similar one, and ``similarity`` what was found; both are null in
    a class of one text.

    Documents without a word (null and empty texts among them) have no node and are each in a class of their own.
    Repeated rows, and texts that differ in case and punctuation only, share a node. A null doc_id joins its class but
    never names it; class_id is null where no document of the class has an id. An empty table gives an empty result;
    columns other than doc_id and text are ignored. Node ids are 64-bit digests of the words.
    """
    signed, nodes, links = classified(docs)
    nodes = store(nodes.select("node", "doc_id", "label"), "dup-known")
    names = store(nodes.groupBy("label").agg(F.min("doc_id").alias("class_id")), "dup-names")
    links = links.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))
    both = links.select(F.col("a").alias("node"), F.col("b").alias("other"), "similarity", F.lit(1).alias("n")).union(links.select("b", "a", "similarity", F.lit(0)))
    best = both.groupBy("node").agg(F.max(F.struct("similarity", "other")).alias("x"), F.sum("n").alias("n")).select("node", "x.*", "n")
    best = store(best.join(nodes.select("node", "label"), "node"), "dup-best")
    counts = store(best.groupBy("label").agg(F.sum("n").alias("n_links")), "dup-counts")
    ids = best.join(nodes.select(F.col("node").alias("other"), F.col("doc_id").alias("linked_id")), "other").select("node", "linked_id", "similarity")
    per_node = nodes.join(names, "label").join(counts, "label", "left").select("node", "class_id", "n_links").join(ids, "node", "left")
    rows = signed.select("doc_id", "node")
    told = ["doc_id", "node", "class_id", "linked_id", "similarity", F.coalesce("n_links", F.lit(0)).alias("n_links")]
    none = [F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(0).cast("long")]
    with_words = rows.where("node is not null").join(store(per_node, "dup-classes"), "node").select(*told)
    return with_words.union(rows.where("node is null").select("doc_id", "node", F.col("doc_id").alias("class_id"), *none))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of ``docs``, with all their columns, without near duplicates: of each class the row with the least
    doc_id stays (of the least text hash among repeated ids; of rows equal in both, one). Documents without a word all
    stay. Columns of any name are carried along."""
    signed, nodes, _ = classified(docs)
    least = F.min(F.struct(F.col("doc_id").isNull().alias("unnamed"), "doc_id", "text_hash")).alias("x")
    kept = nodes.groupBy("label").agg(least).select("x.doc_id", "x.text_hash")
    wordless = signed.where("node is null").select("doc_id", "text_hash").distinct()
    rows = signed.select("doc_id", "text_hash", F.col("node").isNull().alias("wordless")).groupBy("doc_id", "text_hash", "wordless").agg(F.count(F.lit(1)).alias("n"))
    kept = kept.union(wordless).select(F.col("doc_id").alias("__dup_id"), F.col("text_hash").alias("__dup_hash"))
    kept = kept.join(rows, F.col("__dup_id").eqNullSafe(F.col("doc_id")) & (F.col("__dup_hash") == F.col("text_hash"))).select("__dup_id", "__dup_hash", (F.col("wordless") | (F.col("n") == 1)).alias("__dup_all"))
    kept = store(kept, "dup-kept")
    own = F.col("own_id").eqNullSafe(F.col("__dup_id")) & (F.col("own_hash") == F.col("__dup_hash"))
    # all columns of a row in one, so that their names can't clash with others
    rows = docs.select(F.col("doc_id").cast("long").alias("own_id"), F.xxhash64("text").alias("own_hash"), F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    out = rows.join(kept.where("__dup_all"), own).select("row.*")
    if kept.where("not __dup_all").limit(1).count():
        out = out.union(rows.join(kept.where("not __dup_all"), own).dropDuplicates(["__dup_id", "__dup_hash"]).select("row.*"))
    return out


def query(spark, sf_dir: str) -> DataFrame:
    """The class of every document, and the link that its text was verified by."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "class_id", "linked_id", F.round("similarity", 6).alias("similarity"), "n_links")

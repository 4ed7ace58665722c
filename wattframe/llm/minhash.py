"""MinHash near-dedup: circulant signatures, banding, exact Jaccard on full sets.

Two permutations make the whole signature: one scatters the shingles over 2^32 places, the
other ranks the places, and coordinate k ranks them after a circular shift by k. Bands of
coordinates propose links, full shingle sets confirm them, components group the documents.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from wattframe.llm.components import components
from wattframe.llm.staging import drop, stage
from wattframe.llm.words import _GRAM, common, grams, mix, reduce_by_text, sets_of, signed, slices, words_of

BANDS = 32
ROWS = 4
BLOCK_DOCS = 512
PAIRED = 64  # nodes of the largest buckets whose pairs are rows
U32 = np.uint32


def scatter(x: np.ndarray) -> np.ndarray:
    """First permutation of the 2^32 places."""
    x = x ^ (x >> U32(16))
    x *= U32(0x7FEB352D)
    x ^= x >> U32(15)
    x *= U32(0x846CA68B)
    x ^= x >> U32(16)
    return x


def rank(x: np.ndarray) -> np.ndarray:
    """Second permutation of the 2^32 places; changes ``x`` in place."""
    x ^= x >> U32(16)
    x *= U32(0x85EBCA6B)
    x ^= x >> U32(13)
    x *= U32(0xC2B2AE35)
    x ^= x >> U32(16)
    return x


def signatures(shingles: np.ndarray, bounds: np.ndarray, size: int) -> np.ndarray:
    """One row of ``size`` coordinates per text; texts without shingles keep the largest number."""
    places = scatter(shingles.astype(U32))
    out = np.empty((len(bounds) - 1, size), U32)
    for k in range(size):
        out[:, k] = reduce_by_text(np.minimum, rank(places - U32(k)), bounds, U32(0xFFFFFFFF))
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One key per text and band; equal keys mean equal bands of the same number."""
    parts = signature.reshape(len(signature), bands, rows).astype(np.uint64)
    sums = (parts * _GRAM[:rows]).sum(axis=2, dtype=np.uint64)
    return mix(sums + np.arange(1, bands + 1, dtype=np.uint64) * _GRAM[rows])


def fingerprints(shingles: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that stand for each set, in two columns."""
    zero = np.uint64(0)
    return tuple(
        signed(reduce_by_text(np.add, mix(shingles ^ _GRAM[i]), bounds, zero)) for i in (40, 41)
    )


def _signed_rows(n: int, bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            words = words_of(part.column(1))
            shingles, bounds = sets_of(*grams(words, n, whole=True))
            sizes = np.diff(bounds)
            keys = signed(band_keys(signatures(shingles, bounds, bands * rows), bands, rows))
            full = sizes > 0
            hi, lo = fingerprints(shingles, bounds)
            counts = np.where(full, bands, 0)
            lists = pa.ListArray.from_arrays(
                pa.array(np.concatenate(([0], np.cumsum(counts))), pa.int32()), pa.array(keys[full].ravel())
            )
            yield pa.RecordBatch.from_arrays(
                [part.column(0), part.column(2), pa.array(sizes), pa.array(hi), pa.array(lo), lists],
                ["doc_id", "text_digest", "n_shingles", "hi", "lo", "bands"],
            )

    return run


def _shingle_rows(n: int):
    """Sets of the rows (node, text, hi, lo) whose text is the one that the node stands for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in slices(batches, "text"):
            shingles, bounds = sets_of(*grams(words_of(part.column(1)), n, whole=True))
            sets = [shingles[a:b].tobytes() for a, b in zip(bounds[:-1], bounds[1:], strict=True)]
            hi, lo = fingerprints(shingles, bounds)
            own = (hi == part.column(2).to_numpy()) & (lo == part.column(3).to_numpy())
            yield pa.RecordBatch.from_arrays(
                [part.column(0), pa.array(sets, pa.binary())], ["node", "shingles"]
            ).filter(pa.array(own))

    return run


def _similar(percent: int):
    """Keeps the pairs whose full sets are similar enough."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            left, right = batch.column(2), batch.column(3)
            keep = np.zeros(batch.num_rows, bool)
            for i in range(batch.num_rows):
                a = np.frombuffer(left[i].as_buffer(), np.uint64)
                b = np.frombuffer(right[i].as_buffer(), np.uint64)
                both = common(a, b)
                keep[i] = 100 * both >= percent * (len(a) + len(b) - both)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1)], ["a", "b"]
            ).filter(pa.array(keep))

    return run


def links(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) whose full sets (node, shingles) have a Jaccard of ``percent`` or more."""
    left = sets.select(F.col("node").alias("a"), F.col("shingles").alias("left"))
    right = sets.select(F.col("node").alias("b"), F.col("shingles").alias("right"))
    joined = pairs.join(right, "b").join(left, "a").select("a", "b", "left", "right")
    return joined.mapInArrow(_similar(percent), "a long, b long")


def _links_between(percent: int):
    """Links between groups, for one block of members and one of documents of smaller groups."""

    def run(key: tuple, members: pd.DataFrame, others: pd.DataFrame) -> pd.DataFrame:
        found: set[tuple[int, int]] = set()
        if len(members) and len(others):
            sets = [np.frombuffer(x, np.uint64) for x in members["shingles"]]
            sizes = np.fromiter(map(len, sets), np.int64, len(sets))
            hashes = np.concatenate(sets)
            owner = np.repeat(np.arange(len(sets)), sizes)
            order = np.argsort(hashes, kind="stable")
            hashes, owner = hashes[order], owner[order]
            groups = members["component"].to_numpy()
            for group, own in zip(others["other_component"], others["other_shingles"], strict=True):
                own = np.frombuffer(own, np.uint64)
                first = np.searchsorted(hashes, own, "left")
                counts = np.searchsorted(hashes, own, "right") - first
                ends = np.cumsum(counts)
                at = np.arange(ends[-1]) + np.repeat(first - ends + counts, counts)
                both = np.bincount(owner[at], minlength=len(sets))
                near = (100 * both >= percent * (sizes + len(own) - both)) & (groups != group)
                found.update((min(group, g), max(group, g)) for g in np.unique(groups[near]))
        return pd.DataFrame(sorted(found), columns=["a", "b"], dtype="int64")

    return run


def _near_sizes(first: str, second: str, percent: int) -> F.Column:
    """Whether sets of these sizes may have a Jaccard of ``percent``."""
    return 100 * F.least(first, second) >= percent * F.greatest(first, second)


def _between_groups(rows: DataFrame, labels: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links between components that share a bucket but that no bucket's leader has joined.

    Of each such bucket, the documents outside its largest component meet all its documents.
    Buckets of up to ``PAIRED`` give a row per pair of sizes that may be similar, and a pair that
    shares several of them is compared once; larger ones meet in blocks, without a row per pair.
    Buckets of two are settled by their leader.
    """
    rows = stage(
        rows.where("n > 2")
        .join(labels, "node", "left")
        .select("bucket", "node", "size", "n", F.coalesce("component", "node").alias("component")),
        "labelled",
    )
    parts = rows.groupBy("bucket", "component").agg(F.count("*").alias("docs"))
    mixed = stage(
        parts.groupBy("bucket")
        .agg(
            F.count("*").alias("groups"),
            F.max_by("component", F.struct("docs", -F.col("component"))).alias("largest"),
        )
        .where("groups > 1")
        .drop("groups"),
        "mixed",
    )
    rows = stage(rows.join(mixed, "bucket"), "unsettled")
    found = _between_few(rows.where(F.col("n") <= PAIRED), sets, percent)
    return found.unionByName(_between_many(rows.where(F.col("n") > PAIRED), sets, percent)).distinct()


def _between_few(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, by one row for each pair of nodes of a bucket."""
    left = rows.where("component != largest").select(
        "bucket", F.col("node").alias("a"), F.col("size").alias("a_size"), F.col("component").alias("a_component")
    )
    right = rows.select(
        "bucket", F.col("node").alias("b"), F.col("size").alias("b_size"), F.col("component").alias("b_component")
    )
    pairs = stage(
        left.join(right.hint("merge"), "bucket")
        .where(F.col("a_component") != F.col("b_component"))
        .where(_near_sizes("a_size", "b_size", percent))
        .select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"))
        .distinct(),
        "pairs",
    )
    near = stage(links(pairs, sets, percent), "near")
    of = rows.select("node", "component").distinct()
    one, other = (of.select(F.col("node").alias(x), F.col("component").alias(f"{x}_component")) for x in "ab")
    return (
        near.join(one, "a")
        .join(other, "b")
        .select(F.least("a_component", "b_component").alias("a"), F.greatest("a_component", "b_component").alias("b"))
    )


def _between_many(rows: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between components, by blocks of nodes that meet in a task each."""
    rows = rows.join(sets, "node")
    blocks = F.ceil(F.col("n") / BLOCK_DOCS).cast("int")
    own = F.pmod(F.xxhash64("node"), blocks).cast("int")
    every = F.explode(F.sequence(F.lit(0), blocks - 1))
    members = rows.select("bucket", own.alias("block"), every.alias("side"), "component", "shingles")
    others = rows.where("component != largest").select(
        "bucket", own.alias("side"), every.alias("block"), "component", "shingles"
    )
    others = others.select([F.col(c).alias(f"other_{c}") for c in others.columns])
    key = ["bucket", "block", "side"]
    return (
        members.groupBy(*key)
        .cogroup(others.groupBy([f"other_{k}" for k in key]))
        .applyInPandas(_links_between(percent), "a long, b long")
    )


def grouped(nodes: DataFrame, sets_of_nodes: Callable[[DataFrame], DataFrame], percent: int) -> DataFrame:
    """(node, component) of all nodes that have a link to another.

    ``nodes`` has (node, size, bands) with one row per different set; ``sets_of_nodes`` takes a
    table of nodes and gives their (node, shingles).
    """
    cells = nodes.select("node", "size", F.explode("bands").alias("bucket"))
    shared = stage(cells.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1"), "buckets")
    met = stage(cells.join(shared, "bucket"), "met")
    weight = stage(met.groupBy("node").agg(F.sum("n").alias("weight")), "weight")
    leaders = stage(
        met.join(weight, "node")
        .groupBy("bucket")
        .agg(F.max_by(F.struct("node", "size"), F.struct("weight", -F.col("node"))).alias("leader")),
        "leaders",
    )
    pairs = stage(
        met.join(leaders, "bucket")
        .where(F.col("node") != F.col("leader.node"))
        .where(_near_sizes("size", "leader.size", percent))
        .select(F.col("leader.node").alias("a"), F.col("node").alias("b"))
        .distinct(),
        "pairs",
    )
    sets = stage(sets_of_nodes(weight.select("node")), "sets")
    drop(shared, weight, leaders)
    labels = components(links(pairs, sets, percent))
    more = stage(_between_groups(met, labels, sets, percent), "more")
    drop(met, pairs, sets)
    if more.isEmpty():
        return labels
    over = components(more).select(F.col("node").alias("component"), F.col("component").alias("lower"))
    named = more.select(F.col("a").alias("node")).union(more.select("b")).distinct()
    single = named.join(labels, "node", "left_anti").select("node", F.col("node").alias("component"))
    return stage(
        labels.unionByName(single)
        .join(over, "component", "left")
        .select("node", F.coalesce("lower", "component").alias("component")),
        "labels",
    )


def near_duplicates(
    docs: DataFrame, shingle: int = 5, percent: int = 80, bands: int = BANDS, rows: int = ROWS
) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id, kept.

    Documents are linked when their sets of ``shingle`` successive words (A-Z lower-cased)
    overlap by ``percent`` of their union or more; component_id is the smallest doc_id
    reachable and kept marks that document. 32 bands of 4 coordinates miss a pair at 0.8 with
    a chance of 5e-8; nothing else limits the candidates.

    Equal sets are one node from the start. In every bucket each node is compared with a
    leader, the one that meets most others in all its buckets; where a bucket still holds
    several components, those are compared in blocks. A text with fewer words than a shingle
    is one shingle; NULL, empty and blank texts have none and stand alone. Rows that repeat an
    id give a row each, judged by their own text, which ``text_digest`` (xxhash64) tells apart.
    Rows without an id keep their set size, have no component and are kept. Very long texts
    are taken whole. Other columns are ignored.
    """
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    signed_docs = stage(
        texts.withColumn("text_digest", F.xxhash64("text")).mapInArrow(
            _signed_rows(shingle, bands, rows),
            "doc_id long, text_digest long, n_shingles long, hi long, lo long, bands array<long>",
        ),
        "signatures",
    )
    known = signed_docs.where("n_shingles > 0 and doc_id is not null")
    classes = stage(
        known.groupBy("hi", "lo")
        .agg(F.min("doc_id").alias("rep"), F.any_value("n_shingles").alias("size"), F.any_value("bands").alias("bands"))
        .withColumn("node", F.monotonically_increasing_id()),  # ids of documents may stand for several texts
        "classes",
    )
    stands = classes.select(F.col("rep").alias("doc_id"), "node", "hi", "lo")
    labels = grouped(
        classes.select("node", "size", "bands"),
        # by shuffle at every size: the nodes grow with the texts
        lambda nodes: texts.join(stands.join(nodes, "node", "left_semi").hint("merge"), "doc_id")
        .select("node", "text", "hi", "lo")
        .mapInArrow(_shingle_rows(shingle), "node long, shingles binary")
        .distinct(),
        percent,
    )
    named = stage(labels.join(classes.select("node", "rep"), "node"), "named")
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    linked = (
        known.select("doc_id", "text_digest", "n_shingles", "hi", "lo")
        .join(classes.select("hi", "lo", "rep", "node"), ["hi", "lo"])
        .join(named.join(least, "component").select("node", "component_id"), "node", "left")
        .select("doc_id", "text_digest", "n_shingles", F.coalesce("component_id", "rep").alias("component_id"))
    )
    alone = signed_docs.where("not (n_shingles > 0 and doc_id is not null)").select(
        "doc_id", "text_digest", "n_shingles", F.col("doc_id").alias("component_id")
    )
    return linked.unionByName(alone).withColumn(
        "kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(True))
    )


def op2_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of all documents by 4-word shingles."""
    found = near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), shingle=4)
    return found.drop("text_digest")


OP2_SQL = r"""
with recursive w as (
    select doc_id, list_filter(regexp_split_to_array(
        translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
        '[\x20\x09-\x0D]+'), lambda x: x != '') as w
    from documents
), s as (
    select distinct doc_id, unnest(case
        when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
        else list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' ')) end) as g
    from w
), n as (select doc_id, count(*) as n from s group by 1
), pairs as (
    select a.doc_id as a, b.doc_id as b, count(*) as c
    from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2
), links as (
    select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b
    where 100 * c >= 80 * (x.n + y.n - c)
), both_ways as (select a, b from links union all select b, a from links
), reach(doc_id, root) as (
    select doc_id, doc_id from documents
    union select both_ways.b, root from reach join both_ways on reach.doc_id = both_ways.a
), least_root as (select doc_id, min(root) as root from reach group by 1)
select d.doc_id, coalesce(n, 0) as n_shingles, root as component_id, d.doc_id = root as kept
from documents d join least_root using (doc_id) left join n using (doc_id)
"""

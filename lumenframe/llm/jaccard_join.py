"""Operator 10: n-gram Jaccard join by a MinHash LSH forest.

A text is the set of its five-word shingles (a shorter text is one shingle, all
its words). Rows with the same set are one class. Every class has TREES labels of
DEPTH min-wise values. The forest is a table of them sorted by tree and label, so
the nodes of a tree's prefix trie at any depth are runs of its rows. Two classes
are candidates when they share a node; every candidate is verified exactly.

The join starts at a long prefix, at which a pair just at the threshold is still
found with probability FLOOR. From the similarities of the links found there it
estimates, in every bin of similarity, how many were missed. Where a bin's recall
is below the target, prefixes are shortened to the longest at which such pairs
reach it, and the pairs that share only the shorter prefix are verified too. As
bins are judged apart, large groups of close copies can't hide others' links.

Nodes with more members, or longer texts, than a block holds are dealt into
pairs of blocks, so a node of any size becomes tasks of bounded size, and a task
counts its links and returns one row per member, never the pairs. A pair is
verified in the first tree that holds it. Components come from the members'
local roots by alternating star steps that split the edges of a hub.

Edge cases: a null text or one without words links to nothing and is its own
class and group, and so is a row with a null doc_id; repeated rows are copies of
each other and have a row each; classes are of texts, so an id with several
texts has a row in the class of each, and ``keep_first`` decides about each; ties
go to the smaller id, then the smaller key of the text; very long texts are
hashed in slices and verified in blocks of their own; extra columns are not
read, and ``keep_first`` hands them on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.dedup import connected_components
from .common import arrow_map, cut, mix, read_table, shingle_hashes, small_side, text_hashes

SHINGLE = 5
THRESHOLD = 0.8
TREES = 16
#: Values of a label, the longest prefix.
DEPTH = 6
#: Probability with which a pair at the threshold is found at the first prefix, and the recall wanted in every bin.
FLOOR, RECALL = 0.99, 0.999
#: Bins of similarity between the threshold and 1.
BINS = 8
#: Members of a block, and about so many shingles; a task verifies a pair of blocks.
BLOCK, BLOCK_SHINGLES = 256, 1 << 19
#: About so many members of small nodes, and so many shingles, share a task.
PACK_ROWS, PACK_SHINGLES = 250, 1 << 18
_ODD = np.random.default_rng(20).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_ADD = np.random.default_rng(21).integers(1, 1 << 63, TREES * DEPTH, dtype=np.uint64)


def shingles_of(h: np.ndarray) -> np.ndarray:
    """Sorted distinct shingle hashes of a text from those of its words."""
    if not len(h):
        return h
    return np.unique(shingle_hashes(h, min(SHINGLE, len(h))) + np.uint64(max(0, SHINGLE - len(h))))


def signature(shingles: np.ndarray) -> np.ndarray:
    """TREES x DEPTH minima under multiply-add hashes, in bounded memory for long texts."""
    least = np.full(TREES * DEPTH, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(shingles), 2048):
        part = shingles[at : at + 2048, None] * _ODD + _ADD
        np.minimum(least, part.min(0), out=least)
    return least.reshape(TREES, DEPTH)


def node_keys(signatures: np.ndarray, depth: int) -> np.ndarray:
    """Keys (documents x TREES) of the trie nodes at ``depth`` from 16-bit signature values (documents x TREES x DEPTH)."""
    keys = np.broadcast_to(np.arange(1, TREES + 1, dtype=np.uint64), signatures.shape[:2])
    for d in range(depth):
        keys = mix(keys * np.uint64(0x9E3779B97F4A7C15) + signatures[:, :, d] + np.uint64(1))
    return keys.view(np.int64)


def _signatures(column) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint16).reshape(-1, TREES, DEPTH)


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` with ``t1`` and ``t2``, a 128-bit key of the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.withColumns({"t1": F.xxhash64(text), "t2": F.xxhash64(F.lit(1), text)})


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, t1, t2, s1, s2, n, sig) of every row: 128-bit fingerprint and size of the shingle set, and its signature.

    Rows without words or id have n = 0 and no signature.
    """

    def run(batch):
        ids, out = batch.column("doc_id").to_pylist(), []
        for i, h in zip(ids, text_hashes(batch.column("text").to_pylist()), strict=True):
            if i is not None and len(h):
                s = shingles_of(h)
                one, two = np.add.reduce(s), np.bitwise_xor.reduce(mix(s + np.uint64(77)))
                sig = (signature(s) >> np.uint64(48)).astype(np.uint16)
                out.append((one.view(np.int64), two.view(np.int64), len(s), sig.tobytes()))
            else:
                out.append((0, 0, 0, None))
        own = {c: batch.column(c) for c in ("doc_id", "t1", "t2")}
        return own | dict(zip(("s1", "s2", "n", "sig"), zip(*out, strict=True), strict=True))

    return arrow_map(docs, run, "doc_id long, t1 long, t2 long, s1 long, s2 long, n long, sig binary")


def forest(classes: DataFrame) -> DataFrame:
    """(tree, label, rep, n) sorted by tree and label: the prefix tries of all trees, a row for every class and tree."""
    width = 2 * DEPTH
    label = F.transform(F.sequence(F.lit(0), F.lit(TREES - 1)), lambda t: F.substring("sig", t * width + 1, F.lit(width)))
    rows = classes.select("rep", "n", F.posexplode(label).alias("tree", "label"))
    return cut(rows.repartitionByRange("tree", "label", "rep").sortWithinPartitions("tree", "label", "rep"), "forest")


def node_members(tries: DataFrame, depth: int) -> DataFrame:
    """(node, tree, rep, n): membership in the forest's nodes at a depth, runs of rows with equal prefixes."""
    node = F.xxhash64("tree", F.substring("label", 1, 2 * depth))
    return tries.select(node.alias("node"), "tree", "rep", "n")


def node_sets(members: DataFrame) -> DataFrame:
    """(node, tree, size, shingles, x1, x2) of every node with several members; x1 and x2 stand for their set."""
    return members.groupBy("node", "tree").agg(
        F.count("*").alias("size"),
        F.sum("n").alias("shingles"),
        F.bit_xor(F.xxhash64("rep")).alias("x1"),
        F.bit_xor(F.xxhash64(F.lit(1), "rep")).alias("x2"),
    ).where("size > 1")


def node_cells(members: DataFrame, known: DataFrame | None = None, block: int = BLOCK) -> DataFrame:
    """(node, tree, i, j, b, rep, n, small): the members of every pair of a node's blocks; b is the member's own block.

    Nodes with the same members in several trees are kept in the first one, and those with the members of a node in
    ``known``, whose pairs are all verified, are left out.
    """
    nodes, alike = node_sets(members), ["size", "shingles", "x1", "x2"]
    if known is not None:
        nodes = nodes.join(known, alike, "left_anti")
    blocks = F.ceil(F.greatest(F.col("size") / block, F.col("shingles") / BLOCK_SHINGLES))
    nodes = nodes.groupBy(*alike).agg(F.min(F.struct("tree", "node")).alias("at"))
    nodes = nodes.select("at.node", "at.tree", F.least(blocks, F.col("size")).cast("int").alias("blocks"))
    placed = members.join(nodes, ["node", "tree"]).withColumn(
        "b", F.pmod(F.xxhash64("rep", "node"), F.col("blocks").cast("long")).cast("int")
    )
    other = F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("o")
    return placed.select("node", "tree", "rep", "n", "b", (F.col("blocks") == 1).alias("small"), other).select(
        "node", "tree", F.least("b", "o").alias("i"), F.greatest("b", "o").alias("j"), "b", "rep", "n", "small"
    )


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all pairwise intersections; for many sets by products of 0/1 matrices over slices of the vocabulary."""
    n = len(sets)
    if n == 2:
        both = len(np.intersect1d(*sets, assume_unique=True))
        return np.array([[len(sets[0]), both], [both, len(sets[1])]], float)
    rows = np.repeat(np.arange(n), [len(s) for s in sets])
    _, cols = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(cols, kind="stable")
    rows, cols = rows[order], cols[order]
    width = min(4096, int(cols[-1]) + 1)
    out = np.zeros((n, n), np.float32)
    for at in range(0, int(cols[-1]) + 1, width):
        a, b = np.searchsorted(cols, [at, at + width])
        held = np.zeros((n, width), np.float32)
        held[rows[a:b], cols[a:b] - at] = 1
        out += held @ held.T
    return out.astype(float)


def chance(similarity: np.ndarray | float, depth: int) -> np.ndarray | float:
    """The probability that a pair shares a node at a depth."""
    return 1 - (1 - similarity**depth) ** TREES


def cell_links(sets: list[np.ndarray], keys: np.ndarray, tree: int, longer: np.ndarray | None, block: np.ndarray, mixed: bool, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """(links, similarities) of a cell's members: a pair counts in the first tree in which it meets, and in one cell there.

    ``keys``, and ``longer`` where longer prefixes have been verified: the members' nodes in all trees.
    """
    n = np.array([len(s) for s in sets], float)
    shared = shared_counts(sets)
    sim = shared / (n[:, None] + n - shared)
    link = sim >= threshold - 1e-12
    for t in range(tree):
        link &= keys[:, None, t] != keys[None, :, t]
    if longer is not None:
        for t in range(TREES):
            link &= longer[:, None, t] != longer[None, :, t]
    np.fill_diagonal(link, False)
    if mixed:  # pairs inside one block belong to the block's own cell
        link &= block[:, None] != block[None, :]
    return link, sim


def _verify(depth: int, longer: int | None, threshold: float):
    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by([(c, "ascending") for c in ("node", "tree", "i", "j", "rep")])
        node, tree, i, j, b, rep, copies = (table.column(c).to_numpy() for c in ("node", "tree", "i", "j", "b", "rep", "copies"))
        labels = _signatures(table.column("sig"))
        keys, more = node_keys(labels, depth), None if longer is None else node_keys(labels, longer)
        edges = np.linspace(threshold, 1, BINS + 1)[1:-1]
        ids, first = np.unique(rep, return_index=True)
        texts = table.column("text").take(pa.array(first)).to_pylist()
        sets = dict(zip(ids.tolist(), map(shingles_of, text_hashes(texts)), strict=True))
        new = np.flatnonzero((node[1:] != node[:-1]) | (tree[1:] != tree[:-1]) | (i[1:] != i[:-1]) | (j[1:] != j[:-1])) + 1
        reps, links, roots, seen = [], [], [], np.zeros(2 * BINS)
        for lo, hi in zip([0, *new.tolist()], [*new.tolist(), len(rep)], strict=True):
            if hi - lo < 2:
                continue
            ids = rep[lo:hi]
            link, sim = cell_links([sets[r] for r in ids.tolist()], keys[lo:hi], tree[lo], None if more is None else more[lo:hi], b[lo:hi], i[lo] != j[lo], threshold)
            if not link.any():
                continue
            found = sim[link]
            at = np.searchsorted(edges, found, "right")
            seen[:BINS] += np.bincount(at, minlength=BINS)
            seen[BINS:] += np.bincount(at, 1 / np.maximum(chance(found, depth), 1e-9) - 1, BINS)
            root = ids
            while True:  # members of a local component get its least class
                grown = np.minimum(root, np.where(link, root[None, :], root[:, None]).min(1))
                if (grown == root).all():
                    break
                root = grown
            some = link.any(1)
            reps.append(ids[some])
            links.append((link @ copies[lo:hi])[some])
            roots.append(root[some])
        cat = lambda x: np.concatenate(x) if x else np.empty(0, np.int64)
        told = [seen.tolist()] + [None] * max(0, sum(map(len, reps)) - 1) if reps else []
        return pa.table({"rep": cat(reps), "links": cat(links), "root": cat(roots), "seen": pa.array(told, pa.list_(pa.float64()))})

    return run


def verified(docs: DataFrame, classes: DataFrame, tries: DataFrame, depth: int, longer: int | None = None, threshold: float = THRESHOLD) -> DataFrame:
    """(rep, links, root, seen) from all cells at a depth, without the pairs that share a ``longer`` prefix.

    ``docs``: t1, t2, text; ``classes``: (rep, t1, t2, n, copies, sig). ``seen``, once a task: the links of each bin, and how
    many were missed for as many at this depth.
    """
    known = None if longer is None else node_sets(node_members(tries, longer)).select("size", "shingles", "x1", "x2").distinct()
    cells = cut(node_cells(node_members(tries, depth), known), "cells")
    size = cells.where("small").agg(F.count("*").alias("rows"), F.sum("n").alias("n")).head()
    packs = max(1, -(-size["rows"] // PACK_ROWS), -(-(size["n"] or 0) // PACK_SHINGLES))
    wanted = cut(classes.join(cells.select("rep").distinct(), "rep", "left_semi").select("t1", "t2", "rep", "copies", "sig"), "wanted")
    texts = docs.select("t1", "t2", "text").join(small_side(wanted), ["t1", "t2"]).drop("t1", "t2").dropDuplicates(["rep"])
    pack = F.when(F.col("small"), F.pmod(F.xxhash64("node"), F.lit(packs))).otherwise(F.xxhash64("node", "tree", "i", "j"))
    rows = cells.join(texts, "rep").select(pack.alias("pack"), "node", "tree", "i", "j", "b", "rep", "copies", "sig", "text")
    return rows.groupBy("pack").applyInArrow(_verify(depth, longer, threshold), "rep long, links long, root long, seen array<double>")


def match_depth(similarity: float = THRESHOLD, recall: float = RECALL) -> int:
    """The longest prefix that a pair of this similarity shares in some tree with probability ``recall``."""
    return next((d for d in range(DEPTH, 1, -1) if chance(similarity, d) >= recall), 1)


def depth_needed(found: DataFrame, depth: int, threshold: float, recall: float) -> int:
    """The depth at which every bin of similarity that has links reaches the recall; ``depth`` where all do already."""
    seen = np.zeros(2 * BINS)
    for r in found.where("seen IS NOT NULL").select(F.posexplode("seen").alias("at", "x")).groupBy("at").agg(F.sum("x").alias("x")).collect():
        seen[r["at"]] = r["x"]
    links, missed = seen[:BINS], seen[BINS:]
    short = [k for k in range(BINS) if links[k] and links[k] < recall * (links[k] + missed[k])]
    return min([depth, *(match_depth(threshold + (1 - threshold) * k / BINS, recall) for k in short)])


def linked(docs: DataFrame, classes: DataFrame, recall: float = RECALL, threshold: float = THRESHOLD) -> tuple[DataFrame, int]:
    """((rep, links, root), depth): the links of all classes, and the length to which prefixes were shortened."""
    tries, depth = forest(classes), match_depth(threshold, min(FLOOR, recall))
    found = cut(verified(docs, classes, tries, depth, None, threshold), "links")
    shorter = depth_needed(found, depth, threshold, recall)
    if shorter < depth:
        found = found.unionAll(cut(verified(docs, classes, tries, shorter, depth, threshold), "links"))
    return found.drop("seen"), shorter


def grouped(docs: DataFrame, recall: float = RECALL, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, t1, t2, first, class, n_links) of every row; ``docs``: doc_id, text, t1, t2.

    ``first`` is the least (doc_id, t1, t2) with an equal set, ``class`` the least of the component of links; both NULL for
    a row without words or id. ``n_links`` counts the other rows with a similarity of ``threshold`` or more, copies included.
    """
    prints = cut(fingerprints(docs), "prints")
    rep = F.xxhash64("s1", "s2", "n").alias("rep")
    classes = prints.where("n > 0").groupBy("s1", "s2", "n").agg(
        F.min(F.struct("doc_id", "t1", "t2")).alias("first"), F.count("*").alias("copies"), F.min("sig").alias("sig")
    )
    classes = cut(classes.select(rep, "first", "first.t1", "first.t2", "n", "copies", "sig"), "classes")
    found, _ = linked(docs, classes, recall, threshold)
    links = found.groupBy("rep").agg(F.sum("links").alias("links"))
    # a component goes by the least first row of its classes
    ends = found.where("root <> rep").select("rep", "root").distinct()
    for c in ("rep", "root"):
        ends = ends.join(classes.select(F.col("rep").alias(c), F.col("first").alias(f"{c}_first")), c)
    roots = connected_components(ends.select(F.col("rep_first").alias("a"), F.col("root_first").alias("b")))
    per_class = (
        classes.select("rep", "first", "copies")
        .join(links, "rep", "left")
        .join(roots.withColumnRenamed("id", "first"), "first", "left")
        .select("rep", "first", F.coalesce("root", "first").alias("class"), (F.col("copies") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"))
    )
    rows = prints.select("doc_id", "t1", "t2", F.when(F.col("n") > 0, rep).alias("rep"))
    return rows.join(per_class, "rep", "left").select("doc_id", "t1", "t2", "first", "class", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def near_duplicates(docs: DataFrame, recall: float = RECALL, threshold: float = THRESHOLD) -> DataFrame:
    """(doc_id, exact_id, class_id, n_links) of every row: smallest id with an equal set, and in its component of links; linked rows."""
    rows = grouped(keyed(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))), recall, threshold)
    own = lambda c: F.coalesce(F.col(f"{c}.doc_id"), F.col("doc_id"))
    return rows.select("doc_id", own("first").alias("exact_id"), own("class").alias("class_id"), "n_links")


def keep_first(docs: DataFrame) -> DataFrame:
    """One row of each group, the one with the smallest id and, of its texts, the smallest key; rows with a null id stay."""
    whole = keyed(docs.select(F.struct("*").alias("_doc"), F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")))
    key = ["doc_id", "t1", "t2"]
    rows = cut(grouped(whole.drop("_doc")).where("doc_id IS NOT NULL"), "groups")
    others = cut(rows.where(F.struct(*key) != F.col("class")).select(*key).distinct(), "others")
    repeated = cut(rows.groupBy(*key).count().where("count > 1").select(*key).join(small_side(others), key, "left_anti"), "repeated")
    kept = whole.join(small_side(others), key, "left_anti")
    if repeated.isEmpty():
        return kept.select("_doc.*")
    once = kept.join(small_side(repeated), key, "left_semi").dropDuplicates(key)
    return kept.join(small_side(repeated), key, "left_anti").select("_doc.*").unionAll(once.select("_doc.*"))


def op10_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links")

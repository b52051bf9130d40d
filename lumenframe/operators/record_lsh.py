"""Candidate keys of typed records, so that similar records meet without all pairs of a block.

If weighted similarities add up to a threshold, every column with enough weight
must reach a floor of its own: s >= 1 - (1 - threshold) / weight. A floor turns
into cells that two records with that similarity share: numbers and dates get
overlapping buckets, equal values one cell, short texts their neighbours by one
deletion, longer texts and n-grams MinHash bands. A key is one cell of each
column (and a block), hashed. Only MinHash can lose a pair; it takes as many
bands as the wanted recall needs.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.expr import total
from ..sources.tables import materialize
from .dedup import CUTS, blocked_pairs, bundles, char_ngrams, classes, column_similarity, connected_components, expanded, opened

#: A record gets at most about so many keys; columns beyond that are left to the score.
MAX_KEYS = 160
#: With at most so many keys of its own a record carries them all, and a pair comes from the least it shares.
FEW_KEYS = 8
#: How records meet: in blocks, by keys, by keys inside blocks, or by either.
CANDIDATES = ("block", "lsh", "intersection", "union")


def score_of(columns: dict[str, str], weights: dict[str, float] | None, method: str, date_days: float, a: str = "_a", b: str = "_b", granted: tuple[str, ...] = (), bags: bool = False) -> Column:
    """The similarity of the records with columns <c><a> and <c><b>: composite, exact_subset or fuzzy_subset.

    Columns of a ``granted`` kind count as equal, which gives a bound that costs less; with ``bags`` texts count as similar
    as their letters allow (columns _bag_<c> and _len_<c>), another one.
    """
    weights = weights or dict.fromkeys(columns, 1.0)
    whole = sum(weights[c] for c in columns)
    score = F.lit(0.0)
    for c, kind in columns.items():
        if kind in granted and method != "exact_subset":
            score = score + F.lit(weights[c] / whole)
            continue
        if bags and kind == "lowered" and method != "exact_subset":
            s = most_similar_texts(*[F.col(f"{n}_{c}{x}") for n in ("_bag", "_len") for x in (a, b)])
        else:
            s = column_similarity("exact" if method == "exact_subset" and kind != "date" else kind, F.col(f"{c}{a}"), F.col(f"{c}{b}"), date_days)
        if method == "fuzzy_subset":
            s = (s >= CUTS[kind]).cast("double")
        elif method == "exact_subset" and kind == "date":
            s = (s > 0).cast("double")
        score = score + F.lit(weights[c] / whole) * s
    return score


def letter_bag(text: Column) -> Column:
    """The letters of a text, in 16 classes of four bits: as many ones as the class has letters, four at most."""

    def add(bag: Column, c: Column) -> Column:
        at = F.pmod(F.ascii(c), F.lit(16)) * 4
        held = F.call_function("shiftrightunsigned", bag, at).bitwiseAND(F.lit(15))
        return bag.bitwiseOR(F.call_function("shiftleft", (held * 2 + 1).bitwiseAND(F.lit(15)).cast("long"), at))

    return F.aggregate(F.split(F.lower(text), ""), F.lit(0).cast("long"), add)


def most_similar_texts(bag_a: Column, bag_b: Column, length_a: Column, length_b: Column) -> Column:
    """A bound of the similarity of two texts by edits: each letter that one has more of than the other takes one."""
    more = [F.bit_count(x.bitwiseAND(F.bitwise_not(y))) for x, y in ((bag_a, bag_b), (bag_b, bag_a))]
    return F.coalesce(1 - F.try_divide(F.greatest(*more).cast("double"), F.greatest(length_a, length_b)), F.lit(1.0))


def floors(columns: dict[str, str], weights: dict[str, float] | None, threshold: float, method: str) -> dict[str, float]:
    """The similarity that each column must reach in a pair at the threshold; columns that need none are left out."""
    weights = weights or dict.fromkeys(columns, 1.0)
    whole = sum(weights[c] for c in columns)
    found = {}
    for c, kind in columns.items():
        least = 1 - (1 - threshold) * whole / weights[c] if weights[c] else 0.0
        if least <= 1e-9:
            continue
        if method == "fuzzy_subset":
            least = CUTS[kind]
        elif method == "exact_subset":
            least = 1e-9 if kind == "date" else 1.0
        found[c] = min(1.0, least)
    return found


def _near(x: Column, width: float) -> Column:
    """Two cells of a number, so that numbers at most ``width`` apart share one; the width gets a little more for rounding."""
    at = F.floor(x / F.lit(width * (1 + 1e-9) + 1e-300))
    return F.array(at, at + 1)


def _number_cells(v: Column, least: float) -> Column:
    x = v.cast("double")
    if least >= 1:
        return F.array(F.xxhash64(x))
    cells = F.transform(_near(F.ln(F.abs(x)), -math.log(least)), lambda k: F.xxhash64(k, F.signum(x)))
    return F.when(x == 0, F.array(F.xxhash64(F.lit("zero")))).otherwise(cells)


def _date_cells(v: Column, least: float, date_days: float) -> Column:
    days = F.unix_micros(v.cast("timestamp")) / F.lit(86400e6)
    return F.array(F.xxhash64(days)) if least >= 1 else F.transform(_near(days, (1 - least) * date_days), lambda k: F.xxhash64(k))


def deletions(text: Column) -> Column:
    """The text and what is left of it without one of its characters; texts one edit apart share one of these."""
    without = F.transform(F.sequence(F.lit(1), F.length(text)), lambda i: F.concat(F.substring(text, F.lit(1), i - 1), F.substring(text, i + 1, F.length(text))))
    return F.array_distinct(F.concat(F.array(text), F.when(F.length(text) > 0, without).otherwise(F.array().cast("array<string>"))))


def bands_for(jaccard: float, recall: float) -> tuple[int, int]:
    """(bands, rows): fewest keys with at least one row in a band that find a pair of this Jaccard similarity with this probability."""
    options = []
    for rows in (1, 2, 3, 4):
        hit = jaccard**rows
        bands = 1 if hit >= 1 else math.ceil(math.log(1 - recall) / math.log(1 - hit))
        if bands <= MAX_KEYS // 4:
            options.append((bands, rows))
    return options[-1] if options else (0, 0)


def _band_cells(grams: Column, bands: int, rows: int) -> Column:
    def least(seed: Column) -> Column:
        return F.array_min(F.transform(grams, lambda g: F.xxhash64(g, seed)))

    return F.transform(F.sequence(F.lit(0), F.lit(bands - 1)), lambda k: F.xxhash64(k, *[least(k * rows + j) for j in range(rows)]))


def _crossed(keys: Column, cells: Column) -> Column:
    return F.flatten(F.transform(keys, lambda k: F.transform(cells, lambda x: F.xxhash64(k, x))))


def _column_cells(df: DataFrame, columns: dict[str, str], need: dict[str, float], date_days: float, recall: float) -> list[tuple[int, Column, bool]]:
    """Of each column with a floor: (cells a record has at most or on average, the cells, whether they lose no pair)."""
    texts = [c for c in need if columns[c] == "text"]
    told = df.agg(*[f(F.length(c)).alias(f"{n}_{c}") for c in texts for n, f in (("most", F.max), ("mean", F.avg))]).first() if texts else None
    cells: list[tuple[int, Column, bool]] = []
    for c, least in need.items():
        v, kind = F.col(c), columns[c]
        if kind == "number":
            cells.append((1 if least >= 1 else 2, _number_cells(v, least), True))
        elif kind == "date":
            cells.append((2, _date_cells(v, least, date_days), True))
        elif kind == "exact" or least >= 1:
            cells.append((1, F.array(F.xxhash64(F.lower(v) if kind in ("text", "ngram") else v)), True))
        elif kind == "text":
            edits, mean = math.floor((1 - least) * (told[f"most_{c}"] or 0) + 1e-9), told[f"mean_{c}"] or 0
            if edits <= 1:
                found = deletions(F.lower(v)) if edits else F.array(F.lower(v))
                cells.append((1 + edits * math.ceil(mean), F.transform(found, lambda t: F.xxhash64(t)), True))
                continue
            m, lost = mean + 2, 3 * (1 - least) * mean  # an edit changes at most three of the padded text's grams
            bands, rows = bands_for(max(0.01, (m - lost) / (m + lost)), recall)
            if bands:
                cells.append((bands, _band_cells(char_ngrams(F.concat(F.lit("\x02\x02"), F.lower(v), F.lit("\x03\x03")), 3), bands, rows), False))
        elif kind == "ngram":
            bands, rows = bands_for(least, recall)
            grams = char_ngrams(F.lower(v), 3)
            if bands:  # texts without grams are similar only when equal
                cells.append((bands, F.when(F.size(grams) > 0, _band_cells(grams, bands, rows)).otherwise(F.array(F.xxhash64(F.lower(v)))), False))
    return cells


def _keys_of(df: DataFrame, columns: dict[str, str], weights: dict[str, float] | None, threshold: float, method: str, date_days: float, recall: float, within: Column | None, lossless: bool = False) -> tuple[Column | None, bool]:
    """(keys, whether they lose no pair), see ``record_keys``; without any cell the keys are None."""
    return _counted_keys(df, columns, weights, threshold, method, date_days, recall, within, lossless)[:2]


def _counted_keys(df: DataFrame, columns: dict[str, str], weights: dict[str, float] | None, threshold: float, method: str, date_days: float, recall: float, within: Column | None, lossless: bool = False) -> tuple[Column | None, bool, int]:
    """``_keys_of`` with the keys that a record has, at most or on average, for each of ``within``.

    ``lossless``: only from cells that lose none. Without floors, pairs by exact_subset still agree in all columns of one of
    the least sets that reach the threshold together; each set gives keys of its own.
    """
    need = floors(columns, weights, threshold, method)
    start = F.array(F.lit(0).cast("long")) if within is None else F.transform(within, lambda k: F.xxhash64(k))

    def crossed(need: dict[str, float], keys: Column) -> tuple[Column | None, bool, int]:
        cells = [x for x in _column_cells(df, columns, need, date_days, recall) if x[2] or not lossless]
        known, size, sure = F.when(total([F.col(c).isNull().cast("int") for c in need]) == 0, keys).otherwise(F.array().cast("array<bigint>")) if need else keys, 1, True
        for n, found, exact in sorted(cells, key=lambda x: x[0]):
            if size > 1 and size * n > MAX_KEYS:
                break
            size, sure = size * n, sure and exact
            known = _crossed(known, found)
        return (known if cells else None), sure, size

    keys, sure, size = crossed(need, start)
    if keys is None and method == "exact_subset" and threshold > 1e-6 and len(columns) <= 6:
        weights = weights or dict.fromkeys(columns, 1.0)
        whole, sets = sum(weights[c] for c in columns), []
        for n in range(1, len(columns) + 1):
            for s in combinations(columns, n):
                if sum(weights[c] for c in s) / whole >= threshold - 1e-9 and not any(set(t) <= set(s) for t in sets):
                    sets.append(s)
        parts = [crossed({c: 1e-9 if columns[c] == "date" else 1.0 for c in s}, F.transform(start, lambda k, i=i: F.xxhash64(k, F.lit(i)))) for i, s in enumerate(sets)]
        keys, size = F.concat(*[F.coalesce(p, F.array().cast("array<bigint>")) for p, _, _ in parts]) if parts else None, sum(n for _, _, n in parts)
    return (None if keys is None else F.array_distinct(keys)), sure, size


def record_keys(df: DataFrame, columns: dict[str, str], weights: dict[str, float] | None = None, threshold: float = 0.8, method: str = "composite", date_days: float = 30.0, recall: float = 0.99, within: Column | None = None) -> Column:
    """An array of hashed keys per record; records of a pair at the threshold share one.

    ``within``: an array of block keys, which every key then holds one of. A NULL in a column that has a floor leaves the
    record without keys, for it can't reach the threshold. Lengths of texts are read once to choose their cells.
    """
    keys, _ = _keys_of(df, columns, weights, threshold, method, date_days, recall, within)
    if keys is None:
        raise ValueError(f"no column has to reach a similarity in a pair at {threshold}; give blocks or a higher threshold")
    return keys


def _texts(df: DataFrame, column: Column) -> Column:
    """A block column, or array of several, as an array of its texts without NULL."""
    kind = df.select(column.alias("k")).schema["k"].dataType.typeName()
    return F.filter(F.transform(column if kind == "array" else F.array(column), lambda k: k.cast("string")), lambda k: k.isNotNull())


def _class_pairs(reps: DataFrame, columns: dict[str, str], threshold: float, candidates: str, method: str, weights: dict[str, float] | None, date_days: float, recall: float, held: tuple[str, ...] = (), few: bool = False) -> DataFrame:
    """(a, b, similarity, <h>_a, <h>_b) at the threshold, once each, of the first records of classes; their blocks are the array _keys.

    Pairs of a block are sought by keys inside it where keys lose no pair, and a union needs no blocks then. With ``few`` keys
    records carry them, and nothing is shuffled after they have met; ``held`` columns come along only so.
    """
    args = (columns, weights, threshold, method, date_days, recall)
    reps, blocks = reps.withColumnRenamed("_keys", "_blocks"), F.col("_blocks")
    if candidates == "block":
        keys, _ = _keys_of(reps, *args, blocks, lossless=True)
        keys = F.transform(blocks, lambda k: F.xxhash64(k)) if keys is None else keys
    elif candidates == "intersection":
        keys = record_keys(reps, *args, blocks)
    else:
        keys, sure = record_keys(reps, *args), candidates == "lsh" or _keys_of(reps, *args, None)[1]
        if not sure:
            inside, _ = _keys_of(reps, *args, F.transform(blocks, lambda k: F.concat(F.lit("block "), k)), lossless=True)
            keys = F.concat(F.transform(blocks, lambda k: F.xxhash64(k)) if inside is None else inside, keys)
    # keys are hashes: a pair inside blocks must share a block's name too
    named = ["_blocks"] if candidates in ("block", "intersection") else []
    texts = [] if method == "exact_subset" else [c for c in columns if columns[c] == "text"]
    kinds, told = {c: "lowered" if c in texts else k for c, k in columns.items()}, [f"{n}_{c}" for c in texts for n in ("_bag", "_len")]
    compared = [(F.lower(F.col(c)) if c in texts else F.col(c)).alias(c) for c in columns]
    bags = [x for c in texts for x in (letter_bag(F.col(c)).alias(f"_bag_{c}"), F.length(F.lower(F.col(c))).alias(f"_len_{c}"))]
    keyed = materialize(reps.select("id", *compared, *named, *held, *bags, F.array_distinct(keys).alias("_cells")), "keys")  # made once, read for sizes and both sides
    bounds = ({"granted": ("ngram",), "bags": True}, {}) if texts or "ngram" in columns.values() else ({},)  # Java compiles no method of over 8,000 bytes
    asked = [score_of(kinds, weights, method, date_days, "_x", "_y", **bound) >= threshold - 1e-9 for bound in bounds]  # what costs little to tell is told first
    if named:
        asked.append(F.arrays_overlap("_blocks_x", "_blocks_y"))
    seen, similarity = [*columns, *named, *told], {"similarity": score_of(kinds, weights, method, date_days, "_x", "_y")}
    if few:
        asked.append(F.array_min(F.array_intersect("_cells_x", "_cells_y")) == F.col("_cell_x"))
        dealt = keyed.withColumn("_cell", F.explode("_cells"))
        pairs = blocked_pairs(dealt, "id", F.col("_cell"), [*seen, "_cells", "_cell", *held], once=False, asked=asked, values=similarity)
        return pairs.select("a", "b", "similarity", *[f"{h}_{x}" for x in "ab" for h in held])
    pairs = blocked_pairs(keyed, "id", F.col("_cells"), seen, once=False, asked=asked, values=similarity)
    return pairs.groupBy("a", "b").agg(F.max("similarity").alias("similarity"))


def _few_keys(df: DataFrame, columns: dict[str, str], threshold: float, candidates: str, method: str, weights: dict[str, float] | None, date_days: float, recall: float) -> bool:
    """Whether records have at most FEW_KEYS keys for each of their blocks."""
    keys, _, size = _counted_keys(df, columns, weights, threshold, method, date_days, recall, None, lossless=candidates == "block")
    return candidates in ("block", "intersection") and (1 if keys is None else size) <= FEW_KEYS


def similar_pairs(df: DataFrame, id_col: str, columns: dict[str, str], threshold: float = 0.8, candidates: str = "lsh", block: Column | None = None, method: str = "composite", weights: dict[str, float] | None = None, date_days: float = 30.0, recall: float = 0.99) -> DataFrame:
    """(a, b, similarity) of record pairs at the threshold, once each; ids are unique.

    ``candidates``: records that share a block, a key ("lsh"), a key and a block ("intersection"), or a key or a block
    ("union"). ``block`` is a column or an array of several. Records alike in all compared columns and blocks are compared
    once. Scores are the join's own condition, so no pair below the threshold leaves it. Records too empty to reach the
    threshold don't enter. With few keys a record the pairs are not shuffled at all, and records alike meet in ``bundles``.
    """
    args = (columns, threshold, candidates, method, weights, date_days, recall)
    rows = _enough(df, columns, threshold, candidates, block, method, weights, date_days)
    itself = score_of(columns, weights, method, date_days, "", "").alias("similarity")
    if _few_keys(rows, *args):
        found = bundles(rows.withColumn("_keys", _texts(df, block)), id_col, ["_keys", *columns])
        own = found.where(F.size("_keys") > 0).select(F.col("id").alias("a"), F.col("id").alias("b"), itself, *[F.col("_rows").alias(f"_rows_{x}") for x in "ab"])
        return opened(_class_pairs(found, *args, held=("_rows",), few=True).unionByName(own)).select("a", "b", "similarity")
    found = _alike(df, id_col, columns, threshold, candidates, block, method, weights, date_days)
    reps = found.where("id = rep")
    pairs = _class_pairs(reps, *args)
    own = reps.where(F.col("_last") != F.col("id")).where(F.lit(True) if candidates in ("lsh", "union") else F.size("_keys") > 0)
    return expanded(pairs.unionByName(own.select(F.col("id").alias("a"), F.col("id").alias("b"), itself)), found.select("id", "rep"))


def _enough(df: DataFrame, columns: dict[str, str], threshold: float, candidates: str, block: Column | None, method: str, weights: dict[str, float] | None, date_days: float) -> DataFrame:
    """The records that reach the threshold with their own copy."""
    if candidates not in CANDIDATES:
        raise ValueError(f"candidates {candidates!r} is not one of {CANDIDATES}")
    if block is None and candidates != "lsh":
        raise ValueError(f"candidates {candidates!r} need a block")
    return df.where(score_of(columns, weights, method, date_days, "", "") >= threshold - 1e-9)


def _alike(df: DataFrame, id_col: str, columns: dict[str, str], threshold: float, candidates: str, block: Column | None, method: str, weights: dict[str, float] | None, date_days: float) -> DataFrame:
    """``classes`` of the records that reach the threshold with their own copy; _keys holds their blocks."""
    rows = _enough(df, columns, threshold, candidates, block, method, weights, date_days)
    return classes(rows, id_col, F.array().cast("array<string>") if block is None or candidates == "lsh" else _texts(df, block), list(columns))


def similar_groups(df: DataFrame, id_col: str, columns: dict[str, str], threshold: float = 0.8, candidates: str = "lsh", block: Column | None = None, method: str = "composite", weights: dict[str, float] | None = None, date_days: float = 30.0, recall: float = 0.99) -> DataFrame:
    """(id, group_id, is_duplicate, similarity) of all rows: components of the similar pairs, named by their smallest id.

    Records equal in all compared columns are one class, which meets others as its smallest id, so copies form no pairs.
    similarity is the best of a row's pairs, copies included, 0 without one. A record that can't reach the threshold with
    its own copy stays alone.
    """
    known = _alike(df, id_col, columns, threshold, candidates, block, method, weights, date_days)
    known = known.withColumn("_self", score_of(columns, weights, method, date_days, "", ""))
    found = materialize(_class_pairs(known.where("id = rep"), columns, threshold, candidates, method, weights, date_days, recall), "pairs")
    roots = connected_components(found.select("a", "b")).withColumnsRenamed({"id": "rep"})
    best = found.select(F.explode(F.array("a", "b")).alias("rep"), "similarity").groupBy("rep").agg(F.max("similarity").alias("best"))
    of_class = known.where("id = rep").select("rep", F.when(F.col("_last") != F.col("rep"), F.col("_self")).alias("copy")).join(roots, "rep", "left").join(best, "rep", "left")
    known = known.select("id", "rep").join(of_class, "rep").select("id", F.coalesce("root", "rep").alias("group_id"), F.greatest(F.coalesce("best", F.lit(0.0)), F.coalesce("copy", F.lit(0.0))).alias("similarity"))
    out = df.select(F.col(id_col).alias("id")).join(known, "id", "left").select("id", F.coalesce("group_id", "id").alias("group_id"), F.coalesce("similarity", F.lit(0.0)).alias("similarity"))
    return out.select(F.col("id").alias(id_col), "group_id", (F.col("group_id") != F.col("id")).alias("is_duplicate"), "similarity")

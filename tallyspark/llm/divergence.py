"""Source divergence audit over a K-squared quadtree of the group-term count matrix.

Terms are runs of letters (A-Z, a-z and any code point above 127); only A-Z are lower-cased.
A language keeps the V terms found in at least ``min_docs`` of its documents (rows), and gives
them dense columns 0..V-1. Every occurring (lang, source) group, and each lang as a whole, has
per kept term ``p = 1 + floor(1e9 * (count + 1) / (N + V))``, N the group's sum
of counts over kept terms; ``f(p, q) = floor((p - q)^2 / q)``. All arithmetic is on longs.

Texts are read once: a task counts the terms of its texts per group, in tables of ``TABLE``
entries, and one shuffle brings a term's counts of all groups together, as one row. The columns
are those rows' places, from per-partition counts.

Part ``pair``: for a group g and each other source h of its lang, the sum of f(p_g, p_h) over all
V kept terms. The matrix is read as a K-squared tree over the columns (arity ``ARITY``): a node
at level l covers ``ARITY^l`` columns. For a pair of groups the trees are walked jointly: a leaf
that is nonzero in either group is priced term by term; a quadrant that is zero in both is
uniform, every term in it has the two groups' zero-count p, and it is priced analytically as
(its columns) x f(p0_g, p0_h). A task holds a node at level ``BLOCK_LEVELS`` for the sources of
two tiles (about ``TILE`` sources each), walks it for every pair of them and gives on only the
pair's sums and the number of leaves entered, so a cell is sent once for each tile of its lang
and a pair's leaves are never rows. What no walk entered, in a block or as whole blocks, is zero
in both; a pair of two empty groups is priced at its root alone.

Part ``term``: for g, each kept term with count > 0 in g and p_g > p_lang, value f(p_g, p_lang),
ranks up to ``top_terms``. Ranks run from 1 per (lang, source, part): value descending, then
item ascending by UTF-8 bytes.

Edges: null text, lang or source read as ''. A group with no kept term still gets its pair rows
(value 0 when V = 0). Repeated rows are documents of their own. Only the columns ``text``,
``lang`` and ``source`` are read, so extra columns cannot clash. An empty table gives no rows.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallyspark.sources.workspace import settle

#: Fixed values of the contract: the term pattern, the scale of p and the smoothing of counts.
TERM = r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
LOWER = "abcdefghijklmnopqrstuvwxyz"
SCALE = 1_000_000_000

#: ``TERM`` on UTF-8 bytes: A-Z lower-cased, every byte outside a term a blank.
BLANKED = bytes(b if b > 127 or chr(b).isalpha() else 32 for b in bytes(range(256)).lower())

ARITY = 16
#: Level of the nodes that a task walks: ``ARITY ** BLOCK_LEVELS`` columns.
BLOCK_LEVELS = 3
#: Sources a tile holds about; a task compares those of two tiles.
TILE = 128
#: Counts that a task holds at most before it gives them on.
TABLE = 400_000
#: Rows of a batch that a task gives on.
BATCH = 50_000

#: Names and terms pass Python as bytes.
COUNTS = "lang binary, source binary, term binary, c long, d long"
PRICED = "lang binary, lo binary, hi binary, ab long, ba long, entered long"
RESULT = "lang string, source string, part string, item string, value long, rank int"


def _p(count: str, total: str, vocab: str):
    return F.expr(f"1 + (CAST({SCALE} AS BIGINT) * ({count} + 1)) div ({total} + {vocab})")


def _f(p: str, q: str):
    return F.expr(f"(({p} - {q}) * ({p} - {q})) div {q}")


def _batches(counts: dict[tuple[bytes, bytes], Counter], docs: dict[tuple[bytes, bytes], Counter]) -> Iterator[pa.RecordBatch]:
    sizes = [len(held) for held in counts.values()]
    group = pa.array(np.repeat(np.arange(len(sizes)), sizes))
    columns = [pa.array([key[i] for key in counts], pa.binary()).take(group) for i in (0, 1)]
    columns.append(pa.array(list(chain.from_iterable(counts.values())), pa.binary()))
    columns.append(pa.array(list(chain.from_iterable(held.values() for held in counts.values())), pa.int64()))
    columns.append(pa.array([docs[key][term] for key, held in counts.items() for term in held], pa.int64()))
    batch = pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "c", "d"])
    for at in range(0, batch.num_rows, BATCH):
        yield batch.slice(at, BATCH)


def _counter(table: int):
    """Rows ``COUNTS`` of the texts of a task: occurrences and documents of a group's terms, in
    several rows for one term if ``table`` counts were reached and given on in between."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, docs, held = {}, {}, 0
        for batch in batches:
            for lang, source, text in zip(*(batch.column(c).to_pylist() for c in ("lang", "source", "text")), strict=True):
                terms, key = text.translate(BLANKED).split(), (lang, source)
                if terms:
                    mine = counts.setdefault(key, Counter())
                    held -= len(mine)
                    mine.update(terms)
                    held += len(mine)
                    docs.setdefault(key, Counter()).update(set(terms))
                if held >= table:
                    yield from _batches(counts, docs)
                    counts, docs, held = {}, {}, 0
        yield from _batches(counts, docs)

    return count


def term_counts(read: DataFrame, min_docs: int) -> DataFrame:
    """(lang, term, cells, lc, part, place): a row for each kept term with its count in each source
    that holds it and in the lang; places count the rows of a partition, lang by lang."""
    counts = read.select(F.col("lang").cast("binary"), F.col("source").cast("binary"), "text").mapInArrow(_counter(TABLE), COUNTS)
    counts = counts.select(*[F.col(c).cast("string").alias(c) for c in ("lang", "source", "term")], "c", "d")
    cells = counts.repartition("lang", "term").groupBy("lang", "term", "source").agg(F.sum("c").alias("c"), F.sum("d").alias("d"))
    terms = cells.groupBy("lang", "term").agg(
        F.collect_list(F.struct("source", "c")).alias("cells"), F.sum("c").alias("lc"), F.sum("d").alias("d")
    )
    placed = terms.where(F.col("d") >= min_docs).sortWithinPartitions("lang", "term")
    return placed.select(
        "lang", "term", "cells", "lc", F.spark_partition_id().alias("part"), F.monotonically_increasing_id().alias("place")
    )


def dense_columns(terms: DataFrame, runs: DataFrame) -> DataFrame:
    """``terms`` with ``col``, 0..V-1 in each lang: the lang's terms in earlier partitions (of the
    lengths ``runs``) and in this one before the row, so no lang has to fit in one task."""
    before = Window.partitionBy("lang").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first")
    shifts = runs.select("lang", "part", shift.alias("shift"))
    return terms.join(shifts, ["lang", "part"]).withColumn("col", F.col("place") + F.col("shift")).drop("part", "place", "shift")


def _read(docs: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    # translate reads bytes that are not UTF-8 as U+FFFD.
    text = F.when(F.is_valid_utf8(text), text).otherwise(F.translate(text, UPPER, LOWER))
    return docs.select(
        F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"),
        F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"),
        text.cast("binary").alias("text"),
    )


def _walk(levels: list[np.ndarray], arity: int, i: int, others: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place in ``others``, leaf) of the leaves nonzero in row i or the other, by joint descent.
    ``levels``: per level from the leaves to the root, which nodes of a row hold a nonzero leaf."""
    at, node = np.nonzero(levels[-1][i] | levels[-1][others])
    for level in levels[-2::-1]:
        at, node = np.repeat(at, arity), (node[:, None] * arity + np.arange(arity)).ravel()
        entered = level[i, node] | level[others[at], node]
        at, node = at[entered], node[entered]
    return at, node


def _pricer(arity: int, span: int):
    """Prices the pairs of one block of columns and two tiles of sources: rows ``PRICED``."""

    def price(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        coded = rows.column("source").combine_chunks().dictionary_encode()
        names, row = coded.dictionary.to_pylist(), coded.indices.to_numpy()
        leaf, p, tile = (rows.column(c).to_numpy() for c in ("leaf", "p", "tile"))
        root, n = leaf < 0, len(names)
        zero, tiles = np.zeros(n, np.int64), np.zeros(n, np.int64)
        zero[row[root]], tiles[row[root]] = p[root], tile[root]
        row, leaf, p = row[~root], leaf[~root], p[~root]
        held, prices = np.zeros((n, span), bool), np.repeat(zero[:, None], span, axis=1)
        held[row, leaf], prices[row, leaf] = True, p
        levels = [held]
        while levels[-1].shape[1] > 1:
            levels.append(levels[-1].reshape(n, -1, arity).any(axis=2))
        order = np.array(sorted(range(n), key=names.__getitem__))
        lo, hi, sums = [], [], []
        for rank, i in enumerate(order):
            others = order[rank + 1 :]
            if key[2] != key[3]:
                others = others[tiles[others] != tiles[i]]
            at, col = _walk(levels, arity, i, others)
            if len(at):
                a, b = prices[i, col], prices[others[at], col]
                square, starts = (a - b) ** 2, np.flatnonzero(np.diff(at, prepend=-1))
                lo += [names[i]] * len(starts)
                hi += [names[j] for j in others[at[starts]]]
                entered = np.diff(starts, append=len(at))
                sums.append((np.add.reduceat(square // b, starts), np.add.reduceat(square // a, starts), entered))
        ab, ba, entered = (np.concatenate(x) for x in zip(*sums, strict=True)) if sums else [np.zeros(0, np.int64)] * 3
        columns = [pa.array(x, pa.binary()) for x in ([key[0].as_py()] * len(lo), lo, hi)]
        return pa.Table.from_arrays([*columns, *map(pa.array, (ab, ba, entered))], ["lang", "lo", "hi", "ab", "ba", "entered"])

    return price


def block_rows(cells: DataFrame, group: DataFrame, span: int) -> DataFrame:
    """What the tasks walk: a row for each cell and, as leaf -1 with its zero-count p, for each
    source in each block, once for each tile of the lang."""
    roots = group.where(F.col("V") > 0).withColumn("block", F.explode(F.expr(f"sequence(0L, (V - 1) div {span}L)")))
    roots = roots.select("lang", "block", "source", F.lit(-1).alias("leaf"), F.col("p0").alias("p"), "tile", "tiles")
    block = F.expr(f"col div {span}L")
    leaf = F.expr(f"int(col % {span}L)")
    leaves = cells.select("lang", block.alias("block"), "source", leaf.alias("leaf"), "p", "tile", "tiles")
    sent = leaves.unionByName(roots).withColumn("o", F.explode(F.expr("sequence(0L, tiles - 1)")))
    return sent.select(
        F.col("lang").cast("binary").alias("lang"), "block",
        F.least("tile", "o").alias("t_lo"), F.greatest("tile", "o").alias("t_hi"),
        F.col("source").cast("binary").alias("source"), "leaf", "p", "tile",
    )


def audit(docs: DataFrame, min_docs: int = 3, top_terms: int = 200) -> DataFrame:
    """``RESULT`` rows: part ``pair`` for every ordered pair of sources of a lang, part ``term``
    for the terms that a source holds more than its lang, up to rank ``top_terms``."""
    read = _read(docs)
    kept = settle(term_counts(read, min_docs), "divergence-terms")
    runs = kept.groupBy("lang", "part").agg(F.min("place").alias("first"), F.count(F.lit(1)).alias("n"))
    sums = kept.select("lang", F.inline("cells")).groupBy("lang", "source").agg(F.sum("c").alias("N"))
    langs = runs.groupBy("lang").agg(F.sum("n").alias("V")).join(sums.groupBy("lang").agg(F.sum("N").alias("LN")), "lang")
    zero = F.lit(0).cast("bigint")
    groups = read.select("lang", "source").distinct()
    tiles = groups.groupBy("lang").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles"))
    group = (
        groups.join(sums, ["lang", "source"], "left")
        .join(langs, "lang", "left")
        .join(tiles, "lang")
        .select("lang", "source", *[F.coalesce(c, zero).alias(c) for c in ("N", "V", "LN")], "tiles")
    )
    group = group.withColumn("tile", F.expr("pmod(xxhash64(source), tiles)"))
    group = settle(group.withColumn("p0", F.when(F.col("N") + F.col("V") > 0, _p("0", "N", "V"))), "divergence-groups")
    cells = dense_columns(kept, runs).select("lang", "term", "col", "lc", F.inline("cells"))
    cells = cells.join(group, ["lang", "source"]).withColumn("p", _p("c", "N", "V"))

    # Part term: against the lang as a whole.
    terms = cells.withColumn("q", _p("lc", "LN", "V")).where(F.col("p") > F.col("q"))
    terms = terms.select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), _f("p", "q").alias("value"))
    by = Window.partitionBy("lang", "source", "part").orderBy(F.col("value").desc(), F.col("item"))
    terms = terms.withColumn("rank", F.row_number().over(by)).where(F.col("rank") <= top_terms)

    # Part pair: walked by block, summed over blocks; the columns not entered are priced analytically.
    keys, span = ["lang", "lo", "hi"], ARITY**BLOCK_LEVELS
    walked = block_rows(cells, group, span).groupBy("lang", "block", "t_lo", "t_hi").applyInArrow(_pricer(ARITY, span), PRICED)
    walked = walked.groupBy(*[F.col(c).cast("string").alias(c) for c in keys]).agg(
        *[F.sum(c).alias(c) for c in ("ab", "ba", "entered")]
    )
    # Every ordered pair; groups that both hold no kept term have all V columns at f(p0, p0').
    a, b = group.alias("a"), group.alias("b")
    pairs = a.join(b, (F.col("a.lang") == F.col("b.lang")) & (F.col("a.source") != F.col("b.source"))).select(
        F.col("a.lang").alias("lang"),
        F.col("a.source").alias("source"),
        F.col("b.source").alias("item"),
        F.col("a.V").alias("V"),
        F.col("a.p0").alias("pa"),
        F.col("b.p0").alias("pb"),
    )
    lo = F.col("source") < F.col("item")
    pairs = pairs.withColumns({"lo": F.least("source", "item"), "hi": F.greatest("source", "item")})
    pairs = pairs.join(walked, keys, "left").withColumn("zero", F.col("V") - F.coalesce("entered", zero)).select(
        "lang",
        "source",
        F.lit("pair").alias("part"),
        "item",
        F.when(F.col("V") == 0, zero)
        .otherwise(F.coalesce(F.when(lo, F.col("ab")).otherwise(F.col("ba")), zero) + F.col("zero") * _f("pa", "pb"))
        .cast("bigint")
        .alias("value"),
    )
    pairs = pairs.withColumn("rank", F.row_number().over(by))
    return pairs.unionByName(terms).select("lang", "source", "part", "item", "value", F.col("rank").cast("int"))

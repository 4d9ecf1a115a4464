"""Near-duplicate documents by ProbMinHash over weighted word shingles.

A shingle's weight is how often it occurs. Each shingle is a Poisson process whose rate is
its weight: arrivals fall on random registers, a register keeps its earliest arrival, and a
process ends once its next arrival is later than every register's. The share of equal
registers of two texts estimates their probability Jaccard similarity (Ertl 2020).

A link asks for similar sets, whatever the counts. So a text with repeated shingles also has the
registers of the same process with weight 1 each, in the same bands; a text without repeats
has them already. Recall then follows the set similarity, also of texts that differ by repeats.

Registers are grouped to bands; texts with an equal band are candidates, and a link is a pair
whose shingle sets have an exact Jaccard similarity of ``similarity`` or more. Classes are the
connected components of the links. Equal texts are one node from the start.

Large buckets are not expanded to pairs. First every member of a bucket is compared with one
leader, the member with most candidates, which joins most copies. Where members of a bucket are
still of different classes, the buckets they share make a family. A family's texts are dealt
into blocks of about ``BLOCK``; a task gets two blocks and compares what shares a band and is
not yet in one class, so a text is sent once for each block of its family. Every pair of
a bucket is thus compared or already in one class, and no pair is written but the links.

Edge cases: words are runs of bytes other than space and \\t to \\r; a text with one to four
words has one shingle, all its words; a text without words is like equal texts only; a NULL
text is empty; rows with a NULL id take part, and class ids ignore them (a class of NULL ids
has a NULL id); repeated ids and rows each give a row; an empty table gives no rows; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.slices import slices
from tallyspark.sources.workspace import settle

#: Text bytes cut to shingles at once in a Python worker.
CHUNK = 1 << 18
BLOCK = 1024
#: Edges that a task joins to trees at once; only what then still spans tasks takes rounds.
EDGES = 200_000


@dataclass(frozen=True)
class Settings:
    words: int = 5
    similarity: float = 0.8
    bands: int = 24
    rows: int = 4


_SPACE = np.zeros(256, dtype=bool)
_SPACE[[32, *range(9, 14)]] = True


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(texts: list[bytes], words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, hash and count of the distinct shingles, sorted by number and hash."""
    raw = np.frombuffer(b" ".join(texts) + b" ", np.uint8)
    ends = np.cumsum([len(t) + 1 for t in texts])
    space = _SPACE[raw]
    starts = np.flatnonzero(~space & np.append(True, space[:-1]))
    if not len(starts):
        return np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.int64)
    stops = np.flatnonzero(space & np.append(False, ~space[:-1]))
    place = np.zeros(len(raw), dtype=np.int64)
    place[starts[0] :] = np.arange(starts[0], len(raw)) - np.repeat(starts, np.diff(np.append(starts, len(raw))))
    powers = np.full(int((stops - starts).max()) + 1, 0x9E3779B97F4A7C15, dtype=np.uint64)
    powers[0] = 1
    powers = np.cumprod(powers, dtype=np.uint64)
    value = (raw.astype(np.uint64) + np.uint64(1)) * powers[np.minimum(place, len(powers) - 1)]
    value[space] = 0
    word = _mix(np.add.reduceat(value, starts))
    doc = np.searchsorted(ends, starts, side="right")
    number = np.bincount(doc, minlength=len(texts))
    hashes, owner = np.zeros(0, np.uint64), np.zeros(0, np.int64)
    if len(word) >= words:
        n = len(word) - words + 1
        joined = word[:n].copy()
        for i in range(1, words):
            joined = joined * np.uint64(0xD6E8FEB86659FD93) + word[i : i + n]
        inside = doc[:n] == doc[words - 1 :]
        hashes, owner = _mix(joined[inside]), doc[:n][inside]
    short = np.flatnonzero((number > 0) & (number < words))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), dtype=np.uint64)
        for i in range(words - 1):
            more = number[short] > i
            at = np.minimum(first + i, len(word) - 1)
            extra = np.where(more, extra * np.uint64(0xA0761D6478BD642F) + word[at], extra)
        hashes, owner = np.append(hashes, _mix(extra)), np.append(owner, short)
    order = np.lexsort((hashes, owner))
    hashes, owner = hashes[order], owner[order]
    new = np.append(True, (hashes[1:] != hashes[:-1]) | (owner[1:] != owner[:-1]))
    head = np.flatnonzero(new)
    return owner[head], hashes[head], np.diff(np.append(head, len(hashes)))


def signatures(owner: np.ndarray, hashes: np.ndarray, weight: np.ndarray, texts: int, registers: int) -> np.ndarray:
    """The shingle that holds each register, one row a text (0 for a text without shingles)."""
    earliest = np.full(texts * registers, np.inf)
    holder = np.zeros(texts * registers, dtype=np.uint64)
    time, turn = np.zeros(len(hashes)), 0
    while len(hashes):
        draw = _mix(hashes + np.uint64((2 * turn + 1) * 0x9E3779B97F4A7C15 % (1 << 64)))
        unit = ((draw >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        time = time - np.log(unit) / weight
        spot = owner * registers + (_mix(draw) % np.uint64(registers)).astype(np.int64)
        np.minimum.at(earliest, spot, time)
        won = time == earliest[spot]
        holder[spot[won]] = hashes[won]
        latest = earliest.reshape(texts, registers).max(axis=1)
        going = time < latest[owner]
        owner, hashes, weight, time = owner[going], hashes[going], weight[going], time[going]
        turn += 1
    return holder.reshape(texts, registers)


def band_keys(registers: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key a band; the band's number is part of it."""
    parts = registers.reshape(len(registers), bands, rows)
    key = np.broadcast_to(np.arange(1, bands + 1, dtype=np.uint64), parts.shape[:2]).copy()
    for i in range(rows):
        key = _mix(key * np.uint64(0xD6E8FEB86659FD93) + parts[:, :, i])
    return key


def text_keys(
    owner: np.ndarray, hashes: np.ndarray, count: np.ndarray, texts: int, settings: Settings
) -> list[np.ndarray]:
    """Keys of the weighted bands and, for a text with repeated shingles, of the bands with weight 1."""
    registers = settings.bands * settings.rows
    held = signatures(owner, hashes, count.astype(float), texts, registers)
    out = list(band_keys(held, settings.bands, settings.rows).view(np.int64))
    odd = np.unique(owner[count > 1])
    if len(odd):
        mine = np.isin(owner, odd)
        place = np.searchsorted(odd, owner[mine])
        held = signatures(place, hashes[mine], np.ones(len(place)), len(odd), registers)
        for i, keys in zip(odd.tolist(), band_keys(held, settings.bands, settings.rows).view(np.int64), strict=True):
            out[i] = np.concatenate([out[i], keys])
    return out


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    start = size = 0
    for i, text in enumerate(texts):
        if i > start and size + len(text) > CHUNK:
            yield start, i
            start, size = i, 0
        size += len(text)
    if len(texts) > start:
        yield start, len(texts)


def _raw(texts: list[str | None]) -> list[bytes]:
    return [(t or "").encode("utf-8", "surrogatepass") for t in texts]


def _node() -> Column:
    return F.unhex(F.md5(F.coalesce("text", F.lit("")).cast("binary")))


def _id_key() -> Column:
    """The id as a join key that NULL has too."""
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _keys(docs: DataFrame, settings: Settings) -> DataFrame:
    """``doc_id``, ``node`` (digest of the text) and the keys of its bands."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, CHUNK):
            texts = _raw(batch.column("text").to_pylist())
            out = []
            for a, b in _blocks(texts):
                owner, hashes, count = shingles(texts[a:b], settings.words)
                found = text_keys(owner, hashes, count, b - a, settings)
                some = np.isin(np.arange(b - a), owner)
                out += [k if s else k[:0] for k, s in zip(found, some, strict=True)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("node"), pa.array(out, pa.list_(pa.int64()))],
                names=["doc_id", "node", "keys"],
            )

    return docs.select("doc_id", _node().alias("node"), "text").mapInArrow(
        rows, f"doc_id {kind}, node binary, keys array<bigint>"
    )


def _sets(docs: DataFrame, nodes: DataFrame, words: int) -> DataFrame:
    """``node`` and its sorted shingle hashes, for the given nodes."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, CHUNK):
            texts = _raw(batch.column("text").to_pylist())
            out = []
            for a, b in _blocks(texts):
                owner, hashes, _ = shingles(texts[a:b], words)
                cut = np.searchsorted(owner, np.arange(1, b - a))
                out += [x.astype("<u8").tobytes() for x in np.split(hashes, cut)]
            yield pa.RecordBatch.from_arrays(
                [batch.column("node"), pa.array(out, pa.binary())], names=["node", "grams"]
            )

    # One document stands for all of one text.
    known = docs.select(_id_key().alias("id_key"), "text")
    known = known.withColumn("node", _node()).join(nodes, ["node", "id_key"], "left_semi")
    return known.select("node", "text").mapInArrow(rows, "node binary, grams binary").dropDuplicates(["node"])


def _jaccard(a: pd.Series, b: pd.Series) -> pd.Series:
    out = []
    for x, y in zip(a, b, strict=True):
        x, y = np.frombuffer(x, "<u8"), np.frombuffer(y, "<u8")
        both = len(np.intersect1d(x, y, assume_unique=True))
        out.append(both / (len(x) + len(y) - both))
    return pd.Series(out, dtype="float64")


def _verified(pairs: DataFrame, sets: DataFrame, similarity: float) -> DataFrame:
    """The pairs (a, b) whose shingle sets are similar enough."""
    left = sets.select(F.col("node").alias("a"), F.col("grams").alias("x"))
    right = sets.select(F.col("node").alias("b"), F.col("grams").alias("y"))
    jaccard = F.pandas_udf(_jaccard, "double")
    return pairs.join(left, "a").join(right, "b").where(jaccard("x", "y") >= similarity).select("a", "b")


def _trees(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges (a, b) of ``EDGES`` at a time as trees of depth one: each node (the least one
    too) with the least node that these edges connect it with."""
    parent: dict = {}
    seen = 0

    def root(node):
        while parent[node] != node:
            parent[node] = node = parent[parent[node]]
        return node

    def told() -> pa.RecordBatch:
        nodes = list(parent)
        return pa.RecordBatch.from_arrays([pa.array(nodes, kind), pa.array(map(root, nodes), kind)], names=["a", "b"])

    for batch in batches:
        kind = batch.column("a").type
        for a, b in zip(batch.column("a").to_pylist(), batch.column("b").to_pylist(), strict=True):
            parent.setdefault(a, a)
            parent.setdefault(b, b)
            low, high = sorted((root(a), root(b)))
            parent[high] = low
            seen += 1
            if seen == EDGES:
                yield told()
                parent.clear()
                seen = 0
    if parent:
        yield told()


def components(edges: DataFrame) -> DataFrame:
    """``node`` and ``comp``, the least node it is connected with, for the nodes of the edges.

    Each task first joins its edges to trees, ``EDGES`` at a time; more edges than that go on in
    rounds. There labels travel along edges and then to their label's label, so rounds grow with
    the logarithm of a chain's length.
    """
    edges = settle(edges.select("a", "b"), "dedup-edges")
    count, kind = edges.count(), edges.schema["a"].dataType.simpleString()
    trees = edges.coalesce(max(1, -(-count // EDGES))).mapInArrow(_trees, f"a {kind}, b {kind}")
    if count <= EDGES:
        return settle(trees.toDF("node", "comp"), "dedup-labels")
    edges = settle(trees, "dedup-trees", replaces=edges)
    both = settle(
        edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(),
        "dedup-edges",
    )
    labels = settle(
        both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")),
        "dedup-labels",
    )
    while True:
        near = both.join(labels.select(F.col("node").alias("b"), "comp"), "b")
        near = near.groupBy(F.col("a").alias("node")).agg(F.min("comp").alias("near"))
        met = labels.join(near, "node").select("node", "comp", F.least("comp", "near").alias("low"))
        # The class a node was in hears of the lower label too.
        told = met.groupBy("comp").agg(F.min("low").alias("low")).withColumnRenamed("comp", "root")
        met = met.join(told.select(F.col("root").alias("comp"), F.col("low").alias("told")), "comp")
        met = met.select("node", F.col("comp").alias("old"), F.least("low", "told").alias("comp"))
        jump = told.select(F.col("root").alias("comp"), F.col("low").alias("next"))
        met = met.join(jump, "comp", "left")
        labels = settle(
            met.select("node", "old", F.coalesce(F.least("next", "comp"), "comp").alias("comp")), "dedup-labels"
        )
        if labels.where("old <> comp").isEmpty():
            return labels.select("node", "comp")
        labels = labels.select("node", "comp")


def classes(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``class_id`` (least id of its class) and ``class_size`` of every document."""
    documents, comps = _linked(docs, settings)
    named = documents.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    about = named.groupBy("comp").agg(F.min("doc_id").alias("class_id"), F.count(F.lit(1)).alias("class_size"))
    return named.join(about, "comp").select("doc_id", "class_id", "class_size")


def _linked(docs: DataFrame, settings: Settings) -> tuple[DataFrame, DataFrame]:
    """All documents with their node, and the class of each node that has links."""
    keyed = settle(_keys(docs, settings), "dedup-keys")
    texts = keyed.groupBy("node").agg(
        F.min("doc_id").alias("doc_id"), F.first("keys").alias("keys")
    )
    exploded = texts.select("node", F.explode(F.array_distinct("keys")).alias("key"))
    several = exploded.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1")
    members = settle(exploded.join(several, "key"), "dedup-members")
    degree = members.groupBy("node").agg(F.sum("n").alias("degree"))
    members = settle(members.drop("n").join(degree, "node"), "dedup-members")
    wanted = texts.select("node", _id_key().alias("id_key")).join(degree, "node", "left_semi")
    sets = settle(_sets(docs, wanted, settings.words), "dedup-sets")
    best = F.max(F.struct("degree", "node")).alias("l")
    leaders = members.groupBy("key").agg(best).select("key", F.col("l.node").alias("leader"))
    led = members.join(leaders, "key").where(F.col("leader") != F.col("node"))
    pairs = led.select(F.least("leader", "node").alias("a"), F.greatest("leader", "node").alias("b")).distinct()
    links = settle(_verified(pairs, sets, settings.similarity), "dedup-links")
    comps = components(links)
    more = _family_links(members, sets, comps, texts, settings)
    every = settle(links.unionByName(more), "dedup-links")
    return keyed.select("doc_id", "node"), components(every)


def _family_links(
    members: DataFrame, sets: DataFrame, comps: DataFrame, texts: DataFrame, settings: Settings
) -> DataFrame:
    """Links between different classes that share a bucket."""
    classed = members.select("key", "node").join(comps, "node", "left")
    classed = classed.withColumn("comp", F.coalesce("comp", "node"))
    range_ = classed.groupBy("key").agg(F.min("comp").alias("low"), F.max("comp").alias("high"), F.min("node").alias("root"))
    mixed = settle(classed.join(range_.where("low <> high"), "key").select("node", "comp", "root"), "dedup-mixed")
    families = components(mixed.where("node <> root").select(F.col("root").alias("a"), F.col("node").alias("b")))
    sizes = families.groupBy(F.col("comp").alias("family")).agg(F.count(F.lit(1)).alias("n"))
    families = families.select("node", F.col("comp").alias("family"))
    known = (
        families.join(mixed.select("node", "comp").distinct(), "node")
        .join(sizes, "family")
        .withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int"))
        .withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
        .join(texts.select("node", "keys"), "node")
        .join(sets, "node")
    )
    other = F.explode(F.expr("sequence(0, blocks - 1)"))
    dealt = known.select("family", "node", "comp", "block", "keys", "grams", other.alias("other"))
    dealt = dealt.withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
    return dealt.groupBy("family", "x", "y").applyInPandas(_compare_blocks(settings), "a binary, b binary")


def _compare_blocks(settings: Settings):
    def compare(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("node", kind="stable").reset_index(drop=True)
        # Without repeats, the keys of weight 1 are the weighted ones.
        keys = np.stack([np.resize(np.asarray(k, dtype=np.int64), 2 * settings.bands) for k in rows["keys"]])
        grams = [np.frombuffer(g, "<u8") for g in rows["grams"]]
        sizes = np.array([len(g) for g in grams])
        names = np.unique(rows["comp"].to_numpy(dtype=object), return_inverse=True)[1]
        block, x, y = rows["block"].to_numpy(), rows["x"].iloc[0], rows["y"].iloc[0]
        parent = list(range(len(rows)))

        def root(i: int) -> int:
            while parent[i] != i:
                parent[i] = parent[parent[i]]
                i = parent[i]
            return i

        shared = np.zeros((len(rows), len(rows)), dtype=np.int16)
        for weighted, plain in zip(keys.T[: settings.bands], keys.T[settings.bands :], strict=True):
            shared += plain[:, None] == plain[None, :]
            odd = np.flatnonzero(weighted != plain)
            if len(odd):
                across = weighted[odd, None] == plain[None, :]
                shared[odd] += across
                shared[:, odd] += across.T
                shared[np.ix_(odd, odd)] += weighted[odd, None] == weighted[None, odd]
        able = np.triu(shared > 0, 1) & (names[:, None] != names[None, :])
        if x != y:
            able &= block[:, None] != block[None, :]
        low, high = np.minimum(sizes[:, None], sizes[None, :]), np.maximum(sizes[:, None], sizes[None, :])
        able &= low / high >= settings.similarity
        i, j = np.nonzero(able)
        likely = np.argsort(-shared[i, j], kind="stable")
        out = []
        for a, b in zip(i[likely].tolist(), j[likely].tolist(), strict=True):
            u, v = root(int(names[a])), root(int(names[b]))
            if u == v:
                continue
            both = len(np.intersect1d(grams[a], grams[b], assume_unique=True))
            if both / (sizes[a] + sizes[b] - both) >= settings.similarity:
                parent[u] = v
                out.append((rows["node"][a], rows["node"][b]))
        return pd.DataFrame(out, columns=["a", "b"])

    return compare


def keep_one(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One document of each class, the one of least id (NULL last), all columns as they are.

    Of rows that share this id and the text one is kept.
    """
    documents, comps = _linked(docs, settings)
    named = documents.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    chosen = named.groupBy("comp").agg(
        F.min_by(F.struct("doc_id", "node"), F.struct(F.col("doc_id").isNull(), "doc_id", "node")).alias("c")
    )
    chosen = chosen.select("c.doc_id", F.col("c.node").alias("_d_node"))
    chosen = chosen.select("_d_node", _id_key().alias("_d_key"))
    keyed = docs.withColumns({"_d_node": _node(), "_d_key": _id_key()})
    # Joined and freed of repeats on one distribution: the texts are shuffled once.
    kept = keyed.join(chosen, ["_d_node", "_d_key"], "left_semi").dropDuplicates(["_d_node", "_d_key"])
    return kept.select(*docs.columns)

"""Remove repeated byte strings, found by suffix arrays over shards that meet all equal strings.

Every string of ``length`` bytes has an anchor: the k-mer of least hash in it. Equal strings
have equal anchors, so they meet if they are dealt by the anchor's hash.

1. Documents are dealt into blocks; each block sends the hashes of its anchors, once each.
2. Hashes seen in two blocks go back; each block sends, for its repeated anchors, the
   segments covering all strings of that anchor, equal segments once, to the shard of the hash.
3. A shard takes its different segments anchor by anchor. Strings whose hash no other string
   has are left out; what the others cover is joined to one text, whose suffixes are sorted by
   induction. Common prefixes then tell, byte for byte, which strings start earlier elsewhere.
4. Marks go back to the blocks, which cut out what they cover.

A passage in a third of all documents reaches a shard once a block, however often it occurs.
Each block sends each shard one row, so blocks and shards hold ``WIDE`` times ``block_bytes`` of
text on large inputs, and their number follows the input; about ``block_bytes`` are sorted at once.

"Earlier" is by document id (NULL first), for equal ids by a hash of the text, then by
position. Edge cases: a NULL text is empty; texts shorter than ``length`` keep all bytes; of
equal rows one counts as first; an empty table gives no rows; other columns are ignored. One
document must fit into a task's memory about thirty times over.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.suffixes import common_prefixes, suffix_array

K = 16
#: Bytes worked at in one step: their arrays fit a core's cache.
CHUNK = 1 << 17
#: ``block_bytes`` in a block or shard of a large input; so many blocks, if the input has them, are no loss.
WIDE, FEW = 4, 512
_NONE = np.iinfo(np.int64).min
#: A segment on its way to a shard, without its bytes, and a run of marked strings on its way back.
#: ``doc`` is the document's place in its block.
SEGMENT = np.dtype([("id", "<i8"), ("tie", "<i8"), ("anchor", "<u8"), ("doc", "<i4"), ("first", "<i4"), ("size", "<i4"), ("null", "?")])
MARK = np.dtype([("doc", "<i4"), ("first", "<i4"), ("count", "<i4")])


@dataclass(frozen=True)
class Settings:
    length: int = 100
    block_bytes: int = 2 << 20


def _table() -> np.ndarray:
    x = np.arange(1, 257, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(27))


BYTES = _table()
#: An odd number and its inverse modulo 2^64.
_BASE = 0xD6E8FEB86659FD93
_BACK = pow(_BASE, -1, 1 << 64)


def _kmers(raw: np.ndarray) -> np.ndarray:
    """64-bit hashes of all K-mers (K a power of two), by doubling."""
    h, power, width = BYTES[raw], _BASE, 1
    while width < K:
        h = h[:-width] * np.uint64(power) + h[width:]
        power, width = power * power % (1 << 64), 2 * width
    h ^= h >> np.uint64(32)
    h *= np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(29))


def anchors(raw: np.ndarray, ends: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Anchor hash, first string and number of strings of each run of strings with one anchor.

    ``raw``: documents of one chunk in a row, ending at ``ends``; no string crosses an end.
    """
    empty = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    n = len(raw) - length + 1
    if n < 1:
        return empty
    hashes = _kmers(raw)
    mask = np.uint64((1 << 32) - 1)  # the same in every chunk, so that equal strings have equal anchors
    least = (hashes & ~mask) | np.arange(len(hashes), dtype=np.uint64)
    width, wanted = 1, length - K + 1
    while 2 * width <= wanted:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wanted > width:
        least = np.minimum(least[: -(wanted - width)], least[wanted - width :])
    begins = np.append(0, ends[:-1])
    inside = np.zeros(n + 1, dtype=np.int64)
    long = ends - begins >= length
    np.add.at(inside, begins[long], 1)
    np.add.at(inside, ends[long] - length + 1, -1)
    usable = np.cumsum(inside)[:n] > 0
    new = usable.copy()
    new[1:] &= ~usable[:-1] | (least[1:n] != least[: n - 1])
    first = np.flatnonzero(new)
    if not len(first):
        return empty
    stop = usable.copy()
    stop[:-1] &= ~usable[1:] | new[1:]
    count = np.flatnonzero(stop) - first + 1
    return hashes[(least[first] & mask).astype(np.int64)], first, count


class Block:
    """The documents of one block in their order, with their anchors."""

    def __init__(self, rows: pd.DataFrame, length: int) -> None:
        ids = rows["doc_id"].to_numpy(dtype=object)
        self.ids = np.array([_NONE if pd.isna(i) else int(i) for i in ids], dtype=np.int64)
        self.null = np.array([bool(pd.isna(i)) for i in ids], dtype=bool)
        self.tie = rows["tie"].to_numpy(dtype=np.int64)
        order = np.lexsort((self.tie, self.ids, ~self.null))
        self.ids, self.tie, self.null = self.ids[order], self.tie[order], self.null[order]
        texts = rows["text"].tolist()
        self.texts = [(texts[i] or "").encode("utf-8", "surrogatepass") for i in order]
        self.length = length

    def chunks(self) -> Iterator[tuple[int, int, bytes, np.ndarray]]:
        start = size = 0
        for i, text in enumerate(self.texts):
            if i > start and size + len(text) > CHUNK:
                yield self._chunk(start, i)
                start, size = i, 0
            size += len(text)
        if len(self.texts) > start:
            yield self._chunk(start, len(self.texts))

    def _chunk(self, a: int, b: int) -> tuple[int, int, bytes, np.ndarray]:
        return a, b, b"".join(self.texts[a:b]), np.cumsum([len(t) for t in self.texts[a:b]])

    def runs(self) -> Iterator[tuple[bytes, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Per chunk: text, hashes, firsts, counts, document numbers and firsts inside documents."""
        for a, _, text, ends in self.chunks():
            hashes, first, count = anchors(np.frombuffer(text, np.uint8), ends, self.length)
            doc = np.searchsorted(ends, first, side="right")
            begins = np.append(0, ends[:-1])
            yield text, hashes, first, count, a + doc, first - begins[doc]


def _rows(shard: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order by shard, and of each shard its number and its place in that order."""
    order = np.argsort(shard, kind="stable")
    ranked = shard[order]
    cut = np.flatnonzero(ranked[1:] != ranked[:-1]) + 1
    first = np.append(0, cut)[: len(ranked)]
    return order, list(zip(ranked[first].tolist(), first.tolist(), np.append(cut, len(ranked)).tolist(), strict=False))


def _send_hashes(settings: Settings, shards: int):
    def send(rows: pd.DataFrame) -> pd.DataFrame:
        found = [h for _, h, *_ in Block(rows, settings.length).runs()]
        values = np.unique(np.concatenate(found)).astype("<u8")
        order, parts = _rows((values % np.uint64(shards)).astype(np.int64))
        values = values[order]
        found = pd.DataFrame([(s, values[a:b].tobytes()) for s, a, b in parts], columns=["shard", "hashes"])
        found.insert(1, "block", np.int64(rows["block"].iloc[0]))
        return found

    return send


def _answer(rows: pd.DataFrame) -> pd.DataFrame:
    """To each block its hashes that another block has too."""
    parts = rows["hashes"].tolist()
    sent = np.frombuffer(b"".join(parts), "<u8")
    _, which, count = np.unique(sent, return_inverse=True, return_counts=True)
    shared = count[which] > 1
    ends = np.cumsum([len(x) // 8 for x in parts])
    stop = np.append(0, np.cumsum(shared))[np.append(0, ends)]
    kept = sent[shared]
    out = [(n, kept[a:b].tobytes()) for n, a, b in zip(rows["block"], stop[:-1].tolist(), stop[1:].tolist(), strict=True) if b > a]
    return pd.DataFrame(out, columns=["block", "hashes"])


def _within(values: np.ndarray, some: np.ndarray) -> np.ndarray:
    """Which values are among ``some``, which are in order."""
    if not len(some):
        return np.zeros(len(values), dtype=bool)
    return some[np.minimum(np.searchsorted(some, values), len(some) - 1)] == values


def _firsts(segments: list[bytes]) -> np.ndarray:
    """Of each segment the place of the first one equal to it."""
    seen: dict[bytes, int] = {}
    return np.fromiter((seen.setdefault(x, i) for i, x in enumerate(segments)), np.int64, len(segments))


_SENT = ["shard", "block", "segments", "data", "marks"]


def _send_segments(settings: Settings, shards: int):
    def send(key, docs: pd.DataFrame, answers: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame([], columns=_SENT)
        block, own = Block(docs, settings.length), int(docs["block"].iloc[0])
        runs = list(block.runs())
        local, count = np.unique(np.concatenate([r[1] for r in runs]), return_counts=True)
        back = np.frombuffer(b"".join(answers["hashes"]), "<u8")
        wanted = np.union1d(back, local[count > 1])
        told, data = [], []
        for text, hashes, first, count, doc, inner in runs:
            repeated = np.flatnonzero(_within(hashes, wanted))
            part = np.zeros(len(repeated), SEGMENT)
            part["id"], part["tie"], part["null"] = (x[doc[repeated]] for x in (block.ids, block.tie, block.null))
            part["anchor"], part["doc"], part["first"] = hashes[repeated], doc[repeated], inner[repeated]
            part["size"] = count[repeated] + settings.length - 1
            told.append(part)
            data += [text[a : a + n] for a, n in zip(first[repeated].tolist(), part["size"].tolist(), strict=True)]
        told = np.concatenate(told)
        once = _firsts(data) == np.arange(len(data))
        again, kept = told[~once], np.flatnonzero(once)
        order, parts = _rows((told["anchor"][kept] % np.uint64(shards)).astype(np.int64))
        kept = kept[order]
        told = told[kept]
        out = [
            (shard, own, told[a:b].tobytes(), b"".join([data[i] for i in kept[a:b].tolist()]), b"")
            for shard, a, b in parts
        ]
        if len(again):
            marks = _pack(again["doc"], again["first"], again["size"] - settings.length + 1)
            out.append((own % shards, own, b"", b"", marks))
        return pd.DataFrame(out, columns=_SENT)

    return send


def _pack(doc: np.ndarray, first: np.ndarray, count: np.ndarray) -> bytes:
    """Marks: runs of strings, joined where they touch."""
    order = np.lexsort((first, doc))
    doc, first, count = doc[order], first[order], count[order]
    ends = first + count
    head = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (first[1:] > ends[:-1])))
    out = np.zeros(len(head), MARK)
    out["doc"], out["first"] = doc[head], first[head]
    out["count"] = np.maximum.reduceat(ends, head) - first[head]
    return out.tobytes()


def _string_hashes(segments: list[bytes], length: int) -> np.ndarray:
    """64-bit hashes of all strings of the segments, one after the other; sums of powers modulo 2^64."""
    raw = np.frombuffer(b"".join(segments), np.uint8)
    sizes = np.array([len(x) for x in segments])
    room = np.repeat(np.cumsum(sizes), sizes) - np.arange(len(raw))
    at = np.flatnonzero(room >= length)
    power = np.full(len(raw), _BASE, dtype=np.uint64)
    power[0] = 1
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(BYTES[raw] * np.multiply.accumulate(power), out=total[1:])
    power[1:] = _BACK
    return (total[at + length] - total[at]) * np.multiply.accumulate(power)[at]


def _twice(hashes: np.ndarray) -> np.ndarray:
    """Which hashes come twice or more."""
    order = np.argsort(hashes)
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    out = np.zeros(len(hashes), dtype=bool)
    out[order[1:][same]] = True
    out[order[:-1][same]] = True
    return out


def mark_shard(segments: list[bytes], hashes: np.ndarray, order: np.ndarray, length: int) -> list[np.ndarray]:
    """For each of the different segments, which of its strings start earlier elsewhere.

    ``order``: rank of a segment's first string among all; ranks are far enough apart to add offsets.
    Segments whose anchor no other segment has cannot share a string and stay out of the sort, and
    so does what no string covers whose hash another string has.
    """
    marks = [np.zeros(max(0, len(x) - length + 1), dtype=bool) for x in segments]
    _, which, count = np.unique(hashes, return_inverse=True, return_counts=True)
    used = np.flatnonzero(count[which] > 1)
    if not len(used):
        return marks
    sizes = np.array([len(segments[i]) for i in used])
    cut = np.flatnonzero(np.diff(np.cumsum(sizes) // CHUNK)) + 1
    parts = [[segments[i] for i in part.tolist()] for part in np.split(used, cut)]
    twice = _twice(np.concatenate([_string_hashes(x, length) for x in parts]))
    strings = sizes - length + 1
    hit = np.add.reduceat(twice, np.cumsum(strings) - strings, dtype=np.int64) > 0
    twice, used, sizes = twice[np.repeat(hit, strings)], used[hit], sizes[hit]
    if not len(used):
        return marks
    raw = np.frombuffer(b"\0".join([segments[i] for i in used]) + b"\0", np.uint8)
    owner = np.repeat(np.arange(len(used)), sizes + 1)
    offset = np.arange(len(raw)) - (np.cumsum(sizes + 1) - sizes - 1)[owner]
    strings = np.flatnonzero(sizes[owner] - offset >= length)[twice]
    edges = np.bincount(strings, minlength=len(raw) + 1) - np.bincount(strings + length, minlength=len(raw) + 1)
    covered = np.cumsum(edges)[:-1] > 0
    # A stretch is followed by one byte that nothing covers: its end mark.
    last = np.append(False, covered[:-1] & ~covered[1:])
    taken = np.flatnonzero(covered | last)
    raw, owner, offset, last = raw[taken], owner[taken], offset[taken], last[taken]
    symbols = np.where(last, 0, raw.astype(np.int64) + 1)
    ends = np.flatnonzero(last)
    room = np.repeat(ends, np.diff(ends, prepend=-1)) - np.arange(len(raw))
    sa = suffix_array(symbols)
    prefix = common_prefixes(raw, sa, room, np.append(True, last[:-1]))
    whole = sa[room[sa] >= length]
    head = prefix[whole] < length
    head[:1] = True
    rank = order[used][owner[whole]] + offset[whole]
    group = np.cumsum(head) - 1
    first = np.minimum.reduceat(rank, np.flatnonzero(head)) if len(whole) else rank
    later = whole[rank > first[group]]
    by, parts = _rows(owner[later])
    places = offset[later[by]]
    for i, a, b in parts:
        marks[used[i]][places[a:b]] = True
    return marks


def _portions(anchors: np.ndarray, sizes: np.ndarray, limit: int) -> Iterator[tuple[int, int]]:
    """Stretches of whole anchors, which are in order, that end where they pass ``limit`` bytes."""
    ends = np.append(np.flatnonzero(anchors[1:] != anchors[:-1]) + 1, len(anchors))
    total = np.append(0, np.cumsum(sizes))
    start, upto = 0, total[ends]
    while start < len(anchors):
        at = np.searchsorted(upto, total[start] + limit)
        stop = int(ends[min(at, len(ends) - 1)])
        yield start, stop
        start = stop


def _mark(settings: Settings):
    def mark(rows: pd.DataFrame) -> pd.DataFrame:
        out = [(int(b), m) for b, m in zip(rows["block"], rows["marks"], strict=True) if m]
        told = np.frombuffer(b"".join(rows["segments"]), SEGMENT)
        if not len(told):
            return pd.DataFrame(out, columns=["block", "marks"])
        block = np.repeat(rows["block"].to_numpy(), [len(x) // SEGMENT.itemsize for x in rows["segments"]])
        data = b"".join(rows["data"])
        sizes = told["size"].astype(np.int64)
        begins = np.cumsum(sizes) - sizes
        # Rank of a string: documents in order, then its place in the document.
        order = np.lexsort((told["tie"], told["id"], ~told["null"]))
        ranked = told[["null", "id", "tie"]][order]
        number = np.empty(len(told), dtype=np.int64)
        number[order] = np.append(0, np.cumsum(ranked[1:] != ranked[:-1]))
        rank = number * (int(told["first"].max()) + int(sizes.max()) + 1) + told["first"]
        order = np.lexsort((rank, told["anchor"]))
        doc, first, count = [], [], []
        for start, stop in _portions(told["anchor"][order], sizes[order], settings.block_bytes):
            part = order[start:stop]
            segments = [data[a : a + n] for a, n in zip(begins[part].tolist(), sizes[part].tolist(), strict=True)]
            once = _firsts(segments) == np.arange(len(part))
            where, again = part[once], part[~once]
            different = [segments[i] for i in np.flatnonzero(once).tolist()]
            found = mark_shard(different, told["anchor"][where], rank[where], settings.length)
            # A place that is not marked lies between two segments, so runs end with them.
            between = np.zeros(1, dtype=bool)
            flat = np.concatenate([x for y in found for x in (between, y)] + [between])
            edges = np.diff(flat.view(np.int8))
            opens, closes = np.flatnonzero(edges == 1), np.flatnonzero(edges == -1)
            lies = np.cumsum([0] + [len(x) + 1 for x in found])
            of = np.searchsorted(lies, opens, side="right") - 1
            doc += [where[of], again]
            first += [opens - lies[of], np.zeros(len(again), np.int64)]
            count += [closes - opens, sizes[again] - settings.length + 1]
        at, first, count = (np.concatenate(x) for x in (doc, first, count))
        by, parts = _rows(block[at])
        at, first, count = at[by], first[by], count[by]
        first = first + told["first"][at]
        out += [(b, _pack(told["doc"][at[i:j]], first[i:j], count[i:j])) for b, i, j in parts]
        return pd.DataFrame(out, columns=["block", "marks"])

    return mark


def _spans(marks: np.ndarray, length: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Document, start and end of each stretch of bytes that marked strings cover, in order."""
    begin = marks["doc"].astype(np.int64) * (longest + 1) + marks["first"]
    order = np.argsort(begin)
    begin = begin[order]
    end = np.maximum.accumulate(begin + marks["count"][order] + length - 1)
    head = np.append(True, begin[1:] > end[:-1])[: len(begin)]
    begin, end = begin[head], end[np.append(head[1:], True)[: len(head)]]
    doc = begin // (longest + 1)
    return doc, begin - doc * (longest + 1), end - doc * (longest + 1)


def _cut(settings: Settings):
    def cut(key, docs: pd.DataFrame, marks: pd.DataFrame) -> pd.DataFrame:
        if not len(docs):
            return pd.DataFrame([], columns=["doc_id", "n_bytes", "removed", "kept"])
        block = Block(docs, settings.length)
        found = np.frombuffer(b"".join(marks["marks"]), MARK)
        doc, begin, end = _spans(found, settings.length, max(map(len, block.texts)))
        stop = np.searchsorted(doc, np.arange(len(block.texts) + 1)).tolist()
        spans = list(zip(begin.tolist(), end.tolist(), strict=True))
        out = []
        for n, text in enumerate(block.texts):
            kept, at, removed = [], 0, []
            for a, b in spans[stop[n] : stop[n + 1]]:
                kept.append(text[at:a])
                at = b
                removed.append({"start": a, "end": b})
            kept.append(text[at:])
            out.append((None if block.null[n] else int(block.ids[n]), len(text), removed, b"".join(kept)))
        found = pd.DataFrame(out, columns=["doc_id", "n_bytes", "removed", "kept"])
        return found.astype({"doc_id": "Int64"})

    return cut


def remove_repeats(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """``doc_id``, ``n_bytes``, ``removed`` (byte spans) and ``kept`` (the remaining bytes)."""
    spark = docs.sparkSession
    total = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    few = min(2 * int(spark.conf.get("spark.sql.shuffle.partitions")), FEW, -(-total // settings.block_bytes))
    parts = max(-(-total // (WIDE * settings.block_bytes)), few, 1)
    rows = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text").withColumn("tie", F.xxhash64("text"))
    rows = rows.withColumn("block", F.pmod(F.xxhash64("doc_id", "tie"), F.lit(parts)))
    sent = rows.groupBy("block").applyInPandas(
        _send_hashes(settings, parts), "shard bigint, block bigint, hashes binary"
    )
    answers = sent.groupBy("shard").applyInPandas(_answer, "block bigint, hashes binary")
    segments = (
        rows.groupBy("block")
        .cogroup(answers.groupBy("block"))
        .applyInPandas(
            _send_segments(settings, parts),
            "shard bigint, block bigint, segments binary, data binary, marks binary",
        )
    )
    marks = segments.groupBy("shard").applyInPandas(_mark(settings), "block bigint, marks binary")
    return (
        rows.groupBy("block")
        .cogroup(marks.groupBy("block"))
        .applyInPandas(
            _cut(settings),
            "doc_id bigint, n_bytes bigint, removed array<struct<start:bigint,end:bigint>>, kept binary",
        )
    )

"""Benchmark passages in documents, by the q-gram lemma and banded alignment.

A stretch of ``length`` characters of an item with at most ``k`` edits shares at least
``length + 1 - q * (k + 1)`` q-grams with its copy, all on neighbouring diagonals (document
position minus item position). So shared q-grams are counted in overlapping bands of
diagonals; a band with enough of them close together is a region, and a region counts
only if an alignment inside the band has a stretch of that length within the budget. A
gapless alignment is tried first, then the banded one with gaps.

Case and white space are folded on both sides. First letters and signs one to one, which keeps
all lengths; then, where that differs, with runs of white space as one and full case folding.
Positions are those of the text as written.

The benchmark is the query set. Its text goes to the tasks in blocks of ``block_bytes``;
a larger benchmark means more passes over the documents, each as cheap in memory.

Edge cases: NULL or empty texts and items match nothing; items shorter than ``length``
must match as a whole, with a budget in proportion; items shorter than ``q`` are left
out; repeated items and documents each give their own rows; empty tables give no rows;
other columns pass through ``drop_contaminated`` and are ignored by ``find_passages``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.slices import slices


@dataclass(frozen=True)
class Settings:
    """``length``: characters that make a passage; ``rate``: edits allowed per character."""

    length: int = 80
    rate: float = 0.05
    q: int = 12
    block_bytes: int = 4 << 20


BATCH_CHARS = 1 << 20
_B = 0x9E3779B97F4A7C15


def qgram_hashes(codes: np.ndarray, q: int) -> np.ndarray:
    """64-bit hashes of all q-grams, by doubling."""
    x = (codes.astype(np.uint64) + np.uint64(1)) * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(29)
    done, out, power, width = 0, None, _B, 1
    while True:
        if q & width:
            if out is None:
                out = x
            else:
                n = len(x) - done
                out = out[:n] * np.uint64(power) + x[done : done + n]
            done += width
        if done == q:
            break
        x = x[:-width] * np.uint64(power) + x[width:]
        power = power * power % (1 << 64)
        width *= 2
    out = out[: max(0, len(codes) - q + 1)] * np.uint64(0x94D049BB133111EB)
    return out ^ (out >> np.uint64(31))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each code point that has a case or is space: its one-to-one fold, its full fold's length, whether space."""
    signs = [chr(c) for c in range(0x20000)]
    full = [c.casefold() for c in signs]
    one = [f if len(f) == 1 else low if len(low := c.lower()) == 1 else c for c, f in zip(signs, full, strict=True)]
    space = np.array([c.isspace() for c in signs])
    single = np.array([ord(c) for c in one], dtype=np.uint32)
    single[space] = 32
    return single, np.array([len(f) for f in full]), space


_SINGLE, _LENGTHS, _IS_SPACE = _tables()


def fold_single(text: str) -> str:
    """Case and kinds of white space folded, position by position."""
    codes = code_points(text)
    known = codes < len(_SINGLE)
    folded = np.where(known, _SINGLE[np.where(known, codes, 0)], codes).astype("<u4")
    return folded.tobytes().decode("utf-32-le", "surrogatepass")


def fold_whole(text: str) -> tuple[str, np.ndarray]:
    """The text without outer white space, runs of it as one, in full case folding; and where each sign stood."""
    codes = code_points(text)
    low = np.where(codes < len(_SINGLE), codes, 0)
    space = _IS_SPACE[low]
    keep = ~space
    if keep.any():
        inner = np.flatnonzero(keep)[[0, -1]]
        first = space & ~np.append(False, space[:-1])
        first[: inner[0]] = first[inner[1] :] = False
        keep |= first
    at = np.flatnonzero(keep)
    kept = codes[at].copy()
    kept[space[at]] = 32
    folded = kept.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass").casefold()
    return folded, np.repeat(at, np.where(space[at], 1, _LENGTHS[low[at]]))


class Index:
    """One block of items, searched with folds that keep lengths and, where it differs, with whole folds."""

    def __init__(self, items: list[tuple[object, str]], settings: Settings) -> None:
        known = [(item, text) for item, text in items if text is not None]
        self.single = Grams([(item, fold_single(text)) for item, text in known], settings)
        whole = [(item, fold_single(text), fold_whole(text)[0]) for item, text in known]
        self.whole = Grams([(item, text) for item, _, text in whole], settings)
        self.changed = Grams([(item, text) for item, before, text in whole if text != before], settings)

    def search(self, texts: list[str]) -> list[tuple[int, object, int, int, int]]:
        """(text number, item, start, end, edits), in code points of the text as written, end exclusive."""
        single = [fold_single(t) for t in texts]
        found = self.single.search(single)
        folded = [fold_whole(t) for t in texts]
        differ = np.array([f != s for (f, _), s in zip(folded, single, strict=True)], dtype=bool)
        # A text that folds to the same needs the items only that do not.
        for grams, which in ((self.whole, np.flatnonzero(differ)), (self.changed, np.flatnonzero(~differ))):
            if not len(grams.items):
                continue
            for i, item, start, end, edits in grams.search([folded[i][0] for i in which]):
                at = folded[which[i]][1]
                found.append((int(which[i]), item, int(at[start]), int(at[end - 1]) + 1, edits))
        return sorted(_merged(found), key=lambda r: (r[0], r[2], str(r[1])))


class Grams:
    """q-grams of items."""

    def __init__(self, items: list[tuple[object, str]], settings: Settings) -> None:
        self.q, self.items = settings.q, []
        length, budget, need = [], [], []
        for item, text in items:
            if text is None or len(text) < settings.q:
                continue
            n = min(len(text), settings.length)
            k = int(settings.rate * n)
            while k and n + 1 - settings.q * (k + 1) < 1:
                k -= 1
            self.items.append((item, code_points(text)))
            length.append(n)
            budget.append(k)
            need.append(max(1, n + 1 - settings.q * (k + 1)))
        self.length, self.budget, self.need = (np.array(x, dtype=np.int64) for x in (length, budget, need))
        grams = [qgram_hashes(codes, self.q) for _, codes in self.items]
        sizes = [len(g) for g in grams]
        flat = np.concatenate(grams) if grams else np.zeros(0, np.uint64)
        order = np.argsort(flat, kind="stable")
        self.item_of = np.repeat(np.arange(len(grams)), sizes)[order]
        self.at = np.concatenate([np.arange(n) for n in sizes])[order] if grams else np.zeros(0, np.int64)
        self.keys, self.first = np.unique(flat[order], return_index=True)
        self.last = np.append(self.first[1:], len(flat))
        bits = max(16, int(len(flat)).bit_length() + 6)
        self.shift = np.uint64(64 - bits)
        self.present = np.zeros(1 << bits, dtype=bool)
        self.present[(self.keys >> self.shift).astype(np.int64)] = True

    def search(self, texts: list[str]) -> list[tuple[int, object, int, int, int]]:
        """(text number, item, start, end, edits), in code points, end exclusive."""
        found, start, size = [], 0, 0
        for i, text in enumerate(texts):
            if i > start and size + len(text) > BATCH_CHARS:
                found += self._search(texts, start, i)
                start, size = i, 0
            size += len(text)
        return found + self._search(texts, start, len(texts))

    def _search(self, texts: list[str], a: int, b: int) -> list[tuple[int, object, int, int, int]]:
        codes = code_points("".join(texts[a:b]))
        ends = np.cumsum([len(t) for t in texts[a:b]])
        if len(codes) < self.q or not len(self.keys):
            return []
        hashes = qgram_hashes(codes, self.q)
        near = np.flatnonzero(self.present[(hashes >> self.shift).astype(np.int64)])
        slot = np.minimum(np.searchsorted(self.keys, hashes[near]), len(self.keys) - 1)
        hit = self.keys[slot] == hashes[near]
        near, slot = near[hit], slot[hit]
        doc = np.searchsorted(ends, near, side="right")
        inside = near + self.q <= ends[doc]
        near, slot, doc = near[inside], slot[inside], doc[inside]
        if not len(near):
            return []
        many = self.last[slot] - self.first[slot]
        total = int(many.sum())
        offset = np.arange(total) - np.repeat(np.cumsum(many) - many, many)
        entry = np.repeat(self.first[slot], many) + offset
        p, doc = np.repeat(near, many), np.repeat(doc, many)
        item, j = self.item_of[entry], self.at[entry]
        found = []
        for region in self._regions(p, doc, item, j):
            d, it, low, lo_p, hi_p = region
            begin = int(ends[d - 1]) if d else 0
            spot = self._verify(codes[begin : int(ends[d])], int(it), int(low) - begin)
            if spot:
                edits, first, last = spot
                found.append((a + int(d), self.items[it][0], first, last, edits))
        return sorted(_merged(found), key=lambda r: (r[0], r[2], str(r[1])))

    def _regions(self, p, doc, item, j) -> list[tuple[int, int, int, int, int]]:
        """Bands with enough q-grams close together: text, item, lowest diagonal, positions."""
        step = self.budget[item] + 1
        band = (p - j) // step
        p, doc, item = (np.concatenate([x, x]) for x in (p, doc, item))
        band = np.concatenate([band, band - 1])
        order = np.lexsort((p, band, item, doc))
        p, doc, item, band = p[order], doc[order], item[order], band[order]
        new = np.ones(len(p), dtype=bool)
        new[1:] = (p[1:] != p[:-1]) | (band[1:] != band[:-1]) | (item[1:] != item[:-1]) | (doc[1:] != doc[:-1])
        p, doc, item, band = p[new], doc[new], item[new], band[new]
        far = np.arange(len(p)) + self.need[item] - 1
        fits = far < len(p)
        far = np.minimum(far, len(p) - 1)
        fits &= (doc[far] == doc) & (item[far] == item) & (band[far] == band)
        fits &= p[far] - p <= self.length[item] - self.q + self.budget[item]
        out: dict[tuple[int, int, int], list[int]] = {}
        for i in np.flatnonzero(fits):
            key = (int(doc[i]), int(item[i]), int(band[i]))
            spot = out.setdefault(key, [int(p[i]), int(p[far[i]])])
            spot[1] = max(spot[1], int(p[far[i]]))
        return [
            (d, it, b * int(self.budget[it] + 1), lo, hi) for (d, it, b), (lo, hi) in out.items()
        ]

    def _verify(self, text: np.ndarray, it: int, low: int) -> tuple[int, int, int] | None:
        """Fewest edits of a passage inside the band of diagonals from ``low``, and where it lies."""
        item, n, k = self.items[it][1], int(self.length[it]), int(self.budget[it])
        best = None
        for d in range(low, low + 2 * (k + 1)):
            first, last = max(0, -d), min(len(item), len(text) - d)
            if last - first < n:
                continue
            wrong = np.concatenate([[0], np.cumsum(text[first + d : last + d] != item[first:last])])
            edits = wrong[n:] - wrong[:-n]
            good = np.flatnonzero(edits <= k)
            if len(good) and (best is None or edits[good].min() < best[0]):
                best = (int(edits[good].min()), first + d + int(good[0]), first + d + int(good[-1]) + n)
        return best or banded(text, item, n, k, low - k, low + 3 * k + 2)


def banded(text, item, n: int, k: int, low: int, high: int) -> tuple[int, int, int] | None:
    """Edit distance of every stretch of ``n`` of the item inside diagonals low to high, all at once."""
    starts = np.arange(len(item) - n + 1)
    starts = starts[(starts + high + n >= 0) & (starts + low <= len(text))]
    if not len(starts):
        return None
    pad = n + high - low + 2
    padded = np.concatenate([np.full(pad, 0xFFFFFFFF, np.uint32), text, np.full(pad + len(item), 0xFFFFFFFF, np.uint32)])
    width = high - low + 1
    columns = np.arange(width)
    cost = np.zeros((len(starts), width), dtype=np.int64)
    base = starts[:, None] + low + columns[None, :] + pad
    for r in range(n):
        letters = padded[np.clip(base + r, 0, len(padded) - 1)]
        step = cost + (letters != item[starts + r][:, None])
        step[:, :-1] = np.minimum(step[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(step - columns, axis=1) + columns
    least = cost.min(axis=1)
    good = np.flatnonzero(least <= k)
    if not len(good):
        return None
    begin = int(starts[good[0]]) + low + int(cost[good[0]].argmin())
    end = int(starts[good[-1]]) + low + int(cost[good[-1]].argmin()) + n
    return int(least[good].min()), max(0, begin - k), min(len(text), end)


def _merged(found: list[tuple[int, object, int, int, int]]) -> list[tuple[int, object, int, int, int]]:
    """One row for overlapping spans of one text and item."""
    out: list[tuple[int, object, int, int, int]] = []
    for row in sorted(found, key=lambda r: (r[0], str(r[1]), r[2], r[3])):
        if out and out[-1][:2] == row[:2] and row[2] <= out[-1][3]:
            out[-1] = (*row[:2], out[-1][2], max(out[-1][3], row[3]), min(out[-1][4], row[4]))
        else:
            out.append(row)
    return out


def _blocks(benchmark: DataFrame, settings: Settings) -> Iterator[Index]:
    items = benchmark.select("item_id", "text").where(F.octet_length("text") > 0)
    size = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    blocks = -(-size // settings.block_bytes)
    for b in range(blocks):
        part = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == b)
        yield Index(sorted(((r.item_id, r.text) for r in part.collect()), key=str), settings)


def find_passages(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """One row for each benchmark passage in a document: ``doc_id, item_id, start, end, edits``."""
    kinds = docs.schema["doc_id"].dataType.simpleString(), benchmark.schema["item_id"].dataType.simpleString()
    schema = f"doc_id {kinds[0]}, item_id {kinds[1]}, start bigint, end bigint, edits bigint"
    out = None
    for index in _blocks(benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                ids = batch["doc_id"].tolist()
                found = shared.value.search([t or "" for t in batch["text"]])
                yield pd.DataFrame(
                    [(ids[i], *rest) for i, *rest in found],
                    columns=["doc_id", "item_id", "start", "end", "edits"],
                )

        part = docs.select("doc_id", "text").mapInPandas(rows, schema)
        out = part if out is None else out.unionByName(part)
    return docs.sparkSession.createDataFrame([], schema) if out is None else out


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """The documents without a benchmark passage, all columns as they are, without a shuffle."""
    import pyarrow as pa

    out = docs
    for index in _blocks(benchmark, settings):
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def rows(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in slices(batches, BATCH_CHARS):
                texts = batch.column(batch.schema.get_field_index("text")).to_pylist()
                clean = np.ones(len(texts), dtype=bool)
                for i, *_ in shared.value.search([t or "" for t in texts]):
                    clean[i] = False
                yield batch.filter(pa.array(clean))

        out = out.mapInArrow(rows, docs.schema)
    return out

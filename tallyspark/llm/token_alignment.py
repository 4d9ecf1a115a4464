"""Cross-tokenizer alignment: which tokens of one vocabulary overlap which of another.

Side A is a byte-level BPE (tokenizers library) run on ``" " + text``; side B a sentencepiece
model run on ``text`` (it adds the leading space itself). Special-token strings inside a text
are plain text on both sides. A token's bytes: A's vocabulary entry mapped back through the
byte-level alphabet; B's piece in UTF-8 with U+2581 as a space and ``<0xHH>`` as byte HH.

Per Arrow batch, tokens of all documents are laid on one axis of byte offsets (each document
after the last), and running counts of starts on it give, for every token start of one side, the
token of the other side that covers it; documents begin at equal offsets on both sides. Two tokens overlap exactly when one's
start lies inside the other, so the union of both directions is every overlapping pair, once.
Byte offsets where tokens of both sides end cut a document into groups.

Across the corpus an (A id, B id) pair's count is the number of documents that hold it linked;
a link is *best* when its count is the highest of its A id (ties all best). Counts are summed by
one aggregation; links meet them through a broadcast table when the distinct pairs are within
``BROADCAST_PAIRS`` (counted first), else through a join salted over ``SALTS`` ways.

Edges: a null or empty text, or one whose joined token bytes of either side differ from
``" " + text``, has no tokens: zeros and an empty ``groups`` string. A document is a row: repeated
rows count as separate documents, and a null ``doc_id`` is kept as null. Input columns other
than ``doc_id`` and ``text`` are dropped, so no name can clash.
"""

from __future__ import annotations

import os
from functools import lru_cache
from itertools import chain, compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyspark.llm.slices import slices
from tallyspark.sources.workspace import settle

#: Distinct id pairs up to which counts are broadcast to the links; beyond, a salted join.
BROADCAST_PAIRS = 4_000_000
SALTS = 16
#: Text bytes tokenized and aligned at once in a Python worker.
SLICE_BYTES = 1 << 18

TOKENS = (
    "_row long, doc_id long, n_a long, n_b long, n_groups long, groups string, "
    "link_a array<int>, link_b array<int>, link_n array<long>"
)


def _byte_alphabet() -> dict[str, int]:
    """The byte-level BPE alphabet: printable Latin-1 bytes stand for themselves, the others
    (controls, space, 127 to 160 and 173) take the code points from 256 up in byte order."""
    kept = [*range(ord("!"), ord("~") + 1), *range(ord("¡"), ord("¬") + 1), *range(ord("®"), ord("ÿ") + 1)]
    shifted = [b for b in range(256) if b not in kept]
    return {chr(b): b for b in kept} | {chr(256 + i): b for i, b in enumerate(shifted)}


def _table(pieces: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    lengths = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
    starts = np.concatenate([[0], np.cumsum(lengths)[:-1]]).astype(np.int64)
    return np.frombuffer(b"".join(pieces), dtype=np.uint8), starts, lengths


def _gather(table, ids: np.ndarray) -> np.ndarray:
    """Bytes of the ids, concatenated."""
    buf, starts, lengths = table
    n = lengths[ids]
    inside = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
    return buf[np.repeat(starts[ids], n) + inside]


class _Sides:
    def __init__(self, a_file: str, b_file: str):
        import sentencepiece
        from tokenizers import Tokenizer

        # A task has one core: threads of the library only add CPU time and memory arenas of their own.
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(a_file)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b_file)
        if self.a.get_vocab_size() > 1 << 16 or self.b.get_piece_size() > 1 << 16:
            raise ValueError("ids are packed in 16 bits a side")
        alphabet = _byte_alphabet()
        vocab = self.a.get_vocab()
        a_pieces = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            a_pieces[i] = bytes(alphabet[c] for c in token) if all(c in alphabet for c in token) else b""
        b_pieces = []
        for i in range(self.b.get_piece_size()):
            piece = self.b.id_to_piece(i)
            if self.b.is_byte(i):
                b_pieces.append(bytes([int(piece[3:5], 16)]))
            elif self.b.is_control(i) or self.b.is_unknown(i):
                b_pieces.append(b"")
            else:
                b_pieces.append(piece.replace("▁", " ").encode("utf-8"))
        self.bytes_a, self.bytes_b = _table(a_pieces), _table(b_pieces)
        self.digits_a = _table([str(i).encode() for i in range(len(a_pieces))])
        self.digits_b = _table([str(i).encode() for i in range(len(b_pieces))])


@lru_cache(maxsize=2)
def _sides(a_file: str, b_file: str) -> _Sides:
    return _Sides(a_file, b_file)


def _valid(table, ids_list: list[list[int]], expected: list[bytes]) -> np.ndarray:
    """Per document: do its tokens' bytes join to the expected bytes?"""
    n_docs = len(expected)
    want = np.fromiter(map(len, expected), dtype=np.int64, count=n_docs)
    counts = np.fromiter(map(len, ids_list), dtype=np.int64, count=n_docs)
    flat = np.fromiter(chain.from_iterable(ids_list), dtype=np.int64, count=int(counts.sum()))
    doc_of = np.repeat(np.arange(n_docs), counts)
    got = np.bincount(doc_of, weights=table[2][flat], minlength=n_docs).astype(np.int64)
    ok = (got == want) & (counts > 0)
    joined = _gather(table, flat[ok[doc_of]])
    text = np.frombuffer(b"".join(e for e, k in zip(expected, ok, strict=True) if k), dtype=np.uint8)
    wrong = np.flatnonzero(joined != text)
    if len(wrong):
        ends = np.cumsum(want[ok])
        bad = np.unique(np.searchsorted(ends, wrong, side="right"))
        ok[np.flatnonzero(ok)[bad]] = False
    return ok


def _side(table, ids_list, keep: np.ndarray) -> dict[str, np.ndarray]:
    """Tokens of the kept documents: document, id, start and end on the batch's axis."""
    counts = np.fromiter((len(x) if k else 0 for x, k in zip(ids_list, keep, strict=True)), dtype=np.int64)
    ids = np.fromiter(chain.from_iterable(compress(ids_list, keep)), dtype=np.int64, count=int(counts.sum()))
    # Kept documents lie one after another, so the running total of bytes is the end offset.
    lengths = table[2][ids]
    ends = np.cumsum(lengths)
    doc = np.repeat(np.arange(len(ids_list)), counts)
    return {"doc": doc, "id": ids, "start": ends - lengths, "end": ends}


def _upto(places: np.ndarray, length: int) -> np.ndarray:
    """For each place of an axis, how many of ``places`` are not beyond it."""
    return np.cumsum(np.bincount(places, minlength=length))


def _groups_text(sides: _Sides, a: dict, b: dict, cuts: np.ndarray) -> tuple[np.ndarray, bytes]:
    """``a1,a2|b1;a3|b2,b3`` of all kept documents, concatenated, and each group's end in it."""
    before = _upto(cuts, int(cuts[-1]) + 1) - np.bincount(cuts)
    ga, gb = before[a["end"]], before[b["end"]]
    # Both sides are in order of their groups, so they are merged, not sorted: a token's place is its
    # own number and that of the other side's tokens before it (A comes first within a group).
    groups = int(ga[-1]) + 1
    at_a = np.arange(len(ga)) + (_upto(gb, groups) - np.bincount(gb, minlength=groups))[ga]
    at_b = np.arange(len(gb)) + _upto(ga, groups)[gb]
    group, side, ids = (np.empty(len(ga) + len(gb), dtype=np.int64) for _ in range(3))
    group[at_a], side[at_a], ids[at_a] = ga, 0, a["id"]
    group[at_b], side[at_b], ids[at_b] = gb, 1, b["id"]
    # Separator after each token: ',' within a side, '|' from A to B, ';' between groups.
    nxt_group = np.append(group[1:], -1)
    nxt_side = np.append(side[1:], -1)
    sep = np.where(nxt_group != group, ord(";"), np.where(nxt_side != side, ord("|"), ord(",")))
    table_a, table_b = sides.digits_a, sides.digits_b
    width = np.where(side == 0, table_a[2][np.minimum(ids, len(table_a[2]) - 1)], table_b[2][np.minimum(ids, len(table_b[2]) - 1)]) + 1
    offs = np.cumsum(width) - width
    out = np.empty(int(width.sum()), dtype=np.uint8)
    for s, table in ((0, table_a), (1, table_b)):
        mask = side == s
        sel = ids[mask]
        n = table[2][sel]
        inside = np.arange(int(n.sum()), dtype=np.int64) - np.repeat(np.cumsum(n) - n, n)
        out[np.repeat(offs[mask], n) + inside] = _gather(table, sel)
    out[offs + width - 1] = sep
    group_end = offs[nxt_group != group] + width[nxt_group != group]
    return group_end, out.tobytes()


def _align(a_file: str, b_file: str, slice_bytes: int):
    def run(batches):
        sides = _sides(a_file, b_file)
        for batch in slices(batches, slice_bytes):
            texts = [t if t is not None else "" for t in batch.column("text").to_pylist()]
            rows = len(texts)
            spaced = [" " + t for t in texts]
            expected = [s.encode("utf-8") for s in spaced]
            a_ids = [e.ids for e in sides.a.encode_batch_fast(spaced, add_special_tokens=False)]
            b_ids = sides.b.encode(texts, num_threads=1)
            present = np.fromiter((len(t) > 0 for t in texts), dtype=bool, count=rows)
            keep = present & _valid(sides.bytes_a, a_ids, expected) & _valid(sides.bytes_b, b_ids, expected)
            n_a = np.fromiter((len(x) if k else 0 for x, k in zip(a_ids, keep, strict=True)), np.int64, rows)
            n_b = np.fromiter((len(x) if k else 0 for x, k in zip(b_ids, keep, strict=True)), np.int64, rows)
            a = _side(sides.bytes_a, a_ids, keep)
            b = _side(sides.bytes_b, b_ids, keep)
            # Each token start finds the other side's token that covers it, the last of those that
            # start there; a token that starts where its cover starts is found from both sides.
            start_a, start_b = a["start"], b["start"]
            axis = int(a["end"][-1]) + 1 if len(start_a) else 1
            of_a = _upto(start_b, axis)[start_a] - 1
            of_b = _upto(start_a, axis)[start_b] - 1
            new = np.flatnonzero(start_a[of_b] != start_b)
            id_a, id_b = a["id"], b["id"]
            # Distinct pairs of a document with their number of occurrences.
            doc = np.concatenate([a["doc"], b["doc"][new]])
            key = (np.concatenate([id_a, id_a[of_b[new]]]) << 16) | np.concatenate([id_b[of_a], id_b[new]])
            pair, occ = np.unique((doc << 32) | key, return_counts=True)
            split = np.searchsorted(pair >> 32, np.arange(rows + 1))
            ends_a, ends_b = a["end"], b["end"]
            cuts = ends_a[np.bincount(ends_b, minlength=axis)[ends_a] > 0]
            sizes = np.fromiter((len(e) if k else 0 for e, k in zip(expected, keep, strict=True)), np.int64, rows)
            n_groups = np.bincount(np.searchsorted(np.cumsum(sizes), cuts, side="left"), minlength=rows)[:rows]
            groups = [""] * rows
            if len(cuts):
                group_end, text = _groups_text(sides, a, b, cuts)
                last = np.cumsum(n_groups) - 1
                at = 0
                for i in np.flatnonzero(n_groups):
                    end = int(group_end[last[i]])
                    groups[i] = text[at : end - 1].decode("ascii")
                    at = end
            offsets = pa.array(split, type=pa.int32())
            yield pa.RecordBatch.from_pydict(
                {
                    "_row": batch.column("_row"),
                    "doc_id": batch.column("doc_id"),
                    "n_a": pa.array(n_a),
                    "n_b": pa.array(n_b),
                    "n_groups": pa.array(n_groups.astype(np.int64)),
                    "groups": pa.array(groups, type=pa.string()),
                    "link_a": pa.ListArray.from_arrays(offsets, pa.array(((pair >> 16) & 0xFFFF).astype(np.int32))),
                    "link_b": pa.ListArray.from_arrays(offsets, pa.array((pair & 0xFFFF).astype(np.int32))),
                    "link_n": pa.ListArray.from_arrays(offsets, pa.array(occ.astype(np.int64))),
                }
            )

    return run


def tokens(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Per row: ``TOKENS`` columns; ``groups`` is the plain group string (not hashed), link_*
    the distinct linked id pairs of the document and how often each occurs. Written once."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("_row"),
        F.col("doc_id").cast("bigint").alias("doc_id"),
        F.col("text").cast("string").alias("text"),
    )
    return settle(rows.mapInArrow(_align(a_file, b_file, SLICE_BYTES), TOKENS), "token-alignment")


def align(docs: DataFrame, a_file: str, b_file: str) -> DataFrame:
    """Per row of ``docs``: doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum (longs) and
    groups_sha256 (hex of the group string, '' without tokens)."""
    toks = tokens(docs, a_file, b_file)
    links = toks.select("_row", F.inline(F.arrays_zip(F.col("link_a").alias("a"), F.col("link_b").alias("b"), F.col("link_n").alias("n"))))
    pairs = links.groupBy("a", "b").agg(F.count(F.lit(1)).alias("c"))
    most = pairs.groupBy("a").agg(F.max("c").alias("m"))
    pairs = settle(pairs.join(most, "a").select("a", "b", "c", (F.col("c") == F.col("m")).alias("best")), "token-pairs")
    if pairs.count() <= BROADCAST_PAIRS:
        counted = links.join(F.broadcast(pairs), ["a", "b"])
    else:
        salted = pairs.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        counted = links.withColumn("salt", F.pmod(F.col("_row"), F.lit(SALTS)).cast("int")).join(salted, ["a", "b", "salt"])
    per_doc = counted.groupBy("_row").agg(
        F.sum("n").alias("n_links"),
        F.sum(F.when(F.col("best"), F.col("n")).otherwise(0)).alias("n_best"),
        F.sum(F.col("n") * F.col("c")).alias("count_sum"),
    )
    zero = F.lit(0).cast("bigint")
    # Hashed before the join, so that its shuffle moves digests and not the group strings.
    digest = F.when(F.col("groups") == "", "").otherwise(F.sha2("groups", 256)).alias("groups_sha256")
    told = toks.select("_row", "doc_id", "n_a", "n_b", "n_groups", digest)
    return told.join(per_doc, "_row", "left").select(
        "doc_id",
        "n_a",
        "n_b",
        "n_groups",
        F.coalesce("n_links", zero).cast("bigint").alias("n_links"),
        F.coalesce("n_best", zero).cast("bigint").alias("n_best"),
        F.coalesce("count_sum", zero).cast("bigint").alias("count_sum"),
        "groups_sha256",
    )

"""Token ids as ORC: integer run-length encoding, row indexes, Bloom filters on document ids.

Documents are range-partitioned and sorted by id, so the task number and file counter in
the file names (read as integers, any number of digits) order the files, each
stripe covers a range of ids, and a look-up by id skips stripes by their minimum and
maximum and row groups by their Bloom filter. Stripes are read in parallel.

The tokenizer splits a text before every single space that follows a visible character
and precedes one, whatever stands around it. So each text is cut there, and a piece seen
before comes from a bounded memory of the task's Python process.

Edge cases: a NULL or empty text is the end id alone; NULL ids sort first; documents of
equal id keep the order of the scan and each has its own row; an empty table writes
no row; other columns are not written. One document's ids must fit in one Arrow batch.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Pieces, and words, remembered by a Python worker; the memory starts anew beyond it.
REMEMBERED = 700_000
#: Characters of text taken apart at a time.
BLOCK_CHARS = 4 << 20
_encoders: dict[str, "Encoder"] = {}


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 stands for itself, other bytes for 256 upward."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


_SIGNS = ".,;:!?#$%&*|"
#: Stands for a part that may not be cut off at its spaces.
_ODD = bytearray()


def _odd(part: str) -> bool:
    return not part or part[0].isspace() or part[-1].isspace()


def _mapped(word: str) -> str:
    return word if word.isascii() else word.encode().decode("latin-1").translate(_LETTERS)


class Encoder:
    """Token ids of texts, an end id after each.

    Uses the tokenizer's own splitter and model, once for a piece not seen lately. No
    string of a special token is recognised in a text.
    """

    def __init__(self, file: str) -> None:
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(file)
        self.split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        self.model = self.tokenizer.model
        self.space = self.split(" ")[0][0]
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _ids(self, word: str) -> bytes:
        return array("I", [t.id for t in self.model.tokenize(word)]).tobytes()

    def _word(self, word: str) -> bytes:
        found = self.words.get(word)
        if found is None:
            if len(self.words) >= REMEMBERED:
                self.words.clear()
            found = self.words[word] = self._ids(word)
        return found

    def _letters(self, letters: str) -> bytes:
        """Ids of letters with a space before them: one word."""
        found = self.pieces.get(letters)
        if found is None:
            found = self.pieces[letters] = self._ids(self.space + _mapped(letters))
        return found

    def _spaced(self, part: str) -> bytes:
        """Ids of a part with a space before it: letters are a word, signs after them another."""
        letters = part.rstrip(_SIGNS)
        if letters.isalpha():
            found = self._letters(letters)
            return found if len(letters) == len(part) else found + self._word(part[len(letters) :])
        return _ODD if _odd(part) else self._piece(" " + part)

    def _piece(self, piece: str) -> bytes:
        """Ids of any piece; a single line feed between visible characters is a word of its own."""
        if "\n" in piece:
            lines = piece.split("\n")
            if not any(map(_odd, [lines[0].removeprefix(" "), *lines[1:]])):
                first = self._spaced(lines[0][1:]) if lines[0][0] == " " else self._piece(lines[0])
                return self._word(_LETTERS[10]).join([first, *map(self._piece, lines[1:])])
        letters = piece.rstrip(_SIGNS)
        if letters.isalpha():
            found = self._word(_mapped(letters))
            return found if len(letters) == len(piece) else found + self._word(piece[len(letters) :])
        return b"".join([self._word(w) for w, _ in self.split(piece)])

    def _all_spaced(self, parts: list[str]) -> list[bytes]:
        """Ids of each part with a space before it, or _ODD."""
        if len(self.pieces) > REMEMBERED:
            self.pieces.clear()
        known = self.pieces
        for part in parts:
            if part not in known:
                known[part] = self._spaced(part)
        return list(map(known.__getitem__, parts))

    def encode(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and their number for each text."""
        blocks, start, size = [], 0, 0
        for i, text in enumerate(texts):
            if i > start and size + len(text) > BLOCK_CHARS:
                blocks.append(self._block(texts[start:i], end_id))
                start, size = i, 0
            size += len(text)
        blocks.append(self._block(texts[start:], end_id))
        return tuple(np.concatenate(part) for part in zip(*blocks, strict=True))

    def _block(self, texts: list[str], end_id: int) -> tuple[np.ndarray, np.ndarray]:
        if not texts:
            return np.zeros(0, dtype="<i4"), np.zeros(0, dtype=np.int64)
        split = pc.split_pattern(pa.array(texts, pa.string()), pattern=" ")
        first = split.offsets.to_numpy().astype(np.int64)
        coded = split.values.dictionary_encode()
        which = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        parts = coded.dictionary.to_pylist()
        ids = self._all_spaced(parts)
        # Where a cut might not be one of the tokenizer's, the text is cut with more care.
        odd = np.fromiter((x is _ODD for x in ids), bool, len(ids))
        careful = np.zeros(len(texts), dtype=bool)
        owner = np.repeat(np.arange(len(texts)), np.diff(first))
        careful[owner[odd[which]]] = True
        careful &= np.diff(first) > 1
        # The first part of a text has no space before it; it and the end id are entries of their own.
        for i, text in enumerate(texts):
            if careful[i]:
                ids.append(b"".join([self._piece(p) for p in pieces_of(text)]))
            else:
                ids.append(self._piece(text[: text.find(" ")] if " " in text else text))
        ids.append(np.array([end_id], dtype="<u4").tobytes())
        used = ~careful[owner]
        used[first[:-1]] = True
        which[first[:-1]] = len(parts) + np.arange(len(texts))
        ends = np.cumsum(np.bincount(owner[used], minlength=len(texts)))
        which = np.insert(which[used], ends, len(ids) - 1)
        owner = np.insert(owner[used], ends, np.arange(len(texts)))
        sizes = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        begin = np.cumsum(sizes) - sizes
        count = sizes[which]
        at = np.repeat(begin[which] - (np.cumsum(count) - count), count) + np.arange(count.sum())
        flat = np.frombuffer(b"".join(ids), dtype="<i4")[at]
        return flat, np.bincount(owner, weights=count, minlength=len(texts)).astype(np.int64)


def pieces_of(text: str) -> list[str]:
    """The text cut before single spaces between visible characters; joined, they are the text."""
    if not text:
        return []
    parts = text.split(" ")
    if len(parts) == 1:
        return parts
    joined = [parts[0], *[" " + p for p in parts[1:]]]
    if "" not in parts and not any(p[-1].isspace() or p[0].isspace() for p in parts):
        return joined
    out = [joined[0]]
    for piece, part in zip(joined[1:], parts[1:], strict=True):
        last = out[-1][-1:]
        if not part or part[0].isspace() or not last or last.isspace():
            out[-1] += piece
        else:
            out.append(piece)
    return out


def encode_documents(docs: DataFrame, tokenizer_file: str, end_id: int) -> DataFrame:
    """In the order and partitioning of ``docs``: id, ids with the end id, place in the partition."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer_file) or _encoders.setdefault(
            tokenizer_file, Encoder(tokenizer_file)
        )
        done = 0
        for batch in batches:
            texts = [t or "" for t in batch.column("text").to_pylist()]
            values, lengths = encoder.encode(texts, end_id)
            ends = np.cumsum(lengths)
            offsets = np.concatenate([[0], ends]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"),
                    pa.array(done + ends - lengths),
                    pa.array(lengths),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                ],
                names=["doc_id", "local_start", "n_tokens", "ids"],
            )
            done += int(ends[-1]) if len(ends) else 0

    return docs.mapInArrow(
        encode, f"doc_id {kind}, local_start bigint, n_tokens bigint, ids array<int>"
    )


def write_token_ids(
    docs: DataFrame,
    path: str,
    tokenizer_file: str,
    end_id: int = 0,
    stripe_bytes: int = 16 << 20,
    rows_per_index: int = 2000,
) -> None:
    """Encode ``docs`` (doc_id, text) and write ORC files in ascending id order."""
    order = [F.asc_nulls_first("doc_id"), F.asc("_scan")]
    ordered = (
        docs.select("doc_id", "text")
        .withColumn("_scan", F.monotonically_increasing_id())
        .repartitionByRange(*order)
        .sortWithinPartitions(*order)
        .select("doc_id", "text")
    )
    (
        encode_documents(ordered, tokenizer_file, end_id)
        .write.option("compression", "zstd")
        .option("orc.create.index", "true")
        .option("orc.row.index.stride", str(rows_per_index))
        .option("orc.stripe.size", str(stripe_bytes))
        .option("orc.bloom.filter.columns", "doc_id")
        .option("orc.bloom.filter.fpp", "0.01")
        .orc(path)
    )


def read_token_ids(spark: SparkSession, path: str) -> DataFrame:
    """The rows of the files, each with the ``file`` it lies in."""
    return spark.read.orc(path).withColumn("file", F.col("_metadata.file_name"))


def file_order(name: Column) -> list[Column]:
    """Order of written files: task number, then file counter of the task, as integers, then
    the name. ``part-100000-…`` follows ``part-99999-…``; names without them sort first."""

    def number(pattern: str) -> Column:
        return F.regexp_extract(name, pattern, 1).try_cast("decimal(38,0)")

    return [number(r"^part-([0-9]+)-"), number(r"-c([0-9]+)[.]?[^-]*$"), name]


def token_digest(spark: SparkSession, path: str) -> DataFrame:
    """Per document, from the files: ``doc_id``, ``start``, ``n_tokens``, ``ids_crc32``."""
    stored = read_token_ids(spark, path)
    kind = stored.schema["doc_id"].dataType.simpleString()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column("ids")
            at = ids.offsets.to_numpy()
            values = ids.values.to_numpy(zero_copy_only=False).astype("<u4", copy=False)
            crc = [zlib.crc32(values[a:b].tobytes()) for a, b in zip(at[:-1], at[1:], strict=True)]
            kept = [batch.column(n) for n in ("doc_id", "file", "local_start")]
            lengths = pa.array(np.diff(at).astype(np.int64))
            yield pa.RecordBatch.from_arrays(
                [*kept, lengths, pa.array(crc, type=pa.int64())],
                names=["doc_id", "file", "local_start", "n_tokens", "ids_crc32"],
            )

    read = stored.select("doc_id", "file", "local_start", "ids").mapInArrow(
        digest,
        f"doc_id {kind}, file string, local_start bigint, n_tokens bigint, ids_crc32 bigint",
    )
    before = Window.orderBy(*file_order(F.col("file"))).rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        stored.groupBy("file")
        .agg(F.sum("n_tokens").alias("n"))
        .select("file", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("offset"))
    )
    return read.join(offsets, "file").select(
        "doc_id", (F.col("offset") + F.col("local_start")).alias("start"), "n_tokens", "ids_crc32"
    )

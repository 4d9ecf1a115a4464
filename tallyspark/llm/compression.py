"""Quality rules: base counts and compression bands.

The ratio of bytes to zstandard-compressed bytes grows with repetition and falls toward
1 for noise. It also grows with length, so the whole text has limits by length; fixed
chunks catch a repetitive or noisy stretch inside an otherwise ordinary text.

Edge cases: a NULL text counts as empty; empty texts have no words and fail the base
rule; texts below the shortest band are not judged by compression; repeated rows are
judged alike; an empty table gives no rows; columns other than ``doc_id`` and ``text``
are ignored. Texts are handled one at a time, so memory follows the longest text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"


@dataclass(frozen=True)
class Bands:
    """Limits of the compression ratio.

    ``whole``: (bytes from, lowest ratio, highest ratio), ascending; texts shorter than the
    first row are not judged. Chunks of ``chunk`` bytes must lie between ``chunk_low`` and
    ``chunk_high``, up to a share of ``bad_share``; a shorter rest is judged as part of the
    last ``chunk`` bytes. Low limits lie above base64 and printable noise, below prose; hex
    compresses as well as dense prose and is not told from it.
    """

    whole: tuple[tuple[int, float, float], ...] = (
        (200, 1.25, 2.8),
        (400, 1.35, 2.8),
        (800, 1.45, 3.0),
        (3200, 1.5, 3.5),
        (12800, 1.5, 4.0),
    )
    chunk: int = 2048
    chunk_low: float = 1.45
    chunk_high: float = 3.5
    bad_share: float = 0.34
    level: int = 3


def base_counts(text: str) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of a whole text."""
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    word_chars = len(text) - (len(raw) - len(raw.translate(None, SPACE)))
    n_symbols = len(raw) - len(raw.translate(None, SYMBOLS))
    seen: set[bytes] = set()
    dup_lines = 0
    for line in raw.split(b"\n"):
        if line.strip(SPACE):
            dup_lines += line in seen
            seen.add(line)
    return len(words), word_chars, n_symbols, dup_lines, _repeated(words)


def _repeated(words: list[bytes]) -> int:
    """Words covered by 3-word windows that occur twice or more."""
    n = len(words)
    if n < 4:
        return 0
    number: dict[bytes, int] = {}
    ids = np.fromiter((number.setdefault(w, len(number)) for w in words), np.int64, n)
    if len(number) == n:
        return 0
    pairs = ids[:-1] * len(number) + ids[1:]
    if len(number) > 2_000_000:
        pairs = np.unique(pairs, return_inverse=True)[1]
    windows = pairs[:-1] * len(number) + ids[2:]
    order = np.argsort(windows, kind="stable")
    same = windows[order][1:] == windows[order][:-1]
    twice = np.zeros(n - 2, dtype=bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(n, dtype=bool)
    for shift in range(3):
        covered[shift : n - 2 + shift] |= twice
    return int(covered.sum())


def band_verdict(raw: bytes, compressor, bands: Bands) -> tuple[float, float, bool]:
    """Ratio of the whole text, share of bad chunks, and whether both lie within limits."""
    if not raw:
        return 0.0, 0.0, True
    ratio = len(raw) / len(compressor.compress(raw))
    low, high = 0.0, float("inf")
    for start, lowest, highest in bands.whole:
        if len(raw) >= start:
            low, high = lowest, highest
    starts = list(range(0, len(raw) - bands.chunk + 1, bands.chunk))
    if starts and len(raw) % bands.chunk:
        starts.append(len(raw) - bands.chunk)
    bad = 0
    for start in starts:
        part = raw[start : start + bands.chunk]
        found = len(part) / len(compressor.compress(part))
        bad += not bands.chunk_low <= found <= bands.chunk_high
    share = bad / len(starts) if starts else 0.0
    return ratio, share, low <= ratio <= high and share <= bands.bad_share


def judge(docs: DataFrame, bands: Bands = Bands()) -> DataFrame:
    """Base counts, ratios and the verdict of every document."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def rows(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=bands.level)
        for batch in batches:
            out = []
            for text in batch["text"]:
                text = text or ""
                counts = base_counts(text)
                raw = text.encode("utf-8", "surrogatepass")
                ratio, share, fine = band_verdict(raw, compressor, bands)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                out.append((*counts, failed, fine and not failed, ratio, share))
            columns = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
            columns += ["base_failed", "kept", "ratio", "bad_chunk_share"]
            found = pd.DataFrame(out, columns=columns, index=batch.index)
            found.insert(0, "doc_id", batch["doc_id"])
            yield found

    return docs.select("doc_id", "text").mapInPandas(
        rows,
        f"doc_id {kind}, n_words bigint, word_chars bigint, n_symbols bigint, n_dup_lines bigint,"
        " n_repeat_words bigint, base_failed boolean, kept boolean, ratio double,"
        " bad_chunk_share double",
    )

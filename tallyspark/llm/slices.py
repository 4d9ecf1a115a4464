"""Arrow batches in slices, for Python steps whose memory must not follow the batch size."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa


def slices(batches: Iterable[pa.RecordBatch], limit: int) -> Iterator[pa.RecordBatch]:
    """Arrow batches cut into runs of rows whose texts hold at most ``limit`` bytes (a longer
    text is a run of its own), so a worker's memory follows ``limit``, not the batch size."""
    import pyarrow.compute as pc

    for batch in batches:
        sizes = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False)
        at, total = 0, 0
        for i, size in enumerate(sizes):
            if i > at and total + size > limit:
                yield batch.slice(at, i - at)
                at, total = i, 0
            total += int(size)
        if at < len(sizes):
            yield batch.slice(at)

"""Arrow batches within tasks: in bounded stretches, and lists of tuples as arrays."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts that are worked on together, and bytes of them.
PART_ROWS, PART_CHARS = 10_000, 4_000_000


def parts_of(texts: pa.Array, rows: int = PART_ROWS, chars: int = PART_CHARS) -> Iterator[pa.Array]:
    """A batch in stretches of bounded rows and bytes of text, so that what is found in one is bounded as well."""
    sizes = np.cumsum(pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < len(texts):
        before = sizes[at - 1] if at else 0
        end = min(at + rows, max(at + 1, int(np.searchsorted(sizes, before + chars, "right"))))
        yield texts.slice(at, end - at)
        at = end


def listed_structs(lists: Sequence[Sequence[tuple]], names: Sequence[str], kinds: Sequence) -> pa.ListArray:
    """Lists of tuples as one Arrow array of lists of structs, field by field."""
    offsets = np.cumsum([0, *map(len, lists)], dtype=np.int32)
    fields = list(zip(*chain.from_iterable(lists), strict=True)) or [()] * len(names)
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([pa.array(f, k) for f, k in zip(fields, kinds, strict=True)], list(names)))

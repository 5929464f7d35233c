"""Small pieces that several operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, functions as F

from spanlake.operators.joins import join_large, join_small  # noqa: F401

BLANKS = r"[\s\x{00A0}\x{0085}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"


def host_of(url: Column) -> Column:
    """Host in lower case, without user, port and one leading ``www.``; null if there is none."""
    host = F.regexp_extract(url, r"^\s*[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)
    host = F.regexp_replace(F.lower(host), r"^www\.", "")
    return F.when(host != "", host)


def path_of(url: Column) -> Column:
    """Path in lower case without query, fragment, closing slash or .html."""
    path = F.regexp_replace(F.coalesce(url, F.lit("")), r"^\s*[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", "")
    path = F.regexp_replace(F.lower(path), r"[?#].*$", "")
    return F.regexp_replace(path, r"(\.html?|/)+$", "")


def pieces(batch: pa.RecordBatch, column: int, most_bytes: int = 4_000_000) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about most_bytes of text each, so that long texts do not add up; a longer text is alone."""
    size = np.cumsum(pc.fill_null(pc.binary_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        base = size[at - 1] if at else 0
        end = max(at + 1, int(np.searchsorted(size, base + most_bytes, side="right")))
        yield batch.slice(at, end - at)
        at = end


def list_pieces(batch: pa.RecordBatch, column: int, most_items: int) -> Iterator[pa.RecordBatch]:
    """Slices of a batch whose lists hold about most_items together; a longer list is alone."""
    end = np.cumsum(pc.fill_null(pc.list_value_length(batch.column(column)), 0).to_numpy(zero_copy_only=False).astype(np.int64))
    at = 0
    while at < batch.num_rows:
        stop = max(at + 1, int(np.searchsorted(end, (end[at - 1] if at else 0) + most_items, side="right")))
        yield batch.slice(at, stop - at)
        at = stop

"""Token counts by section, from one encoding of each whole document."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from vecspark.llm.tokens import default_path, section_counts


def count_by_line(docs: DataFrame, path: str | None = None) -> DataFrame:
    """One row for each line of each document: doc_id, section (from 0), start, end (characters, end beyond the line feed), n_tokens, doc_tokens.

    A whole document is encoded once; a token belongs to the line that holds most of its characters, the earlier of two that hold as
    many. Lines' counts add up to doc_tokens. Null and empty texts have no lines: they give one row, whose section is null and whose
    counts are 0. Repeated rows give theirs again. Empty in, empty out. Other columns, whatever their names, take no part.
    """
    path = path or default_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                none = np.zeros(1, np.int64)
                found = [x if len(x[1]) else (0, none, none, none) for x in section_counts(part.column(1).to_pylist(), path)]
                empty = np.array([not t for t in part.column(1).to_pylist()], bool)
                sizes = np.array([len(x[1]) for x in found], np.int64)
                of = np.repeat(np.arange(len(found)), sizes)
                section = (np.arange(int(sizes.sum())) - np.repeat(np.cumsum(sizes) - sizes, sizes)).astype(np.int32)
                columns = [pa.array(np.concatenate([x[k] for x in found]).astype(np.int64)) for k in (1, 2, 3)]
                tokens = pa.array(np.array([x[0] for x in found], np.int64)[of])
                yield pa.RecordBatch.from_arrays(
                    [part.column(0).take(pa.array(of)), pa.array(section, mask=empty[of]), *columns, tokens],
                    names=["doc_id", "section", "start", "end", "n_tokens", "doc_tokens"],
                )

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, section int, start long, end long, n_tokens long, doc_tokens long")

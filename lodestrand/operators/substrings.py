"""Which texts hold which short strings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

WIDTH = 8  # bytes that one number holds
ODD = np.uint64(0x9E3779B97F4A7C15)


def holding(texts: DataFrame, key: str, text: str, wanted: list[bytes], places: int = 1 << 20) -> DataFrame:
    """(key, start): the texts with every wanted string of at most eight bytes that they hold, each once. The bytes at a place
    are read as a number and looked up in a table of hashes, what is left among the sorted strings, by their length: a pass
    over the text for each length, in blocks of ``places``, whatever the number of strings. Every text but null holds the
    empty string."""
    every = sorted(set(wanted), key=lambda s: (len(s), s))
    if any(len(s) > WIDTH for s in every):
        raise ValueError("wanted strings have at most eight bytes")
    lengths = []
    for n in sorted({len(s) for s in every} - {0}):
        number = {int.from_bytes(s, "little"): i for i, s in enumerate(every) if len(s) == n}
        numbers = np.array(sorted(number), np.uint64)
        table = np.zeros(1 << 16, bool)
        table[(numbers * ODD) >> np.uint64(48)] = True
        lengths.append((n, numbers, np.array([number[int(x)] for x in numbers]), table))

    def look(batches):
        names = pa.array(every, pa.binary())
        for batch in batches:
            texts = batch.column(1)
            if not len(texts):
                continue
            _, where, data = texts.buffers()
            ends = np.frombuffer(where, np.int64 if pa.types.is_large_binary(texts.type) else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
            raw = np.zeros(ends[-1] - ends[0] + WIDTH, np.uint8)
            if ends[-1] > ends[0]:
                raw[:-WIDTH] = np.frombuffer(data, np.uint8)[ends[0] : ends[-1]]
            ends -= ends[0]
            starts = np.ndarray(len(raw) - WIDTH, "<u8", raw, strides=(1,))
            pairs = [np.arange(len(texts)) * len(every)] if every[0] == b"" else []
            for lo in range(0, len(starts), places):
                here = starts[lo : lo + places]
                for n, numbers, index, table in lengths:
                    x = here & np.uint64((1 << 8 * n) - 1)
                    at = np.flatnonzero(table[(x * ODD) >> np.uint64(48)])
                    x = x[at]
                    i = np.minimum(np.searchsorted(numbers, x), len(numbers) - 1)
                    same = numbers[i] == x
                    at, i = at[same] + lo, i[same]
                    row = np.searchsorted(ends, at, "right") - 1
                    inside = at + n <= ends[row + 1]
                    pairs.append(np.unique(row[inside] * len(every) + index[i[inside]]))
            held = np.unique(np.concatenate(pairs)) if pairs else np.empty(0, np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(held // len(every))), names.take(pa.array(held % len(every)))], [key, "start"])

    schema = T.StructType([T.StructField(key, texts.schema[key].dataType), T.StructField("start", T.BinaryType())])
    if not every:
        return texts.sparkSession.createDataFrame([], schema)
    return texts.where(F.col(text).isNotNull()).select(key, F.col(text).cast("binary").alias("text")).mapInArrow(look, schema)

"""Token counts of whole texts by rank-synchronous array merging.

No shuffle: one narrow pass; a task holds one block of texts, the distinct new
units of that block as ragged arrays, and a bounded memo.
"""

from __future__ import annotations

import functools

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .bytebpe import PRETOKENS, Units, count_batch, groups, ranks


@functools.lru_cache(maxsize=4)
def counter(path: str) -> Units:
    table = ranks(path)

    def solve(units: list[str]) -> list[int]:
        out = []
        for k in range(0, len(units), 50_000):
            tokens, of = [], []
            for u in units[k : k + 50_000]:
                found = PRETOKENS.findall(u)
                tokens += found
                of.append(len(found))
            counts = count_batch(table, [t.encode("utf-8", "surrogatepass") for t in tokens])
            ends = np.cumsum(np.array(of))
            total = np.append(0, np.cumsum(counts))
            out += (total[ends] - total[ends - np.array(of)]).tolist()
        return out

    return Units(solve, table.special)


def token_counts(df: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", limit: int = 512) -> DataFrame:
    """One row per input row: ``(id_col, n_bytes, n_tokens, over_limit)``.

    ``tokenizer`` is the path of a byte-level BPE file that every executor can
    read.  Counts are those of the file's own library without begin, end or
    template tokens; strings of its added tokens count as one token each.
    A null text counts as empty (0 bytes, 0 tokens); null ids and repeated rows
    are kept; other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        memo = counter(tokenizer)
        for batch in batches:
            texts, n_bytes, n_tokens = batch.column(1).to_pylist(), [], []
            for held in groups(texts):
                n_bytes += [len(t.encode("utf-8", "surrogatepass")) for t in held]
                n_tokens += [sum([1 if v is None else v for v in values]) for values in memo.batch(held)]
            n_tokens = np.array(n_tokens, dtype=np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n_bytes, pa.int64()), pa.array(n_tokens), pa.array(n_tokens > limit)], names=["id", "n_bytes", "n_tokens", "over_limit"])

    rows = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean").withColumnRenamed("id", id_col)

"""Cost-balanced packing of documents into fixed-length training sequences."""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import tokens
from ._worker import lean

PIECE_SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def balance(lengths: np.ndarray, capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) for documents of these lengths.

    Full sequences are cut off long documents. What is left goes, longest first,
    to the sequence of the lowest estimated cost (linear * n + quadratic * n^2,
    summed over its pieces) that has room for it; where none has room, the
    piece is cut to fill the cheapest open one. As few sequences are opened as
    hold all tokens, so the padding is less than one sequence in all.
    """
    out: list[tuple[int, int, int, int, int]] = []
    sequence = 0
    rest = []
    for d, n in enumerate(lengths.tolist()):
        whole = n // capacity
        for k in range(whole):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            rest.append((n % capacity, d, whole * capacity))
    rest.sort(key=lambda x: (-x[0], x[1]))
    opened = -(-sum(x[0] for x in rest) // capacity)
    free, cost = np.full(opened, capacity), np.zeros(opened)
    for n, d, start in rest:
        while n:
            open_cost = np.where(free >= n, cost, np.inf)
            k = int(open_cost.argmin())
            if open_cost[k] == np.inf:
                k = int(np.where(free > 0, cost, np.inf).argmin())
            take = min(n, int(free[k]))
            out.append((d, start, take, sequence + k, capacity - int(free[k])))
            free[k] -= take
            cost[k] += linear * take + quadratic * take * take
            start, n = start + take, n - take
    return out


def pack(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    tokenizer_path: str | None = None,
    end_id: int = 1,
    capacity: int = 2048,
    block_tokens: int = 1_000_000,
    linear: float = 1.0,
    quadratic: float = 1.0 / 2048,
) -> DataFrame:
    """Assigns every token of every document to one place in one sequence.

    A document's tokens are the ids of its text and then `end_id`. Blocks of
    about `block_tokens` tokens are packed where their documents are read: no
    shuffle, bounded memory, and less than one sequence of padding per block.
    `sequence_id` is made of the partition's and the sequence's number, so a
    task that is run again gives the same rows.

    Null and empty texts have `end_id` alone; rows with a null or a repeated id
    are packed like others; an empty table gives no row; other columns are not
    read.
    """
    path = tokenizer_path or tokens.default_path()

    def run(batches):
        from pyspark import TaskContext

        base, used = TaskContext.get().partitionId() << 32, 0
        held: list[tuple[list, np.ndarray, np.ndarray]] = []
        size = 0

        def flush():
            nonlocal used, size, held
            keys = [k for x in held for k in x[0]]
            ids = np.concatenate([x[1] for x in held])
            n = np.concatenate([np.diff(x[2]) for x in held])
            first = np.concatenate([[0], np.cumsum(n)])
            pieces = balance(n, capacity, linear, quadratic)
            d, start, length, sequence, offset = (np.array(x, np.int64) for x in zip(*pieces))
            at = first[d] + start
            view = memoryview(ids.astype("<u4").tobytes())
            crc = [zlib.crc32(view[4 * a : 4 * b]) for a, b in zip(at.tolist(), (at + length).tolist())]
            out = pa.RecordBatch.from_arrays(
                [
                    pa.array([keys[i] for i in d.tolist()], pa.int64()),
                    *(pa.array(x, pa.int64()) for x in (start, length, np.array(crc, np.int64), n[d], base + used + sequence, offset)),
                ],
                names=[x.split()[0] for x in PIECE_SCHEMA.split(", ")],
            )
            used += int(sequence.max()) + 1
            held, size = [], 0
            return out

        for batch in batches:
            keys = batch.column(0).to_pylist()
            for i, ids, at in tokens.encoded(batch.column(1), path):
                n = len(at) - 1
                ids = np.insert(ids, at[1:], end_id)
                at = at + np.arange(n + 1)
                held.append((keys[i : i + n], ids, at))
                size += len(ids)
                if size >= block_tokens:
                    yield flush()
        if held:
            yield flush()

    return docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text")).mapInArrow(lean(run), PIECE_SCHEMA)

"""Exact length histogram: token totals for every context limit at once."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from . import tokens
from ._store import cut
from ._worker import lean

#: Distinct lengths per block of the two-level suffix sums.
BLOCK = 4096


def token_lengths(docs: DataFrame, text_col: str = "text", tokenizer_path: str | None = None) -> DataFrame:
    """One row per document: n_tokens. Null and empty texts have 0."""
    path = tokenizer_path or tokens.default_path()

    def run(batches):
        for batch in batches:
            n = [np.diff(at) for _, _, at in tokens.encoded(batch.column(0), path)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int64), *n]), pa.int64())], names=["n_tokens"])

    return docs.select(docs[text_col].alias("text")).mapInArrow(lean(run), "n_tokens long")


def length_histogram(lengths: DataFrame, length_col: str = "n_tokens") -> DataFrame:
    """Rows (n_tokens, n_docs), one for each encoded length; null lengths count as 0."""
    n = F.coalesce(lengths[length_col].cast("long"), F.lit(0).cast("long")).alias("n_tokens")
    return lengths.select(n).groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def context_totals(histogram: DataFrame) -> DataFrame:
    """Suffix sums of a histogram: one row for each length that occurs.

    For the context limit `n_tokens`: docs_longer (documents over it), docs_within,
    tokens_total (of all documents), tokens_truncated (what is left when each
    document is cut at the limit), tokens_lost, and quantile (share of the
    documents that are not longer). Between two lengths that occur the answers
    follow from the shorter one's row: tokens_truncated grows by docs_longer for
    each token of limit. Sums run within blocks of lengths and over the
    blocks' totals, so no task gets all lengths. The histogram is stored first, as it is
    read twice. An empty histogram gives no row.
    """
    h = cut(histogram).withColumn("_block", F.expr(f"n_tokens div {BLOCK}"))
    blocks = h.groupBy("_block").agg(F.sum("n_docs").alias("_d"), F.sum(F.col("n_docs") * F.col("n_tokens")).alias("_t"))
    later = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.orderBy(F.col("_block").desc()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    blocks = blocks.select(
        "_block",
        F.coalesce(F.sum("_d").over(later), F.lit(0)).alias("_d_later"),
        F.coalesce(F.sum("_t").over(later), F.lit(0)).alias("_t_later"),
        F.sum("_d").over(everything).alias("_docs"),
        F.sum("_t").over(everything).alias("tokens_total"),
    )
    inner = Window.partitionBy("_block").orderBy(F.col("n_tokens").desc()).rowsBetween(Window.unboundedPreceding, -1)
    longer = F.coalesce(F.sum("n_docs").over(inner), F.lit(0)) + F.col("_d_later")
    above = F.coalesce(F.sum(F.col("n_docs") * F.col("n_tokens")).over(inner), F.lit(0)) + F.col("_t_later")
    kept = F.col("tokens_total") - F.col("_above") + F.col("docs_longer") * F.col("n_tokens")
    return (
        h.join(blocks, "_block")
        .withColumns({"docs_longer": longer, "_above": above})
        .select(
            "n_tokens",
            "n_docs",
            "docs_longer",
            (F.col("_docs") - F.col("docs_longer")).alias("docs_within"),
            "tokens_total",
            kept.alias("tokens_truncated"),
            (F.col("tokens_total") - kept).alias("tokens_lost"),
            ((F.col("_docs") - F.col("docs_longer")) / F.col("_docs")).alias("quantile"),
        )
    )

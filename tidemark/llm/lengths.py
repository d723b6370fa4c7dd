"""Exact histogram of encoded lengths, and what its suffix sums answer.

Documents are counted by the number of their tokens. With the counts summed from the longest
length down, every context limit has exact answers: how many documents are longer, how many
tokens remain when each document is cut at the limit, and which share of documents fits.

Lengths are summed in two steps (blocks of ``STEP`` lengths, then within each block), so no
task holds more than ``STEP`` rows or the list of blocks, however long documents get. Null
and empty texts are documents of length 0. Documents never move; only counts are shuffled.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import tokens
from tidemark.llm.shared import arrow, keep

STEP = 4096


def n_tokens(text: str = "text", vocabulary: str = tokens.VOCABULARY):
    @arrow("bigint")
    def length(texts: pa.Array) -> pa.Array:
        return pa.array(np.array([len(x) for x in tokens.encoded(texts, vocabulary)], np.int64))
    return length(text)


def histogram(documents: DataFrame, vocabulary: str = tokens.VOCABULARY) -> DataFrame:
    """(length, n_docs) of all documents."""
    return (documents.select(n_tokens("text", vocabulary).alias("length"))
            .groupBy("length").agg(F.count(F.lit(1)).alias("n_docs")))


def suffix_sums(counts: DataFrame) -> DataFrame:
    """Each length with what a context limit of that length keeps.

    docs_longer: documents beyond the limit; tokens_kept: all tokens with every document cut
    at the limit; tokens_cut: the rest; share_fitting: documents that fit, in 0 to 1 (the quantile
    of the length); docs and tokens: the totals.
    """
    block = F.expr(f"length div {STEP}").alias("block")
    rows = keep(counts.select("length", "n_docs", block))
    sums = rows.groupBy("block").agg(F.sum("n_docs").alias("d"), F.sum(F.col("n_docs") * F.col("length")).alias("t"))
    later = Window.orderBy(F.desc("block"))  # one row for each block of lengths
    whole = later.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    beyond = sums.select("block", (F.sum("d").over(later) - F.col("d")).alias("d_after"),
                         (F.sum("t").over(later) - F.col("t")).alias("t_after"),
                         F.sum("d").over(whole).alias("docs"), F.sum("t").over(whole).alias("tokens"))
    own = Window.partitionBy("block").orderBy(F.desc("length"))
    longer = F.sum("n_docs").over(own) - F.col("n_docs") + F.col("d_after")
    rest = F.sum(F.col("n_docs") * F.col("length")).over(own) - F.col("n_docs") * F.col("length") + F.col("t_after")
    out = rows.join(beyond, "block").select("length", "n_docs", longer.alias("docs_longer"), rest.alias("rest"),
                                            "docs", "tokens")
    cut = F.col("rest") - F.col("docs_longer") * F.col("length")
    return out.select(
        "length", "n_docs", "docs_longer", (F.col("tokens") - cut).alias("tokens_kept"), cut.alias("tokens_cut"),
        (1 - F.col("docs_longer") / F.col("docs")).alias("share_fitting"), "docs", "tokens")


def at_limit(sums: DataFrame, limit: int) -> DataFrame:
    """One row for a limit that need not be a length itself: what it keeps of all tokens."""
    fits = F.col("length") <= limit
    kept = F.sum(F.col("n_docs") * F.least("length", F.lit(limit)))
    return sums.agg(F.coalesce(F.min(F.when(fits, F.col("docs_longer"))), F.max("docs")).alias("docs_longer"),
                    kept.alias("tokens_kept"), (F.max("tokens") - kept).alias("tokens_cut"))


def quantile(sums: DataFrame, share: float) -> DataFrame:
    """The shortest length that at least ``share`` of the documents don't exceed."""
    return sums.where(F.col("share_fitting") >= share).agg(F.min("length").alias("length"))


def report(documents: DataFrame) -> DataFrame:
    return suffix_sums(histogram(documents.select("text")))

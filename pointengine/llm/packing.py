"""Operator 8: optimal length buckets and token-budget batches.

The global histogram of lengths is reduced on the executors; dynamic programming over it picks the bucket
boundaries with the least padding; batches fill inside each bucket.  A token is a UTF-8 byte, plus one end token a
document, unless the caller has a column of lengths, such as an encoder's counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import documents, numbered

#: Every length up to this is a bin of its own ...
FINE_LIMIT = 8192
#: ... and beyond it a doubling has this many bins, so the histogram stays below about 15,000 bins for any corpus.
STEPS_A_DOUBLING = 256


def _least(best: list[int], lengths: list[int], docs: list[int], toks: list[int]) -> list[int]:
    """Least padding of bins 0..j with one more bucket than in best, for every j.

    With the last bucket over i + 1..j, padding is best[i] + toks[i + 1] - lengths[j] * docs[i + 1], a line in
    lengths[j] for every i, and what depends on j alone; lines come by falling slope and are asked at rising
    lengths, so the lower hull is walked once.
    """
    hull: list[tuple[int, int]] = []
    at, out = 0, []
    for j, length in enumerate(lengths):
        own = length * docs[j + 1] - toks[j + 1]
        if hull:
            at = min(at, len(hull) - 1)
            while at + 1 < len(hull) and hull[at + 1][1] - length * hull[at + 1][0] <= hull[at][1] - length * hull[at][0]:
                at += 1
            out.append(min(best[j], own + hull[at][1] - length * hull[at][0]))
        else:
            out.append(best[j])
        line = (docs[j + 1], best[j] + toks[j + 1])
        while len(hull) > 1 and (hull[-1][1] - hull[-2][1]) * (line[0] - hull[-1][0]) >= (line[1] - hull[-1][1]) * (hull[-1][0] - hull[-2][0]):
            hull.pop()
        hull.append(line)
    return out


def optimal_boundaries(lengths: Sequence[int], counts: Sequence[int], sums: Sequence[int], buckets: int) -> tuple[list[int], int]:
    """Upper boundaries of at most ``buckets`` buckets and their padding, least possible among the bins' lengths.

    lengths: ascending longest lengths of the bins; counts and sums: documents and tokens in each.  A bucket over
    bins i..j pads all its documents to lengths[j].  Of equal paddings the one with the fewest buckets counts, and
    from the last bucket back the one whose next boundary is smallest.
    """
    n = len(lengths)
    if not n:
        return [], 0
    edge = [int(x) for x in lengths]
    docs, toks = [0], [0]
    for c, t in zip(counts, sums, strict=True):
        docs.append(docs[-1] + int(c))
        toks.append(toks[-1] + int(t))
    layers = [[edge[j] * docs[j + 1] - toks[j + 1] for j in range(n)]]
    while len(layers) < min(buckets, n):
        layers.append(_least(layers[-1], edge, docs, toks))
    out, j, k = [edge[-1]], n - 1, len(layers) - 1
    while True:
        while k and layers[k - 1][j] == layers[k][j]:
            k -= 1
        if not k:
            return out[::-1], layers[-1][n - 1]
        pad = lambda i: layers[k - 1][i] + edge[j] * (docs[j + 1] - docs[i + 1]) - (toks[j + 1] - toks[i + 1])  # noqa: B023, E731
        j = next(i for i in range(j) if pad(i) == layers[k][j])
        k -= 1
        out.append(edge[j])


def _bin(n: Column) -> Column:
    """The bin of a length: itself, or its doubling and step; bins ascend with lengths."""
    doubling = F.length(F.bin(n)) - 1
    step = F.floor((n - F.pow(F.lit(2.0), doubling)) / F.pow(F.lit(2.0), doubling) * STEPS_A_DOUBLING)
    return F.when(n <= FINE_LIMIT, n).otherwise(F.lit(FINE_LIMIT) + doubling * STEPS_A_DOUBLING + step).cast("long")


def pack(docs: DataFrame, buckets: int = 16, budget: int = 65536, length: str | None = None) -> DataFrame:
    """doc_id, n_tokens, bucket, boundary, batch, slot for every row.

    A batch holds boundary-padded documents of one bucket within ``budget`` tokens, or a single document
    where one alone is longer; nothing is cut or dropped.  A boundary is the length of the bucket's longest document.
    Batches are numbered from 0 in each bucket and slots from 0 in each batch, by the MD5 of doc_id and text.
    length names a column of token counts, of which null counts as 0; without it a token is a byte, and a null or empty text
    has its end token alone.  A text may be of any length.  Repeated rows are packed each, and are interchangeable.
    Other columns are ignored.  An empty table gives no rows.  The driver sees the histogram only: at most about 15,000 rows.
    """
    d = documents(docs, *([F.coalesce(F.col(length).cast("long"), F.lit(0)).alias("_n")] if length else []))
    tokens = F.col("_n") if length else (F.octet_length("text") + 1).cast("long")
    order = F.md5(F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), F.col("text")).cast("binary"))
    d = d.select("doc_id", tokens.alias("n_tokens"), order.alias("_order")).withColumn("_bin", _bin(F.col("n_tokens")))
    hist = sorted(d.groupBy("_bin").agg(F.max("n_tokens").alias("most"), F.count(F.lit(1)).alias("n"), F.sum("n_tokens").alias("t")).collect())
    bounds, _ = optimal_boundaries(*([int(r[i]) for r in hist] for i in (1, 2, 3)), buckets)
    bucket, boundary = F.lit(None).cast("int"), F.lit(None).cast("long")
    for i, b in reversed(list(enumerate(bounds))):
        bucket = F.when(F.col("n_tokens") <= b, F.lit(i)).otherwise(bucket)
        boundary = F.when(F.col("n_tokens") <= b, F.lit(b).cast("long")).otherwise(boundary)
    d = d.withColumns({"bucket": bucket, "boundary": boundary}).drop("_bin")
    each = F.greatest(F.floor(F.lit(budget) / F.greatest("boundary", F.lit(1))).cast("long"), F.lit(1).cast("long"))
    out = numbered(d, "bucket", [F.col("_order")], "_at", buckets, F.conv(F.substring("_order", 1, 3), 16, 10).cast("int"))
    return out.select("doc_id", "n_tokens", "bucket", "boundary", F.floor(F.col("_at") / each).cast("long").alias("batch"), (F.col("_at") % each).cast("int").alias("slot"))

"""Parts of reads that grow by selectivity, from counts of short k-mers, and their rarest seeds.

Any k + 1 parts of a read find the same hits; parts that are rare in the references bring fewer
candidates. Each part starts as one window; the part whose letters are most frequent (by weight) grows by a letter,
until all letters belong to a part. A part's width is the count of the rarest window within it.
"""

from __future__ import annotations

from functools import partial

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators import matching, scan, seed_index

#: Letters of a counted window, and the most: counts are an array over all windows (5 ** 8 numbers are 3 MB).
WINDOW, MOST_WINDOW = 6, 8


def window_counts(pieces: DataFrame, length: int = WINDOW) -> np.ndarray:
    """How often each window of so many letters, by its packed number, stands in the references; summed by batch before the shuffle."""
    if not 1 <= length <= MOST_WINDOW:
        raise ValueError(f"length must lie within 1 and {MOST_WINDOW}")
    out = np.zeros(5**length, np.int64)
    counted = pieces.mapInArrow(partial(seed_index._window_counts, length=length), "kmer long, n long").groupBy("kmer").agg(F.sum("n").alias("n"))
    for r in counted.collect():  # at most 5 ** MOST_WINDOW rows
        out[r.kmer] = r.n
    return out


def grown_parts(text: np.ndarray, parts: int, counts: np.ndarray, length: int, weights: list[int] | None = None) -> list[tuple[int, int]]:
    """(begin, end) of each part of text, in order and without gaps.

    Parts start evenly spaced, as wide as a window. The part with the greatest width times weight that has room grows next, the
    leftmost of equals, towards its neighbour of smaller width if both sides have room; once no part stands in the references, each takes what is
    left behind it. Texts with fewer than parts * length letters are cut evenly.
    """
    m = len(text)
    if m < parts * length or parts < 2:
        return [(i * m // parts, (i + 1) * m // parts) for i in range(parts)]
    window = counts[scan.packed(text, length)].tolist()
    begin = [i * (m - length) // (parts - 1) for i in range(parts)]
    end = [b + length for b in begin]
    width = [window[b] for b in begin]
    weights = weights or [1] * parts
    for _ in range(m - parts * length):
        best, chosen, forward = 0, None, True
        for i in range(parts):
            left, right = i > 0 and begin[i] > end[i - 1], i < parts - 1 and end[i] < begin[i + 1]
            if (left or right) and width[i] * weights[i] > best:
                best, chosen = width[i] * weights[i], i
                forward = right and (not left or width[i - 1] >= width[i + 1])
        if chosen is None:
            break
        if forward:
            end[chosen] += 1
            width[chosen] = min(width[chosen], window[end[chosen] - length])
        else:
            begin[chosen] -= 1
            width[chosen] = min(width[chosen], window[begin[chosen]])
    for i in range(parts - 1):
        end[i] = begin[i + 1]
    return list(zip(begin, end))


def rarest_seed(text: np.ndarray, begin: int, end: int, counts: np.ndarray, length: int) -> int:
    """Where the part's seed begins: of all stretches of the longest seed that fits, the leftmost that holds the rarest window."""
    n = min(scan.LONGEST_SEED, end - begin)
    if n < length or n == end - begin:
        return begin
    window = counts[scan.packed(text[begin:end], length)]
    least = np.lib.stride_tricks.sliding_window_view(window, n - length + 1).min(1)
    return begin + int(least.argmin())


def seeds_by_count(counts: np.ndarray, length: int, weights: list[int] | None = None):
    """The seeds of grown parts, for scan.Patterns."""
    return partial(_seeds, counts=counts, length=length, weights=weights)


def _seeds(text: np.ndarray, k: int, counts: np.ndarray, length: int, weights: list[int] | None):
    if len(text) <= k:
        return None
    out = []
    for part, (lo, hi) in enumerate(grown_parts(text, k + 1, counts, length, weights)):
        at = rarest_seed(text, lo, hi, counts, length)
        out.append((text[at : min(hi, at + scan.LONGEST_SEED)], at, part))
    return out


def match(reads: DataFrame, pieces: DataFrame, k: int, metric: str = "edit", *, length: int = WINDOW, weights: list[int] | None = None) -> DataFrame:
    """The hits of matching.hamming_match or edit_match for reads of at most scan.MOST_LETTERS letters in all, by grown parts. pieces are those
    of an index or of scan.pieces, with flanks that hold the longest read and its errors."""
    if (reads.agg(F.sum(F.length("seq"))).first()[0] or 0) > scan.MOST_LETTERS:
        raise ValueError(f"reads have more than {scan.MOST_LETTERS} letters: map them in groups")
    rows = [(r.read_id, r.seq) for r in reads.select("read_id", "seq").where(F.length("seq") > 0).collect()]
    hits = scan.match_pieces(pieces, rows, k, metric, seeds_by_count(window_counts(pieces, length), length, weights))
    if metric == "edit" and k:
        return matching.nonredundant(hits, k)
    return hits if k == 0 else matching.one_strand(hits)

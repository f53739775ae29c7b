"""Search schemes that run: what a search allows in its first parts makes seeds that may hold errors.

A search goes through the parts in an order and bounds the errors that it has met after each. Its first parts
adjoin each other, so they are one stretch with at most as many errors as the bound after them: a seed is such a stretch, or
its first letters, with each of its neighbours within that many substitutions. Longer seeds are rarer, so
schemes that allow no error or one in many letters bring few candidates even for large k. As each distribution of errors
is covered by a search, no hit is lost; candidates are verified as others are.
"""

from __future__ import annotations

from functools import partial
from itertools import combinations, product

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.operators import matching, scan, schemes

#: Substitutions that a seed may hold, and that it may hold where a search allows so many in its first part: of 13 letters, 40
#: strings are within one, 742 within two.
MOST_ERRORS, UTMOST_ERRORS = 1, 2
_LETTERS = np.frombuffer(b"ACGT", np.uint8)


def stretches(searches: list[schemes.Search], most_errors: int = MOST_ERRORS) -> list[tuple[int, int, int]]:
    """(first part, last part, errors) of each search's seed: its first parts for as long as its upper bound is no more than most_errors.

    The same stretch comes once, with the most errors that a search allows in it. A search that allows more in its first part alone
    has that part as its seed, up to UTMOST_ERRORS; with more there is no seed: an error.
    """
    out: dict[tuple[int, int], int] = {}
    for s in searches:
        if s.upper[0] > max(most_errors, UTMOST_ERRORS):
            raise ValueError(f"a search allows {s.upper[0]} errors in its first part, seeds at most {UTMOST_ERRORS}")
        n = sum(u <= max(most_errors, s.upper[0]) for u in s.upper)  # bounds don't decrease
        first = s.order[:n]
        key = min(first), max(first)
        out[key] = max(out.get(key, 0), s.upper[n - 1])
    return [(lo, hi, errors) for (lo, hi), errors in sorted(out.items())]


def neighbours(letters: np.ndarray, errors: int) -> list[np.ndarray]:
    """The letters, and all strings with at most so many of them replaced by others of ACGT."""
    out = [letters]
    for n in range(1, min(errors, len(letters)) + 1):
        for places in combinations(range(len(letters)), n):
            for new in product(*([x for x in _LETTERS if x != letters[p]] for p in places)):
                changed = letters.copy()
                changed[list(places)] = new
                out.append(changed)
    return out


def scheme_seeds(strategy: str, k: int, most_errors: int = MOST_ERRORS):
    """The seeds of a strategy's searches, for scan.Patterns, with Hamming distances."""
    searches = schemes.build(strategy, k)
    return partial(_seeds, parts=len(searches[0].order), wanted=stretches(searches, most_errors))


def _seeds(text: np.ndarray, k: int, parts: int, wanted: list[tuple[int, int, int]]):
    m = len(text)
    if m < parts:
        return None
    out = []
    for first, last, errors in wanted:
        lo, hi = first * m // parts, (last + 1) * m // parts
        own = text[lo : min(hi, lo + scan.LONGEST_SEED)]
        out += [(x, lo, 0) for x in neighbours(own, errors)]
    return out


def match(reads: DataFrame, pieces: DataFrame, k: int, strategy: str = "columba", *, alone: bool = False) -> DataFrame:
    """The hits of matching.hamming_match for reads of at most scan.MOST_LETTERS letters in all, by the seeds of a strategy. pieces are those
    of an index or of scan.pieces, with flanks that hold the longest read and its errors. alone: whether each sequence is known to have a number of
    its own; then tasks leave out second strands, and no hit is shuffled."""
    if (reads.agg(F.sum(F.length("seq"))).first()[0] or 0) > scan.MOST_LETTERS:
        raise ValueError(f"reads have more than {scan.MOST_LETTERS} letters: map them in groups")
    rows = [(r.read_id, r.seq) for r in reads.select("read_id", "seq").where(F.length("seq") > 0).collect()]
    if alone and matching.named_apart(rows):
        return scan.match_pieces(pieces, rows, k, "hamming", scheme_seeds(strategy, k), of="strands")
    return matching.one_strand(scan.match_pieces(pieces, rows, k, "hamming", scheme_seeds(strategy, k)))


def strategy_costs(reads: DataFrame, pieces: DataFrame, k: int, strategies: tuple[str, ...]) -> DataFrame:
    """(strategy, seeds, places): distinct seeds of all reads and strands, neighbours not counted, and at how many places they stand."""
    spark = reads.sparkSession
    rows = [(r.read_id, r.seq) for r in reads.select("read_id", "seq").where(F.length("seq") > 0).collect()]
    found = []
    places = scan.count_places_of_each(pieces, rows, k, [scheme_seeds(strategy, k) for strategy in strategies])
    for strategy, met in zip(strategies, places):  # a few
        wanted = stretches(schemes.build(strategy, k))
        parts = len(schemes.build(strategy, k)[0].order)
        n = 2 * len(wanted) * sum(len(seq) >= parts for _, seq in rows)
        found.append((strategy, n, met))
    return spark.createDataFrame(found, "strategy string, seeds long, places long")

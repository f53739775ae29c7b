"""Matching in one pass over the references: seeds and patterns are broadcast, hits come out.

For read sets of a bounded size. References are cut into pieces with the letters around them, dealt
over all tasks, and each Arrow batch of pieces is handled as one array: k-mers are packed numbers, a
sorted table of seeds finds candidates, and all candidates of one pattern length are verified at once.
Nothing but hits leaves a task, so no candidate is shuffled.
"""

from __future__ import annotations

from functools import partial
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strandwise.functions.sequence import bound_batches

#: Letters of a piece, letters that are searched at a time, and letters that a verification gathers at a time.
PIECE, SEARCHED, GATHERED = 1 << 16, 1 << 18, 1 << 21
#: Candidates at a time; those of one pattern stay together, at most (k + 1) ** 2 for a letter that is searched.
CANDIDATES = 1 << 20
#: Places of seeds whose surroundings are compared at a time.
COMPARED = 1 << 14
#: Letters of all reads (both strands take twice as many bytes) up to which they are broadcast, and bytes of references for a task.
MOST_LETTERS, TASK_BYTES = 1 << 23, 16 << 20
#: The longest seed: a number of base 5 in 63 bits.
LONGEST_SEED = 13
#: Bits of the hash by which k-mers are told from those that are no seed.
MARK_BITS = 18

_CODE = np.full(256, 4, np.uint64)
_CODE[np.frombuffer(b"ACGT", np.uint8)] = np.arange(4, dtype=np.uint64)
_LOW = np.uint64(0x5555555555555555)
_COMPLEMENT = bytes.maketrans(b"ACGT", b"TGCA")
_HIT = "read_id string, strand string, seq_idx long, begin long, end long, distance long"


def packed(letters: np.ndarray, k: int) -> np.ndarray:
    """The k-mer at each place as a number of base 5, least letter first; letters but ACGT are one letter. By doubling."""
    power = _CODE[letters]
    out, have, size, rest = None, 0, 1, k
    while rest:
        if rest & 1:
            if out is None:
                out, have = power, size
            else:
                out, have = out[: len(power) - have] + power[have:] * np.uint64(5**have), have + size
        rest >>= 1
        if rest:
            power, size = power[: len(power) - size] + power[size:] * np.uint64(5**size), 2 * size
    return out


def words(letters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(the 32 letters from each place on, those before each place from the last one on), first letter lowest, and for the place behind the end too. By doubling.

    Letters but ACGT are as A, and so is what lies outside: words that differ are of letters that differ.
    """
    code = _CODE[letters] & np.uint64(3)
    ahead, behind = np.append(code, np.uint64(0)), np.append(np.uint64(0), code)
    size = 1
    while size < 32:
        more, before = np.zeros_like(ahead), np.zeros_like(behind)
        more[:-size], before[size:] = ahead[size:], behind[:-size]
        ahead, behind = ahead | more << np.uint64(2 * size), behind | before << np.uint64(2 * size)
        size *= 2
    return ahead, behind


def words_at(letters: np.ndarray, at: np.ndarray, step: int = 1) -> np.ndarray:
    """words at some places, by step 1 the letters from there on, by -1 those down from there."""
    out = np.zeros(len(at), np.uint64)
    for i in range(32):
        place = at + step * i
        code = _CODE[letters[np.clip(place, 0, len(letters) - 1)]] & np.uint64(3)
        out |= np.where((place >= 0) & (place < len(letters)), code, np.uint64(0)) << np.uint64(2 * i)
    return out


def word_distance(x: np.ndarray, y: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Letters that differ in two words, among those whose low bits are in counted."""
    z = x ^ y
    return np.bitwise_count((z | z >> np.uint64(1)) & counted)


def word_errors(text: np.ndarray, pattern: np.ndarray, size: np.ndarray, most: int) -> np.ndarray:
    """The least edit distance of the first size letters of pattern to what text begins with, most + 1 for more. size is at most 32 - most.

    By furthest reaching diagonals: how many letters (here twice as many, as bits) are behind with so many errors.
    """
    end, two = (2 * size).astype(np.uint64), np.uint64(2)
    found = np.full(len(text), most + 1, np.int8)
    reach: dict[int, np.ndarray] = {}
    for errors in range(most + 1):
        now = {}
        for d in range(-errors, errors + 1):  # letters of text less those of pattern
            came = []
            if d in reach:
                came.append(reach[d] + two)
            if d - 1 in reach:
                came.append(reach[d - 1])
            if d + 1 in reach:
                came.append(reach[d + 1] + two)
            i = np.minimum(came[0] if len(came) == 1 else np.maximum.reduce(came), end) if came else np.zeros(len(text), np.uint64)
            x = pattern >> i ^ text >> (i + np.uint64(2 * d) if d >= 0 else i - np.uint64(-2 * d))
            i += np.bitwise_count((x & (~x + np.uint64(1))) - np.uint64(1)) & np.uint8(254)
            now[d] = np.minimum(i, end)
        reach = now
        found[(found > errors) & (np.maximum.reduce(list(reach.values())) >= end)] = errors
    return found


def _mark(kmers: np.ndarray) -> np.ndarray:
    return kmers * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - MARK_BITS)


class Measured(NamedTuple):
    """letters in all, of the longest sequence, and whether each sequence has a number of its own. Sizes may be bounds from above."""

    letters: int
    longest: int
    alone: bool


def measured(seqs: DataFrame) -> Measured:
    """One pass over (seq_idx, seq). Texts that sequences are made of by leaving letters out bound them, and need no such pass."""
    size, rows = F.octet_length("seq"), F.count(F.lit(1))
    letters, longest, n, different = seqs.agg(F.sum(size), F.max(size), rows, F.count_distinct("seq_idx")).first()
    return Measured(letters or 0, longest or 0, n == different)


def pieces(refs: DataFrame, left: int, right: int, letters: int | None = None) -> DataFrame:
    """(seq_idx, first, lead, own, body): PIECE letters from first on, with up to left letters before and right after them.

    lead is how many stand before, own how many are the piece's. Cut where the references are read, then dealt over all tasks by
    sequence and place: one shuffle. letters: how many there are, if that is known.
    """
    bound_batches(refs.sparkSession)
    if letters is None:
        letters = refs.agg(F.sum(F.octet_length("seq"))).first()[0] or 0
    parts = max(2 * refs.sparkSession.sparkContext.defaultParallelism, -(-letters // TASK_BYTES))
    cut = refs.select("seq_idx", "seq").mapInArrow(partial(_cut, left=left, right=right), "seq_idx long, first long, lead int, own int, body binary")
    return cut.repartition(parts, "seq_idx", "first")


def _cut(batches, left: int, right: int):
    names, kinds = ["seq_idx", "first", "lead", "own", "body"], [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()]
    out, size = [], 0
    for batch in batches:
        for idx, seq in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            raw = (seq or "").encode("ascii", "replace")
            for at in range(0, len(raw), PIECE):
                lo = max(0, at - left)
                out.append((idx, at, at - lo, min(PIECE, len(raw) - at), raw[lo : at + PIECE + right]))
                size += len(out[-1][4])
                if size >= 1 << 20:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)
                    out, size = [], 0
    if out:
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), kinds)], names=names)


def even_seeds(text: np.ndarray, k: int):
    """(letters, begin, errors that may stand before it) of the seed of each of k + 1 even parts; None for a text of fewer letters."""
    m, parts = len(text), k + 1
    if m < parts:
        return None
    cuts = [i * m // parts for i in range(parts + 1)]
    return [(text[lo : min(hi, lo + LONGEST_SEED)], lo, i) for i, (lo, hi) in enumerate(zip(cuts, cuts[1:]))]


class Counters:
    """What runs that were given it have met, once their results are written: places where seeds stand, shifts for errors and flanks included; different
    candidates; and those of them that are hits. A task that runs twice counts twice."""

    NAMES = ("places", "candidates", "verified")

    def __init__(self, spark):
        for name in self.NAMES:
            setattr(self, name, spark.sparkContext.accumulator(0))

    def values(self) -> dict[str, int]:
        found = {name: getattr(self, name).value for name in self.NAMES}
        return {**found, "dropped": found["candidates"] - found["verified"]}


class Patterns:
    """All patterns of both strands, and their seeds by length. seeds(text, k) gives what even_seeds does: at least one of a text's
    seeds stands in every string within k errors of it, behind at most so many errors."""

    def __init__(self, reads: list[tuple[str, str]], k: int, seeds=None):
        self.k, self.names, self.strand, texts = k, [], [], []
        for name, seq in sorted(reads, key=lambda r: len(r[1])):  # those of one length, and a read's strands, are side by side
            raw = seq.encode("ascii", "replace")
            for strand, p in (("FW", raw), ("RC", raw.translate(_COMPLEMENT)[::-1])):
                self.names.append(name)
                self.strand.append(strand)
                texts.append(np.frombuffer(p, np.uint8))
        self.texts = texts
        self.size = np.array([len(t) for t in texts], np.int64)
        #: The patterns of each length, from and up to, and their letters
        self.by_size = {int(m): tuple(np.searchsorted(self.size, [m, m + 1]).tolist()) for m in np.unique(self.size)}
        self.table = {m: np.stack(texts[lo:hi]) for m, (lo, hi) in self.by_size.items()}
        found_seeds: dict[int, list[tuple[int, int, int, int]]] = {}
        self.short = []
        for i, t in enumerate(texts):
            own = (seeds or even_seeds)(t, k)
            if own is None:  # every place is tried
                self.short.append(i)
                continue
            for letters, at, before in own:
                found_seeds.setdefault(len(letters), []).append((int(packed(letters, len(letters))[0]), i, at, before))
        # of each pattern: its first 32 letters as a word, and which bits of it count
        joined, offset = np.concatenate([*texts, np.zeros(1, np.uint8)]), np.cumsum(self.size) - self.size
        self.head, self.counted = words_at(joined, offset), _LOW >> (64 - 2 * np.minimum(self.size, 32)).astype(np.uint64)
        self.seeds, self.marks, self.beside = {}, {}, {}
        for n, found in found_seeds.items():
            key, pattern, begin, part = (np.array(c) for c in zip(*found))  # by pattern
            keys, which = np.unique(key.astype(np.uint64), return_inverse=True)
            self.seeds[n] = keys, which, pattern.astype(np.int64), begin.astype(np.int64), part.astype(np.int64)
            # hashes that seeds have: most k-mers of the references have none of them, and are not looked up
            self.marks[n] = np.zeros(1 << MARK_BITS, bool)
            self.marks[n][_mark(keys)] = True
            # the letters before and behind each seed as words, and how many of them count
            at, most = offset[pattern] + begin, max(0, 32 - k)
            left, right = words_at(joined, at - 1, -1), words_at(joined, at + n)
            self.beside[n] = left, np.minimum(begin, most), right, np.minimum(self.size[pattern] - begin - n, most)


def candidates(letters: np.ndarray, room: np.ndarray, patterns: Patterns, gaps: bool, counters=None):
    """(pattern, begin) wherever a part's seed stands, room[begin] letters are enough and up to 32 letters on either side of the seed don't
    rule it out, in order and without repeats.

    room is below 0 where begins are not wanted. With gaps, so are the places that up to p errors put the begin at, for part p: as
    each part after the last one without errors has an error, no more than p are left for those before it.
    Comes in groups of about CANDIDATES, counted before they are made; both strands of a read are whole in one of them.
    """
    k, found, total = patterns.k, [], np.zeros(len(patterns.texts), np.int64)
    for n, (keys, which, pattern, begin, part) in patterns.seeds.items():
        if len(letters) < n:
            continue
        kmers = packed(letters, n)
        pos = np.flatnonzero(patterns.marks[n][_mark(kmers)])
        some = kmers[pos]
        at = np.minimum(np.searchsorted(keys, some), len(keys) - 1)
        same = keys[at] == some
        at, pos = at[same], pos[same]
        pos = pos[np.argsort(at, kind="stable")]
        count = np.bincount(at, minlength=len(keys))
        each = count[which]
        part = part if gaps else np.zeros_like(part)
        total += np.bincount(pattern, each * (2 * part + 1), len(total)).astype(np.int64)
        found.append((pos, (np.cumsum(count) - count)[which], each, pattern, begin, part, n))
    ahead, behind = words(letters)
    short = np.array(patterns.short, np.int64)
    total[short] += len(letters)
    # begins can lie before the array and behind it
    pad = (int(patterns.size[-1]) if len(patterns.size) else 0) + k
    room = np.concatenate([np.full(pad, -1, np.int32), room.astype(np.int32), np.full(pad, -1, np.int32)])
    least = np.maximum(1, patterns.size - k) if gaps else patterns.size
    bits = len(room).bit_length()
    mask = (1 << bits) - 1
    group = np.repeat((np.cumsum(total) - total)[::2] // CANDIDATES, 2)
    edges = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1], [True]])) if len(group) else []
    for lo, hi in zip(edges[:-1], edges[1:]):
        if not total[lo:hi].any():
            continue
        if counters is not None:
            counters.places.add(int(total[lo:hi].sum()))
        keys = []
        for i in short[(short >= lo) & (short < hi)].tolist():
            keys.append((i << bits) + pad + np.flatnonzero(room[pad : pad + len(letters)] >= least[i]))
        for pos, first, each, pattern, begin, part, n in found:
            some = np.arange(*np.searchsorted(pattern, [lo, hi]))
            some = some[each[some] > 0]
            seeds = np.repeat(some, each[some])
            places = pos[np.repeat(first[some] - np.cumsum(each[some]) + each[some], each[some]) + np.arange(len(seeds))]
            for at in range(0, len(seeds), COMPARED):
                seed, place = seeds[at : at + COMPARED], places[at : at + COMPARED]
                own = (pattern[seed] << bits) + pad + place - begin[seed]
                if not gaps:
                    own = own[room[own & mask] >= least[pattern[seed]]]
                    which = own >> bits
                    keys.append(own[word_distance(ahead[(own & mask) - pad], patterns.head[which], patterns.counted[which]) <= k])
                    continue
                left, left_size, right, right_size = (x[seed] for x in patterns.beside[n])
                before = word_errors(behind[place], left, left_size, k)
                # errors that may stand before the seed
                most = np.minimum(part[seed], k - word_errors(ahead[place + n], right, right_size, k))
                for shift in range(-k, k + 1):
                    some_of = own[(most >= before) & (most >= abs(shift))] + shift
                    keys.append(some_of[room[some_of & mask] >= least[some_of >> bits]])
        keys = np.sort(np.concatenate(keys))
        keys = keys[np.diff(keys, prepend=-1) > 0]
        yield keys >> bits, (keys & mask) - pad


def hamming(letters: np.ndarray, begin: np.ndarray, texts: np.ndarray) -> np.ndarray:
    """Letters that differ between each row of texts and the letters from its begin on."""
    return (letters[begin[:, None] + np.arange(texts.shape[1])] != texts).sum(1, dtype=np.int64)


def edit(letters: np.ndarray, begin: np.ndarray, available: np.ndarray, texts: np.ndarray, k: int, of: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(least edit distance of each begin's text to a string of at least one letter from there on, the shortest such string). of: each begin's row of texts.

    k + 1 stands for more than k. A band of 2 * k + 1 diagonals moves down all rows at once; column c
    of it is the string of i + c - k letters. Columns beyond what is available don't count in the end, and
    no other depends on them. Rows that have passed k are left out from time to time.
    """
    n, m = len(begin), texts.shape[1]
    columns = np.ascontiguousarray(texts.T)
    far, last = k + 1, len(letters) - 1
    distance, width = np.full(n, far, np.int64), np.zeros(n, np.int64)
    at, of = np.arange(n), np.arange(n) if of is None else of
    band = [np.full(n, c - k if c >= k else far, np.int8) for c in range(2 * k + 1)]
    window = [letters[np.clip(begin + c - k, 0, last)] for c in range(2 * k)]  # each column's last letter
    for i in range(1, m + 1):
        window.append(letters[np.minimum(begin + (i + k - 1), last)])
        letter, above, band = columns[i - 1][of], band, []
        for c in range(2 * k + 1):
            j = i + c - k  # letters of the string
            x = above[c] + (window[c] != letter) if j >= 1 else np.full(len(at), far, np.int8)
            if c < 2 * k and j >= 0:
                x = np.minimum(x, above[c + 1] + 1)
            if c and j >= 1:
                x = np.minimum(x, band[c - 1] + 1)
            band.append(x)
        del window[0]
        if i % 4 == 0 or i == m:
            alive = np.flatnonzero(np.minimum.reduce(band) <= k)
            if len(alive) < len(at):
                at, of, begin = at[alive], of[alive], begin[alive]
                band, window = [x[alive] for x in band], [x[alive] for x in window]
            if not len(at):
                return distance, width
            band = [np.minimum(x, far) for x in band]
    j = m + np.arange(2 * k + 1) - k
    final = np.where((j < 1)[None] | (j[None] > available[at][:, None]), far, np.stack(band, 1))
    best = final.argmin(1)  # the first of equals: the shortest string
    distance[at] = final[np.arange(len(at)), best]
    width[at] = j[best]
    return distance, width


def thinned(same: np.ndarray, begin: np.ndarray, score: np.ndarray, reach: int) -> tuple[list[int], int]:
    """(rows that are kept, but for the last one; the last one) of hits in order of group, begin and score; same: whether each row is of the group
    of the row before. One within reach of the last kept one is dropped, unless its score is less: then it takes its place. One at the same begin is dropped."""
    near = same & (np.diff(begin) <= reach)  # to the row before; what is far from that is far from the last kept one
    kept, at = [], 0
    place = int(begin[0]), int(score[0])
    for i, (close, b, s) in enumerate(zip(near.tolist(), begin[1:].tolist(), score[1:].tolist()), 1):
        if close and b - place[0] <= reach:
            if b == place[0] or s >= place[1]:
                continue
        else:
            kept.append(at)
        at, place = i, (b, s)
    return kept, at


def _some(batches):
    """Parts of the batches with about SEARCHED letters."""
    for batch in batches:
        total = np.cumsum([len(b) for b in batch.column("body").to_pylist()])
        edges = np.flatnonzero(np.diff(total // SEARCHED, prepend=-1, append=-1)) if batch.num_rows else []
        for lo, hi in zip(edges[:-1], edges[1:]):
            yield batch.slice(lo, hi - lo)


def _verified(letters: np.ndarray, room: np.ndarray, which: np.ndarray, begin: np.ndarray, patterns: Patterns, metric: str):
    """(pattern, begin, width, distance) of the candidates, in order of pattern and begin, that are hits."""
    k, out = patterns.k, []
    for m, (lo, hi) in patterns.by_size.items():
        some = np.searchsorted(which, [lo, hi])
        block = max(1, GATHERED // (m + 2 * k + 1))
        for at in range(some[0], some[1], block):
            part = slice(at, min(at + block, some[1]))
            own, of = begin[part], which[part] - lo
            if metric == "edit" and k:
                d, width = edit(letters, own, room[own], patterns.table[m], k, of)
            else:
                d = hamming(letters, own, patterns.table[m][of])
                width = np.full(len(own), m)
            hit = np.flatnonzero(d <= k)
            out.append((which[part][hit], own[hit], width[hit], d[hit]))
    return [np.concatenate(c) for c in zip(*out)]


def _one_strand(which, begin, width, distance):
    """Hits without those of the second strand where the first has the same distance at the same begin."""
    key = (which >> 1 << int(begin.max()).bit_length() | begin) << int(distance.max()).bit_length() | distance
    order = np.argsort(key << 1 | which & 1)
    order = order[np.diff(key[order], prepend=-1) > 0]
    return which[order], begin[order], width[order], distance[order]


def _thin(which, begin, width, distance, row, reach: int):
    """Hits that matching.nonredundant keeps, all of a read in a sequence being here."""
    score = distance << 32 | width
    order = np.lexsort((which & 1, score, begin, which >> 1))
    read, row, begin, score = which[order] >> 1, row[order], begin[order], score[order]
    kept, last = thinned((np.diff(read) == 0) & (np.diff(row) == 0), begin, score, reach)
    order = order[[*kept, last]]
    return which[order], begin[[*kept, last]], width[order], distance[order]


def _match(batches, shared, k: int, metric: str, counters=None, of: str | None = None):
    """Hits in pieces. of: None for all, "strands" for one where both strands have it, "whole" for those that are kept
    of sequences that are one piece, "cut" for all in other sequences."""
    patterns = shared.value
    names, strand = pa.array(patterns.names, pa.string()), pa.array(patterns.strand, pa.string())
    for batch in _some(batches):
        if of in ("whole", "cut"):
            first, own = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("first", "own"))
            alone = (first == 0) & (pc.binary_length(batch.column("body")).to_numpy(zero_copy_only=False) == own)
            batch = batch.filter(pa.array(alone if of == "whole" else ~alone))
        if not batch.num_rows:
            continue
        idx, first, lead, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seq_idx", "first", "lead", "own"))
        bodies = batch.column("body").to_pylist()
        sizes = np.array([len(b) for b in bodies], np.int64)
        # a letter of no sequence ends each body, so that no seed spans two
        letters = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
        base = np.cumsum(sizes + 1) - sizes - 1
        # letters from each place on to the end of its body; below 0 where the place is not the piece's
        piece = np.repeat(np.arange(len(sizes)), sizes + 1)
        at = np.arange(len(letters)) - base[piece]
        room = np.where((at >= lead[piece]) & (at < (lead + own)[piece]), sizes[piece] - at, -1)
        for which, begin in candidates(letters, room, patterns, metric == "edit", counters):
            if counters is not None:
                counters.candidates.add(len(which))
            if not len(which):
                continue
            which, begin, width, d = _verified(letters, room, which, begin, patterns, metric)
            if counters is not None:
                counters.verified.add(len(which))
            if not len(which):
                continue
            if of == "strands":
                which, begin, width, d = _one_strand(which, begin, width, d)
            elif of == "whole":
                which, begin, width, d = _thin(which, begin, width, d, piece[begin], 2 * k)
            row, taken = piece[begin], pa.array(which)
            start = first[row] - lead[row] + begin - base[row]
            yield pa.RecordBatch.from_arrays(
                [names.take(taken), strand.take(taken), pa.array(idx[row]), pa.array(start), pa.array(start + width), pa.array(d)],
                names=["read_id", "strand", "seq_idx", "begin", "end", "distance"],
            )


def scan(reads: DataFrame, refs: DataFrame, k: int, metric: str, longest: int) -> DataFrame:
    """Hits of both strands of every read, at most MOST_LETTERS in all. Hamming: all with at most k substitutions. Edit: for
    every start the least distance, if at most k, and the shortest string that has it."""
    rows = [(r.read_id, r.seq) for r in reads.select("read_id", "seq").where(F.length("seq") > 0).collect()]
    return match_pieces(pieces(refs, longest + k, longest + k), rows, k, metric)


def match_pieces(cut: DataFrame, rows: list[tuple[str, str]], k: int, metric: str, seeds=None, counters: Counters | None = None, of: str | None = None) -> DataFrame:
    """scan's hits of (read_id, seq) rows in pieces whose flanks hold the longest read and its errors. seeds: see Patterns, of: see _match."""
    return match_shared(cut, shared_patterns(cut.sparkSession, rows, k, seeds), k, metric, counters, of)


def shared_patterns(spark, rows: list[tuple[str, str]], k: int, seeds=None):
    return spark.sparkContext.broadcast(Patterns(rows, k, seeds))


def match_shared(cut: DataFrame, shared, k: int, metric: str, counters: Counters | None = None, of: str | None = None) -> DataFrame:
    bound_batches(cut.sparkSession)
    own = cut.select("seq_idx", "first", "lead", "own", "body")
    return own.mapInArrow(partial(_match, shared=shared, k=k, metric=metric, counters=counters, of=of), _HIT)


def _weights(choices: list[Patterns]) -> tuple[np.ndarray, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """(texts without seeds of each choice, {letters: (all seeds of so many, how often each choice has each)})."""
    by_length = {}
    for n in sorted({n for p in choices for n in p.seeds}):
        keys = np.unique(np.concatenate([p.seeds[n][0] for p in choices if n in p.seeds]))
        count = np.zeros((len(choices), len(keys)), np.int64)
        for own, p in zip(count, choices):
            if n in p.seeds:
                own[np.searchsorted(keys, p.seeds[n][0])] = np.bincount(p.seeds[n][1], minlength=len(p.seeds[n][0]))
        by_length[n] = keys, count
    return np.array([len(p.short) for p in choices], np.int64), by_length


def _places(batches, shared):
    """For each choice, the number of places within pieces' own letters where its seeds stand, and where texts without seeds are tried."""
    short, by_length = shared.value
    total = np.zeros(len(short), np.int64)
    for batch in _some(batches):
        lead, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("lead", "own"))
        bodies = batch.column("body").to_pylist()
        sizes = np.array([len(b) for b in bodies], np.int64)
        letters = np.frombuffer(b"".join(bodies), np.uint8)
        row = np.repeat(np.arange(len(sizes)), sizes)
        at = np.arange(len(letters)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        # letters from each place on to the end of its piece; none where the place is not the piece's
        room = np.where((at >= lead[row]) & (at < lead[row] + own[row]), sizes[row] - at, 0)
        total += own.sum() * short
        for n, (keys, count) in by_length.items():
            if len(letters) < n:
                continue
            kmers = packed(letters, n)
            which = np.minimum(np.searchsorted(keys, kmers), len(keys) - 1)
            which = which[(keys[which] == kmers) & (room[: len(kmers)] >= n)]
            total += count @ np.bincount(which, minlength=len(keys))
    yield pa.RecordBatch.from_arrays([pa.array(range(len(total)), pa.int64()), pa.array(total)], names=["choice", "n"])


def count_places(cut: DataFrame, rows: list[tuple[str, str]], k: int, seeds=None) -> int:
    """count_places_of_each for one choice of seeds."""
    return count_places_of_each(cut, rows, k, [seeds])[0]


def count_places_of_each(cut: DataFrame, rows: list[tuple[str, str]], k: int, choices: list) -> list[int]:
    """What each choice of seeds (see Patterns) costs: at how many places they stand, before any is verified. Pieces have LONGEST_SEED letters or more
    behind them, and are read once for all choices."""
    bound_batches(cut.sparkSession)
    shared = cut.sparkSession.sparkContext.broadcast(_weights([Patterns(rows, k, seeds) for seeds in choices]))
    found = cut.select("lead", "own", "body").mapInArrow(partial(_places, shared=shared), "choice long, n long").groupBy("choice").agg(F.sum("n").alias("n"))
    counts = {r.choice: r.n for r in found.collect()}  # a row for each choice
    return [counts.get(i, 0) for i in range(len(choices))]


_COUNT = "kmer long, n long, seq_idx long, pos long"


def _count(batches, k: int):
    for batch in batches:
        if not batch.num_rows:
            continue
        idx, first, lead, own = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("seq_idx", "first", "lead", "own"))
        bodies = batch.column("body").to_pylist()
        sizes = np.array([len(b) for b in bodies], np.int64)
        letters = np.frombuffer(b"\0".join(bodies) + b"\0", np.uint8)
        if len(letters) < k:
            continue
        base = np.cumsum(sizes + 1) - sizes - 1
        code = _CODE[letters]
        key, wrong = np.zeros(len(letters) - k + 1, np.int64), np.zeros(len(letters) + 1, np.int64)
        np.cumsum(code == 4, out=wrong[1:])
        for i in range(k):
            key = key * 4 + code[i : len(letters) - k + 1 + i].astype(np.int64) % 4
        pos = np.flatnonzero(wrong[k:] == wrong[: len(letters) - k + 1])
        row = np.searchsorted(base, pos, "right") - 1
        mine = (pos >= base[row] + lead[row]) & (pos < base[row] + lead[row] + own[row])
        pos, row = pos[mine], row[mine]
        seq, at, key = idx[row], first[row] - lead[row] + pos - base[row], key[pos]
        order = np.lexsort((at, seq, key))
        kmers, start, n = np.unique(key[order], return_index=True, return_counts=True)
        yield pa.RecordBatch.from_arrays([pa.array(kmers), pa.array(n.astype(np.int64)), pa.array(seq[order][start]), pa.array(at[order][start])], names=["kmer", "n", "seq_idx", "pos"])


def kmer_counts(refs: DataFrame, k: int) -> DataFrame:
    """(kmer, n, seq_idx, pos): every k-mer of ACGT (packed, base 4) with its count and first place; summed by batch before the shuffle."""
    some = pieces(refs, 0, k - 1).mapInArrow(partial(_count, k=k), _COUNT)
    first = F.min(F.struct("seq_idx", "pos")).alias("first")
    return some.groupBy("kmer").agg(F.sum("n").alias("n"), first).select("kmer", "n", "first.seq_idx", "first.pos")

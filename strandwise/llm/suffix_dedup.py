"""Operator 3: removal of repeated byte strings by a hash-compared suffix sort at content-chosen anchors.

A string of LENGTH bytes that starts at two places has the same anchor, the leftmost of its
GRAM-byte substrings with the least hash, at the same distance from both. So repeats are searched
only among suffixes that start near equal anchors: their contexts (all strings of LENGTH bytes that
contain the anchor) are sorted as suffixes by mergesort, which compares two of them by the length
of their common extension. That length comes from prefix polynomial hashes by binary search, so a
comparison takes a logarithmic number of steps. Strings that the hashes call equal are compared
byte by byte before they count. A group that is too large for one sort is split first, as quicksort
does it: each context is compared with a few pivots of its group, byte by byte, and with the strings
that no pivot has it goes on to groups of contexts that share more. Whole contexts that recur are
told by a 128-bit BLAKE2 digest.
"""

from __future__ import annotations

import hashlib
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_arrow, row_key, rows_with, stage, unstage

LENGTH, GRAM = 400, 64
#: Bytes before and after an anchor's start that strings with the anchor can reach.
LEFT, RIGHT = LENGTH - GRAM, LENGTH
#: Places that a block's keys can name, and bytes of a text that are hashed at a time.
PLACES = 1 << 20
BLOCK = PLACES - LENGTH
#: Contexts of one group that are sorted in memory (28 MB); larger groups are split by so many pivots, and into so many parts of their starts.
GROUP, PIVOTS, PARTS = 4096, 8, 3
#: Contexts that a task sorts at a time, and pairs that it compares byte by byte at a time.
SORTED = 1024

_rng = np.random.default_rng(20240229)
#: A byte's random value, and powers of an odd base and of its inverse modulo 2**64.
_VALUE = _rng.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 2**64)


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE, BLOCK + 2 * LENGTH + 1), _powers(_INVERSE, BLOCK + 2 * LENGTH + 1)


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """Along the last axis: the polynomial hash of each prefix, from the empty one on."""
    out = np.zeros((*data.shape[:-1], data.shape[-1] + 1), np.uint64)
    np.cumsum(_VALUE[data] * _UP[: data.shape[-1]], axis=-1, out=out[..., 1:])
    return out


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    return x ^ (x >> np.uint64(29))


def _sliding_least(x: np.ndarray, w: int) -> np.ndarray:
    """The least of each w consecutive values, by running minima of blocks of w."""
    n = len(x)
    padded = np.concatenate([x, np.full(-n % w, np.uint64(2**64 - 1))]).reshape(-1, w)
    ahead = np.minimum.accumulate(padded, axis=1).ravel()
    behind = np.minimum.accumulate(padded[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(behind[: n - w + 1], ahead[w - 1 : n])


def anchors(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(places, hashes) of the anchors of all strings of LENGTH bytes of data, in ascending order."""
    places, hashes = [], []
    for at in range(0, len(data) - LENGTH + 1, BLOCK):
        part = data[at : at + BLOCK + LENGTH - 1]
        h = prefix_hashes(part)
        g = _mix((h[GRAM:] - h[:-GRAM]) * _DOWN[: len(part) - GRAM + 1])
        # the place in the low bits makes the leftmost of equal hashes the least
        keys = (g & ~np.uint64(PLACES - 1)) | np.arange(len(g), dtype=np.uint64)
        least = _sliding_least(keys, LENGTH - GRAM + 1) & np.uint64(PLACES - 1)
        p = least[np.concatenate([[True], least[1:] != least[:-1]])].astype(np.int64)
        places.append(at + p)
        hashes.append(g[p])
    if not places:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    p, h = np.concatenate(places), np.concatenate(hashes)
    new = np.concatenate([[True], p[1:] != p[:-1]])  # blocks overlap
    return p[new], h[new]


_ANCHORS = "rk long, pos long, last long, n long, size long, anchor long, context binary"


def _find(batches):
    kinds = [pa.int64()] * 6 + [pa.binary()]
    names = ["rk", "pos", "last", "n", "size", "anchor", "context"]

    def rows():
        for batch in batches:
            for rk, text in zip(*(c.to_pylist() for c in batch.columns)):
                raw = (text or "").encode()
                p, h = anchors(np.frombuffer(raw, np.uint8))
                run = None
                for pos, a in zip(p.tolist(), h.view(np.int64).tolist()):
                    lo = max(0, pos - LEFT)
                    c = hashlib.blake2b(raw[lo : pos + RIGHT], digest_size=16, salt=(pos - lo).to_bytes(8, "little")).digest()
                    if run and run[6] == c:  # a text that repeats itself at once: one row for the run
                        run[2], run[3] = pos, run[3] + 1
                        continue
                    if run:
                        yield run
                    run = [rk, pos, pos, 1, len(raw), a, c]
                if run:
                    yield run

    for group in by_bytes(rows(), lambda _: 1, 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*group), kinds)], names=names)


class Contexts:
    """Contexts of anchors side by side: column LEFT is the anchor's first byte; absent bytes are 0 and never compared."""

    def __init__(self, rows: list[tuple[int, bytes]]):
        """rows: (bytes before the anchor, the context)."""
        self.left = np.array([left for left, _ in rows], np.int64)
        self.right = np.array([len(x) - left for left, x in rows], np.int64)
        self.data = np.zeros((len(rows), LEFT + RIGHT), np.uint8)
        for i, (left, x) in enumerate(rows):
            self.data[i, LEFT - left : LEFT - left + len(x)] = np.frombuffer(x, np.uint8)
        self.hashes = prefix_hashes(self.data)

    def same(self, i, j, start, length) -> np.ndarray:
        """Whether the hashes of the strings of contexts i and j from column start on are equal."""
        h = self.hashes
        return h[i, start + length] - h[i, start] == h[j, start + length] - h[j, start]

    def extension(self, i, j, start, length) -> np.ndarray:
        """The length of the common extension from start on, at most length: a binary search over hashed prefixes."""
        lo, hi = np.zeros(len(i), np.int64), np.array(length, np.int64)
        while (open_ := lo < hi).any():
            mid = (lo + hi + 1) // 2
            equal = self.same(i, j, start, mid)
            lo = np.where(open_ & equal, mid, lo)
            hi = np.where(open_ & ~equal, mid - 1, hi)
        return lo

    def compare(self, i, j, start, length) -> np.ndarray:
        """-1, 0 or 1 as the string of i sorts before, with or after that of j."""
        out = np.zeros(len(i), np.int64)
        k = np.flatnonzero(~self.same(i, j, start, length))
        if len(k):
            i, j, start, length = i[k], j[k], start[k], length[k]
            at = start + np.minimum(self.extension(i, j, start, length), length - 1)
            out[k] = np.sign(self.data[i, at].astype(np.int64) - self.data[j, at])
        return out

    def bytes_equal(self, i, j, start, length) -> np.ndarray:
        column, out = np.arange(self.data.shape[1]), np.empty(len(i), bool)
        for at in range(0, len(i), SORTED):
            k = slice(at, at + SORTED)
            outside = (column < start[k, None]) | (column >= (start[k] + length[k])[:, None])
            out[k] = ((self.data[i[k]] == self.data[j[k]]) | outside).all(1)
        return out


def sort_suffixes(contexts: Contexts, which: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Order of the items by suffix within each group: a bottom-up mergesort of all groups at once.

    Items of a group are adjacent and share start and length. In a pass each item finds its place in
    the neighbouring run by binary search, so a pass takes a logarithmic number of comparisons.
    """
    n = len(which)
    first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    counts = np.diff(np.append(first, n))
    begin, end = np.repeat(first, counts), np.repeat(first + counts, counts)
    order, w = np.arange(n), 1
    while w < counts.max():
        at = np.flatnonzero(end - begin > w)
        b, e = begin[at], end[at]
        pair = b + (at - b) // (2 * w) * (2 * w)
        mid, stop = np.minimum(pair + w, e), np.minimum(pair + 2 * w, e)
        in_left = at < mid
        base = np.where(in_left, mid, pair)
        lo, hi = base.copy(), np.where(in_left, stop, mid)
        while len(k := np.flatnonzero(lo < hi)):
            m = (lo[k] + hi[k]) // 2
            x, y = order[m], order[at[k]]
            c = contexts.compare(which[x], which[y], start[y], length[y])
            after = np.where(in_left[k], c < 0, c <= 0)  # equal items keep their runs' order
            lo[k] = np.where(after, m + 1, lo[k])
            hi[k] = np.where(after, hi[k], m)
        place = np.where(in_left, at, pair + at - mid) + lo - base
        merged = order.copy()
        merged[place] = order[at]
        order, w = merged, 2 * w
    return order


def classes(contexts: Contexts, which: np.ndarray, group: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """A number for each item; items of one group have one number if and only if their strings are equal."""
    order = sort_suffixes(contexts, which, group, start, length)
    i, j = order[:-1], order[1:]
    near = (group[i] == group[j]) & contexts.same(which[i], which[j], start[j], length[j])
    equal = near.copy()
    k = np.flatnonzero(near)
    equal[k] = contexts.bytes_equal(which[i[k]], which[j[k]], start[j[k]], length[j[k]])
    out = np.empty(len(which), np.int64)
    out[order] = np.cumsum(np.concatenate([[0], ~equal]))
    # equal hashes must mean one class; where a collision broke a class up, bytes decide
    h = contexts.hashes
    full = h[which, start + length] - h[which, start]
    keys, number = np.unique(np.stack([group.astype(np.uint64), full]), axis=1, return_inverse=True)
    number = number.ravel()
    low, high = np.full(keys.shape[1], np.iinfo(np.int64).max), np.full(keys.shape[1], -1)
    np.minimum.at(low, number, out)
    np.maximum.at(high, number, out)
    for broken in np.flatnonzero(low != high).tolist():
        seen: dict[bytes, int] = {}
        for x in np.flatnonzero(number == broken).tolist():
            text = contexts.data[which[x], start[x] : start[x] + length[x]].tobytes()
            out[x] = seen.setdefault(text, len(which) + broken * len(which) + len(seen))
    return np.unique(out, return_inverse=True)[1].ravel()


def repeated_starts(contexts: Contexts, group: np.ndarray, done: np.ndarray, first: np.ndarray | None = None, last: np.ndarray | None = None) -> list[tuple[int, int, int]]:
    """(context, u, v): all strings of the context that start u to v bytes before its anchor are repeated in its group.

    group is ascending; of each group only starts first to last (all, if they are not given) are
    asked for. A context that is done needs no answer, but the others may repeat it. The starts are
    halved again and again: strings of a part share their middle, and where it occurs once, none of
    them is repeated; where the union of the part's strings occurs twice, all are, and one of the
    contexts stands for the others from there on.
    """
    found, n = [], len(group)
    if first is None:
        # all share the anchor's bytes and no two are equal, so the first halving needs no look
        half = LEFT // 2
        which, done = np.tile(np.arange(n), 2), np.tile(done, 2)
        group = np.concatenate([group, group + group.max(initial=0) + 1])
        u, v = np.repeat([0, half + 1], n), np.repeat([half, LEFT], n)
    else:
        which, u, v = np.arange(n), first, last
    while len(which):
        # the middle: from u before the anchor, LENGTH - v after it
        has = (contexts.left[which] >= u) & (contexts.right[which] >= LENGTH - v)
        which, group, done, u, v = (x[has] for x in (which, group, done, u, v))
        if not len(which):
            break
        middle = classes(contexts, which, group, LEFT - u, u + LENGTH - v)
        order = np.argsort(middle, kind="stable")
        which, group, done, u, v = (x[order] for x in (which, middle, done, u, v))
        count, waiting = np.bincount(group), np.bincount(group, ~done)
        more = (count[group] > 1) & (waiting[group] > 0)
        which, group, done, u, v = (x[more] for x in (which, group, done, u, v))
        if not len(which):
            break
        whole = (contexts.left[which] >= v) & (contexts.right[which] >= LENGTH - u)
        keep = np.ones(len(which), bool)
        k = np.flatnonzero(whole)
        if len(k):
            union = classes(contexts, which[k], group[k], LEFT - v[k], v[k] + LENGTH - u[k])
            twice = np.bincount(union)[union] > 1
            hit = k[twice & ~done[k]]
            found += zip(which[hit].tolist(), u[hit].tolist(), v[hit].tolist())
            _, stand = np.unique(union, return_index=True)
            stands = np.zeros(len(k), bool)
            stands[stand] = True
            keep[k[twice & ~stands]] = False
            done[k[twice]] = True
        keep &= u < v
        which, group, done, u, v = (x[keep] for x in (which, group, done, u, v))
        half = (u + v) // 2
        which, done = np.tile(which, 2), np.tile(done, 2)
        group = np.concatenate([2 * group, 2 * group + 1])
        u, v = np.concatenate([u, half + 1]), np.concatenate([half, v])
        order = np.argsort(group, kind="stable")
        which, group, done, u, v = (x[order] for x in (which, group, done, u, v))
    return found


_CONTEXTS = "many boolean, group binary, first int, last int, rk long, pos long, done boolean, before int, bytes binary"


def _fetch(batches):
    kinds = [pa.bool_(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.int32(), pa.binary()]
    names = ["many", "group", "first", "last", "rk", "pos", "done", "before", "bytes"]

    def rows():
        for batch in batches:
            for rk, text, wanted in zip(*(c.to_pylist() for c in batch.columns)):
                raw = text.encode()
                for x in wanted:
                    pos = x["pos"]
                    lo = max(0, pos - LEFT)
                    yield x["many"], x["anchor"].to_bytes(8, "little", signed=True), 0, LEFT, rk, pos, x["done"], pos - lo, raw[lo : pos + RIGHT]

    for group in by_bytes(rows(), lambda _: 1, 1 << 12):
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*group), kinds)], names=names)


_SPAN = "rk long, lo long, hi long"


def _spans(rows):
    for group in by_bytes(rows, lambda _: 1, 1 << 14):
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*group)], names=["rk", "lo", "hi"])


def _resolve(batches):
    """Contexts arrive sorted by group; whole groups are gathered up to about SORTED contexts."""
    def groups():
        at, held = None, []
        for batch in batches:
            for row in zip(*(batch.column(n).to_pylist() for n in ("group", "first", "last", "rk", "pos", "done", "before", "bytes"))):
                if row[0] != at:
                    if held:
                        yield held
                    at, held = row[0], []
                held.append(row)
        if held:
            yield held

    def rows():
        for part in by_bytes(groups(), len, SORTED):
            flat = [r for g in part for r in g]
            contexts = Contexts([(r[6], r[7]) for r in flat])
            group = np.repeat(np.arange(len(part)), [len(g) for g in part])
            whole = all(r[1] == 0 and r[2] == LEFT for r in flat)
            ranges = () if whole else (np.array([r[1] for r in flat], np.int64), np.array([r[2] for r in flat], np.int64))
            for i, u, v in repeated_starts(contexts, group, np.array([r[5] for r in flat]), *ranges):
                yield flat[i][3], flat[i][4] - v, flat[i][4] - u + LENGTH

    return _spans(rows())


def _common(a: bytes, b: bytes) -> int:
    """The length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    return int(np.argmax(np.frombuffer(a, np.uint8, n) != np.frombuffer(b, np.uint8, n)))


_ITEM = "group binary, first int, last int, rk long, pos long, done boolean, before int, bytes binary"
_ITEMS = pa.schema([("group", pa.binary()), ("first", pa.int32()), ("last", pa.int32()), ("rk", pa.int64()), ("pos", pa.int64()), ("done", pa.bool_()), ("before", pa.int32()), ("bytes", pa.binary())])


def _split(batches):
    """Compares each context of a large group with its pivots. Rows: spans that they share, and items of smaller groups.

    Two contexts that share a string share it with the same pivots. So a string that a pivot has is
    settled for all who hold it, the pivot included. The group's starts are cut into PARTS, and with a
    part that holds any other string a context goes on to those that have its part's middle in common.
    """
    items, spans = [], {}

    def tables():
        if items:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*items), _ITEMS)] + [pa.nulls(len(items), pa.int64())] * 2, names=[*_ITEMS.names, "lo", "hi"])
        if spans:
            # what overlaps is one span
            rk, lo, hi = zip(*((rk, lo, hi) for rk, found in spans.items() for lo, hi in merge_spans(found)))
            empty = [pa.nulls(len(rk), f.type) for f in _ITEMS]
            empty[_ITEMS.get_field_index("rk")] = pa.array(rk, pa.int64())
            yield pa.RecordBatch.from_arrays([*empty, pa.array(lo, pa.int64()), pa.array(hi, pa.int64())], names=[*_ITEMS.names, "lo", "hi"])
        items.clear()
        spans.clear()

    for batch in batches:
        columns = (batch.column(n).to_pylist() for n in ("group", "first", "last", "rk", "pos", "done", "before", "bytes", "pivots"))
        for group, first, last, rk, pos, done, before, raw, pivots in zip(*columns):
            back, ahead, shared, own = raw[:before][::-1], raw[before:], [], False
            for p in pivots:
                if (rk, pos) == (p["rk"], p["pos"]):
                    own = True
                    continue
                # starts o that lie within what is common on the left, and LENGTH - o on the right
                hi = min(last, _common(back, p["bytes"][: p["before"]][::-1]))
                lo = max(first, LENGTH - _common(ahead, p["bytes"][p["before"] :]))
                if lo <= hi:
                    shared.append((lo, hi + 1))
                    if not p["done"]:
                        spans.setdefault(p["rk"], set()).add((p["pos"] - hi, p["pos"] - lo + LENGTH))
            shared = merge_spans(shared)
            if shared and not done:
                spans.setdefault(rk, set()).update((pos - hi + 1, pos - lo + LENGTH) for lo, hi in shared)
            step = -(-(last - first + 1) // PARTS)
            for u in range(first, last + 1, step):
                v = min(last, u + step - 1)
                lo, hi = max(u, LENGTH - len(ahead)), min(v, before)  # starts that the context has
                if own or lo > hi or any(a <= lo and hi < b for a, b in shared):
                    continue
                key = hashlib.blake2b(raw[before - u : before + LENGTH - v], digest_size=16, key=group, salt=b"%d" % u).digest()
                lo = max(0, before - v)  # what strings of the part can reach
                items.append((key, u, v, rk, pos, done, before - lo, raw[lo : before - u + LENGTH]))
            if len(items) + len(spans) >= 1 << 14:
                yield from tables()
    yield from tables()


def _split_groups(items: DataFrame) -> tuple[DataFrame, DataFrame, list[DataFrame]]:
    """(items of groups of at most GROUP, spans that pivots have shown, the staged tables that hold them): groups of any size, without gathering one.

    Members meet their group's pivots in a join of one row a group, whose skewed partitions Spark
    splits. An item alone in its group goes no further. Every round leaves a
    PARTS-th of a group's starts; when one is left, pivots settle it, so there are at most seven.
    """
    small, spans, held = [], [], []
    while True:
        pivot = F.min(F.struct("rk", "pos", "done", "before", "bytes")).alias("pivot")
        slots = items.groupBy("group", F.pmod(F.xxhash64("rk", "pos"), F.lit(PIVOTS)).alias("slot")).agg(F.count(F.lit(1)).alias("n"), pivot)
        groups = slots.groupBy(F.col("group").alias("of")).agg(F.sum("n").alias("n"), F.collect_list("pivot").alias("pivots")).where("n > 1")
        groups = stage(groups.select("of", F.when(F.col("n") > GROUP, F.col("pivots")).alias("pivots")), "pivots")
        held.append(groups)
        met = items.join(groups, F.col("group") == F.col("of")).drop("of")
        small.append(met.where("pivots is null").drop("pivots"))
        if not groups.where("pivots is not null").limit(1).count():
            break
        split = stage(met.where("pivots is not null").transform(in_arrow, _split, f"{_ITEM}, lo long, hi long"), "split")
        held.append(split)
        spans.append(split.where("lo is not null").select("rk", "lo", "hi"))
        items = split.where("lo is null").drop("lo", "hi")
    union = lambda tables: reduce(DataFrame.union, tables)
    return union(small), union(spans) if spans else items.sparkSession.createDataFrame([], _SPAN), held


def merge_spans(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for lo, hi in sorted(spans):
        if out and lo <= out[-1][1]:
            out[-1] = out[-1][0], max(hi, out[-1][1])
        else:
            out.append((lo, hi))
    return out


_KEPT = "doc_id long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"


def _cut(batches):
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
    for batch in batches:
        columns = batch.schema.names
        sizes, spans, kept = [], [], []
        for text, found in zip(batch.column("text").to_pylist(), batch.column("found").to_pylist() if "found" in columns else [None] * batch.num_rows):
            raw = (text or "").encode()
            merged = merge_spans([(x["lo"], x["hi"]) for x in found or ()])
            at, out = 0, []
            for lo, hi in merged:
                out.append(raw[at:lo])
                at = hi
            sizes.append(len(raw))
            spans.append([{"start": lo, "end": hi} for lo, hi in merged])
            kept.append(b"".join([*out, raw[at:]]))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(spans, kind), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "spans", "kept"])


def remove_repeats(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_bytes, spans (start, end of each maximal removed run), kept (the other bytes).

    A byte goes if a string of LENGTH bytes that covers it starts anywhere else too, in this or
    another row; strings don't cross rows. Null, empty and short texts keep all; null ids stay null;
    repeated rows repeat each other, so those of LENGTH bytes or more lose everything; an empty
    table gives an empty result; a text of any length is searched whole, in blocks that overlap;
    other columns of docs, whatever their names, are not read. kept is binary, as a cut can split a
    character.

    Shuffled are anchors (a row for about 130 bytes), the texts of rows with contexts that must be
    sorted or with bytes to remove, and those contexts. Equal contexts are counted before the
    shuffle and decide each other without a sort. A group of more than GROUP different contexts is
    not gathered: pivots split it until its parts can be sorted.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("rk", row_key("doc_id", "text"))
    texts = rows.select("rk", "text")
    found = stage(texts.transform(in_arrow, _find, _ANCHORS), "anchors")
    each = found.groupBy("anchor", "context").agg(F.sum("n").alias("n"), F.min(F.struct("rk", "pos")).alias("at"))
    groups = each.groupBy(F.col("anchor").alias("of")).agg(F.sum("n").alias("total"), F.count(F.lit(1)).alias("m")).where("total > 1")
    groups = stage(groups, "groups")  # so that Spark can split the other side of the join where an anchor is hot
    each = stage(each.join(groups, F.col("anchor") == F.col("of")).drop("of", "total"), "repeated")
    equal = each.where("n > 1").select(F.col("context").alias("of"))
    spans = found.join(equal, F.col("context") == F.col("of")).select("rk", F.greatest(F.lit(0), F.col("pos") - LEFT).alias("lo"), F.least("size", F.col("last") + RIGHT).alias("hi"))

    wanted = each.where("m > 1").select(F.col("at.rk").alias("rk"), F.struct(F.col("at.pos").alias("pos"), "anchor", (F.col("n") > 1).alias("done"), (F.col("m") > GROUP).alias("many")).alias("x"))
    wanted = stage(wanted.groupBy("rk").agg(F.collect_list("x").alias("wanted")), "wanted")
    some, _ = rows_with(texts, wanted)
    # repeated rows share a key, and all but one may go
    fetched = some.join(wanted.withColumnRenamed("rk", "of"), F.col("rk") == F.col("of")).select("rk", "text", "wanted").transform(in_arrow, _fetch, _CONTEXTS)
    fetched = stage(fetched, "contexts")
    small, large = fetched.where("not many").drop("many"), fetched.where("many").drop("many")
    held = []
    if large.limit(1).count():
        split, shown, held = _split_groups(large)
        small, spans = small.union(split), spans.union(shown)
    spans = spans.union(small.repartition("group").sortWithinPartitions("group").transform(in_arrow, _resolve, _SPAN))
    spans = stage(spans.groupBy("rk").agg(F.collect_set(F.struct("lo", "hi")).alias("found")), "spans")
    unstage(found, groups, each, wanted, fetched, *held)

    some, rest = rows_with(rows, spans)
    cut = some.join(spans.withColumnRenamed("rk", "of"), F.col("rk") == F.col("of"), "left").select("doc_id", "text", "found").transform(in_arrow, _cut, _KEPT)
    return cut if rest is None else cut.union(rest.select("doc_id", "text").transform(in_arrow, _cut, _KEPT))


def repeat_digest(removed: DataFrame) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256 and text: what is kept, with U+FFFD for characters that a cut split."""
    gone = F.aggregate("spans", F.lit(0).cast("long"), lambda total, x: total + x["end"] - x["start"])
    text = F.make_valid_utf8(F.col("kept").cast("string"))
    return removed.select("doc_id", "n_bytes", gone.alias("n_removed"), F.size("spans").cast("long").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"), text.alias("text"))


def oracle_sql(length: int = 400) -> str:
    """DuckDB; for ids that are neither null nor repeated and texts that no cut leaves with half a character. It names every string by its MD5."""
    return f"""
WITH t AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, '')))::BIGINT AS n FROM documents),
u AS (SELECT doc_id, a, substr(x, 2 * a + 1, 2 * (512 + {length - 1})) AS y FROM (SELECT doc_id, x, unnest(range(0, n - {length - 1}, 512)) AS a FROM t WHERE n >= {length})),
p AS (SELECT doc_id, a + i AS i, md5_number(substr(y, 2 * i + 1, {2 * length})) AS h FROM (SELECT doc_id, a, y, unnest(range(0, least(512, len(y) // 2 - {length - 1}))) AS i FROM u)),
r AS (SELECT doc_id, i FROM p WHERE h IN (SELECT h FROM p GROUP BY h HAVING count(*) > 1)),
b AS (SELECT doc_id, i, (i - lag(i) OVER (PARTITION BY doc_id ORDER BY i) <= {length}) IS NOT TRUE AS begins FROM r),
c AS (SELECT doc_id, i, sum(begins::INT) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM b),
s AS (SELECT doc_id, min(i) AS lo, max(i) + {length} AS hi FROM c GROUP BY doc_id, span),
g AS (SELECT doc_id, lo, hi, coalesce(lag(hi) OVER (PARTITION BY doc_id ORDER BY lo), 0) AS after FROM s),
k AS (SELECT t.doc_id, string_agg(substr(x, 2 * after + 1, 2 * (lo - after)), '' ORDER BY lo) || substr(any_value(x), 2 * max(hi) + 1) AS kept,
             sum(hi - lo)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM g JOIN t USING (doc_id) GROUP BY t.doc_id)
SELECT t.doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(kept, x))) AS kept_sha256,
       decode(unhex(coalesce(kept, x))) AS text
FROM t LEFT JOIN k USING (doc_id)"""

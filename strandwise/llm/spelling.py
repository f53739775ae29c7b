"""Operator 12: spelling variants, by a self-join of a prefix-partitioned vocabulary trie with active nodes.

Two words at distance one differ at one place: the length of their common prefix. So for words of L
and L - 1 code points the places 0 to L - 1 are cut into intervals, and a group of words that share
what stands before and what stands after an interval (its key) holds every pair that differs within it. The
middles of a group's words form a trie, and each key is the root of one: all tries of a chunk are
walked at once, level by level. An active pair is two nodes of one depth that differ by a
replacement, or a node and one a level deeper that has one code point more. It arises where the
paths part, and goes down by equal code points; pairs of words that are left at the end are the result.
"""

from __future__ import annotations

import re
import zlib
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_arrow, slices, stage

BATCH_BYTES = 1 << 22
#: Rows that are walked together, and rows of a group beyond which its interval is halved. A group of one place has at most
#: as many rows as there are letters, and one.
CHUNK_ROWS, GROUP_ROWS = 1 << 16, 1 << 14
#: Runs of letters in UTF-8 with A-Z lower-cased: a-z and U+00C0 to U+00FF, whose first byte is 0xC3.
_RUN = re.compile(rb"(?:[a-z]|\xc3[\x80-\xbf])+")


def misspelt(run: str, doc_id: int | None, every: int) -> str:
    """The run as it is, or without one code point, by the CRC-32 of id and run."""
    h = zlib.crc32(f"{'null' if doc_id is None else doc_id}:{run}".encode())
    return run if not every or h % every else run[: h % len(run)] + run[h % len(run) + 1 :]


def _count(batches, every: int, least: int):
    """(word, n) of each batch. Distinct runs of a text are counted before their CRC-32 is taken."""
    for part in slices(batches, 1, BATCH_BYTES):
        total: dict[bytes, int] = {}
        for doc_id, text in zip(part.column(0).to_pylist(), part.column(1).cast(pa.binary()).to_pylist()):
            own: dict[bytes, int] = {}
            for run in _RUN.findall((text or b"").lower()):  # bytes: only A-Z change
                own[run] = own.get(run, 0) + 1
            start = zlib.crc32(b"null:" if doc_id is None else b"%d:" % doc_id)
            for run, n in own.items():
                if every and zlib.crc32(run, start) % every == 0:
                    run = misspelt(run.decode(), doc_id, every).encode()
                total[run] = total.get(run, 0) + n
        words = [(w.decode(), n) for w, n in total.items() if len(w) >= least]
        words = [x for x in words if len(x[0]) >= least]
        if words:
            yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in words], pa.string()), pa.array([n for _, n in words], pa.int64())], names=["word", "n"])


def vocabulary(docs: DataFrame, *, misspell_every: int = 0, least_length: int = 5, least_count: int = 3, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(word, n): lower-cased runs of letters of all texts, of at least so many code points and occurrences.

    With misspell_every, a run whose CRC-32 with its document's id (null: the word null) is divisible by it loses one code point, so that
    variants are planted. Counts are summed by batch, then by task, before the shuffle.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    bound_batches(docs.sparkSession)
    counted = rows.transform(in_arrow, partial(_count, every=misspell_every, least=least_length), "word string, n long")
    return counted.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= least_count)


def _grouped(words: DataFrame) -> DataFrame:
    """(L, a, z, key, word, n): each word in the tries of its own length and the next one, with the first half and the second half of the places open."""
    each = words.withColumn("len", F.length("word")).withColumn("L", F.explode(F.expr("array(len, len + 1)")))
    each = each.withColumn("s", F.explode(F.expr("array(struct(cast(L div 2 as int) as a, 0 as z), struct(0 as a, L - cast(L div 2 as int) as z))")))
    return _keyed(each.select("L", "s.a", "s.z", "word", "n"))


def _keyed(rows: DataFrame) -> DataFrame:
    key = "concat_ws(' ', L, a, substring(word, 1, a), substring(word, length(word) - z + 1, z))"
    return rows.select("L", "a", "z", F.expr(key).alias("key"), "word", "n")


def _halved(rows: DataFrame) -> DataFrame:
    """The rows with the first half of their open places joined to the prefix, and with the second half joined to the suffix."""
    half = "cast((L - a - z) div 2 as int)"
    each = rows.withColumn("s", F.explode(F.expr(f"array(struct(a + {half} as a, z as z), struct(a as a, L - a - {half} as z))")))
    return _keyed(each.select("L", "s.a", "s.z", "word", "n"))


def _split(rows: DataFrame) -> DataFrame:
    """Rows whose groups have at most GROUP_ROWS rows, or one open place. Keys of larger groups, no more than all rows by GROUP_ROWS, are joined."""
    done = None
    while True:
        large = rows.where("L - a - z > 1").groupBy("key").agg(F.count(F.lit(1)).alias("rows")).where(F.col("rows") > GROUP_ROWS).select(F.col("key").alias("of"))
        large = stage(large, "large-groups")
        if large.isEmpty():
            return rows if done is None else done.unionByName(rows)
        fit = rows.join(large, F.col("key") == F.col("of"), "left_anti")
        done = fit if done is None else done.unionByName(fit)
        rows = stage(_halved(rows.join(large, F.col("key") == F.col("of"), "left_semi")), "halved-groups")


def _expand(count: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, place): for each row count places from first on."""
    total = np.cumsum(count)
    row = np.repeat(np.arange(len(count)), count)
    return row, np.arange(total[-1] if len(total) else 0) + np.repeat(first - total + count, count)


class _Level:
    """Children of the nodes of one depth: parent, letter and number of each, in order of both."""

    def __init__(self, node: np.ndarray, letters: np.ndarray, new: np.ndarray):
        rows = np.flatnonzero(new)
        letter = letters[rows]
        real = letter > 0  # 0: a shorter word has ended
        self.parent, self.letter, self.child = node[rows][real], letter[real].astype(np.int64), np.flatnonzero(real)
        self.count = np.bincount(self.parent, minlength=int(node[-1]) + 1)
        self.first = np.cumsum(self.count) - self.count
        self.key = self.parent * 256 + self.letter

    def find(self, node: np.ndarray, letter: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(whether node has a child of that letter, the child)."""
        if not len(self.key):
            return np.zeros(len(node), bool), np.zeros(len(node), np.int64)
        at = np.minimum(np.searchsorted(self.key, node * 256 + letter), len(self.key) - 1)
        return self.key[at] == node * 256 + letter, self.child[at]


def trie_pairs(group: np.ndarray, letters: np.ndarray, after: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group at distance one, of which at least one is as long as letters is wide, the other at most one shorter.

    letters has a row of bytes for each word, 0 after the end of a shorter one; rows ascend by group and letters and are distinct.
    after is the letter of the words that follows each row's, 0 at their end. A pair comes once: it arises at the end of the
    common prefix, where equal letters no longer follow.
    """
    n, m = letters.shape
    same = letters[1:] == letters[:-1]
    common = np.where(same.all(1), m, same.argmin(1))
    common[group[1:] != group[:-1]] = -1
    starts = [np.concatenate([[True], common < k]) for k in range(m + 1)]
    node = [np.cumsum(s) - 1 for s in starts]
    left = right = np.zeros(0, np.int64)  # two nodes of depth k: one replacement
    less = more = barred = np.zeros(0, np.int64)  # depth k and k + 1: one insertion; barred: the letter inserted last, 0 if another followed
    before = None
    for k in range(m):
        level = _Level(node[k], letters[:, k], starts[k + 1])
        # insertions: go down by equal letters, then those that arise here
        if before is not None:
            row, at = _expand(before.count[less], before.first[less])
            letter = before.letter[at]
            found, child = level.find(more[row], letter)
            found &= letter != barred[row]
            less, more, barred = before.child[at][found], child[found], np.zeros(int(found.sum()), np.int64)
        less, more, barred = np.concatenate([less, level.parent]), np.concatenate([more, level.child]), np.concatenate([barred, level.letter])
        # replacements likewise
        row, at = _expand(level.count[left], level.first[left])
        found, child = level.find(right[row], level.letter[at])
        rank = np.arange(len(level.parent)) - level.first[level.parent]
        later = level.count[level.parent] - 1 - rank
        one, other = _expand(later, np.arange(len(level.parent)) + 1)
        left, right = np.concatenate([level.child[at][found], level.child[one]]), np.concatenate([child[found], level.child[other]])
        before = level
    # nodes of depth m are rows; shorter words end at nodes of depth m - 1
    short = np.flatnonzero(letters[:, m - 1] == 0)
    ends = np.full(int(node[m - 1][-1]) + 1, -1)
    ends[node[m - 1][short]] = short
    whole = (ends[less] >= 0) & ((barred == 0) | (barred != after[ends[less]]))
    return np.concatenate([left, ends[less[whole]]]), np.concatenate([right, more[whole]])


def _walk(table: pa.Table):
    """(row, other) numbers of all pairs of a table of whole groups."""
    width = (table.column("L").to_numpy() - table.column("a").to_numpy() - table.column("z").to_numpy()).astype(np.int64)
    keys = table.column("key").combine_chunks()
    keys = keys.chunk(0) if isinstance(keys, pa.ChunkedArray) else keys
    group = np.cumsum(np.concatenate([[0], ~np.asarray(keys[1:].to_numpy(zero_copy_only=False) == keys[:-1].to_numpy(zero_copy_only=False))]))
    words = [w.encode("latin-1") for w in table.column("word").to_pylist()]
    a, z = table.column("a").to_pylist(), table.column("z").to_pylist()
    middle = [w[i : len(w) - j] for w, i, j in zip(words, a, z)]
    for m in np.unique(width).tolist():
        own = np.flatnonzero(width == m)
        padded = b"".join(middle[i].ljust(m, b"\0") for i in own.tolist())
        letters = np.frombuffer(padded, np.uint8).reshape(len(own), m)
        after = np.array([words[i][-z[i]] if z[i] else 0 for i in own.tolist()], np.int64)
        one, other = trie_pairs(group[own], letters, after)
        yield own[one], own[other]


def _chunks(batches):
    """Tables of whole groups of about CHUNK_ROWS rows, in rows' order."""
    held, rows = [], 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows >= CHUNK_ROWS:
            table = pa.Table.from_batches(held).combine_chunks()
            keys = table.column("key").to_pylist()
            at = next((i for i in range(len(keys) - 1, 0, -1) if keys[i] != keys[i - 1]), 0)
            if at:
                yield table.slice(0, at)
            held, rows = table.slice(at).to_batches(), table.num_rows - at
    if rows:
        yield pa.Table.from_batches(held).combine_chunks()


def _pairs(batches):
    for table in _chunks(batches):
        words = np.array(table.column("word").to_pylist(), object)
        for one, other in _walk(table):
            yield pa.RecordBatch.from_arrays([pa.array(words[one], pa.string()), pa.array(words[other], pa.string())], names=["word", "near"])


def _nearest(batches):
    """(word, n_near, near_n, near) of the chunk's pairs: how many, and the most frequent, the smallest of equals."""
    for table in _chunks(batches):
        words, n = np.array(table.column("word").to_pylist(), object), table.column("n").to_numpy()
        rank = np.empty(len(words), np.int64)
        rank[np.argsort(words, kind="stable")] = np.arange(len(words))
        for one, other in _walk(table):
            row, near = np.concatenate([one, other]), np.concatenate([other, one])
            if not len(row):
                continue
            order = np.lexsort((rank[near], -n[near], row))
            row, near = row[order], near[order]
            first = np.flatnonzero(np.diff(row, prepend=-1))
            counts = np.diff(np.append(first, len(row)))
            best = near[first]
            yield pa.RecordBatch.from_arrays([pa.array(words[row[first]], pa.string()), pa.array(counts.astype(np.int64)), pa.array(n[best].astype(np.int64)), pa.array(words[best], pa.string())], names=["word", "n_near", "near_n", "near"])


def _in_groups(words: DataFrame) -> DataFrame:
    """Rows of groups side by side, dealt by key; bytes of the Latin letters order as the trie does."""
    rows = _split(_grouped(words)).repartition("key")
    return rows.sortWithinPartitions("key", F.encode("word", "ISO-8859-1"))


def near_pairs(words: DataFrame) -> DataFrame:
    """(word, near): every pair of words(word, n) at distance one, once. Words are distinct, not empty and of U+0001 to U+00FF."""
    bound_batches(words.sparkSession)
    return _in_groups(words).transform(in_arrow, _pairs, "word string, near string")


def spelling_variants(words: DataFrame, *, factor: int = 2) -> DataFrame:
    """Per row of words(word, n), which are distinct: word, form, root, n, n_near, form_n.

    Near words differ by exactly one inserted, deleted or replaced code point; n_near counts them. form
    is the most frequent of them (the smallest in code-point order of equals), if it is at least
    factor times as frequent as the word, else null; root follows forms to the last. Each pair of near words is found
    in one group, and what leaves a chunk is a count and a best word for each word. Roots are found by
    doubling: each round replaces a word's target by the target's own, so rounds follow the
    logarithm of the longest chain. Null words or counts are not allowed; an empty table gives an empty result.
    """
    if factor < 2:
        raise ValueError("factor must be 2 or more, so that forms end")
    words = stage(words.select("word", "n"), "words")
    bound_batches(words.sparkSession)
    found = _in_groups(words).transform(in_arrow, _nearest, "word string, n_near long, near_n long, near string")
    best = found.groupBy("word").agg(F.sum("n_near").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("o"), "near")).alias("b"))
    best = best.select(F.col("word").alias("of"), "n_near", F.col("b.near").alias("near"), (-F.col("b.o")).alias("near_n"))
    known = words.join(best, F.col("word") == F.col("of"), "left")
    good = F.col("near_n") >= factor * F.col("n")
    known = stage(known.select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(good, F.col("near")).alias("form"), F.when(good, F.col("near_n")).alias("form_n")), "forms")
    roots = known.where("form is not null").select("word", F.col("form").alias("root"))
    while True:
        roots = stage(roots, "roots")
        step = roots.select(F.col("word").alias("at"), F.col("root").alias("next"))
        jumped = roots.join(step, F.col("root") == F.col("at"), "left")
        if jumped.where("next is not null").isEmpty():
            break
        roots = jumped.select("word", F.coalesce("next", "root").alias("root"))
    roots = roots.withColumnRenamed("word", "of")
    out = known.join(roots, F.col("word") == F.col("of"), "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def document_variants(docs: DataFrame, *, misspell_every: int = 0, least_length: int = 5, least_count: int = 3, factor: int = 2, **columns: str) -> DataFrame:
    """spelling_variants of the vocabulary of docs. A null text has no words; a null id counts as the word null where runs are misspelt;
    repeated rows count as often as they are there; other columns of docs, whatever their names, are not read; texts and words of any length are read whole."""
    return spelling_variants(vocabulary(docs, misspell_every=misspell_every, least_length=least_length, least_count=least_count, **columns), factor=factor)

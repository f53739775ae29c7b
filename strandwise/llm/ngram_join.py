"""Operator 8: Jaccard self-join of shingle sets by token-combination prefixes, as components of linked documents.

Tokens (hashed shingles) have a global order, rare ones first, from a fixed-size sketch of their
frequencies. A set's prefix is extended until so many tokens would have to be missing from a
partner to leave no signature in common that the partner could not be similar enough. Signatures
are single tokens for the rare class, and pairs or triples for frequent classes, within parts that
a hash deals tokens to. Documents that share a signature are candidates, and are verified.
"""

from __future__ import annotations

import hashlib
import itertools
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import by_bytes, in_arrow, row_key, rows_with, stage
from .components import connected_components

#: A counter for about so many tokens, so that counters tell frequent tokens from chance at any size; the fewest and
#: the most bits of a token that select its counter (a byte for each goes to all workers: 16 MB); counters of a segment.
TOKENS, LEAST_BITS, MOST_BITS, SEGMENT = 32, 16, 24, 1 << 15
#: Levels of a counter are 12 * log2(1 + count / mean); from these levels on, tokens count as frequent and very frequent.
PAIRS, TRIPLES = 30, 72
#: Sets up to this size use single tokens only.
SINGLES = 48
#: Bits of the parity bitmap that bounds the symmetric difference of two sets.
BITMAP_BITS = 1024
#: Members of a bucket that are compared at a time.
BLOCK = 1024
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads their bits."""
    x = (x ^ (x >> np.uint64(30))) * _B
    x = (x ^ (x >> np.uint64(27))) * _C
    return x ^ (x >> np.uint64(31))


#: Bytes hashed at a time; longer words than LONG_WORD are hashed one by one.
PIECE, LONG_WORD = 1 << 20, 256
_BASE = 0xD6E8FEB86659FD93
_rng = np.random.default_rng(20240301)
_VALUE = _rng.integers(1, 2**63, 256).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_IS_SPACE = np.isin(np.arange(256), list(b" \t\n\x0b\x0c\r"))


def _powers(base: int) -> np.ndarray:
    out = np.full(PIECE, base, np.uint64)
    out[0] = 1
    return np.multiply.accumulate(out)


_UP, _DOWN = _powers(_BASE), _powers(pow(_BASE, -1, 2**64))


def word_hashes(text: bytes) -> np.ndarray:
    """64-bit hashes of the words of a text in lower case, split at ASCII white space.

    A word's hash is the difference of two prefix polynomial hashes modulo 2**64, shifted to the
    word's start; words too long for that to tell apart well are hashed one by one.
    """
    import xxhash

    out, at = [], 0
    while at < len(text):
        piece = text[at : at + PIECE]
        if at + PIECE < len(text) and not _IS_SPACE[text[at + PIECE]]:
            spaces = np.flatnonzero(_IS_SPACE[np.frombuffer(piece, np.uint8)])
            if not len(spaces):  # one word fills the piece
                word = text[at:].split(None, 1)[0]
                out.append(np.array([xxhash.xxh3_64_intdigest(word)], np.uint64))
                at += len(word)
                continue
            piece = piece[: spaces[-1] + 1]
        at += len(piece)
        b = np.frombuffer(piece, np.uint8)
        edges = np.flatnonzero(np.diff(np.concatenate([[True], _IS_SPACE[b], [True]])))
        starts, ends = edges[::2], edges[1::2]
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum(_VALUE[b] * _UP[: len(b)], out=sums[1:])
        h = mix((sums[ends] - sums[starts]) * _DOWN[np.minimum(starts, PIECE - 1)] + (ends - starts).astype(np.uint64))
        for k in np.flatnonzero(ends - starts > LONG_WORD).tolist():
            h[k] = xxhash.xxh3_64_intdigest(piece[starts[k] : ends[k]])
        out.append(h)
    return np.concatenate(out) if out else np.zeros(0, np.uint64)


def shingle_set(text: bytes, size: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text: A-Z lower-cased, words split at ASCII white space.

    With fewer words than size, the whole sequence is one shingle; without words there is none.
    """
    h = word_hashes(text.lower())
    if not len(h):
        return h
    n = min(size, len(h))
    out = np.zeros(len(h) - n + 1, np.uint64) + np.uint64(n)
    with np.errstate(over="ignore"):
        for k in range(n):
            out = mix(out * _A + h[k : len(h) - n + 1 + k])
    return np.unique(out)


def needed(n: int, num: int, den: int) -> int:
    """The least overlap that a set of n tokens has with a linked one, at similarity num / den."""
    return -(-num * n // den)


def bands(n: int, num: int, den: int) -> list[tuple[int, int]]:
    """(index, smallest size) of the band of n and of the one below. A set linked with it shares one of the two."""
    found, lo = [(0, 1)], 1
    while (lo := lo * den // num + 1) <= n:
        found = [*found[-1:], (found[-1][0] + 1, lo)]
    return found


def signatures(tokens: np.ndarray, levels: np.ndarray, num: int, den: int) -> np.ndarray:
    """Signatures of one set; linked sets share at least one."""
    n = len(tokens)
    level = levels[(tokens >> np.uint64(65 - len(levels).bit_length())).astype(np.int64)]
    order = np.lexsort((tokens, level))
    budget = n - needed(n, num, den) + 1
    first = order[:budget]
    if n <= SINGLES or level[first[-1]] < PAIRS:
        return tokens[first]  # the schemes of both bands give these
    out = set()
    for band, size in bands(n, num, den):
        out.update(tokens[first].tolist() if size <= SINGLES else _combinations(tokens, level, order, budget, band, size, num, den))
    return np.array(sorted(out), np.uint64)


def _combinations(tokens, level, order, budget, band, size, num, den):
    """The signatures of the scheme of one band: size, its smallest set, fixes the number of parts."""
    parts = max(1, min(size * (den - num) // den, (num * size // den - 1) // 3))
    cells: dict[tuple[int, int], list[int]] = {}
    cost = 0
    for at in order.tolist():
        if cost >= budget:
            break
        t = int(tokens[at])
        k = 1 if level[at] < PAIRS else 2 if level[at] < TRIPLES else 3
        if k == 1:
            yield t
            cost += 1
            continue
        cell = cells.setdefault((k, (t >> 8) % parts), [])
        cell.append(t)
        cost += len(cell) >= k
    for (k, _), cell in cells.items():
        for combination in itertools.combinations(cell, k):
            yield int.from_bytes(hashlib.blake2b(np.array([band, *combination], np.uint64).tobytes(), digest_size=8).digest(), "little")


def bitmap(tokens: np.ndarray) -> bytes:
    """Parities of token counts by hash: two bitmaps differ in at most as many bits as the sets differ in tokens."""
    odd = np.bincount((tokens & np.uint64(BITMAP_BITS - 1)).astype(np.int64), minlength=BITMAP_BITS) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


_FEATURES = "doc_id long, rk long, node long, proof long, n int, bits binary, segment int, counts binary"


def sketch_bits(docs: DataFrame) -> int:
    """About TOKENS tokens a counter, at six characters a word; beyond MOST_BITS only the order of tokens gets coarser."""
    chars = docs.agg(F.sum(F.length("text"))).first()[0] or 0
    return min(MOST_BITS, max(LEAST_BITS, round(np.log2(1 + chars / 6 / TOKENS))))


def _features(batches, size: int, seed: int, bits: int):
    import zstandard

    names = ["doc_id", "rk", "node", "proof", "n", "bits", "segment", "counts"]
    kinds = [pa.int64()] * 4 + [pa.int32(), pa.binary(), pa.int32(), pa.binary()]
    counts = np.zeros(1 << bits, np.uint32)

    def table(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=names)

    for batch in batches:
        out = []
        for i, rk, text in zip(*(c.to_pylist() for c in batch.columns)):
            tokens = shingle_set((text or "").encode(), size)
            node = proof = None
            if len(tokens):
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
                node, proof = np.frombuffer(digest, "<i8").tolist()
                np.add.at(counts, (tokens >> np.uint64(64 - bits)).astype(np.int64), 1)
            out.append((i, rk, node, proof, len(tokens), bitmap(tokens), None, None))
        if out:
            yield table(out)
    z = zstandard.ZstdCompressor(level=1)
    for s in range(0, len(counts), SEGMENT):
        if counts[s : s + SEGMENT].any():
            yield table([(None, None, None, None, -1, None, s // SEGMENT, z.compress(counts[s : s + SEGMENT].tobytes()))])


def _add(batches):
    """Sums of the counters of each segment; segments arrive sorted."""
    import zstandard

    unpack, pack = zstandard.ZstdDecompressor().decompress, zstandard.ZstdCompressor(level=1).compress
    at, total = None, None

    def row():
        return pa.RecordBatch.from_arrays([pa.array([at], pa.int32()), pa.array([pack(total.tobytes())], pa.binary())], names=["segment", "counts"])

    for batch in batches:
        for segment, data in zip(*(c.to_pylist() for c in batch.columns)):
            counts = np.frombuffer(unpack(data, max_output_size=4 * SEGMENT), np.uint32).astype(np.uint64)
            if segment == at:
                total += counts
            else:
                if at is not None:
                    yield row()
                at, total = segment, counts
    if at is not None:
        yield row()


def token_levels(features: DataFrame, bits: int) -> np.ndarray:
    """One byte per counter: how frequent its tokens are, relative to the mean counter."""
    import zstandard

    parts = features.where("n < 0").select("segment", "counts").repartition(min(64, (1 << bits) // SEGMENT), "segment").sortWithinPartitions("segment")
    counts = np.zeros(1 << bits, np.float32)
    for segment, data in parts.transform(in_arrow, _add, "segment int, counts binary").toLocalIterator():
        counts[segment * SEGMENT : (segment + 1) * SEGMENT] = np.frombuffer(zstandard.ZstdDecompressor().decompress(data, max_output_size=8 * SEGMENT), np.uint64)
    return np.minimum(255, 12 * np.log2(1 + counts / (counts.mean() + 1))).astype(np.uint8)


def _sign(batches, size: int, num: int, den: int, shared, seed: int):
    levels = shared.value
    for batch in batches:
        nodes, found = [], []
        for text in batch.column(0).to_pylist():
            tokens = shingle_set((text or "").encode(), size)
            if len(tokens):
                digest = hashlib.blake2b(tokens.tobytes(), digest_size=16, salt=seed.to_bytes(8, "little")).digest()
                own = signatures(tokens, levels, num, den)
                found.append(own)
                nodes.append(np.full(len(own), np.frombuffer(digest, "<i8")[0]))
        if found:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(found).view(np.int64)), pa.array(np.concatenate(nodes))], names=["sig", "node"])


def _zip(batches):
    import zstandard

    pack = zstandard.ZstdCompressor(level=3).compress
    for batch in batches:
        yield pa.RecordBatch.from_arrays([batch.column("rk"), pa.array([pack((t or "").encode()) for t in batch.column("text").to_pylist()], pa.binary())], names=["rk", "text"])


def _verify(batches, size: int, num: int, den: int):
    """Pairs arrive sorted by a, so the set of a is made once for its run. Texts are compressed."""
    import zstandard

    inflate = zstandard.ZstdDecompressor().decompress
    last, own = None, None
    for batch in batches:
        linked = []
        for a, b, text_a, text_b in zip(*(c.to_pylist() for c in batch.columns)):
            if a != last:
                last, own = a, shingle_set(inflate(text_a), size)
            other = shingle_set(inflate(text_b), size)
            common = len(np.intersect1d(own, other, assume_unique=True))
            linked.append(den * common >= num * (len(own) + len(other) - common))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(linked, pa.bool_())], names=["a", "b", "linked"])


def _cross(batches, num: int, den: int, forest: bool):
    """Possible links between members of a block pair (sig, i, j) that have different labels, by exact bounds.

    Rows arrive sorted by (sig, i, j). With forest, a link that would close a cycle in the block
    pair is left out: if the others hold, it adds nothing; if not, the next round has it again.
    """
    def pairs(rows):
        nodes = np.array([r[0] for r in rows], np.int64)
        labels, label_of = np.unique(np.array([r[1] for r in rows], np.int64), return_inverse=True)
        n = np.array([r[2] for r in rows], np.int64)
        bits = np.frombuffer(b"".join(r[3] for r in rows), np.uint64).reshape(len(rows), -1)
        parent = list(range(len(labels)))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for x in range(len(rows) - 1):
            rest = slice(x + 1, None)
            total = n[rest] + n[x]
            # |A ^ B| <= (1 - t) / (1 + t) * (|A| + |B|) for a link, and bitmaps differ in no more bits
            may = (label_of[rest] != label_of[x]) & (np.bitwise_count(bits[rest] ^ bits[x]).sum(1, dtype=np.int64) * (den + num) <= (den - num) * total)
            may &= (np.minimum(n[rest], n[x]) * den >= num * np.maximum(n[rest], n[x])) & (nodes[rest] != nodes[x])
            for y in (np.flatnonzero(may) + x + 1).tolist():
                if forest:
                    a, b = root(label_of[x]), root(label_of[y])
                    if a == b:
                        continue
                    parent[a] = b
                yield int(min(nodes[x], nodes[y])), int(max(nodes[x], nodes[y]))

    def groups():
        at, rows = None, []
        for batch in batches:
            for sig, i, j, node, label, n, bits in zip(*(c.to_pylist() for c in batch.columns)):
                if (sig, i, j) != at:
                    if rows:
                        yield rows
                    at, rows = (sig, i, j), []
                rows.append((node, label, n, bits))
        if rows:
            yield rows

    for found in by_bytes((p for g in groups() for p in pairs(g)), lambda _: 1, 1 << 14):
        a, b = zip(*found)
        yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])


def _cross_pairs(members: DataFrame, labels: DataFrame, sets: DataFrame, num: int, den: int, forest: bool) -> tuple[DataFrame, DataFrame]:
    """(candidates across labels within buckets that still hold more than one label, the members of such buckets).

    Large buckets are met in pairs of blocks. A bucket that holds one label will never hold more.
    """
    n = members.count()  # bounds the tables that follow
    named = stage(members.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("sig", "node", F.coalesce("label", "node").alias("label")), "named", n)
    open_ = named.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi"), F.count(F.lit(1)).alias("size")).where("lo <> hi")
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    open_ = stage(open_.select(F.col("sig").alias("open_sig"), blocks.alias("blocks")), "open", n)
    rows = stage(named.join(open_, F.col("sig") == F.col("open_sig")).drop("open_sig"), "open-members", n)
    own = F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int")
    pairs = rows.withColumn("own", own).withColumn("other", F.explode(F.expr("sequence(0, blocks - 1)")))
    pairs = pairs.select("sig", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "node", "label")
    pairs = pairs.join(sets.select(F.col("node").alias("of"), "n", "bits"), F.col("node") == F.col("of")).drop("of")
    dealt = pairs.repartition("sig", "i", "j").sortWithinPartitions("sig", "i", "j", "node")
    return dealt.transform(in_arrow, partial(_cross, num=num, den=den, forest=forest), "a long, b long").distinct(), rows.select("sig", "node")


def linked_documents(docs: DataFrame, *, shingle: int = 3, similarity: tuple[int, int] = (9, 10), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, rk (row key), n_shingles, component_id (the smallest doc_id reachable by links, its own included).

    Two documents link if the Jaccard similarity of their shingle sets is at least similarity
    (a fraction of two integers). Null and empty texts have no shingles and link with nothing, not
    even each other; equal sets link; a null id takes part and is never the smallest, so a
    component of null ids alone has a null id; repeated rows are documents of one set; an empty
    table gives an empty result; a text of any length gives all its shingles; other columns of docs,
    whatever their names, are not read.

    Equal sets are one node from the start. Nodes are named by 64 bits of their set's hash; another
    64 prove that no two sets share a name, and if two do, names are drawn anew. Links are found in
    three rounds, each of which emits no more than it must: every node against one node it shares
    a signature with; then, within buckets that still hold several components, a spanning forest
    of what exact bounds leave possible; then all that is still possible. So no link between
    components is lost, and no group's pairs are listed once its members are known to be connected.
    """
    num, den = similarity
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).withColumn("rk", row_key("doc_id", "text"))
    seed, bits = 0, sketch_bits(rows)
    while True:
        features = stage(rows.select("doc_id", "rk", "text").transform(in_arrow, partial(_features, size=shingle, seed=seed, bits=bits), _FEATURES), "features")
        present = features.where("node is not null")
        nodes = stage(
            present.groupBy("node").agg(F.min("doc_id").alias("first_id"), F.min("rk").alias("rk"), F.min("proof").alias("lo"), F.max("proof").alias("hi"), F.first("n").alias("n"), F.first("bits").alias("bits")),
            "nodes",
        )
        if not nodes.where("lo <> hi").limit(1).count():
            break
        seed += 1
    shared = docs.sparkSession.sparkContext.broadcast(token_levels(features, bits))
    signed = stage(rows.select("text").transform(in_arrow, partial(_sign, size=shingle, num=num, den=den, shared=shared, seed=seed), "sig long, node long"), "signatures")
    # staged, so that Spark can split the other side of the join where a signature is hot
    buckets = stage(signed.groupBy("sig").agg(F.min("node").alias("lo"), F.max("node").alias("hi")).where("lo <> hi").select(F.col("sig").alias("of"), "lo"), "buckets")
    members = stage(signed.join(buckets, F.col("sig") == F.col("of")).select("sig", "node", "lo").distinct(), "members")

    wanted = members.select("node").distinct().join(nodes.select(F.col("node").alias("of"), F.col("rk").alias("of_rk")), F.col("node") == F.col("of")).select("node", "of_rk")
    wanted = stage(wanted, "wanted")
    some, _ = rows_with(rows.select("rk", "text"), wanted.select(F.col("of_rk").alias("rk")), _zip, "rk long, text binary")
    # rows that repeat share a row key: one text stays for each node
    texts = some.join(wanted, F.col("rk") == F.col("of_rk")).dropDuplicates(["rk"]).select("node", "text")
    texts = stage(texts, "texts")

    def verified(pairs: DataFrame) -> DataFrame:
        a = texts.select(F.col("node").alias("node_a"), F.col("text").alias("text_a"))
        b = texts.select(F.col("node").alias("node_b"), F.col("text").alias("text_b"))
        both = pairs.join(b, F.col("b") == F.col("node_b")).select("a", "b", "text_b").join(a, F.col("a") == F.col("node_a")).select("a", "b", "text_a", "text_b")
        return stage(both.sortWithinPartitions("a").transform(in_arrow, partial(_verify, size=shingle, num=num, den=den), "a long, b long, linked boolean"), "verified").where("linked").select("a", "b")

    first = members.where("node <> lo").groupBy(F.col("node").alias("b")).agg(F.min("lo").alias("a"))
    edges = verified(first.select("a", "b"))
    labels = connected_components(edges)
    members = members.select("sig", "node")
    for forest in (True, False):
        pairs, members = _cross_pairs(members, labels, nodes, num, den, forest)
        edges = edges.union(verified(pairs))
        labels = connected_components(edges)

    named = nodes.join(labels.withColumnRenamed("node", "of"), F.col("node") == F.col("of"), "left").select("node", "first_id", F.coalesce("label", "node").alias("label"))
    smallest = named.groupBy("label").agg(F.min("first_id").alias("component_id")).withColumnRenamed("label", "of")
    classes = stage(named.join(smallest, F.col("label") == F.col("of")).select(F.col("node").alias("of"), "component_id"), "classes")
    out = features.where("n >= 0").join(classes, F.col("node") == F.col("of"), "left")
    own = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return out.select("doc_id", "rk", F.col("n").cast("long").alias("n_shingles"), own.alias("component_id"), F.when(F.col("n") == 0, F.xxhash64("rk", F.lit(1))).otherwise(F.col("node")).alias("node"))


def one_of_each(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", **join) -> DataFrame:
    """The rows of docs without all but one document of each component: the smallest id stays. Rows without shingles stay.

    Of a component of null ids alone one row stays, as does one of rows that repeat the smallest id and its text. All
    columns of docs, whatever their names, are in the result; an empty table gives an empty one; texts of any length are read whole.
    """
    linked = linked_documents(docs, id_col=id_col, text_col=text_col, **join)
    group = F.coalesce("component_id", F.col("node"))
    keep = linked.where("n_shingles > 0").groupBy(group.alias("g"), F.col("component_id").isNull()).agg(F.min_by("rk", F.struct(F.col("doc_id").isNull(), "doc_id", "rk")).alias("of"), F.lit(True).alias("single"))
    keep = keep.select("of", "single").union(linked.where("n_shingles = 0").select(F.col("rk").alias("of"), F.lit(False)).distinct())
    names = docs.columns
    renamed = docs.select([F.col(f"`{c}`").alias(f"_in_{n}") for n, c in enumerate(names)])
    ident, text = (F.col(f"_in_{names.index(c)}") for c in (id_col, text_col))
    renamed = renamed.withColumn("_rk", row_key(ident.cast("long"), text))
    joined = renamed.join(keep, F.col("_rk") == F.col("of"))
    single = joined.where("single").dropDuplicates(["_rk"])
    return single.unionByName(joined.where(~F.col("single"))).select([F.col(f"_in_{n}").alias(c) for n, c in enumerate(names)])


def oracle_sql(shingle: int = 3, similarity: tuple[int, int] = (9, 10)) -> str:
    """DuckDB; for ids that are neither null nor repeated. It meets all pairs of different sets with a shingle in common."""
    num, den = similarity
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    words = ", ".join(["w", *(f"lead(w, {n}) OVER o" for n in range(1, shingle))])  # what the text lacks is null and left out
    return f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{lower}'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, unnest(w) AS w, generate_subscripts(w, 1) AS i, len(w) AS n FROM w),
q AS (SELECT doc_id, i, n, concat_ws(' ', {words}) AS token FROM p WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
s AS (SELECT doc_id, list(DISTINCT token ORDER BY token) AS s FROM q WHERE i <= greatest(1, n - {shingle - 1}) GROUP BY doc_id),
m AS (SELECT doc_id, coalesce(len(s), 0)::BIGINT AS n, CASE WHEN s IS NULL THEN doc_id ELSE min(doc_id) OVER (PARTITION BY s) END AS rep, s FROM w LEFT JOIN s USING (doc_id)),
x AS (SELECT rep, n, unnest(s) AS token FROM m WHERE doc_id = rep),
l AS (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.token = b.token AND a.rep < b.rep AND {den} * least(a.n, b.n) >= {num} * greatest(a.n, b.n)
      GROUP BY a.rep, b.rep, a.n, b.n HAVING {den} * count(*) >= {num} * (a.n + b.n - count(*))),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
c AS (SELECT DISTINCT a AS rep, a AS met FROM e UNION SELECT c.rep, e.b FROM c JOIN e ON e.a = c.met),
f AS (SELECT rep, min(met) AS component_id FROM c GROUP BY rep)
SELECT doc_id, n AS n_shingles, coalesce(component_id, rep) AS component_id FROM m LEFT JOIN f USING (rep)"""

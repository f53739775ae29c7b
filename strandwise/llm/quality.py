"""Operator 7: quality rules with the frequency of lines across a host's documents."""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import in_arrow, row_key, stage

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: What str.split() takes for white space besides \x20 and \x09-\x0D.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
SYMBOLS = "#*$%&|<>"
LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)} | {c: "0" for c in range(ord("1"), ord("9") + 1)}
#: A line is frequent on a host beyond both: so many distinct documents, such a share of the host's distinct documents.
MIN_DOCUMENTS, SHARE = 20, 0.01
#: Documents need so many words; repeated 3-word windows may cover such a part of them; frequent lines must leave such a part.
MIN_WORDS, MOST_REPEATED, LEAST_LEFT = 50, 0.50, 0.30


def words_of(text: str) -> list[str]:
    return WORD.findall(text) if _ODD.search(text) else text.split()


def repeated_words(words: list[str]) -> int:
    """Words that lie in a 3-word window found twice or more."""
    windows = list(zip(words, words[1:], words[2:]))
    seen, twice = set(), set()
    if len(set(windows)) == len(windows):
        return 0
    for w in windows:
        (twice if w in seen else seen).add(w)
    covered, end = 0, 0
    for i, w in enumerate(windows):
        if w in twice:
            covered += i + 3 - max(i, end)
            end = i + 3
    return covered


def normal_line(line: str) -> str:
    """Words joined by single spaces, A-Z lower-cased, digits as 0."""
    return " ".join(words_of(line)).translate(LOWER)


def line_hash(line: str) -> int:
    import xxhash

    return xxhash.xxh3_64_intdigest(line) - 2**63


_LINES = pa.list_(pa.struct([("hash", pa.int64()), ("words", pa.int64())]))
_BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def _measure(batches):
    names = ["doc_id", "rk", "host", "same", *_BASE, "lines"]
    for batch in batches:
        out = []
        for i, rk, host, text, same in zip(*(c.to_pylist() for c in batch.columns)):
            text = text or ""
            words, seen, repeats, lines = words_of(text), set(), 0, {}
            for line in text.split("\n"):
                if normal := normal_line(line):
                    repeats += line in seen
                    seen.add(line)
                    h = line_hash(normal)
                    lines[h] = lines.get(h, 0) + normal.count(" ") + 1
            out.append((i, rk, host, same, len(words), sum(map(len, words)), sum(map(text.count, SYMBOLS)), repeats, repeated_words(words), [{"hash": h, "words": n} for h, n in lines.items()]))
        if out:
            kinds = [pa.int64(), pa.int64(), pa.string(), *[pa.int64()] * 6, _LINES]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=names)


def judged_documents(docs: DataFrame, *, count_copies: bool = False, min_documents: int = MIN_DOCUMENTS, share: float = SHARE, least_left: float = LEAST_LEFT, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source") -> DataFrame:
    """Per row of docs: doc_id, rk (row key), the base features, base_failed, left_words, removed (line hashes), kept.

    A host's documents are its distinct texts, so copies of one document don't make its lines
    frequent; with count_copies they are its rows. A line that more than min_documents of them hold, and more than share of them, is
    removed from all; a document that keeps less than least_left of its words is rejected, as is
    one that fails the base rules. A null text is empty: it has no words and fails, and is
    one document of its host with the empty ones; a null host is a host;
    repeated rows get equal results; an empty table gives an empty result; other columns of docs,
    whatever their names, are not read; a text of any length is measured whole, a row at a time.

    Texts are read once and not shuffled: what moves is the 64-bit hash of each distinct line of a
    document, summed by host and hash before the shuffle. Frequent lines meet documents in a join
    whose skewed partitions Spark splits.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(host_col).alias("host"), F.col(text_col).alias("text"))
    rows = rows.select("doc_id", row_key("doc_id", "text").alias("rk"), "host", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"))
    base = ", ".join(f"{c} long" for c in _BASE)
    measured = rows.transform(in_arrow, _measure, f"doc_id long, rk long, host string, same long, {base}, lines array<struct<hash: long, words: long>>")
    measured = stage(measured, "features")
    once = measured if count_copies else measured.groupBy("host", "same").agg(F.first("lines").alias("lines"))
    hosts = once.groupBy("host").agg(F.count(F.lit(1)).alias("documents")).withColumnRenamed("host", "of")
    counts = once.select("host", F.explode("lines.hash").alias("hash")).groupBy("host", "hash").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > min_documents)
    frequent = counts.join(hosts, F.col("host").eqNullSafe(F.col("of"))).where(F.col("n") > F.col("documents") * F.lit(share))
    # staged, so that Spark can split the other side of the join where a line is hot
    frequent = stage(frequent.select(F.col("host").alias("of"), F.col("hash").alias("line")), "frequent")
    held = measured.select("doc_id", "rk", "host", F.explode("lines").alias("l")).select("doc_id", "rk", "host", "l.hash", "l.words")
    removed = held.join(frequent, (F.col("hash") == F.col("line")) & F.col("host").eqNullSafe(F.col("of")))
    # repeated rows share a row key, so a line's words are counted once by max
    removed = removed.groupBy("doc_id", "rk", "hash").agg(F.max("words").alias("words"))
    removed = removed.groupBy("doc_id", "rk").agg(F.sum("words").alias("gone"), F.collect_list("hash").alias("removed"))
    removed = removed.withColumnRenamed("doc_id", "of").withColumnRenamed("rk", "of_rk")
    joined = measured.drop("lines", "same").join(removed, (F.col("rk") == F.col("of_rk")) & F.col("doc_id").eqNullSafe(F.col("of")), "left")
    failed = (F.col("n_words") < MIN_WORDS) | (F.col("n_repeat_words") * 100 > F.col("n_words") * round(100 * MOST_REPEATED))
    left = F.col("n_words") - F.coalesce("gone", F.lit(0))
    kept = ~failed & (left * 100 >= F.col("n_words") * round(100 * least_left))
    return joined.select("doc_id", "rk", *_BASE, failed.alias("base_failed"), left.alias("left_words"), "removed", kept.alias("kept"))


def _clean(batches):
    for batch in batches:
        texts = []
        for text, removed in zip(batch.column("_text").to_pylist(), batch.column("removed").to_pylist()):
            gone = set(removed or ())
            texts.append("\n".join(x for x in text.split("\n") if not (n := normal_line(x)) or line_hash(n) not in gone) if gone else text)
        names = [n for n in batch.schema.names if n not in ("_text", "removed")]
        yield pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), pa.array(texts, pa.string())], names=[*names, "_text"])


def cleaned_documents(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", keep: tuple[str, ...] = (), **rules) -> DataFrame:
    """The rows that judged_documents keeps, without their frequent lines: doc_id, the columns in keep, text.

    Names in keep must not be doc_id or text; any other may be there, kept or not.
    """
    if clash := set(keep) & {"doc_id", "text"}:
        raise ValueError(f"keep names columns of the result: {', '.join(sorted(clash))}")
    judged = judged_documents(docs, id_col=id_col, text_col=text_col, **rules).where("kept")
    # repeated rows share a key and a verdict
    judged = judged.groupBy(F.col("doc_id").alias("of"), F.col("rk").alias("of_rk")).agg(F.first("removed").alias("removed"))
    kept = [F.col(f"`{c}`").alias(f"_keep_{n}") for n, c in enumerate(keep)]
    rows = docs.select(F.col(id_col).cast("long").alias("_id"), *kept, F.col(text_col).alias("_text")).withColumn("_rk", row_key("_id", "_text"))
    joined = rows.join(judged, (F.col("_rk") == F.col("of_rk")) & F.col("_id").eqNullSafe(F.col("of"))).drop("_rk", "of", "of_rk")
    types = {f.name: f.dataType.simpleString() for f in rows.schema}
    names = ["_id", *(f"_keep_{n}" for n in range(len(keep)))]
    out = joined.select(*names, "_text", "removed").transform(in_arrow, _clean, ", ".join(f"{c} {types[c]}" for c in (*names, "_text")))
    return out.select(F.col("_id").alias("doc_id"), *(F.col(f"_keep_{n}").alias(c) for n, c in enumerate(keep)), F.col("_text").alias("text"))


def oracle_sql(min_documents: int = MIN_DOCUMENTS, share: float = SHARE) -> str:
    """DuckDB; for ids that are not null and not repeated."""
    word = "[^\\x20\\x09-\\x0D]+"
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789", "abcdefghijklmnopqrstuvwxyz000000000"
    return f"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{word}') AS w FROM documents),
x AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM d),
g AS (SELECT doc_id, i, word || ' ' || lead(word) OVER q || ' ' || lead(word, 2) OVER q AS g FROM x WINDOW q AS (PARTITION BY doc_id ORDER BY i)),
t AS (SELECT doc_id, i, g IS NOT NULL AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS twice FROM g),
r AS (SELECT doc_id, bool_or(twice) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS covered FROM t),
rw AS (SELECT doc_id, count(*) FILTER (covered) AS n FROM r GROUP BY doc_id),
s AS (SELECT doc_id, source, md5(text) AS same, unnest(string_split(text, chr(10))) AS line FROM d),
l AS (SELECT *, regexp_extract_all(line, '{word}') AS w FROM s WHERE len(regexp_extract_all(line, '{word}')) > 0),
n AS (SELECT doc_id, source, same, line, len(w) AS words, translate(array_to_string(w, ' '), '{upper}', '{lower}') AS key FROM l),
dl AS (SELECT doc_id, count(*) - count(DISTINCT line) AS n FROM n GROUP BY doc_id),
h AS (SELECT source, count(DISTINCT md5(text)) AS documents FROM d GROUP BY source),
f AS (SELECT source, key FROM n JOIN h USING (source) GROUP BY source, key
      HAVING count(DISTINCT same) > {min_documents} AND count(DISTINCT same) > any_value(documents) * {share}::DOUBLE),
gone AS (SELECT doc_id, sum(words) AS n FROM n JOIN f USING (source, key) GROUP BY doc_id),
b AS (SELECT d.doc_id, len(d.w)::BIGINT AS n_words, length(array_to_string(d.w, ''))::BIGINT AS word_chars,
        len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(dl.n, 0)::BIGINT AS n_dup_lines,
        coalesce(rw.n, 0)::BIGINT AS n_repeat_words, (len(d.w) - coalesce(gone.n, 0))::BIGINT AS left_words
      FROM d LEFT JOIN rw USING (doc_id) LEFT JOIN dl USING (doc_id) LEFT JOIN gone USING (doc_id))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {round(100 * MOST_REPEATED)} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {round(100 * MOST_REPEATED)} * n_words) AND 100 * left_words >= {round(100 * LEAST_LEFT)} * n_words AS kept
FROM b"""

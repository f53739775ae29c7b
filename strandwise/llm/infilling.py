"""Operator 13: fill-in-the-middle transformation, as one numpy kernel over the UTF-8 buffers of a batch."""

from __future__ import annotations

from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bound_batches, in_arrow, slices

BATCH_BYTES = 1 << 22
#: Prefix, suffix and middle begin with these.
SENTINELS = ("<P>", "<S>", "<M>")
_SPACE = np.zeros(256, bool)
_SPACE[[*range(9, 14), 32]] = True

_ROW = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def fill_in_middle(docs: DataFrame, *, seed: int = 42, rate: int = 50, spm_rate: int = 80, sentinels: tuple[str, str, str] = SENTINELS, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n, form, prefix_chars, middle_chars, output.

    A text is n units: white space with the word after it, and white space that ends the text. Two
    cuts between units make prefix, middle and suffix; form says how they stand in the output: psm
    (prefix, suffix, middle), spm (suffix, prefix, middle), each after its sentinel, or plain (the text as it is;
    the counts of code points are null then). rate per cent of the texts are transformed, spm_rate per cent of those as spm. Choices come from the
    SHA-256 of seed and id, so reruns agree and repeated rows get equal results; a null id draws as
    the word null. A null text is empty, and an empty text, or one that holds a sentinel, is plain. An
    empty table gives an empty result; other columns of docs, whatever their names, are not read. A text of
    any length is cut whole, with some 12 bytes of memory for each of its own. A map without a shuffle.
    """
    if len(set(sentinels)) < 3 or not all(sentinels) or any(a in b for a in sentinels for b in sentinels if a != b):
        raise ValueError("sentinels must be three texts, none within another")
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("long").cast("string"), F.lit("null"))), 256)
    draws = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("long").alias(f"h{i + 1}") for i in range(4)]
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), *draws)
    bound_batches(docs.sparkSession)
    return rows.transform(in_arrow, partial(_transform, rate=rate, spm_rate=spm_rate, sentinels=sentinels), _ROW)


def restored_texts(transformed: DataFrame, *, sentinels: tuple[str, str, str] = SENTINELS) -> DataFrame:
    """transformed with restored: the text that each row's form and output (needed columns) stand for. A null output stays null."""
    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in transformed.schema)
    return transformed.transform(in_arrow, partial(_restore, sentinels=sentinels), f"{kept}, restored string")


def unit_cuts(data: np.ndarray, ends: np.ndarray, draw) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(n, first cut, second cut) of each text; data holds the texts side by side, ends[1:] their ends.

    A unit starts at a text's first byte and where white space follows another byte. Running counts of
    starts, less the count before the text, number its units; draw(n) gives two numbers of units for
    each text, and one search among the counts finds all bytes where those units have passed.
    """
    space = _SPACE[data]
    start = np.zeros(len(data), bool)
    start[1:] = space[1:] & ~space[:-1]
    full = ends[:-1] < ends[1:]
    start[ends[:-1][full]] = True
    count = np.concatenate([[0], np.cumsum(start, dtype=np.int32)])
    before = count[ends[:-1]].astype(np.int64)
    n = count[ends[1:]] - before
    cuts = [np.where(u < n, np.searchsorted(count, before + u + 1) - 1, ends[1:]) for u in draw(n)]
    return n, np.minimum(*cuts), np.maximum(*cuts)


def _holders(data: bytes, ends: np.ndarray, sentinel: bytes) -> np.ndarray:
    """Whether each text holds the sentinel."""
    held, at = np.zeros(len(ends) - 1, bool), data.find(sentinel)
    while at >= 0:
        text = int(np.searchsorted(ends, at, "right")) - 1
        if at + len(sentinel) <= ends[text + 1]:
            held[text] = True
            at = data.find(sentinel, int(ends[text + 1]))  # one is enough
        else:
            at = data.find(sentinel, at + 1)
    return held


def _transform(batches, rate: int, spm_rate: int, sentinels):
    marks = [s.encode() for s in sentinels]
    for part in slices(batches, 1, BATCH_BYTES):
        texts = part.column(1).fill_null("")
        ends = np.frombuffer(texts.buffers()[1], np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
        body = memoryview(texts.buffers()[2] or b"")[ends[0] : ends[-1]]
        data, ends = np.frombuffer(body, np.uint8), ends - ends[0]
        h = [part.column(2 + i).to_numpy() for i in range(4)]
        n, one, two = unit_cuts(data, ends, lambda n: (h[0] % (n + 1), h[1] % (n + 1)))
        plain = (ends[:-1] == ends[1:]) | (h[2] % 100 >= rate)
        whole = body.tobytes()
        for mark in marks:
            plain |= _holders(whole, ends, mark)
        spm = h[3] % 100 < spm_rate
        letters = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80, dtype=np.int32)]).astype(np.int64)
        prefix, middle = letters[one] - letters[ends[:-1]], letters[two] - letters[one]
        out = []
        for a, b, c, d, as_is, reverse in zip(ends[:-1].tolist(), one.tolist(), two.tolist(), ends[1:].tolist(), plain.tolist(), spm.tolist()):
            if as_is:
                out.append(body[a:d])
            elif reverse:
                out += (marks[1], body[c:d], marks[0], body[a:b], marks[2], body[b:c])
            else:
                out += (marks[0], body[a:b], marks[1], body[c:d], marks[2], body[b:c])
        added = np.where(plain, 0, sum(map(len, marks)))
        offsets = np.concatenate([[0], np.cumsum(ends[1:] - ends[:-1] + added)]).astype(np.int32)
        output = pa.Array.from_buffers(pa.string(), len(texts), [None, pa.py_buffer(offsets), pa.py_buffer(b"".join(out))])
        form = pa.array(np.where(plain, "plain", np.where(spm, "spm", "psm")), pa.string())
        yield pa.RecordBatch.from_arrays([part.column(0), pa.array(n, pa.int64()), form, pa.array(prefix, pa.int64(), mask=plain), pa.array(middle, pa.int64(), mask=plain), output], names=["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"])


def restore(form: str, output: str, sentinels: tuple[str, str, str] = SENTINELS) -> str:
    """The text of one row. No sentinel is in it, so each is found once."""
    if form == "plain":
        return output
    p, s, m = sentinels
    if form == "psm":
        rest, middle = output[len(p) :].split(m)
        prefix, suffix = rest.split(s)
    else:
        rest, middle = output[len(s) :].split(m)
        suffix, prefix = rest.split(p)
    return prefix + middle + suffix


def _restore(batches, sentinels):
    for batch in batches:
        pairs = zip(batch.column("form").to_pylist(), batch.column("output").to_pylist())
        texts = [None if o is None else restore(f, o, sentinels) for f, o in pairs]
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], names=[*batch.schema.names, "restored"])


def infilling_digest(transformed: DataFrame) -> DataFrame:
    rows = restored_texts(transformed)
    return rows.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2(F.col("output").cast("binary"), 256).alias("output_sha256"), F.sha2(F.col("restored").cast("binary"), 256).alias("restored_sha256"))


def oracle_sql(seed: int = 42, rate: int = 50, spm_rate: int = 80) -> str:
    """DuckDB, from lists of units."""
    draws = ", ".join(f"('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT AS h{i + 1}" for i in range(4))
    space = "\\x20\\x09-\\x0D"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, sha256('{seed}:' || coalesce(doc_id::VARCHAR, 'null')) AS h,
             regexp_extract_all(coalesce(text, ''), '[{space}]*[^{space}]+|[{space}]+') AS u FROM documents),
e AS (SELECT doc_id, text, u, len(u)::BIGINT AS n, {draws} FROM d),
f AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS a, greatest(h1 % (n + 1), h2 % (n + 1)) AS b,
        CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>') OR h3 % 100 >= {rate} THEN 'plain'
             WHEN h4 % 100 < {spm_rate} THEN 'spm' ELSE 'psm' END AS form FROM e),
g AS (SELECT *, array_to_string(u[1:a], '') AS p, array_to_string(u[a + 1:b], '') AS m, array_to_string(u[b + 1:n], '') AS s FROM f)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(m) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM g"""

"""Operators 1, 2, 9 and 10 against the libraries themselves."""

import hashlib
import math
import struct
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import public_tokenizers
import pytest

from strandwise.llm import encoding, media, packing, queries, storage, token_counts, token_store

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(PATH)
    return lambda text: t.encode(text or "", add_special_tokens=False).ids


def test_pieces_give_the_library_s_tokens(sf_docs, odd_texts, library, monkeypatch):
    texts = [t or "" for _, t in odd_texts] + [r["text"] for r in sf_docs]
    want = [library(t) for t in texts]
    for slice_bytes, kept in ((1 << 22, 700_000), (40, 50)):
        monkeypatch.setattr(encoding, "SLICE_BYTES", slice_bytes)
        e = encoding.Encoder(PATH, kept)
        assert [list(struct.unpack(f"<{len(x) // 4}I", x)) for x in e.ids(texts)] == want
        assert e.lengths(pa.array([None, *texts], pa.string()).slice(1)) == [len(x) for x in want]


def test_cuts_at_odd_places_give_the_library_s_tokens(library):
    rng = np.random.default_rng(5)
    parts = ["a", "Zb", "'s", "'", "12", ",", ".", "!?", "<|endoftext|>", "<|", " ", "  ", "\n", "\t ", "\r\n", "\x1c", "\x85", "\xa0", "\u2003", "\u3000", "\u2029", "\u1680", "é", "à", "ѐ", "日本", "…", "\U0001f600", "(", "-", "_", "\0"]
    texts = ["".join(rng.choice(parts, rng.integers(1, 30))) for _ in range(3000)]
    e = encoding.Encoder(PATH)
    assert e.lengths(texts) == [len(library(t)) for t in texts]
    assert [list(np.frombuffer(x, "<u4")) for x in e.ids(texts[::-1])] == [library(t) for t in texts[::-1]]


def test_a_text_of_several_slices(library):
    rng = np.random.default_rng(6)
    text = " ".join("".join(rng.choice(list("abcdeé"), rng.integers(1, 9))) + "," * int(rng.integers(2)) for _ in range(1_100_000))
    assert len(text.encode()) > encoding.SLICE_BYTES + (1 << 20)
    flat, counts = encoding.Encoder(PATH).encode(["x y", text, ""])
    want = library(text)
    assert counts.tolist() == [2, len(want), 0] and flat[2:].tolist() == want


@pytest.mark.parametrize("name", ["word_bpe_49k.json", "piece_bpe_32k.model"])
def test_other_tokenizers_are_not_cut(name, sf_docs):
    path = public_tokenizers.path(name)
    texts = [r["text"] for r in sf_docs[:20]] + [""]
    if name.endswith(".model"):
        import sentencepiece

        want = sentencepiece.SentencePieceProcessor(model_file=path).encode(texts)
    else:
        from tokenizers import Tokenizer

        want = [x.ids for x in Tokenizer.from_file(path).encode_batch(texts, add_special_tokens=False)]
    assert encoding.Encoder(path).lengths(texts) == [len(x) for x in want]


def test_counts(make_docs, odd_texts, library):
    got = token_counts.count_tokens(make_docs(odd_texts), PATH, limit=512).collect()
    want = [(i, len((t or "").encode()), n := len(library(t)), n > 512) for i, t in odd_texts]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def test_empty_tables(make_docs):
    empty = make_docs([])
    assert token_counts.count_tokens(empty, PATH).count() == 0
    assert media.media_digest(media.audio_features(empty)).count() == 0
    assert packing.pack_documents(empty, PATH).count() == 0
    store = token_store.write_store(empty, PATH, token_store.store_folder(empty.sparkSession))
    assert store.count() == 0 and token_store.digest_store(store).count() == 0


def test_wav_round_trip_and_digest(make_docs, odd_texts):
    rows = {}
    for r in media.media_digest(media.audio_features(make_docs(odd_texts))).collect():
        rows.setdefault(r.doc_id, []).append(r)
    for i, t in odd_texts:
        data = (t or "").encode()
        pad = data + b" " * (-len(data) % 192 if data else 192)
        for r in rows[i]:
            assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (len(data), len(pad), hashlib.sha256(pad).hexdigest(), zlib.crc32(pad[-16:]))
            wav = media.encode_wav(pad)
            assert (r.media_bytes, r.media_sha256) == (len(wav), hashlib.sha256(wav).hexdigest())
    assert rows[8][0].feature == rows[9][0].feature == rows[9][1].feature


def test_resampling_keeps_a_tone_and_frames_do_not_depend_on_chunks(monkeypatch):
    n = 24_000
    tone = (128 + 100 * np.sin(2 * np.pi * 1000 * np.arange(n) / media.RATE)).astype(np.uint8)
    y = media.resample(tone, 0, media.n_resampled(n))
    want = 100 / 128 * np.sin(2 * np.pi * 1000 * np.arange(len(y)) / media.TARGET)
    assert np.abs(y - want)[50:-50].max() < 0.02
    whole, energy = media.log_mel(tone.tobytes())
    monkeypatch.setattr(media, "CHUNK_FRAMES", 7)
    parts, _ = media.log_mel(tone.tobytes())
    assert len(whole) == math.ceil((16_000 - 400) / 160) + 1 and np.allclose(whole, parts, atol=1e-4)
    mels, spans = media.read_tensors(media.tensor_stream(whole))
    assert np.array_equal(mels, whole) and spans[0, 0] == 0 and len(spans) == math.ceil(len(whole) / media.BLOCK)


def test_hysteresis():
    assert media.segments(np.array([0, -2, -5, -8, -10, -5, -1, -20.0])) == [(0, 4), (6, 7)]
    quiet = np.zeros(24_000, np.uint8) + 128
    quiet[8000:12000] = np.random.default_rng(1).integers(0, 255, 4000)
    found = media.segments(media.log_mel(quiet.tobytes())[1])
    assert len(found) >= 1 and all(0.3 < s * 0.01 < 0.52 for s, _ in found)


def test_store(make_docs, odd_texts, library, spark, monkeypatch):
    monkeypatch.setattr(token_store, "FRAME_IDS", 1000)
    folder = token_store.store_folder(spark)
    manifest = token_store.write_store(make_docs(odd_texts), PATH, folder, end_id=2)
    got = token_store.read_store(manifest).orderBy("start").collect()
    want = {}
    for i, t in odd_texts:
        want.setdefault(i, []).append(library(t) + [2])
    at, ids = 0, []
    for r in got:
        values = list(struct.unpack(f"<{r.n_tokens}I", r.ids))
        assert r.start == at and values in want[r.doc_id]
        at, ids = at + r.n_tokens, ids + [r.doc_id]
    assert ids == sorted(ids, key=lambda i: (i is not None, i)) and len(ids) == len(odd_texts)
    crc = {(r.doc_id, r.start): r.ids_crc32 for r in token_store.digest_store(manifest).collect()}
    assert crc == {(r.doc_id, r.start): zlib.crc32(r.ids) for r in got}
    for path in [r.path for r in manifest.collect()]:
        with token_store._Shard(path) as shard:
            for i, s, n in list(shard.index())[-2:]:
                assert shard.ids(s, n) in token_store.read_documents(path, {i})[i]


def test_damage_is_found(make_docs, spark):
    path = token_store.write_store(make_docs([(1, "some words here")]), PATH, token_store.store_folder(spark)).first().path
    local = storage.filesystem(path)[1]
    data = bytearray(open(local, "rb").read())
    data[-9 - 4] ^= 1  # the checksum of the only frame
    open(local, "wb").write(data)
    with pytest.raises(ValueError, match="checksum"):
        token_store.read_documents(path, {1})


def test_store_query_over_a_table(spark, sf_docs, library):
    got = queries.op9_token_store(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    at = 0
    for r, d in zip(got, sorted(sf_docs, key=lambda d: d["doc_id"])):
        ids = library(d["text"]) + [2]
        assert tuple(r) == (d["doc_id"], at, len(ids), zlib.crc32(struct.pack(f"<{len(ids)}I", *ids)))
        at += len(ids)
    assert len(got) == len(sf_docs)


def test_first_fit_decreasing_is_first_fit():
    rng = np.random.default_rng(3)
    for n in (1, 2, 57, 300):
        lengths = rng.integers(1, 101, n).tolist()
        bins, offsets = packing.first_fit_decreasing(lengths, 100)
        room, want = [], {}
        for i in sorted(range(n), key=lambda i: -lengths[i]):
            b = next((b for b, r in enumerate(room) if r >= lengths[i]), len(room))
            room += [100] * (b == len(room))
            want[i] = (b, 100 - room[b])
            room[b] -= lengths[i]
        assert [want[i] for i in range(n)] == list(zip(bins, offsets))


def test_packing(make_docs, odd_texts, sf_docs, library, monkeypatch):
    rows = odd_texts + [(1000 + d["doc_id"], d["text"]) for d in sf_docs]
    got = packing.pack_documents(make_docs(rows), PATH, seq_len=256, with_ids=True).collect()
    again = packing.pack_documents(make_docs(rows), PATH, seq_len=256).collect()
    assert sorted(map(str, (tuple(r)[:7] for r in got))) == sorted(map(str, map(tuple, again)))
    sequences, pieces = defaultdict(list), defaultdict(list)
    for r in got:
        assert zlib.crc32(r.ids) == r.ids_crc32 and len(r.ids) == 4 * r.length
        sequences[r.sequence_id].append((r.offset, r.length))
        pieces[r.doc_id].append((r.start, r.length, r.ids, r.doc_tokens))
    for parts in sequences.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 256
    for i, t in rows:
        if i == 9:
            continue  # a repeated row: its pieces are there once for each
        ids = library(t) + [1]
        own = sorted(pieces[i])
        assert b"".join(x for _, _, x, _ in own) == struct.pack(f"<{len(ids)}I", *ids) and {n for *_, n in own} == {len(ids)}
    assert len(pieces[9]) == 2
    filled = sum(r.length for r in got) / (256 * len(sequences))
    assert filled > 0.95

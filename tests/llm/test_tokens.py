import os
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyarrow import fs
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lexmere.llm import packing, suffixes, tokencounts, tokenfiles
from lexmere.llm.units import UnitEncoder

os.environ["TOKENIZERS_PARALLELISM"] = "false"
FILES = {"words": "word_bpe_49k.json", "bytes": "byte_bpe_50k.json", "pieces": "piece_bpe_32k.model"}
ODD = [
    "a  b", " lead", "trail ", "", "  ", "     ", "x" + " " * 37 + "y", "x\n y", "\n\n z  \n", "</s> <s>",
    "<|endoftext|> a <|endoftext|>b <|startoftext|>", "it's  don't 'S", "a  b　 c", "tab\t x", "  b", "é ̈x",
    "▁ a ▁▁ b", "日本語 テキスト 漢字", "\x1c y \x85 z", "Σας ΣΑΣ", "😀😀 x\x00", "x " * 50, "nospace" * 3000,
]


def library(kind):
    path = public_tokenizers.path(FILES[kind])
    if kind == "pieces":
        return sentencepiece.SentencePieceProcessor(model_file=path).encode
    model = Tokenizer.from_file(path)
    return lambda texts: [e.ids for e in model.encode_batch(texts, add_special_tokens=False)]


def words(rng, n):
    return "".join(rng.choice(["the ", "of ", f"w{rng.randrange(50)} ", "\n", "  ", "é, ", "日本"]) for _ in range(n))


def mixed(n=40):
    rng = random.Random(3)
    return ODD + [words(rng, rng.choice((5, 60, 400))) for _ in range(n)]


def numbers(data):
    return np.frombuffer(data, "<u4").tolist()


@pytest.mark.parametrize("kind", FILES)
def test_parts_give_the_library_ids(kind, monkeypatch):
    texts = mixed()
    want = library(kind)(texts)
    encoder = UnitEncoder(kind, public_tokenizers.path(FILES[kind]))
    assert [numbers(x) for x in encoder.encode([t.encode() for t in texts])] == want
    monkeypatch.setattr("lexmere.llm.units.CACHE_PARTS", 10)
    monkeypatch.setattr("lexmere.llm.units.SLICE_BYTES", 100)
    encoder = UnitEncoder(kind, public_tokenizers.path(FILES[kind]))
    assert [numbers(x) for x in encoder.encode([t.encode() for t in texts])] == want
    assert list(encoder.encode([None, b""])) == [b"", b""]


def test_suffix_matching_gives_the_library_ids(monkeypatch):
    texts = mixed()
    want = library("pieces")(texts)
    path = public_tokenizers.path(FILES["pieces"])
    monkeypatch.setattr("lexmere.llm.suffixes.INDEX_CHARS", 500)
    encoder = suffixes.SuffixEncoder(path)
    assert [numbers(x) for x in encoder.encode([t.encode() for t in texts])] == want
    marked = [suffixes.MARK + t.replace(" ", suffixes.MARK) if t else "" for t in texts]
    assert suffixes.encode_marked(marked, encoder.model) == want  # whole texts in one index


def test_occurrences_equal_find():
    model = suffixes.pieces(public_tokenizers.path(FILES["pieces"]))
    text = "▁the▁theory▁of▁banana"
    start, piece = suffixes.occurrences(suffixes._codes(text), model)
    strings = {i: p for p, i in model.ids.items()}
    got = {(int(s), strings[model.token[k]]) for s, k in zip(start, piece)}
    want = {(i, p) for p in model.ids for i in range(len(text)) if text.startswith(p, i)}
    assert got == want


def frame(spark, texts):
    rows = [(i, t, "z") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, "doc_id long, text string, ids string").repartition(3)


def test_suffix_encoding_and_decoding(spark):
    path = public_tokenizers.path(FILES["pieces"])
    texts = mixed(10) + [None]
    got = suffixes.decode(suffixes.encode(frame(spark, texts), path), path).collect()
    model = sentencepiece.SentencePieceProcessor(model_file=path)
    assert len(got) == len(texts)
    for r in got:
        text = texts[r.doc_id] or ""
        assert numbers(r.ids) == model.encode(text)
        assert r.decoded == text.replace("▁", " ") == model.decode(numbers(r.ids))
    assert suffixes.encode(frame(spark, ["x"]).limit(0), path).collect() == []


@pytest.mark.parametrize("chunk, overlap", [(16_384, 256), (64, 8), (40, 1)])
def test_counts_are_exact_whatever_the_chunks(spark, chunk, overlap):
    path = public_tokenizers.path(FILES["pieces"])
    texts = mixed(10) + [None, "漢字かな交じり文" * 40, "ab" * 200]
    got = tokencounts.count_tokens(frame(spark, texts), path, chunk=chunk, overlap=overlap).collect()
    want = [(i, len((t or "").encode()), n) for (i, t), n in zip(enumerate(texts), map(len, library("pieces")([t or "" for t in texts])))]
    assert sorted((r.doc_id, r.n_bytes, r.n_tokens) for r in got) == want


def test_stable_borders_are_in_no_piece():
    pairs = tokencounts.joined_pairs(["ab", "bcd", "x"])
    assert pairs == {"ab", "bc", "cd"}


def test_token_files_round_trip(spark, tmp_path, monkeypatch):
    texts = mixed(20) + [None]
    docs = frame(spark, texts).union(spark.createDataFrame([(None, "no id", ""), (5, "again", "")], "doc_id long, text string, ids string"))
    path = public_tokenizers.path(FILES["bytes"])
    manifest = tokenfiles.write_files(docs, str(tmp_path / "f"), path)
    got = tokenfiles.read_files(spark, manifest).collect()
    want = {i: ids + [0] for i, ids in enumerate(library("bytes")([t or "" for t in texts]))}
    at = 0
    ordered = sorted(got, key=lambda r: r.start)
    assert [r.doc_id for r in ordered] == sorted([None, 5, *want], key=lambda i: -1 if i is None else i)
    for r in ordered:
        assert r.start == at
        at += len(r.ids) // 4
        if r.doc_id is not None and r.doc_id != 5:
            assert numbers(r.ids) == want[r.doc_id]
    digest = {(r.doc_id, r.start): (r.n_tokens, r.ids_crc32) for r in tokenfiles.digest(tokenfiles.read_files(spark, manifest)).collect()}
    assert digest == {(r.doc_id, r.start): (len(r.ids) // 4, zlib.crc32(r.ids)) for r in got}
    some = tokenfiles.read_files(spark, manifest, {2, 7}).collect()
    assert sorted((r.doc_id, bytes(r.ids)) for r in some) == sorted((r.doc_id, bytes(r.ids)) for r in got if r.doc_id in (2, 7))
    empty = tokenfiles.write_files(docs.limit(0), str(tmp_path / "e"), path)
    assert tokenfiles.read_files(spark, empty).collect() == []


def test_only_wanted_frames_are_read_and_checksums_hold(tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "FRAME_BYTES", 400)
    store, name = fs.FileSystem.from_uri(str(tmp_path / "x.bin"))
    with store.open_output_stream(name) as out:
        writer = tokenfiles.TokenFileWriter(out)
        for i in range(100):
            writer.add(i, np.arange(i, dtype="<u4").tobytes())
        writer.close()
    with store.open_input_file(name) as source:
        reader = tokenfiles.TokenFileReader(source)
        seen = []
        frame_of = reader.frame
        reader.frame = lambda k: seen.append(k) or frame_of(k)
        assert [(i, numbers(ids)) for i, _, ids in reader.documents({90})] == [(90, list(range(90)))]
        assert len(seen) == 1 and len(reader.entries) > 10
    import zstandard

    raw = bytearray((tmp_path / "x.bin").read_bytes())
    plain = zstandard.ZstdDecompressor().stream_reader(bytes(raw), read_across_frames=True).read()
    assert plain == b"".join(np.arange(i, dtype="<u4").tobytes() for i in range(100))
    raw[-tokenfiles.FOOTER.size - 1] ^= 1  # the last frame's checksum
    (tmp_path / "y.bin").write_bytes(raw)
    with store.open_input_file(str(tmp_path / "y.bin")) as source, pytest.raises(ValueError, match="checksum"):
        list(tokenfiles.TokenFileReader(source).documents())


def sequences(rows):
    out = defaultdict(list)
    for r in rows:
        out[r.sequence_id].append((r.offset, r.length))
    return out


def test_packing(spark):
    texts = mixed(60) + [None]
    path = public_tokenizers.path(FILES["words"])
    limits = packing.Capacities(tokens=64, group_pieces=100)
    rows = packing.pack_documents(frame(spark, texts), path, limits).collect()
    want = {}
    for i, ids in enumerate(library("words")([t or "" for t in texts])):
        ids = ids + [0]
        for k in range(0, len(ids), 64):
            part = np.array(ids[k : k + 64], "<u4")
            want[i, k // 64] = (k, len(part), zlib.crc32(part.tobytes()))
    assert {(r.doc_id, r.piece): (r.start, r.length, r.ids_crc32) for r in rows} == want
    for places in sequences(rows).values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 64
    assert len(sequences(rows)) <= sum(r.length for r in rows) / 64 * 1.02 + 2
    again = frame(spark, ["x"]).limit(0)
    assert packing.pack_documents(again, path, limits).collect() == []


@pytest.mark.parametrize("score", ["norm", "dot"])
def test_every_capacity_holds(score):
    rng = np.random.default_rng(4)
    lengths = rng.integers(1, 100, 500)
    limits = packing.Capacities(tokens=128, documents=5, attention=9000 + 99**2, score=score)
    bins, offsets = packing.best_fit(lengths, limits)
    for b in range(bins.max() + 1):
        own = np.flatnonzero(bins == b)
        own = own[np.argsort(offsets[own])]
        assert offsets[own].tolist() == [0, *np.cumsum(lengths[own])[:-1]]
        assert lengths[own].sum() <= 128 and len(own) <= 5 and (lengths[own] ** 2).sum() <= 9000 + 99**2
    with pytest.raises(ValueError):
        packing.best_fit(np.array([200]), limits)


def test_best_fit_is_close_to_the_least():
    lengths = np.random.default_rng(6).integers(1, 2049, 4000)
    bins, _ = packing.best_fit(lengths, packing.Capacities())
    # longest pieces over half a sequence each need their own
    least = max(-(-lengths.sum() // 2048), (lengths > 1024).sum())
    assert bins.max() + 1 <= least * 1.02


def test_rows_keep_their_other_columns(spark):
    path = public_tokenizers.path(FILES["pieces"])
    docs = spark.createDataFrame([(None, None), (1, "a b"), (1, "a b")], "doc_id long, text string").withColumn("row", F.lit(9))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in tokencounts.count_tokens(docs, path).collect()) == [(0, 0), (1, 2), (1, 2)]

import json
import zlib

import numpy as np
import pyarrow.fs as pafs
import pytest

from tests.llm.helpers import ODD, docs, noise, sha
from trustloom.llm import byte_bpe, token_files
from trustloom.llm._shared import fresh_path

public_tokenizers = pytest.importorskip("public_tokenizers")
RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.fixture(scope="module")
def encoding():
    import tiktoken

    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(RANKS), special_tokens={})


def test_pattern_is_the_public_one():
    assert byte_bpe.PATTERN == public_tokenizers.PATTERN


def test_transducer_equals_merging(encoding):
    coder = byte_bpe.MergeTransducer(byte_bpe.read_ranks(RANKS))
    for text in [*noise(300), "a" * 7000, "ab" * 4000, "-" * 5000]:
        for piece in byte_bpe._PATTERN.findall(text):
            assert coder.encode(piece.encode()) == encoding.encode_ordinary(piece)


def test_utf8_machine_is_incremental():
    raw = "aé世😀b".encode() + b"\xff\xe4\xb8" + b"z" + b"\xf0\x9f\x98"
    for step in (1, 2, 3, 5, 100):
        machine = byte_bpe.Utf8Machine()
        got = "".join(machine.feed(raw[k : k + step]) for k in range(0, len(raw), step)) + machine.close()
        assert got == raw.decode("utf-8", "replace")


def test_round_trip_equals_library(spark, encoding):
    texts = [*noise(500, 2), *ODD]
    got = {r.doc_id: r for r in byte_bpe.round_trip(docs(spark, texts), RANKS).collect()}
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        ids = encoding.encode_ordinary(text or "")
        assert (got[k].n_tokens, got[k].ids_sha256, got[k].decoded_sha256) == (len(ids), sha(" ".join(map(str, ids))), sha(text or "")), repr(text)


def test_encode_and_decode_columns(spark, encoding):
    texts = noise(50, 3)
    rows = byte_bpe.decode(byte_bpe.encode(docs(spark, texts), RANKS), RANKS).collect()
    assert all(list(r.ids) == encoding.encode_ordinary(texts[r.doc_id]) and r.text == texts[r.doc_id] for r in rows)


def test_byte_bpe_of_no_rows(spark):
    assert byte_bpe.round_trip(docs(spark, []), RANKS).count() == 0


def library_ids(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORDS)
    t.encode_special_tokens = True
    return [e.ids for e in t.encode_batch([x or "" for x in texts], add_special_tokens=False)]


def test_token_files_equal_library(spark):
    texts = [*noise(400, 5), *ODD, "<|endoftext|> It's l'ete", None]
    ids = [3 * k - 70 for k in range(len(texts) - 1)] + [None]
    rows = token_files.tokens_on_file(docs(spark, texts, ids), WORDS, 2).collect()
    want, start = {}, 0
    for k in sorted(range(len(texts)), key=lambda k: (ids[k] is not None, ids[k] or 0)):
        tokens = [*library_ids([texts[k]])[0], 2]
        want[ids[k]] = (start, len(tokens), zlib.crc32(np.array(tokens, "<u4").tobytes()))
        start += len(tokens)
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in rows} == want


def test_reader_gets_one_document_and_sees_damage(spark, tmp_path):
    texts = noise(60, 6)
    listed = token_files.write_files(docs(spark, texts), fresh_path(spark, "t"), WORDS, 2, files=3).collect()
    assert sum(r.n_docs for r in listed) == 60 and len(listed) == 3
    for r in listed:
        fs, place = pafs.FileSystem.from_uri(r.path)
        with fs.open_input_file(place) as f:
            reader = token_files.FrameReader(f)
            k = int(reader.doc_ids[1])
            assert reader.document(k).tolist() == [*library_ids([texts[k]])[0], 2]
            with pytest.raises(KeyError):
                reader.document(10**6)
        raw = bytearray(open(place, "rb").read())
        raw[12] ^= 0xFF
        (tmp_path / "bad").write_bytes(raw)
        with pafs.LocalFileSystem().open_input_file(str(tmp_path / "bad")) as f, pytest.raises(Exception):
            token_files.FrameReader(f).frame(0)


def test_token_files_of_no_rows(spark):
    assert token_files.tokens_on_file(docs(spark, []), WORDS, 2).count() == 0

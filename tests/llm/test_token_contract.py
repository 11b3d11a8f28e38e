"""Special tokens inside texts, and units whose hashes collide."""

import zlib

import numpy as np
import pytest

from tests.llm.helpers import docs, noise
from trustloom.llm import byte_bpe, token_files
from trustloom.llm._bytes import utf8
from trustloom.llm._units import TokenPool, hashed_units

public_tokenizers = pytest.importorskip("public_tokenizers")
WORDS = public_tokenizers.path("word_bpe_49k.json")


def test_special_tokens_as_the_plain_library(spark):
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(WORDS)
    texts = ["<|endoftext|>", "a <|endoftext|> b", "x<|startoftext|>y é's", "<|ENDOFTEXT|> é<|EndOfText|>", "<|endoftext", "<|endoftext|><|endoftext|>", "É<|endoftext|>É", *noise(60, 8)]
    rows = {r.doc_id: r for r in token_files.tokens_on_file(docs(spark, texts), WORDS, 2).collect()}
    for k, text in enumerate(texts):
        ids = [*library.encode(text, add_special_tokens=False).ids, 2]
        assert (rows[k].n_tokens, rows[k].ids_crc32) == (len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())), text
    assert rows[0].n_tokens == 2 and rows[3].n_tokens > 3


def thue_morse(n, a, b):
    return "".join((a, b)[bin(k).count("1") & 1] for k in range(n))


def test_units_with_one_hash_keep_their_own_ids():
    # any polynomial hash modulo 2**64 gives these two one value
    one, other = thue_morse(1 << 11, "a", "b"), thue_morse(1 << 11, "b", "a")
    import pyarrow as pa

    offsets, data = utf8(pa.array([one, other]))
    assert len(set(hashed_units(offsets, data, True)[3].tolist())) == 1
    codec = byte_bpe.ByteBpe(byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_50k.tiktoken")))
    for order in ([one, other], [other, one, one, other]):
        offsets, data = utf8(pa.array(order))
        assert [codec.decode(ids.tolist()).decode() for _, ids in codec.encode_rows(offsets, data)] == order


@pytest.mark.parametrize("units", [["ab", "ac", "a"], ["12345678x", "12345678y", "x2345678x"], ["q" * 16 + "a" + "q" * 9, "q" * 16 + "b" + "q" * 9, "q" * 26]])
def test_a_pool_compares_bytes(units):
    pool = TokenPool(lambda found, kinds: [list(u) for u in found], np.uint16)
    for _ in range(3):
        raw = "".join(units).encode()
        lengths = np.array(list(map(len, units)))
        starts = np.cumsum(lengths) - lengths
        got = pool.lookup(np.frombuffer(raw, np.uint8), starts, lengths, np.zeros(len(units), np.uint8), np.full(len(units), 7, np.uint64))
        ids, counts = pool.tokens(got)
        assert [bytes(x.tolist()).decode() for x in np.split(ids, np.cumsum(counts)[:-1])] == units

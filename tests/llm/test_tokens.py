"""Token ids: parity with the libraries, exact round trips, canonical codes."""

import zlib

import numpy as np
import plain
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from armwise.llm import piece_codec, token_files
from armwise.llm.queries import vocabulary

PIECES = "piece_bpe_32k.model"
WORDS = "word_bpe_49k.json"


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(vocabulary(WORDS))


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_pieces_equal_sentencepiece(spark, which):
    import sentencepiece

    other = sentencepiece.SentencePieceProcessor(model_file=vocabulary(PIECES))
    docs = plain.awkward(spark) if which == "awkward" else spark.read.parquet(f"{plain.SF}/documents.parquet")
    texts = sorted((r.doc_id or 0, r.text or "") for r in docs.select("doc_id", "text").collect())
    rows = piece_codec.encode(docs, vocabulary(PIECES)).collect()
    want = sorted((k, other.encode(t)) for k, t in texts)
    assert sorted((r.doc_id or 0, list(r.ids)) for r in rows) == want
    assert all(r.n_tokens == len(r.ids) and r.ids_crc32 == zlib.crc32(np.array(r.ids, "<i4").tobytes()) and r.round_trip for r in rows)
    back = piece_codec.decode(piece_codec.encode(docs, vocabulary(PIECES)), vocabulary(PIECES)).collect()
    assert sorted((r.doc_id or 0, r.text) for r in back) == sorted((k, t.replace("▁", " ")) for k, t in texts)
    assert piece_codec.encode(plain.empty(docs), vocabulary(PIECES)).count() == 0


def test_threads_change_nothing(spark):
    docs = plain.awkward(spark)
    a, b = ([(r.doc_id, r.ids) for r in piece_codec.encode(docs, vocabulary(PIECES), threads=n).collect()] for n in (1, 4))
    assert a == b


@pytest.mark.parametrize("which", ["table", "awkward"])
def test_files_hold_the_library_s_ids(spark, library, which):
    docs = plain.awkward(spark) if which == "awkward" else spark.read.parquet(f"{plain.SF}/documents.parquet")
    texts = [(r.doc_id, r.text or "") for r in docs.select("doc_id", "text").collect()]
    path = token_files.scratch(spark, "test-tokens")
    token_files.write_files(docs, vocabulary(WORDS), path)
    rows = sorted(token_files.read_files(spark, path, with_ids=True).collect(), key=lambda r: r.start)
    assert [r.key for r in rows] == sorted((k for k, _ in texts), key=lambda k: (k is not None, k))
    assert sorted((-1 if r.key is None else r.key, list(r.ids)) for r in rows) == sorted((k if k is not None else -1, library.encode(t, add_special_tokens=False).ids + [2]) for k, t in texts)
    start = 0
    for r in rows:
        assert (r.start, r.n_tokens, r.ids_crc32) == (start, len(r.ids), zlib.crc32(np.array(r.ids, "<u4").tobytes()))
        start += r.n_tokens


def test_files_of_no_documents(spark):
    assert token_files.round_trip(plain.empty(plain.awkward(spark)), vocabulary(WORDS)).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 10**6), min_size=1, max_size=60), st.integers(6, 20))
def test_codes_are_short_complete_and_no_worse_than_plain_huffman(counts, limit):
    counts = np.array(counts)
    n = token_files.code_lengths(counts, limit)
    used = counts > 0
    assert ((n > 0) == used).all() and n.max(initial=0) <= limit
    if used.sum() > 1:
        assert sum(2.0 ** -int(x) for x in n[used]) == 1
        import heapq

        heap = counts[used].tolist()
        heapq.heapify(heap)
        cost = 0
        while len(heap) > 1:
            both = heapq.heappop(heap) + heapq.heappop(heap)
            cost += both
            heapq.heappush(heap, both)
        mine = int((counts * n.astype(np.int64)).sum())
        assert mine == cost if limit == 20 and used.sum() < 20 else mine >= cost


@settings(max_examples=40, deadline=None)
@given(st.lists(st.lists(st.integers(0, 900), max_size=700), min_size=1, max_size=5))
def test_blocks_round_trip(docs):
    flat = np.concatenate([np.array(d, np.int64) for d in docs])
    book = token_files.codebook(token_files.code_lengths(np.bincount(flat, minlength=1 << 16)).tobytes())
    keys = [None, *range(1, len(docs))]
    data = token_files.pack(keys, [len(d) for d in docs], flat, book)
    for got_keys, counts, ids in token_files.unpack([data, data], book):
        assert got_keys == keys and counts.tolist() == [len(d) for d in docs] and ids.tolist() == flat.tolist()


_UNICODE = st.text(st.characters(exclude_categories=["Cs"]) | st.sampled_from("aAéÉßſİıΣς'’.,\x01\x02\x07 \t\n<|>０٣½ﬁ́­"), max_size=60)


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(st.none(), _UNICODE, st.sampled_from(["<|endoftext|>", "it's <|startoftext|>x", "ΑΣ ΑΣ.", "ÀÉÎ naïve", "\x01\x02\x03\x04\x05\x06\x07\x08"])), max_size=6))
def test_words_apart_encode_as_whole_texts(library, texts):
    import pyarrow as pa

    ids, ends = token_files._encoder(vocabulary(WORDS)).encode(pa.array(texts, pa.string()), 2)
    got = [x.tolist() for x in np.split(ids, ends)[:-1]]
    assert got == [library.encode(t or "", add_special_tokens=False).ids + [2] for t in texts]


def message(*fields: tuple[int, bytes | float | int]) -> bytes:
    """A protobuf message: bytes, floats and small integers by field number."""
    out = b""
    for n, v in fields:
        if isinstance(v, bytes):
            size = b""
            k = len(v)
            while True:
                size += bytes([k & 127 | (128 if k > 127 else 0)])
                k >>= 7
                if not k:
                    break
            out += bytes([n << 3 | 2]) + size + v
        elif isinstance(v, float):
            out += bytes([n << 3 | 5]) + np.float32(v).tobytes()
        else:
            out += bytes([n << 3, v])
    return out


def test_rebuilt_unigram_model_gives_sentencepiece_s_ids(tmp_path):
    """A model file written by hand: unigram scores, a dummy prefix and single spaces."""
    import sentencepiece

    pieces = [("<unk>", 0.0, 2), ("<s>", 0.0, 3), ("</s>", 0.0, 3)]
    pieces += [(p, s, 1) for p, s in (("▁", -3.1), ("▁the", -2.2), ("▁qu", -4.5), ("ick", -4.1), ("▁quick", -7.3), ("fox", -6.2), ("▁f", -5.9), ("ox", -5.2), ("ze", -6.6), ("bra", -6.7), ("▁zebra", -12.9))]
    pieces += [(chr(97 + i), -8.0 - i / 8, 1) for i in range(26)]
    model = b"".join(message((1, message((1, p.encode()), (2, s), (3, k)))) for p, s, k in pieces)
    model += message((2, message((3, 1))), (3, message((3, 1), (4, 1), (5, 1))))
    path = tmp_path / "m.model"
    path.write_bytes(model)
    codec, other = piece_codec.Codec(str(path)), sentencepiece.SentencePieceProcessor(model_file=str(path))
    assert codec.model.kind == piece_codec.UNIGRAM and codec.model.one_space
    for t in ["the quick fox", "", "  two  ends  ", "zebra quick", "foxbox thethe", "a  b   c", "naïve", "quickthe zebrabra"]:
        (ids, same), = codec.encode([t])
        assert same and ids.tolist() == other.encode(t), t

import hashlib
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
import tiktoken
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from tapelight.llm import byte_bpe, idcoder, packing, token_file
from tapelight.llm.arrowtext import ENCODED, Memo, segments, slices, utf8, words
from tapelight.llm.scratch import folder
from tapelight.llm.tokenizer import library_ids, token_memo

from .helpers import awkward, none

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
ODD = st.lists(st.sampled_from(list("ab1 '\n\t.,!sreldé日😀\u00a0\u2003\x85\u0301\x1c▁") + ["'s", "<|endoftext|>", "  "]), max_size=40).map("".join)


@given(st.lists(ODD, max_size=20))
@settings(deadline=None, max_examples=60)
def test_ids_are_those_of_whole_texts(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        plain.encode_special_tokens = True
        ids, at = token_memo(public_tokenizers.path(name))(*utf8(pa.array(texts, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


@given(st.lists(ODD, max_size=20))
@settings(deadline=None, max_examples=60)
def test_byte_bpe_is_the_rank_format(texts):
    coder = byte_bpe.bpe(RANKS, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks={t: i for i, t in enumerate(coder.tokens)}, special_tokens={})
    ids, at = coder.memo(*utf8(pa.array(texts, pa.string())))
    for text, a, b in zip(texts, at[:-1], at[1:], strict=True):
        assert ids[a:b].tolist() == library.encode_ordinary(text)
        assert coder.decode(ids[a:b])[0].tobytes().decode() == text


@given(st.lists(st.integers(0, 65534), max_size=300), st.integers(0, 3))
@settings(deadline=None, max_examples=40)
def test_coder_round_trip(ids, times):
    ids = np.array(ids * 10**times, np.int64)
    assert idcoder.decode(b"".join(idcoder.encode(ids))).tolist() == ids.tolist()


def test_blocks_stand_alone_and_notice_damage():
    ids = np.random.default_rng(1).integers(0, 500, 3 * idcoder.BLOCK + 7)
    blocks = idcoder.encode(ids)
    assert len(blocks) == 4 and idcoder.decode(blocks[2]).tolist() == ids[2 * idcoder.BLOCK : 3 * idcoder.BLOCK].tolist()
    broken = bytearray(blocks[1])
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        idcoder.decode(bytes(broken))
    with pytest.raises(ValueError):
        idcoder.decode(blocks[0][:10])
    with pytest.raises(ValueError):
        idcoder.encode(np.array([65535]))


def test_repetition_is_coded_small():
    ids = np.tile(np.arange(50), 400)
    assert sum(map(len, idcoder.encode(ids))) < len(ids) / 4


def test_a_block_learns_from_all_its_ids():
    ids = np.tile(np.arange(50), 400)
    assert sum(map(len, idcoder.encode(ids))) < len(ids) / 16  # blocks of 1,024 ids learnt twenty times


@pytest.mark.parametrize("n", [1, 2, 255, 511, 513, 70_000])
def test_lanes_of_any_length(n):
    ids = np.random.default_rng(n).zipf(1.3, n) % 65535
    assert idcoder.decode(b"".join(idcoder.encode(ids))).tolist() == ids.tolist()


def test_memo_keeps_what_comes_again():
    asked = []
    memo = Memo(lambda texts: (asked.extend(texts), [[len(t), 7] for t in texts])[1], most=8)
    for k in range(20):
        texts = ["often", "again", f"once{k}", f"another{k}"]
        ids, at = memo(*utf8(pa.array(texts)))
        assert ids.tolist() == [x for t in texts for x in (len(t), 7)] and at.tolist() == [0, 2, 4, 6, 8]
        assert len(memo.rows) <= 8 + 4
    assert asked.count("often") == asked.count("again") == 1


def test_memo_encodes_few_segments_at_once():
    sizes = []
    memo = Memo(lambda texts: (sizes.append(len(texts)), [[int(t)] for t in texts])[1])
    numbers = [*range(3 * ENCODED), 5, 2 * ENCODED]
    for _ in range(2):
        ids, at = memo(*utf8(pa.array(map(str, numbers))))
        assert ids.tolist() == numbers and at.tolist() == list(range(len(numbers) + 1))
    assert sum(sizes) == 3 * ENCODED and max(sizes) <= ENCODED


def test_case_and_white_space_need_no_segments_of_their_own():
    """Where the normaliser takes them away, but for letters that NFC joins to a mark in lower case alone."""
    name = public_tokenizers.path("word_bpe_49k.json")
    memo = Memo(token_memo(name).encode, fold=token_memo(name).fold)
    plain = Tokenizer.from_file(name)
    for first, texts in ((4, [" word and Word\nWORD\tAnd", "x\rx"]), (0, ["J\u030c j\u030c H\u0331 h\u0331 I\u0307 i\u0307", "\u0130\u212a K", "A", "\u0301", "DON'T\x0bStop \x1cX", "THE<|EndOfText|>END \u0301\n\u0301"])):
        ids, at = memo(*utf8(pa.array(texts, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]
        assert not first or len(memo.rows) == first  # " word", " and", "x", " x"
    assert token_memo(public_tokenizers.path("byte_bpe_50k.json")).fold is None


def test_words_and_segments_cover_texts():
    texts = ["", " a  b\n", "é,x", None, "don't stop", "x\u00a0 y"]
    batch = next(slices([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])]))
    data, at = utf8(batch.column("text"))
    starts, ends, first = words(data, at)
    assert [[data[a:b].tobytes().decode() for a, b in zip(starts[i:j], ends[i:j], strict=True)] for i, j in zip(first[:-1], first[1:], strict=True)] == [(t or "").split(" ") if t == "x\u00a0 y" else [w for w in (t or "").replace("\n", " ").split(" ") if w] for t in texts]
    cuts, _ = segments(data, at)
    assert set(at[:-1][np.diff(at) > 0]) <= set(cuts)


def test_slices_are_bounded_and_whole():
    texts = ["x" * n for n in (5, 0, 900, 3, 2000, 1)]
    cut = list(slices([pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])], most=1000))
    assert [t for b in cut for t in b.column("text").to_pylist()] == texts and all(b.num_rows == 1 or b.column("text").nbytes < 2000 for b in cut)


def test_token_files(spark):
    path, name = folder(spark), public_tokenizers.path("word_bpe_49k.json")
    documents = awkward(spark)
    token_file.write_ids(documents, path, name, end_id=1, row_ids=500)
    rows = sorted(token_file.read_ids(spark, path).collect(), key=lambda r: r.start)
    plain = Tokenizer.from_file(name)
    plain.encode_special_tokens = True
    texts = {r.doc_id: r.text or "" for r in documents.collect() if r.doc_id is not None}
    at, last = 0, -1
    for r in rows:
        assert r.start == at and (r.doc_id is None or r.doc_id >= last)
        if r.doc_id is not None:
            ids = plain.encode(texts[r.doc_id], add_special_tokens=False).ids + [1]
            assert r.ids == ids and r.ids_crc32 == zlib.crc32(np.array(ids, "<u4").tobytes())
        at, last = at + r.n_tokens, r.doc_id if r.doc_id is not None else last
    assert len(rows) == documents.count()
    empty = folder(spark)
    token_file.write_ids(none(spark), empty, name, end_id=1)
    assert token_file.read_ids(spark, empty).count() == 0


def test_byte_bpe_documents(spark):
    documents = awkward(spark)
    rows = byte_bpe.encode_documents(documents, RANKS, public_tokenizers.PATTERN).collect()
    assert len(rows) == documents.count()
    for r in rows:
        assert r.n_tokens == len(r.ids) and r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest() and r.decoded_sha256 == hashlib.sha256(r.text.encode()).hexdigest()
    assert byte_bpe.encode_documents(none(spark), RANKS, public_tokenizers.PATTERN).count() == 0


def test_packing(spark):
    documents = awkward(spark)
    name = public_tokenizers.path("byte_bpe_50k.json")
    packed = packing.pack_documents(documents, name, 0, block=8, ids=True).cache()
    rows = packed.collect()
    assert sum(r.start == 0 for r in rows) == documents.count()
    for r in rows:
        assert r.length == len(r.ids) <= 2048 and (r.piece == 0 or r.length == 2048)
    for s in packing.sequences(packed).collect():
        own = sorted((r for r in rows if r.sequence_id == s.sequence_id), key=lambda r: r.offset)
        assert [r.offset for r in own] == [sum(q.length for q in own[:k]) for k in range(len(own))] and s.ids == [i for r in own for i in r.ids] and s.length <= 2048
    assert packing.pack_documents(none(spark), name, 0).count() == 0


@given(st.lists(st.integers(1, 100), max_size=120))
@settings(deadline=None, max_examples=80)
def test_local_search_loses_nothing_and_never_needs_more(lengths):
    first = packing.best_fit(lengths, 100)
    bins = packing.local_search([list(b) for b in first], lengths, 100)
    assert sorted(k for b in bins for k in b) == list(range(len(lengths))) and all(sum(lengths[k] for k in b) <= 100 for b in bins) and len(bins) <= len(first)


def test_local_search_empties_a_bin():
    lengths = [60, 60, 40, 30, 10]
    assert len(packing.local_search([[0, 3], [1, 4], [2]], lengths, 100)) == 2


@given(st.lists(st.lists(st.sampled_from(["a", " ", "b1", ".", "<", "|>", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>", "é\n"]), max_size=12).map("".join), max_size=12))
@settings(deadline=None, max_examples=60)
def test_ids_are_the_librarys(texts):
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        plain = Tokenizer.from_file(public_tokenizers.path(name))
        ids, at = library_ids(public_tokenizers.path(name))(*utf8(pa.array(texts, pa.string())))
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:], strict=True)] == [plain.encode(t, add_special_tokens=False).ids for t in texts]


def test_added_tokens_are_one_id(spark):
    documents = spark.createDataFrame([(1, "x <|endoftext|> y"), (2, "z")], "doc_id long, text string")
    path, name = folder(spark), public_tokenizers.path("word_bpe_49k.json")
    token_file.write_ids(documents, path, name, end_id=1)
    rows = {r.doc_id: r for r in token_file.read_ids(spark, path).collect()}
    assert rows[1].ids == [343, 49407, 344, 1] and rows[2].start == 4
    name = public_tokenizers.path("byte_bpe_50k.json")
    packed = {r.doc_id: r.ids for r in packing.pack_documents(documents, name, 0, ids=True).collect()}
    assert packed[1] == Tokenizer.from_file(name).encode("x <|endoftext|> y", add_special_tokens=False).ids + [0] and 50256 in packed[1]


def test_packing_keeps_ids_and_columns(spark):
    """Large ids beside null ones, repeated ids, and columns named like the packing's own."""
    big = (1 << 60) + 1
    rng = np.random.default_rng(5)
    rows = [(None if k % 7 == 0 else big + k // 3, int(n), k, k * 2, "x", k) for k, n in enumerate(rng.integers(1, 1500, 300))]
    pieces = spark.createDataFrame(rows, "doc_id long, length long, block int, full int, offset string, _row int")
    few = packing.pack(pieces, block=64).select("sequence_id").distinct().count()
    packed = packing.pack(pieces, block=64, rounds=None, levels=None).collect()
    assert sorted((r.doc_id or 0, r.length, r.block, r.full, r._row) for r in packed) == sorted((r[0] or 0, r[1], r[2], r[3], r[5]) for r in rows)
    by_sequence = {}
    for r in packed:
        by_sequence.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for own in by_sequence.values():
        own.sort()
        assert [a for a, _ in own] == [sum(n for _, n in own[:k]) for k in range(len(own))] and sum(n for _, n in own) <= 2048
    total = sum(r[1] for r in rows)
    assert len(by_sequence) <= few <= 1.05 * len(by_sequence) + 1
    assert len(by_sequence) <= -(-total // 2048) + 2  # two above the least that could hold all tokens


def test_piece_checksums(spark):
    """ids_crc32, start and length of every piece against the tokenizer itself."""
    documents, name = awkward(spark), public_tokenizers.path("byte_bpe_50k.json")
    plain = Tokenizer.from_file(name)
    texts = {r.doc_id: r.text or "" for r in documents.collect() if r.doc_id is not None}
    ids = {i: np.array(plain.encode(t, add_special_tokens=False).ids + [0], "<u4") for i, t in texts.items()}
    for r in packing.pack_documents(documents, name, 0).where("doc_id IS NOT NULL").collect():
        own = ids[r.doc_id][r.start : r.start + r.length]
        assert len(own) == r.length and r.ids_crc32 == zlib.crc32(own.tobytes())

import glob
import zlib
from collections import defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from reelsight.llm import packing
from reelsight.llm.queries import QUERIES, tokenizer_file
from reelsight.session import checkpoint_dir


@pytest.fixture(scope="module")
def tokenizer():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokenizer_file("word_bpe_49k.json"))


def check(rows, docs, tokenizer):
    ids = {}
    for i, t in docs:
        whole = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [2], "<u4")
        ids.setdefault(i, []).append(whole)
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        match = [w for w in ids[r.doc_id] if len(w) == r.doc_tokens
                 and zlib.crc32(w[r.start:r.start + r.length].tobytes()) == r.ids_crc32]
        assert match
        pieces[r.doc_id].append((r.start, r.length))
        sequences[r.sequence_id].append((r.offset, r.length))
    for i, wholes in ids.items():
        assert sum(n for _, n in pieces[i]) == sum(map(len, wholes))
    for s in sequences.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 4096
    return sequences


def test_pieces_cover_documents(spark, odd_docs, tokenizer):
    rows = packing.pack_documents(odd_docs, tokenizer_file("word_bpe_49k.json")).collect()
    check(rows, [(r.doc_id, r.text) for r in odd_docs.collect()], tokenizer)


def test_little_padding(spark, some_docs, tokenizer):
    rows = packing.pack_documents(some_docs, tokenizer_file("word_bpe_49k.json"), keep_ids=False).collect()
    sequences = check(rows, [(r.doc_id, r.text) for r in some_docs.collect()], tokenizer)
    used = sum(n for s in sequences.values() for _, n in s)
    assert used / (4096 * len(sequences)) > 0.97


def test_sequences_hold_the_ids(spark, odd_docs):
    pieces = packing.pack_documents(odd_docs, tokenizer_file("word_bpe_49k.json"))
    rows = {r.sequence_id: r for r in packing.assemble_sequences(pieces).collect()}
    for p in pieces.collect():
        r = rows[p.sequence_id]
        part = bytes(r.ids)[4 * p.offset:4 * (p.offset + p.length)]
        assert zlib.crc32(part) == p.ids_crc32 and len(r.ids) == 4 * r.length


def test_empty_table(spark, no_docs):
    assert packing.pack_documents(no_docs, tokenizer_file("word_bpe_49k.json")).count() == 0


def test_tokenizer_by_words_equals_whole_texts(tokenizer):
    ours = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    for text in ("It's a test of  spaces", "a\x1cb\x1f c\x85d", "é ́x", "cafÉ <|endoftext|> Straße", "",
                 "x" * 500 + " y", "The the, THE. the!? It.s A_b a,b x.. ...", "你好 世界 123 4.5"):
        assert ours.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_first_fit_decreasing_equals_plain_search():
    draw = np.random.default_rng(1)
    lengths = draw.integers(1, 100, 500)
    bins, offsets = packing.first_fit_decreasing(lengths, 100)
    room, want = [], {}
    for i in np.argsort(-lengths, kind="stable"):
        k = next((k for k, r in enumerate(room) if r >= lengths[i]), len(room))
        if k == len(room):
            room.append(100)
        want[i] = (k, 100 - room[k])
        room[k] -= lengths[i]
    assert [(int(b), int(o)) for b, o in zip(bins, offsets)] == [want[i] for i in range(len(lengths))]


def test_digests_come_from_the_stored_sequences(spark, odd_docs):
    sequences = packing.pack_sequences(odd_docs, tokenizer_file("word_bpe_49k.json"))
    good = {(r.sequence_id, r.offset): r for r in packing.pieces_of(sequences).collect()}
    for r in sequences.collect():
        at = 0
        for offset in r.offsets:
            piece = good[r.sequence_id, offset]
            assert offset == at and piece.ids == r.ids[4 * at:4 * (at + piece.length)]
            at += piece.length
        assert 4 * at == len(r.ids) <= 4 * 4096
    # Another last id in every sequence shows in the checksum of its last piece, and of no other.
    spoilt = sequences.withColumn("ids", F.expr("substring(ids, 1, length(ids) - 4) || X'07000000'"))
    wrong = [r for r in packing.pieces_of(spoilt, keep_ids=False).collect()
             if r.ids_crc32 != good[r.sequence_id, r.offset].ids_crc32]
    assert len(wrong) == len({r.sequence_id for r in wrong}) == sequences.count()
    short = packing.pieces_of(sequences.withColumn("ids", F.expr("substring(ids, 1, length(ids) - 4)"))).collect()
    assert sum(r.length for r in short) == sum(r.length for r in good.values()) - sequences.count()


def test_stage_and_query_pack_whole_sequences(spark, odd_docs, tokenizer):
    rows = corpus_pipeline.STAGES[-1][1](spark, odd_docs, "/root/testdata/sf0.001").collect()
    check(rows, [(r.doc_id, r.text) for r in odd_docs.collect()], tokenizer)
    assert all(len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32 for r in rows)
    before = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/sequences-*"))
    digests = QUERIES["op2_packing"](spark, "/root/testdata/sf0.001").collect()
    stored, = set(glob.glob(f"{checkpoint_dir(spark).removeprefix('file:')}/sequences-*")) - before
    stored = {r.sequence_id: r.ids for r in spark.read.parquet(stored).collect()}
    packed = [r for r in digests if r.sequence_id < 1 << 62]
    assert {r.sequence_id for r in packed} == set(stored)
    for r in packed:
        assert zlib.crc32(stored[r.sequence_id][4 * r.offset:4 * (r.offset + r.length)]) == r.ids_crc32


def test_groups_are_bounded_by_bytes(spark, some_docs, tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "GROUP_BYTES", 100_000)
    rows = packing.pack_documents(some_docs, tokenizer_file("word_bpe_49k.json")).collect()
    check(rows, [(r.doc_id, r.text) for r in some_docs.collect()], tokenizer)
    assert len({r.sequence_id >> 24 for r in rows if r.sequence_id < 1 << 62}) > 1


def test_each_word_is_encoded_once_for_many_texts(tokenizer, monkeypatch):
    """Texts with the same words in another case or with marks behind them ask the tokenizer for them together and once."""
    ours = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    asked = []
    for name in ("encode", "encode_letters"):
        plain = getattr(ours, name)
        monkeypatch.setattr(ours, name, lambda words, plain=plain: asked.append(list(words)) or plain(words))
    texts = ["Été word, Word. WORD!? word", "", "  \n", "word naïve, naïve. x×y 4.5,word a\x1cb\x85", "Naïve x" + "y" * 300 + " z!"]
    for text, ids in zip(texts, ours.all_ids(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids
    words = sum(asked, [])
    assert len(asked) <= 2 and len(words) == len(set(words)) and not {"Word", "word,", "word.", "WORD!?", "Été", "Naïve", "z!"} & set(words)
    assert max(map(len, ours.memo)) <= packing.MEMO_WORD_BYTES
    few = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"), memo_words=3)
    for text in texts * 2:
        assert few.ids(text).tolist() == tokenizer.encode(text, add_special_tokens=False).ids
        assert len(few.memo) + len(few.older) <= 20


def test_odd_signs_have_the_ids_of_whole_texts(tokenizer):
    draw = np.random.default_rng(3)
    signs = [*"aZhHtTsS'.,!?;:|<>*4 \n\x0b\x00\x1c\x85\xa0\xadµªºßÀÿ×÷ÉéΣσςİıſǰ̸̱́̈K你", "<|endoftext|>",
             "<|EndOfText|>", "'re", "the", "Est", "été"]
    ours = packing.WordTokenizer(tokenizer_file("word_bpe_49k.json"))
    narrow = [s for s in signs if max(s) <= "\xff" and "<" not in s]
    texts = ["".join(draw.choice(some, draw.integers(0, 24))) for some in (signs, narrow, narrow, [*"aé'.,! "]) for _ in range(500)]
    for text, ids in zip(texts, ours.all_ids(texts), strict=True):
        assert ids.tolist() == tokenizer.encode(text, add_special_tokens=False).ids, text

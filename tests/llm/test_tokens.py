"""Token ids, packing, the token store and SentencePiece."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from ledgerline.llm import packing, sentence_pieces, token_store, tokens
from tests.llm.helpers import CLASHING, documents, small_documents

ALPHABET = "abcdefgh ABC    \n\t.,'!éßñÑ\"<>|0123456789日本語😀ЖΏ 　ﬁ²́"


def texts(n=1500, seed=2):
    rng = random.Random(seed)
    special = ["", " ", "don't. isn't, it's", "<|endoftext|>", "A<|startoftext|>b <|ENDOFTEXT|>", "a.,b ., é. É, ×. é.",
               "\x00x\x1cy\x85z", "İstanbul Σας ΣΑΣ", "word." * 500]
    return special + ["".join(rng.choice(ALPHABET) for _ in range(rng.randrange(0, 80))) for _ in range(n)]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return Tokenizer.from_file(tokens.vocabulary())


def library_ids(library, text, end):
    return np.array(library.encode(text or "", add_special_tokens=False).ids + [end], np.uint32)


def test_word_table_gives_the_librarys_ids(library):
    rows = texts()
    got = {}
    for i, ids, at in tokens.encode_column(pa.array(rows), tokens.word_table(tokens.vocabulary()), 7):
        for k in range(len(at) - 1):
            got[i + k] = ids[at[k]:at[k + 1]].tolist()
    assert [got[k] for k in range(len(rows))] == [library_ids(library, t, 7).tolist() for t in rows]


def test_word_table_starts_anew_when_full(library, monkeypatch):
    monkeypatch.setattr(tokens, "MAX_WORDS", 40)
    table = tokens.WordTable(lambda words: [e.ids for e in library.encode_batch_fast(words, add_special_tokens=False)])
    rows = [f"word{i} and word{i + 1}" for i in range(200)]
    monkeypatch.setattr(tokens, "row_chunks", lambda off: ((k, k + 1) for k in range(len(off) - 1)))
    got = [ids.tolist() for _, ids, _ in tokens.encode_column(pa.array(rows), table, 2)]
    assert got == [library_ids(library, t, 2).tolist() for t in rows]


@pytest.mark.parametrize("seed", range(4))
def test_plan_uses_every_piece_once_with_little_padding(seed):
    rng = np.random.default_rng(seed)
    window = 512
    counts = np.bincount(np.minimum(rng.geometric(0.01, 3000), window), minlength=window + 1)
    counts[40] += 4000 * (seed % 2)
    plan = packing.plan(counts, window)
    used, total = np.zeros_like(counts), 0
    for lengths, n in plan:
        assert n > 0 and sum(lengths) <= window
        np.add.at(used, list(lengths), n)
        total += n
    assert (used == counts).all()
    assert total * window <= 1.02 * (counts * np.arange(window + 1)).sum() + window
    seats = {}
    for length, lo, hi, each, first, at in packing.slots(plan):
        for rank in range(lo, hi):
            k = first + (rank - lo) // each
            seats.setdefault(k, []).append((at + (rank - lo) % each * length, length))
    assert sorted(seats) == list(range(total))
    for parts in seats.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]


def test_plan_of_nothing():
    assert packing.plan(np.zeros(17, np.int64), 16) == []


def check_pack(rows, library, out):
    left = {}
    for doc, text in rows:
        left.setdefault(doc, []).append(library_ids(library, text, 2))
    seats, count = {}, {}
    for r in out:
        ids = next(v for v in left[r.doc_id] if len(v) == r.doc_tokens
                   and zlib.crc32(v[r.start:r.start + r.length].tobytes()) == r.ids_crc32)
        count[r.doc_id] = count.get(r.doc_id, 0) + r.length
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
        assert 0 < r.length <= len(ids)
    assert count == {d: sum(map(len, v)) for d, v in left.items()}
    for parts in seats.values():
        parts.sort()
        assert [p[0] for p in parts] == [sum(q[1] for q in parts[:k]) for k in range(len(parts))]
        assert sum(p[1] for p in parts) <= packing.WINDOW
    return seats


def test_packing_covers_every_id(spark, library):
    docs = small_documents(spark)
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    seats = check_pack(rows, library, packing.pack(docs).collect())
    total = sum(p[1] for parts in seats.values() for p in parts)
    assert len(seats) * packing.WINDOW <= 1.1 * total + packing.WINDOW


def test_packing_edge_cases(spark, library):
    rows = [(1, None), (2, ""), (3, "word " * 9000), (3, "word " * 9000), (4, "tie"), (5, "tie"), (None, "tie")]
    docs = documents(spark, [(i, t, None, None) for i, t in rows], CLASHING)
    check_pack(rows, library, packing.pack(docs).collect())
    assert packing.pack(docs.limit(0)).count() == 0


@pytest.mark.parametrize("n", [0, 1, 2, 1023, 1024, 1025, 5000])
def test_blocks_round_trip(n):
    rng = np.random.default_rng(n)
    for ids in (rng.integers(0, 49408, n), np.full(n, 49407), rng.integers(0, 3, n), rng.geometric(0.01, n) % 49408):
        ids = ids.astype(np.uint32)
        blocks = token_store.encode_blocks(ids)
        sizes = [min(token_store.BLOCK, n - k * token_store.BLOCK) for k in range(len(blocks))]
        assert (token_store.decode_blocks(blocks, sizes) == ids).all()
        for k, b in enumerate(blocks):  # every block stands alone
            part = ids[k * token_store.BLOCK:(k + 1) * token_store.BLOCK]
            assert (token_store.decode_blocks([b], [len(part)]) == part).all()


def test_repeated_ids_are_coded_shorter():
    ids = np.tile(np.arange(50, dtype=np.uint32) * 900, 100)
    assert sum(map(len, token_store.encode_blocks(ids))) < len(ids)


def test_a_damaged_block_is_noticed():
    ids = np.arange(3000, dtype=np.uint32)
    data = bytearray(token_store.pack_segment([None, 4], np.array([1000, 2000]), ids))
    names, lengths, back = token_store.unpack_segment(bytes(data))
    assert names == [None, 4] and lengths.tolist() == [1000, 2000] and (back == ids).all()
    data[-40] ^= 255
    with pytest.raises(ValueError):
        token_store.unpack_segment(bytes(data))
    with pytest.raises(ValueError):
        token_store.unpack_segment(b"XXXX" + bytes(data[4:]))


def check_store(rows, library, out):
    want, start = [], 0
    for doc, text in rows:
        ids = library_ids(library, text, 1)
        want.append((doc, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(out, key=lambda r: r[1]) == want


def test_store_gives_every_document_back(spark, library):
    docs = small_documents(spark)
    rows = sorted((r.doc_id, r.text) for r in docs.collect())
    check_store(rows, library, [tuple(r) for r in token_store.store_tokens(docs.repartition(6)).collect()])


def test_store_edge_cases(spark, library):
    rows = [(None, "x"), (1, None), (2, ""), (3, "word " * 5000), (3, "word " * 5000), (4, "tie"), (5, "tie")]
    docs = documents(spark, [(i, t, None, None) for i, t in reversed(rows)], CLASHING)
    check_store(rows, library, [tuple(r) for r in token_store.store_tokens(docs).collect()])
    assert token_store.store_tokens(docs.limit(0)).count() == 0


def test_pieces_equal_the_library():
    import sentencepiece
    path = tokens.vocabulary(sentence_pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = texts(1500, 4) + ["▁", "a▁ b", " a ", "ab" * 300, "<s> </s> <0x41>"]
    got = {}
    for i, ids, at in sentence_pieces.encode_column(pa.array(rows), sentence_pieces._table(path)):
        for k in range(len(at) - 1):
            got[i + k] = ids[at[k]:at[k + 1]].tolist()
    assert [got[k] for k in range(len(rows))] == library.encode(rows)


def test_pieces_round_trip_on_spark(spark):
    import sentencepiece
    library = sentencepiece.SentencePieceProcessor(model_file=tokens.vocabulary(sentence_pieces.MODEL))
    rows = [(1, "  two  spaces "), (2, None), (3, ""), (4, "日本 é\n\t"), (5, "▁mark"), (6, "long " * 30_000), (6, "x"), (None, "x")]
    docs = documents(spark, [(i, t, None, None) for i, t in rows], CLASHING[:-2])
    both = sentence_pieces.decode(sentence_pieces.encode(docs)).collect()
    for r in both:
        assert r.decoded == (None if r.text is None else r.text.replace("▁", " "))
        assert r.ids == (None if r.text is None else library.encode(r.text))
    out = sentence_pieces.round_trip(docs).collect()
    assert len(out) == len(rows) and all(r.lossless for r in out)
    assert sentence_pieces.round_trip(docs.limit(0)).count() == 0
    assert all(r.lossless for r in sentence_pieces.round_trip(small_documents(spark)).collect())


def test_ids_beyond_the_format_are_refused():
    with pytest.raises(ValueError, match="16 bits"):
        token_store.pack_segment([1], np.array([2]), np.array([5, 70_000], np.uint32))


def test_common_lengths_are_ranked_in_sub_groups(spark, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 2)
    docs = documents(spark, [(i, "one two three", "en", "a") for i in range(60)] + [(100 + i, "word " * i, "en", "a") for i in range(30)])
    seats = {}
    rows = packing.pack(docs, window=64).collect()
    for r in rows:
        seats.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert len({(r.doc_id, r.start) for r in rows}) == len(rows)
    for own in seats.values():
        own.sort()
        assert [o for o, _ in own] == [0, *np.cumsum([n for _, n in own])[:-1]] and sum(n for _, n in own) <= 64


def test_words_encoded_together_equal_words_encoded_alone():
    from tokenizers import Tokenizer
    library = Tokenizer.from_file(tokens.vocabulary())
    rng = random.Random(3)
    odd = ["|", "a|b", "||", "", "<|endoftext|>", "\u0301x", "\u00a0z", "ﬀ", "ａ｜b", "😀", "it's", "x" * 5000, "1,234.5", "\u2028", "!?"]
    words = [rng.choice(odd) if rng.random() < 0.1 else "".join(rng.choice("abcdeéß1.,'") for _ in range(rng.randrange(1, 9)))
             for _ in range(5000)]
    ids, sizes = tokens.joined_encoder(library)(words)
    got = [r.tolist() for r in np.split(ids, np.cumsum(sizes)[:-1])]
    assert got == [library.encode(w, add_special_tokens=False).ids for w in words]
    assert [len(x) for x in tokens.joined_encoder(library)([])] == [0, 0]


def test_a_segment_takes_little_more_than_its_ids_tell():
    rng = np.random.default_rng(5)
    chance = 1 / np.arange(1, 3001)
    ids = (rng.choice(3000, 60_000, p=chance / chance.sum()) * 13).astype(np.uint32)
    data = token_store.pack_segment([1], np.array([len(ids)]), ids)
    bits = -np.log2(chance / chance.sum()) @ (chance / chance.sum())
    assert len(data) < 1.1 * len(ids) * bits / 8 + 6 * 3000
    assert (token_store.unpack_segment(data)[2] == ids).all()


def test_damaged_odds_are_noticed():
    data = bytearray(token_store.pack_segment([1], np.array([2000]), np.arange(2000, dtype=np.uint32)))
    data[40] ^= 255
    with pytest.raises(ValueError, match="odds"):
        token_store.unpack_segment(bytes(data))


def test_latin_letters_and_words_of_them_give_the_librarys_ids(library):
    rng = random.Random(8)
    letters = "abcXYZßàöøÿÀÖØÞ×÷µªºŸé\u0301\u0323İſ'"
    rows = [" ".join("".join(rng.choice(letters) for _ in range(rng.randrange(1, 7))) for _ in range(rng.randrange(40)))
            for _ in range(400)]
    table = tokens.WordTable(tokens.joined_encoder(library))
    got = {i + k: ids[at[k]:at[k + 1]].tolist() for i, ids, at in tokens.encode_column(pa.array(rows), table, 7)
           for k in range(len(at) - 1)}
    assert [got[k] for k in range(len(rows))] == [library.encode(r, add_special_tokens=False).ids + [7] for r in rows]


def test_words_of_letters_are_encoded_many_at_a_time(library):
    asked = []

    class Counting:
        model, normalizer, pre_tokenizer = library.model, library.normalizer, library.pre_tokenizer
        encode, get_vocab = library.encode, library.get_vocab

        def encode_batch_fast(self, texts, **more):
            asked.extend(texts)
            return library.encode_batch_fast(texts, **more)

    words = ["word" + a + b for a in "abcdéß" for b in "xyzö"]
    ids, sizes = tokens.joined_encoder(Counting())(words)
    assert [r.tolist() for r in np.split(ids, np.cumsum(sizes)[:-1])] == [
        library.encode(w, add_special_tokens=False).ids for w in words]
    assert not asked  # the rules for other words weren't needed


def test_the_automaton_names_the_pieces_that_end_at_a_prefix():
    known = sentence_pieces.pieces(tokens.vocabulary(sentence_pieces.MODEL))
    longest = max(map(len, known.ids))
    for word in ["▁internationalization", "▁▁▁the", "▁日本é\nthe", "▁" + "ab" * 20]:
        at = 0
        for i, c in enumerate(word, 1):
            to = known.steps[at].get(c)
            at = known.step(at, c) if to is None else to
            ends = [word[s:i] for s in range(max(0, i - longest), i) if word[s:i] in known.ids]
            assert [(len(p), known.ids[p]) for p in ends] == list(known.ends[at])


def test_words_of_known_pairs_need_no_check(monkeypatch):
    import sentencepiece
    path = tokens.vocabulary(sentence_pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    known = sentence_pieces.Pieces(path)
    words = sorted({w for t in texts(300, 9) for w in t.split()})
    spelled = known.encode([" " + w for w in words])
    assert spelled == library.encode(words)
    calls = []
    monkeypatch.setattr(sentence_pieces.Pieces, "stands", lambda self, *pair: calls.append(pair))
    assert known.encode([" " + w for w in reversed(words)]) == spelled[::-1] and not calls


def test_a_worker_remembers_a_bounded_number_of_steps_and_pairs(monkeypatch):
    import sentencepiece
    path = tokens.vocabulary(sentence_pieces.MODEL)
    library = sentencepiece.SentencePieceProcessor(model_file=path)
    monkeypatch.setattr(sentence_pieces, "MAX_STEPS", 3)
    monkeypatch.setattr(sentence_pieces, "MAX_PAIRS", 5)
    known = sentence_pieces.Pieces(path)
    words = sorted({w for t in texts(100, 10) for w in t.split()})
    assert known.encode([" " + w for w in words]) == library.encode(words)
    assert known.taken == 3 and len(known.pairs) <= 5

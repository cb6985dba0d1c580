import hashlib
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm.llm_helpers import documents, texts
from tokenizers import Tokenizer

from vocabmill.llm import bpe, lexicon, packing, pretokens, token_counts
from vocabmill.llm.shared import map_arrays, pack_arrays, text_blocks
from vocabmill.llm.vocabulary import Vocabulary

PATH = public_tokenizers.path("word_bpe_49k.json")
LIBRARY = Tokenizer.from_file(PATH)
VOCABULARY = Vocabulary(PATH)


def ids_of(text):
    return LIBRARY.encode(text or "", add_special_tokens=False).ids


def encoded(codec, texts):
    lists = {}
    for row, ids, _ in codec.encode(texts):
        lists.setdefault(row, []).extend(ids.tolist())
    return [lists[i] for i in range(len(texts))]


ODD = st.text(st.sampled_from("'''srtevmldlxa1 .!éΣßİ́\n　\x1c\u0085日<|>"), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.one_of(ODD, st.text(max_size=30)))
def test_codecs_agree_with_the_library(text):
    if any(0xD800 <= ord(c) < 0xE000 or _unassigned(c) for c in text):
        return
    arrays = bpe.Codec.compile(VOCABULARY, ["hello", "world", "re", "'s", "!"])
    for codec in (bpe.Codec(VOCABULARY), bpe.Codec(VOCABULARY, arrays)):
        assert encoded(codec, [text, None, "Hello world's"]) == [ids_of(text), [], ids_of("Hello world's")]
        assert codec.decode(np.array(ids_of(text))) == LIBRARY.decode(ids_of(text), skip_special_tokens=False)
    counter = token_counts.Counter(VOCABULARY, token_counts.Counter.compile(VOCABULARY, ["hello", "world", "re"]))
    assert counter.count([text, None, ""]).tolist() == [len(ids_of(text)), 0, 0]


def _unassigned(c):
    import unicodedata

    return unicodedata.category(c) in ("Cn", "Cs")


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("abcé", min_size=1, max_size=6), st.integers(0, 50), min_size=1, max_size=40), st.lists(st.text("abcéz", min_size=1, max_size=7), min_size=1))
def test_lexicon_maps_words_to_outputs(words, asked):
    arrays = lexicon.build(list(words), list(words.values()))
    asked += list(words)
    text = "".join(asked)
    ends = np.cumsum([len(w) for w in asked])
    codes = np.frombuffer(text.encode("utf-32-le"), np.uint32)
    found = lexicon.Lexicon(arrays).walk(codes, ends - [len(w) for w in asked], ends)
    assert found.tolist() == [words.get(w, -1) for w in asked]


def test_lexicon_shares_suffixes_and_can_be_mapped(tmp_path):
    words = sorted(a + b for a in "abcdefgh" for b in ("ning", "ned", "ner"))
    arrays = lexicon.build(words, range(len(words)))
    assert len(arrays["base"]) < 12  # a trie has more than 70 states
    path = tmp_path / "arrays"
    path.write_bytes(pack_arrays(arrays))
    mapped = map_arrays(str(path))
    assert all((mapped[name] == array).all() for name, array in arrays.items())


def test_long_words_are_merged_like_short_ones():
    words = ["ab" * n + "the" for n in (20, 30, 40)] + ["a" * 3000]
    ids, counts = VOCABULARY.merge(words)
    parts = np.split(ids, np.cumsum(counts)[:-1])
    assert [p.tolist() for p in parts] == [ids_of(w) for w in words]


def test_chunk_maps_compose():
    rng = np.random.default_rng(0)
    classes = rng.integers(0, pretokens.CLASSES, (37, 11)).astype(np.uint8)
    step, _ = pretokens.transitions()
    total = pretokens.scan(pretokens.chunk_maps(classes))
    for start in range(pretokens.STATES):
        state = start
        for row, expected in zip(classes, total[:, start], strict=True):
            for c in row:
                state = step[state * pretokens.CLASSES + c]
            assert state == expected


def test_blocks_cut_at_white_space():
    rows = ["aa bb cc dd", None, "", "x" * 30, "ee ff"]
    blocks = list(text_blocks(rows, 5))
    pieces = {}
    for block in blocks:
        for row, piece, _ in block:
            pieces.setdefault(row, []).append(piece)
    assert ["".join(pieces[i]) for i in range(5)] == [t or "" for t in rows]
    assert all(p.endswith(" ") for p in pieces[0][:-1])
    assert sum(last for block in blocks for _, _, last in block) == len(rows)


@pytest.fixture(scope="module")
def codec(spark):
    return bpe.codec_for(documents(spark), PATH, max_words=200)


def test_round_trip_digests(spark, codec):
    expected = sorted((i or -1, *_digests(t)) for i, t, _ in texts())
    rows = bpe.round_trip_digests(documents(spark), codec).collect()
    assert sorted((-1 if r.doc_id is None else r.doc_id or -1, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in rows) == expected


def _digests(text):
    ids = ids_of(text)
    decoded = LIBRARY.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def test_encode_and_decode_tables(spark, codec):
    docs = documents(spark).where("doc_id between 80 and 90")
    rows = bpe.encode(docs, codec).collect()
    own = {i: t for i, t, _ in texts()}
    assert all(r.ids == ids_of(own[r.doc_id]) and r.n_tokens == len(r.ids) for r in rows)
    back = bpe.decode(bpe.encode(docs, codec), codec).collect()
    assert {r.doc_id: r.decoded for r in back} == {i: LIBRARY.decode(ids_of(own[i]), skip_special_tokens=False) for i in range(80, 91)}


def test_frequent_words_are_counted_over_all_documents(spark):
    docs = documents(spark, [(1, "b b a's", None), (2, "B <|endoftext|> a", None), (3, None, None)])
    assert {r.word: r.n for r in bpe.word_counts(docs).collect()} == {"b": 3, "a": 2, "'s": 1}
    assert bpe.frequent_words(docs, max_words=2) == ["b", "a"]
    rng = np.random.default_rng(3)
    words = [f"{'abcd'[k % 4]}{'xyz'[k % 3]}q{k}" for k in range(300)]
    counts = [int(n) for n in rng.choice([1, 1, 1, 2, 3, 70, 1500, 1510], 300)]
    docs = documents(spark, [(0, " ".join(" ".join([w] * n) for w, n in zip(words, counts, strict=True)), None)])
    expected = {}
    for r in bpe.word_counts(docs).collect():
        expected[r.word] = r.n
    ordered = sorted(expected, key=lambda w: (-expected[w], w))
    for most in (1, 5, 50, 150, len(ordered), len(ordered) + 9):
        assert bpe.frequent_words(docs, max_words=most) == ordered[:most]
    assert bpe.frequent_words(documents(spark, [])) == []


def test_token_counts_table(spark):
    counter = token_counts.counter_for(documents(spark), PATH, max_words=300)
    rows = token_counts.token_counts(documents(spark), counter).collect()
    found = sorted((-1 if r.doc_id is None else r.doc_id, r.n_bytes, r.n_tokens) for r in rows)
    assert found == sorted((-1 if i is None else i, len((t or "").encode()), len(ids_of(t))) for i, t, _ in texts())


def check_packing(rows, expected, length):
    own, sequences = {}, {}
    for r in rows:
        own.setdefault(r.key, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for members in sequences.values():
        at = 0
        for r in sorted(members, key=lambda r: r.offset):
            assert r.offset == at
            at += r.length
        assert at <= length
    for key, lists in expected.items():
        pieces = sorted((r.piece, r.start, r.length, r.ids_crc32) for r in own[key])
        assert pieces == sorted(
            (k // length, k, len(ids[k : k + length]), zlib.crc32(np.array(ids[k : k + length], "<u4").tobytes())) for ids in lists for k in range(0, len(ids), length)
        )
    return len(sequences)


@pytest.mark.parametrize("block", [50_000, 20])
def test_packing_holds_all_pieces(spark, codec, monkeypatch, block):
    monkeypatch.setattr(packing, "BLOCK_PIECES", block)
    rows = packing.pack(packing.pieces(documents(spark), codec, 512), 512).collect()
    expected = {}
    for i, t, _ in texts():
        expected.setdefault(i, []).append([*ids_of(t), 0])
    sequences = check_packing(rows, expected, 512)
    total = sum(len(ids) for lists in expected.values() for ids in lists)
    assert sequences <= -(-total // 512) + 2


def test_packing_of_an_empty_table(spark, codec):
    assert packing.pack(packing.pieces(documents(spark, []), codec, 512), 512).collect() == []
    assert bpe.round_trip_digests(documents(spark, []), codec).collect() == []


def test_local_search_raises_squares_and_empties_bins():
    sizes = [6, 3, 5, 4, 1, 1]
    before = [[0, 1], [2, 3], [4], [5]]
    after = packing.local_search([list(b) for b in before], sizes, 10)
    assert sorted(i for b in after for i in b) == list(range(6))
    assert all(sum(sizes[i] for i in b) <= 10 for b in after)
    assert len(after) == 2
    rng = np.random.default_rng(1)
    sizes = rng.integers(1, 100, 400).tolist()
    bins = [[i] for i in range(len(sizes))]
    after = packing.local_search(bins, sizes, 100)
    squares = [sum(sum(sizes[i] for i in b) ** 2 for b in x) for x in (bins, after)]
    assert squares[1] > squares[0] and len(after) <= least_bins(sizes, 100) + 2


def least_bins(sizes, capacity):
    """A lower bound: pieces of over half a bin need their own, small ones only fit beside those that leave room."""
    best = 0
    for k in range(capacity // 2 + 1):
        alone = sum(s > capacity - k for s in sizes)
        half = [s for s in sizes if capacity / 2 < s <= capacity - k]
        rest = sum(s for s in sizes if k <= s <= capacity / 2)
        best = max(best, alone + len(half) + max(0, -(-(rest - (len(half) * capacity - sum(half))) // capacity)))
    return best


def test_exact_triples_are_found_beyond_the_nearest_partners():
    """Pieces that fill bins in threes: best fit leaves many bins underfull that exchanges can fill."""
    rng = np.random.default_rng(7)
    sizes = []
    for _ in range(200):
        a, b = sorted(rng.integers(1, 2048, 2).tolist())
        a, b = min(a, 1200), min(b, 1900)
        parts = [x for x in (a, b - a, 2048 - b) if x > 0]
        sizes += parts
    found = packing.pack_block(sizes, 2048)
    assert sorted(i for b in found for i in b) == list(range(len(sizes)))
    assert len(found) <= len(packing.best_fit(sizes, 2048))
    assert len(found) <= least_bins(sizes, 2048) + 4

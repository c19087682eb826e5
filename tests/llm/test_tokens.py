"""Token ids, counts, packing and files against the library and round trips."""

import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from vitrine.llm import packing, queries, simple8b, tokencount, tokenfile, wordids

from .conftest import TEXTS

WORD, BYTE = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
LIBRARY = {p: Tokenizer.from_file(p) for p in (WORD, BYTE)}
SF = "/root/testdata/sf0.001"
FST = tokencount.Transducer(WORD)
PLAIN = st.text(alphabet="abst're lvd1!\n\t É", max_size=400)
ANY = st.one_of(PLAIN, st.text(max_size=60), st.lists(st.sampled_from(["<|endoftext|>", "don't", " ", "''", "日本", "½"]), max_size=12).map("".join))


def ids(path, text):
    return LIBRARY[path].encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(ANY)
def test_ids_and_counts_equal_the_library(text):
    for path in (WORD, BYTE):
        got = np.frombuffer(wordids.word_ids(path).ids(text), dtype="<u4").tolist()
        assert got == ids(path, text)
    assert FST.counts([text]) == [len(ids(WORD, text))]


@settings(max_examples=60, deadline=None)
@given(st.lists(ANY, max_size=8))
def test_long_texts_are_cut_safely(texts):
    for path in (WORD, BYTE):
        words = wordids.word_ids(path)
        before, wordids.STRETCH = wordids.STRETCH, 12
        try:
            got = [x.tolist() for x in words.each([*texts, None])]
        finally:
            wordids.STRETCH = before
        assert got == [ids(path, t) for t in [*texts, None]]


def test_chunks_compose():
    texts = ["x" * 3000, "'" * 1500, "a b " * 900, "no'space'" * 400, None, ""]
    assert FST.counts(texts) == [len(ids(WORD, t)) for t in texts]


def test_state_maps_over_long_runs():
    rng = np.random.default_rng(3)
    drawn = "".join(rng.choice(list("0123456789abcdef"), 20_000))
    texts = ["q" + "x" * 9000, "abc" * 5000, "it's" + "'" * 3000, "日本語のテキスト。" * 400, "é😀" * 1500, "　全角 　空白" * 200, drawn, "İ J̌ ½ \x0b\x0c\x85 x\x01\x7f\x00q" * 200, "ab<|endoftext|>cd" * 100]
    assert FST.counts(texts) == [len(ids(WORD, t)) for t in texts]
    for t in texts:
        assert FST.counts([t]) == [len(ids(WORD, t))]


def test_maps_are_composed_as_one_walk_goes():
    rng = np.random.default_rng(4)
    for lanes in (1, 2, 3, 8, 37):
        to = rng.integers(0, 3, (lanes, 3))  # from three states to three, and a count each
        counts = rng.integers(0, 9, (lanes, 3))
        keys = np.array([c << 32 | s for c in range(lanes) for s in range(3) if c or not s])
        at = lambda x: np.array([x[k >> 32, k & 0xFFFFFFFF] for k in keys.tolist()])
        want, state = [], 0
        for c in range(lanes):
            want.append(counts[c, state])
            state = to[c, state]
        assert tokencount.composed(keys, at(to), at(counts), lanes).tolist() == want


@pytest.mark.parametrize("most, at_once", [(1000, 1 << 20), (1000, 700), (6, 50)])
def test_a_full_table_gives_way_to_the_library(monkeypatch, most, at_once):
    monkeypatch.setattr(tokencount, "MOST_STATES", most)
    monkeypatch.setattr(tokencount, "MOST_PAIRS", 500)
    monkeypatch.setattr(tokencount, "AT_ONCE", at_once)
    fst, rng = tokencount.Transducer(WORD), np.random.default_rng(7)
    letters = ["".join(rng.choice(list("abcdefgEXT'1 \n" if k % 2 else "aehinorstEX1"), 2000)) for k in range(6)]
    texts = [*letters, "<|ENDOFTEXT|> and <|endoftext|>", "plain words", None]
    for _ in range(2):  # the table starts anew
        assert fst.counts(texts) == [len(ids(WORD, t)) for t in texts]
        assert len(fst.keys) <= most


def test_other_layouts_are_refused():
    with pytest.raises(ValueError):
        tokencount.Transducer(BYTE)


def test_token_counts(docs, no_docs):
    got = sorted(map(tuple, tokencount.token_counts(docs, WORD).collect()), key=str)
    assert got == sorted(((i, len((t or "").encode()), n := len(ids(WORD, t)), n > 2048) for i, t in TEXTS), key=str)
    assert tokencount.token_counts(no_docs, WORD).count() == 0


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.integers(0, 3), st.integers(0, 50_256), st.integers(0, 2**64 - 1)), max_size=700))
def test_simple8b_round_trip(values):
    array = np.array(values, dtype=np.uint64)
    words, escapes, offsets = simple8b.encode(array)
    assert (simple8b.decode(words, escapes) == array).all()
    assert len(offsets) == -(-len(words) // simple8b.BLOCK)


def test_packs_every_id_once(docs, no_docs):
    rows = packing.packed(docs, WORD, capacity=64).collect()
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault((r.doc_id, r.doc_tokens), []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    for i, t in TEXTS:
        want = [*ids(WORD, t), 1]
        own = sorted(by_doc[i, len(want)], key=lambda r: r.start)
        at = 0
        for r in own:
            piece = np.array(want[at : at + r.length], dtype="<u4").tobytes()
            assert (r.start, r.ids_crc32) == (at, zlib.crc32(piece))
            at += r.length
        assert at % len(want) == 0
    for own in by_sequence.values():
        own.sort(key=lambda r: r.offset)
        assert [r.offset for r in own] == np.cumsum([0, *[r.length for r in own[:-1]]]).tolist()
        total = sum(r.length for r in own)
        assert total == 64 or total & (total - 1) == 0 and total < 64
    assert packing.packed(no_docs, WORD).count() == 0


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=80), st.integers(1, 6))
def test_sum_of_squares_choice(sizes, most_open):
    """Each choice against all others, by the sum of squares that they lead to."""
    c = 16
    p = packing.Packer(c, most_open)

    def after(level, size):
        levels = p.levels.copy()
        levels[level] -= level > 0
        to = (level + size) % c
        levels[to] += to > 0
        return int((levels * levels).sum())

    for n, size in enumerate(sizes):
        rest, new = size % c, p.count < most_open
        if rest:
            options = [h for h in range(1, c) if p.levels[h]] + [0] * (new or not p.count)
            least = min(after(h, rest) for h in options)
            assert after(p.choose(rest, new), rest) == least
        p.add(n, b"abcd" * size)
        assert p.count <= most_open and (rest == 0 or int((p.levels**2).sum()) == least)
        assert p.count == p.levels.sum() == sum(map(len, p.open.values()))
    p.finish()
    fills = [sum(map(len, s)) for s in p.closed]
    assert sum(fills) == sum(sizes) and sum(f < c for f in fills) <= 4 and all(f & (f - 1) == 0 for f in fills)


def test_the_rule_places_nearly_all():
    rng = np.random.default_rng(3)
    for low, high in ((20, 4000), (1100, 2040)):
        p, sizes = packing.Packer(2048), rng.integers(low, high, 4000).tolist()
        for size in sizes:
            p.add(0, bytes(4 * size))
        assert sum(len(x) for s in p.closed for x in s) >= 0.95 * sum(sizes)


def test_token_files(spark, docs, no_docs, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfile, "MOST_IDS", 40)
    path = str(tmp_path / "files")
    tokenfile.write_token_files(docs, path, BYTE)
    got = sorted(map(tuple, tokenfile.read_token_files(spark, path).collect()), key=lambda r: r[1])
    start = 0
    for (i, t), row in zip(sorted(((i, t) for i, t in TEXTS if i != 9), key=lambda x: x[0] or 0), [r for r in got if r[0] != 9], strict=True):
        want = [*ids(BYTE, t), 0]
        if (i or 0) > 9:
            start = row[1]
        assert row == (i, start, len(want), zlib.crc32(np.array(want, dtype="<u4").tobytes()))
        start += len(want)
    assert [r[1] for r in got] == np.cumsum([0, *[r[2] for r in got[:-1]]]).tolist()
    tokenfile.write_token_files(no_docs, str(tmp_path / "none"), BYTE)
    assert tokenfile.read_token_files(spark, str(tmp_path / "none")).count() == 0


def test_token_files_of_the_default_size(spark):
    """The registered query against the library, images of the default size."""
    rows = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = sorted(map(tuple, queries.op3_token_files(spark, SF).select("doc_id", "start", "n_tokens", "ids_crc32").collect()))
    start = 0
    for (i, t), row in zip(rows, got, strict=True):
        want = [*ids(BYTE, t), 0]
        assert row == (i, start, len(want), zlib.crc32(np.array(want, dtype="<u4").tobytes()))
        start += len(want)


def test_memory_of_words_is_bounded(monkeypatch):
    monkeypatch.setattr(wordids, "REMEMBERED", 5000)
    words = wordids.WordIds(BYTE)
    text = " ".join(f"w{i} É{i}" for i in range(300)) + " " + "z" * 6000
    assert np.frombuffer(words.ids(text), dtype="<u4").tolist() == ids(BYTE, text)
    assert words.held <= 2500 and len(words) + len(words.older) < 30


@pytest.mark.parametrize("segment", [1, 7, 120, 1000])
def test_segments_join(monkeypatch, segment):
    monkeypatch.setattr(simple8b, "SEGMENT", segment)
    values = np.array([0] * 500 + [2**63, 1, 2**61] * 40 + list(range(900)), dtype=np.uint64)
    words, escapes, offsets = simple8b.encode(values)
    assert (simple8b.decode(words, escapes) == values).all() and len(offsets) == -(-len(words) // simple8b.BLOCK)


def test_image_slices():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 50_000, 5000)
    image = tokenfile.Image(tokenfile.image_of([None, -5, 9], [1000, 3000, 1000], values, 17))
    assert image.keys().to_pylist() == [None, -5, 9] and image.before == 17
    assert image.ids_between(1234, 3456).tolist() == values[1234:3456].tolist()

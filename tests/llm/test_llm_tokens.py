import zlib

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from llm_cases import nothing, odd  # noqa: F401
from public_tokenizers import path
from tokenizers import Tokenizer

from tableloom.llm import packing, tokenfiles
from tableloom.llm.tokens import VOCABULARY, TextEncoder, encoder


def plain(text):
    return encoder().tokenizer.encode(text or "", add_special_tokens=False).ids


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet="abT .,'sé\n\t  ßж漢1²<|>\x00\x1f\x1c🙂", max_size=60))
def test_ids_are_those_of_the_whole_text(text):
    assert np.frombuffer(encoder().encode(text), "<u4").tolist() == plain(text)


def test_special_strings_and_long_words():
    for text in ("<|endoftext|> x <|endoftext|>", "x" * 5000, "it's they'll  we've", " lead", "trail ", "a \n b"):
        assert np.frombuffer(encoder().encode(text), "<u4").tolist() == plain(text)


def test_ids_are_those_of_a_fresh_tokenizer():
    fresh = Tokenizer.from_file(path(VOCABULARY))
    assert [x for x in fresh.get_vocab() if "\u0100" in x] == ["\u0100"]  # no merge crosses the mark between pieces
    texts = ["a foo\n\n", "a quux zyzzy foo bar\n\n", "b corge\n\n\n grault garply\n\n\n", "b é\n\nü ö\n\n", "a foo", "one <|endoftext|> two\n\n", "a<|endoftext|>b c"]
    for order in (texts, texts[::-1]):
        own = TextEncoder(path(VOCABULARY))
        for text in order:
            assert np.frombuffer(own.encode(text), "<u4").tolist() == fresh.encode(text, add_special_tokens=False).ids, text


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 2**32 - 1), max_size=40))
def test_ranks_round_trip(values):
    ranks = np.array(values, dtype=np.uint32)
    control, data = tokenfiles.encode_ranks(ranks)
    assert len(control) == (len(values) + 3) // 4
    assert tokenfiles.decode_ranks(control, data, len(values)).tolist() == values


def test_files_hold_every_document_in_order(spark, odd, tmp_path, monkeypatch):
    monkeypatch.setattr(tokenfiles, "BLOCK", 5_000)  # the long document goes over several blocks
    manifest = tokenfiles.write(odd, str(tmp_path / "tokens"))
    rows = tokenfiles.read(spark, manifest, with_ids=True).orderBy("start").collect()
    want = sorted(((r.doc_id, r.text) for r in odd.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    start = 0
    for row, (doc_id, text) in zip(rows, want, strict=True):
        ids = np.array([*plain(text), 0], dtype="<u4")
        assert (row.doc_id, row.start, row.n_tokens, row.ids_crc32) == (doc_id, start, len(ids), zlib.crc32(ids.tobytes()))
        assert bytes(row.ids) == ids.tobytes()
        start += len(ids)
    assert sorted(p.suffix for p in (tmp_path / "tokens").iterdir()) == [".bin"] * (manifest.count() + 1)


def test_frequent_ids_take_one_byte(frame, tmp_path):
    docs = frame([(k, "the " * 300) for k in range(4)], "doc_id bigint, text string")
    manifest = tokenfiles.write(docs, str(tmp_path / "t")).collect()
    ids = sum(m.n_tokens for m in manifest)
    assert sum((tmp_path / "t" / m.name.rpartition("/")[2]).stat().st_size for m in manifest) < 1.4 * ids + 400


def test_no_documents(nothing):
    assert tokenfiles.round_trip(nothing).count() == 0
    assert packing.pack(nothing).count() == 0


@pytest.mark.parametrize("window", [16, 64])
def test_packing_places_every_id_once(odd, window):
    rows = packing.pack(odd, window=window, with_ids=True).toPandas()
    got = rows.groupby(["doc_id", "start"], dropna=False).size().sum()
    want = sum(-(-(len(plain(r.text)) + 1) // window) for r in odd.collect())
    assert got == want
    q = rows.sort_values(["sequence_id", "offset"])
    assert ((q.groupby("sequence_id").length.cumsum() - q.length) == q.offset).all()
    assert q.groupby("sequence_id").length.sum().max() <= window
    assert sorted(q.sequence_id.unique()) == list(range(q.sequence_id.nunique()))
    for r in rows.itertuples():
        assert len(r.ids) == 4 * r.length and zlib.crc32(r.ids) == r.ids_crc32
    long = rows[rows.doc_id == 4].sort_values("start")
    assert b"".join(long.ids) == np.array([*plain(odd.where("doc_id = 4").first().text), 0], dtype="<u4").tobytes()


@settings(max_examples=40, deadline=None)
@given(st.lists(st.integers(0, 30), min_size=20, max_size=20))
def test_plans_use_up_the_histogram(counts):
    histogram = np.array([0, *counts])
    used = np.zeros_like(histogram)
    patterns = packing.plan(histogram)
    for pattern, n in patterns:
        assert n > 0 and sum(pattern) <= 20
        for length in pattern:
            used[length] += n
    assert (used == histogram).all()
    places = packing.Places(patterns, 20)
    taken = {}
    for length, n in enumerate(histogram.tolist()):
        if n:
            s, o = places.find(np.full(n, length), np.arange(n))
            for a, b in zip(s.tolist(), o.tolist(), strict=True):
                taken.setdefault(a, []).append((b, length))
    assert len(taken) == places.sequences
    for parts in taken.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length


def test_combinations_are_all_of_them():
    have = np.array([1, 2, 3, 5, 7, 8, 12])
    got = {tuple(int(x) for x in r if x) for r in packing.combinations(have, 12)}
    want = {tuple(sorted(c, reverse=True)) for a in have for b in [0, *have] for c3 in [0, *have] for c in [[int(x) for x in (a, b, c3) if x]] if sum(c) == 12}
    assert got == want


def test_little_padding():
    rng = np.random.default_rng(0)
    histogram = np.bincount(np.clip(rng.geometric(0.004, 200_000), 1, 1024), minlength=1025)
    patterns = packing.plan(histogram)
    filled = sum(n * sum(p) for p, n in patterns)
    assert filled == (histogram * np.arange(1025)).sum() and filled > 0.995 * 1024 * sum(n for _, n in patterns)


def test_texts_learned_together_have_the_ids_of_each(monkeypatch):
    from tableloom.llm import tokens

    monkeypatch.setattr(tokens, "_TOGETHER", 300)
    own = tokens.TextEncoder(tokens.public_tokenizers.path(tokens.VOCABULARY), words=40, parts=20)
    texts = [f"word{k} it's, don't-{k % 7}! naïveté{k}\nline{k % 5} the,the a\nb 12{k}.5 \x00x{k} é{'x' * k}" for k in range(60)]
    texts += [None, "", " ", "a", "a  b", "a \n b", "end\n", "\n\nstart it", "tab\there you're", "日本 語 text{}", "<|endoftext|> x <|endoftext|>", "\x1f a \x1f"]
    learned = []
    learn = own._learn
    monkeypatch.setattr(own, "_learn", lambda pieces: learned.append(pieces) or learn(pieces))
    for _ in range(2):
        assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [plain(t) for t in texts]
    assert len(learned) < 2 * len(texts) / 2  # not once for each text


def test_each_different_word_is_looked_up_once():
    class Known(dict):
        asked = 0

        def get(self, key, default=None):
            self.asked += 1
            return super().get(key, default)

    own = TextEncoder(path(VOCABULARY))
    own.known = Known()
    texts = ["the cat and the dog and the cat\nand " * 50, None, "", "a the  cat <|endoftext|>", "the  dog \n the\t dog"] * 20
    held = pa.array(["left out", *texts], pa.string()).slice(1)
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(held)] == [plain(t) for t in texts]
    assert own.known.asked < 20  # not once for each of the 9000 words


@pytest.mark.parametrize("space", [*filter(str.isspace, map(chr, range(0x10000))), "\u180e", "\u200b", "\ufeff"])
def test_white_space_of_any_kind(space):
    own = TextEncoder(path(VOCABULARY), words=5)
    ends = [f"{space}", f"{space} ", f" {space}", f" {space} ", f"{space}{space} ", f" {space}{space}"]
    texts = [t for e in ends for t in (f"ab{e}cd", f"ab{e}cd ef{e}", f"{e}ab", f"ab é{e}1 's{e}x", e)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [plain(t) for t in texts]


def test_small_batches_are_joined_and_large_ones_stay_alone(monkeypatch):
    from tableloom.llm import tokens

    monkeypatch.setattr(tokens, "_TOGETHER", 1000)
    sizes = [100, 0, 100, 500, 5000, 20, 600, 30]
    batches = [pa.record_batch({"doc_id": [k], "text": ["x" * n]}) for k, n in enumerate(sizes)]
    got = list(tokens.joined(iter(batches)))
    assert [len(b) for b in got] == [4, 1, 2, 1]
    assert pa.Table.from_batches(got).to_pydict() == pa.Table.from_batches(batches).to_pydict()
    assert list(tokens.joined(iter([]))) == []


def test_long_pieces_are_encoded_alone(monkeypatch):
    own = TextEncoder(path(VOCABULARY))
    together = []
    joined = own._joined
    monkeypatch.setattr(own, "_joined", lambda pieces: together.append(sum(map(len, pieces))) or joined(pieces))
    texts = [f"漢字{k}" * 400 + f" x{k} " + f"語{k}" * 300 + "  end" for k in range(50)]
    assert [np.frombuffer(x, "<u4").tolist() for x in own.encode_all(texts)] == [plain(t) for t in texts]
    assert together == [sum(len(f"x{k}") for k in range(50)) + len("end")]

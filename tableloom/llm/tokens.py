"""Texts to token ids with a byte-level vocabulary of the tokenizers library."""

from __future__ import annotations

import functools
import os
import re
from collections.abc import Iterable, Iterator

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

VOCABULARY = "byte_bpe_50k.json"

# Ends every document in ids.
END = np.zeros(1, dtype="<u4").tobytes()

# A space before a character that is not white space always starts a new
# pre-token, so a text may be cut before it without changing its ids.
_CUT = re.compile(r" (?=\S)")
# Texts that hold this are not cut at every space. Arrow's patterns know no other white space than ASCII.
_SPACES = r" [\s\x0B\x1C-\x1F\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]"
_KEPT_CHARS = 48
# Bytes of the texts whose words are looked up together, about.
_TOGETHER = 10_000_000
# Unknown words that the library gets as one text; it is slower with much longer ones.
_JOINED = 300


class TextEncoder:
    """Encodes whole texts; ids of words, and in the library those of pre-tokens, are kept in two bounded caches per worker."""

    def __init__(self, path: str, words: int = 300_000, parts: int = 10_000):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.model._resize_cache(parts)
        # The library takes the strings of special tokens out of a text first, so a text with one is not cut.
        special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.whole = re.compile("|".join(map(re.escape, special))) if special else None
        self.hard = "|".join([_SPACES, *map(re.escape, special)])
        vocabulary = self.tokenizer.get_vocab()
        # Ids that start with a space, which byte-level vocabularies write as this letter.
        self.opens = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.opens[[k for t, k in vocabulary.items() if t[0] == "\u0120"]] = True
        self.room, self.known = words, {}

    def _plain(self, texts: list[str]) -> list[bytes]:
        # One at a time, as the library needs much more memory than the text it encodes.
        found = (self.tokenizer.encode_batch_fast([t], add_special_tokens=False)[0].ids for t in texts)
        return [np.array(ids, dtype="<u4").tobytes() for ids in found]

    def _joined(self, pieces: list[str]) -> list[bytes]:
        """Ids of short pieces that have no space in them, each after one."""
        ids = np.array(self.tokenizer.encode_batch_fast([" " + " ".join(pieces)], add_special_tokens=False)[0].ids, dtype="<u4")
        at = (4 * np.flatnonzero(self.opens[ids])).tolist()
        if len(at) != len(pieces):  # no byte-level vocabulary
            return self._plain([" " + p for p in pieces])
        raw = ids.tobytes()
        return [raw[a:b] for a, b in zip(at, [*at[1:], len(raw)], strict=True)]

    def _learn(self, pieces: list[str]) -> dict[str, bytes]:
        """Ids of different pieces, each after a space."""
        got, common, others = {}, [], []
        for p in pieces:
            (others if not p or len(p) > _KEPT_CHARS or " " in p or p[0].isspace() else common).append(p)
        for k in range(0, len(common), _JOINED):
            some = common[k : k + _JOINED]
            got.update(zip(some, self._joined(some), strict=True))
        got.update(zip(others, self._plain([" " + p for p in others]), strict=True))
        if len(self.known) < self.room:
            self.known.update((p, ids) for p, ids in got.items() if len(p) <= _KEPT_CHARS)
        return got

    def encode(self, text: str | None) -> bytes:
        """The ids as little-endian unsigned 32-bit integers, without an end id; null is empty."""
        return next(self.encode_all([text]))

    def encode_all(self, texts: Iterable[str | None] | pa.Array) -> Iterator[bytes]:
        """``encode`` of each text; each different word of about ten megabytes is looked up once, unknown ones are encoded together."""
        texts = texts if isinstance(texts, pa.Array) else pa.array(list(texts), pa.large_string())
        texts = pc.fill_null(texts, "")
        ends = np.cumsum(pc.binary_length(texts).to_numpy(zero_copy_only=False), dtype=np.int64)
        begin = 0
        while begin < len(texts):
            before = ends[begin - 1] if begin else 0
            end = int(np.searchsorted(ends, before + _TOGETHER)) + 1
            yield from self._together(texts[begin:end])
            begin = end
        pa.default_memory_pool().release_unused()  # a worker that waits keeps its cache alone

    def _pieces(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The pieces of each text, and where each text lies among them."""
        hard = pc.match_substring_regex(texts, self.hard)
        if not pc.any(hard).as_py():
            return pc.split_pattern(texts, " "), np.arange(len(texts))
        cut = [[t] if self.whole and self.whole.search(t) else _CUT.split(t) for t in texts.filter(hard).to_pylist()]
        easy = pc.split_pattern(texts.filter(pc.invert(hard)), " ")
        hard = hard.to_numpy(zero_copy_only=False)
        row = np.empty(len(texts), dtype=np.int64)
        row[~hard], row[hard] = np.arange(len(easy)), np.arange(len(easy), len(texts))
        return pa.concat_arrays([easy, pa.array(cut, easy.type)]), row

    def _together(self, texts: pa.Array) -> Iterator[bytes]:
        split, row = self._pieces(texts)
        words, cuts = split.flatten(), split.offsets.to_numpy() - split.offsets[0].as_py()
        # The first piece of a text has no space before it.
        later = np.ones(len(words), dtype=bool)
        later[cuts[:-1]] = False
        firsts = words.take(pa.array(cuts[:-1])).dictionary_encode()
        rest = words.filter(pa.array(later)).dictionary_encode()
        pieces = rest.dictionary.to_numpy(zero_copy_only=False).tolist()
        ids = list(map(self.known.get, pieces))
        if missing := [k for k, raw in enumerate(ids) if raw is None]:
            got = self._learn([pieces[k] for k in missing])
            for k in missing:
                ids[k] = got[pieces[k]]
        number = np.empty(len(words), dtype=np.int64)
        number[later] = rest.indices.to_numpy()
        number[~later] = firsts.indices.to_numpy() + len(ids)
        found = pa.array(ids + self._plain(firsts.dictionary.to_numpy(zero_copy_only=False).tolist()), pa.large_binary()).take(pa.array(number))
        _, offsets, data = found.buffers()
        ends = np.frombuffer(offsets, dtype=np.int64)[cuts].tolist()
        raw = memoryview(data or b"")
        for k in row.tolist():
            yield bytes(raw[ends[k] : ends[k + 1]])

    def encode_document(self, text: str | None) -> np.ndarray:
        """Ids of a text with the end id."""
        return next(self.encode_documents([text]))

    def encode_documents(self, texts: Iterable[str | None] | pa.Array) -> Iterator[np.ndarray]:
        """``encode_document`` of each text."""
        for raw in self.encode_all(texts):
            yield np.frombuffer(raw + END, dtype="<u4")


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows in batches of over half the bytes that the encoder takes together, as far as there are so many."""
    held, size = [], 0
    for batch in batches:
        if held and batch.nbytes > _TOGETHER:  # a large one stays alone, as Arrow bounds the text in a batch
            yield pa.concat_batches(held)
            held, size = [], 0
        held.append(batch)
        size += batch.nbytes
        if size > _TOGETHER // 2:
            yield pa.concat_batches(held)
            held, size = [], 0
    if held:
        yield pa.concat_batches(held)


@functools.cache
def encoder(name: str = VOCABULARY) -> TextEncoder:
    """One encoder per Python worker. ``name`` is a file of ``public_tokenizers`` or a path."""
    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    return TextEncoder(name if os.path.isabs(name) else public_tokenizers.path(name))

"""Whole texts to token ids with the ``tokenizers`` library, inside the tasks."""

from __future__ import annotations

import contextlib
import ctypes
import gc
import re
import sys
from array import array
from collections.abc import Callable, Iterable, Iterator
from typing import Any

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc

WORD_BPE = public_tokenizers.path("word_bpe_49k.json")
"""Default vocabulary file; it lies at the same path on every machine."""

LETTERS = "".join(c for c in map(chr, range(0x100)) if c.isascii() and c.isalpha() or c >= "À" and c.isalpha())
TAIL = "!\"#$%&()*+,-./:;=?@[\\]^_`{}~"
"""Punctuation that stands in one unit with any that follows; an apostrophe can begin a unit of its own, and a special token has angle brackets."""
PLAIN = rf"^[{LETTERS}]+[{re.escape(TAIL)}]*$"
NONE = pa.scalar(b"", pa.large_binary())


def release() -> None:
    """Give freed memory back to the machine, where the worker's allocators can."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with contextlib.suppress(OSError, AttributeError):
        ctypes.CDLL("libc.so.6").malloc_trim(0)


def free_name(base: str, columns: Iterable[str]) -> str:
    """``base``, with underscores before it until no column has that name in any case."""
    taken = {c.lower() for c in columns}
    while base.lower() in taken:
        base = f"_{base}"
    return base


def per_process(user: str, key: Any, make: Callable[[], Any]) -> Any:
    """A value that outlives a task in its Python worker, until another ``user`` works there.

    Functions travel to the tasks by value, so their module's globals do not outlive a task. A worker
    serves many stages, and the tables of one must not lie beside those of the next.
    """
    kept = sys.__dict__.setdefault("_folioscope_kept", {})
    if kept.get("user") != user:
        kept.clear()
        kept["user"] = user
        release()
    if key not in kept:
        kept[key] = make()
    return kept[key]


def small_parts(batches: Iterator[pa.RecordBatch], rows: int = 1024) -> Iterator[pa.RecordBatch]:
    """The batches in slices of a few rows, as texts take more room in Python than in Arrow."""
    for batch in batches:
        for first in range(0, batch.num_rows, rows):
            yield batch.slice(first, rows)


class WordEncoder:
    """Ids, as unsigned 32-bit integers (little-endian machines are assumed), of texts.

    The word-BPE tokenizer drops white space before it looks for pieces, so a text's ids are those of
    its chunks between spaces, one after another. Arrow cuts a batch of texts into chunks and numbers the
    different ones, and Python meets each of those once per batch. A run of Latin letters is one unit of that
    tokenizer, and so is the punctuation after it; such chunks are looked up by their two parts, the
    letters in lower case. All others go through the whole tokenizer.
    """

    def __init__(self, path: str, max_entries: int = 100_000):
        """``max_entries`` bounds each of the two generations of parts kept from batch to batch; an entry takes about 200 bytes."""
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.max_entries = max_entries
        self.parts: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}
        letters = [c for c in map(chr, range(0xC0, 0x100)) if c.isalpha()]
        self.units = str.maketrans({c: self.tokenizer.pre_tokenizer.pre_tokenize_str(c)[0][0] for c in letters})

    def _word(self, word: str) -> bytes:
        """A lower-case run of letters as one unit of the model."""
        return array("I", [t.id for t in self.model.tokenize(word if word.isascii() else word.translate(self.units))]).tobytes()

    def _whole(self, chunk: str) -> bytes:
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def _each(self, parts: pa.Array, make: Callable[[str], bytes]) -> pa.Array:
        """Ids of every part; ``make`` gives those that are not kept."""
        out = []
        for part in parts.to_numpy(zero_copy_only=False).tolist():
            ids = self.parts.get(part)
            if ids is None:
                ids = self.older.get(part)
                if ids is None:
                    ids = make(part)
                if len(part) <= 64:
                    if len(self.parts) >= self.max_entries:
                        self.older, self.parts = self.parts, {}
                    self.parts[part] = ids
            out.append(ids)
        return pa.array(out, pa.large_binary())

    def _different(self, parts: pa.Array, make: Callable[[str], bytes]) -> pa.Array:
        numbered = parts.dictionary_encode()
        return self._each(numbered.dictionary, make).take(numbered.indices)

    def _chunks(self, chunks: pa.Array) -> pa.Array:
        plain = pc.match_substring_regex(chunks, PLAIN)
        whole = self._each(chunks.filter(pc.invert(plain)), self._whole)
        halves = chunks.filter(plain)
        words = self._different(pc.utf8_lower(pc.utf8_rtrim(halves, TAIL)), self._word)
        tails = self._different(pc.utf8_ltrim(halves, LETTERS), self._whole)
        place = np.empty(len(chunks), np.int64)
        plain = plain.to_numpy(zero_copy_only=False)
        place[plain], place[~plain] = np.arange(len(words)), len(words) + np.arange(len(whole))
        return pa.concat_arrays([pc.binary_join_element_wise(words, tails, NONE), whole]).take(pa.array(place))

    def encode_all(self, texts: pa.Array, end: bytes = b"") -> pa.Array:
        """Large binaries: the ids of every text, and ``end`` after them; a null text counts as an empty one."""
        if not len(texts):
            return pa.array([], pa.large_binary())
        different = texts.fill_null("").dictionary_encode()  # copies in a batch are encoded once
        split = pc.split_pattern(pc.replace_substring(different.dictionary, "\n", " "), " ")
        chunks = split.flatten().dictionary_encode()
        ids = self._chunks(chunks.dictionary).take(chunks.indices)
        _, offsets, data = ids.buffers()
        places = np.frombuffer(offsets, np.int64)[split.offsets.to_numpy()]
        joined = pa.Array.from_buffers(pa.large_binary(), len(split), [None, pa.py_buffer(places), data])
        if end:
            joined = pc.binary_join_element_wise(joined, pa.scalar(end, pa.large_binary()), NONE)
        return joined if len(joined) == len(texts) else joined.take(different.indices)

    def encode(self, text: str | None) -> bytes:
        return self.encode_all(pa.array([text], pa.string()))[0].as_py()


def word_encoder(path: str = WORD_BPE) -> WordEncoder:
    return per_process("tokens", path, lambda: WordEncoder(path))

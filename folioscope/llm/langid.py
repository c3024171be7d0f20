"""Language ID by unigram pieces, marginalised over all segmentations.

Every language has a probability for each piece of one fixed public vocabulary. A word's
probability is the sum over all ways to cut it into pieces, which the forward algorithm finds
in one pass; a text's is the product over its words. The piece probabilities are fitted by
expectation maximisation over the word counts of labelled texts: each pass sends expected piece
counts, at most one per piece and language, to the driver.
"""

from __future__ import annotations

import base64
import re
import uuid
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from folioscope.llm.tokens import free_name, per_process, small_parts
from folioscope.plans.scale import bound_batches, materialise

VOCABULARY = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
UNKNOWN = "und"
RUN = re.compile(r"[^\W\d_]+")
LEARN_RUN = re.compile(r"[^\W\d_]{1,40}")
"""Runs that are learnt from; a longer one is learnt from in parts. All of it is scored as one word."""
LONG = 200
"""Bytes from which a word is scored by itself, a stretch at a time."""
BASE = np.uint64(0x9E3779B97F4A7C15)
CACHED = 100_000
SLICE = 1 << 20


def slices(texts: list[str | None]) -> Iterator[tuple[int, list[str]]]:
    """Runs of whole texts with about ``SLICE`` characters together, and the first one's place."""
    first, size = 0, 0
    for i, text in enumerate(texts):
        size += len(text or "")
        if size >= SLICE or i + 1 == len(texts):
            yield first, [t or "" for t in texts[first : i + 1]]
            first, size = i + 1, 0


def pieces_of(path: str) -> list[bytes]:
    """The pieces of a vocabulary file of ranks, with every single byte, so that any text has a segmentation."""
    with open(path, "rb") as file:
        found = {base64.b64decode(line.split()[0]) for line in file if line.strip()}
    return sorted(found | {bytes([b]) for b in range(256)})


def _hashes(pieces: list[bytes]) -> np.ndarray:
    out = np.zeros(len(pieces), np.uint64)
    for i, piece in enumerate(pieces):
        value = 0
        for byte in piece:
            value = (value * int(BASE) + byte + 1) & 0xFFFFFFFFFFFFFFFF
        out[i] = value
    return out


def as_word(run: str) -> bytes | None:
    """A run of letters as it is cut into pieces; None without a letter."""
    letters = "".join(filter(str.isalpha, run))
    return b" " + letters.encode("utf-8", "replace") if letters else None


@dataclass
class Pieces:
    """Vocabulary, looked up by hash in arrays."""

    path: str
    hashes: np.ndarray = field(init=False)
    order: np.ndarray = field(init=False)
    longest: int = field(init=False)

    def __post_init__(self):
        pieces = pieces_of(self.path)
        hashes = _hashes(pieces)
        self.longest = max(map(len, pieces))
        self.order = np.argsort(hashes)
        self.hashes = hashes[self.order]

    def lattice(self, words: list[bytes]) -> list[list[tuple[int, np.ndarray]]]:
        """For words of one length: at each end, the piece lengths and the pieces there (-1: none)."""
        letters = np.frombuffer(b"".join(words), np.uint8).reshape(len(words), -1).astype(np.uint64) + np.uint64(1)
        width = letters.shape[1]
        ends: list[list[tuple[int, np.ndarray]]] = [[] for _ in range(width + 1)]
        running = np.zeros_like(letters)
        for n in range(1, min(self.longest, width) + 1):
            running = running[:, : width - n + 1] * BASE + letters[:, n - 1 :]
            at = np.minimum(np.searchsorted(self.hashes, running), len(self.hashes) - 1)
            piece = np.where(self.hashes[at] == running, self.order[at], -1)
            for start in np.flatnonzero((piece >= 0).any(axis=0)):
                ends[start + n].append((n, piece[:, start]))
        return ends


def _forward(ends, chance: np.ndarray, n_words: int) -> tuple[list[np.ndarray], np.ndarray]:
    """Scaled forward sums at every place, and the log probability of each word by language.

    ``chance`` has a row for each piece and a last row of zeros for no piece. What is kept of
    earlier places is scaled along, so that the last sum is relative to ``scale``.
    """
    langs = chance.shape[1]
    sums = [np.ones((n_words, langs))]
    scale = np.zeros((n_words, 1))
    longest = max((n for found in ends for n, _ in found), default=0)
    for end in range(1, len(ends)):
        total = np.zeros((n_words, langs))
        for n, piece in ends[end]:
            total += sums[end - n] * chance[piece]
        top = total.max(axis=1, keepdims=True)
        scale += np.log(top)
        sums.append(total / top)
        for back in range(max(0, end - longest), end):
            sums[back] = sums[back] / top
    with np.errstate(divide="ignore"):
        return sums, np.maximum(np.log(sums[-1]), -700.0) + scale


def _long_forward(pieces: Pieces, chance: np.ndarray, word: bytes, stretch: int = 1 << 15) -> np.ndarray:
    """The same sum for one word of any length, with as many earlier places in hand as the longest piece has bytes."""
    longest, langs = pieces.longest, chance.shape[1]
    recent = np.zeros((longest, langs))  # row k: the sum k + 1 places back, relative to ``scale``
    recent[0], scale = 1.0, 0.0
    for first in range(0, len(word), stretch):
        start = max(0, first - longest + 1)
        ends = pieces.lattice([word[start : first + stretch]])
        for end in ends[first - start + 1 :]:
            n, piece = np.array([n for n, _ in end]), np.array([p[0] for _, p in end])
            total = (recent[n - 1] * chance[piece]).sum(axis=0)
            top = total.max()
            scale += np.log(top)
            recent[1:] = recent[:-1] / top
            recent[0] = total / top
    with np.errstate(divide="ignore"):
        return np.maximum(np.log(recent[0]), -700.0) + scale


def log_chances(pieces: Pieces, chance: np.ndarray, words: list[bytes]) -> np.ndarray:
    """Log probability of each word under each language, over all segmentations."""
    padded = np.vstack([chance, np.zeros(chance.shape[1])])
    out = np.zeros((len(words), chance.shape[1]))
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        if len(word) > LONG:
            out[i] = _long_forward(pieces, padded, word)
        else:
            by_length.setdefault(len(word), []).append(i)
    for rows in by_length.values():
        for first in range(0, len(rows), 4096):
            part = rows[first : first + 4096]
            out[part] = _forward(pieces.lattice([words[i] for i in part]), padded, len(part))[1]
    return out


def expected_counts(pieces: Pieces, chance: np.ndarray, words: list[bytes], counts: np.ndarray) -> np.ndarray:
    """Expected uses of each piece in ``words`` under one language (``chance`` has one column)."""
    padded = np.append(chance, 0.0)
    found = np.zeros(len(padded))
    by_length: dict[int, list[int]] = {}
    for i, word in enumerate(words):
        by_length.setdefault(len(word), []).append(i)
    for rows in by_length.values():
        for first in range(0, len(rows), 4096):
            part = np.array(rows[first : first + 4096])
            ends = pieces.lattice([words[i] for i in part])
            width = len(ends) - 1
            ahead, behind = np.zeros((width + 1, len(part))), np.zeros((width + 1, len(part)))
            grown = np.exp(4.0)  # a byte costs a few nats; without this long words underflow
            ahead[0] = behind[width] = 1.0
            for end in range(1, width + 1):
                for n, piece in ends[end]:
                    ahead[end] += ahead[end - n] * padded[piece] * grown**n
            for end in range(width, 0, -1):
                for n, piece in ends[end]:
                    behind[end - n] += behind[end] * padded[piece] * grown**n
            weight = counts[part] / np.maximum(ahead[width], 1e-300)
            for end in range(1, width + 1):
                for n, piece in ends[end]:
                    share = ahead[end - n] * padded[piece] * grown**n * behind[end] * weight
                    found += np.bincount(np.where(piece < 0, len(padded) - 1, piece), share, len(padded))
    return found[:-1]


@dataclass
class Model:
    """Piece probabilities (a column per language) and the share of texts per language."""

    path: str
    langs: list[str]
    chance: np.ndarray
    prior: np.ndarray
    key: str = field(default_factory=lambda: uuid.uuid4().hex)


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in small_parts(batches):
        counts: Counter = Counter()
        langs = batch.column("lang").to_pylist()
        for first, texts in slices(batch.column("text").to_pylist()):
            for i, text in enumerate(texts):
                counts.update((langs[first + i], run) for run in LEARN_RUN.findall(text.lower()))
        rows = [(lang, word, n) for (lang, run), n in counts.items() if (word := as_word(run))]
        lang, word, n = zip(*rows) if rows else ((), (), ())
        yield pa.RecordBatch.from_arrays([pa.array(lang, pa.string()), pa.array(word, pa.binary()), pa.array(n, pa.int64())], ["lang", "word", "n"])


def fit(docs: DataFrame, learn: Column, text_col: str, lang_col: str, id_col: str, vocabulary: str, max_rows: int, passes: int) -> Model | None:
    """Fit on about ``max_rows`` texts of each language among the rows that ``learn`` admits.

    The rows are those with the smallest hashes of their ids, so the same ones at every run.
    """
    spark = docs.sparkSession
    labelled = docs.where(learn & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull())
    shares = labelled.groupBy(F.col(lang_col).alias("lang")).count().orderBy("lang").collect()  # one row per language
    if not shares:
        return None
    grain = 1 << 20
    chosen = F.lit(False)
    for row in shares:
        chosen |= (F.col(lang_col) == row.lang) & (F.pmod(F.xxhash64(id_col), F.lit(grain)) < int(min(1, max_rows / row["count"]) * grain) + 1)
    sample = labelled.where(chosen).select(F.col(lang_col).alias("lang"), F.col(text_col).alias("text"))
    counted = sample.mapInArrow(_count_words, "lang string, word binary, n long").groupBy("lang", "word").agg(F.sum("n").alias("n"))
    counted = materialise(counted, "word-counts")

    langs = [row.lang for row in shares]
    size = len(pieces_of(vocabulary))
    chance = np.full((size, len(langs)), 1.0 / size)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(chance)

        def expect(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            pieces = per_process("langid", vocabulary, lambda: Pieces(vocabulary))
            found = np.zeros_like(shared.value)
            for batch in batches:
                lang = np.array([langs.index(x) for x in batch.column("lang").to_pylist()], np.int64)
                words, n = np.array(batch.column("word").to_pylist(), object), batch.column("n").to_numpy()
                for k in np.unique(lang):
                    found[:, k] += expected_counts(pieces, shared.value[:, k], list(words[lang == k]), n[lang == k])
            piece, k = np.nonzero(found)
            yield pa.RecordBatch.from_arrays([pa.array(piece, pa.int64()), pa.array(k, pa.int64()), pa.array(found[piece, k])], ["piece", "k", "uses"])

        uses = counted.mapInArrow(expect, "piece long, k long, uses double").groupBy("piece", "k").agg(F.sum("uses").alias("uses"))
        total = np.full_like(chance, 0.01)
        for row in uses.collect():  # at most one row per piece and language
            total[row.piece, row.k] += row.uses
        chance = total / total.sum(axis=0)
        shared.unpersist()
    prior = np.array([row["count"] for row in shares], float)
    return Model(vocabulary, langs, chance, prior / prior.sum())


class WordScores(dict):
    """Row in ``table`` of every run of letters met so far; row 0 is for runs without a letter."""

    def __init__(self, model: Model):
        self.model, self.pieces = model, per_process("langid", model.path, lambda: Pieces(model.path))
        self.table = np.zeros((1, len(model.langs)))

    def learn(self, runs: set[str]) -> None:
        new = [run for run in runs if run not in self]
        if len(self) + len(new) > CACHED:
            self.clear()
            self.table = self.table[:1]
            new = list(runs)
        words = [as_word(run) for run in new]
        real = [i for i, word in enumerate(words) if word]
        self.update((run, 0) for run, word in zip(new, words) if not word)
        self.update((new[i], len(self.table) + at) for at, i in enumerate(real))
        self.table = np.vstack([self.table, log_chances(self.pieces, self.model.chance, [words[i] for i in real])])


def scores_of(texts: list[str], words: WordScores) -> tuple[np.ndarray, np.ndarray]:
    """Log probability of every text by language, and how many words with letters it has."""
    runs = [RUN.findall(text.lower()) for text in texts]
    words.learn({run for found in runs for run in found})
    out, n = np.zeros((len(texts), words.table.shape[1])), np.zeros(len(texts), np.int64)
    for i, found in enumerate(runs):
        at = np.fromiter(map(words.__getitem__, found), np.int64, len(found))
        out[i], n[i] = words.table[at].sum(axis=0), np.count_nonzero(at)
    for run in [run for found in runs for run in found if len(run) > LONG]:
        words.pop(run, None)  # long ones are not kept
    return out, n


def _predict(shared, unlearnt: str, at: int, n_kept: int):
    """``at`` is the place of the text column; the first ``n_kept`` columns are returned with the results."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = Model(**shared.value) if shared.value else None
        kept = per_process("langid", "word scores", dict)
        if model and model.key not in kept:
            kept.clear()
            kept[model.key] = WordScores(model)
        for batch in small_parts(batches):
            lang, score = [UNKNOWN] * batch.num_rows, np.zeros(batch.num_rows)
            for first, texts in slices(batch.column(at).to_pylist()):
                if not model:
                    for i, text in enumerate(texts):
                        if any(as_word(run[0]) for run in RUN.finditer(text.lower())):
                            lang[first + i] = unlearnt
                    continue
                chance, n = scores_of(texts, kept[model.key])
                chance = chance + np.log(model.prior)
                share = np.exp(chance - chance.max(axis=1, keepdims=True))
                share /= share.sum(axis=1, keepdims=True)
                for i in np.flatnonzero(n):
                    best = int(share[i].argmax())
                    lang[first + i], score[first + i] = model.langs[best], share[i, best]
            yield pa.RecordBatch.from_arrays([*batch.columns[:n_kept], pa.array(lang, pa.string()), pa.array(score)], [*batch.schema.names[:n_kept], "lang_pred", "score"])

    return run


def identify(
    docs: DataFrame,
    learn: Column | None = None,
    keep: list[str] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    lang_col: str = "lang",
    vocabulary: str = VOCABULARY,
    max_rows: int = 1500,
    passes: int = 3,
    unlearnt: str = UNKNOWN,
) -> DataFrame:
    """``keep`` columns of every row with ``lang_pred`` and ``score``, the posterior of that language.

    Only texts and non-null labels of rows that ``learn`` admits (all, by default) are learnt from,
    about ``max_rows`` of each language. ``und`` with score 0 stands for a null text, a text
    without a letter; where no row is labelled, every text with a letter is ``unlearnt``. Ties go to the language first by name.
    Letters are those of Unicode; a run of them is one word, whatever its length. ``keep`` columns named
    like the two results are replaced.
    """
    learn = F.lit(True) if learn is None else learn
    bound_batches(docs.sparkSession)
    model = fit(docs, learn, text_col, lang_col, id_col, vocabulary, max_rows, passes)
    shared = docs.sparkSession.sparkContext.broadcast(model and vars(model))
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    kept = text_col in keep  # then the text travels once
    rows = docs.select(*keep, *([] if kept else [F.col(text_col).alias(free_name("_text", keep))]))
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*keep).schema)
    return rows.mapInArrow(_predict(shared, unlearnt, keep.index(text_col) if kept else len(keep), len(keep)), f"{schema}, lang_pred string, score double")

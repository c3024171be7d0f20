"""Phrase collocations, counted in burst hash tries.

Words are counted first, then phrases of two words, then those of three and four; an occurrence counts
only if its words, or its pairs of words, are frequent, which those of every frequent phrase are. Those travel as a bit array of
bounded size: a saturated one costs traffic and changes no result. A task counts in a trie over word ids whose leaves are hash
containers, which burst when they grow. When the trie is full, its largest subtrees leave as sorted runs. Runs meet
in partitions of the whole phrase, its longest prefix, as a shorter one can have a third of all rows, and are merged there.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from folioscope.llm.line_dedup import has, places, repeat_filter
from folioscope.llm.skew import join_hot
from folioscope.llm.tokens import per_process, small_parts
from folioscope.plans.scale import materialise

BREAKS = bytes.maketrans(b",;:!?\n\x0b\x0c\r\t", b"......... ")
"""Everything that ends a piece becomes a full stop, which no word holds."""
STOP = b"."
BITS = 20
"""Bits of a word id in a task; three fit a packed key."""
WORDS = 300_000
ENTRIES = 800_000
BURST = 32_768
PART = 1 << 20
"""Bytes of text that are taken apart together."""
ODD = np.uint64(0x9E3779B97F4A7C15)
PHRASES = "lang string, phrase string, length int, n long"


def mixed(names: np.ndarray, words: np.ndarray) -> np.ndarray:
    """Hashes of phrases one word longer."""
    with np.errstate(over="ignore"):
        names = (names * np.uint64(5) + words) * ODD
    return names ^ (names >> np.uint64(31))


class HatTrie:
    """Counts of keys of word ids: a shallow trie whose leaves are hash containers (dicts of counts by the whole key).

    A container serves a range of ids of its level. When it grows beyond ``BURST`` keys it bursts: into two ranges, or, where it
    serves a single id already, into a level below that goes by the next id.
    """

    def __init__(self, length: int, level: int = 0):
        self.length, self.level = length, level
        self.bounds = np.zeros(1, np.int64)
        self.children: list[Counter | HatTrie] = [Counter()]

    def keys_of(self, ids: np.ndarray) -> list:
        """A number for up to three ids, otherwise their bytes."""
        if self.length > 3:
            return ids.astype("<i4").view(f"V{4 * self.length}").ravel().tolist()
        packed = ids[:, 0]
        for k in range(1, self.length):
            packed = (packed << BITS) | ids[:, k]
        return packed.tolist()

    def ids_of(self, keys) -> np.ndarray:
        if self.length > 3:
            return np.frombuffer(b"".join(keys), "<i4").reshape(-1, self.length).astype(np.int64)
        packed = np.fromiter(keys, np.int64, len(keys))
        return np.stack([(packed >> (BITS * k)) & ((1 << BITS) - 1) for k in range(self.length - 1, -1, -1)], axis=1)

    def add(self, ids: np.ndarray) -> None:
        """Count the rows of ``ids``."""
        if len(self.children) == 1:
            slots, order, cuts = [0], slice(None), [0, len(ids)]
        else:
            slot = np.searchsorted(self.bounds, ids[:, self.level], "right") - 1
            order = np.argsort(slot.astype(np.uint16), kind="stable")  # a part has fewer words
            slots = np.unique(slot)
            cuts = [*np.searchsorted(slot[order], slots).tolist(), len(ids)]
            slots = slots.tolist()
        ids = ids[order]
        for i, a, b in zip(reversed(slots), reversed(cuts[:-1]), reversed(cuts[1:])):  # a burst moves later slots only
            child = self.children[i]
            if isinstance(child, HatTrie):
                child.add(ids[a:b])
            else:
                child.update(self.keys_of(ids[a:b]))
                if len(child) > BURST:
                    self._burst(i)

    def _burst(self, slot: int) -> None:
        full = self.children[slot]
        ids, counts = self.ids_of(full), np.fromiter(full.values(), np.int64, len(full))
        own = ids[:, self.level]
        middle = int(np.median(own)) if own.min() < own.max() else None
        if middle is not None:
            middle += middle == own.min()
            keys = self.keys_of(ids)
            low, high = Counter(), Counter()
            for key, n, above in zip(keys, counts.tolist(), (own >= middle).tolist()):
                (high if above else low)[key] = n
            self.bounds = np.insert(self.bounds, slot + 1, middle)
            self.children[slot : slot + 1] = [low, high]
        elif self.level + 1 < self.length:
            below = HatTrie(self.length, self.level + 1)
            below.children = [full]
            self.children[slot] = below

    def entries(self) -> int:
        return sum(c.entries() if isinstance(c, HatTrie) else len(c) for c in self.children)

    def _take(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        for child in self.children:
            if isinstance(child, HatTrie):
                yield from child._take()
            elif child:
                yield self.ids_of(child), np.fromiter(child.values(), np.int64, len(child))

    def spill(self, keep: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Take whole subtrees out, the largest first, until ``keep`` entries stay; ids and counts of each."""
        sizes = [c.entries() if isinstance(c, HatTrie) else len(c) for c in self.children]
        left = sum(sizes)
        for i in sorted(range(len(sizes)), key=sizes.__getitem__, reverse=True):
            if left <= keep:
                break
            left -= sizes[i]
            child, self.children[i] = self.children[i], Counter()
            if isinstance(child, HatTrie):
                yield from child._take()
            elif child:
                yield self.ids_of(child), np.fromiter(child.values(), np.int64, len(child))


class Words:
    """Ids of ``(lang, word)``; number 0 is the end of a piece."""

    def __init__(self):
        self.langs, self.words, self.hashes = [""], [STOP], np.zeros(1, np.uint64)
        self.tables: dict[str, dict[bytes, int]] = {}

    def ids(self, lang: str, found: list[bytes]) -> np.ndarray:
        table = self.tables.setdefault(lang, {STOP: 0})
        new = list(set(found).difference(table))
        salt = xxhash.xxh3_64_intdigest(lang.encode())
        table.update(zip(new, range(len(self.words), len(self.words) + len(new))))
        self.words.extend(new)
        self.langs.extend([lang] * len(new))
        self.hashes = np.append(self.hashes, np.fromiter((xxhash.xxh3_64_intdigest(w, salt) for w in new), np.uint64, len(new)))
        return np.fromiter(map(table.__getitem__, found), np.int64, len(found))


def parts(texts: list[bytes]) -> Iterator[bytes]:
    """The texts with piece ends as full stops, in parts that end between words; a long text gives several."""
    whole = b" . ".join(t.lower().translate(BREAKS).replace(STOP, b" . ") for t in texts)
    at = 0
    while at < len(whole):
        end = whole.find(b" ", at + PART)
        end = len(whole) if end < 0 else end
        yield whole[at:end]
        at = end


def _count(lengths: tuple[int, ...], shared, bits: int, shorter: int):
    def rows(tries: dict[int, HatTrie], words: Words, keep: int) -> Iterator[pa.RecordBatch]:
        texts, langs = pa.array(words.words, pa.binary()), pa.array(words.langs, pa.string())
        for trie in tries.values():
            for ids, counts in trie.spill(keep):
                phrase = pc.binary_join_element_wise(*[texts.take(pa.array(column)) for column in ids.T], b" ").cast(pa.string())
                run = pa.RecordBatch.from_arrays(
                    [langs.take(pa.array(ids[:, 0])), phrase, pa.array(np.full(len(ids), trie.length, np.int32)), pa.array(counts)], ["lang", "phrase", "length", "n"]
                )
                yield run.sort_by([("lang", "ascending"), ("phrase", "ascending")])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        per_process("phrases", "none", dict)  # frees the tables of earlier stages
        frequent = np.frombuffer(shared.value, np.uint8) if shared else None
        tries, words = {m: HatTrie(m) for m in lengths}, Words()
        for batch in small_parts(batches, 4096):
            by_lang: dict[str, list[bytes]] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                by_lang.setdefault(lang, []).append(text.as_py())
            for lang, texts in by_lang.items():
                before: list[bytes] = []
                for part in parts(texts):
                    found = [*before, *part.split()]
                    known = len(before)
                    before = found[len(found) - max(lengths) + 1 :] if max(lengths) > 1 else []
                    ids = words.ids(lang, found)
                    good = ids > 0
                    if shared:
                        m = len(ids) - shorter + 1
                        for k in range(1, shorter):
                            good = good[: max(m, 0)] & (ids[k : k + max(m, 0)] > 0)
                        at = np.flatnonzero(good)
                        hashes, names = words.hashes[ids], np.zeros(len(at), np.uint64)
                        for k in range(shorter):
                            names = mixed(names, hashes[at + k])
                        good[at] = has(frequent, places(names, bits))
                    for m in lengths:
                        n = len(ids) - m + 1
                        if n <= 0:
                            continue
                        whole = good[:n].copy()
                        for k in range(1, m - shorter + 1 if shared else m):
                            whole &= good[k : k + n]
                        whole[: max(known - m + 1, 0)] = False  # counted with the part before
                        at = np.flatnonzero(whole)
                        tries[m].add(np.stack([ids[at + k] for k in range(m)], axis=1))
                    if len(words.words) > WORDS:
                        yield from rows(tries, words, 0)
                        tries, words = {m: HatTrie(m) for m in lengths}, Words()
                    elif sum(t.entries() for t in tries.values()) > ENTRIES:
                        yield from rows(tries, words, ENTRIES // 2 // len(lengths))
        yield from rows(tries, words, 0)

    return run


def _names(batches: Iterator[pa.RecordBatch]) -> Iterator[np.ndarray]:
    """Hashes of phrases, each twice, so that the filter has all of them."""
    for batch in batches:
        found = []
        for lang, phrase in zip(batch.column("lang").to_pylist(), batch.column("phrase").to_pylist()):
            salt = xxhash.xxh3_64_intdigest(lang.encode())
            found.append([xxhash.xxh3_64_intdigest(w, salt) for w in phrase.encode().split(b" ")])
        columns = np.array(found, np.uint64).reshape(len(found), -1).T
        names = np.zeros(len(found), np.uint64)
        for column in columns:
            names = mixed(names, column)
        yield np.repeat(names, 2)


def phrase_counts(docs: DataFrame, lengths: tuple[int, ...], shorter: DataFrame | None = None, words: int = 0, max_filter_bits: int = 1 << 28) -> DataFrame:
    """``lang, phrase, length, n`` of the phrases of ``lengths`` words in ``docs (lang, text binary)``.

    With ``shorter``, the frequent phrases of ``words`` words, only phrases made of those are surely counted.
    """
    shared, bits = None, 0
    if shorter is not None:
        bits = min(max_filter_bits, 1 << max(13, (16 * shorter.count()).bit_length()))
        shared = docs.sparkSession.sparkContext.broadcast(repeat_filter(shorter.select("lang", "phrase"), bits, _names).tobytes())
    runs = docs.mapInArrow(_count(lengths, shared, bits, words), PHRASES)
    # dealt out first: the rows of a run are distinct, so that summing them where they are gains nothing
    return runs.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.first("length").alias("length"), F.sum("n").alias("n"))


def collocations(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", longest: int = 4, least: int = 30, contained: int = 80, top: int = 2000) -> DataFrame:
    """The ``top`` phrases of each language by how much their words keep together: ``lang, rank, phrase, a, l, r, n, score``.

    Words are what stands between spaces, tabs and the marks ``.,;:!?`` or line ends, with A-Z lower-cased; a phrase lies
    between two marks. Candidates have 2 to ``longest`` words and ``a`` occurrences, ``least`` or more. Of the cuts of a
    candidate into two the lowest-scoring counts (of several the first), with ``l`` and ``r`` occurrences of its parts
    and score floor(2000000 a / (l + r)). A candidate goes if a longer one that holds it has ``contained`` hundredths of its
    occurrences or more. ``n`` is the number of words of the language. Ties go to more occurrences, then to the
    smaller phrase by bytes. A null language is ``und``; null and empty texts, and texts without words, add nothing; repeated rows count
    again; an empty table gives no rows. ``longest`` is at most 4.
    """
    texts = docs.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.encode(F.col(text_col), "UTF-8").alias("text"))
    texts = texts.where("text is not null")
    words = materialise(phrase_counts(texts, (1,)), "words")
    totals = words.groupBy("lang").agg(F.sum("n").alias("total"))
    levels = [words.where(F.col("n") >= least)]
    for lengths in ((2,), tuple(range(3, longest + 1))):
        if lengths and lengths[-1] <= longest:
            found = phrase_counts(texts, lengths, levels[-1], lengths[0] - 1)
            levels.append(materialise(found.where(F.col("n") >= least), f"phrases-{lengths[0]}"))
    known = reduce(DataFrame.unionByName, levels)
    found = known.where("length > 1").withColumn("words", F.split("phrase", " "))

    def piece(start, length):
        return F.array_join(F.slice("words", start, length), " ")

    cuts = found.select("lang", "phrase", "words", "length", F.col("n").alias("a"), F.explode(F.sequence(F.lit(1), F.col("length") - 1)).alias("k"))
    cuts = cuts.select("lang", "phrase", "a", "k", piece(F.lit(1), F.col("k")).alias("left"), piece(F.col("k") + 1, F.col("length") - F.col("k")).alias("right"))
    cuts = materialise(cuts, "cuts")
    counts = materialise(known.select("lang", "phrase", "n"), "frequent-phrases")
    for side, name in (("left", "l"), ("right", "r")):
        cuts = materialise(join_hot(cuts, counts.select("lang", F.col("phrase").alias(side), F.col("n").alias(name)), ["lang", side]), "cuts")
    score = F.expr("cast(cast(a as decimal(20, 0)) * 2000000 div (l + r) as long)").alias("score")
    lowest = F.min(F.struct(score, "k", "l", "r")).alias("cut")
    scored = cuts.groupBy("lang", "phrase").agg(F.first("a").alias("a"), lowest)

    spans = F.array(*[F.struct(F.lit(i).alias("start"), F.lit(w).alias("width"), F.lit(n).alias("of")) for n in range(3, longest + 1) for w in range(2, n) for i in range(1, n - w + 2)])
    held = found.where("length > 2").select("lang", "words", "length", "n", F.explode(spans).alias("s")).where("s.of = length")
    held = held.groupBy("lang", piece(F.col("s.start"), F.col("s.width")).alias("phrase")).agg(F.max("n").alias("inside"))
    kept = scored.join(held, ["lang", "phrase"], "left").where(F.col("inside").isNull() | (F.col("inside") * 100 < F.col("a") * contained))
    kept = kept.select("lang", "phrase", "a", "cut.l", "cut.r", "cut.score")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), F.asc("phrase"))
    ranked = kept.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= top)
    return ranked.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")

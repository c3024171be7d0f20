"""Line dedup, token files, packing, language, quality and mixing on small tables with odd rows."""

import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from folioscope.llm import langid, line_dedup, mixing, packing, quality, token_files
from folioscope.llm.tokens import WORD_BPE, WordEncoder
from folioscope.plans.scale import scratch_path

DDL = "doc_id long, text string, lang string, source string, n_chars long"
LONG = "this line is long enough to be counted, and more"
TEXTS = [
    "Hello world, it's ÀÉÎ straße naïve 123 a.b.c <|endoftext|> 中文 éx  \t tab\r\nnext\x0bv nbsp",
    "", None, " ", "x" * 5000, "Don't they'll we're 'S 'LL a--b..!? ½ ² İstanbul Ǆ", "The the THE the, the. the! The!!\n\nthe",
]


def odd_documents(spark):
    rows = [(i, t, "en", "s", 1) for i, t in enumerate(TEXTS)]
    rows += [(None, "no id here", None, None, None), (3, "repeated id", "de", "s", None), (3, "repeated id", "de", "s", None)]
    return spark.createDataFrame(rows, DDL)


def empty_documents(spark):
    return spark.createDataFrame([], DDL)


def plain_dedup(rows, min_chars, min_docs):
    key = lambda line: "".join(c.lower() if c.isascii() else c for c in line.strip("\t\n\x0b\x0c\r "))
    holders = {}
    for doc, text in rows:
        for line in (text or "").split("\n"):
            if doc is not None and len(key(line)) >= min_chars:
                holders.setdefault(key(line), set()).add(doc)
    keeper = {k: max(v) for k, v in holders.items() if len(v) >= min_docs}
    out = []
    for doc, text in rows:
        lines = (text or "").split("\n")
        kept = [x for x in lines if keeper.get(key(x), doc) == doc or (doc is None and key(x) not in keeper)]
        out.append((doc, "\n".join(kept), len(lines), len(lines) - len(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("bits", [1 << 13, 1 << 20])
def test_line_dedup_matches_plain(spark, bits):
    line = lambda i: f"line number {i} which is fairly long: é{'x' * (i % 5)}"
    rows = [(i, "\n".join(line((i * k) % 40) + " " * (k % 3) for k in range(12)) + "\n") for i in range(60)]
    rows += [(100 + i, f" {LONG.upper()}\t\n{LONG}\nown {i}") for i in range(6)]
    rows += [(None, f"{LONG}\nx"), (100, f"{LONG}\nother text"), (101, None), (102, ""), (105, f" {LONG.upper()}\t\n{LONG}\nown 5")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_lines", F.lit(0))
    names = ["_drop", "_doc", "_row_hash", "_lines", "drop", "doc", "row_hash", "lines", "whole", "key", "places"]
    got = line_dedup.dedup_lines(df.withColumns({c: F.lit(c) for c in names}), max_filter_bits=bits)
    assert got.select(*names).distinct().collect() == [tuple(names)]
    found = sorted(((r.doc_id, r.text or "", r.n_lines, r.n_dropped) for r in got.collect()), key=str)
    assert found == plain_dedup(rows, 40, 5)


def test_line_dedup_of_an_empty_table(spark):
    assert line_dedup.dedup_lines(empty_documents(spark)).count() == 0


def test_encoder_equals_the_library(spark, sf_dir):
    tokenizer, encoder = Tokenizer.from_file(WORD_BPE), WordEncoder(WORD_BPE, max_entries=50)
    texts = TEXTS + [r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(40).collect()]
    for text in [t for t in texts if t] * 2:
        assert np.frombuffer(encoder.encode(text), "<u4").tolist() == tokenizer.encode(text, add_special_tokens=False).ids


def test_encoder_asks_once_per_batch_and_word():
    encoder, asked = WordEncoder(WORD_BPE, max_entries=50), []
    word, whole = encoder._word, encoder._whole
    encoder._word = lambda x: asked.append(x) or word(x)
    encoder._whole = lambda x: asked.append(x) or whole(x)
    words = [f"{a}{b}" for a in ("was", "Über", "señ", "qu") for b in ("the", "la", "Ich", "xy", "où", "EN")]
    words += [w + tail for w in words for tail in (",", "###", "&&&", "$$$", "***", "%%%")] + ["it's", "555-1012", "<|endoftext|>a", "a<|endoftext|>", "ab\u0338="]
    texts = [" ".join(words[k:] + words[:k]) for k in range(len(words))] + [None, "", " \n"]
    tokenizer = Tokenizer.from_file(WORD_BPE)
    want = [np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, 7], "<u4").tobytes() for t in texts]
    assert encoder.encode_all(pa.array(texts, pa.string()), np.array([7], "<u4").tobytes()).to_pylist() == want
    assert len(asked) == len(set(asked)) == 24 + 7 + 5  # words in lower case, tails (no tail is one), odd chunks
    assert encoder.encode_all(pa.array([], pa.string())).to_pylist() == []


def test_token_files(spark):
    docs = odd_documents(spark)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    folder = scratch_path(spark, "tokens")
    token_files.write_token_files(docs, folder, end_id=2)
    got = token_files.read_token_files(spark, folder).orderBy("start").collect()
    rows = sorted(((r.doc_id, r.text) for r in docs.collect()), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    start = 0
    for row, (doc, text) in zip(got, rows, strict=True):
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        assert (row.doc_id, row.start, row.n_tokens) == (doc, start, len(ids))
        assert np.frombuffer(row.ids, "<u4").tolist() == ids
        start += len(ids)


def test_token_files_of_an_empty_table(spark):
    folder = scratch_path(spark, "tokens")
    assert token_files.write_token_files(empty_documents(spark), folder).count() == 0
    assert token_files.read_token_files(spark, folder).count() == 0


@pytest.mark.parametrize("seed", range(4))
def test_best_two_fit_fills_sequences(seed):
    draw = np.random.default_rng(seed)
    lengths = [int(x) for x in np.clip(draw.lognormal(3, 1.2, 3000), 1, 256)]
    sequence, offset = packing.best_two_fit(lengths, 256)
    for k in range(sequence.max() + 1):
        inside = sorted((offset[i], lengths[i]) for i in np.flatnonzero(sequence == k))
        assert [o for o, _ in inside] == list(np.cumsum([0] + [n for _, n in inside[:-1]]))
        assert 0 < sum(n for _, n in inside) <= 256
    assert sequence.max() + 1 <= -(-sum(lengths) // 256) + 2


def test_best_two_fit_replaces_the_smallest():
    # 6 and 3 leave a gap of 1 of 10; 2 and 2 in place of the 3 leave none
    sequence, _ = packing.best_two_fit([6, 3, 2, 2], 10)
    assert len({sequence[0], sequence[2], sequence[3]}) == 1 and sequence[1] != sequence[0]


def test_packing_pieces(spark):
    docs = odd_documents(spark)
    tokenizer = Tokenizer.from_file(WORD_BPE)
    packed = packing.pack_documents(docs, capacity=64).cache()
    want = []
    for r in docs.collect():
        ids = np.array(tokenizer.encode(r.text or "", add_special_tokens=False).ids + [1], "<u4")
        want += [(r.doc_id, i // 64, i, zlib.crc32(ids[i : i + 64].tobytes())) for i in range(0, len(ids), 64)]
    got = [(r.doc_id, r.piece, r.start, zlib.crc32(r.ids)) for r in packed.collect()]
    assert sorted(got, key=str) == sorted(want, key=str)
    for r in packing.sequences(packed).collect():
        parts = sorted((p.offset, bytes(p.ids)) for p in packed.where(F.col("sequence_id") == r.sequence_id).collect())
        assert bytes(r.ids) == b"".join(p for _, p in parts) and len(r.ids) <= 256
    assert packing.pack_documents(empty_documents(spark)).count() == 0


def test_forward_algorithm_sums_all_segmentations():
    pieces = langid.Pieces(langid.VOCABULARY)
    names = langid.pieces_of(langid.VOCABULARY)
    chance = np.random.default_rng(1).dirichlet(np.ones(len(names)), 2).T
    place = {p: i for i, p in enumerate(names)}

    def total(word):
        sums = [np.ones(2)]
        for end in range(1, len(word) + 1):
            sums.append(sum((sums[s] * chance[place[word[s:end]]] for s in range(max(0, end - 16), end) if word[s:end] in place), np.zeros(2)))
        return sums[-1]

    words = [b" the", b" nation", "é".encode(), b" zqx", b" " + b"ab" * 20]
    assert np.allclose(langid.log_chances(pieces, chance, words), np.log([total(w) for w in words]))
    uses = langid.expected_counts(pieces, chance[:, 0], [b" the"], np.array([3.0]))
    assert np.isclose(sum(len(n) * u for n, u in zip(names, uses)), 12)


def test_language_of_odd_rows(spark):
    rows = [(i, "the cat sat on the mat and the dog" if i % 2 else "der hund und die katze auf der matte", "en" if i % 2 else "de", "s", 1) for i in range(40)]
    rows += [(100, None, "en", "s", 1), (101, "123 !?", None, "s", 1), (None, "the mat", "de", "s", 1), (102, "die katze und " * 500, None, "s", 1)]
    docs = spark.createDataFrame(rows, DDL).withColumn("score", F.lit("clash"))
    got = {r.doc_id: r for r in langid.identify(docs, learn=F.col("doc_id") < 30).collect()}
    assert [got[i].lang_pred for i in (31, 32, 100, 101, None, 102)] == ["en", "de", "und", "und", "en", "de"]
    assert got[100].score == got[101].score == 0 and all(0.5 < got[i].score <= 1 for i in (31, 32, 102))
    assert {r.lang_pred for r in langid.identify(docs, learn=F.lit(False)).collect()} == {"und"}
    assert langid.identify(empty_documents(spark)).count() == 0


def test_factorisation_machine_identity():
    draw = np.random.default_rng(0)
    table, x = draw.normal(size=(6, 4)), draw.normal(size=6)
    plain = 0.3 + x @ table[:, 0] + sum(x[i] * x[j] * (table[i, 1:] @ table[j, 1:]) for i in range(6) for j in range(i))
    got = quality.margins(np.zeros(6, int), np.arange(6), x, 1, 0.3, table)
    assert np.isclose(got[0], plain)


def test_quality_of_odd_rows(spark):
    good = lambda i: f"A plain sentence about thing number {i}, written with care. It goes on."
    bad = lambda i: f"BUY!! NOW!! | {i} | $$$ ### BUY!! BUY!! BUY!!"
    rows = [(i, good(i) if i % 2 else bad(i), "en", "s", 70) for i in range(120)]
    rows += [(200, None, None, None, None), (201, "", "en", "s", 0), (None, good(1), "en", "s", 1), (202, bad(9) * 300, "en", "s", 10**7)]
    docs = spark.createDataFrame(rows, DDL)
    labels = spark.createDataFrame([(i, i % 2 if i != 7 else None) for i in range(80)] + [(None, 1), (5, 1)], "doc_id long, quality int")
    got = {r.doc_id: r.score for r in quality.score_quality(docs, labels, passes=4, parts=2).collect()}
    assert len(got) == len(rows) and all(0 <= s <= 1 for s in got.values())
    assert min(got[i] for i in range(81, 120, 2)) > 0.5 > max([got[202], *(got[i] for i in range(80, 120, 2))])
    none = {r.score for r in quality.score_quality(docs, labels.where("false"), passes=1).collect()}
    assert all(0.2 < s < 0.8 for s in none)
    assert quality.score_quality(empty_documents(spark), labels, passes=1, parts=2).count() == 0


def test_mixing_meets_targets(spark):
    rows = [(i, ("plain good words here " if i % 4 else "junk ### stuff $$$ ") * (1 + i % 5), "en", "s", 1) for i in range(200)]
    rows += [(None, "good words", None, None, None), (300, None, "en", "s", 1), (301, "", "en", "s", 1), (5, "good plain words", "en", "s", 1)]
    docs = spark.createDataFrame(rows, DDL).withColumn("rate", F.lit("clash"))
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)] + [(None, 1, 0), (3, None, 0)], "doc_id long, quality int, toxic int")
    targets = {"good": 0.5, "poor": 0.5}
    got = mixing.mix(docs, labels, targets).collect()
    tokens, p, rate = np.array([r.n_tokens for r in got]), np.array([r.posterior for r in got]), np.array([r.rate for r in got])
    assert len(got) == len(rows) and np.allclose(p.sum(axis=1), 1) and (rate >= 0).all()
    assert np.allclose((tokens * rate) @ p, tokens.sum() * np.array([0.5, 0.5]), rtol=0.01)
    assert all(np.floor(r.rate) <= r.copies <= np.ceil(r.rate) for r in got)

    # the same steps in plain numpy
    base = tokens @ p
    wanted, x = tokens.sum() * np.array([0.5, 0.5]), np.ones(len(got))
    for _ in range(40):
        if (np.abs((tokens * x) @ p - wanted) <= 0.001 * wanted).all():
            break
        x = np.maximum(0, x - p @ (((tokens * x) @ p - wanted) / base))
    assert np.allclose(x, rate)
    floor = mixing.mix(docs, labels, targets, least_rate=1.0, budget=1.5).collect()
    assert min(r.copies for r in floor) >= 1
    assert mixing.mix(empty_documents(spark), labels, targets).count() == 0


@pytest.mark.parametrize("sharpness, least, budget", [(40.0, 0.0, 1.0), (0.3, 0.0, 1.0), (1.0, 1.0, None), (40.0, 1.0, None)])
def test_mixing_meets_targets_with_weak_posteriors_and_without_a_budget(spark, sharpness, least, budget):
    rows = [(i, ("plain good words here " if i % 4 else "junk ### stuff $$$ ") * (1 + i % 5), "en", "s", 1) for i in range(200)]
    labels = spark.createDataFrame([(i, int(i % 4 > 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    share = 0.7 if sharpness < 1 else 0.5
    got = mixing.mix(spark.createDataFrame(rows, DDL), labels, {"good": share, "poor": 1 - share}, sharpness=sharpness, least_rate=least, budget=budget).collect()
    tokens, p, rate = np.array([r.n_tokens for r in got]), np.array([r.posterior for r in got]), np.array([r.rate for r in got])
    after = (tokens * rate) @ p
    assert rate.min() >= least and np.allclose(after / after.sum(), [share, 1 - share], rtol=0.002)
    assert budget is None or np.isclose(after.sum(), budget * tokens.sum(), rtol=0.002)


def test_mixing_reports_targets_out_of_reach(spark, caplog):
    rows = [(i, "plain good words here", "en", "s", 1) for i in range(40)]
    labels = spark.createDataFrame([(i, 1, 0) for i in range(40)], "doc_id long, quality int, toxic int")
    got = mixing.mix(spark.createDataFrame(rows, DDL), labels, {"good": 0.5, "poor": 0.5}, least_rate=1.0, budget=None).collect()
    assert "mixing" in caplog.text and all(1 <= r.rate <= 2.01 for r in got)


def test_forward_algorithm_uses_the_longest_pieces():
    names = langid.pieces_of(langid.VOCABULARY)
    longest = max(names, key=len)
    pieces, chance = langid.Pieces(langid.VOCABULARY), np.full((len(names), 1), 1e-12)
    chance[names.index(longest)] = 0.5
    assert len(longest) == 33 and np.isclose(langid.log_chances(pieces, chance, [longest])[0, 0], np.log(0.5))


def test_results_beside_columns_with_inner_names(spark):
    names = ["_text", "__text", "_m0", "lang_pred", "score", "label", "part"]
    rows = [(i, "the cat sat" if i % 2 else "le chat dort", "en" if i % 2 else "fr", i) for i in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, n_chars long")
    labels = spark.createDataFrame([(i, i % 2) for i in range(40)], "doc_id long, quality int")
    clash = docs.withColumns({c: F.lit(c) for c in names})
    found = langid.identify(clash, keep=[*names, "doc_id"]).select("doc_id", *names[:3], "lang_pred")
    assert {tuple(r) for r in found.collect()} == {(i, *names[:3], g) for i, _, g, _ in rows}
    scored = quality.score_quality(clash, labels, keep=[*names, "doc_id"]).collect()
    assert all([r[c] for c in names[:4]] == names[:4] and (r.score > 0.5) == (r.doc_id % 2 == 1) for r in scored)


def test_words_of_any_length():
    pieces = langid.Pieces(langid.VOCABULARY)
    chance = np.random.default_rng(2).random((len(langid.pieces_of(langid.VOCABULARY)), 3)) / 1000
    word = b" " + "abstractionsüber".encode() * 340
    whole = langid._forward(pieces.lattice([word]), np.vstack([chance, np.zeros(3)]), 1)[1][0]
    assert len(word) > 5000 and np.allclose(langid.log_chances(pieces, chance, [word])[0], whole, rtol=1e-9)
    assert np.allclose(langid._long_forward(pieces, np.vstack([chance, np.zeros(3)]), word, stretch=100), whole, rtol=1e-9)
    assert langid.RUN.findall("ab" * 5000) == ["ab" * 5000]

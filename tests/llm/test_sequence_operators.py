"""Phrases, prefix trie and repeat removal against plain versions, with odd inputs."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from folioscope.llm import phrases, prefix_trie, repeats
from folioscope.llm.phrases import HatTrie, collocations
from folioscope.llm.repeats import remove_repeats
from folioscope.llm.skew import join_hot


def plain_collocations(rows, least, contained, top):
    counts, totals = Counter(), Counter()
    for lang, text in rows:
        lang = "und" if lang is None else lang
        lowered = (text or "").encode().lower().decode()
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", lowered):
            words = [w for w in re.split("[ \t]+", piece) if w]
            totals[lang] += len(words)
            counts.update((lang, *words[i : i + m]) for m in (1, 2, 3, 4) for i in range(len(words) - m + 1))
    frequent = {k: n for k, n in counts.items() if n >= least}
    found = {}
    for (lang, *w), a in frequent.items():
        if len(w) > 1:
            parts = [(counts[(lang, *w[:k])], counts[(lang, *w[k:])]) for k in range(1, len(w))]
            score, _, left, right = min((2000000 * a // (x + y), k, x, y) for k, (x, y) in enumerate(parts))
            inside = any(
                len(v) > len(w) and g == lang and 100 * n >= contained * a and any(v[i : i + len(w)] == w for i in range(len(v)))
                for (g, *v), n in frequent.items()
            )
            if not inside:
                found.setdefault(lang, []).append((-score, -a, " ".join(w).encode(), left, right))
    return {(g, i, x[2].decode(), -x[1], x[3], x[4], totals[g], -x[0]) for g, many in found.items() for i, x in enumerate(sorted(many)[:top], 1)}


def test_collocations(spark, monkeypatch):
    rng = random.Random(3)
    words = ["A", "b", "É", "ton", "\x00", "x y", "Zz", "und"]
    rows = [(rng.choice(["en", None, "und", "fr"]), "".join(rng.choice(words) + rng.choice([" ", " ", " ", "\t ", ". ", "\n", ","]) for _ in range(rng.randrange(40)))) for _ in range(150)]
    rows += [("en", None), ("en", ""), (None, " .,;"), ("de", "w" * 5000 + " b " * 300), rows[0]]
    docs = spark.createDataFrame([(t, g, i) for i, (g, t) in enumerate(rows)], "text string, lang string, phrase long")
    for least, contained, top in ((3, 80, 2000), (6, 50, 7)):
        want = plain_collocations(rows, least, contained, top)
        assert {tuple(r) for r in collocations(docs, least=least, contained=contained, top=top).collect()} == want and want
    assert collocations(docs.where("lang = 'none'")).collect() == []
    for name, size in (("PART", 60), ("ENTRIES", 40), ("BURST", 2), ("WORDS", 30)):
        monkeypatch.setattr(phrases, name, size)
    docs = docs.select(docs.text.cast("binary").alias("text"), "lang").where("text is not null and lang is not null")
    counted = Counter()
    trie_rows = phrases._count((2, 3), None, 0, 0)([b for b in docs.toArrow().select(["lang", "text"]).to_batches()])
    for batch in trie_rows:
        for r in batch.to_pylist():
            counted[r["lang"], r["phrase"]] += r["n"]
    whole = Counter()
    for lang, text in rows:
        for piece in re.split("[.,;:!?\n\x0b\x0c\r]", (text or "").encode().lower().decode()) if lang else []:
            w = [x for x in re.split("[ \t]+", piece) if x]
            whole.update((lang, " ".join(w[i : i + m])) for m in (2, 3) for i in range(len(w) - m + 1))
    assert counted == whole


def test_trie_bursts_and_spills(monkeypatch):
    monkeypatch.setattr(phrases, "BURST", 8)
    rng = np.random.default_rng(1)
    for length in (1, 2, 4):
        trie, out, keys, deep = HatTrie(length), Counter(), Counter(), False
        for _ in range(30):
            ids = rng.integers(1, 6 if length > 1 else 2000, (200, length))
            keys.update(map(tuple, ids.tolist()))
            trie.add(ids)
            deep |= any(isinstance(c, HatTrie) for c in trie.children)
            for part, counts in trie.spill(300):
                out.update(dict(zip(map(tuple, part.tolist()), counts.tolist())))
            assert trie.entries() <= 300
        for part, counts in trie.spill(0):
            out.update(dict(zip(map(tuple, part.tolist()), counts.tolist())))
        assert out == keys and trie.entries() == 0 and deep == (length == 4)


def plain_trie(rows):
    turns = {}
    for c, turn, role, text in rows:
        if c is not None:
            turns.setdefault(c, []).append((turn is not None, turn or 0, (role or "").encode(), (text or "").encode()))
    own = {c: [x[2:] for x in sorted(t)] for c, t in turns.items()}
    whole = {}
    for c, t in own.items():
        h = zlib.crc32(str(c).encode()) % 6
        host = c - (abs(c) % 100) * (1 if c > 0 else -1)
        whole[c] = own.get(host, [])[:h] + t[h:]
    nodes = {}
    for c, t in whole.items():
        for d in range(len(t) + 1):
            nodes.setdefault(tuple(t[:d]), []).append(c)
    out = set()
    for path, members in nodes.items():
        below = [p for p in nodes if p[: len(path)] == path]
        leaves = [p for p in below if not any(len(q) == len(p) + 1 and q[: len(p)] == p for q in below)]
        saved = sum((len(nodes[p]) - 1) * len(p[-1][1].decode()) for p in below if p)
        ends = ",".join(map(str, sorted(c for c in members if len(whole[c]) == len(path))))
        children = sum(len(q) == len(path) + 1 for q in below)
        out.add((min(members), len(path), min(nodes[path[:-1]]) if path else None, len(members), children, len(leaves), saved, hashlib.sha256(ends.encode()).hexdigest()))
    return out


def test_prefix_trie(spark, monkeypatch):
    for name, size in (("BLOCK", 4), ("IDS", 3)):
        monkeypatch.setattr(prefix_trie, name, size)
    rng = random.Random(7)
    rows = []
    for c in [*range(0, 40), *range(100, 112), -3, -105, 205, 10**12 + 7]:
        for turn in range(rng.choice([1, 2, 5, 9])):
            rows.append((c, rng.choice([turn, turn, None, 3]), rng.choice(["user", None, ""]), rng.choice(["a", "É b", None, "", "long " * 900])))
    rows += [(100, t, "user", "same") for t in range(30)] + [(300 + k, t, "u", "x") for k in range(30) for t in range(7)]
    rows += [(None, 1, "user", "lost"), rows[0], rows[0]]
    chain = [(500, t, "u", str(t)) for t in range(70)] + [(501, t, "u", str(t)) for t in range(50)]
    schema = "conv_id long, turn long, role string, text string, depth long, p string"
    df = spark.createDataFrame([(*r, 1, "p") for r in rows + chain], schema)
    assert {tuple(r) for r in prefix_trie.prefix_trie(df).collect()} == plain_trie(rows + chain)
    assert prefix_trie.prefix_trie(df.where("conv_id = 77777")).collect() == []
    turnless = [(2, 1, "u", "x")]  # its head is the host's first five turns, and the host is not there
    assert zlib.crc32(b"2") % 6 > 0
    assert {tuple(r) for r in prefix_trie.prefix_trie(spark.createDataFrame(turnless, "conv_id long, turn long, role string, text string")).collect()} == plain_trie(turnless)


def plain_repeats(texts, length):
    counts = Counter(t[i : i + length] for t in texts for i in range(len(t) - length + 1))
    for t in texts:
        gone = bytearray(len(t))
        for i in range(len(t) - length + 1):
            if counts[t[i : i + length]] > 1:
                gone[i : i + length] = b"\1" * length
        spans = sum(1 for i in range(len(t)) if gone[i] and (i == 0 or not gone[i - 1]))
        yield bytes(b for b, g in zip(t, gone) if not g), len(t), sum(gone), spans


@pytest.mark.parametrize("length", [1, 7, 40])
def test_remove_repeats(spark, length, monkeypatch):
    monkeypatch.setattr(repeats, "CHUNK", 150)
    rng = random.Random(length)
    texts = ["".join(rng.choice("abcé") for _ in range(rng.choice([0, 5, 30, 200, 600]))) for _ in range(15)]
    for _ in range(25):
        a, b = rng.choice(texts), rng.choice(texts)
        i, k = rng.randrange(len(a) + 1), rng.randrange(len(b) + 1)
        texts.append(b[:k] + a[i : i + rng.randrange(150)] + b[k:])
    texts += ["ab" * 200, "a" * 300, None, texts[3], texts[3]]
    rows = [(None if i == 3 else i // 2, t, f"x{i}", i) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, runs string, t1 long")
    found = remove_repeats(docs, length=length)
    assert found.columns == ["doc_id", "text", "runs", "t1", "kept", "n_bytes", "n_removed", "n_spans"]
    want = sorted((i, d, t, x, *p) for (d, t, x, i), p in zip(rows, plain_repeats([(t or "").encode() for t in texts], length)))
    assert sorted((r.t1, r.doc_id, r.text, r.runs, bytes(r.kept), r.n_bytes, r.n_removed, r.n_spans) for r in found.collect()) == want
    assert remove_repeats(docs.where("t1 < 0"), length=length).collect() == []


def test_long_text_repeats(spark):
    rng = random.Random(1)
    passage = "".join(rng.choice("abcdefgh ") for _ in range(700))
    filler = "".join(rng.choice("abcdefgh ") for _ in range(1_500_000))
    texts = [filler[:600_000] + passage + filler[600_000:], filler[700_000:700_450] + passage[:399], "#" + passage[:401]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: (r.n_removed, r.n_spans) for r in remove_repeats(docs).drop("text", "kept").collect()}
    assert found == {0: (450 + 401, 2), 1: (450, 1), 2: (401, 1)}


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_join_hot(spark, how):
    big = spark.range(3000).selectExpr("case when id % 3 = 0 then null when id < 1500 then 7 else id end as k", "id")
    small = spark.createDataFrame([(7, "a"), (2000, "b"), (5, "c"), (None, "d")], "k long, v string")
    want = big.join(small, "k", how)
    assert sorted(map(tuple, join_hot(big, small, ["k"], how).collect()), key=str) == sorted(map(tuple, want.collect()), key=str)

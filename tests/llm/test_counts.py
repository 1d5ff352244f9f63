"""Quotient filters, suffix automata, exact dedup, divergence audit and collocations against plain versions, on awkward rows too."""

import hashlib
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from evispark.llm import divergence, exact, phrases, quotient, tokens
from evispark.llm.automaton import automaton

random.seed(11)
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
SCHEMA = "doc_id long, text string, lang string, source string, term string, key string, fp string, row string, n string"
VOCABULARY = ["new", "york", "city", "of", "the", "Straße", "ÉTÉ", "été", "x1", "--"]


def prose(n):
    return "".join(random.choice(VOCABULARY) + random.choice((" ", " ", " ", "\t", ", ", ".", "\n")) for _ in range(n))


TEXTS = [None, "", " \t", "...", "a", prose(4000), "漢字 かな\x00 é", "New York City, NEW YORK city! new york"] + [prose(random.randint(1, 300)) for _ in range(60)]
ROWS = [(i, t, random.choice(("en", "fr", None, "")), random.choice(("a", "b", "ü", None, ""))) for i, t in enumerate(TEXTS)]
ROWS += [(100 + i, (TEXTS[5].upper() if i % 3 else TEXTS[5]), "en", "hot") for i in range(30)]
ROWS += [(None, "of one", "en", "a"), (None, "OF one", "en", "a"), (7, TEXTS[7], "en", "a"), (7, TEXTS[7], "en", "a"), (90, "alone", "xx", "only"), (91, "", "yy", "only")]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, "t", "k", "f", "r", "n") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@settings(deadline=None, max_examples=60)
@given(st.integers(1, 63), st.lists(st.lists(st.tuples(st.integers(0, (1 << 63) - 1), st.sampled_from([1, 2, 3, 256, 257, 258, 70_000, 1 << 41])), max_size=60), min_size=1, max_size=4))
def test_filters_merge_without_loss(width, parts):
    wanted, made = Counter(), []
    for part in parts:
        part = [(f & (1 << width) - 1, c) for f, c in part]
        for f, c in part:
            wanted[f] += c
        fps, n = np.array([f for f, _ in part], np.uint64), np.array([c for _, c in part], np.int64)
        made.append(quotient.build(*quotient.distinct(fps, n), width))
    merged = quotient.merge(made, width)
    fps, n = quotient.entries(merged)
    assert dict(zip(fps.tolist(), n.tolist(), strict=True)) == dict(wanted)
    assert fps.tolist() == sorted(wanted)
    assert all(quotient.count(merged, f) == c for f, c in wanted.items())
    assert all(quotient.count(merged, f) == wanted[f] for f in range(min(1 << width, 8)))


@settings(deadline=None, max_examples=80)
@given(st.lists(st.tuples(st.integers(0, 3), st.booleans(), st.booleans()), max_size=60), st.integers(1, 5))
def test_states_are_classes_of_end_positions(rows, depth):
    symbols = np.array([s for s, _, _ in rows], np.int64)
    usable, joined = np.array([u for _, u, _ in rows], bool), np.array([j for _, _, j in rows], bool)
    ends = defaultdict(set)
    for i in range(len(rows)):
        for size in range(1, min(depth, i + 1) + 1):
            span = range(i - size + 1, i + 1)
            if all(usable[k] for k in span) and all(joined[k] for k in span[1:]):
                ends[tuple(symbols[list(span)])].add(i)
    classes = defaultdict(list)
    for found, at in ends.items():
        classes[frozenset(at)].append(found)
    s = automaton(symbols, usable, joined, depth)
    got = {}
    for k in range(len(s.count)):
        longest = tuple(symbols[s.end[k] - s.hi[k] + 1 : s.end[k] + 1])
        assert ends[longest] and len(ends[longest]) == s.count[k]
        members = classes[frozenset(ends[longest])]
        assert {len(m) for m in members} == set(range(s.lo[k], s.hi[k] + 1)) and max(members, key=len) == longest
        got[frozenset(ends[longest])] = k
        if s.link[k] >= 0:
            suffix = longest[len(longest) - s.lo[k] + 1 :]
            to = s.link[k]
            assert s.hi[to] == len(suffix) and ends[suffix] == ends[tuple(symbols[s.end[to] - s.hi[to] + 1 : s.end[to] + 1])]
        else:
            assert s.lo[k] == 1
    assert len(got) == len(s.count) == len(classes)


def test_words_of_shards():
    texts = ["A b,c", None, "", ".x  y", "Éz é", "q" * 50] * 7
    batch = pa.record_batch([pa.array(texts), pa.array(range(len(texts)))], ["text", "i"])
    for limit in (1, 20, 10_000):
        seen, rows = [], []
        for shard in tokens.shards([batch, batch], limit):
            found = tokens.coded(shard["text"], phrases.KINDS)
            seen += [(shard["i"][int(d)].as_py(), found.words[int(c)].as_py().decode(), bool(f)) for d, c, f in zip(found.doc, found.codes, found.fresh, strict=True)]
            rows += shard["i"].to_pylist()
        assert rows == [*range(len(texts))] * 2
        wanted = []
        for i, t in enumerate(texts):
            for piece in re.split(r"[.,;:!?\x0A-\x0D]", (t or "").translate(LOWER)):
                wanted += [(i, w, k == 0) for k, w in enumerate(re.findall(r"[^\x20\x09]+", piece))]
        assert seen == wanted * 2


@pytest.mark.parametrize("bits", [64, 4])
def test_exact(docs, none, bits, monkeypatch):
    """With 4 bits nearly all fingerprints are of several texts, which only their bytes part."""
    if bits == 4:
        monkeypatch.setattr(exact, "BROADCAST", 0)
    groups = defaultdict(list)
    for doc_id, text, *_ in ROWS:
        groups[(text or "").translate(LOWER)].append(doc_id)
    wanted = []
    for text, ids in groups.items():
        keep = max((i for i in ids if i is not None), default=None)
        kept = [i == keep for i in ids]
        first = kept.index(True)
        wanted += [(i, keep, len(ids), k == first, hashlib.sha256(text.encode()).hexdigest()) for k, i in enumerate(ids)]
    got = [(r.doc_id, r.keep_id, r.group_size, r.kept, r.text_sha256) for r in exact.duplicates(docs, bits).collect()]
    assert sorted(got, key=repr) == sorted(wanted, key=repr)
    assert exact.duplicates(none, bits).collect() == []


def test_filters_of_many_parts(spark, monkeypatch):
    """A fingerprint of a third of the rows, in filters that are built again and again."""
    monkeypatch.setattr(exact, "HELD", 50)
    rows = spark.range(0, 6000, 1, 7).select(F.when(F.col("id") % 3 == 0, F.lit(5)).otherwise(F.xxhash64(F.col("id") % 1500)).alias("fp"))
    found = exact.repeated(exact.filters(rows, 6000), 6000)
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, rows.groupBy("fp").count().where("count > 1").collect()))


def test_divergence(docs, none):
    counts, in_docs, groups = defaultdict(Counter), defaultdict(Counter), set()
    for _, text, lang, source in ROWS:
        lang, source = lang or "", source or ""
        groups.add((lang, source))
        terms = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
        counts[lang, source].update(terms)
        in_docs[lang].update(set(terms))
    wanted = []
    f = lambda p, q: (p - q) ** 2 // (p + q)
    for lang in {g[0] for g in groups}:
        kept = sorted(t for t, n in in_docs[lang].items() if n >= 10)
        own = {s: {t: counts[lang, s][t] for t in kept} for x, s in groups if x == lang}
        total = {t: sum(c[t] for c in own.values()) for t in kept}
        p = lambda c: {t: 1 + 1_000_000_000 * (n + 2) // (sum(c.values()) + 2 * len(kept)) for t, n in c.items()}
        ps, q = {s: p(c) for s, c in own.items()}, p(total)
        for s in own:
            found = [(sum(f(ps[s][t], ps[o][t]) for t in kept), o) for o in own if o != s]
            wanted += [(lang, s, "pair", o, v, i) for i, (v, o) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode())), 1)]
            found = [(f(ps[s][t], q[t]), t) for t in kept if own[s][t] and ps[s][t] > q[t]]
            wanted += [(lang, s, "term", t, v, i) for i, (v, t) in enumerate(sorted(found, key=lambda x: (-x[0], x[1].encode()))[:10], 1)]
    got = divergence.audit(docs).select("lang", "source", "part", "item", "value", "rank").collect()
    assert sorted(map(tuple, got)) == sorted(wanted) and {w[2] for w in wanted} == {"pair", "term"}
    assert divergence.audit(none).collect() == []


def test_probabilities_beyond_64_bits(spark):
    n, total, kept = 9_300_000_000, 40_000_000_000, 3_000_000_000
    df = spark.createDataFrame([(n, total, kept)], "n long, total long, kept long")
    assert df.select(divergence.probability("n", "total", "kept")).first()[0] == 1 + 1_000_000_000 * (n + 2) // (total + 2 * kept)


def plain_collocations(rows, depth=4, least=30, top=2000):
    f, sizes = defaultdict(Counter), Counter()
    for _, text, lang, _ in rows:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = tuple(re.findall(r"[^\x20\x09]+", piece))
            sizes[lang] += len(w)
            f[lang].update(w[i : i + m] for m in range(1, depth + 1) for i in range(len(w) - m + 1))
    out = []
    for lang, c in f.items():
        candidates = {g: a for g, a in c.items() if len(g) > 1 and a >= least}
        found = []
        for g, a in candidates.items():
            if any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in candidates.items()):
                continue
            score, k = min((2_000_000 * a // (c[g[:k]] + c[g[k:]]), k) for k in range(1, len(g)))
            found.append((-score, -a, " ".join(g).encode(), c[g[:k]], c[g[k:]]))
        out += [(lang, i, p.decode(), -a, x, y, sizes[lang], -s) for i, (s, a, p, x, y) in enumerate(sorted(found)[:top], 1)]
    return sorted(out)


@pytest.mark.parametrize("top", [2000, 7])
def test_collocations(docs, none, top):
    got = phrases.collocations(docs, least=12, top=top).collect()
    wanted = plain_collocations(ROWS, least=12, top=top)
    assert sorted(map(tuple, got)) == wanted and {w[0] for w in wanted} >= {"en", "fr", "und"}
    assert phrases.collocations(none).collect() == []


def test_collocations_after_colliding_digests_and_full_sieves(docs, monkeypatch):
    """Words whose digests collide get another seed; sieves that let nearly all through change nothing."""
    monkeypatch.setattr(phrases, "MOST_BITS", 64)
    monkeypatch.setattr(phrases, "SIEVE_BITS", 1)
    poor = lambda data, seed: phrases.digest64(data, seed) if seed > 1 else len(data)
    assert sorted(map(tuple, phrases.collocations(docs, least=12, digest=poor).collect())) == plain_collocations(ROWS, least=12)


def test_score_beyond_64_bits(spark):
    rows = [(b"a" * 8, 20_000_000_000_000, "en"), (b"b" * 8, 30_000_000_000_000, "en"), (b"a" * 8 + b"b" * 8, 15_000_000_000_000, None)]
    found = phrases.scored(spark.createDataFrame(rows, "key binary, a long, lang string")).first()
    assert found["score"] == 2_000_000 * 15 // 50 and found["lang"] == "en"

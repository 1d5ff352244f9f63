"""Models and pipeline stages against plain versions that share none of their code but fixed numbers and hash functions."""

import hashlib
import math
import random
import re
import unicodedata
import zlib
from collections import Counter, defaultdict

import corpus_pipeline
import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.llm import hosts, langid, lines, maxent, mixing, omh, quality, queries, simhash, warc

RNG = random.Random(5)
VOCABULARY = ["".join(RNG.choice("abcdeé") for _ in range(RNG.randint(1, 7))) for _ in range(150)] + ["the", "of", "Der", "un"]


def prose(n):
    return " ".join(RNG.choice(VOCABULARY[: RNG.choice((10, 60, 154))]) for _ in range(n))


TEXTS = [prose(RNG.randint(1, 120)) for _ in range(60)] + [None, "", " \n ", "x", prose(900)]
M32, M64 = (1 << 32) - 1, (1 << 64) - 1


def spread(x, rows):
    x = (x ^ x >> 15) * 0xC2B2AE35 & M32
    x = (x ^ x >> 13) * 0x27D4EB2F & M32
    return (x ^ x >> 16) * rows >> 32


class PlainModel:
    """The maximum-entropy model with dictionaries, a token at a time."""

    def __init__(self, rows):  # (doc_id, text, held, round)
        self.tokens = lambda t: [*(t or "").encode().lower().split(), b""]
        train = [(self.tokens(t), r) for _, t, held, r in rows if not held]
        self.counts = Counter(w for x, _ in train for w in x)
        ranked = [w for w in sorted(self.counts, key=lambda w: (-self.counts[w], w)) if w]
        self.rank = {w: i for i, w in enumerate(ranked)}
        self.inner = min(len(ranked), 47 * 32)
        self.size = int(min(65536, max(1024, 1.5 * sum(self.counts.values()) ** 0.5)))
        self.weights, self.inside = defaultdict(lambda: np.zeros(64)), defaultdict(lambda: np.zeros(32))
        mass, kinds = np.zeros(64), np.zeros(64)
        for w, n in self.counts.items():
            mass[self.of(w)] += n
            kinds[self.of(w)] += 1
        self.bias, self.mass, self.kinds = np.log((mass + 0.5) / (mass + 0.5).sum()), mass, kinds
        for turn in range(4):
            seen, hoped = (defaultdict(lambda: np.zeros(64)), defaultdict(lambda: np.zeros(32))), (defaultdict(lambda: np.zeros(64)), defaultdict(lambda: np.zeros(32)))
            for found, r in train:
                if r == turn:
                    for i, w in enumerate(found):
                        for which, rows_, share, own in self.shares(found, i, w):
                            for row in rows_:
                                seen[which][row][own] += 1
                                hoped[which][row] += share
            for which, table in enumerate((self.weights, self.inside)):
                for row in hoped[which]:
                    table[row] = table[row] + np.log((seen[which][row] + 16) / (hoped[which][row] + 16)) / 2

    def of(self, w):
        if not w:
            return 47
        return self.rank[w] // 32 if self.rank.get(w, 1 << 30) < self.inner else 48 + zlib.crc32(w[-3:]) % 16

    def code(self, w):
        n = len(self.rank)
        return n if not w else self.rank[w] if w in self.rank else n + 1 + (zlib.crc32(w[-3:]) % 16 << 16 | zlib.crc32(w) & 0xFFFF)

    def shares(self, found, i, w):
        """(table, rows, probabilities, own) of the class and, for a word of a class of words, of its place within."""
        x, y, z = (self.code(found[i - k]) + 1 if i >= k else 0 for k in (1, 2, 3))
        a, b, c = 0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F
        last = x * a & M32
        rows = [spread(v & M32, self.size) for v in (last, (last ^ y * b & M32) + 1, y * b + 2, (last ^ z * c & M32) + 3)]
        score = self.bias + sum(self.weights[r] for r in rows)
        yield 0, rows, softmax(score), self.of(w)
        if w and self.rank.get(w, 1 << 30) < self.inner:
            k = self.of(w)
            slots = [v for v, r in self.rank.items() if r < self.inner and r // 32 == k]
            share = np.full(32, -80.0)
            share[: len(slots)] = np.log([self.counts[v] / self.mass[k] for v in slots])
            of = (k * 0x9E3779B1 + 4) & M32
            inner = [spread(last ^ of, self.size), spread((last ^ y * b & M32) + of & M32, self.size)]
            yield 1, inner, softmax(share + sum(self.inside[r] for r in inner)), self.rank[w] % 32

    def score(self, text):
        found, out = self.tokens(text), 0.0
        for i, w in enumerate(found):
            out += sum(math.log10(share[own]) for _, _, share, own in self.shares(found, i, w))
            if self.of(w) > 47:
                out += math.log10((self.counts[w] + 0.5) / (self.mass[self.of(w)] + 0.5 * (self.kinds[self.of(w)] + 1)))
        return out


def softmax(x):
    x = np.exp(x - x.max())
    return x / x.sum()


@pytest.mark.parametrize("frequent", [maxent.FREQUENT, 100])
def test_scores_are_the_plain_models(spark, frequent):
    frame = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    rows = frame.select("doc_id", "text", (F.crc32(F.col("doc_id").cast("string")) % 5 == 1).alias("held"), F.pmod(F.xxhash64("doc_id", "text"), F.lit(4)).alias("round")).collect()
    plain = None
    for parts in (1, 4, 16):
        got = {r.doc_id: r.score for r in maxent.scores(frame.repartition(parts), frequent=frequent).collect()}
        if frequent == maxent.FREQUENT:
            plain = plain or PlainModel(rows)
            wanted = {r[0]: plain.score(r[1]) for r in rows}
        else:  # codes of rare words are hashes, so only that partitions change nothing
            wanted = plain = plain or got
        assert got.keys() == wanted.keys() and all(abs(got[i] - wanted[i]) <= 1e-4 * abs(wanted[i]) for i in got)


def test_held_out_texts_score_above_the_baseline(spark):
    table = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    means = []
    for parts in (4, 64):
        row = maxent.scores(table.repartition(parts)).where("held_out").agg((F.sum("score") / F.sum("n_tokens")).alias("s"), (F.sum("base_score") / F.sum("n_tokens")).alias("b")).first()
        assert row.s > row.b + 0.02
        means.append(row.s)
    assert abs(means[0] - means[1]) < 1e-6


def plain_sketch(text):
    def mixed(x):
        for shift in (31, 29):
            x = (x ^ x >> shift) * 0x9E3779B97F4A7C15 & M64
        return x ^ x >> 32

    if not text:
        return [0] * omh.SIZE
    kmers, seen, items = [], Counter(), []
    for i in range(max(1, len(text) - omh.K + 1)):
        h = 0
        for c in text[i : i + omh.K]:
            h = (h * 0x100000001B3 + ord(c)) & M64
        kmers.append(mixed(h))
    bits = len(kmers).bit_length()  # the lowest bits of a k-mer's hash hold its place, and don't tell k-mers apart
    for h in kmers:
        items.append(mixed((h + seen[h >> bits] * 0x9E3779B97F4A7C15) & M64) >> 32)
        seen[h >> bits] += 1
    out = []
    for a, b in omh._SEEDS[:2].T.tolist():
        first = sorted(range(len(items)), key=lambda i: ((items[i] ^ a) * b & M32, i))[: omh.TUPLE]
        h = 0
        for i in sorted(first):
            h = mixed((h + kmers[i]) & M64)
        out.append(h >> 32 | 1)
    return out


def test_order_minhash_is_the_plain_one():
    for text in ["", "a", "abcdefg", "abababababababababab", "漢𐍈é" * 20, prose(60), prose(200) + "x" * 300]:
        assert omh.sketch(omh.codes_of(text)).tolist() == plain_sketch(text)


def test_order_minhash_on_awkward_rows(spark):
    rows = [(None, "n1"), (None, "n2"), (3, "tie a"), (3, "tie b"), (5, None), (5, prose(40)), (9, prose(9))]
    frame = spark.createDataFrame([(i, t, "k", "s") for i, t in rows], "doc_id string, text string, shard string, carried string")
    got = omh.fingerprints(frame).collect()
    assert Counter((r.doc_id, r.n_chars) for r in got) == Counter((None if i is None else str(i), len(t or "")) for i, t in rows)
    assert all(r.fingerprint in {omh.sketch(omh.codes_of(t or "")).tobytes().hex() for _, t in rows} for r in got)


def test_languages_are_the_plain_models(spark):
    stems = {"en": ["the", "house", "of", "light"], "hi": ["हिन्दी", "भाषा", "और", "घर"], "de": ["straße", "und", "haus", "das"]}
    texts = [(i, " ".join(RNG.choice(stems[lang]) + RNG.choice(["", "", "s", "en"]) for _ in range(12)), lang) for i, lang in enumerate(["en", "hi", "de"] * 30)]
    texts += [(200, "CO₂", None), (201, "m² ½", None), (202, "½ ² 3 --", None), (203, None, "en"), (204, "housing haus", "de"), (205, "", "en"), (206, "भाषाएँ", None)]
    letter = lambda c: unicodedata.category(c)[0] == "L"
    mark = lambda c: unicodedata.category(c)[0] == "M"

    def words(t):
        out, run = [], ""
        for c in (t or "").lower() + " ":
            if letter(c) or run and mark(c):
                run += c
            elif run:
                out.append(run)
                run = ""
        return out

    held = lambda i: zlib.crc32(str(i).encode()) % 4 == 2
    learnt = [(t, lang) for i, t, lang in texts if not held(i) and lang and t is not None]
    langs, total = sorted({x for _, x in learnt}), Counter(x for _, x in learnt)
    counts = {x: Counter(w for t, y in learnt if y == x for w in words(t)) for x in langs}
    known = [w for w in sorted(set().union(*counts.values())) if sum(c[w] for c in counts.values()) >= 2]
    grams = lambda w, n: [f" {w} "[i : i + n] for i in range(len(w) + 3 - n)]
    tables = [{x: Counter() for x in langs} for _ in range(5)]
    for x in langs:
        for w in known:
            if counts[x][w]:
                tables[0][x][w] += counts[x][w]
                for n in range(1, 5):
                    for g in grams(w, n):
                        tables[n][x][g] += counts[x][w]
    log = lambda n, x, key: math.log((tables[n][x][key] + 0.5) / (sum(tables[n][x].values()) + 0.5 * (len(set().union(*tables[n].values())) + 1)))

    def word(x, w):
        if any(tables[0][y][w] for y in langs):
            return log(0, x, w)
        for n in range(4, 0, -1):
            if some := [g for g in grams(w, n) if any(tables[n][y][g] for y in langs)]:
                return sum(log(n, x, g) for g in some) / len(some)
        return 0.0

    got = {r.doc_id: r for r in langid.identify(spark.createDataFrame([(*t, "x") for t in texts], "doc_id long, text string, lang string, word string")).collect()}
    for i, t, _ in texts:
        found = words(t)
        if not found:
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        scores = np.array([sum(word(x, w) for w in found) + math.log(total[x] / len(learnt)) for x in langs])
        assert got[i].lang_pred == langs[int(scores.argmax())] and got[i].score == pytest.approx(softmax(scores).max(), abs=1e-9)
    assert {got[200].lang_pred, got[201].lang_pred} <= set(langs) and got[202].lang_pred == "und" and got[206].lang_pred == "hi"


def test_few_bad_hosts_among_many_mixed_ones(spark):
    rng = random.Random(1)
    rows = [(i, f"http://h{i % 300}.site{i % 60}.com/", int(rng.random() < 0.85)) for i in range(4000)]
    rows += [(5000 + i, "http://spam.bad.com/", 0) for i in range(30)] + [(6000 + i, "http://mild.bad2.com/", i % 2) for i in range(30)]
    pages = spark.createDataFrame([(i, u, "h") for i, u, _ in rows], "page_id long, url string, html string")
    labels = spark.createDataFrame([(i, q, 0) for i, _, q in rows], "doc_id long, quality int, toxic int")
    judged = hosts.judge(pages, labels)
    assert {r.host for r in judged.where("verdict = 'block'").select("host").distinct().collect()} == {"spam.bad.com"}
    import duckdb

    c = duckdb.connect()
    for name, frame in (("pages", pages), ("labels", labels)):
        c.register(name, frame.toArrow())
    assert sorted(map(tuple, judged.collect())) == sorted((r[0], r[1], r[2], r[3], r[4]) for r in c.sql(hosts.HOSTS_SQL).fetchall())


def test_beta_probabilities():
    for a, b in ((6.4, 19.6), (44.0, 18.0), (3.0, 2.5), (1.7, 1.2), (900.0, 700.0)):
        t = (np.arange(400_000) + 0.5) / 400_000
        density = np.exp((a - 1) * np.log(t) + (b - 1) * np.log1p(-t) - (a + b - 2) * math.log(0.5))
        for rate in (0.5, 0.3):
            assert hosts.beta_below(np.array([a]), np.array([b]), rate)[0] == pytest.approx(density[t <= rate].sum() / density.sum(), abs=2e-3)
    for x in (0.2, 0.7, 5.0):  # what can be written out
        assert hosts.beta_below(np.array([x, 1.0]), np.array([1.0, x]), 0.3) == pytest.approx([0.3**x, 1 - 0.7**x])


def test_revisits_name_their_response(spark, tmp_path):
    big = "y" * 3000
    pages = spark.createDataFrame([(i, "u", big) for i in range(5)] + [(9, "u", "z" * 2000)], "page_id long, url string, html string")
    warc.write(pages, f"file://{tmp_path}/w")
    headers = [h for p in tmp_path.glob("w/*.warc.gz") for h, _ in warc.records(iter([p.read_bytes()]))]
    of = {h["X-Page-ID"]: h for h in headers}
    import gzip

    whole = b"".join(gzip.decompress(p.read_bytes()) for p in sorted(tmp_path.glob("w/*.warc.gz")))  # as any reader of WARC files sees them
    assert whole.startswith(b"WARC/1.1\r\n") and whole.count(b"WARC/1.1\r\n") == 6 and whole.count(big.encode()) == 1
    assert all(of[str(i)]["WARC-Refers-To"] == of["4"]["WARC-Record-ID"] for i in range(4)) and "WARC-Refers-To" not in of["4"] and len({h["WARC-Record-ID"] for h in headers}) == 6


def test_names_that_clash_are_kept(spark):
    names = ["__key", "__size", "__text", "__kept", "__lines", "__places", "__copy", "a.b", "cell", "line", "own", "n"]
    rows = [(i, prose(70) + "\nshared line of a page\n" + prose(30), "s", *(f"{c}{i}" for c in names)) for i in range(40)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, " + ", ".join(f"`{c}` string" for c in names))
    for made in (quality.cleaned(frame), lines.cleaned(frame), simhash.keep_one(frame), simhash.keep_one_similar(frame), mixing.repeated(frame)):
        assert made.columns == frame.columns
        found = made.collect()
        assert found and all(r[c] == f"{c}{r.doc_id}" for r in found for c in names)


def test_long_host_lists_are_joined(spark):
    rows = [(i, "\n".join([prose(60), *(f"menu {k} {chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60))]), RNG.choice(["h", None])) for i in range(90)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    key = lambda df: sorted(tuple(r) for r in df.select("doc_id", "__left", "__kept", "__text").collect())
    assert key(quality.judged(frame)) == key(quality.judged(frame, broadcast_lines=-1)) and all("menu" not in r[3] for r in key(quality.judged(frame)))


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


def groups(n, alike):
    up = list(range(n))
    for i in range(n):
        for j in range(i):
            if up[i] != up[j] and alike(i, j):
                a, b = sorted((up[i], up[j]))
                up = [a if x == b else x for x in up]
    return up


def plain_quality(docs):
    def base(text):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w), len(w) < 50 or 100 * len(rep) > 50 * len(w)

    plain = lambda x: re.sub(r"[1-9]", "0", re.sub(r"[\t\n\x0b\f\r]", " ", x.lower())).strip(" ")
    texts = defaultdict(set)
    for d in docs:
        texts[d["source"]].add(d["text"] or "")
    often = {}
    for host, found in texts.items():
        seen = Counter(x for t in found for x in {plain(x) for x in t.split("\n")} if x)
        often[host] = {x for x, n in seen.items() if n > 20 and n * n > len(found)}
    out = []
    for d in docs:
        n, failed = base(d["text"])
        left = "\n".join(x for x in (d["text"] or "").split("\n") if plain(x) not in often[d["source"]])
        if not failed and 100 * base(left)[0] >= 30 * n:
            out.append(d | {"text": left})
    return out


def plain_lines(docs):
    def normal(x):
        small = re.sub(r"[1-9]", "0", "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in x))
        bare = re.sub(r"[!-/:-@\[-`{-~]", " ", small)
        return " ".join(bare.split()) or " ".join(small.split())

    order = sorted(range(len(docs)), key=lambda i: docs[i]["doc_id"])
    places = [(i, k, normal(x)) for i in order for k, x in enumerate((docs[i]["text"] or "").split("\n")) if normal(x)]
    distinct = list(dict.fromkeys(x for _, _, x in places))
    near = lambda i, j: 1 - distance(distinct[i], distinct[j]) / max(len(distinct[i]), len(distinct[j])) >= 0.8 - 1e-12 if min(len(distinct[i]), len(distinct[j])) >= 0.79 * max(len(distinct[i]), len(distinct[j])) else False
    of = dict(zip(distinct, groups(len(distinct), near), strict=True))
    gone, seen = set(), set()
    for i, k, x in places:
        if of[x] in seen:
            gone.add((i, k))
        seen.add(of[x])
    return [d | {"text": None if d["text"] is None else "\n".join(x for k, x in enumerate(d["text"].split("\n")) if (i, k) not in gone)} for i, d in enumerate(docs)]


def plain_near(docs):
    def shingles(text):
        w = (text or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}

    rows = sorted(docs, key=lambda d: d["doc_id"])
    sets = [shingles(d["text"]) for d in rows]
    top = groups(len(rows), lambda i, j: len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j]))
    return [d for i, d in enumerate(rows) if top[i] == i]


def plain_mix(docs):
    sizes, out = Counter(), []
    for d in docs:
        sizes[d["source"]] += len((d["text"] or "").split())
    names = sorted(sizes)
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3 * sizes[s] for s in over}
        left, free = left - sum(3 * sizes[s] for s in over), free - over
    for s in names:
        whole = int(target[s] // sizes[s]) if sizes[s] else 0
        extra = int(target[s] - whole * sizes[s])
        for d in sorted((d for d in docs if d["source"] == s), key=lambda d: hashlib.md5(f"42:{d['doc_id']}".encode()).hexdigest()):
            found = (d["text"] or "").split()
            part = min(len(found), max(0, extra))
            extra -= len(found)
            out += [d] * (whole + (part == len(found))) if found else []
            out += [d | {"text": " ".join(found[:part])}] if 0 < part < len(found) else []
    return out


def test_each_stage_of_the_pipeline_is_the_plain_one(spark):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    body = [prose(60) for _ in range(6)]
    docs = []
    for i in range(70):
        text = "\n".join(["Home | About 2024", RNG.choice(body) if i % 3 else prose(70), prose(12)] + ([prose(4)] if i % 5 else []))
        docs.append({"doc_id": i, "text": text if i % 11 else RNG.choice([None, "", "short one", "a b c " * 60]), "source": "big" if i % 4 else f"s{i % 3}", "lang": "en"})
    schema = "doc_id long, text string, source string, lang string"
    rows = lambda found: Counter(tuple(d.values()) for d in found)
    frame = spark.createDataFrame([tuple(d.values()) for d in docs], schema)
    plain = {"quality_rules": plain_quality, "line_dedup": plain_lines, "near_dedup": plain_near, "mix_sources": plain_mix}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [r.asDict() for r in frame.collect()]
        got = stage(spark, frame, "").collect()
        assert rows(r.asDict() for r in got) == rows(plain[name](before)), name
        frame = spark.createDataFrame(got, schema)
    assert frame.count() > 10
    encoded = corpus_pipeline.STAGES[-1][1](spark, frame, "").collect()
    assert Counter((r.doc_id, tuple(r.token_ids)) for r in encoded) == Counter((r.doc_id, tuple(sp.encode(r.text or "", add_eos=True))) for r in frame.collect())
    empty = spark.createDataFrame([], schema)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, "").count() == 0


def test_links_of_a_large_group_connect_what_is_similar(spark):
    rng, found = random.Random(9), []
    for base in ([rng.choice(VOCABULARY) + str(i) for i in range(24)] for _ in range(3)):
        for share in (0, 1, 2, 3, 4, 5, 6, 8, 10):
            for _ in range(4):
                words = list(base)
                for _ in range(share):
                    k = rng.randrange(len(words))
                    words[k : k + 1] = rng.choice([[], ["new"], ["ab", "cd"], [words[k] + "x"]])
                found.append(" ".join(words))
    found = list(dict.fromkeys(found))
    schema = "line long, simhash long, plain string, cells array<long>"
    frame = spark.createDataFrame([(i, 0, x, [lines.meeting.GROUP | 5]) for i, x in enumerate(found)], schema)
    near = lambda i, j: 1 - distance(found[i], found[j]) / max(len(found[i]), len(found[j])) >= 0.8 - 1e-12
    top = groups(len(found), near)
    for few in (0, 1000):
        links = [(r.a, r.b) for r in lines.verified_links(frame, lines.Blocks(5), few).collect()]
        assert all(near(a, b) for a, b in links)
        linked = {frozenset(p) for p in links}
        assert groups(len(found), lambda i, j, linked=linked: frozenset((i, j)) in linked) == top and len(set(top)) > 3

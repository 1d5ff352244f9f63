"""Each operator on awkward rows (nulls, empty and long texts, ties, repeated rows, clashing columns) and on empty tables, against brute force."""

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from evispark.llm import bpe, components, hosts, langid, lines, maxent, mixing, omh, quality, queries, simhash, warc

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, key string, cell string, line string, __size string"
random.seed(7)
WORDS = ["the", "of", "and", "maison", "Straße", "x1", "##", "été", "niño", "run"] + ["".join(random.choice("abcdeé") for _ in range(random.randint(2, 9))) for _ in range(300)]


def prose(n):
    return " ".join(random.choice(WORDS) for _ in range(n))


BASE = prose(120)
ROWS = [
    (1, BASE, "en", "a"), (2, BASE, "en", "a"), (3, BASE + " more", "fr", "b"), (4, None, None, None), (5, "", "de", "b"), (6, " \n\t", "de", None),
    (7, prose(3), "en", "a"), (8, prose(3000) + "\n" + prose(40), "en", "a"), (8, prose(60), "fr", "b"), (None, prose(70), "en", "c"), (9, "a b c " * 40, "es", "c"),
    (10, BASE, "en", "a"), (10, BASE, "en", "a"), (11, "0 1 2 --", "en", "a"), (12, "漢字 かな \x00 é\n" + prose(80), "en", "d"),
] + [(20 + i, prose(90) + "\nthis line is on many pages\n" + prose(20), "en", "big") for i in range(30)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "k", "c", "l", "s") for r in ROWS], SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return (text or "").encode().lower().split()


def test_sql(same):
    for name, sql in queries.ORACLE_SQL.items():
        same(queries.QUERIES[name], sql)


def test_quality(docs, none):
    def base(text):
        w = [x for x in re.findall(r"[^\x20\x09-\x0D]+", text or "")]
        tri = Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
        rep = {j for i in range(len(w) - 2) if tri[tuple(w[i : i + 3])] > 1 for j in (i, i + 1, i + 2)}
        return len(w), len(rep)

    got = quality.judged(docs).select("text", "__base.*", "__kept").collect()
    assert len(got) == len(ROWS) and all((r.n_words, r.n_repeat_words) == base(r.text) for r in got)
    assert quality.judged(none).count() == 0
    kept = quality.cleaned(docs)
    assert kept.columns == docs.columns and all("many pages" not in r.text for r in kept.where("source = 'big'").collect()) and kept.where("source = 'big'").count() == 30
    assert quality.judged(docs, broadcast_lines=-1).where("__kept").count() == kept.count()


def test_sentencepiece(docs, none):
    sentencepiece = pytest.importorskip("sentencepiece")
    sp = sentencepiece.SentencePieceProcessor(model_file=queries.model_path())
    with open(queries.model_path(), "rb") as file:
        model = bpe.Model(file.read())
    alphabet = "abcdefgh  \n\t▁éßñ漢𐍈\x00 the ing</s><s>.,0123 "
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 60))) for _ in range(1500)] + [r[1] or "" for r in ROWS]
    for t in texts:
        ids = sp.encode(t, add_eos=True)
        assert model.encode(t, True) == ids and model.decode(ids) == sp.decode(ids)
    for _ in range(1500):
        ids = [random.choice([2, 0, 1, 259, random.randint(3, 258), random.randint(3, 258), random.randint(259, 31999)]) for _ in range(random.randint(0, 8))]
        assert model.decode(ids) == sp.decode(ids)
    got = bpe.encode_texts(docs, queries.model_path(), with_ids=True).collect()
    assert Counter(tuple(r.token_ids) for r in got) == Counter(tuple(sp.encode(r[1] or "", add_eos=True)) for r in ROWS)
    assert bpe.encode_texts(none, queries.model_path()).count() == 0


def plain_distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, e in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (c != e))
    return row[-1]


def test_edit_distance():
    for _ in range(1500):
        a, b = ("".join(random.choice("abc") for _ in range(random.randint(0, 14))) for _ in "xy")
        assert lines.distance(a, b) == plain_distance(a, b)
    for _ in range(500):
        a = [random.choice(WORDS) for _ in range(30)]
        b = [w for w in a if random.random() > 0.06]
        for _ in range(random.randint(0, 4)):
            b.insert(random.randint(0, len(b)), random.choice(WORDS))
        a, b = " ".join(a), " ".join(b)
        assert lines.similar(a, b) == (1 - plain_distance(a, b) / max(len(a), len(b)) >= 0.8 - 1e-12)


def roots(n, links):
    up = list(range(n))

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in links:
        a, b = sorted((top(a), top(b)))
        up[b] = a
    return [top(i) for i in range(n)]


def test_line_dedup(spark, docs, none):
    long = " ".join(WORDS[20:80])
    near = [long, long.replace(WORDS[25], WORDS[25] + "x", 1), long.upper() + "!", long[::-1]]
    rows = [(i, "\n".join(random.choices(near, k=3)) + "\n\n" + prose(12), "en", "a") for i in range(40)] + ROWS
    frame = spark.createDataFrame([(*r, 0, "k", "c", "l", "s") for r in rows], SCHEMA)
    order = sorted({(r[0] is None, r[0] or 0, xxhash_key(spark, r), r[1]) for r in rows}, key=lambda r: r[:3])
    occurrences = [(d, pos, b" ".join(w)) for d, r in enumerate(order) for pos, w in lines.normalised(r[3] or "")]
    distinct = list(dict.fromkeys(x for _, _, x in occurrences))
    hashes = lines.simhashes([x.split() for x in distinct], lines.Hashes())
    links = [(i, j) for i in range(len(distinct)) for j in range(i) if int(np.bitwise_count(hashes[i] ^ hashes[j])) <= 3 and 1 - plain_or_fast(distinct[i].decode(), distinct[j].decode()) >= 0.8 - 1e-12]
    group, seen, gone = dict(zip(distinct, roots(len(distinct), links), strict=True)), set(), Counter()
    for d, _, line in occurrences:
        gone[order[d][1], order[d][3]] += group[line] in seen
        seen.add(group[line])
    got = lines.deduplicated(frame, wide=False).collect()
    assert len(got) == len(rows) and all(r["__gone"] == gone[r.doc_id or 0, r.text] for r in got)
    assert lines.cleaned(docs).columns == docs.columns and lines.deduplicated(none).count() == 0


def xxhash_key(spark, row, memo={}):  # noqa: B006
    if row[:2] not in memo:
        memo[row[:2]] = spark.createDataFrame([row[:2]], "doc_id long, text string").select(F.xxhash64("doc_id", F.coalesce("text", F.lit("")))).first()[0]
    return memo[row[:2]]


def plain_or_fast(a, b):
    return lines.distance(a, b) / max(len(a), len(b))


def test_simhash(docs, none):
    def brute(text):
        w = words(text)
        s = [b" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))] if w else []
        h = [xxhash.xxh64_intdigest(x, 42) for x in s]
        return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0

    fps = [brute(r[1]) for r in ROWS]
    top = roots(len(ROWS), [(i, j) for i in range(len(ROWS)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    least = {t: min((ROWS[i][0] for i in range(len(ROWS)) if top[i] == t and ROWS[i][0] is not None), default=None) for t in set(top)}
    got = simhash.near_duplicates(docs).select("doc_id", simhash.fingerprint_hex(F.col("fp")), "component_id").collect()
    assert Counter(map(tuple, got)) == Counter((r[0], f"{f:016x}", least[t]) for r, f, t in zip(ROWS, fps, top, strict=True))
    assert simhash.keep_one(docs).count() == len(set(top)) and simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("segment_bits", [1, 2, 4, 8])
def test_no_link_is_lost(spark, segment_bits):
    rng = np.random.default_rng(segment_bits)
    seeds = rng.integers(0, 1 << 63, 30, np.uint64)
    fps = {int(s) for s in seeds}
    for s in seeds:
        for _ in range(15):
            s = int(s) ^ sum(1 << int(b) for b in rng.choice(64, rng.integers(1, 7), replace=False))
            fps.add(s)
    fps = sorted(fps)
    signed = np.array(fps, np.uint64).view(np.int64).tolist()
    links = simhash.near_links(spark.createDataFrame([(x,) for x in signed], "fp long"), segment_bits=segment_bits)
    found = {r.node: r.root for r in components.components(links, "a", "b").collect()}
    top = roots(len(fps), [(i, j) for i in range(len(fps)) for j in range(i) if (fps[i] ^ fps[j]).bit_count() <= 4])
    groups = lambda label: {frozenset(x for x in signed if label(x) == k) for k in {label(x) for x in signed}}
    at = dict(zip(signed, top, strict=True))
    assert groups(lambda x: found.get(x, x)) == groups(at.get)


def test_chain_and_star_components(spark):
    pairs = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 160)] + [(7, 7), (None, 3)]
    got = dict(map(tuple, components.components(spark.createDataFrame(pairs, "a long, b long"), "a", "b").collect()))
    assert got == {i: 0 for i in range(41)} | {i: 100 for i in range(100, 160)}


def test_language(spark, docs, none):
    got = langid.identify(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        assert r.held_out == (zlib.crc32(str("" if r.doc_id is None else r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1
    assert {r.lang_pred for r in got if r.doc_id in (4, 5, 6, 11)} == {"und"} and langid.identify(none).count() == 0
    table = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    right = langid.identify(table).where("held_out").join(table.select("doc_id", "lang"), "doc_id").select(F.avg((F.col("lang") == F.col("lang_pred")).cast("int"))).first()[0]
    assert right > 0.95


def test_order_minhash(spark, none):
    rows = [(i, t) for i, t in enumerate([None, "", "short", prose(50), prose(400), prose(400), "x" * 40_000, "é漢𐍈" * 30])]
    got = {r.doc_id: r for r in omh.fingerprints(spark.createDataFrame(rows, "doc_id long, text string"), shard_bytes=2000).collect()}
    for i, t in rows:
        t, after = t or "", rows[i - 1][1] or ""
        edited = t[: len(t) - len(t) // 3] + after[: len(t) // 3]
        r = got[i]
        assert (r.n_chars, r.edited_sha256) == (len(t), hashlib.sha256(edited.encode()).hexdigest())
        assert r.fingerprint == omh.sketch(omh.codes_of(t)).tobytes().hex() and r.edited_fingerprint == omh.sketch(omh.codes_of(edited)).tobytes().hex()
        assert r.near_next == omh.likeness(omh.sketch(omh.codes_of(t)), omh.sketch(omh.codes_of(after)))
    assert got[4].near_edited > got[4].near_next and omh.fingerprints(none).count() == 0
    big = omh.codes_of(prose(3000))
    assert (omh.sketch(big) == omh.sketch(big, step=64)).all()
    swapped = np.r_[big[len(big) // 2 :], big[: len(big) // 2]]
    assert 0.2 < omh.likeness(omh.sketch(big), omh.sketch(swapped)) < 0.9  # the same k-mers, another order


def test_lm_scores(docs, none):
    held = lambda i: zlib.crc32(str("" if i is None else i).encode()) % 5 == 1
    counts = Counter(w for r in ROWS if not held(r[0]) for w in [*words(r[1]), b""])
    total, distinct = sum(counts.values()), len(counts)

    def base(text):
        w = [*words(text), b""]
        return held, len(w), sum(counts[x] > 0 for x in w), round(sum(np.log10((counts[x] + 0.5) / (total + 0.5 * (distinct + 1))) for x in w), 6)

    for limit in (maxent.FREQUENT, 10):
        got = maxent.scores(docs, frequent=limit).collect()
        assert Counter((r.held_out, r.n_tokens, r.n_known, round(r.base_score, 6)) for r in got) == Counter((held(r[0]), *base(r[1])[1:]) for r in ROWS)
        assert all(r.train_tokens == total and r.score < 0 for r in got)
    assert maxent.scores(none).count() == 0


def test_mixing(spark, docs, none):
    got = mixing.mix(docs.select("doc_id", "source", "text")).collect()
    assert len(got) == len(ROWS) and all(0 <= r["__taken"] <= 3 * r["__size"] for r in got)
    taken, goal = Counter(), {}
    for r in got:
        taken[r.source] += r["__taken"]
        goal[r.source] = r["__target"]
    assert all(abs(taken[s] - goal[s]) <= 1 for s in goal)
    assert sorted(map(tuple, got), key=str) == sorted(map(tuple, mixing.mix(docs.select("doc_id", "source", "text")).collect()), key=str)
    sizes = {s: sum(len((r[1] or "").split()) for r in ROWS if r[3] == s) for s in {r[3] for r in ROWS}}
    names = sorted(x for x in sizes if x is not None) + [None]
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    target, free, left = {}, set(names), sum(sizes.values())
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if 3 * sizes[s] <= level * weight[s]}
        if not over:
            target |= {s: level * weight[s] for s in free}
            break
        target |= {s: 3 * sizes[s] for s in over}
        left -= sum(3 * sizes[s] for s in over)
        free -= over
    assert all(abs(goal[s] - target[s]) < 1e-6 * max(1, target[s]) for s in names)
    copies = mixing.repeated(docs)
    assert copies.columns == docs.columns and sum(len(r.text.split()) for r in copies.collect()) == pytest.approx(sum(taken.values()), abs=60)
    assert mixing.mix(none.select("doc_id", "source", "text")).count() == 0


def test_warc(spark, none, tmp_path):
    big, other = "x" * 2000, "é" * 600
    rows = [(1, "http://a/", big), (2, "http://a b/\n", big), (3, None, big), (3, "u", big), (4, "u", "small"), (5, "u", "small"), (6, "u", None), (None, "u", big), (7, "u", other), (8, "u", other)]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "page_id long, url string, html string, digest string")
    for place in "ab":
        warc.write(frame, f"file://{tmp_path}/{place}", roll_bytes=300, shard_bytes=3000)
    got = warc.read(spark, f"file://{tmp_path}/a")
    wanted = Counter([(1, "revisit", 3), (2, "revisit", 3), (3, "response", None), (3, "revisit", 3), (4, "response", None), (5, "response", None), (6, "response", None), (None, "revisit", 3), (7, "revisit", 8), (8, "response", None)])
    assert Counter((r.page_id, r.record_type, r.refers_to) for r in got.collect()) == wanted
    assert Counter((r.payload_bytes, r.payload_digest) for r in got.collect()) == Counter((len((h or "").encode()), hashlib.sha1((h or "").encode()).hexdigest()) for _, _, h in rows)
    names = [sorted((p.name, p.read_bytes()) for p in (tmp_path / place).glob("*.warc.gz")) for place in "ab"]
    assert names[0] == names[1] and len(names[0]) > 2 and not list((tmp_path / "a/_temporary").iterdir())
    damaged = names[0][0][1][:-9]
    with pytest.raises(ValueError):
        list(warc.records(iter([damaged])))
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    warc.write(empty, f"file://{tmp_path}/none")
    assert warc.read(spark, f"file://{tmp_path}/none").count() == 0


def test_url_filters(spark):
    urls = ["http://A.com/en/x", "http://example.com/en/7z", "https://sub.example.net/de/8/1", "x://net/de/", "http://org/es/?q", None, "no url", "http://bad.io/", "http://bad.io/2", "http://notnet/de/", "http://good.io#/"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls)] + [(100 + i, "http://bad.io/x", "h") for i in range(40)] + [(200 + i, f"http://h{i % 9}.org/x", "h") for i in range(90)], "page_id long, url string, host string")
    labels = spark.createDataFrame([(100 + i, 0, 1) for i in range(40)] + [(200 + i, 1, 0) for i in range(90)] + [(5, None, None), (None, 1, 1)], "doc_id long, quality int, toxic int")
    got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in hosts.judge(pages, labels).collect()}
    assert got[0] == ("a.com", "/en/x", "com/en/", "block") and got[1][2:] == ("example.com/en/7", "allow") and got[2][2:] == ("example.net/de/8", "block")
    assert got[3][2:] == ("net/de/", "allow") and got[4] == ("org", "/es/", "org/es/", "block") and got[5] == got[6] == ("", "", None, "allow")
    assert got[7][3] == got[8][3] == "block" and got[9][2:] == (None, "allow") and got[10][:2] == ("good.io", "")
    assert hosts.judge(pages.limit(0), labels).count() == 0 and hosts.judge(pages, labels.limit(0)).where("verdict = 'block'").count() == 3


def test_pipeline(spark, docs):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "line_dedup", "near_dedup", "mix_sources", "sentencepiece"]
    frame = docs
    for _, stage in corpus_pipeline.STAGES[:-1]:
        frame = stage(spark, frame, "")
        assert frame.columns == docs.columns
    assert corpus_pipeline.STAGES[-1][1](spark, frame, "").count() == frame.count() > 0


def test_registered_domains(spark):
    """Two labels are a suffix where a country's follows a kind of registrant, whatever the country."""
    known = {"a.b.example.com": "example.com", "x.y.co.uk": "y.co.uk", "www.uni.ac.at": "uni.ac.at", "z.gob.mx:8080": "z.gob.mx", "shop.me.com": "me.com", "co.uk": "co.uk", "a.de.com": "de.com", "localhost": "localhost", "": "", "k.ne.jp": "k.ne.jp", "b.k.ne.jp": "k.ne.jp", "d.co.info": "co.info"}
    rows = spark.createDataFrame([(h,) for h in known], "host string")
    assert {r.host: r.d for r in rows.select("host", hosts.domain_of(F.col("host")).alias("d")).collect()} == known

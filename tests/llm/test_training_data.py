"""Operators of the llm subpackage against brute force, exact round trips and held-out accuracy."""

import base64
import gzip
import hashlib
import os
import random
import re
import time
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from matquarry.llm import bpe, exactdup, fingerprints, langid, neardup, packing, quality, queries, textkit, toxicity, urlfilter, warc

RANKS, JSON, PATTERN = public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, keep_id string"
WORDS = [f"w{i}" for i in range(400)]


def words(n, seed):
    r = random.Random(seed)
    return " ".join(r.choice(WORDS) for _ in range(n))


def edited(text, n, seed):
    r, w = random.Random(seed), text.split()
    for _ in range(n):
        w[r.randrange(len(w))] = f"x{r.randrange(10**6)}"
    return " ".join(w)


@pytest.fixture(scope="module")
def rows():
    base = words(300, 1)
    texts = [words(80, k) for k in range(20)] + [base, base.upper(), base] + [edited(base, 3, k) for k in range(12)]
    texts += ["", None, "one two", "one two", "é" * 5000 + " " * 40 + "漢字 <|endoftext|>", "\n\n \t x  y\n", words(6000, 9)]
    out = [(i, t, "en", "s", len(t or ""), "clash") for i, t in enumerate(texts)]
    return out + [out[3], (None, "no id", None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = (t or "").split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def test_fingerprints(docs, rows, empty):
    got = [r for r in fingerprints.with_neighbour(docs).collect() if r.doc_id is not None]
    assert len(got) == len(rows) - 1
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0), r[1] or ""))
    expected = set()
    for i, r in enumerate(order):
        t, nxt = r[1] or "", order[(i + 1) % len(order)][1] or ""
        h = len(t) // 2
        expected.add((r[0], hashlib.sha256((t[: len(t) - h] + nxt[:h]).encode()).hexdigest()))
    assert {(r.doc_id, r.edited_sha256) for r in got} <= expected
    by_text = {}
    for r in got:
        t = next(x[1] or "" for x in rows if x[0] == r.doc_id)
        assert by_text.setdefault(t, r.fingerprint) == r.fingerprint
    assert fingerprints.with_neighbour(empty).count() == 0


def test_sketches_estimate_and_merge(docs):
    a, b = words(3000, 1).encode(), (words(3000, 1) + " " + words(1500, 2)).encode()
    x, y = fingerprints.sketches([a, b])
    true = len(shingles(a.decode()) & shingles(b.decode())) / len(shingles(a.decode()) | shingles(b.decode()))
    assert abs(fingerprints.resemblance(x, y) - true) < 0.12
    assert abs(fingerprints.containment(x, y) - 1) < 0.15
    assert abs(fingerprints.distinct(y) / len(shingles(b.decode())) - 1) < 0.25
    whole = fingerprints.fingerprint(docs.withColumn("k", F.when(F.col("doc_id") % 2 == 0, F.col("doc_id") % 3)))
    expected = {}
    for r in whole.collect():
        own = expected.setdefault(r.k, set())
        own |= set(fingerprints.load(r.fingerprint).tolist())
    old, fingerprints.FOLDED = fingerprints.FOLDED, 1
    try:
        got = {r.k: set(fingerprints.load(r.fingerprint).tolist()) for r in fingerprints.merged(whole, ["k"]).collect()}
    finally:
        fingerprints.FOLDED = old
    assert got == {k: set(sorted(v)[: fingerprints.K]) for k, v in expected.items()}
    everything = fingerprints.merged(whole, []).collect()
    assert [set(fingerprints.load(r.fingerprint).tolist()) for r in everything] == [set(sorted(set().union(*expected.values()))[: fingerprints.K])]


def test_fingerprint_likeness_against_all_shingles(spark):
    """Below k shingles sketches hold them all, so likeness is exact."""
    rows = [(i, words(60, i // 2) + (f" tail{i}" if i % 2 else "")) for i in range(30)] + [(2**60 + 1, words(40, 77)), (2**60 + 3, None), (None, words(50, 3))]
    got = {r.doc_id: r for r in fingerprints.with_neighbour(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got) == {r[0] for r in rows}
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    like = lambda x, y: len(x & y) / len(x | y) if x | y else 1.0
    for i, (doc_id, text) in enumerate(order):
        t, nxt = text or "", order[(i + 1) % len(order)][1] or ""
        edit = t[: len(t) - len(t) // 2] + nxt[: len(t) // 2]
        assert got[doc_id].near_edited == pytest.approx(like(shingles(t), shingles(edit)))
        assert got[doc_id].near_next == pytest.approx(like(shingles(t), shingles(nxt)))


def test_bpe_equals_the_library(docs, rows, empty):
    e = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=bpe.read_ranks(RANKS), special_tokens={})
    got = {r.doc_id: r for r in bpe.round_trip(docs, RANKS, PATTERN).collect()}
    for doc_id, t, *_ in rows:
        ids = e.encode_ordinary(t or "")
        assert got[doc_id].n_tokens == len(ids)
        assert got[doc_id].ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert got[doc_id].decoded_sha256 == hashlib.sha256((t or "").encode()).hexdigest()
    own, r = bpe.Encoder(bpe.read_ranks(RANKS), PATTERN), random.Random(3)
    for _ in range(200):
        w = "".join(r.choice(r.choice(["ab", "etaoin", " \n", "é漢'", "=-_"])) for _ in range(r.choice([3, 40, 300])))
        assert np.frombuffer(own.packed(w), "<u4").tolist() == e.encode_ordinary(w)
    assert bpe.round_trip(empty, RANKS, PATTERN).count() == 0
    back = bpe.decode(bpe.encode(docs, RANKS, PATTERN), RANKS, PATTERN, out="again")
    assert back.where("coalesce(text, '') <> again").count() == 0


def test_packing(docs, rows, empty):
    t = Tokenizer.from_file(JSON)
    assert any("<|endoftext|>" in (r[1] or "") for r in rows)
    got = packing.pack(docs, JSON, 512).collect()
    space, ids = {}, {r[0]: np.array([*t.encode(r[1] or "", add_special_tokens=False).ids, 0], "<u4") for r in rows}
    for r in got:
        assert zlib.crc32(ids[r.doc_id][r.start : r.start + r.length].tobytes()) == r.ids_crc32
        space.setdefault(r.sequence_id, []).append((r.offset, r.length))
    for pieces in space.values():
        end = 0
        for offset, length in sorted(pieces):
            assert offset == end
            end += length
        assert end <= 512
    total = sum(len(ids[r[0]]) for r in rows)
    assert sum(r.length for r in got) == total
    assert len(space) <= -(-total // 512) + 1
    assert packing.pack(empty, JSON).count() == 0


def test_supersteps_pack_as_tight_as_best_fit(spark):
    """Sequences against sequential best-fit of the same lengths, longest first; every document has a place."""
    r = random.Random(5)
    lengths = [r.choice([r.randrange(1, 60), r.randrange(1, 700), r.randrange(1, 2049), 2048]) for _ in range(3000)]
    count = {n: lengths.count(n) for n in set(lengths)}
    plan = packing.match(spark.createDataFrame(list(count.items()), "length long, n long"))
    used, ranks = {}, {}
    for x in plan.collect():
        for i in range(x.n):
            used.setdefault(x.sequence + i, []).append((x.offset, x.length))
            ranks.setdefault(x.length, []).append(x.rank + i)
    assert {n: sorted(x) for n, x in ranks.items()} == {n: list(range(c)) for n, c in count.items()}
    for some in used.values():
        end = 0
        for offset, length in sorted(some):
            assert offset == end
            end += length
        assert end <= 2048
    gaps = []
    for n in sorted(lengths, reverse=True):
        fit = [g for g in gaps if g >= n]
        best = min(fit) if fit else 2048
        if fit:
            gaps.remove(best)
        gaps.append(best - n)
    assert len(used) <= len(gaps) + 2


def test_exact_dedup_with_colliding_digests(docs, rows, empty):
    norm = lambda s: (s or "").translate({c: c + 32 for c in range(65, 91)})
    for bytes_ in (16, 1):
        got = exactdup.report(docs, digest_bytes=bytes_).collect()
        assert len(got) == len(rows)
        for r in got:
            t = next(norm(x[1]) for x in rows if x[0] == r.doc_id)
            same = [x[0] for x in rows if norm(x[1]) == t]
            assert (r.keep_id, r.group_size) == (max((x for x in same if x is not None), default=None), len(same))
            assert r.text_sha256 == hashlib.sha256(t.encode()).hexdigest()
    kept = exactdup.dedup(docs)
    assert kept.columns == docs.columns
    assert kept.count() == len({norm(r[1]) for r in rows})
    assert exactdup.report(empty).count() == 0
    assert exactdup.dedup(empty).count() == 0


def test_exact_dedup_of_repeated_ids(spark):
    rows = [(5, "A text"), (5, "B text"), (9, "b text"), (7, "Foo"), (7, "foo"), (7, "foo"), (None, "x"), (None, "X"), (2**60 + 1, "y"), (None, "Y")]
    docs = spark.createDataFrame([(*r, 1, 2) for r in rows], "doc_id long, text string, __sha int, part int")
    kept = exactdup.dedup(docs)
    assert kept.columns == docs.columns
    got = [(r.doc_id, r.text.lower()) for r in kept.collect()]
    assert sorted(got, key=str) == sorted([(5, "a text"), (9, "b text"), (7, "foo"), (None, "x"), (2**60 + 1, "y")], key=str)
    weak = exactdup.dedup(docs, digest_bytes=0).collect()  # all digests collide
    assert sorted(weak, key=str) == sorted(kept.collect(), key=str)


def test_near_duplicates(spark, docs, rows, empty):
    got = {r.doc_id: r for r in neardup.classes(docs).collect()}
    texts = {r[0]: r[1] or "" for r in rows if r[0] is not None}
    for a in texts:
        for b in texts:
            x, y = shingles(texts[a]), shingles(texts[b])
            if texts[a] == texts[b] or (x | y and len(x & y) / len(x | y) >= 0.82):
                assert got[a].class_id == got[b].class_id
    assert got[0].class_id != got[1].class_id
    one = neardup.one_each(docs.withColumn("__sha", F.lit(1)))
    assert one.columns == [*docs.columns, "__sha"]
    shared_id = spark.createDataFrame([(1, words(50, 1)), (1, words(50, 2)), (1, words(50, 2)), (None, words(50, 1)), (None, "z"), (0, None), (0, "")], "doc_id long, text string")
    assert sorted(((r.doc_id, r.text or "") for r in neardup.one_each(shared_id).collect()), key=str) == sorted([(1, words(50, 1)), (1, words(50, 2)), (None, "z"), (0, "")], key=str)
    assert one.where("doc_id is not null").count() == len({r.class_id for r in got.values() if r.class_id is not None})
    assert neardup.classes(empty).count() == 0


def test_near_duplicates_of_large_mixed_buckets(spark):
    """Edits of one absent base share its buckets, but only those of one chain are similar: held against all pairs."""
    base, texts = words(300, 1), []
    for k in range(150):
        at = random.Random(k).sample(range(5, 290, 6), 11)
        for chosen in (at[:5], at[:2] + at[5:8], at[5:8] + at[9:])[: 3 if k % 3 == 0 else 2]:
            texts.append(" ".join(f"x{k}-{i}" if i in chosen else t for i, t in enumerate(base.split())))
    found, column = [], {}
    for t in texts:
        w, seen = t.split(), {}
        each = [tuple(w[i : i + 5]) for i in range(len(w) - 4)]
        nth = [seen[s] for s in each if not seen.update({s: seen.get(s, 0) + 1})]
        found.append([column.setdefault(x, len(column)) for x in zip(each, nth, strict=True)])
    x = np.zeros((len(texts), len(column)), np.float32)
    for i, f in enumerate(found):
        x[i, f] = 1
    both, n = x @ x.T, x.sum(1)
    near = both >= 0.8 * (n[:, None] + n[None, :] - both) - 1e-6
    label = np.arange(len(texts))
    while (new := np.array([label[row].max() for row in near])).tolist() != label.tolist():
        label = new
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(label.tolist()))


def test_components_of_long_chains(spark):
    r = random.Random(2)
    order = r.sample(range(10**6), 1000)
    edges = [(order[i], order[i + 1]) for i in range(999) if i % 250] + [(-1, k) for k in range(-50, -1)]
    began = time.time()
    got = {x.node: x["class"] for x in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert time.time() - began < 120
    for k in range(0, 1000, 250):
        run = order[k + (k > 0) : k + 251] if k else order[1:251]
        assert {got[x] for x in run} == {min(run)}
    assert {got[x] for x in range(-50, 0)} == {-50}


def test_near_duplicates_of_one_template(spark):
    """240 texts, each one edit of a template that is not among them: one class."""
    base = words(120, 4).split()
    texts = []
    for i in range(240):
        w = list(base)
        w[random.Random(i).randrange(120)] = f"y{i}"
        texts.append(" ".join(w))
    got = neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert {r.class_id for r in got} == {239}
    assert [r.doc_id for r in got if r.kept] == [239]


def test_recall_against_all_pairs(spark):
    """Pairs of every similarity: those of 0.8 or more share a class, and classes hold no others."""
    texts = []
    for k in range(60):
        base = words(200, 100 + k)
        texts += [base] + [edited(base, n, 7 * k + n) for n in (1, 3, 4, 5, 8)]
    found = [shingles(t) for t in texts]
    label, linked = list(range(len(texts))), 0
    for i in range(len(texts)):
        for j in range(i // 6 * 6, i):
            if len(found[i] & found[j]) >= 0.8 * len(found[i] | found[j]):
                linked += 1
                low, high = sorted((label[i], label[j]))
                label = [high if x == low else x for x in label]
    got = {r.doc_id: r.class_id for r in neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert linked > 100
    assert sum(got[i] == label[i] for i in range(len(texts))) >= 0.99 * len(texts)


def test_tokens_are_counted_and_found(spark, monkeypatch):
    r = random.Random(9)
    some = {i: sorted(r.sample(range(-40, 40), r.randrange(0, 30))) for i in range(60)}
    sets = spark.createDataFrame([(i, bytearray(np.array(x, np.int32).tobytes())) for i, x in some.items()], "node long, set binary")
    texts = spark.createDataFrame([(i, i) for i in range(50)], "node long, score long")
    expected = {}
    for i in range(50):
        for t in some[i]:
            expected.setdefault(t, []).append((len(some[i]), i))
    for counted in (20, 10**6):
        monkeypatch.setattr(neardup, "COUNTED", counted)
        got = {x.token: (x.often, x.least, x.node) for x in neardup.token_counts(texts, sets).collect()}
        assert got == {t: (len(x), min(n for n, _ in x), min(i for _, i in x)) for t, x in expected.items()}
    sought = spark.createDataFrame([(t,) for t in (-3, 5, 17, 999)], "token int")
    counts, prefixes = neardup.token_counts(texts, sets), []
    for bound in (0, 10**6):
        monkeypatch.setattr(neardup, "SOUGHT", bound)
        prefixes.append(sorted((x.node, x.token, x.size, x["at"]) for x in neardup.prefixes(texts, counts, sets, 0.5).collect()))
        assert prefixes[0] == prefixes[-1] and len(prefixes[0]) > 50
        got = sorted((x.token, x.node, x.size) for x in neardup.having(sought, texts, sets).collect())
        assert got == sorted((t, i, len(some[i])) for t in (-3, 5, 17) for i in range(50) if t in some[i])


def test_signatures_estimate_weighted_similarity():
    a = [words(3, 5)] * 150 + [words(200, 6)]
    b = [words(3, 5)] * 110 + [words(200, 6)]
    texts = [" ".join(x).encode() for x in (a, b)]
    x, y = neardup.occurrences(texts)
    true = len(np.intersect1d(x, y)) / len(np.union1d(x, y))
    owner, element, weight = neardup.weighted(texts)
    s = neardup.signatures(owner, element, weight, 2, 3000)
    assert weight.max() > 100
    assert abs((s[0] == s[1]).mean() - true) < 0.04


def test_warc_ranges_and_revisits(spark):
    noise = random.Random(1).randbytes(400).hex()
    html = ["a" * 3000, "same", "same", None, "", "x\x1f\x8b\x08y" + noise, "é漢"] * 3
    pages = spark.createDataFrame([(i, f"http://a.example/{i} b" if i % 5 else None, h, "x") for i, h in enumerate(html)], "page_id long, url string, html string, payload string")
    expected = {}
    for i, h in enumerate(html):
        last = max(k for k, g in enumerate(html) if (g or "") == (h or ""))
        raw = (h or "").encode()
        expected[i] = (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "response" if i == last else "revisit", None if i == last else last)
    for size in (64, 700, 1 << 20):
        got = warc.archive(pages, size=size).collect()
        assert {r.page_id: (r.payload_bytes, r.payload_digest, r.record_type, r.refers_to) for r in got} == expected
        assert len(got) == len(html)
    member = warc.record(1, "http://a.example/", b"hi", None)
    assert gzip.decompress(member + warc.EMPTY_MEMBER + member).count(b"WARC/1.1") == 2
    assert warc.archive(pages.limit(0)).count() == 0
    assert warc.archive(pages, min_revisit=10**6).where("record_type = 'revisit'").count() == 0


def test_warc_large_ids_and_damage(spark, tmp_path):
    ids = [2**60 + 1, 2**60 + 3, 2**60 + 5, None]
    pages = spark.createDataFrame([(i, None, "same", 1, "d") for i in ids], "page_id long, url string, html string, content int, deal string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.archive(pages).collect()}
    assert got == {ids[0]: ("revisit", ids[2]), ids[1]: ("revisit", ids[2]), ids[2]: ("response", None), None: ("revisit", ids[2])}
    members = [warc.record(i, "http://a.example/", random.Random(i).randbytes(300), None) for i in range(9)]
    whole = warc.EMPTY_MEMBER.join(members)
    at = len(warc.EMPTY_MEMBER.join(members[:4])) + len(warc.EMPTY_MEMBER)
    for name, raw in (("cut", whole[:-30]), ("header", whole[:at] + b"x" + whole[at + 1 :]), ("body", whole[: at + 200] + bytes(20) + whole[at + 220 :]), ("start", b"junk" + whole)):
        (tmp_path / name).write_bytes(raw)
        for size in (100, 1 << 20):
            with pytest.raises(Exception, match="damaged|digest"):
                warc.read(spark, str(tmp_path / name), size).collect()
    (tmp_path / "whole").write_bytes(whole)
    assert warc.read(spark, str(tmp_path / "whole"), 100).count() == 9


@pytest.mark.parametrize("between", [b"", warc.EMPTY_MEMBER])
@pytest.mark.parametrize("size", [64, 500, 3000, 1 << 20])
def test_warc_no_damage_goes_unseen(tmp_path, between, size):
    """Every member damaged in turn, read by ranges: one of the ranges raises."""
    members = [warc.record(i, "http://a.example/", random.Random(i).randbytes(150 + 7 * i), None) for i in range(60)]
    file = str(tmp_path / "a.warc.gz")

    def ids(raw):
        (tmp_path / "a.warc.gz").write_bytes(raw)
        return [row[0] for begin in range(0, len(raw), size) for row in warc._scan(file, len(raw), begin, min(len(raw), begin + size))]

    assert ids(between.join(members)) == list(range(60))
    for i, m in enumerate(members):
        for at in (0, len(m) // 2, len(m) - 6):
            damaged = m[:at] + bytes([m[at] ^ 0x55]) + m[at + 1 :]
            with pytest.raises(ValueError, match="damaged|digest"):
                ids(between.join([*members[:i], damaged, *members[i + 1 :]]))


def test_url_rules_and_verdicts(spark):
    urls = [f"https://a{i}.example.{'org' if i % 3 else 'com'}/{'fr' if i % 2 else 'de'}/{i}" for i in range(300)]
    odd = ["http://ORG/x", "http://example.org/en/12", "http://org.net/", "no scheme", None, "http://x.com", "http://good.net/fr/1?q"]
    pages = spark.createDataFrame([(i, u, "h") for i, u in enumerate(urls + odd)], "page_id long, url string, html string")
    got = {r.page_id: r for r in urlfilter.judge(pages, queries.RULES).collect()}
    assert len(got) == len(urls + odd)
    at = lambda k: got[len(urls) + k]
    assert (at(0).host, at(0).path, at(0).rule, at(0).verdict) == ("org", "/x", "org/", "allow")
    assert (at(1).rule, at(1).verdict) == ("example.org/en/1", "block")
    assert [at(k).rule for k in (2, 3, 4, 5)] == [None] * 4
    assert (at(3).host, at(3).path, at(5).path) == ("", "", "")
    assert urlfilter.judge(pages.limit(0), queries.RULES).count() == 0


def test_url_models_count_every_gram(spark):
    """More grams than 2**18 for each verdict: differences against Witten-Bell smoothing over all counts."""
    r = random.Random(3)
    letters = "abcdefghijklmnopqrstuvwxyz0123456789-/"
    tail = lambda: "".join(r.choice(letters) for _ in range(40))
    urls = [f"http://{'org' if i % 2 else 'net'}/{tail()}" for i in range(6000)] + [f"http://x.com/{tail()}" for _ in range(50)]
    rules = [urlfilter.Rule("allow", "org", "/"), urlfilter.Rule("block", "net", "/")]
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    aside = {x.page_id: x.aside for x in pages.select("page_id", (F.pmod(F.xxhash64("url"), F.lit(5)) == 0).alias("aside")).collect()}
    counts = ({}, {})
    for i, u in enumerate(urls[:6000]):
        t = u[7:].encode()
        for j in range(len(t) if not aside[i] else 0):
            for k in range(min(j, 5) + 1):
                here = counts[i % 2].setdefault(t[j - k : j], {})
                here[t[j]] = here.get(t[j], 0) + 1
    assert all(sum(len(x) for x in c.values()) > 1 << 18 for c in counts)

    def log_likelihood(c, t):
        total = 0.0
        for j in range(len(t)):
            p = 1 / 256
            for k in range(min(j, 5) + 1):
                if here := c.get(t[j - k : j]):
                    p = (here.get(t[j], 0) + len(here) * p) / (sum(here.values()) + len(here))
            total += np.log(p)
        return total

    got = {x.page_id: x.difference for x in urlfilter.judge(pages, rules).collect()}
    for i in [*range(100), *range(6000, 6050)]:
        t = urls[i][7:].encode()
        assert abs(got[i] - (log_likelihood(counts[1], t) - log_likelihood(counts[0], t)) / len(t)) < 1e-9


def labelled(spark, n=240):
    bad, junk = ["vile", "awful"], "### $$$ %%% ### &&& ***"
    texts, labels = [], []
    for i in range(n):
        t = words(60, 1000 + i)
        toxic, quality_ = int(i % 6 == 0), int(i % 5 != 0)
        t += f" {bad[i % 2]} {bad[0]}" if toxic else ""
        t = t if quality_ else " ".join(f"{w} {junk}" for w in t.split())
        texts.append((i, t, "en", "s", len(t), None))
        if i % 7:
            labels.append((i, quality_, toxic))
    docs = spark.createDataFrame([*texts, (None, None, None, None, None, None), (999, "", None, None, 0, None)], SCHEMA)
    return docs, spark.createDataFrame([*labels, (None, 1, 1), (5, None, None)], "doc_id long, quality int, toxic int")


def test_quality(spark, empty):
    docs, labels = labelled(spark)
    got = {r.doc_id: r.accepted for r in quality.classify(docs, labels).collect()}
    right = sum(got[i] == (i % 5 != 0) for i in range(240))
    assert right >= 235
    kept = quality.accept(docs, labels)
    assert kept.columns == docs.columns
    assert {r.doc_id for r in kept.collect()} == {k for k, v in got.items() if v}
    assert quality.classify(docs, labels.limit(0)).where("accepted").count() == docs.count()
    assert quality.classify(empty, labels).count() == 0


def test_quality_against_plain_models(spark):
    """Weights against models counted gram by gram; the sample is the k largest of weight and noise."""
    docs, labels = labelled(spark)
    texts = {r.doc_id: r.text or "" for r in docs.collect() if r.doc_id is not None}
    bucket_of = {}

    def cells(t):
        tokens = re.findall(r"\w+|[^\w\s]+", t.lower())
        grams = [(x,) for x in tokens] + (list(zip(tokens, tokens[1:], strict=False)) if len(tokens) > 1 else [tuple(tokens)] * len(tokens))
        for g in grams:
            if g not in bucket_of:
                found = [c.tolist() for *_, c in textkit.buckets([" ".join(g).encode()], len(g), quality.BITS)][0]
                bucket_of[g] = found[-1]
        return [bucket_of[g] for g in grams]

    good = {r.doc_id for r in labels.collect() if r.quality == 1}
    target, raw = np.zeros(1 << quality.BITS), np.zeros(1 << quality.BITS)
    for i, t in texts.items():
        for c in cells(t):
            raw[c] += 1
            target[c] += i in good
    for c in cells(""):
        raw[c] += 1
    ratio = np.log((target + quality.PRIOR) / (raw * target.sum() / raw.sum() + quality.PRIOR))
    got = {r.doc_id: r for r in quality.classify(docs, labels).collect()}
    for i, t in texts.items():
        assert got[i].log_weight == pytest.approx(sum(ratio[c] for c in cells(t)), abs=1e-6)
    noise = {r.doc_id: r.g for r in docs.select("doc_id", quality.gumbel(F.col("doc_id")).alias("g")).collect()}
    keys = {i: got[i].log_weight + noise[i] for i in got}
    assert all(abs(keys[i] - got[i].key) < 1e-9 for i in got)
    k = sum(r.accepted for r in got.values())
    assert {i for i, r in got.items() if r.accepted} == set(sorted(keys, key=keys.get, reverse=True)[:k])


def test_gumbel_top_k_samples_by_weight(spark):
    """The share of draws in which a text is the first is its weight's share of all."""
    weights = np.array([1.0, 2.0, 4.0, 8.0])
    draws = spark.range(4).crossJoin(spark.range(4000).withColumnRenamed("id", "seed"))
    u = draws.select("id", "seed", (quality.gumbel(F.concat_ws("-", "id", "seed")) + F.element_at(F.array(*[F.lit(float(np.log(w))) for w in weights]), (F.col("id") + 1).cast("int"))).alias("key"))
    first = u.groupBy("seed").agg(F.max_by("id", "key").alias("id")).groupBy("id").count().collect()
    share = np.array([{r.id: r["count"] for r in first}.get(i, 0) for i in range(4)]) / 4000
    assert np.abs(share - weights / weights.sum()).max() < 0.03


def test_kth_largest(spark, monkeypatch):
    monkeypatch.setattr(quality, "SORTED", 10)
    monkeypatch.setattr(quality, "BINS", 8)
    values = [random.Random(2).gauss(0, 1) ** 5 for _ in range(500)] + [1.0] * 50
    keys = spark.createDataFrame([(v,) for v in values], "key double")
    for k in (1, 7, 250, 550):
        assert quality.kth_largest(keys, "key", k) == sorted(values, reverse=True)[k - 1]


def test_toxicity(spark, empty):
    docs, labels = labelled(spark)
    model = toxicity.fit(docs, labels)
    got = {r.doc_id: r for r in toxicity.grade(docs, model).collect()}
    assert all(got[i].toxic == (i % 6 == 0) for i in range(240))
    assert all(0 <= r.severity <= 1 for r in got.values())
    kept = toxicity.harmless(docs, labels)
    assert kept.columns == docs.columns
    assert kept.count() == 202
    assert toxicity.harmless(docs, labels.limit(0)).count() == docs.count()
    assert toxicity.harmless(empty, labels).count() == 0


def test_toxicity_grades_share_weights(spark):
    """Four grades; the fitted likelihood is at its minimum, and a plain gradient descent finds the same."""
    r = random.Random(8)
    texts, grades = [], []
    for i in range(400):
        g = i % 4
        texts.append(" ".join(r.choice(WORDS[:30]) for _ in range(20)) + " vile" * (g >= 1) + " awful" * (g >= 2) + " horrid" * (g >= 3))
        grades.append(g)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame(list(enumerate(grades)), "doc_id long, severity int")
    model = toxicity.fit(docs, labels, "severity")
    assert model.grades == [0, 1, 2, 3] and len(model.theta) == 3 and (np.diff(model.theta) > 0).all()
    got = {x.doc_id: x for x in toxicity.grade(docs, model).collect()}
    assert sum(got[i].grade == g for i, g in enumerate(grades)) >= 390
    mean = [np.mean([got[i].severity for i in range(400) if grades[i] == g]) for g in range(4)]
    assert sorted(mean) == mean

    row, cell = toxicity.features([t.encode() for t in texts])
    kinds, column = np.unique(cell, return_inverse=True)
    x = np.zeros((400, len(kinds)))
    x[row, column] = 1
    target, weight = np.array(grades)[:, None] > np.arange(3), 1 / 400

    def loss(w, theta):
        z = np.clip((x @ w)[:, None] - theta, -40, 40)
        return (weight * np.where(target, np.log1p(np.exp(-z)), np.log1p(np.exp(z)))).sum() + toxicity.PENALTY * np.abs(w).sum()

    w, theta = np.zeros(len(kinds)), np.arange(3.0)
    for _ in range(20_000):
        e = (1 / (1 + np.exp(-np.clip((x @ w)[:, None] - theta, -40, 40))) - target) * weight
        w = w - 0.1 * (x.T @ e.sum(1))
        w = np.sign(w) * np.maximum(np.abs(w) - 0.1 * toxicity.PENALTY, 0)
        theta = theta + 0.1 * e.sum(0)
    own = np.zeros(len(kinds))
    own[np.searchsorted(kinds, model.buckets)] = model.weights
    assert loss(own, model.theta) <= loss(w, theta) + 0.02


def test_language(spark, empty):
    r = random.Random(4)
    say = {"en": ["the", "and", "thing", "with"], "de": ["und", "der", "schön", "nicht"], "fr": ["où", "les", "été", "dans"]}
    rows = [(i, " ".join(r.choice(say[lang]) for _ in range(30)), lang, "s", 0, None) for i in range(300) for lang in [list(say)[i % 3]]]
    rows += [(1000, None, "en", None, None, None), (1001, "12 !!", "en", None, None, None), (None, "the thing", None, None, None, None)]
    got = langid.predict(spark.createDataFrame(rows, SCHEMA)).collect()
    by = {x.doc_id: x for x in got}
    assert len(got) == len(rows)
    assert sum(by[i].lang_pred == list(say)[i % 3] for i in range(300) if by[i].held_out) >= 0.95 * sum(by[i].held_out for i in range(300))
    assert all(by[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0) for i in range(300))
    assert by[1000].lang_pred == by[1001].lang_pred == "und"
    assert langid.predict(empty).count() == 0
    many = [(i, f"{chr(0x4E00 + i % 300)}{chr(0x4E00 + i % 300)} abc", f"l{i % 300}", "s", 0, None) for i in range(1500)]
    found = langid.predict(spark.createDataFrame(many, SCHEMA)).where("held_out").collect()
    assert sum(x.lang_pred == f"l{x.doc_id % 300}" for x in found) >= 0.9 * len(found)  # more languages than landmarks


def test_language_equals_kernel_ridge_regression():
    """Nystroem features with all training texts as landmarks are exact kernel ridge regression."""
    r = random.Random(6)
    langs = [["a", "b", "c"][i % 3] for i in range(60)]
    texts = [" ".join(r.choice({"a": ["uno", "dos"], "b": ["eins", "zwei"], "c": ["один", "два"]}[lang] + WORDS[:3]) for _ in range(12)) for lang in langs]
    texts[7] = texts[7] * 4000  # a very long text
    grams = []
    for t in texts:
        raw = t.lower().encode()
        grams.append({raw[i : i + n] for n in (1, 2, 3) for i in range(len(raw) - n + 1)})
    kernel = np.array([[len(x & y) / np.sqrt(len(x) * len(y)) for y in grams] for x in grams])
    y = np.array([[1.0 if lang == k else -1.0 for k in "abc"] for lang in langs])
    # z z' = K and the ridge is scaled by the number of texts, as in training.
    expected = kernel @ np.linalg.solve(kernel + langid.RIDGE * len(texts) * np.eye(len(texts)), y)
    model = langid.train([langid.bitmap(t) for t in texts], langs, landmarks=len(texts))
    assert np.abs(model.scores(texts) - expected).max() < 0.02


def test_pipeline_against_plain_python(spark, tmp_path):
    """Every stage done again in plain Python from the decisions of the classifiers (tested above)."""
    import corpus_pipeline

    docs, labels = labelled(spark, 120)
    base = words(150, 5)
    more = [(300, base, "en", "s", 0, None), (301, base.upper(), "en", "s", 0, None), (302, edited(base, 2, 1), "en", "s", 0, None), (303, edited(base, 2, 2), "en", "s", 0, None), (304, words(3000, 6), "en", "s", 0, None)]
    docs = docs.unionByName(spark.createDataFrame(more, SCHEMA))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    labels.write.parquet(f"{tmp_path}/labels.parquet")
    docs, labels = (spark.read.parquet(f"{tmp_path}/{x}.parquet") for x in ("documents", "labels"))
    judged = quality.classify(docs, labels).collect()
    good = {r.doc_id for r in judged if r.accepted}
    rows = [r for r in docs.collect() if r.doc_id in good]
    some = spark.createDataFrame([tuple(r) for r in rows], docs.schema)
    toxic = {r.doc_id for r in toxicity.grade(some, toxicity.fit(some, labels)).where("toxic").collect()}
    rows = [r for r in rows if r.doc_id not in toxic]
    lower = lambda t: (t or "").translate({c: c + 32 for c in range(65, 91)})
    exact = {}
    for r in sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0)):
        exact[lower(r.text)] = r
    rows = list(exact.values())
    label = list(range(len(rows)))
    for i, x in enumerate(rows):
        for j, y in enumerate(rows[:i]):
            a, b = shingles(x.text), shingles(y.text)
            if a and len(a & b) >= 0.8 * len(a | b):
                label = [label[i] if k == label[j] else k for k in label]
    kept = {k: max((r for r, m in zip(rows, label, strict=True) if m == k), key=lambda r: (r.doc_id is not None, r.doc_id or 0)) for k in set(label)}
    t = Tokenizer.from_file(JSON)
    expected = []
    for r in kept.values():
        ids = [*t.encode(r.text or "", add_special_tokens=False).ids, 0]
        first = len(ids) % 2048 or 2048
        for k, stop in enumerate(range(first, len(ids) + 1, 2048)):
            start = stop - 2048 if k else 0
            expected.append((r.doc_id, k, start, stop - start, zlib.crc32(np.array(ids[start:stop], "<u4").tobytes())))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r[:5] for r in got), key=str) == sorted(expected, key=str)
    ends = {}
    for r in got:
        ends[r.sequence_id] = ends.get(r.sequence_id, 0) + r.length
    assert max(ends.values()) <= 2048 and len(ends) <= -(-sum(ends.values()) // 2048) + 1


@pytest.mark.skipif(not os.path.isdir("/root/testdata/sf0.001"), reason="no test data here")
def test_pipeline(spark):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    ids = {r.doc_id for r in got.select("doc_id").distinct().collect()}
    assert 0 < len(ids) < docs.count()
    kept = [r.text.lower() for r in docs.where(F.col("doc_id").isin(sorted(ids))).collect()]
    assert len(kept) == len(set(kept))

"""The rank-order classifier and the first four stages of the pipeline against versions written apart from them."""

import hashlib
import itertools
import math
import re
import zlib
from collections import Counter

import corpus_pipeline
import xxhash
from test_llm import SCHEMA, rows, split

from tesserine.llm import fingerprints, langid, shared


def grams(text):
    words = "".join(c if c.isalpha() else " " for c in (text or "").lower()).split(" ")
    found = Counter(f" {w} "[k : k + n] for w in words if w for n in (1, 2, 3) for k in range(len(w) + 3 - n))
    found.pop(" ", None)
    code = lambda g: sum(ord(c) << 21 * (len(g) - 1 - k) for k, c in enumerate(g))
    return found, lambda g: (-found[g], code(g))


def language_profiles(labelled):
    by_lang = {}
    for text, lang in labelled:
        if text is not None and lang is not None:
            by_lang.setdefault(lang, []).append(text)
    out = {}
    for lang, texts in by_lang.items():
        found, order = grams(" ".join(texts))
        if found:
            out[lang] = {g: k for k, g in enumerate(sorted(found, key=order)[:400])}
    return out


def language_of(text, profiles):
    found, order = grams(text)
    own = sorted(found, key=order)[:400]
    if not own:
        return "und", 0.0
    away = {lang: sum(abs(p[g] - k) if g in p else 400 for k, g in enumerate(own)) for lang, p in profiles.items()}
    best = min(sorted(away), key=away.get)
    return best, 1 - away[best] / (400 * len(own))


def near_kept(docs):
    sets = []
    for d in docs:
        w = split("".join(c.lower() if c.isascii() else c for c in d[1]))
        sets.append({tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set())
    group = list(range(len(docs)))
    for a, b in itertools.combinations(range(len(docs)), 2):
        if sets[a] and 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b]):
            group = [group[a] if g == group[b] else g for g in group]
    first = {}
    for k in sorted(range(len(docs)), key=lambda k: (docs[k][0] is None, docs[k][0] or 0)):
        first.setdefault(group[k], k)
    return [docs[k] for k in sorted(first.values())]


def passages_cut(docs):
    least = lambda d: -(1 << 63) if d[0] is None else d[0]
    windows = lambda w: [(k, tuple(w[k : k + 13])) for k in range(len(w) - 12)]
    earliest, out = {}, []
    for d in sorted(docs, key=least):
        for _, g in windows(split(d[1])):
            earliest.setdefault(g, least(d))
    for d in docs:
        w = split(d[1])
        gone = {k + j for k, g in windows(w) if earliest[g] < least(d) for j in range(13)}
        if not gone or len(gone) < len(w):
            text = " ".join(x for j, x in enumerate(w) if j not in gone)
            out.append((d[0], text, d[2], d[3], len(text) if gone else d[4]))
    return out


def mixed(docs):
    size = Counter()
    for d in docs:
        size[d[3]] += len(split(d[1]))
    weight = {s: (3.0, 1.0, 2.0)[k % 3] for k, s in enumerate(sorted(size, key=lambda s: (s is None, s or "")))}
    left, weights, level = 1.5 * sum(size.values()), sum(weight.values()), None
    for s in sorted(size, key=lambda s: 2 * size[s] / weight[s]):
        if left / weights * weight[s] <= 2 * size[s]:
            level = left / weights
            break
        left, weights = left - 2 * size[s], weights - weight[s]
    out = []
    for d in docs:
        rate = min(2.0 * size[d[3]], math.inf if level is None else level * weight[d[3]]) / size[d[3]] if size[d[3]] else 0
        chance = int(hashlib.md5(f"7:{'null' if d[0] is None else d[0]}".encode()).hexdigest()[:13], 16) / 2**52
        out += [d] * (math.floor(rate) + (chance < rate - math.floor(rate)))
    return out


def test_language_id_is_brute_force(spark):
    docs = spark.createDataFrame(rows(), SCHEMA)
    profiles = language_profiles([(r[1], r[2]) for r in rows()])
    want = sorted((str(r[0]), language_of(r[1], profiles)[0], round(language_of(r[1], profiles)[1], 9)) for r in rows())
    got = langid.predict(docs, langid.fit(docs)).collect()
    assert sorted((str(r.doc_id), r.lang_pred, round(r.score, 9)) for r in got) == want


def test_pipeline_stages_are_brute_force(spark, tmp_path):
    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    docs, want = spark.read.parquet(f"{tmp_path}/documents.parquet"), [r[:5] for r in rows()]
    profiles = language_profiles([(r[1], r[2]) for r in want if zlib.crc32(("" if r[0] is None else str(r[0])).encode()) % 5])
    named = [(*r[:2], r[2] or language_of(r[1], profiles)[0], *r[3:]) for r in want if language_of(r[1], profiles)[0] != "und"]
    expected = {"language_id": named, "near_dedup": (near := near_kept(named)), "substring_dedup": (cut := passages_cut(near)), "mixing": mixed(cut)}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = shared.stage(stage(spark, docs, str(tmp_path)), name)
        assert sorted(map(repr, (tuple(r) for r in docs.collect()))) == sorted(map(repr, expected[name])), name


def spark_hash(*values):
    """Spark's xxhash64 of text, (value, bytes) integers: each one seeds the next."""
    seed = 42
    for v in values:
        seed = xxhash.xxh64_intdigest(v.encode() if isinstance(v, str) else v[0].to_bytes(v[1], "little", signed=True), seed)
    return seed


def signed(x, bits):
    x &= (1 << bits) - 1
    return x - (1 << bits) if x >> (bits - 1) else x


def order_minhash(text):
    """{bin: 26-bit hash of its two least k-mers in text order}."""
    units = [signed(spark_hash(u), 64) for u in re.findall(r"[^\x20\x09-\x0D]{1,12}", text)]
    kmers = [signed(spark_hash(*[(u, 8) for u in units[i : i + 3]]), 36) for i in range(len(units))]
    seen, bins = Counter(), {}
    for i, kmer in enumerate(kmers):
        h = spark_hash((kmer, 8), (seen[kmer], 4)) & (1 << 36) - 1
        seen[kmer] += 1
        bins.setdefault(h >> 30, []).append((h, i))
    return {b: spark_hash(*[(kmers[i], 8) for i in sorted(i for _, i in sorted(found)[:2])]) & (1 << 26) - 1 for b, found in bins.items()}


def test_order_minhash_is_brute_force(spark):
    texts = {-1 if i is None else i: t or "" for i, t, *_ in rows()}
    order = sorted(texts)
    written = lambda f: "".join(f"{b << 26 | f[b]:08x}" for b in sorted(f, key=lambda b: (b < 32, b)))
    alike = lambda a, b: sum(a.get(k) == v for k, v in b.items()) / len(a | b) if a or b else 1.0
    want = []
    for i, *_ in rows():
        key = -1 if i is None else i
        own, following = texts[key], texts[order[(order.index(key) + 1) % len(order)]]
        half = len(own) // 2
        a, b, c = map(order_minhash, (own, own[: len(own) - half] + following[:half], following))
        want.append((str(i), written(a), written(b), round(alike(a, b), 9), round(alike(a, c), 9)))
    got = fingerprints.fingerprints(spark.createDataFrame(rows(), SCHEMA)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, r.edited_fingerprint, round(r.near_edited, 9), round(r.near_next, 9)) for r in got) == sorted(want)

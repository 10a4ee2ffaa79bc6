"""Small fixtures with nulls, empty and odd texts, ties, repeated rows and empty tables, against brute force."""

import hashlib
import itertools
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserine.llm import bpe, chat, fingerprints, langid, mixing, mtree, neardup, sharding, substrings, warc

WORDS = [f"w{i}" for i in range(60)]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, spans string, size int"


def rows():
    rnd = random.Random(3)
    base = [" ".join(rnd.choice(WORDS) for _ in range(rnd.randint(20, 120))) for _ in range(30)]
    texts = [None, "", "  \t\n", "one two", "One  TWO", "日本語 テキスト", "a" * 3000, *base]
    texts += [base[0], base[0], base[1] + " tail", base[2].upper(), " ".join(base[3].split()[:-2]), base[4] + " " + base[5], " ".join([base[6]] * 40)]
    out = [(i * 3, t, "ab"[i % 2] if i % 7 else None, ["s1", "s2", None][i % 3], len(t or ""), "x", 1) for i, t in enumerate(texts)]
    return [*out, (None, base[7], "a", "s1", 1, "x", 1), out[8], out[8]]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def split(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def test_near_duplicates(docs, empty):
    sets = {}
    for i, t, *_ in rows():
        w = split(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.setdefault((i, t), frozenset(tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))) if w else frozenset())
    keys, parent = list(sets), {}
    find = lambda x: x if parent.setdefault(x, x) == x else find(parent[x])
    for a, b in itertools.combinations(keys, 2):
        if sets[a] and 100 * len(sets[a] & sets[b]) >= 85 * len(sets[a] | sets[b]):
            parent[find(b)] = find(a)
    groups = {}
    for k in keys:
        groups.setdefault(find(k), []).append(k[0])
    want = sorted((str(i), len(sets[i, t]), str(min((x for x in groups[find((i, t))] if x is not None), default=None))) for i, t, *_ in rows())
    got = neardup.near_duplicates(docs).collect()
    assert sorted((str(r.doc_id), r.n_shingles, str(r.component_id)) for r in got) == want
    assert all(r.kept == (r.component_id == r.doc_id) for r in got)
    assert neardup.near_duplicates(empty).count() == 0


def test_substring_dedup(docs, empty):
    seen = {}
    low = lambda i: -(1 << 63) if i is None else i
    for i, t, *_ in rows():
        w = split(t)
        for k in range(len(w) - 12):
            seen[tuple(w[k : k + 13])] = min(low(i), seen.get(tuple(w[k : k + 13]), 1 << 62))
    want = []
    for i, t, *_ in rows():
        w, gone = split(t), set()
        for k in range(len(w) - 12):
            if seen[tuple(w[k : k + 13])] < low(i):
                gone.update(range(k, k + 13))
        kept = " ".join(x for j, x in enumerate(w) if j not in gone)
        want.append((str(i), len(w), len(gone), hashlib.sha256(kept.encode()).hexdigest()))
    got = substrings.substring_dedup(docs, texts=False)
    assert "lang" in got.columns and "spans" not in got.columns
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept) for r in got.collect()) == sorted(want)
    assert substrings.substring_dedup(empty).count() == 0


def test_bpe_is_the_librarys(docs, empty):
    library = bpe.TreeEncoder(bpe.tokenizer_path()).library
    small = bpe.TreeEncoder(bpe.tokenizer_path(), 8, 8)
    rnd = random.Random(1)
    parts = ["a", "the", " ", "  ", "\n", "'s", "'re", "'l", "l", "12", "é", "日本", "!!", "<|endoftext|>", "\t", "ab" * 20, "x" * 50, "😀", "\x1f", "1", "²", "\xa0"]
    for _ in range(1500):
        t = "".join(rnd.choice(parts) for _ in range(rnd.randint(0, 60)))
        ids = library.encode(t, add_special_tokens=False).ids
        assert small.encode(t) == ids and small.decode(ids) == library.decode(ids, skip_special_tokens=False)
    want = sorted((str(i), hashlib.sha256(np.array(library.encode(t or "", add_special_tokens=False).ids, "<u4").tobytes()).hexdigest()) for i, t, *_ in rows())
    got = bpe.encode_documents(docs, with_ids=True).collect()
    assert sorted((str(r.doc_id), r.ids_sha256) for r in got) == want and all(len(r.ids) == r.n_tokens for r in got)
    assert bpe.encode_documents(empty).count() == 0


def test_language_id(spark, docs, empty):
    train = spark.createDataFrame([("der die das und nicht ein", "de"), ("the and of with not a", "en"), (None, "en"), ("x", None)], "text string, lang string")
    profiles = langid.fit(train)
    assert langid.classify("das und die", profiles)[0] == "de" and langid.classify("with the and", profiles)[0] == "en"
    assert langid.classify(None, profiles) == ("und", 0.0) and langid.classify("12 !!", profiles) == ("und", 0.0)
    got = langid.predict(docs, profiles).collect()
    assert len(got) == len(rows()) and all(0 <= r.score <= 1 for r in got)
    assert langid.fit(empty).languages == () and langid.predict(empty, profiles).count() == 0


def test_warc_round_trip(spark):
    pages = spark.createDataFrame([(1, "u\r\nX: y", "same"), (9, "u", "same"), (5, None, "same"), (2, "v", None), (3, "v", ""), (None, "w", "same"), (4, "w", "x" * 50_000), (6, "z", "é")], "page_id long, url string, html string")
    got = {r.page_id: r for r in warc.archived(pages).collect()}
    assert len(got) == 8 and got[1].refers_to == 9 and got[5].record_type == "revisit" and got[9].record_type == got[None].record_type == "response"
    assert got[2].refers_to == 3 and got[3].payload_digest == warc.sha1_base32(b"") and got[1].payload_bytes == 4 and got[6].payload_bytes == 2
    assert {r.record_type for r in warc.archived(pages, least_bytes=5).collect()} == {"response"}
    assert warc.archived(pages.limit(0)).count() == 0
    content = bytes(warc.write_archives(pages).first().content)
    with pytest.raises(warc.WarcError):
        list(warc.read_archive(content[:-3]))
    samples = [warc.record("resource", f"urn:{i}", "2020-01-01T00:00:00Z", str(i).encode() * 900) for i in range(60)]
    d = warc.dictionary_of(samples)
    packed = warc.archive_start(d) + b"".join(warc.compressor(d).compress(s) for s in samples)
    assert d and [b for _, b in warc.read_archive(packed)] == [str(i).encode() * 900 for i in range(60)]
    with pytest.raises(warc.WarcError):
        warc.parse_record(samples[0][:-5])


def test_mixing(docs, empty):
    got = mixing.with_copies(docs).collect()
    assert len(got) == len(rows()) and all(r.copies in (0, 1, 2) for r in got)
    sizes = {r.source: r.source_size for r in got}
    goal = {r.source: r.target for r in got}
    assert all(goal[s] <= 2 * sizes[s] + 1e-9 for s in sizes) and abs(sum(goal.values()) - 1.5 * sum(sizes.values())) < 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in got)
    assert mixing.with_copies(empty).count() == 0


def test_fingerprints(docs, empty):
    order = sorted({(i if i is not None else -1) for i, *_ in rows()})
    text = {(-1 if i is None else i): t or "" for i, t, *_ in rows()}
    got = fingerprints.fingerprints(docs).collect()
    assert len(got) == len(rows())
    for r in got:
        i = -1 if r.doc_id is None else r.doc_id
        own, nxt = text[i], text[order[(order.index(i) + 1) % len(order)]]
        half = len(own) // 2
        assert r.n_chars == len(own) and r.edited_sha256 == hashlib.sha256((own[: len(own) - half] + nxt[:half]).encode()).hexdigest()
        assert 0 <= r.near_edited <= 1 and 0 <= r.near_next <= 1
    same = {r.fingerprint for r in got if text.get(r.doc_id) == text[21]}
    assert len(same) == 1 and fingerprints.fingerprints(empty).count() == 0


def test_top_k(spark):
    rnd = np.random.default_rng(1)
    data = [(i, [float(x) for x in rnd.normal(size=8).round(1)]) for i in range(300)] + [(i, [1.0] * 8) for i in range(300, 420)]
    data += [(500, None), (600, [1.0, None] + [0.0] * 6), (700, [float("nan")] * 8), (None, [1.0] * 8)]
    table = spark.createDataFrame(data, "vec_id long, embedding array<float>").select("vec_id", mtree.integer_vector(F.col("embedding")).alias("vector"))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in mtree.top_k(table, table.where("vec_id % 100 = 0"), tree_rows=100, page=8).collect()}
    usable = {i: np.floor(1024 * np.array(v, np.float32).astype(float)).astype(int) for i, v in data[:420]}
    for q in range(0, 420, 100):
        best = sorted((-int(v @ usable[q]), i) for i, v in usable.items() if i != q)[:10]
        assert [got[q, k + 1] for k in range(10)] == [(i, -s) for s, i in best]
    assert mtree.top_k(table.limit(0), table.limit(0)).count() == 0


def test_sharding(docs, empty):
    got = sharding.shard(docs, shards=4).collect()
    assert len(got) == len(rows()) and {r.law for r in got} == {"bytes"}
    for s in {r["shard"] for r in got}:
        slots = sorted(r.slot for r in got if r["shard"] == s)
        assert slots == list(range(len(slots))) and 0 <= s < 4
    assert sum(r["size"] for r in got) == sum(len((t or "").encode()) + 1 for _, t, *_ in rows())
    assert sharding.shard(empty).count() == 0


def test_preference_pairs(spark):
    turns = "pair_id long, turn long, role string, text string"
    a = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "yes"), (2, 0, "user", None), (3, 0, "user", "q"), (None, 0, "user", "n")], turns)
    b = spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", "no"), (1, 2, "user", "why"), (2, 0, "user", "")], turns)
    got = {r.pair_id: r for r in chat.preference_pairs(a, b).collect()}
    assert set(got) == {1, 2, 3} and got[1].n_common == 1 and got[1].prompt == "<|im_start|>user\nhi<|im_end|>\n"
    assert got[1].chosen == "<|im_start|>assistant\nyes<|im_end|>\n" and got[1].chosen_mask == "0*22,1*14"
    assert got[1].rejected_mask == "0*22,1*13,0*31" and len(got[1].rejected) == 22 + 13 + 31
    assert got[2].chosen == got[2].rejected == "" and got[3].prompt == "" and got[3].rejected == ""
    assert chat.preference_pairs(a.limit(0), b.limit(0)).count() == 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    spark.createDataFrame(rows(), SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    out = corpus_pipeline.run(spark, str(tmp_path))
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == list(corpus_pipeline.COLUMNS)
    library = bpe.TreeEncoder(bpe.tokenizer_path()).library
    want = sorted((str(r.doc_id), library.encode(r.text, add_special_tokens=False).ids) for r in docs.collect())
    assert sorted((str(r.doc_id), list(r.ids)) for r in out.collect()) == want

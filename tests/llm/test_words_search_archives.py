"""Spelling variants, ranked search and archives against brute force, with nulls, empty, long, tied and repeated rows."""

from __future__ import annotations

import base64
import gzip
import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from isobar.llm import ranked, spelling, warc
from isobar.llm.shared import shared_dir

DOCS = "doc_id bigint, text string, word string, term string, shard int"


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield shared_dir(spark)


def clashing(spark, rows):
    return spark.createDataFrame([(i, t, "w", "t", 7) for i, t in rows], DOCS).repartition(3)


# -- spelling


def variants(docs, least_size, least_n, ratio):
    counts = Counter()
    for i, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            word = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if i is None else i}:{word}".encode())
            counts[word[: h % len(word)] + word[h % len(word) + 1 :] if h % 199 == 0 else word] += 1
    n = {w: c for w, c in counts.items() if len(w) >= least_size and c >= least_n}
    gaps = defaultdict(set)
    for w in n:
        gaps[w].add(w)
        for p in range(len(w)):
            gaps[w[:p] + w[p + 1 :]].add(w)
            gaps[w[:p] + "\0" + w[p + 1 :]].add(w)
    near = defaultdict(set)
    for gap, words in gaps.items():
        for a in words:
            # through a shorter word only those one longer than it are near; two that lost a character need not be
            near[a] |= {b for b in words if b != a and ("\0" in gap or len(a) != len(b))}
    best = {w: min(b, key=lambda x: (-n[x], x)) for w, b in near.items() if b}
    form = {w: b for w, b in best.items() if n[b] >= ratio * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return out


def texts(seed, size):
    rng = random.Random(seed)
    stems = ["".join(rng.choice("abcé") for _ in range(rng.randint(5, 9))) for _ in range(60)] + ["aaaaaa", "aaaaaaa", "aaaaab"]
    weights = [3 ** rng.randint(0, 4) for _ in stems]
    out = []
    for i in range(size):
        words = rng.choices(stems, weights, k=rng.randint(0, 120))
        for k in range(len(words)):
            if rng.random() < 0.1:
                at = rng.randrange(len(words[k]))
                words[k] = words[k][:at] + rng.choice(["", "a", "bc", "ÿ"]) + words[k][at + 1 :]
        out.append((i, rng.choice([" ", "×", "1", "—", "-"]).join(w.title() if rng.random() < 0.2 else w for w in words)))
    return out


@pytest.mark.parametrize(("seed", "most"), [(1, 2_000), (2, 3)])
def test_spelling_by_brute_force(spark, monkeypatch, seed, most):
    monkeypatch.setattr(spelling, "GROUP", most)
    docs = texts(seed, 250) + [(900, None), (901, ""), (None, "aaaaaa no id " * 9), (902, "z" * 5_000 + " " + "z" * 4_999), (903, ("y" * 80 + " ") * 6), (7, "aaaaaa " * 40), (7, "aaaaaa " * 40)]
    words = spelling.counted_runs(clashing(spark, docs), 4).where("n >= 2")
    near = {r["word"]: (r["n_near"], r["best"]["form"]) for r in spelling.near_words(words, 4, most).collect()}
    want = variants(docs, 4, 2, 2)
    assert {w: n for w, (n, _) in near.items()} == {w: n for w, _, n, *_ in want if n}
    got = [tuple(r) for r in spelling.spelling_variants(clashing(spark, docs), 4, 2, 2).select("word", "n", "n_near", "form", "form_n", "root").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert any(r[3] for r in want) and any(r[5] not in (r[0], r[3]) for r in want)


def test_spelling_groups_are_bounded(spark):
    words = spark.createDataFrame([(f"{'prefix'}{a}{b}{'suffix'}", 5) for a in "abcdefghij" for b in "abcdefghij"], "word string, n bigint")
    rows = spelling.grouped(words, 6, 30)
    assert rows.groupBy("key").count().agg(F.max("count")).first()[0] <= 30
    # every word is near the 9 + 9 that share one of the two letters
    assert {r["n_near"] for r in spelling.near_words(words, 6, 30).collect()} == {18}


def test_spelling_of_nothing(spark):
    for rows in ([], [(1, None), (2, ""), (3, "1 2 3")]):
        assert spelling.spelling_variants(clashing(spark, rows) if rows else spark.createDataFrame([], DOCS)).count() == 0


def test_wavelet_tree_reports_rectangles():
    rng = np.random.default_rng(0)
    for n in (1, 2, 7, 64, 200):
        values = rng.permutation(n)
        tree = spelling.WaveletTree(values)
        a, b, c, d = (rng.integers(0, n + 1, 300) for _ in range(4))
        query, value = tree.report(a, b, c, d)
        got = defaultdict(list)
        for q, v in zip(query.tolist(), value.tolist(), strict=True):
            got[q].append(v)
        for q in range(300):
            assert sorted(got[q]) == sorted(v for v in values[a[q] : b[q]].tolist() if c[q] <= v < d[q])


def test_combined_checksums():
    tables = spelling._shift_tables(40)
    for head, tail in ((b"12:", b"abc"), (b":", b""), (b"-7:", "é".encode() * 20)):
        h = zlib.crc32(tail)
        for k in range(4):
            h ^= int(tables[len(tail), k, zlib.crc32(head) >> (8 * k) & 255])
        assert h == zlib.crc32(head + tail)


# -- ranked search


TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms_of(text):
    return [re.sub("[A-Z]", lambda m: m[0].lower(), t) for t in TERM.findall(text or "")]


def ranking(docs, items, k):
    held = [(i, Counter(terms_of(t))) for i, t in docs]
    n, length = sum(1 for _, c in held if c), sum(sum(c.values()) for _, c in held)
    df = Counter(t for _, c in held for t in c)
    out = Counter()
    for item, text in items:
        scores = []
        for i, c in held:
            m = 50 + (50 * sum(c.values()) * n) // length if length else 0
            score = sum(math.floor(1000 * math.log((2 * n + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in set(terms_of(text)) if c[t])
            if score > 0:
                scores.append((-score, i is None, i or 0))
        for rank, (score, none, i) in enumerate(sorted(scores)[:k]):
            out[(item, rank + 1, None if none else i, -score)] += 1
    return out


@pytest.mark.parametrize(("tiers", "shard", "run"), [(ranked.TIERS, ranked.SHARD, 16), ((3, 12, 40), 2_000, 2), ((1,), 500, 1), ((5, 6), 4_000, 3)])
def test_ranked_search_by_brute_force(spark, monkeypatch, tiers, shard, run):
    monkeypatch.setattr(ranked, "RUN", run)
    rng = random.Random(3)
    words = [f"w{i}" for i in range(80)] + ["É", "日本", "x\x7fy", "A1"]
    weights = [1000 / (i + 1) for i in range(len(words))]
    docs = [(i, " ".join(rng.choices(words, weights, k=rng.randint(0, 60)))) for i in range(300)]
    docs += [(500, None), (501, ""), (502, " .,\n"), (None, docs[5][1]), (None, docs[5][1]), (503, docs[5][1]), (504, docs[5][1]), (504, docs[5][1]), (505, "w3 " * 70_000), (506, "w3_W3-w70")]
    items = [(i, " ".join(rng.choices(words, k=rng.randint(1, 25)))) for i in range(25)] + [(30, None), (31, ""), (32, "unheard"), (None, "w1 w79"), (33, "w7 w8"), (33, "w7 w8"), (34, "w70 W70 w3")]
    asked = spark.createDataFrame([(i, t, 1) for i, t in items], "item_id bigint, text string, rank int").repartition(2)
    got = ranked.ranked_search(clashing(spark, docs), asked, 10, tiers=tiers, shard=shard)
    assert got.columns == ["item_id", "rank", "doc_id", "score"]
    assert Counter(tuple(r) for r in got.collect()) == ranking(docs, items, 10)


def test_ranked_search_of_nothing(spark):
    none, items = spark.createDataFrame([], DOCS), spark.createDataFrame([(1, "w1")], "item_id bigint, text string")
    assert ranked.ranked_search(none, items).count() == 0
    assert ranked.ranked_search(clashing(spark, [(1, "w1"), (2, "w2")]), items.limit(0)).count() == 0
    # the one document with the term is half of the corpus
    assert [tuple(r) for r in ranked.ranked_search(clashing(spark, [(1, "w1"), (2, "w2")]), items).select("rank", "doc_id").collect()] == [(1, 1)]


def test_items_are_proven_before_the_last_tier(spark, monkeypatch):
    read = []
    plain = ranked._over_shards

    def seen(postings, asked, shards, kind, k, sets):
        read.append((kind, postings.select("tier").distinct().count(), postings.count()))
        return plain(postings, asked, shards, kind, k, sets)

    monkeypatch.setattr(ranked, "_over_shards", seen)
    rng = random.Random(4)
    docs = [(i, " ".join(["the"] * rng.randint(1, 4) + [f"r{i % 40}"] * (1 + i % 3) + [f"f{rng.randint(0, 99)}" for _ in range(20)])) for i in range(2000)]
    items = [(i, f"the r{i}") for i in range(40)]
    got = ranked.ranked_search(clashing(spark, docs), spark.createDataFrame(items, "item_id bigint, text string"), 10, tiers=(60, 600), shard=20_000)
    assert Counter(tuple(r) for r in got.collect()) == ranking(docs, items, 10)
    # rare terms prove themselves: no lower tier was searched
    assert [kind for kind, *_ in read] == ["sure", "open"] and read[0][1] == 1


def test_index_has_every_term(spark):
    docs = [(1, "b a a"), (2, None), (3, "A c 9")]
    rows = ranked.build_index(spark.createDataFrame(docs, "doc_id bigint, text string").coalesce(1)).collect()
    head = next(r for r in rows if r["term"] is None)
    assert head["ids"] == [1, 2, 3] and np.frombuffer(head["counts"], "<u4").tolist() == [3, 0, 3] and (head["held"], head["length"]) == (2, 6)
    lists = {r["term"]: (np.frombuffer(r["places"], "<u2").tolist(), np.frombuffer(r["counts"], "u1").tolist()) for r in rows if r["term"]}
    assert lists == {"a": ([0, 2], [2, 1]), "b": ([0], [1]), "c": ([2], [1]), "9": ([2], [1])}


# -- archives


PAGES = "page_id bigint, html string, url string, record string, size int"


def pages():
    rng = random.Random(8)
    big = "".join(rng.choice("abcdé<>\r\n ") for _ in range(300_000))
    out = [(i, f"<p>page {i % 9}</p>" * (i % 9), f"http://x/{i}") for i in range(40)]
    out += [(50, None, None), (51, "", "http://x/ y\r\nz"), (52, big, "u"), (53, big, "u"), (54, big[:-1], "u"), (None, big, "u"), (None, "alone", "é"), (55, "tie", "u"), (55, "tie", "u"), (-3, "negative", None), (56, "\r\n\r\nWARC/1.1\r\n\r\n", "u")]
    return out


def expected(rows, least):
    best = {}
    for i, html, _ in rows:
        if len((html or "").encode()) >= least:
            best[html or ""] = max(best.get(html or "", (False, 0)), (i is not None, i or 0))
    out, done = Counter(), set()
    for i, html, _ in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0), reverse=True):
        data = (html or "").encode()
        first = len(data) < least or ((i is not None, i or 0) == best[html or ""] and (html or "") not in done)
        done.add(html or "")
        top = best.get(html or "")
        out[(i, len(data), base64.b32encode(hashlib.sha1(data).digest()).decode(), "response" if first else "revisit", None if first or not top[0] else top[1])] += 1
    return out


@pytest.mark.parametrize(("least", "most"), [(0, warc.ARCHIVE), (20, 3_000)])
def test_archives_round_trip(spark, tmp_path, least, most):
    frame = spark.createDataFrame([(*r, "clash", 1) for r in pages()], PAGES).repartition(3)
    folder = warc.new_folder(spark)
    archives = warc.write_archives(frame, folder, least=least, most=most)
    listed = archives.collect()
    assert sum(r["records"] for r in listed) == len(pages()) and (most == warc.ARCHIVE or len(listed) > 4)
    rows = warc.read_archives(archives, folder, size=1 << 12).collect()
    payload, last = defaultdict(dict), {}
    for r in rows:
        payload[r["record"]][r["chunk"]] = r["data"]
        if r["last"]:
            last[r["record"]] = r
    got, original = Counter(), Counter()
    for name, r in last.items():
        data = b"".join(payload[name][k] for k in range(len(payload[name])))
        page = warc._page(name)
        size = len(data) if r["record_type"] == "response" else r["http_size"]
        got[(page, size, r["digest"], r["record_type"], warc._page(r["refers_to"]))] += 1
        if r["record_type"] == "response":
            original[data] += 1
            assert hashlib.sha1(data).digest() == r["sha1"] and r["size"] == len(data) == r["http_size"]
        else:
            assert data == b""
    assert got == expected(pages(), least)
    assert set(original) == {(html or "").encode() for _, html, _ in pages()}


def test_running_digests_follow_the_chunks(spark):
    frame = spark.createDataFrame(pages(), "page_id bigint, html string, url string").repartition(2)
    rows = warc.chunk_table(frame, F.col("html"), {"page_id": F.col("page_id")}, size=1000).collect()
    whole = defaultdict(bytes)
    for r in sorted(rows, key=lambda r: (r["record"], r["chunk"])):
        assert len(r["data"]) <= 1000
        whole[r["record"]] += r["data"]
        assert r["size"] == len(whole[r["record"]]) and r["sha1"] == hashlib.sha1(whole[r["record"]]).digest()
    assert Counter(whole.values()) == Counter((html or "").encode() for _, html, _ in pages())
    assert sum(r["last"] for r in rows) == len(pages())


def test_archives_are_gzip_members_of_warc_records(spark):
    folder = warc.new_folder(spark)
    archives = warc.write_archives(spark.createDataFrame(pages(), "page_id bigint, html string, url string"), folder).collect()
    data = b""
    for r in archives:
        store, base = warc._folder(folder)
        with store.open_input_stream(f"{base}/{r['file']}", compression=None) as f:
            packed = f.read()
        assert len(packed) == r["bytes"]
        data += gzip.decompress(packed)
    heads = re.findall(rb"WARC/1\.1\r\nWARC-Type: (\w+)\r\nWARC-Record-ID: <urn:x-page:", data)
    assert Counter(heads) == Counter({t.encode(): n for t, n in ((t, sum(c for k, c in expected(pages(), 0).items() if k[3] == t)) for t in ("response", "revisit"))})
    assert b"WARC-Target-URI: http://x/%20y%0D%0Az\r\n" in data


def test_archives_of_nothing_and_of_broken_files(spark):
    folder = warc.new_folder(spark)
    none = warc.write_archives(spark.createDataFrame([], "page_id bigint, html string, url string"), folder)
    assert none.count() == 0 and warc.read_archives(none, folder).count() == 0
    archives = warc.write_archives(spark.createDataFrame([(1, "abc" * 999, "u")], "page_id bigint, html string, url string"), folder)
    store, base = warc._folder(folder)
    path = f"{base}/{archives.first()['file']}"
    with store.open_input_stream(path, compression=None) as f:
        packed = f.read()
    for broken in (packed[:-20], gzip.compress(gzip.decompress(packed).replace(b"abcabc", b"abcabd"))):
        with store.open_output_stream(path, compression=None) as f:
            f.write(broken)
        with pytest.raises(Exception, match="other bytes|ends within"):
            warc.read_archives(archives, folder).collect()

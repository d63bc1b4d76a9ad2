"""Corpus operators against brute force, on small tables with nulls, blanks, ties, long texts and clashing columns."""

from __future__ import annotations

import hashlib
import math
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from isobar.llm import bpe, jaccard, lines, mixing, pii, preference, quality, sharding, topk, toxicity
from isobar.llm.shared import Words, shared_dir

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id bigint, text string, source string, bucket string, score double"


@pytest.fixture(scope="module", autouse=True)
def checkpoints(spark, tmp_path_factory):
    spark.sparkContext.setCheckpointDir(str(tmp_path_factory.mktemp("shared")))
    yield shared_dir(spark)


def rows():
    rng = random.Random(5)
    vocabulary = ["alpha", "Beta", "gamma,", "delta.", "eps", "zeta", "eta!", "théta", "iota", "Kappa"]
    out = [(i, " ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 60))), f"s{i % 4}" if i % 7 else None) for i in range(60)]
    out += [(100, None, "s0"), (101, "", "s1"), (102, " \n\t ", None), (103, "word " * 30_000, "s2"), (104, out[3][1], "s3"), (105, out[3][1].upper(), "s3"), (None, "no id here", "s1"), (106, "été 🎉 ünï", "s9")]
    return [(*r, "clash", 0.25) for r in out]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, int(i % 3 > 0), int(i % 5 == 0)) for i in range(60)], "doc_id bigint, quality int, toxic int")


def test_words_of_slices():
    texts = pa.array([r[1] for r in rows()], pa.string())
    for start, n in ((0, len(texts)), (55, 8), (60, 2)):
        for lower in (False, True):
            words = Words(texts.slice(start, n), lower)
            vocab = words.vocab.to_pylist()
            for k in range(n):
                want = WORD.findall(texts[start + k].as_py() or "")
                if lower:
                    want = [re.sub("[A-Z]", lambda m: m[0].lower(), w) for w in want]
                assert [vocab[c] for c in words.codes[words.starts[k] : words.starts[k + 1]]] == want


# -- mixing


def test_mix_targets_and_copies(spark, docs):
    sources, _ = mixing.plan_mix(mixing.slim_rows(docs, "x"), (5, 2, 1), 1.5, 2)
    goal = {r["source"]: r for r in sources.collect()}
    size = defaultdict(int)
    for _, text, source, *_ in rows():
        size[source] += len(WORD.findall(text or ""))
    weights, left = {s: w for s, w in zip(sorted(k for k in size if k) + [None], [5, 2, 1] * 3, strict=False)}, dict(size)
    want, total = {}, 1.5 * sum(size.values())
    while left:
        level = total / sum(weights[s] for s in left)
        over = [s for s in left if level * weights[s] > 2 * size[s]]
        if not over:
            want |= {s: level * weights[s] for s in left}
            break
        for s in over:
            want[s] = 2 * size[s]
            total -= left.pop(s) * 2
    assert {s: r["target"] for s, r in goal.items()} == pytest.approx(want)
    mixed = mixing.mix_sources(docs, seed="x")
    assert mixed.columns == docs.columns
    counts = Counter(r["doc_id"] for r in mixed.collect())
    assert max(counts.values()) <= 2
    again = Counter(r["doc_id"] for r in mixing.mix_sources(docs.repartition(5), seed="x").collect())
    assert counts == again


def test_mix_of_nothing(empty):
    assert mixing.mix_sources(empty).count() == 0


def test_mix_in_finish_order_by_brute_force(spark):
    rng = random.Random(1)
    data = [(i, " ".join(["w"] * rng.randint(0, 9)), f"s{rng.randint(0, 4)}", "", 0.0) for i in range(300)]
    docs = spark.createDataFrame(data, SCHEMA)
    sources, _ = mixing.plan_mix(mixing.slim_rows(docs, "m"), (5, 2, 1), 1.5, 2)
    target = {r["source"]: (r["target"], r["source_size"]) for r in sources.collect()}
    order = []
    for s in target:
        upto = 0
        for i, t, *_ in sorted((r for r in data if r[2] == s), key=lambda r: hashlib.md5(f"m{r[0]}".encode()).hexdigest()):
            n = len(WORD.findall(t))
            upto += n
            order += [((upto + target[s][1] * k) / target[s][0], k, hashlib.md5(f"m{i}".encode()).hexdigest(), s, i, n) for k in (0, 1)]
    budget, used, want = sum(t for t, _ in target.values()), 0, Counter()
    for *_, i, n in sorted(order):
        used += n
        if used > budget:
            break
        want[i] += 1
    got = Counter(r["doc_id"] for r in mixing.mix_sources(docs, seed="m").collect())
    sized = {r[0] for r in data if r[1]}
    assert {i: k for i, k in got.items() if i in sized} == {i: k for i, k in want.items() if i in sized}


# -- sharding


def test_rendezvous_moves_only_to_the_new_shard(spark):
    keys = spark.range(2000).withColumnRenamed("id", "doc_id")
    a = {r["doc_id"]: (r["shard"], r["grown_shard"]) for r in sharding.shard_rows(keys, weights=(1.0,) * 8).collect()}
    b = {r["doc_id"]: r["shard"] for r in sharding.shard_rows(keys, weights=(1.0,) * 9).collect()}
    assert {k: v[1] for k, v in a.items()} == b
    assert all(b[k] in (v[0], 8) for k, v in a.items())
    share = Counter(v[0] for v in a.values())
    assert len(share) == 8 and max(share.values()) < 2000 / 8 * 1.4


def test_rendezvous_follows_weights(spark):
    keys = spark.range(8000).withColumnRenamed("id", "doc_id")
    share = Counter(r["shard"] for r in sharding.shard_rows(keys, weights=(1.0, 3.0, 0.0)).collect())
    assert share[2] == 0 and share[1] / share[0] == pytest.approx(3, rel=0.15)
    with pytest.raises(ValueError):
        sharding.shard_rows(keys, weights=(0.0,))


def test_slots_have_no_gaps(spark, docs, empty, monkeypatch):
    monkeypatch.setattr(sharding, "SLOT_ROWS", 4)
    placed = sharding.with_slots(sharding.shard_rows(docs, weights=(1.0,) * 3), "shard", ["doc_id", "text"]).collect()
    assert len(placed) == len(rows())
    for s in {r["shard"] for r in placed}:
        slots = sorted(r["slot"] for r in placed if r["shard"] == s)
        assert slots == list(range(len(slots)))
    assert placed[0]["bucket"] == "clash"
    assert sharding.with_slots(sharding.shard_rows(empty), "shard", ["doc_id"]).count() == 0


def test_op10_sizes(spark, data):
    got = sharding.op10_rendezvous_sharding(spark, data)
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{data}/documents.parquet").collect()}
    for r in got.collect():
        raw = (texts[r["doc_id"]] or "").encode()
        assert (r["size"], r["text_crc32"], r["law"]) == (len(raw) + 16, zlib.crc32(raw), "key")


def test_op10_by_brute_force(spark, data):
    """Shards, moves and slots from the definition: the same hash chain, computed apart."""
    import struct

    import xxhash

    def draw(key, shard):
        h = 42
        for part in (struct.pack("<i", 0), key.encode(), struct.pack("<i", shard)):
            h = xxhash.xxh64_intdigest(part, h)
        return math.log(((h >> 11) + 0.5) / 2**53)

    got = sharding.op10_rendezvous_sharding(spark, data).collect()
    slots = defaultdict(list)
    for r in got:
        score = [draw(str(r["doc_id"]), s) for s in range(41)]
        best = max(range(40), key=lambda s: (score[s], -s))
        assert (r["shard"], r["grown_shard"]) == (best, 40 if score[40] > score[best] else best)
        slots[best].append((r["doc_id"], r["slot"]))
    for own in slots.values():  # one bucket at this size, so in the order of doc_id
        assert [s for _, s in sorted(own)] == list(range(len(own)))


def test_sharding_of_long_repeated_and_clashing_rows(spark):
    odd = [(1, "x" * 2_000_000, 0.5), (2, "same", 0.5), (2, "same", 0.5), (None, None, 0.5), (None, "", 0.5)]
    frame = spark.createDataFrame(odd, "doc_id bigint, text string, __best double")
    got = sharding.with_slots(sharding.shard_rows(frame), "shard", ["doc_id", "text"]).collect()
    assert len(got) == 5 and all(r["__best"] == 0.5 for r in got)
    assert len({r["shard"] for r in got if r["doc_id"] == 2}) == 1 and len({r["shard"] for r in got if r["doc_id"] is None}) == 1


# -- personal data

CASES = [
    "Call +1 (017) 555-7713 or mail jo.81@mail7.example.com now", "card 4539 1488 0343 6467, or 4539148803436467!!", "ip 226.203.165.104 on 2024-02-29 and 31.12.1999, 12/25/2020, 2020/01/02",
    "ssn 123-45-6789 token = \"9233A8ECF7C5B09FE5949719B6B82BC439E9329B\"", "4539148803436468 2023-02-30 1.2.3.4.5 300.1.1.1 000-12-3456 version 3.0", "é.07@mail2.example.com", None, "",
]


def luhn(s):
    d = [int(c) for c in re.sub(r"\D", "", s)][::-1]
    return (sum(d[::2]) + sum(sum(divmod(2 * x, 10)) for x in d[1::2])) % 10 == 0


def test_pseudonyms(spark):
    frame = spark.createDataFrame([(i, t, "kept") for i, t in enumerate(CASES)], "doc_id int, text string, n_ip string")
    out = [r["text"] for r in pii.pseudonymise(frame, "k").orderBy("doc_id").collect()]
    shape = lambda t: re.sub("[à-öø-ÿ]", "é", re.sub("[A-Z]", "A", re.sub("[a-z]", "a", re.sub("[0-9]", "9", t))))
    for before, after in zip(CASES, out, strict=True):
        if before is not None and "ip " not in before:
            assert shape(before) == shape(after)
    assert out[4] == CASES[4] and out[6] is None and out[7] == ""
    cards = re.findall(r"[0-9][0-9 ]{14,}[0-9]", out[1])
    assert all(luhn(c) for c in cards) and len({re.sub(" ", "", c) for c in cards}) == 1 and "4539148803436467" not in re.sub(" ", "", out[1])
    assert "226.203.165.104" not in out[2] and all(int(o) < 256 for o in re.search(r"ip (\S+)", out[2])[1].split("."))
    assert "jo.81@" not in out[0] and "@mail7.example.com" in out[0] and "+1 (" in out[0]
    back = pii.pseudonymise(pii.pseudonymise(frame, "k"), "k", reverse=True).orderBy("doc_id")
    assert [r["text"] for r in back.collect()] == CASES
    other = [r["text"] for r in pii.pseudonymise(frame, "another").orderBy("doc_id").collect()]
    assert other[0] != out[0]


def test_pseudonyms_of_other_groupings(spark):
    cases = ["card 3782 822463 10005 or 3782-822463-10005.", "call +44 20 7946 0958, +33 1 23 45 67 89 now", "+33.1.23.45.67.89", "no card 3782 822463 10006, no phone +1 22 33 4 or +1 22 33 44 55 66 77 88 99"]
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    made = pii.pseudonymise(frame, "k", counts=True).orderBy("doc_id").collect()
    assert [(r["n_card"], r["n_phone"]) for r in made] == [(2, 0), (0, 2), (0, 1), (0, 0)]
    for before, r in zip(cases[:3], made, strict=False):
        assert r["text"] != before and re.sub("[0-9]", "9", r["text"]) == re.sub("[0-9]", "9", before)
    assert all(luhn(c) for c in re.findall(r"[0-9]{4}[ -][0-9]{6}[ -][0-9]{5}", made[0]["text"])) and "+44 " in made[1]["text"] and "+33 " in made[1]["text"]
    assert made[3]["text"] == cases[3]
    back = pii.pseudonymise(pii.pseudonymise(frame, "k"), "k", reverse=True).orderBy("doc_id")
    assert [r["text"] for r in back.collect()] == cases


def test_pseudonyms_of_long_secrets_and_cards_of_19(spark):
    rng = random.Random(6)
    long = "".join(rng.choice("0123456789abcdefXYZ") for _ in range(128))
    base = "".join(rng.choice("ABCDabcd0189+/") for _ in range(62)) + "+/=="
    card = "4539148803436467123"
    card = next(c for c in (card[:-1] + str(d) for d in range(10)) if luhn(c))
    cases = [f"key {long} end", f"key={base} end", f"card {' '.join(card[i : i + 4] for i in range(0, 19, 4))}.", "http://example.com/a/path/of/Many/Parts/with/Some/letters/1/2", "a" * 100_000 + " " + "b1" * 300, "c2" * 256]
    frame = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(cases)], "doc_id int, text string, __text string, __done string")
    made = pii.pseudonymise(frame, "k", counts=True).orderBy("doc_id").collect()
    assert [(r["n_secret"], r["n_card"]) for r in made] == [(1, 0), (1, 0), (0, 1), (0, 0), (2, 0), (1, 0)]
    whole = made[4]["text"].removeprefix("a" * 100_000 + " ")
    assert len(whole) == 600 and sum(a != b for a, b in zip(whole, "b1" * 300, strict=True)) > 450
    assert all(r["__text"] == "x" and r["__done"] == "y" for r in made)
    for k in (0, 1, 2):
        assert made[k]["text"] != cases[k] and len(made[k]["text"]) == len(cases[k])
    assert made[1]["text"].endswith("== end") and luhn(made[2]["text"])
    assert sum(a != b for a, b in zip(made[0]["text"], cases[0], strict=True)) > 90
    back = pii.pseudonymise(pii.pseudonymise(frame, "k"), "k", reverse=True).orderBy("doc_id")
    assert [r["text"] for r in back.collect()] == cases


def test_pseudonyms_of_long_mail_names(spark):
    rng = random.Random(7)
    names = ["".join(rng.choice("abcdefghij.XYZ019") for _ in range(n)) for n in (70, 512, 513, 1_500, 20_000)]
    cases = [f"to {n}@mail.example.org, {n}" for n in names] + ["x" * 2_000 + " @", "y" * 600 + "@nohost"]
    frame = spark.createDataFrame(list(enumerate(cases)), "doc_id int, text string")
    made = [r["text"] for r in pii.pseudonymise(frame, "k").orderBy("doc_id").collect()]
    for name, text, case in zip(names, made, cases, strict=False):
        assert len(text) == len(case) and text[3 + len(name) :].startswith("@mail.example.org, ")
        assert sum(a != b for a, b in zip(text[3 : 3 + len(name)], name, strict=True)) > 0.6 * len(name)
    assert made[5:] == cases[5:]
    back = pii.pseudonymise(spark.createDataFrame(list(enumerate(made)), "doc_id int, text string"), "k", reverse=True).orderBy("doc_id")
    assert [r["text"] for r in back.collect()] == cases


def test_pseudonyms_by_an_independent_feistel(spark):
    import hmac

    key = "k"

    def feistel(kind, values, radices):
        n, cut = len(values), (len(values) + 1) // 2
        a, b = list(zip(values, radices, strict=True))[:cut], list(zip(values, radices, strict=True))[cut:]
        for r in range(pii.ROUNDS):
            half, other = (a, b) if r % 2 == 0 else (b, a)
            said = "|".join([kind, str(n), str(r), ",".join(str(v) for v, _ in other)])
            pad = "".join(hmac.new(key.encode(), f"{p}|{said}".encode(), hashlib.sha512).hexdigest() for p in range((len(half) - 1) // pii.PAD_VALUES + 1))
            half = [((v + int(pad[7 * i : 7 * i + 7], 16)) % x, x) for i, (v, x) in enumerate(half)]
            a, b = (half, b) if r % 2 == 0 else (a, half)
        return [v for v, _ in a + b]

    ips = [f"10.{i}.7.{255 - i}" for i in range(0, 200, 17)]
    cards = [c for i in range(400) if luhn(c := f"45391488034{i:05d}")][:10]
    days = ["1900-01-01", "2099-12-31", "2024-02-29", "1987-06-05"]
    frame = spark.createDataFrame([(t,) for t in ips + cards + days], "text string")
    got = [r["text"] for r in pii.pseudonymise(frame, key).collect()]
    import datetime

    begin = datetime.date(1900, 1, 1)
    want = [".".join(map(str, feistel("ip", [int(o) for o in t.split(".")], [256] * 4))) for t in ips]
    for c in cards:
        body = "".join(map(str, feistel("card", [int(d) for d in c[:-1]], [10] * 15)))
        want.append(next(body + str(d) for d in range(10) if luhn(body + str(d))))
    for d in days:
        n = (datetime.date.fromisoformat(d) - begin).days
        hi, lo = feistel("date", [n // pii.DATE_RADIX[1], n % pii.DATE_RADIX[1]], pii.DATE_RADIX)
        want.append(str(begin + datetime.timedelta(hi * pii.DATE_RADIX[1] + lo)))
    assert sorted(got) == sorted(want)


def test_pseudonyms_of_nothing_and_of_repeated_rows(spark, empty):
    assert pii.pseudonymise(empty, "k", counts=True).count() == 0
    frame = spark.createDataFrame([(1, "mail jo.81@mail7.example.com")] * 3, "doc_id int, text string")
    assert pii.pseudonymise(frame, "k").distinct().count() == 1


def test_pseudonyms_are_a_permutation_and_plans_have_no_python(spark):
    ips = spark.range(300).select(F.concat(F.lit("10.0."), (F.col("id") / 256).cast("int").cast("string"), F.lit("."), (F.col("id") % 256).cast("string")).alias("text"))
    out = pii.pseudonymise(ips, "k", counts=True)
    assert out.select("text").distinct().count() == 300
    assert out.agg(F.sum("n_ip")).first()[0] == 300
    assert "Python" not in out._jdf.queryExecution().toString() and "Arrow" not in out._jdf.queryExecution().toString()


# -- near duplicates


def brute_components(data, size, num, den):
    sets, inverted = {}, defaultdict(list)
    for i, t in data:
        w = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(w[j : j + size]) for j in range(len(w) - size + 1)} if len(w) >= size else ({tuple(w)} if w else set())
        for x in sets[i]:
            inverted[x].append(i)
    parent = {i: i for i in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, s in sets.items():
        for j, o in Counter(j for x in s for j in inverted[x] if j < i).items():
            if den * o >= num * (len(s) + len(sets[j]) - o):
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    return {i: (len(s), root(i)) for i, s in sets.items()}


def near_copies():
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    out = []
    for n in (1, 2, 3, 5, 8, 12, 20, 40, 80, 200, 400):
        base = [word() for _ in range(n)]
        for _ in range(8):
            copy = [word() if rng.random() < rng.choice([0.0, 0.01, 0.03, 0.06]) else w for w in base]
            out.append(" ".join(copy + [word() for _ in range(rng.choice([0, 0, 1, 3]))]))
    out += [None, "", " \n", "Same Words here", "same words HERE"]
    rng.shuffle(out)
    return list(enumerate(out))


@pytest.mark.parametrize(("size", "num", "den"), [(3, 9, 10), (5, 4, 5)])
def test_jaccard_against_brute_force(spark, size, num, den):
    data = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(data, "doc_id bigint, text string"), size, num, den).collect()}
    assert got == brute_components(data, size, num, den)


@pytest.mark.parametrize(("chunk", "block", "shingles"), [(2, 2, 10**9), (3, 4, 10**9), (64, 128, 600)])
def test_jaccard_by_blocks(spark, monkeypatch, chunk, block, shingles):
    for name, value in (("CHUNK", chunk), ("BLOCK", block), ("TASK_SHINGLES", shingles)):
        monkeypatch.setattr(jaccard, name, value)
    data = near_copies()
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(data, "doc_id bigint, text string"), 5, 4, 5).collect()}
    assert got == brute_components(data, 5, 4, 5)


def test_jaccard_splits_a_large_star(spark, monkeypatch):
    """Hundreds of copies that differ from each other and share a passage with others: no task has them all."""
    for name, value in (("CHUNK", 16), ("BLOCK", 16)):
        monkeypatch.setattr(jaccard, name, value)
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    base, passage = [word() for _ in range(120)], [word() for _ in range(60)]
    texts = []
    for _ in range(150):
        copy = list(base)
        for _ in range(rng.choice([1, 1, 2, 3])):
            copy[rng.randrange(len(copy))] = word()
        texts.append(" ".join(copy))
        texts.append(" ".join([word() for _ in range(rng.randint(5, 60))] + passage + [word() for _ in range(rng.randint(5, 60))]))
    data, most = list(enumerate(texts)), []
    verify = jaccard._verify

    def seen(members, *args):
        most.append(members.groupBy("task").count().agg(F.max("count")).first()[0])
        return verify(members, *args)

    monkeypatch.setattr(jaccard, "_verify", seen)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in jaccard.linked(spark.createDataFrame(data, "doc_id bigint, text string"), 3, 9, 10).collect()}
    assert got == brute_components(data, 3, 9, 10)
    assert len(most) == 2 and max(most) < 70


def test_jaccard_of_nothing_and_of_clashing_columns(spark, docs, empty):
    assert jaccard.linked(empty).count() == 0
    got = jaccard.linked(docs).collect()
    assert len(got) == len(rows())


@pytest.mark.parametrize(("num", "den"), [(4, 5), (9, 10)])
def test_jaccard_groups_sets_of_any_size(num, den):
    for band in range(12, 56):
        groups, times = jaccard.grouping(band, num, den)
        for n in (math.ceil(jaccard.BAND**band), math.ceil(jaccard.BAND ** (band + 1)) - 1):
            d = n * (den - num) // num
            alone = math.exp(n * math.log1p(-1 / groups)) * (1 + n / (groups - 1))
            assert times * groups * math.log1p(-math.exp(d * math.log1p(-1 / groups)) * (1 - alone)) <= math.log(jaccard.MISS) + 1e-6
    rng = np.random.default_rng(5)
    n = 4_000_000
    tokens = rng.integers(0, 2**64 - 1, n * den // num, np.uint64, endpoint=True)
    keys = [jaccard._keys(np.sort(x), num, den) for x in (tokens[:n], tokens)]
    assert len(np.intersect1d(*keys)) > 0


def test_components(spark):
    pairs = [(i + 1, i) for i in range(40)] + [(100, 50), (100, 51), (51, 60), (7, 7)]
    got = {r["id"]: r["component"] for r in jaccard.components(spark.createDataFrame(pairs, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(41)} | {i: 50 for i in (50, 51, 60, 100)}


def test_rtree_bound_finds_all_links():
    rng = np.random.default_rng(3)
    sets = [np.sort(rng.integers(0, 2**62, 300).astype(np.uint64))]
    for _ in range(90):
        s = sets[rng.integers(len(sets))].copy()
        s[rng.integers(0, len(s), rng.integers(0, 40))] = rng.integers(0, 2**62)
        sets.append(np.unique(s))
    starts = np.concatenate([[0], np.cumsum([len(s) for s in sets])])
    points, size = jaccard.counts_of(np.concatenate(sets), starts), np.diff(starts)
    order = jaccard.Tree.order(points, size, np.arange(len(sets)))
    assert sorted(order.tolist()) == list(range(len(sets)))
    tree = jaccard.Tree(points[order], size[order])
    assert len(tree.levels) > 1
    found = set(zip(*(x.tolist() for x in tree.pairs(np.arange(len(sets)), 9, 10)), strict=True))
    for i in range(len(sets)):
        for j in range(i):
            if len(np.intersect1d(sets[order[i]], sets[order[j]])) * 10 >= 9 * len(np.union1d(sets[order[i]], sets[order[j]])):
                assert (i, j) in found
    links = jaccard.verified_links(np.concatenate(sets), starts, np.arange(len(sets)), 9, 10)
    forest = jaccard.Forest(len(sets))
    want = jaccard.Forest(len(sets))
    for f, pairs in ((forest, links), (want, [(i, j) for i in range(len(sets)) for j in range(i) if len(np.intersect1d(sets[i], sets[j])) * 10 >= 9 * len(np.union1d(sets[i], sets[j]))])):
        for i, j in pairs:
            a, b = f.root(i), f.root(j)
            f.parent[max(a, b)] = min(a, b)
    assert (forest.roots() == want.roots()).all()


# -- quality, toxicity, lines


def test_quality_learns_and_scores_everything(spark, data, docs, labels, empty):
    scored = quality.quality_scores(docs, labels).collect()
    assert len(scored) == len(rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert quality.quality_scores(empty, labels).count() == 0
    assert quality.quality_scores(docs, labels.limit(0)).count() == len(rows())
    got = quality.op2_nbsvm_quality(spark, data).join(spark.read.parquet(f"{data}/labels.parquet"), "doc_id").where("held_out").collect()
    assert np.mean([r["predicted"] == r["quality"] for r in got]) > 0.85
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) for r in got)


def test_quality_scores_by_hand(spark, data):
    """Scores of the registered query from a plain reading of its features, one document at a time."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    from isobar.llm.shared import fitted

    model = fitted(docs, labels, "quality", 3, 1, quality.SAMPLE, quality.train)
    got = {r["doc_id"]: r for r in quality.op2_nbsvm_quality(spark, data).collect()}
    import xxhash

    mask = (1 << 64) - 1

    def mix(x):
        x = (x ^ (x >> 30)) * 0xBF58476D1CE4E5B9 & mask
        x = (x ^ (x >> 27)) * 0x94D049BB133111EB & mask
        return x ^ (x >> 31)

    def shape(word):
        import regex

        for pattern, to in ((r"\p{Lu}+", "X"), (r"[\p{Ll}\p{Lo}\p{Lm}\p{M}]+", "x"), (r"\p{N}+", "d"), ("!+", "!"), (r"\.+", ".")):
            word = regex.sub(pattern, to, word)
        return word

    for r in docs.limit(60).collect():
        words = WORD.findall(r["text"] or "")
        w = [xxhash.xxh3_64_intdigest(x.lower()) for x in words]
        s = [xxhash.xxh3_64_intdigest(shape(x)) ^ (0x5555 if k and words[k - 1] == x else 0) for k, x in enumerate(words)]
        grams = set(w) | {(x * 3 + 1) & mask for x in s}
        grams |= {mix((a * 5 + b) & mask) for a, b in zip(w, w[1:], strict=False)} | {mix((a * 7 + b) & mask) for a, b in zip(s, s[1:], strict=False)}
        own = sorted({g >> 44 for g in grams})
        x = model.ratios[own]
        margin = float(x @ model.weights[own]) / math.sqrt(max(float(x @ x), 1e-12))
        assert got[r["doc_id"]]["score"] == pytest.approx(1 / (1 + math.exp(-(margin * model.curve[0] + model.curve[1]))), abs=1e-6)
        assert got[r["doc_id"]]["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1)


def test_shapes_are_whole():
    a, b = (quality._shapes(pa.array([w]))[0].as_py() for w in ("a1-b2-c3-d4-e5-f6-G7", "a1-b2-c3-d4-e5-f6-g7"))
    assert a != b


def test_dual_descent_separates():
    rng = np.random.default_rng(0)
    features = [np.unique(np.concatenate([rng.integers(0, 50, 8), [100 + int(v)]])) for v in rng.integers(0, 2, 200)]
    starts = np.concatenate([[0], np.cumsum([len(f) for f in features])])
    flat, target = np.concatenate(features), np.array([int(100 + 1 in f) for f in features])
    ratios = quality.log_count_ratios(flat, starts, target)
    w = quality.dual_descent(flat, starts, ratios, target, 1.0, 10)
    model = quality.NaiveBayesSVM(w, ratios, np.array([1.0, 0.0]))
    assert ((model.margins(flat, starts) > 0) == (target == 1)).all()


def test_toxicity_scores_by_a_plain_forward_pass(docs, labels):
    """Each window of a text on its own, word by word, with the formulas of a gated recurrent unit."""
    net = toxicity.trained(docs, labels)
    sig = lambda x: 1 / (1 + np.exp(-x))

    def layer(inputs, u):
        h, out, n = np.zeros(toxicity.HIDDEN), [], toxicity.HIDDEN
        for p in inputs:
            z, r = sig(p[:n] + h @ u[:, :n]), sig(p[n : 2 * n] + h @ u[:, n : 2 * n])
            c = np.tanh(p[2 * n :] + (r * h) @ u[:, 2 * n :])
            h = (1 - z) * h + z * c
            out.append(h)
        return out

    for text in [r[1] for r in rows() if r[1]][:12] + ["one two three four five " * 31]:
        words = WORD.findall(text)
        best, count, first = -np.inf, 0, 0
        while words:
            part = words[first : first + toxicity.WINDOW]
            stats, letters = net.inputs.of(pa.array(part))
            _, f, b = net.projected(stats, letters)
            states = np.hstack([layer(f, net.w["uf"]), layer(b[::-1], net.w["ub"])[::-1]])
            weight = np.exp(np.tanh(states @ net.w["att"]) @ net.w["pick"])
            best, count = max(best, (weight / weight.sum()) @ states @ net.w["out"] + net.w["bias"][0]), count + 1
            if first + toxicity.WINDOW >= len(words):
                break
            first += toxicity.STRIDE
        logit = best if words else toxicity.NOTHING
        want = sig(np.array([logit, min(math.log(max(count, 1)), net.longest), 1]) @ net.curve)
        assert net.score(pa.array([text]))[0] == pytest.approx(want, abs=1e-4)


def test_toxicity_gradients():
    rng = np.random.default_rng(2)
    w = {k: rng.normal(0, 0.3, s).astype(np.float64) for k, s in toxicity.SHAPES.items()}
    stats, letters = rng.normal(size=(30, toxicity.STATS)), rng.integers(1, 64, (30, 10)).astype(np.uint8)
    bags = rng.integers(0, 30, (4, 2, toxicity.WINDOW))
    bags[0, 1, 5:], bags[1, 1] = -1, -1
    y, rate = np.array([1, 0, 1, 0]), np.ones(4)

    def loss(w):
        net = toxicity.Network(w, None, np.zeros(3))
        total = 0.0
        for d in range(4):
            logits = []
            for bag in bags[d]:
                real = bag >= 0
                if not real.any():
                    continue
                _, f, b = net.projected(stats[np.maximum(bag, 0)], letters[np.maximum(bag, 0)])
                f, b = f * real[:, None], b * real[:, None]
                forward, _ = toxicity._gru(f[:, None].astype(np.float32), w["uf"], False)
                backward, _ = toxicity._gru(b[::-1, None].astype(np.float32), w["ub"], False)
                logits.append(net.pooled(forward, backward[::-1], real[:, None])[0][0])
            soft = np.exp(4 * (np.array(logits) - max(logits)))
            z = (soft / soft.sum()) @ np.array(logits)
            total += np.log1p(np.exp(-z if y[d] else z))
        return total / 4

    grads = toxicity._bag_gradients(w, stats, letters, bags, y, rate)
    for k in ("out", "pick", "att", "uf", "wb", "letters", "bias"):
        at = tuple(0 for _ in w[k].shape)
        up, down = ({n: v.copy() for n, v in w.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        # the smooth maximum's own weights are held fixed in the gradient
        assert grads[k][at] == pytest.approx((loss(up) - loss(down)) / 2e-2, abs=4e-2)


def test_toxicity_finds_a_word_anywhere(spark):
    rng = random.Random(3)
    clean = lambda n: " ".join(rng.choice(["the", "of", "river", "stone", "green", "walks", "under", "sky"]) for _ in range(n))
    texts, y = [], []
    for i in range(160):
        t, toxic = clean(rng.randint(20, 200)), i % 2
        if toxic:
            w = t.split()
            w[rng.randrange(len(w))] = rng.choice(["fool", "vermin"])
            t = " ".join(w)
        texts.append(t)
        y.append(toxic)
    net = toxicity.train(texts, np.array(y), 0.3)
    long = clean(3000).split()
    long[2871] = "vermin"
    score = net.score(pa.array([" ".join(long), clean(3000), "", None, "fool"], pa.string()))
    assert score[0] > 0.5 > score[1] and score[2] < 0.3 and score[3] < 0.3
    owner, first, length = toxicity.windows(np.array([0, 0, 5, 5 + 48, 53 + 49, 102 + 500]))
    covered = defaultdict(set)
    for o, f, n in zip(owner, first, length, strict=True):
        covered[o] |= set(range(f, f + n))
    assert {o: len(c) for o, c in covered.items()} == {1: 5, 2: 48, 3: 49, 4: 500}


def test_toxicity_reads_long_words_whole(monkeypatch):
    rng = random.Random(4)
    words = ["".join(rng.choice("abcdefg-_/") for _ in range(n)) for n in (1, 2, 23, 24, 25, 26, 44, 45, 46, 67, 200, 5000)] + ["\u6bd2" * 70]
    odds = np.random.default_rng(4).normal(size=toxicity.GRAM_BUCKETS).astype(np.float32)
    inputs = toxicity.Inputs(np.zeros(toxicity.WORD_BUCKETS, np.float32), odds)
    for block in (10_000, 7):
        monkeypatch.setattr(toxicity, "ROWS", block)
        stats, shares = inputs.of(pa.array(words, pa.large_string()))
        for w, s, share in zip(words, stats, shares, strict=True):
            letters = np.array([[2, *w.encode(), 3, 0, 0, 0, 0]], np.uint8)
            grams, edge = toxicity.gram_buckets(letters)
            mine, start = odds[grams[grams >= 0]], odds[grams[(grams >= 0) & edge]]
            assert s[1:5] == pytest.approx([max(mine.max(), -3), max(start.max(), -3), mine.mean(), start.sum() / 4], abs=1e-4)
            counts = np.bincount(letters[letters > 0] % toxicity.LETTERS, minlength=toxicity.LETTERS)
            assert share == pytest.approx(counts / max(len(w.encode()), toxicity.READ), abs=1e-6)


def test_toxicity_counts_every_gram_of_a_long_word_once():
    rng = random.Random(6)
    word = "".join(rng.choice("abcdefghij") for _ in range(400_000))
    down = toxicity.class_counts([word, "a b"], np.array([1, 0]))[1]
    grams = toxicity.gram_buckets(np.array([[2, *word.encode(), 3]], np.uint8))[0]
    expected = set(grams[grams >= 0].tolist()) | set(toxicity.start_buckets(pa.array([word], pa.large_string())).ravel().tolist())
    assert set(np.flatnonzero(down[1]).tolist()) == expected and down[1].max() == 1


def test_toxicity_finds_a_word_inside_a_long_run():
    rng = random.Random(3)
    pick = lambda n: [rng.choice(["the", "of", "river", "stone", "green", "walks", "under", "sky"]) for _ in range(n)]
    texts, y = [], []
    for i in range(200):
        w, toxic = pick(rng.randint(20, 100)), i % 2
        run = pick(40)
        if toxic:
            run[rng.randrange(15, 25)] = rng.choice(["fool", "vermin"])
        w[rng.randrange(len(w))] = rng.choice("-_/").join(run)
        texts.append(" ".join(w))
        y.append(toxic)
    net = toxicity.train(texts, np.array(y), 0.3)
    clean = pick(40)
    dirty = [*clean[:20], "vermin", *clean[21:]]
    score = net.score(pa.array([" ".join([*pick(30), "-".join(run), *pick(30)]) for run in (dirty, clean)], pa.string()))
    assert len("-".join(dirty)) > 190 and score[0] > 0.5 > score[1]


def test_toxicity_edges(docs, labels, empty):
    scored = toxicity.toxicity_scores(docs, labels).collect()
    assert len(scored) == len(rows()) and all(0 <= r["score"] <= 1 for r in scored)
    assert toxicity.toxicity_scores(empty, labels).count() == 0


def brute_base(t):
    t = t or ""
    w = WORD.findall(t)
    seen, dup = set(), 0
    for line in t.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    grams = list(zip(w, w[1:], w[2:], strict=False))
    often = Counter(grams)
    marked = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), dup, len(marked)


def test_line_rules(spark, docs, labels, empty):
    texts = [r[1] for r in rows()] + ["a b\na b\n\na b \na b", "x # y *$%&|<>\n" * 30, "one two three one two three", "\n\n"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r["doc_id"]: r for r in lines.apply_rules(frame, labels, lines=True).collect()}
    for i, t in enumerate(texts):
        base = brute_base(t)
        assert tuple(got[i][c] for c, _ in lines.COLUMNS[:5]) == base
        assert got[i]["base_failed"] == (base[0] < 50 or 100 * base[4] > 50 * base[0])
        assert not (got[i]["base_failed"] and got[i]["kept"])
    assert lines.apply_rules(empty, labels).count() == 0
    assert lines.apply_rules(docs, labels).columns[:5] == docs.columns


def test_line_labels_differ_within_documents():
    rng = random.Random(4)
    sentence = lambda n=12: " ".join("".join(rng.choice("aeioustrn") for _ in range(rng.randint(2, 7))) for _ in range(n)).capitalize() + "."
    junk = lambda n=12: " ".join(w + "###" for w in sentence(n).split())
    texts, y = [], []
    for k in range(40):
        license = "All rights reserved worldwide by the owners"
        texts.append("\n".join([sentence(), license, sentence(), sentence(), license]))
        texts.append("\n".join([junk(), junk(), sentence(), junk()]))
        y += [1, 0]
    texts.append("\n".join(sentence() for _ in range(2 * lines.CHAIN + 7)))
    y = np.array([*y, 1])
    found = lines.Lines(pa.array(texts))
    label = lines.line_labels(found, found.features(), y)
    by_line = dict(zip([t for text in texts for t in text.split("\n")], label.tolist(), strict=True))
    assert not any(v for t, v in by_line.items() if t.startswith("All rights"))
    assert not any(v for t, v in by_line.items() if "###" in t)
    assert np.mean([v for t, v in by_line.items() if "###" not in t and not t.startswith("All")]) > 0.9
    field = lines.train_documents(texts, y)
    decoded = field.decode(found.features(), found.doc)
    share = np.bincount(found.doc, decoded) / np.bincount(found.doc)
    # every label-1 document of the license kind has both labels, its license lines being boilerplate
    assert share[:80:2].tolist() == [0.6] * 40 and share[-1] == 1


def test_line_verdict_by_brute_force(spark, data):
    """``kept`` from the best of all labellings, worked out line by line for each document."""
    docs, labels = spark.read.parquet(f"{data}/documents.parquet"), spark.read.parquet(f"{data}/labels.parquet")
    field = lines.trained(docs, labels)
    got = {r["doc_id"]: r for r in lines.apply_rules(docs, labels, field).drop("text").collect()}
    for r in docs.select("doc_id", "text").collect():
        text = r["text"] or ""
        words, own = WORD.findall(text), got[r["doc_id"]]
        windows = Counter(zip(words, words[1:], words[2:], strict=False))
        again = {i + j for i in range(len(words) - 2) if windows[tuple(words[i : i + 3])] > 1 for j in range(3)}
        assert (own["n_words"], own["n_repeat_words"]) == (len(words), len(again))
        failed = len(words) < 50 or 100 * len(again) > 50 * len(words)
        found = lines.Lines(pa.array([text]))
        ways = [(0.0, []), (0.0, [])]
        for k, score in enumerate(found.features() @ field.unary):
            ways = [max(((w + (field.pair[b, c] if k else 0.0) + score[c], [*way, c]) for b, (w, way) in enumerate(ways)), key=lambda x: (x[0], x[1][-2:])) for c in (0, 1)]
        best = max(ways, key=lambda x: (x[0], x[1][-1:]))[1]
        share = sum(n for n, c in zip(found.size, best, strict=False) if c) / max(len(words), 1)
        assert abs(share - own["content_share"]) < 1e-12
        assert own["base_failed"] == failed and own["kept"] == (not failed and share >= lines.KEEP)


def test_viterbi_against_all_sequences():
    import itertools

    rng = np.random.default_rng(1)
    field = lines.Field(rng.normal(size=(3, 2)), rng.normal(size=(2, 2)))
    doc = np.array([0] * 5 + [2] * 1 + [3] * 7)
    features = rng.normal(size=(len(doc), 3))
    got = field.decode(features, doc)
    score = features @ field.unary
    for d in (0, 2, 3):
        at = np.flatnonzero(doc == d)
        value = lambda s: sum(score[i, k] for i, k in zip(at, s, strict=True)) + sum(field.pair[a, b] for a, b in zip(s, s[1:], strict=False))  # noqa: B023, E731
        assert tuple(got[at]) == max(itertools.product((0, 1), repeat=len(at)), key=value)


def test_field_learns_a_chain():
    rng = np.random.default_rng(6)
    doc = np.repeat(np.arange(40), 10)
    label = np.repeat(rng.integers(0, 2, 40), 10)
    features = np.column_stack([np.ones(400), (rng.random(400) < np.where(label == 1, 0.7, 0.3))]).astype(float)
    field = lines.train(features, doc, label)
    # ten lines that tell the label with a chance of 0.7 each; alone they would reach 0.7, a majority 0.85 to 0.95
    assert (field.decode(features, doc) == label).mean() > 0.85
    assert field.pair[0, 0] + field.pair[1, 1] > field.pair[0, 1] + field.pair[1, 0]


# -- search


@pytest.mark.parametrize("scale", [3, 100])
def test_top_k_against_brute_force(spark, monkeypatch, scale):
    monkeypatch.setattr(topk, "BLOCK", 64)
    rng = np.random.default_rng(scale)
    vectors = rng.integers(-scale, scale + 1, (400, 6))
    vectors[17] = vectors[18] = vectors[19]
    data = [(i, [int(v) for v in row]) for i, row in enumerate(vectors)] + [(900, None)]
    frame = spark.createDataFrame(data, "id bigint, vector array<bigint>")
    got = topk.top_k(frame, frame.where("id % 20 = 0"), 7).collect()
    for q in range(0, 400, 20):
        score = vectors @ vectors[q]
        want = sorted(((-s, i) for i, s in enumerate(score) if i != q))[:7]
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [(-s, i) for _, i, s in mine] == [(int(a), b) for a, b in want]
    few = frame.where("id < 3")
    assert topk.top_k(few, few, 7).count() == 6
    assert topk.top_k(frame.limit(0), frame.limit(0), 3).count() == 0


def test_top_k_of_nothing_of_repeats_and_of_extra_columns(spark):
    frame = spark.createDataFrame([(i, [i % 7 - 3, 2, -i % 5], "x", i) for i in range(40)] + [(5, [2, 2, 0], "x", 1)] * 3, "id bigint, vector array<bigint>, part string, score bigint")
    got = topk.top_k(frame, frame.where("id = 0"), 50).collect()
    assert len(got) == 42 and sum(r["vec_id"] == 5 for r in got) == 4
    assert topk.top_k(frame.limit(0), frame, 5).count() == 0 and topk.top_k(frame, frame.limit(0), 5).count() == 0


def test_max_score_drops_documents_before_products():
    rng = np.random.default_rng(1)
    vectors = np.floor(64 * rng.normal(size=(2000, 16)) * (rng.random((2000, 16)) < 0.2)).astype(np.int64)
    taken = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = np.ndarray.__getitem__(self, key)
            if isinstance(key, tuple) and len(key) == 2 and np.ndim(out) == 2:
                taken.append(len(out))
            return np.asarray(out)

    shard = topk.Shard(np.arange(2000), vectors)
    shard.vectors = vectors.view(Counted)
    q = vectors[vectors.any(1)][3]
    scores, ids = shard.search(-1, q, 10, [np.zeros(0, np.int64)] * 2)
    exact = vectors @ q
    want = np.lexsort((np.arange(2000), -exact))[:10]
    assert ids.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
    assert taken and max(taken) < 600


def test_max_score_takes_less_time_than_products():
    """Dense vectors, of which bounds drop few: a query costs no more than a few times what integer products would."""
    rng = np.random.default_rng(2)
    vectors = np.floor(64 * (x := rng.normal(size=(8192, 64))) / np.linalg.norm(x, axis=1)[:, None]).astype(np.int64)
    shard, best, plain = topk.Shard(np.arange(8192), vectors), [], []
    for _ in range(3):
        start = time.process_time()
        got = [shard.search(i, vectors[i], 20, [np.zeros(0, np.int64)] * 2) for i in range(40)]
        best.append(time.process_time() - start)
        start = time.process_time()
        exact = [vectors @ vectors[i] for i in range(40)]
        plain.append(time.process_time() - start)
    for i, (scores, ids) in enumerate(got):
        want = [j for j in np.lexsort((np.arange(8192), -exact[i])) if j != i][:20]
        assert ids.tolist() == want and scores.tolist() == exact[i][want].tolist()
    assert min(best) < 5 * min(plain)


@pytest.mark.parametrize("largest", [3, 30_000, 1 << 28])
def test_max_score_drops_documents_below_negative_thresholds(largest):
    rng = np.random.default_rng(largest)
    vectors = -rng.integers(0, largest + 1, (600, 12))
    vectors[300:] -= largest
    taken = []

    class Counted(np.ndarray):
        def __getitem__(self, key):
            out = np.ndarray.__getitem__(self, key)
            taken.append(len(out))
            return np.asarray(out)

    q, none = rng.integers(1, largest + 1, 12), [np.zeros(0, np.int64)] * 2
    best = topk.Shard(np.arange(300), vectors[:300]).search(-1, q, 5, none)
    shard = topk.Shard(np.arange(300, 600), vectors[300:])
    shard.vectors = vectors[300:].view(Counted)
    exact = vectors @ q
    want = np.lexsort((np.arange(600), -exact))[:5]
    scores, ids = shard.search(-1, q, 5, best)
    assert ids.tolist() == want.tolist() and scores.tolist() == exact[want].tolist()
    assert max(taken, default=0) < 150


def test_top_k_deals_a_small_table_to_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(topk, "BLOCK", 64)
    monkeypatch.setattr(topk, "SHARE", 10, raising=False)
    rng = np.random.default_rng(5)
    vectors = rng.integers(-9, 10, (200, 8))
    frame = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(vectors)], "id bigint, vector array<bigint>")
    got = topk.top_k(frame, frame.where("id % 2 = 0"), 3)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert re.findall(r"xxhash64\(2, .*?, 42\), (\d+)\)", plan) == ["10"]
    rows = got.collect()
    assert len(rows) == 300
    for q in (0, 2, 198):
        want = sorted((-int(s), i) for i, s in enumerate(vectors @ vectors[q]) if i != q)[:3]
        assert [(-r["score"], r["vec_id"]) for r in sorted((r for r in rows if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_top_k_of_ragged_vectors(spark):
    data = [(0, [1, 2]), (1, [3]), (2, []), (3, [1, 1, 5])]
    frame = spark.createDataFrame(data, "id bigint, vector array<bigint>")
    got = [(r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in topk.top_k(frame, frame.where("id IN (0, 2)"), 2).collect()]
    assert sorted(got) == [(0, 1, 1, 3), (0, 2, 3, 3), (2, 1, 0, 0), (2, 2, 1, 0)]


def test_quantised(spark):
    cases = [[0.5, -0.01], [float("nan"), 1.0], None, [None, 1.0], [float("inf"), 0.0], []]
    out = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v array<float>").select("i", topk.quantised(F.col("v")).alias("q"))
    assert {r["i"]: r["q"] for r in out.collect()} == {0: [32, -1], 1: None, 2: None, 3: None, 4: None, 5: []}


# -- chat


def test_preference_pairs(spark):
    talk = {
        1: [("user", "hi"), ("assistant", "a"), ("user", "more"), ("assistant", "b")], 2: [("user", "hi"), ("assistant", "a"), ("user", "less"), ("assistant", "c")], 3: [("user", "hi"), ("assistant", "z")],
        4: [("user", "alone")], 5: [(None, None), ("assistant", "x")], 6: [("user", "same"), ("assistant", "same")], 7: [("user", "same"), ("assistant", "same")],
    }
    data = [(c, k, r, t) for c, turns in talk.items() for k, (r, t) in enumerate(turns)] + [(None, 0, "user", "hi")]
    out = {r["chosen_id"]: r for r in preference.format_pairs(preference.paired(spark.createDataFrame(data, "conv_id bigint, turn bigint, role string, text string"))).collect()}
    assert set(out) == {1, 3, 4, 5, 6}
    one = out[1]
    assert (one["rejected_id"], one["n_prompt_turns"]) == (2, 2)
    assert one["prompt"] == "<|user|>\nhi<|end|>\n<|assistant|>\na<|end|>\n"
    a, b = map(int, one["chosen_loss"].split(":"))
    assert one["chosen"][a:b] == "b<|end|>" and one["rejected"].startswith("<|user|>\nless")
    assert out[6]["n_prompt_turns"] == 1 and out[6]["chosen"] == out[6]["rejected"]
    assert out[3]["rejected_id"] is None and out[3]["n_prompt_turns"] == 1 and out[4]["prompt"] == "" and out[5]["prompt"] == "<|unknown|>\n<|end|>\n"


# -- tokens


def test_preference_pairs_with_gaps(spark):
    schema = "conv_id bigint, turn int, role string, text string, pair string, first string"
    assert preference.format_pairs(preference.paired(spark.createDataFrame([], schema))).count() == 0
    long = "word " * 200_000
    turns = [(1, 0, "user", long, "a", "b"), (1, 1, "assistant", "yes", "a", "b"), (2, 0, "user", long, "a", "b"), (2, 1, "assistant", "no", "a", "b"), (2, 1, "assistant", "no", "a", "b")]
    turns += [(3, 0, None, None, "a", "b"), (None, 0, "user", "x", "a", "b"), (4, 0, "user", long + "!", "a", "b"), (4, 1, "assistant", "alone", "a", "b")]
    got = {r["chosen_id"]: r for r in preference.format_pairs(preference.paired(spark.createDataFrame(turns, schema))).collect()}
    assert set(got) == {2, 3, 4} and got[2]["rejected_id"] == 1 and got[3]["rejected_id"] is None
    assert got[2]["n_prompt_turns"] == 1 and len(got[2]["prompt"]) > 1_000_000
    assert got[2]["chosen"].count("no<|end|>") == 2 and got[2]["rejected"].count("yes") == 1
    assert got[3]["chosen"] == "<|unknown|>\n<|end|>\n"


def test_mix_of_null_ids_and_of_a_crowded_last_bin(spark, monkeypatch):
    rng = random.Random(9)
    data = [(None if i % 3 == 0 else i, " ".join([f"w{i}"] * rng.randint(1, 9)), f"s{i % 3}", "m", 0.0) for i in range(400)]
    docs = spark.createDataFrame(data, SCHEMA)
    plain = sorted(map(str, mixing.mix_sources(docs).collect()))
    size = Counter()
    for _, t, s, *_ in data:
        size[s] += len(t.split())
    got = Counter()
    for r in mixing.mix_sources(docs).collect():
        got[r["source"]] += len(r["text"].split())
    for s in mixing.plan_mix(mixing.slim_rows(docs, "mix"), (5, 2, 1), 1.5, 2)[0].collect():
        assert abs(got[s["source"]] - s["target"]) < 40
    monkeypatch.setattr(mixing, "BINS", 2)
    monkeypatch.setattr(mixing, "SORTED", 3)
    assert sorted(map(str, mixing.mix_sources(docs).collect())) == plain


def test_bpe_round_trip(spark, docs, empty):
    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    real = Tokenizer.from_file(path)
    extra = ["I'll <|endoftext|>x <|startoftext|>", "ΑΣ ΣΑΣ İx á ﬁ", "tab\x1cbed \x85 \xa0nbsp", "🎉🎉 日本語 テスト", "a" * 5000]
    texts = [r[1] for r in rows()] + extra
    frame = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id bigint, text string, ids string")
    got = {r["doc_id"]: r for r in bpe.decode(bpe.encode(frame, path), path).collect()}
    for i, t in enumerate(texts):
        want = real.encode(t or "", add_special_tokens=False).ids
        assert np.frombuffer(got[i]["ids"], "<u4").tolist() == want
        assert got[i]["decoded"] == real.decode(want, skip_special_tokens=False)
    assert bpe.encode(empty, path).count() == 0


def test_bpe_merges_long_words_as_the_library_does():
    import time

    from tokenizers import Tokenizer

    path = bpe.tokenizer_path()
    real, merger, rng = Tokenizer.from_file(path), bpe.Merger(path), random.Random(2)
    for n in (47, 48, 49, 300, 6000):
        for letters in ("a", "ab", "theing", "etaoinshrdlu-.", "été日本"):
            word = "".join(rng.choice(letters) for _ in range(n))
            assert merger.word(word) == real.encode(word, add_special_tokens=False).ids
    began = time.monotonic()
    assert merger.word("".join(rng.choice("abcdefgh") for _ in range(1_000_000)))
    assert time.monotonic() - began < 60


def test_bpe_forgets_words_by_bytes(monkeypatch):
    monkeypatch.setattr(bpe, "REMEMBERED_BYTES", 2000)
    path = bpe.tokenizer_path()
    encoder = bpe.Encoder(path, bpe.Automaton(bpe.compile_automaton([])))
    texts = pa.array([" ".join(f"word{i}x" for i in range(200)), "word1x word1x"])
    ids, starts = encoder.encode(texts)
    assert encoder.held <= 2000 and len(encoder.known) < 12
    assert ids[starts[1] :].tolist() == encoder.merger.word("word1x") * 2


def test_lexicon_is_mapped_from_the_broadcast(spark):
    words = [(b"walk", [3, 4]), (b"talk", [5])]
    block = spark.sparkContext.broadcast(bpe.Automaton.shipped(bpe.compile_automaton(words) + b"\0" * 100_000))

    def run(batches):
        automaton = bpe.Automaton.of(block)
        base = automaton.keys
        while base.base is not None and not isinstance(base, np.memmap):
            base = base.base
        ranks = [automaton.ranks(b.column(0)) for b in batches]
        yield pa.RecordBatch.from_pydict({"rank": pa.array(np.concatenate(ranks)), "mapped": pa.array([isinstance(base, np.memmap) and automaton.keys.flags.aligned] * sum(map(len, ranks)))})

    got = spark.createDataFrame([("talk",), ("walk",), ("balk",)], "w string").coalesce(1).mapInArrow(run, "rank bigint, mapped boolean").collect()
    assert [(r["rank"], r["mapped"]) for r in got] == [(0, True), (1, True), (-1, True)]


def test_automaton_is_minimal_and_ranks_words():
    words = sorted({a + b for a in ("walk", "talk", "stalk", "w") for b in ("", "s", "ed", "ing")})
    block = bpe.compile_automaton((w.encode(), [i, i + 1]) for i, w in enumerate(words))
    automaton = bpe.Automaton(block)
    assert automaton.ranks(pa.array([*words, "", "wal", "walkings", "zz"])).tolist() == [*range(len(words)), -1, -1, -1, -1]
    # suffixes are shared: fewer states than one for each prefix
    assert len(automaton.finals) < len({w[:k] for w in words for k in range(len(w) + 1)}) * 0.7
    nothing = bpe.Automaton(bpe.compile_automaton([]))
    assert nothing.ranks(pa.array(["a"])).tolist() == [-1]


def test_lexicon_words_and_others_agree(spark, docs):
    path = bpe.tokenizer_path()
    with_it, without = bpe.encode(docs, path), bpe.encode(docs, path, bpe.compile_automaton([]))
    pick = lambda f: sorted((str(r["doc_id"]), bytes(r["ids"])) for r in f.select("doc_id", "ids").collect())
    assert pick(with_it) == pick(without)


# -- pipeline


def test_pipeline(spark, data):
    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet")
    frame, counts = docs, [docs.count()]
    for name, stage in P.STAGES[:-1]:
        frame = stage(spark, frame, data)
        assert frame.columns == docs.columns, name
        frame = frame.cache()
        counts.append(frame.count())
    assert counts[0] > counts[1] >= counts[2] == counts[3]
    out = P.STAGES[-1][1](spark, frame, data).collect()
    assert len(out) == counts[4] and all(r["n_tokens"] * 4 == len(r["ids"]) for r in out)


def test_pipeline_stages_with_gaps(spark, data):
    import corpus_pipeline as P

    odd = [(1, None, "en", None, 0, 1.0), (2, "", "en", "a", 0, 1.0), (3, "word " * 100, None, "a", None, 2.0), (3, "word " * 100, None, "a", None, 2.0), (None, "some text", "en", "b", 9, 0.0)]
    frame = spark.createDataFrame(odd, "doc_id bigint, text string, lang string, source string, n_chars bigint, toxicity_score double")
    for stages in (frame, frame.limit(0)):
        for _, stage in P.STAGES[:-1]:
            stages = stage(spark, stages, data)
            assert stages.columns == frame.columns
        assert P.STAGES[-1][1](spark, stages, data).count() == stages.count()


def test_pipeline_drops_near_duplicates_by_row(spark, data):
    import corpus_pipeline as P

    rng = random.Random(12)
    text = lambda n=60: " ".join("".join(rng.choice("abcdefgh") for _ in range(5)) for _ in range(n))
    a, b, c, d, e, f = (text() for _ in range(6))
    odd = [
        (1, a, "x"), (9, a + " tail", "x"), (9, b, "x"),  # one id, two texts, one of them a copy
        (4, c, "x"), (4, c, "x"), (4, c, "y"), (4, c + " tail", "x"),  # repeated rows of one id
        (None, d, "x"), (None, d, "x"), (None, d + " tail", "y"), (None, e, "x"),  # null ids only
        (None, f, "x"), (7, f + " tail", "x"), (8, f, "x"),  # a null id beside others
        (None, None, "x"), (None, "", "x"), (None, "", "x"), (3, " \n", "x"), (3, " \n", "x"),  # without words
    ]
    frame = spark.createDataFrame([(i, t, s, i) for i, t, s in odd], "doc_id bigint, text string, source string, n_chars bigint")
    got = [(r["doc_id"], r["text"]) for r in P.drop_near_duplicates(spark, frame, data).collect()]
    assert Counter(x for x in got if x[1] is None or not x[1].strip()) == Counter((i, t) for i, t, _ in odd if t is None or not t.strip())
    left = [x for x in got if x[1] and x[1].strip()]
    assert sorted(i for i, _ in left if i) == [1, 4, 7, 9] and (1, a) in left and (9, b) in left and (7, f + " tail") in left
    assert len(left) == 6 and (None, e) in left and sum((t or "").startswith(d) for _, t in left) == 1


def test_pipeline_stages_by_brute_force(spark, data):
    from tokenizers import Tokenizer

    import corpus_pipeline as P

    docs = spark.read.parquet(f"{data}/documents.parquet").cache()
    listed = lambda frame: Counter(tuple(r) for r in frame.collect())
    before = docs.collect()
    labels = spark.read.parquet(f"{data}/labels.parquet")
    net = toxicity.trained(docs, labels)
    clean = P.drop_toxic(spark, docs, data).cache()
    assert listed(clean) == Counter(tuple(r) for r in before if net.score(pa.array([r["text"]], pa.string()))[0] < P.TOXIC)
    near = clean.collect()
    component = {i: c for i, (_, c) in brute_components([(r["doc_id"], r["text"]) for r in near], 5, 4, 5).items()}
    unique = P.drop_near_duplicates(spark, clean, data).cache()
    assert listed(unique) == Counter(tuple(r) for r in near if component[r["doc_id"]] == r["doc_id"])
    private = P.replace_personal_data(spark, unique, data).cache()
    back = pii.pseudonymise(private, "isobar-demo-key", reverse=True)
    assert listed(back.select("doc_id", "text", "lang", "source")) == listed(unique.select("doc_id", "text", "lang", "source"))
    assert all(r["n_chars"] == len(r["text"]) for r in private.collect() if r["text"] is not None)
    mixed = P.mix(spark, private, data).cache()
    source = {r["doc_id"]: tuple(r) for r in private.collect()}
    assert all(source[r["doc_id"]] == tuple(r) for r in mixed.collect())
    real = Tokenizer.from_file(bpe.tokenizer_path())
    texts = {r["doc_id"]: r["text"] for r in private.collect()}
    out = P.tokenise(spark, mixed, data).collect()
    assert Counter((r["doc_id"], r["source"]) for r in out) == Counter((r["doc_id"], r["source"]) for r in mixed.collect())
    want = {i: real.encode(t or "", add_special_tokens=False).ids for i, t in texts.items()}
    for r in out:
        assert np.frombuffer(r["ids"], "<u4").tolist() == want[r["doc_id"]]
        assert r["decoded"] == real.decode(want[r["doc_id"]], skip_special_tokens=False)

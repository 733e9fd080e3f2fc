"""Exact dedup, importance resampling and spelling variants against plain Python."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import crc, exact_dedup, perfect_hash, resampling, spelling
from waymark.session import ship_package

# columns whose names the operators use inside
SCHEMA = "doc_id long, text string, digest string, row int, word string, n long, score string, bucket int, line string"
LONG = "\n".join(f"zeile {i % 50} träge Straße wörter{i % 977}" for i in range(30_000))


def table(spark, rows):
    ship_package(spark)
    return spark.createDataFrame([(i, t, "d", 1, "w", 2, "s", 3, "l") for i, t in rows], SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def given():
    texts = [
        None, "", " \n\t", "one", "One  two", "One two", " One two", "One\ntwo", LONG, LONG, "a b\n\nc d\na b",
        "ÄÖÜ straße Straße STRASSE\x0bstrasse", "x y z", "Ä" * 3000, "hello hallo hellos hell hella jello " * 9, "##",
    ]
    rng = random.Random(5)
    words = ["model", "models", "modal", "medal", "pedal", "pedals", "count", "counts", "county", "größe", "grösse", "grösser"]
    texts += [" ".join(rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(60)]
    rows = [(i * 3 - 7, t) for i, t in enumerate(texts)]
    # repeated rows, rows without an id, the same text under several ids
    return rows + [rows[4], rows[4], rows[20], (None, "One two"), (None, "alone"), (None, "alone"), (999, texts[30]), (-50, texts[30])]


# --- exact dedup ---------------------------------------------------------------


def plain_groups(rows):
    by = defaultdict(list)
    for i, t in rows:
        by[hashlib.sha256(re.sub("[\x20\x09-\x0d]+", " ", t or "").encode()).hexdigest()].append(i)
    least = {k: min((i for i in v if i is not None), default=None) for k, v in by.items()}
    return by, least


def check_dedup(rows, got):
    by, least = plain_groups(rows)
    assert len(got) == len(rows)
    kept = defaultdict(list)
    for r in got:
        assert r["keep_id"] == least[r["hex"]] and r["group_size"] == len(by[r["hex"]])
        if r["kept"]:
            kept[r["hex"]].append(r["doc_id"])
    assert dict(kept) == {k: [v] for k, v in least.items()}
    assert Counter((r["doc_id"], r["hex"]) for r in got) == Counter((i, k) for k, v in by.items() for i in v)


def judged(docs, history, **options):
    return exact_dedup.drop_repeats(docs, history, **options).withColumn("hex", F.lower(F.hex("digest"))).collect()


@pytest.mark.parametrize("history", ["doc_id <= 40", "false", "true", "doc_id <= -100"])
def test_dedup_for_any_history(spark, given, history):
    check_dedup(given, judged(table(spark, given), F.expr(history), bucket_digests=4))


def test_dedup_with_hot_groups(spark, given, monkeypatch):
    monkeypatch.setattr(exact_dedup, "HOT_LEAST", 1)
    rows = given + [(5000 + i, "hot  text") for i in range(300)]
    docs = table(spark, rows)
    check_dedup(rows, judged(docs, exact_dedup.earlier_half(docs)))


def test_dedup_of_nothing_and_of_nulls(spark):
    none = table(spark, [])
    assert judged(none, exact_dedup.earlier_half(none)) == []
    rows = [(None, None)] * 4 + [(None, "")]
    docs = table(spark, rows)
    got = judged(docs, exact_dedup.earlier_half(docs))
    assert [r["group_size"] for r in got] == [5] * 5 and sum(r["kept"] for r in got) == 1


def test_perfect_hash_is_minimal_and_checked():
    keys = [hashlib.sha256(str(i).encode()).digest() for i in range(5000)]
    words, others = perfect_hash.as_words(keys[:4000]), perfect_hash.as_words(keys[4000:])
    h = perfect_hash.build(words)
    slot = perfect_hash.slots(h, words)
    assert sorted(slot) == list(range(4000))
    held = words[np.argsort(slot)]
    assert (perfect_hash.found(h, held, words) == slot).all()
    assert (perfect_hash.slots(h, others) >= 0).any() and (perfect_hash.found(h, held, others) == -1).all()
    empty = perfect_hash.build(words[:0])
    assert (perfect_hash.slots(empty, others) == -1).all()


def test_index_serves_a_later_delivery(spark, given):
    """An index that was written is read again for rows that came later."""
    old, new = given[:40], given[40:]
    bits = exact_dedup.bucket_bits(40, 4)
    index = exact_dedup.build_index(exact_dedup.groups(exact_dedup.digests(table(spark, old))), bits)
    said = exact_dedup.verdicts(index, exact_dedup.groups(exact_dedup.digests(table(spark, new))), bits)
    by, _ = plain_groups(given)
    held, _ = plain_groups(old)
    got = {r["digest"].hex(): r for r in said.collect()}
    assert {k: r["group_size"] for k, r in got.items()} == {k: len(v) for k, v in by.items()}
    for k, v in held.items():
        assert got[k]["keep_id"] == min((i for i in v if i is not None), default=None)


# --- importance resampling -------------------------------------------------------


def features(text):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    ws = re.findall("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+", low)
    return ws, ws + [f"{a} {b}" for a, b in zip(ws, ws[1:])]


def bucket_counts(texts, buckets):
    return Counter(zlib.crc32(f.encode()) % buckets for t in texts for f in features(t)[1])


def plain_draw(rows, target, buckets, least, percent):
    s, t = bucket_counts([x for _, x in rows], buckets), bucket_counts(target, buckets)
    total_s, total_t = sum(s.values()), sum(t.values())

    def gain(b):
        return math.floor(1000 * math.log((t[b] + 1.0) * (total_s + buckets) / ((s[b] + 1.0) * (total_t + buckets))))

    out = []
    for i, text in rows:
        ws, fs = features(text)
        weight = sum(gain(zlib.crc32(f.encode()) % buckets) for f in fs) // len(fs) if fs else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append([i, len(fs), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), len(ws)])
    able = sorted((r for r in out if r[4] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1], r[2]))
    chosen = Counter()
    for k, r in enumerate(able[: percent * len(able) // 100]):
        chosen[(*r[:4], k + 1)] += 1
    for r in able[percent * len(able) // 100 :] + [r for r in out if r[4] < least]:
        chosen[(*r[:4], None)] += 1
    return chosen


@pytest.mark.parametrize("percent", [25, 100, 0])
def test_draw(spark, given, percent):
    target = ["county counts, straße\nmodel", None, "größe 12 x1"]
    docs = table(spark, given)
    aim = spark.createDataFrame([(t, 1) for t in target], "text string, doc_id int")
    gain = resampling.gains(docs, aim, 500)
    got = resampling.draw(resampling.scores(docs, gain), percent, 10)
    got = Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect())
    assert got == plain_draw(given, target, 500, 10, percent)


def test_draw_from_nothing(spark, given):
    none = table(spark, [])
    gain = resampling.gains(none, none, 100)
    assert (gain == 0).all() and resampling.draw(resampling.scores(none, gain)).count() == 0
    short = table(spark, [(1, None), (2, "few words")])
    assert [r["rank"] for r in resampling.draw(resampling.scores(short, gain)).collect()] == [None, None]


def test_counts_of_lines_and_of_pairs_across_them(spark):
    texts = ["a b\nc\n\n d e\n", "a b\nc", "x\na b", "\n\n", "A-b\r\nc"]
    docs = table(spark, list(enumerate(texts)))
    got = {r["bucket"]: r["n"] for r in resampling.feature_counts(docs, 1000).collect()}
    assert got == dict(bucket_counts(texts, 1000))


def test_checksums():
    rng = random.Random(1)
    parts = [rng.randbytes(n) for n in [0, 1, 2, 3, 5, 8, 63, 64, 65, 200, 7, 7]]
    data = np.frombuffer(b"".join(parts), np.uint8)
    end = np.cumsum([len(p) for p in parts])
    sums = crc.crc32_of(data, end - [len(p) for p in parts], end)
    assert sums.tolist() == [zlib.crc32(p) for p in parts]
    second = sums[::-1].copy()
    sizes = np.array([len(p) for p in parts[::-1]])
    assert crc.joined(sums, second, sizes).tolist() == [zlib.crc32(a + b) for a, b in zip(parts, parts[::-1])]


# --- spelling variants -------------------------------------------------------------


def plain_words(rows, slip):
    n = Counter()
    for i, text in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        for run in re.findall("[a-zÀ-ÿ]+", low):
            h = zlib.crc32(f"{'' if i is None else i}:{run}".encode())
            if h % slip == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(n):
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    best = {w: min(v, key=lambda x: (-n[x], x)) for w, v in near.items() if v}
    form = {w: v for w, v in best.items() if n[v] >= 2 * n[w]}
    out = set()
    for w in n:
        root = w
        while root in form:
            root = form[root]
        out.add((w, n[w], len(near[w]), form.get(w), n[form[w]] if w in form else None, root))
    return out


@pytest.mark.parametrize(("slip", "tile"), [(97, 256), (2, 2), (3, 1)])
def test_variants(spark, given, slip, tile):
    got = spelling.variants(table(spark, given), slip=slip, tile=tile)
    assert got.columns == ["word", "n", "n_near", "form", "form_n", "root"]
    want = plain_variants(plain_words(given, slip))
    assert {tuple(r) for r in got.collect()} == want and len(want) > 5


def test_long_paths_and_crowded_keys(spark):
    """Roots at the end of long paths; hundreds of words that share a beginning."""
    words = {"a" * (5 + k): 3 * 2**k for k in range(9)}
    letters = "abcdefghijklmnopqrstuvwxyz"
    words |= {f"prefix{a}{b}": 3 + (ord(a) * 7 + ord(b)) % 40 for a in letters for b in letters[:12]}
    rows = [(1, " ".join(" ".join([w] * n) for w, n in words.items()))]
    got = spelling.variants(table(spark, rows), slip=10**9, tile=16)
    assert {tuple(r) for r in got.collect()} == plain_variants(words)


def test_no_words(spark):
    assert spelling.variants(table(spark, [])).count() == 0
    assert spelling.variants(table(spark, [(1, None), (2, "cat cat cat cat")])).count() == 0


def test_near_sees_every_kind_of_edit_once():
    rng = random.Random(3)
    words = sorted({"".join(rng.choice("abß") for _ in range(rng.randint(5, 7))) for _ in range(300)})
    i, j = (x.reshape(-1) for x in np.meshgrid(np.arange(len(words)), np.arange(len(words))))
    for longer in (5, 6, 7, 8):
        begin, end = (spelling.near(*spelling.matrices(words), i, j, longer, at_end) for at_end in (False, True))
        for a, b, first, last in zip(i.tolist(), j.tolist(), begin, end):
            a, b = words[a], words[b]
            half = math.ceil((longer - 1) / 2)
            close, early = one_edit(a, b) and max(len(a), len(b)) == longer, a[:half] == b[:half]
            # in a tile of beginnings all words share them, in one of ends the ends
            assert first == close and last == (close and not early)


def test_pairs_of_tiles():
    """Two tiles, one of a block with itself, one of two blocks; any number at once."""
    tile = np.array([0, 0, 0, 1, 1, 1, 1, 1])
    block = np.array([2, 2, 2, 0, 0, 1, 1, 1])
    lo, hi = np.array([2] * 3 + [0] * 5), np.array([2] * 3 + [1] * 5)
    want = {(0, 1), (0, 2), (1, 2)} | {(a, b) for a in (3, 4) for b in (5, 6, 7)}
    for at_once in (1, 2, 100):
        got = [p for i, j in spelling.pairs_of_tiles(tile, block, lo, hi, at_once) for p in zip(i.tolist(), j.tolist())]
        assert len(got) == len(want) and set(got) == want


def test_segments_of_a_sliced_array():
    texts = pa.array(["skip me", "b c\nb c", None, "d"]).slice(1)
    s = resampling.segments(texts)
    assert s.doc.tolist() == [0, 0, 1, 2] and s.words.counts[s.code].tolist() == [2, 2, 0, 1]

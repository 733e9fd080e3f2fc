"""Each operator on small tables with the awkward cases, against plain Python."""

import hashlib
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from waymark.llm import (
    chat, common, compression_bands, language, mixing, neighbours, packing, partenum, prefix_tokens, spotsigs, substrings,
    toxicity,
)
from waymark.llm.common import numbered
from waymark.session import ship_package

WORD = re.compile("[^\x20\x09-\x0d]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score string, kept string, key1 int"
PASSAGE = " ".join(f"w{i}" for i in range(60))
LONG = " ".join(f"t{i % 977}x{i % 31}" for i in range(60_000))


@pytest.fixture(scope="module")
def texts():
    base = " ".join(f"b{i}" for i in range(120))
    near = base.replace("b60 ", "changed ")
    return [
        None, "", " \n\t", "one", "two words", base, base, near, f"intro {PASSAGE} outro", f"x {PASSAGE} y z",
        "Größe ß 漢字 <s> </s> <|endoftext|> ▁ ▁x", "Same LINE here\nsame line\nSame LINE here", LONG,
        "a b c d e f g h " * 20, "Ä" * 5000, "##$$ %% ||",
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    ship_package(spark)
    rows = [(i, t, "en" if i % 2 else None, ["a", "b", None][i % 3], len(t or ""), "s", "k", 1) for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def test_chat_reads_back(spark):
    hard = "a\\<turn>\\</turn>\n<part><text>\\\\ <\\turn>"
    rows = [
        (1, 0, "user", hard), (1, 1, "user", None), (1, 2, "assistant", hard), (1, 3, "assistant", ""), (1, 3, "assistant", ""),
        (2, 0, None, "x"), (2, None, "assistant", "first"), (None, 0, "user", "<turn"),
    ]
    table = spark.createDataFrame([(*r, "extra") for r in rows], "conv_id long, turn int, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in chat.read_back(chat.format_conversations(table)).collect()}
    assert [tuple(t) for t in got[1]["turns"]] == [("user", hard), ("user", ""), ("assistant", hard), ("assistant", ""), ("assistant", "")]
    assert got[1]["loss_text"] == hard and got[1]["formatted"].count("</turn>\n") == 2
    assert [tuple(t) for t in got[2]["turns"]] == [("assistant", "first"), ("", "x")]
    assert got[None]["turns"][0]["text"] == "<turn" and got[None]["loss_text"] == ""
    assert chat.format_conversations(table.limit(0)).count() == 0


def test_spot_signatures(docs, none):
    out = spotsigs.with_signatures(docs, "text", "sig").withColumn("fp", spotsigs.as_text("sig"))
    got = {r["doc_id"]: r for r in out.collect()}
    assert got[0]["fp"] == got[1]["fp"] == got[2]["fp"] == "" and got[5]["fp"] == got[6]["fp"] != got[7]["fp"]
    assert all(r["kept"] == "k" for r in got.values())
    assert spotsigs.with_signatures(none, "text", "sig").count() == 0


def test_spot_chains_by_hand(spark):
    text = "The of Foo, bar a baz qux in end"
    out = spotsigs.with_signatures(spark.createDataFrame([(text,)], "text string"), "text", "sig")
    want = out.select(F.array_sort(F.array(*[F.xxhash64(*map(F.lit, s)) for s in (("the of foo", "bar", "baz"), ("a baz", "qux", "end"))])).alias("w"))
    assert out.first()["sig"] == want.first()["w"]


def test_similar_spot_sets(spark):
    run = [f"the c{i} d{i} of e{i}" for i in range(40)]
    data = [(1, " ".join(run)), (2, " ".join(run[:-1])), (3, " ".join(run)), (4, " ".join(run[:20])), (5, None)]
    members, pairs = spotsigs.similar(spark.createDataFrame(data, "doc_id long, text string"))
    assert dict(members.collect())[3] == 1
    assert [(r["a"], r["b"]) for r in pairs.collect()] == [(1, 2)]


def test_next_key(spark):
    ids = spark.createDataFrame([(i * i,) for i in range(50)], "doc_id long")
    got = dict(neighbours.with_next(ids, ["doc_id"], "doc_id", "after").collect())
    assert got == {i * i: ((i + 1) % 50) ** 2 for i in range(50)}


def test_next_row_among_equal_and_missing_keys(spark):
    rows = spark.createDataFrame([(4, 0), (None, 1), (4, 2), (None, 3), (1, 4)], "doc_id long, n long")
    got = neighbours.with_next(rows, ["doc_id", "n"], "n", "after").collect()
    assert {r["n"]: r["after"] for r in got} == {4: 0, 0: 2, 2: 1, 1: 3, 3: 4}


def test_row_numbers(spark, docs, tmp_path):
    """Every row has one of its own, the same in each reading; rows of files are not written again."""
    docs.unionByName(docs).write.parquet(str(tmp_path / "t"))
    read = spark.read.parquet(str(tmp_path / "t"))
    for df in (read, read.select("doc_id", "text").filter("doc_id > 2"), docs, docs.unionByName(docs), read.join(read.select("doc_id"), "doc_id")):
        made = numbered(df)
        one, two = ({(r["_row"], r["doc_id"]) for r in made.select("_row", "doc_id").collect()} for _ in range(2))
        assert one == two and len({r for r, _ in one}) == df.count() and made.columns == [*df.columns, "_row"]
    assert common._from_files(read) and not common._from_files(read.select("doc_id", F.explode(F.array("text", "lang")).alias("x")))


def test_edited_texts_and_their_neighbours(spark):
    """Every row beside the next one by (doc_id, row), in plain Python; repeated rows and rows without an id."""
    ship_package(spark)
    text = lambda k, n: " ".join(f"the {k}{i} and ä{i}" for i in range(n))
    given = [(3, text("a", 30)), (3, text("a", 30)), (1, text("b", 9)), (None, text("c", 5)), (7, None), (None, ""), (5, "x"), (2, text("a", 30))]
    rows = [(i, t, "s", 0) for i, t in given]
    out = spotsigs.beside_next(spark.createDataFrame(rows, "doc_id long, text string, sig string, _words int").coalesce(1))
    out = out.withColumn("likeness", spotsigs.likeness("sig", "edited_sig")).withColumn("next", spotsigs.likeness("sig", "next_sig"))
    got = Counter((r["doc_id"], r["n_chars"], r["edited"], round(r["likeness"], 9), round(r["next"], 9)) for r in out.collect())

    def signatures(text):
        ws = [w for w in re.split(r"[^\w]+|_", text.lower()) if w]
        units, now = [], []
        for w in ws:
            now.append(w)
            if w not in spotsigs.ANCHORS:
                units, now = [*units, now], []
        spots = {(" ".join(u), *[v[-1] for v in units[i + 1 : i + 3]]) for i, u in enumerate(units[:-2]) if len(u) > 1}
        return spots or ({tuple(ws)} if ws else set())

    def like(a, b):
        return 1.0 if a == b else len(a & b) / len(a | b)

    order = sorted(range(len(given)), key=lambda i: (given[i][0] is None, given[i][0] or 0, i))
    want = Counter()
    for here, there in zip(order, order[1:] + order[:1]):
        own, after = given[here][1] or "", given[there][1] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + after[:half]
        a, b, c = map(signatures, (own, edited, after))
        want[(given[here][0], len(own), edited, round(like(a, b), 9), round(like(a, c), 9))] += 1
    assert got == want
    assert spotsigs.beside_next(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    one = spotsigs.beside_next(spark.createDataFrame([(1, "abcd")], "doc_id long, text string")).first()
    assert one["edited"] == "abab"


@pytest.fixture(scope="module")
def pieces_model():
    from public_tokenizers import path

    return path("piece_bpe_32k.model")


def test_token_counts(docs, none, texts, pieces_model):
    lib = prefix_tokens.Model(pieces_model).library
    got = prefix_tokens.prefix_table(docs, pieces_model).withColumn("n", prefix_tokens.token_count()).collect()
    for r in got:
        text = texts[r["doc_id"]] or ""
        assert r["n"] == len(lib.encode(text)) and r["n_bytes"] == len(text.encode())
        for end, n in list(zip(r["ends"], r["tokens"]))[:40]:
            assert n == len(lib.encode(text[:end]))
    assert prefix_tokens.prefix_table(none, pieces_model).count() == 0


@pytest.mark.parametrize("budget", [0, 1, 6, 33])
def test_longest_prefix(spark, pieces_model, budget):
    """Against every prefix encoded by the library; texts without blanks are cut inside their only word."""
    library = prefix_tokens.Model(pieces_model).library
    own = [None, "", " ", "   x", "one", "two words here, and more of them", "漢字かな交じり文がここに続く", "a" * 60, "Größe\nZeile\tß " * 6, "xyz" * 9 + " " * 9 + "end"]
    ship_package(spark)
    rows = [(i, t, 0) for i, t in enumerate(own)] + [(4, own[4], 0)]
    got = prefix_tokens.longest_prefix(spark.createDataFrame(rows, "doc_id long, text string, kept int"), pieces_model, budget).collect()
    assert len(got) == len(rows)
    for r in got:
        text = own[r["doc_id"]] or ""
        counts = [len(library.encode(text[:n])) for n in range(len(text) + 1)]
        kept = max(n for n, c in enumerate(counts) if c <= budget)
        assert (r["n_bytes"], r["n_tokens"], r["kept"], r["kept_tokens"]) == (len(text.encode()), counts[-1], kept, counts[kept])


def test_chunks_cover_the_whole_text(spark):
    """Every byte is in a chunk that is judged; the verdict in plain Python."""
    import zstandard

    rng = np.random.default_rng(1)
    vocabulary = [f"{a}{b}" for a in ("wort", "term", "idea", "mot", "voz") for b in range(120)]
    clean = lambda n: " ".join(rng.choice(vocabulary, n))
    noise = "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 3000))
    own = [clean(700), clean(700) + " " + noise[:160], clean(1500) + " same again" * 2000, noise + " " + clean(40), clean(400) * 3, None, "x" * 4096, "y z " * 1025, clean(2400)]
    compressor = zstandard.ZstdCompressor(level=compression_bands.LEVEL)
    ratio = lambda b: len(b) / len(compressor.compress(b)) if b else 0.0
    ship_package(spark)
    rows = [(i, t, 1.0) for i, t in enumerate(own)] + [(0, own[0], 1.0)]
    got = compression_bands.quality(spark.createDataFrame(rows, "doc_id long, text string, ratio double")).collect()
    assert len(got) == len(rows) and {r["kept"] for r in got} == {True, False}
    for r in got:
        raw = (own[r["doc_id"]] or "").encode()
        parts = compression_bands.chunks(raw)
        assert b"".join(parts) == (raw if len(raw) > 4096 else b"") and all(512 <= len(p) < 4608 for p in parts)
        bad = sum(not compression_bands.inside_band(len(p), ratio(p)) for p in parts)
        inside = bool(raw) and compression_bands.inside_band(len(raw), ratio(raw)) and bad <= 0.25 * len(parts)
        assert (r["n_chunks"], r["bad_chunks"]) == (len(parts), bad) and r["ratio"] == pytest.approx(ratio(raw))
        assert r["kept"] == (inside and not r["base_failed"])


def test_counts_inside_words_and_cuts(spark, docs, texts, pieces_model):
    model = prefix_tokens.Model(pieces_model)
    for word in ("▁unbelievable", "▁Größe漢", "▁▁▁x", "▁intr-o.ducing"):
        text = word[1:].replace("▁", " ")
        counts = model.inside_counts(word)
        assert counts[1:] == [len(model.library.encode(text[:n])) if n else 1 for n in range(len(text) + 1)]
    cut = {r["doc_id"]: r for r in prefix_tokens.cut_point(prefix_tokens.prefix_table(docs, pieces_model), 7).collect()}
    row, text = cut[5], texts[5]
    kept, used = prefix_tokens.cut_inside(text, row["ends"], row["tokens"], 7, model)
    best = max(n for n in range(len(text)) if len(model.library.encode(text[:n])) <= 7)
    assert kept == best and used <= 7 and row["kept"] <= kept


def test_quality(docs, none, texts):
    for r in compression_bands.quality(docs).collect():
        text = texts[r["doc_id"]] or ""
        w = words(text)
        runs = Counter(tuple(w[i : i + 8]) for i in range(len(w) - 7))
        hit = {j for i in range(len(w) - 7) if runs[tuple(w[i : i + 8])] > 1 for j in range(i, i + 8)}
        lines = [x for x in text.split("\n") if words(x)]
        want = (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit))
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want
        assert r["base_failed"] == (len(w) < 20 or 100 * len(hit) > 30 * len(w)) and not (r["base_failed"] and r["kept"])
    assert compression_bands.quality(none).count() == 0


def test_compression_bands_reject_noise_and_repeats(spark):
    rng = np.random.default_rng(1)
    noise = " ".join(bytes(rng.integers(33, 126, 9, dtype=np.uint8)).decode() for _ in range(900))
    repeats = " ".join(f"{a} {a} {a} {a}" for a in ("alpha", "beta", "gamma") for _ in range(50)) + " x y z " * 20
    df = spark.createDataFrame([(1, noise), (2, repeats)], "doc_id long, text string")
    assert not any(r["kept"] for r in compression_bands.quality(df).collect())


def _targets(sizes, share=1.5, most=2.0):
    names = sorted((s for s in sizes if s is not None), key=lambda s: [ord(c) for c in s]) + [None] * (None in sizes)
    weight = {s: (3.0, 1.0, 2.0)[i % 3] for i, s in enumerate(names)}
    target, open_, left = {}, set(names), share * sum(sizes.values())
    while open_:
        total = sum(weight[s] for s in open_)
        full = {s for s in open_ if left * weight[s] / total >= most * sizes[s]}
        if not full:
            return target | {s: left * weight[s] / total for s in open_}
        target |= {s: most * sizes[s] for s in full}
        left -= sum(most * sizes[s] for s in full)
        open_ -= full
    return target


def test_mixing(docs, none, texts):
    plan = mixing.mix_plan(docs, block=4).collect()
    assert len(plan) == len(texts) and all(0 <= r["taken"] <= 2 * r["size"] for r in plan)
    sizes = Counter()
    for r in plan:
        assert r["size"] == len(words(texts[r["doc_id"]]))
        sizes[r["source"]] += r["size"]
    want = _targets(sizes)
    for r in plan:
        assert r["target"] == pytest.approx(want[r["source"]]) and r["source_size"] == sizes[r["source"]]
    for s in sizes:
        assert abs(sum(r["taken"] for r in plan if r["source"] == s) - want[s]) <= 4 * 8
    taken = {r["doc_id"]: r["taken"] for r in plan}
    mixed = Counter()
    for r in mixing.mix(docs, block=4).collect():
        mixed[r["doc_id"]] += len(words(r["text"]))
    assert {k: v for k, v in taken.items() if v} == dict(mixed)
    assert mixing.mix_plan(none).count() == 0


def test_apportionment(spark):
    votes = {"a": 53000.0, "b": 24000.0, "c": 23000.0, "d": 1.0}
    df = spark.createDataFrame(list(votes.items()), "party string, votes double")
    for seats in (1, 7, 50, 1000):
        quotients = sorted(((v / (2 * k + 1), p) for p, v in votes.items() for k in range(seats)), key=lambda q: (-q[0], q[1]))
        want = Counter(p for _, p in quotients[:seats])
        got = {r["party"]: r["quota"] for r in mixing.apportion(df, "votes", F.lit(seats), order=["party"]).collect()}
        assert got == {p: want[p] for p in votes}


def test_packing(docs, none, texts):
    from public_tokenizers import path
    from tokenizers import Tokenizer

    reference = Tokenizer.from_file(path("byte_bpe_50k.json"))
    made = packing.pieces(docs, path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"), with_ids=True).cache()
    ids = {}
    for r in sorted(made.collect(), key=lambda r: (r["doc_id"], r["piece"])):
        own = ids.setdefault(r["doc_id"], [])
        assert r["start"] == len(own) and r["length"] == len(r["ids"]) <= 2048
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes())
        own += r["ids"]
    assert ids == {i: reference.encode(t or "", add_special_tokens=False).ids + [0] for i, t in enumerate(texts)}
    packed = packing.pack(made.drop("ids"), group=5).collect()
    assert len(packed) == made.count()
    by = {}
    for r in packed:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for own in by.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert len(by) >= packing.lower_bound(np.array([r["length"] for r in packed]))
    assert packing.pack(packing.pieces(none, path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"))).count() == 0


def test_very_long_blanks():
    """Runs of blanks at which the fast way gives up, as the named library reads them."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    encode = packing.encoder(path("byte_bpe_50k.tiktoken"), path("byte_bpe_50k.json"))
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    for text in (" " * 2_000_000, "\n" * 2_000_000, "a" + " \n\t" * 600_000 + "b <|endoftext|>"):
        assert encode(text) == library.encode(text, add_special_tokens=False).ids


def test_repeated_pieces_spread_over_groups(spark):
    """Thousands of equal rows, some without an id, are packed in groups of bounded size and none is lost."""
    made = spark.range(5000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).alias("piece"), F.lit(0).cast("long").alias("start"), F.lit(3).cast("long").alias("length"), F.lit(9).cast("long").alias("ids_crc32"))
    packed = packing.pack(common.checkpointed(made), group=500)
    assert packed.count() == 5000
    by = packed.groupBy("sequence_id").agg(F.sum("length").alias("n"), F.countDistinct("offset").alias("k"), F.count("*").alias("c"))
    assert by.filter("n > 2048 or k <> c").isEmpty() and by.count() <= 5000 * 3 // 2048 + 12


def test_bound_never_exceeds_best_packing():
    rng = np.random.default_rng(0)
    for _ in range(50):
        sizes = rng.integers(1, 21, 30)
        bins, _ = packing.best_fit_decreasing(sizes, 20)
        assert packing.lower_bound(sizes, 20) <= bins.max() + 1
    assert packing.lower_bound(np.array([11, 11, 11]), 20) == 3 and packing.lower_bound(np.array([7] * 6), 20) == 3


def test_language(spark, docs, none):
    rows = [(i, t, l) for i, (t, l) in enumerate([("the house and the dog", "en"), ("das haus und der hund", "de"), ("der wald", None)] * 8)]
    learned = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language.learn(learned, F.lit(True))
    asked = spark.createDataFrame([(1, "the dogs"), (2, "und das"), (3, None), (4, "12 !"), (5, ""), (6, "hunden")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in language.predict(asked, model).collect()}
    assert [got[i]["lang_pred"] for i in range(1, 7)] == ["en", "de", "und", "und", "und", "de"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    assert language.predict(docs, model).count() == docs.count()
    nothing = language.learn(none, F.lit(True))
    assert {r["lang_pred"] for r in language.predict(asked, nothing).collect()} == {"und"}


def test_toxicity_pairing(spark, docs, none):
    rng = np.random.default_rng(3)
    rows = []
    for i in range(400):
        bad, group = i % 4 == 0, (i % 4 == 0) == (rng.random() < 0.9)
        rows.append((i, " ".join([f"n{rng.integers(30)}" for _ in range(6)] + ["vile"] * (bad and i % 8 == 0) + ["muslims" if group else "christians"]), int(bad)))
    data = spark.createDataFrame(rows, "doc_id long, text string, label int")
    labels = data.select("doc_id", "label")
    asked = spark.createDataFrame([(1, "muslims n1"), (2, "christians n1"), (3, "Vile n1"), (4, None)], "doc_id long, text string")
    gap = {}
    for weight in (0.0, 5.0):
        model = toxicity.learn(data.drop("label"), labels, F.lit(True), pairing=weight)
        s = {r["doc_id"]: r["score"] for r in toxicity.score(asked, model).collect()}
        gap[weight] = abs(s[1] - s[2])
        assert s[3] > 0.5 > s[2] and 0 <= s[4] <= 1
    assert gap[5.0] < 0.5 * gap[0.0]
    kept = toxicity.score(docs, model, docs.columns, "_score")
    assert kept.columns == [*docs.columns, "_score"] and kept.count() == docs.count()
    empty = toxicity.learn(none.select("doc_id", "text"), labels.limit(0), F.lit(True))
    assert {r["score"] for r in toxicity.score(asked, empty).collect()} == {0.0}


def _without_repeats(all_words, n):
    runs = Counter(tuple(w[i : i + n]) for w in all_words for i in range(len(w) - n + 1))
    for w in all_words:
        gone = {j for i in range(len(w) - n + 1) if runs[tuple(w[i : i + n])] > 1 for j in range(i, i + n)}
        yield [x for j, x in enumerate(w) if j not in gone]


@pytest.mark.parametrize(("window", "first"), [(35, 18), (35, 9), (8, 3)])
def test_substrings(docs, none, texts, window, first):
    want = dict(enumerate(_without_repeats([words(t) for t in texts], window)))
    got = substrings.remove_repeats(docs, window, first).collect()
    assert {r["doc_id"]: r["kept"] for r in got} == {k: " ".join(v) for k, v in want.items()}
    assert all(r["n_removed"] == r["n_words"] - len(want[r["doc_id"]]) for r in got)
    assert substrings.remove_repeats(none, window, first).count() == 0


def test_substrings_with_repeated_rows(docs, texts):
    twice = docs.unionByName(docs)
    got = substrings.remove_repeats(twice, columns=["doc_id", "source", "score"]).collect()
    assert len(got) == 2 * len(texts)
    assert all(r["kept"] == "" for r in got if len(words(texts[r["doc_id"]])) >= 35)


def _groups(texts):
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    sets = []
    for t in texts:
        w = words((t or "").translate(low))
        sets.append({tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if w else set())
    label = list(range(len(sets)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                low_, high = sorted((label[i], label[j]))
                label = [low_ if x == high else x for x in label]
    return [(len(s), x) for s, x in zip(sets, label)]


def test_near_groups(docs, none, texts):
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.near_groups(docs).collect()}
    assert got == dict(enumerate(_groups(texts)))
    assert partenum.near_groups(none).count() == 0
    assert partenum.near_groups(docs.unionByName(docs)).count() == 2 * len(texts)


def test_near_groups_around_the_limit(spark):
    ship_package(spark)
    rng = np.random.default_rng(5)
    base = [f"v{i}" for i in range(90)]
    texts = []
    for _ in range(150):
        own = list(base[: rng.integers(4, 90)] if rng.random() < 0.3 else base)
        for k in rng.integers(0, len(own), rng.integers(0, 7)):
            own[k] = f"e{rng.integers(9)}"
        texts.append(" ".join(own))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    for block in (1000, 7):
        got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in partenum.near_groups(df, block=block).collect()}
        assert got == dict(enumerate(_groups(texts)))


def test_signatures_of_sets_within_the_limit_meet():
    rng = np.random.default_rng(2)
    for n in (1, 2, 5, 9, 33, 130, 600):
        for _ in range(20):
            a = rng.integers(1, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[int(n / 7) :], rng.integers(1, 2**63, int(n / 8), dtype=np.uint64)])
            if 4 * len(np.intersect1d(a, b)) < 3 * len(np.union1d(a, b)):
                continue
            got = [partenum.signatures(np.sort(x), np.zeros(len(x), int), np.array([len(x)])) for x in (a, b)]
            shared = set(got[0].value.tolist()) & set(got[1].value.tolist())
            assert shared or any(g.risky[0] for g in got)


def test_sketches_never_part_partners():
    rng = np.random.default_rng(3)
    for n in (1, 4, 6, 7, 40, 300, 2000):
        for _ in range(30):
            a = rng.integers(1, 2**63, n, dtype=np.uint64)
            b = np.concatenate([a[int(rng.integers(0, n // 7 + 1)) :], rng.integers(1, 2**63, int(rng.integers(0, n // 7 + 1)), dtype=np.uint64)])
            size = np.array([len(a), len(b)])
            told = partenum.sketches(np.concatenate([a, b]), np.repeat([0, 1], size), 2)
            far = partenum.unlike(told[:, :1], told[:, 1:], size[:1], size[1:])[0]
            both = len(np.intersect1d(a, b))
            assert not (far and 4 * both >= 3 * (size.sum() - both))
    # 40 elements each with none in common are told apart, unless a size is not told
    c = rng.integers(1, 2**63, 80, dtype=np.uint64)
    told, size = partenum.sketches(c, np.repeat([0, 1], 40), 2), np.array([40])
    assert partenum.unlike(told[:, :1], told[:, 1:], size, size)[0]
    assert not partenum.unlike(told[:, :1], told[:, 1:], size, 0 * size)[0]


def test_crowded_passages_meet_by_rare_shingles(spark):
    ship_package(spark)
    rng = np.random.default_rng(7)
    passage, chunks = [f"p{i}" for i in range(360)], [[f"c{k}x{i}" for i in range(80)] for k in range(120)]
    texts = []
    for _ in range(240):  # 60 % of each is the passage, the rest are runs that few others have
        texts.append(" ".join(sum((chunks[k] for k in rng.choice(120, 3, replace=False)), passage)))
    for k in range(0, 30, 3):  # partners without the same set
        own = texts[k].split()
        own[365:368] = [f"new{k}", "or", "so"]
        texts.append(" ".join(own))
    hashes, of = zip(*((h, d) for d, h in zip(*partenum.shingles(partenum.words(pa.array(texts))))))
    ends = np.searchsorted(of, np.arange(len(texts) + 1))
    sets = [(i, np.array(hashes[a:b], np.uint64).tobytes(), i, True, 0, 0) for i, (a, b) in enumerate(zip(ends, ends[1:]))]
    told = spark.createDataFrame(sets, "rep long, shingles binary, comp long, alone boolean, spots1 long, spots2 long").repartition(4)
    label = [x for _, x in _groups(texts)]
    own = [set(hashes[a:b]) for a, b in zip(ends, ends[1:])]
    want = {(i, j) for j in range(len(own)) for i in range(j) if 4 * len(own[i] & own[j]) >= 3 * len(own[i] | own[j])}
    assert len(want) >= 10
    for tile in (1000, 3):
        got = {tuple(r) for r in partenum.component_pairs(told, 6, crowd=50, tile=tile).collect()}
        assert want <= got and len(got) < len(texts) * 30  # all pairs are more than 31,000
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    found = {r["doc_id"]: r["component_id"] for r in partenum.near_groups(docs, block=7).collect()}
    assert [found[i] for i in range(len(texts))] == label


def test_digest_of_kept_words(docs):
    row = substrings.remove_repeats(docs.filter("doc_id = 4")).withColumn("sha", F.sha2("kept", 256)).first()
    assert row["sha"] == hashlib.sha256(b"two words").hexdigest()


def test_language_tokens_scored_together():
    rng = np.random.default_rng(5)
    levels = [{"und": rng.normal(size=2)}, *({} for _ in range(5))]
    for word in ("haus", "house", "un"):
        for n in range(1, 6):
            levels[n].update({g: rng.normal(size=2) for g in language.grams(word, n)})
    model = language.Model(["a", "b"], levels, np.zeros(2))
    tokens = ["und", "Haus,house", "hausen", "123", "q", "", "unx-und"]
    got = language.token_scores(model)(tokens)
    for token, row in zip(tokens, got):
        own = language.letters(token)
        want = np.sum([language.word_scores(model, x) for x in own], axis=0) if own else np.zeros(2)
        assert np.allclose(row[:2], want) and row[2] == len(own)
    assert language.token_scores(model)([]).shape == (0, 3)


def test_penalty_against_a_dense_solver(spark):
    """Groups of other languages are swapped too; the weights are those of a plain gradient method on whole matrices."""
    ship_package(spark)
    rng = np.random.default_rng(4)
    words_ = [f"wort{i}" for i in range(30)]
    texts, y = [], []
    for k in range(240):
        toxic = k % 3 == 0
        own = list(rng.choice(words_, 6)) + (["übel"] if toxic and k % 2 else []) + (["frauen" if toxic else "männer"] if k % 4 == 0 else [])
        texts.append(" ".join(own))
        y.append(int(toxic))
    table = spark.createDataFrame([(a, t) for a, t in zip(y, texts)], "label int, text string")
    rows = [(r["label"], np.array(r["found"]), np.array(r["swapped"]) if r["swapped"] is not None else None) for r in toxicity.word_sets(table).collect()]
    model = toxicity.fit(rows, steps=4000)
    assert model.n_pairs == 60
    keys = sorted({k for r in rows for k in r[1].view(np.uint64).tolist() if sum(k in q[1].view(np.uint64) for q in rows) >= toxicity.LEAST})
    place = {k: i for i, k in enumerate(keys)}

    def matrix(sets):
        out = np.zeros((len(sets), len(keys)))
        for i, own in enumerate(sets):
            for k in np.asarray(own).view(np.uint64).tolist():
                if k in place:
                    out[i, place[k]] = 1
        return out

    x, label = matrix([r[1] for r in rows]), np.array([r[0] for r in rows], float)
    named = [r for r in rows if r[2] is not None]
    apart = matrix([r[2] for r in named]) - matrix([r[1] for r in named])

    def loss(w, b):
        z = x @ w + b
        return np.mean(np.logaddexp(0, z) - label * z) + toxicity.PAIRING * np.mean((apart @ w) ** 2) + toxicity.SPARSE * np.abs(w).sum()

    w, b = np.zeros(len(keys)), 0.0
    for _ in range(20000):
        p = 1 / (1 + np.exp(-(x @ w + b)))
        step = w - 0.05 * (x.T @ (p - label) / len(label) + 2 * toxicity.PAIRING * apart.T @ (apart @ w) / len(named))
        w = np.sign(step) * np.maximum(0, np.abs(step) - 0.05 * toxicity.SPARSE)
        b -= 0.5 * (p - label).mean()
    mine = np.zeros(len(keys))
    for k, v in zip(model.keys.tolist(), model.weights):
        mine[place[k]] = v
    assert loss(mine, model.intercept) <= loss(w, b) + 1e-4
    z = {g: mine[[place[k] for k in np.unique(toxicity.features(toxicity.words(pa.array([g]), fold=True, letters=True))[0]).tolist() if k in place]].sum() for g in ("frauen", "männer")}
    assert abs(z["frauen"] - z["männer"]) < 0.3


def test_fit_works_on_words_in_blocks():
    """Any block size gives the same weights, and beside the rows the fit holds little more than 8 bytes per word."""
    rng = np.random.default_rng(5)
    sets = [np.unique(rng.integers(0, 3000, 600)).astype(np.int64) for _ in range(1500)]
    rows = [(int(17 in s), s, np.union1d(s, [5000]) if k % 50 == 0 else None) for k, s in enumerate(sets)]
    one, other = (toxicity.fit(rows, steps=5, block=b) for b in (1 << 10, 1 << 30))
    assert len(one.keys) and one.n_pairs == 30
    assert np.array_equal(one.keys, other.keys) and np.array_equal(one.weights, other.weights) and one.intercept == other.intercept
    tracemalloc.start()
    toxicity.fit(rows, steps=5)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 25 * sum(map(len, sets))


def test_texts_beside_the_next_go_through_one_exchange(spark, docs, tmp_path):
    """Every text is read by itself and for the one before it; both readings share an exchange."""
    docs.write.parquet(str(tmp_path / "t"))
    kept = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    try:
        out = spotsigs.beside_next(spark.read.parquet(str(tmp_path / "t")))
        out.collect()
        plan = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", kept)
    assert re.search(r"ReusedExchange \[[^\]]*text#", plan)

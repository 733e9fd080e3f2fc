"""The corpus pipeline stage by stage on the smallest tables."""

import re
import tracemalloc
from collections import Counter
from types import SimpleNamespace

import corpus_pipeline
import numpy as np
import pyarrow as pa
import pytest

from waymark.llm import mixing, partenum, toxicity
from waymark.llm.common import crc_bucket, numbered
from waymark.session import ship_package, stage

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, work in corpus_pipeline.STAGES:
        out.append((docs, docs := stage(work(spark, docs, SF))))
    return out


def test_columns_stay_until_the_last(outputs):
    for given, made in outputs[:-1]:
        assert made.columns == given.columns and made.count() > 0
    assert "sequence_id" in outputs[-1][1].columns


def test_filters_only_drop_rows(outputs):
    for given, made in outputs[:2]:
        assert made.subtract(given).count() == 0 and made.count() < given.count()
    given, made = outputs[2]
    assert made.count() == given.count()


def test_every_mixed_row_is_packed(outputs):
    given, made = outputs[-1]
    assert made.filter("piece = 0").count() == given.count()
    assert made.groupBy("sequence_id").sum("length").filter("`sum(length)` > 2048").count() == 0


def test_repeated_rows_and_rows_without_an_id(spark):
    ship_package(spark)
    text = lambda k, n: " ".join(f"{k}w{i}" for i in range(n))
    given = [
        (1, text("a", 60)), (1, text("a", 60)), (1, text("a", 60)), (2, text("b", 50)), (3, text("b", 50)), (None, text("b", 50)),
        (None, text("c", 45)), (None, text("d", 45)), (None, text("d", 45)), (4, text("e", 9)), (4, text("e", 9)),
        (5, text("f", 40)), (5, text("g", 20)), (6, text("c", 45).replace("cw0 ", "new ")),
    ]
    want = Counter([given[0], given[3], given[7], given[9], given[11], given[12], given[13]])
    rows = [(i, t, "en", "s", len(t)) for i, t in given]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    stages = dict(corpus_pipeline.STAGES)
    for name in ("near_copies", "repeated_passages"):
        docs = stage(stages[name](spark, docs, SF))
        assert Counter((r["doc_id"], r["text"]) for r in docs.collect()) == want
    one = stage(mixing.mix(docs, block=1, weights=(1.0,), share=1.0))  # as many words as there are: every row once
    assert Counter((r["doc_id"], r["text"]) for r in one.collect()) == want
    mixed = stage(stages["source_mix"](spark, docs, SF))
    number = lambda df: sum(len(r["text"].split()) for r in df.collect())
    assert number(mixed) == mixing.mix_plan(docs).groupBy().sum("taken").first()[0]
    packed = stages["packing"](spark, mixed, SF)
    assert packed.filter("piece = 0").count() == mixed.count()


def plain_rows(df):
    return [(r["doc_id"], r["text"] or "") for r in df.orderBy("doc_id").collect()]


def words(text):
    return [w for w in re.split("[\x20\x09-\x0d]+", text) if w]


def test_toxic_documents_go(spark, outputs):
    """What the stage keeps is what the fitted model scores below the threshold, and clean labelled texts stay."""
    given, made = outputs[0]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    model = toxicity.learn(given, labels.withColumnRenamed("toxic", "label"), crc_bucket("doc_id") != 2)
    keep = {r["doc_id"] for r in toxicity.score(given, model).collect() if r["score"] < 0.3}
    assert {r["doc_id"] for r in made.collect()} == keep
    said = {r["doc_id"]: r["toxic"] for r in labels.collect()}
    assert sum(said.get(i) == 1 for i in keep) <= 0.2 * sum(x == 1 for x in said.values())
    assert sum(said.get(r["doc_id"]) == 0 and r["doc_id"] not in keep for r in given.collect()) <= 0.02 * given.count()


def test_one_of_each_group_of_near_copies_stays(outputs):
    """All pairs of shingle sets, in plain Python."""
    given, made = outputs[1]
    rows = plain_rows(given)
    sets = []
    for _, text in rows:
        ws = words(text.translate({c: c + 32 for c in range(65, 91)}))
        sets.append({tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set())
    up = list(range(len(rows)))

    def root(i):
        while up[i] != i:
            i = up[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both and 100 * both >= 75 * (len(a) + len(sets[j]) - both):
                up[max(root(i), root(j))] = min(root(i), root(j))
    assert plain_rows(made) == [rows[i] for i in range(len(rows)) if up[i] == i]
    assert len(made.collect()) < len(rows)


def test_repeated_passages_go(outputs):
    """All windows of 35 words, in plain Python; texts without one stay as they are."""
    given, made = outputs[2]
    rows = plain_rows(given)
    split = [words(t) for _, t in rows]
    starts = Counter(tuple(ws[i : i + 35]) for ws in split for i in range(len(ws) - 34))
    want = []
    for (doc, text), ws in zip(rows, split):
        gone = {j for i in range(len(ws) - 34) if starts[tuple(ws[i : i + 35])] > 1 for j in range(i, i + 35)}
        want.append((doc, " ".join(w for j, w in enumerate(ws) if j not in gone) if gone else text))
    assert plain_rows(made) == want
    assert any(a != b for a, b in zip(rows, want))


def test_the_mix_takes_what_its_plan_says(outputs):
    """Blocks of words laid out one by one: which are taken, how often, and what texts come out of them."""
    given, made = outputs[3]
    plan = {r["doc_id"]: r for r in mixing.mix_plan(numbered(given), row="_row").collect()}
    text = dict(plain_rows(given))
    want = Counter()
    for doc, r in plan.items():
        ws, every = words(text[doc]), (r["seats"] // r["blocks"] if r["blocks"] else 0)
        extra = r["seats"] % r["blocks"] if r["blocks"] else 0
        # block b of a shard is taken once more where the count of chosen ones steps up
        more = lambda b: (b + 1 + r["start"]) * extra // r["blocks"] > (b + r["start"]) * extra // r["blocks"]  # noqa: E731, B023
        cut = [w for i, w in enumerate(ws) if more((r["first"] + i) // mixing.BLOCK)]
        assert r["taken"] == every * len(ws) + len(cut)
        for _ in range(every if ws else 0):
            want[(doc, text[doc])] += 1
        if cut:
            want[(doc, " ".join(cut))] += 1
    assert Counter((r["doc_id"], r["text"]) for r in made.collect()) == want
    for source in {r["source"] for r in plan.values()}:
        own = [r for r in plan.values() if r["source"] == source]
        assert abs(sum(r["taken"] for r in own) - own[0]["target"]) <= 0.1 * own[0]["target"] + 4 * mixing.BLOCK


def test_sequences_can_be_rebuilt(outputs):
    """Each mixed row, told by its number, is whole in its pieces, and no sequence overflows or overlaps."""
    from public_tokenizers import path
    from tokenizers import Tokenizer

    given, made = outputs[-1]
    library = Tokenizer.from_file(path("byte_bpe_50k.json"))
    want = Counter((r["doc_id"], len(library.encode(r["text"] or "", add_special_tokens=False).ids) + 1) for r in given.collect())
    pieces, places = {}, {}
    for r in made.collect():
        pieces.setdefault((r["doc_id"], r["row"]), []).append((r["piece"], r["start"], r["length"]))
        places.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    got = Counter()
    for (doc, _), own in pieces.items():
        at = 0
        for k, (piece, start, length) in enumerate(sorted(own)):
            assert (piece, start) == (k, at)
            at += length
        got[(doc, at)] += 1
    assert got == want
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048


def _sets(n: int, size: int = 300) -> pa.RecordBatch:
    rng = np.random.default_rng(3)
    blobs = [np.unique(rng.integers(0, 1 << 63, size).astype(np.uint64)).tobytes() for _ in range(n)]
    spots = pa.array(np.zeros(n, np.int64))
    columns = [pa.array(range(n), pa.int64()), pa.array(blobs, pa.binary()), pa.array(range(n), pa.int64()), pa.array([True] * n), spots, spots]
    return pa.RecordBatch.from_arrays(columns, ["rep", "shingles", "comp", "alone", "spots1", "spots2"])


@pytest.mark.parametrize("work", [partenum._sampled, partenum._by_signature(6), partenum._described, partenum._single])
def test_memory_does_not_follow_the_sets_of_a_batch(work, monkeypatch):
    """Signatures take some 70 times the shingles, so a batch of 10,000 sets took a worker above 1 GB."""
    monkeypatch.setattr(partenum, "TaskContext", SimpleNamespace(get=lambda: SimpleNamespace(partitionId=lambda: 0)))

    def peak(n: int) -> int:
        batch = _sets(n)
        tracemalloc.start()
        for _ in work(iter([batch])):
            pass
        try:
            return tracemalloc.get_traced_memory()[1]
        finally:
            tracemalloc.stop()

    assert peak(6000) < 1.5 * peak(1500)


def test_sampled_signatures_are_the_same_however_a_batch_is_cut(monkeypatch):
    def found() -> list:
        return sorted(((x["rep"], x["sig"]) for b in partenum._sampled(iter([_sets(60)])) for x in b.to_pylist()), key=str)

    whole = found()
    monkeypatch.setattr(partenum, "AT_HAND", 5000)
    assert whole and found() == whole

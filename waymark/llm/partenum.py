"""Groups of near-equal documents by PartEnum signatures, exactly.

Documents are sets of word shingles; they link when their Jaccard is 3/4 or more, and the result is
the connected components. Equal sets are one set from the start.

1. A set can only have a partner if 3/4 of its shingles occur in another set. Shingles are counted
   over all documents in packed form (see ``substrings``); sets below are done.
2. The sets left are in size bands whose upper end is twice the lower; a set also joins the next
   band if a partner can be there. In a band the 64-bit shingle domain is split into ``m`` parts of
   ``SUBPARTS`` each, and a signature is the contents of two of a part's three subparts. Sets of sizes
   a <= b with the wanted Jaccard differ in at most (a + b) / 7 elements. One difference spoils one
   subpart, so a part is lost to two differences, or to one if it has a single filled subpart; with
   more parts (counting those with two filled subparts twice) than 2b / 7, a signature that is
   not empty must be shared. Sets for which the count does not hold are met by all their shingles.
3. Links among sets that share their most frequent sampled signature are found first, in blocks, from
   ``ROUNDS`` samples. Only components of those links are then paired by signatures, so a large group
   of near copies is one party there and not all its pairs, and sets of one block are not paired.
   Partners share a number of signatures that a set's own parts tell; so where a signature is
   frequent, each set may leave out that number less one of its most frequent, which takes passages
   that many documents share out of the pairing. Of two single sets, sizes and parity sketches rule
   out most of those that merely share a passage: sketches never differ in more bits than sets in
   elements, so no link is lost. Sets that keep a signature of more than ``CROWD`` components do not meet
   by it but by their rarest shingles: each gives a quarter of its own and one more, rarest first, of
   which partners share one, and the first they share leaves room for the overlap they need. A shingle
   that many give is paired in tiles of two blocks, which are separate rows. Candidate pairs are
   compared by all their shingles, in blocks of the larger component and lots of the askers.

Defined cases: A-Z is read as a-z; a text with fewer words than a shingle is one shingle; texts
without words and NULL are sets of size 0, linked with nothing; rows of one doc_id are one document;
repeated rows each give a row; other columns do not matter. Names of shingles have 64 bits, of sets 128.
"""

from __future__ import annotations

from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import checkpointed, text_of
from waymark.llm.components import components
from waymark.llm.substrings import _ASKED, _HEAD, _ROW, _Rows, _answers, _ask, _judge, _names
from waymark.llm.wordhash import Words, mix, slices, windows, words

SHINGLE = 5
BUCKET_SHINGLES, BLOCK, OFTEN = 400_000, 1000, 4
SUBPARTS, PARTS_PER_SIZE, PARTS_MORE = 3, 0.15, 8
AT_HAND = 2 << 20  # bytes of texts or shingles that a task works on at a time; signatures take some 70 times that
BROADCAST_ROWS = 500_000  # of 24 bytes
_U = np.uint64
_I = np.int64


def shingles(w: Words, size: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (document index, shingle hash) of a batch, sorted."""
    hashes, at = windows(w, size)
    docs = w.doc[at]
    short = np.flatnonzero((w.counts > 0) & (w.counts < size))
    if len(short):
        first = np.cumsum(w.counts)[short] - w.counts[short]
        whole = np.zeros(len(short), np.uint64)
        for k in range(size - 1):
            has = w.counts[short] > k
            whole[has] = mix(whole[has] + w.hashes[first[has] + k], 31)
        hashes, docs = np.concatenate([hashes, mix(whole, 32)]), np.concatenate([docs, short])
    order = np.lexsort((hashes, docs))
    hashes, docs = hashes[order], docs[order]
    new = np.ones(len(hashes), bool)
    new[1:] = (hashes[1:] != hashes[:-1]) | (docs[1:] != docs[:-1])
    return docs[new], hashes[new]


def set_keys(docs: np.ndarray, hashes: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    out = []
    for salt in (21, 22):
        total = np.zeros(n, np.uint64)
        np.add.at(total, docs, mix(hashes, salt))
        out.append(total.view(np.int64))
    return out[0], out[1]


def _to_bytes(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema) as writer:
        writer.write_batch(batch)
    return sink.getvalue().to_pybytes()


def _profile(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = (TaskContext.get().partitionId() + 1) << 24
        for given in batches:
            for part in slices(given, "text"):
                batch += 1
                out, n = _Rows(), len(part)
                docs, hashes = shingles(words(part.column("text"), fold=True))
                size = np.bincount(docs, minlength=n)
                key1, key2 = set_keys(docs, hashes, n)
                _, first, same = np.unique(np.stack([key1, key2, size]), axis=1, return_index=True, return_inverse=True)
                leader = first[same.reshape(-1)]
                lead = leader == np.arange(n)
                mine = lead[docs]
                head = pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(x) for x in (size, key1, key2, leader, np.cumsum(np.where(lead, size, 0))))],
                    ["doc_id", "n_shingles", "key1", "key2", "leader", "stop"],
                )
                out.add(int(mix(np.array([batch], np.uint64))[0] % (1 << bits)), batch, _HEAD, _to_bytes(head))
                asked = hashes[mine]
                _ask(out, batch, _names(asked, bits), np.arange(len(asked)), bits, named=False)
                yield from out.table().to_batches()

    return run


def _live(table: pa.Table) -> pa.Table:
    """A row per document of a batch: its set, and whether 3/4 of it occurs elsewhere."""
    head, places = None, [np.zeros(0, np.int64)]
    for bucket, _, kind, data in zip(*(c.to_pylist() for c in table.columns)):
        if kind == _HEAD:
            head = pa.ipc.open_stream(data).read_all()
        else:
            places.append(_answers(bucket, kind, data)[0])
    size, leader, stop = (np.asarray(head.column(c)) for c in ("n_shingles", "leader", "stop"))
    found = np.bincount(np.searchsorted(stop, np.concatenate(places), side="right"), minlength=len(size))
    live = (4 * found >= 3 * size) & (size > 0)
    out = head.select(["doc_id", "n_shingles", "key1", "key2"])
    return out.append_column("live", pa.array(live[leader]))


def document_sets(docs: DataFrame, bucket_shingles: int = BUCKET_SHINGLES) -> DataFrame:
    """doc_id, n_shingles, key1, key2, live for every row."""
    given = docs.select("doc_id", text_of().alias("text"))
    size = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, size / 6 / bucket_shingles))), 8, 24))
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = given.mapInArrow(_profile(bits), _ROW).groupBy("bucket").applyInArrow(_judge(bits, named=False), _ROW)
    return rows.groupBy("batch").applyInArrow(_live, f"doc_id {kind}, n_shingles long, key1 long, key2 long, live boolean")


def _features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "text", AT_HAND):
            docs, hashes = shingles(words(part.column("text"), fold=True))
            key1, _ = set_keys(docs, hashes, len(part))
            right = key1 == np.asarray(part.column("key1"))
            ends = np.searchsorted(docs, np.arange(len(part) + 1))
            keep = np.flatnonzero(right)
            yield pa.RecordBatch.from_arrays(
                [part.column("doc_id").take(pa.array(keep)), pa.array([hashes[ends[i] : ends[i + 1]].tobytes() for i in keep], pa.binary())],
                ["rep", "shingles"],
            )


def _unpack(blobs) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all sets, the set each is of, and the sizes."""
    parts = [np.frombuffer(b, np.uint64) for b in blobs]
    size = np.array([len(p) for p in parts], _I)
    return (np.concatenate(parts) if parts else np.zeros(0, np.uint64)), np.repeat(np.arange(len(parts)), size), size


def band(size: np.ndarray) -> np.ndarray:
    return np.floor(np.log2(np.maximum(size, 1))).astype(_I)


class Signatures(NamedTuple):
    row: np.ndarray  # of each signature: a set in one band
    value: np.ndarray
    sets: np.ndarray  # of each row: the set
    least: np.ndarray  # of each row: how many signatures a partner shares at least
    risky: np.ndarray  # of each set: whether that may be none


def signatures(hashes: np.ndarray, owner: np.ndarray, size: np.ndarray) -> Signatures:
    own = band(size)
    up = np.flatnonzero(4 * size >= 3 * (1 << (own + 1)))
    sets, bands = np.concatenate([np.arange(len(size)), up]), np.concatenate([own, own[up] + 1])
    # a line of subparts for each set and band
    m = (np.ceil(PARTS_PER_SIZE * (1 << (bands + 1))) + PARTS_MORE).astype(_I)
    base = np.cumsum(m) - m
    ends = np.searchsorted(owner, np.arange(len(size) + 1))
    n = size[sets]
    element = np.repeat(ends[sets] - (np.cumsum(n) - n), n) + np.arange(n.sum())
    h, row = hashes[element], np.repeat(np.arange(len(sets)), n)
    spread = mix(h, 41)
    part = (spread % m[row].astype(np.uint64)).astype(_I)
    sub = ((spread >> _U(40)) % _U(SUBPARTS)).astype(_I)
    cell = (base[row] + part) * SUBPARTS + sub
    del element, row, spread, part, sub  # each as long as all shingles at hand
    total = np.zeros(int(m.sum()) * SUBPARTS, np.uint64)
    np.add.at(total, cell, mix(h, 42))
    filled = np.bincount(cell, minlength=len(total)).reshape(-1, SUBPARTS) > 0
    del h, cell
    total = total.reshape(-1, SUBPARTS)
    number = filled.sum(axis=1)
    summed = lambda x: np.add.reduceat(x.astype(_I), base) if len(base) else np.zeros(0, _I)
    some, two = summed(number > 0), summed(number > 1)
    risky = (some + two)[: len(size)] <= 2 * size // 7
    # the first difference in a part costs two signatures, the second the last one
    apart = (n + np.minimum(4 * n // 3, (1 << (bands + 1)) - 1)) // 7
    lost = 2 * np.minimum(apart, some) + np.minimum(np.maximum(apart - some, 0), two)
    least = np.maximum(1, 3 * two + 2 * (some - two) - lost)
    place = np.repeat(bands, m) * (1 << 32) + np.arange(int(m.sum())) - np.repeat(base, m)
    whose = np.repeat(np.arange(len(sets)), m)
    found, of = [], []
    for i, j in ((0, 1), (0, 2), (1, 2)):
        used = filled[:, i] | filled[:, j]
        label = mix((place[used] * SUBPARTS + i + j).astype(np.uint64), 43)
        found.append(mix(mix(total[used, i] + label) + total[used, j]))
        of.append(whose[used])
    return Signatures(np.concatenate(of), np.concatenate(found), sets, least, risky)


SAMPLES, ROUNDS = 16, 4


def _sampled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A quarter of the signatures, and NULL for a set that they do not settle."""
    for batch in batches:
        for part in slices(batch, "shingles", AT_HAND):
            s = signatures(*_unpack(part.column("shingles").to_pylist()))
            some = s.value % _U(SAMPLES) < _U(ROUNDS)
            of, found = s.sets[s.row[some]], s.value[some]
            risk = np.flatnonzero(s.risky)
            reps = part.column("rep").take(pa.array(np.concatenate([of, risk])))
            sig = pa.concat_arrays([pa.array(found.view(_I)), pa.nulls(len(risk), pa.int64())])
            yield pa.RecordBatch.from_arrays([reps, sig], ["rep", "sig"])


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def root(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i


def _links_in(table: pa.Table) -> pa.Table:
    """A forest of the links among the sets of one block, found through their inverted shingles."""
    reps = table.column("rep").to_pylist()
    hashes, owner, size = _unpack(table.column("shingles").to_pylist())
    _, index = np.unique(hashes, return_inverse=True)
    order = np.argsort(index, kind="stable")
    posted, edges = owner[order], np.searchsorted(index[order], np.arange(index.max(initial=-1) + 2))
    ends = np.searchsorted(owner, np.arange(len(reps) + 1))
    waiting, a, b = np.ones(len(reps), bool), [], []
    for seed in range(len(reps)):
        if not waiting[seed]:
            continue
        waiting[seed] = False
        todo = [seed]
        while todo:
            i = todo.pop()
            own = index[ends[i] : ends[i + 1]]
            number = edges[own + 1] - edges[own]
            at = np.repeat(edges[own] - (np.cumsum(number) - number), number) + np.arange(number.sum())
            both = np.bincount(posted[at], minlength=len(reps))
            near = np.flatnonzero(waiting & (4 * both >= 3 * (size[i] + size - both)))
            waiting[near] = False
            for j in near.tolist():
                a.append(reps[i])
                b.append(reps[j])
                todo.append(j)
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


_PAIRS, _OFTEN, _CROWD = 4, 5, 8
CROWD, TILE, AT_ONCE = 500, 1000, 1 << 20
SKETCH = 128  # bits
_ABOUT = 4 + SKETCH // 64  # lines told of a set: component, two of blocks, size, sketch


def sketches(hashes: np.ndarray, owner: np.ndarray, n: int) -> np.ndarray:
    """Parity of the elements that fall on each of ``SKETCH`` bits, as a line of int64 per word and set.

    Two sets differ in at least as many elements as their sketches in bits."""
    bit = (mix(hashes, 44) % _U(SKETCH)).astype(_I)
    odd = np.bincount(owner * SKETCH + bit, minlength=n * SKETCH) & 1
    return np.packbits(odd.astype(np.uint8)).view(_I).reshape(n, -1).T


def unlike(sketch_a: np.ndarray, sketch_b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Whether sketches or sizes show that two sets are no partners; False where a size is 0 (not told)."""
    differ = np.bitwise_count((sketch_a ^ sketch_b).view(_U)).sum(axis=0, dtype=_I)  # of signed numbers it counts those of the absolute value
    far = (7 * differ > size_a + size_b) | (4 * np.minimum(size_a, size_b) < 3 * np.maximum(size_a, size_b))
    return far & (size_a > 0) & (size_b > 0)


def _deal(out: _Rows, batch: int, value: np.ndarray, about: np.ndarray, row: np.ndarray, bits: int) -> None:
    """A row per bucket: its signatures with the rows they are of, and once for each of those rows what is told of it.

    ``about`` has a column per row of the batch."""
    bucket = (value >> _U(64 - bits)).astype(_I)
    order = np.argsort(bucket, kind="stable")
    value, row, bucket = value[order], row[order], bucket[order]
    cuts = np.flatnonzero(np.diff(bucket, prepend=-1))
    for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(bucket)).tolist()):
        rows, at = np.unique(row[x:y], return_inverse=True)
        sizes = np.array([y - x, len(rows)], _I)
        parts = (sizes, value[x:y].view(_I), np.concatenate([[rows], about[:, rows]]), at.astype(np.int32))
        out.add(int(bucket[x]), batch, _ASKED, b"".join(p.tobytes() for p in parts))


def _dealt(data: bytes) -> np.ndarray:
    """What :func:`_deal` packed: lines of value, row and what is told, a column per signature."""
    n, k = np.frombuffer(data, _I, 2)
    value = np.frombuffer(data, _I, n, 16)
    told = np.frombuffer(data, _I, k * (1 + _ABOUT), 16 + 8 * n).reshape(1 + _ABOUT, k)
    at = np.frombuffer(data, np.int32, n, 16 + 8 * (n + k * (1 + _ABOUT)))
    return np.concatenate([[value], told[:, at]])


def _by_signature(bits: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = (TaskContext.get().partitionId() + 1) << 24
        for batch in batches:
            for part in slices(batch, "shingles", AT_HAND):
                number += 1
                out = _Rows()
                hashes, owner, size = _unpack(part.column("shingles").to_pylist())
                s = signatures(hashes, owner, size)
                told = [np.asarray(part.column(c)) for c in ("comp", "spots1", "spots2")]
                alone = np.where(np.asarray(part.column("alone")), size, 0)
                about = np.stack([*told, alone, *sketches(hashes, owner, len(size))])[:, s.sets]
                reps = np.asarray(part.column("rep"))[s.sets]
                out.add(number % (1 << bits), number, _HEAD, np.concatenate([about, [s.least], [reps]]).tobytes())
                _deal(out, number, s.value, about, s.row, bits)
                yield from out.table().to_batches()

    return run


def _meet(often: int | None):
    """Pairs of components that share a signature of a bucket. Signatures of more than ``often``
    components go back to their rows, with that number, so that each can leave out its most frequent."""

    def run(table: pa.Table) -> pa.Table:
        out, blobs, sizes, batches, where = _Rows(), [], [], [], 0
        for bucket, batch, kind, data in zip(*(c.to_pylist() for c in table.columns)):
            where = bucket
            if kind in (_HEAD, _CROWD):
                out.add(bucket, batch, kind, data)
                continue
            blobs.append(_dealt(data))
            sizes.append(blobs[-1].shape[1])
            batches.append(batch)
        if not blobs:
            return out.table()
        value, row, comp, *spots = (rows := np.concatenate(blobs, axis=1))[:5]
        size, sketch = rows[5], rows[6:]
        batch = np.repeat(np.array(batches, _I), sizes)
        both, at = np.unique(np.stack([value, comp]), axis=1, return_index=True)
        # blocks of a component of one set, all of whose pairs are known: no link is left there
        blocks = np.stack([h for x in spots for h in (x[at] >> 32, x[at] & 0xFFFFFFFF)])
        size, sketch = size[at], sketch[:, at]
        keys, first, count = np.unique(both[0], return_index=True, return_counts=True)
        if often:
            total = count[np.searchsorted(keys, value)]
            back = np.flatnonzero(total > often)
            back = back[np.argsort(batch[back], kind="stable")]
            cuts = np.flatnonzero(np.diff(batch[back], prepend=-1))
            for x, y in zip(cuts.tolist(), np.append(cuts[1:], len(back)).tolist()):
                at = back[x:y]
                out.add(where, int(batch[at[0]]), _OFTEN, np.stack([value[at], row[at], total[at]]).tobytes())
        few = (count > 1) & (count <= (often or np.inf))
        got, held = [], 0
        for at, n in zip(first[few].tolist(), count[few].tolist()):
            i, j = np.triu_indices(n, 1)
            x, y = blocks[:, at + i], blocks[:, at + j]
            i, j = i + at, j + at
            new = ~((x == y) & (x > 0)).any(axis=0) & ~unlike(sketch[:, i], sketch[:, j], size[i], size[j])
            got.append(np.stack([both[1][i[new]], both[1][j[new]]]))
            held += int(new.sum())
            if held > 1 << 20:
                got, held = [np.unique(np.concatenate(got, axis=1), axis=1)], 0
        if got:
            pairs = np.unique(np.sort(np.concatenate(got, axis=1), axis=0), axis=1)
            out.add(where, 0, _PAIRS, pairs.tobytes())
        return out.table()

    return run


def _rarer(bits: int, crowd: int):
    def run(table: pa.Table) -> pa.Table:
        """The frequent signatures of a batch without each row's ``least`` - 1 most frequent ones.

        Partners share ``least`` signatures; the rarest of those is in what both keep. Where more than
        ``crowd`` components have it, both sets are named instead."""
        head, found, batch = None, [np.zeros((3, 0), _I)], 0
        for _, batch, kind, data in zip(*(c.to_pylist() for c in table.columns)):
            if kind == _HEAD:
                head = np.frombuffer(data, _I).reshape(_ABOUT + 2, -1)
            else:
                found.append(np.frombuffer(data, _I).reshape(3, -1))
        value, row, total = np.concatenate(found, axis=1)
        order = np.lexsort((value, -total, row))
        value, row, total = value[order], row[order], total[order]
        rank = np.arange(len(row)) - np.searchsorted(row, row)
        keep = rank >= head[_ABOUT][row] - 1
        out, many = _Rows(), total > crowd
        named = np.unique(head[_ABOUT + 1][row[keep & many]])
        if len(named):
            out.add(batch % (1 << bits), batch, _CROWD, named.tobytes())
        keep &= ~many
        _deal(out, batch, value[keep].view(np.uint64), head[:_ABOUT], row[keep], bits)
        return out.table()

    return run


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            a, b = np.frombuffer(data, _I).reshape(2, -1)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _named(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for data in batch.column("data").to_pylist():
            yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(data, _I))], ["rep"])


def component_pairs(told: DataFrame, bits: int, often: int = OFTEN, crowd: int = CROWD, tile: int = TILE) -> DataFrame:
    """Pairs a < b of components that can hold partners, for (rep, shingles, comp, alone, spots1, spots2).

    Partners share a signature; up to ``crowd`` components it pairs them, above that their rarest shingles do."""
    rows = told.mapInArrow(_by_signature(bits), _ROW).groupBy("bucket").applyInArrow(_meet(often), _ROW)
    rows = checkpointed(rows)
    again = rows.filter(F.col("kind") != _PAIRS).groupBy("batch").applyInArrow(_rarer(bits, crowd), _ROW)
    again = checkpointed(again.groupBy("bucket").applyInArrow(_meet(None), _ROW))
    packed = rows.unionByName(again).filter(F.col("kind") == _PAIRS).select("data")
    pairs = packed.mapInArrow(_unpacked, "a long, b long")
    crowded = again.filter(F.col("kind") == _CROWD)
    if not crowded.isEmpty():
        reps = crowded.select("data").mapInArrow(_named, "rep long").distinct()
        pairs = pairs.unionByName(_in_crowds(told.join(reps, "rep", "left_semi"), tile))
    return pairs.distinct()


def _described(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "shingles", AT_HAND):
            hashes, owner, size = _unpack(part.column("shingles").to_pylist())
            sketch = sketches(hashes, owner, len(size))
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in ("rep", "comp", "alone")), pa.array(size), *map(pa.array, sketch)],
                ["rep", "comp", "alone", "size", "sketch1", "sketch2"],
            )


def _single(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in slices(batch, "shingles", AT_HAND):
            hashes, owner, _ = _unpack(part.column("shingles").to_pylist())
            yield pa.RecordBatch.from_arrays([part.column("rep").take(pa.array(owner)), pa.array(hashes.view(_I))], ["rep", "h"])


def _in_crowds(sets: DataFrame, tile: int) -> DataFrame:
    """Component pairs among ``sets`` by the prefix of each set in the order of (sets with it, shingle).

    Partners share 3/4 of either's shingles, so one is in both prefixes of a quarter and one more."""
    about = checkpointed(sets.mapInArrow(_described, "rep long, comp long, alone boolean, size long, sketch1 long, sketch2 long"))
    each = sets.mapInArrow(_single, "rep long, h long")
    number = each.groupBy("h").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
    met = each.join(number, "h").groupBy("rep").agg(F.array_sort(F.collect_list(F.struct("n", "h"))).alias("met"))
    # shingles of one set only come first in the order and meet nothing
    own = F.col("size") - F.size("met")
    prefix = F.slice("met", F.lit(1), F.greatest(F.lit(0), F.floor(F.col("size") / 4) + 1 - own).cast("int"))
    given = met.join(about, "rep").select("comp", "alone", "size", "sketch1", "sketch2", own.alias("own"), F.posexplode(prefix).alias("at", "x"))
    of_single = lambda c: F.when(F.col("alone"), c).otherwise(F.lit(0)).cast("long")
    entries = given.select(
        F.col("x.h").alias("h"), F.col("x.n").alias("n"), "comp", of_single(F.col("size")).alias("size"),
        of_single(F.col("own") + F.col("at")).alias("place"), *[of_single(F.col(c)).alias(c) for c in ("sketch1", "sketch2")],
    ).distinct()
    blocks = F.ceil(F.col("n") / tile)
    tiled = entries.withColumn("block", F.pmod(F.xxhash64("comp"), blocks)).withColumn("_o", F.explode(F.sequence(F.lit(0).cast("long"), blocks - 1)))
    tiled = tiled.withColumns({"lo": F.least("block", "_o"), "hi": F.greatest("block", "_o")}).drop("_o", "n")
    most = about.agg(F.sum(F.floor(F.col("size") / 4) + 1)).first()[0] or 0
    groups = max(int(sets.sparkSession.conf.get("spark.sql.shuffle.partitions")), most // 100_000)
    key = F.pmod(F.xxhash64("h", "lo", "hi"), F.lit(groups))
    return tiled.withColumn("key", key).groupBy("key").applyInArrow(_meet_in_tiles, "a long, b long")


def _meet_in_tiles(table: pa.Table) -> pa.Table:
    """Pairs of the two blocks of each tile that sizes, places and sketches leave, about ``AT_ONCE`` at a time."""
    h, lo, hi, block, comp, size, place, *sketch = (
        np.asarray(table.column(c)) for c in ("h", "lo", "hi", "block", "comp", "size", "place", "sketch1", "sketch2")
    )
    order = np.lexsort((block, hi, lo, h))
    h, lo, hi, block, comp, size, place = (x[order] for x in (h, lo, hi, block, comp, size, place))
    sketch = np.stack(sketch)[:, order]
    n = len(h)
    new = np.append(True, (h[1:] != h[:-1]) | (lo[1:] != lo[:-1]) | (hi[1:] != hi[:-1]))[:n]
    first = np.flatnonzero(new)
    tile = np.cumsum(new) - 1
    stop = np.append(first[1:], n)[tile]
    # the rows of the other block stand behind, those of the same block behind the row itself
    lower = first[tile] + np.bincount(tile, weights=block == lo).astype(_I)[tile]
    start = np.where(lo == hi, np.arange(n) + 1, np.where(block == lo, lower, stop))
    number = stop - start
    total = np.cumsum(number)
    got, at = [np.zeros((2, 0), _I)], 0
    while at < n:
        upto = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + AT_ONCE, side="right")))
        k = number[at:upto]
        i = np.repeat(np.arange(at, upto), k)
        j = np.repeat(start[at:upto] - (np.cumsum(k) - k), k) + np.arange(k.sum())
        room = np.minimum(size[i] - place[i], size[j] - place[j])
        far = unlike(sketch[:, i], sketch[:, j], size[i], size[j]) | ((7 * room < 3 * (size[i] + size[j])) & (size[i] > 0) & (size[j] > 0))
        near = ~far & (comp[i] != comp[j])
        if near.any():
            got.append(np.sort(np.stack([comp[i[near]], comp[j[near]]]), axis=0))
            if sum(x.shape[1] for x in got[1:]) > AT_ONCE:
                got = [np.unique(np.concatenate(got, axis=1), axis=1)]
        at = upto
    a, b = np.unique(np.concatenate(got, axis=1), axis=1)
    return pa.Table.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _compare(table: pa.Table) -> pa.Table:
    """A lot of queries against the sets of their targets: one link for a query and a part of a component."""
    asks, comps, parts, lots, reps, blobs = (table.column(c).to_pylist() for c in ("asks", "comp", "part", "lot", "rep", "shingles"))
    targets: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(comps, parts, lots)):
        if not asks[k]:
            targets.setdefault(key, []).append(k)
    queries: dict[tuple, list[int]] = {}
    for k, key in enumerate(zip(comps, parts, lots)):
        if asks[k] and key in targets:
            queries.setdefault(key, []).append(k)
    a, b = [], []
    for key, asked in queries.items():
        members = targets[key]
        every, owner, size = _unpack([blobs[k] for k in members])
        order = np.argsort(every, kind="stable")
        every, owner = every[order], owner[order]
        for k in asked:
            own = np.frombuffer(blobs[k], np.uint64)
            lo, hi = np.searchsorted(every, own), np.searchsorted(every, own, side="right")
            number = hi - lo
            at = np.repeat(lo - (np.cumsum(number) - number), number) + np.arange(number.sum())
            both = np.bincount(owner[at], minlength=len(members))
            near = np.flatnonzero(4 * both >= 3 * (size + len(own) - both))
            if len(near):  # the members of a part are connected, so one link says it all
                a.append(reps[k])
                b.append(reps[members[near[0]]])
    return pa.Table.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])


def links(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """a, b: links that connect what all links connect, for sets (rep long, shingles)."""
    spark = sets.sparkSession
    number = sets.count()
    groups = max(int(spark.conf.get("spark.sql.shuffle.partitions")), number // block)
    sampled = checkpointed(sets.mapInArrow(_sampled, "rep long, sig long"))
    found, blocks = None, sets.select("rep")
    for turn in range(ROUNDS):
        some = sampled.filter(F.col("sig").isNotNull() & (F.pmod("sig", F.lit(ROUNDS)) == turn))
        often = some.groupBy("sig").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        top = some.join(often, "sig").groupBy("rep").agg(F.max(F.struct("n", "sig")).alias("top"))
        spot = F.pmod(F.xxhash64("rep"), F.ceil(F.col("top.n") / block))
        key = 1 + F.pmod(F.xxhash64("top.sig", spot), F.lit(groups))
        placed = checkpointed(top.select("rep", key.alias("key")))
        near = placed.join(sets, "rep").groupBy("key").applyInArrow(_links_in, "a long, b long")
        found = near if found is None else found.unionByName(near)
        blocks = blocks.join(placed.withColumnRenamed("key", f"key{turn}"), "rep", "left")
    found = checkpointed(found.distinct())
    comps = checkpointed(components(found))
    grown = comps.select(F.col("node").alias("rep"), "label")
    alone = lambda c: F.when(F.col("label").isNull(), F.coalesce(c, F.lit(0))).otherwise(0)
    packed = [F.shiftleft(alone(F.col(f"key{i}")), 32).bitwiseOR(alone(F.col(f"key{i + 1}"))) for i in (0, 2)]
    placed = blocks.join(grown, "rep", "left").select(
        "rep", F.coalesce("label", "rep").alias("comp"), F.col("label").isNull().alias("alone"), packed[0].alias("spots1"), packed[1].alias("spots2")
    )
    told = checkpointed(sets.join(placed, "rep"))
    bits = int(np.clip(np.ceil(np.log2(max(1, number / 200))), 6, 20))
    pairs = component_pairs(told, bits)
    risky = sampled.filter(F.col("sig").isNull()).select("rep").distinct()
    if not risky.isEmpty():
        pairs = pairs.unionByName(_by_all_shingles(told, risky)).distinct()
    sizes = told.groupBy("comp").agg(F.count(F.lit(1)).alias("n"))
    of_a, of_b = (sizes.select(F.col("comp").alias(c), F.col("n").alias(f"n{c}")) for c in "ab")
    less = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.xxhash64("a") < F.xxhash64("b")))
    asked = pairs.join(of_a, "a").join(of_b, "b").select(
        F.when(less, F.col("a")).otherwise(F.col("b")).alias("from"), F.when(less, F.col("b")).otherwise(F.col("a")).alias("comp"),
        F.ceil(F.when(less, F.col("nb")).otherwise(F.col("na")) / block).alias("parts"), F.least("na", "nb").alias("n"),
    )
    asked = checkpointed(asked)
    goals = checkpointed(asked.groupBy("comp", "parts").agg(F.ceil(F.sum("n") / block).alias("lots"), F.sum("n").alias("n")))
    size = goals.agg(F.sum(F.col("n") * F.col("parts"))).first()[0] or 0
    up_to = lambda c: F.explode(F.sequence(F.lit(0), (F.col(c) - 1).cast("int")))
    queries = asked.drop("n").join(goals.select("comp", "lots"), "comp").withColumn("part", up_to("parts")).join(
        told.withColumnRenamed("comp", "from"), "from"
    ).select(F.lit(True).alias("asks"), "comp", "part", F.pmod(F.xxhash64("rep"), F.col("lots")).cast("int").alias("lot"), "rep", "shingles")
    targets = goals.withColumn("lot", up_to("lots")).join(told, "comp").select(
        F.lit(False).alias("asks"), "comp", F.pmod(F.xxhash64("rep"), F.col("parts")).cast("int").alias("part"), "lot", "rep", "shingles"
    )
    key = F.pmod(F.xxhash64("comp", "part", "lot"), F.lit(max(groups, size // block)))
    sure = queries.unionByName(targets).withColumn("key", key).groupBy("key").applyInArrow(_compare, "a long, b long")
    return found.unionByName(sure)


def _by_all_shingles(told: DataFrame, risky: DataFrame) -> DataFrame:
    """Component pairs of the few sets that signatures do not settle: whatever shares a shingle with them."""
    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "shingles", AT_HAND):
                hashes, owner, _ = _unpack(part.column("shingles").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("comp").take(pa.array(owner)), pa.array(hashes.view(_I))], ["comp", "h"])

    each = told.join(risky, "rep").mapInArrow(spread, "comp long, h long").distinct()
    every = told.mapInArrow(spread, "comp long, h long").distinct()
    met = each.withColumnRenamed("comp", "c").join(every, "h").filter("c <> comp")
    return met.select(F.least("c", "comp").alias("a"), F.greatest("c", "comp").alias("b"))


def near_groups(docs: DataFrame, bucket_shingles: int = BUCKET_SHINGLES, block: int = BLOCK) -> DataFrame:
    """doc_id, n_shingles, component_id: the least doc_id that links reach. ``doc_id`` is a long."""
    sets = checkpointed(document_sets(docs, bucket_shingles))
    keys = ["key1", "key2", "n_shingles"]
    first = sets.filter("n_shingles > 0").groupBy(*keys).agg(F.min("doc_id").alias("rep"), F.max("live").alias("live"))
    reps = checkpointed(first.filter("live").select("rep", "key1"))
    chosen = reps.withColumnRenamed("rep", "doc_id")
    small = reps.count() <= BROADCAST_ROWS
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen) if small else chosen, "doc_id")
    features = checkpointed(texts.mapInArrow(_features, "rep long, shingles binary"))
    labels = components(links(features, block)).withColumnRenamed("node", "rep")
    known = first.select(*keys, "rep").join(labels, "rep", "left").select(*keys, F.coalesce("label", "rep").alias("component"))
    same = sets.join(known, keys, "left")
    return same.select("doc_id", "n_shingles", F.coalesce("component", "doc_id").alias("component_id"))

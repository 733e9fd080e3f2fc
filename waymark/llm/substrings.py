"""Removing passages that occur more than once, found by level-wise doubling.

A window of words can only be repeated if the shorter windows that make it up are. Windows of
``levels[0]`` words are counted over all documents; places where two repeated ones join give the
candidates of twice that length, and so on, the last level joining two that overlap to exactly the
wanted length. Only survivors of a level take part in the next.

How it moves: texts are read in batches of a few MB. A batch sends its distinct windows to buckets by
hash, 32 bits and a step of the place each, packed in one row per batch and bucket; a bucket counts
and answers with the places that are repeated. Windows repeated inside a batch are known to be and
go as one entry, so the most frequent passage costs a bucket one entry per batch. A name is bucket
and 32 bits; two windows of the last level count as equal when the names of all parts agree.
At the end each document's spans meet its text in one join. Nothing depends on groups of equal
documents, and nothing goes to the driver but the number of bytes, which sets the bucket count.

Defined cases: NULL and empty texts have no words; shorter texts lose nothing; windows are judged
on the input, so every copy of a repeated passage goes, repeated rows included; other columns do not
matter; no rows give no rows.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import text_of
from waymark.llm.wordhash import mix, slices, windows, words

WINDOW, FIRST = 35, 18
BUCKET_WINDOWS = 400_000  # about as many windows are counted together
_U = np.uint64
#: Rows of the exchange: documents of a batch, its own repeats (places with names, or places alone),
#: questions, repeats as entries; and answers. Those of a bucket lack the bits that are its number.
_HEAD, _OWN, _ASKED, _KNOWN, _BARE, _ANSWER = 0, 1, 2, 3, 6, 7
FOUND = ("n_words", "n_removed", "kept")
_ROW = "bucket int, batch long, kind int, data binary"


def levels_to(window: int, first: int = FIRST) -> list[int]:
    """Doubling lengths that end at ``window``: half of it, half of that, until ``first`` is reached."""
    out = [window]
    while out[0] > first:
        out.insert(0, -(-out[0] // 2))
    return out


def _planes(numbers: np.ndarray) -> bytes:
    """32-bit numbers byte plane by byte plane, which compresses well when most are small."""
    return numbers.astype("<u4").view(np.uint8).reshape(-1, 4).T.tobytes()


def _from_planes(raw: np.ndarray, n: int) -> np.ndarray:
    return np.ascontiguousarray(raw.reshape(4, n).T).view("<u4").reshape(-1)


def _steps(places: np.ndarray) -> bytes:
    return _planes(np.diff(places, prepend=0))


def _places(raw: np.ndarray, n: int) -> np.ndarray:
    return np.cumsum(_from_planes(raw, n).astype(np.int64))


class _Rows:
    """Rows of the exchange, gathered to one batch."""

    def __init__(self) -> None:
        self.rows: list[tuple] = []

    def add(self, bucket: int, batch: int, kind: int, data: bytes) -> None:
        self.rows.append((bucket, batch, kind, data))

    def table(self) -> pa.Table:
        kinds = (pa.int32(), pa.int64(), pa.int32(), pa.binary())
        columns = list(zip(*self.rows)) or [(), (), (), ()]
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds)], ["bucket", "batch", "kind", "data"])


def _ask(out: _Rows, batch: int, names: np.ndarray, places: np.ndarray, bits: int, named: bool = True) -> None:
    """Rows that ask which windows are repeated; those repeated inside the batch are answered at once."""
    if not len(names):
        return
    order = np.argsort(names, kind="stable")
    ordered = names[order]
    new = np.ones(len(order), bool)
    new[1:] = ordered[1:] != ordered[:-1]
    first = np.flatnonzero(new)
    many = np.diff(np.append(first, len(order))) > 1
    own = np.sort(order[np.repeat(many, np.diff(np.append(first, len(order))))])
    if len(own):
        here = batch % (1 << bits)
        if named:
            out.add(here, batch, _OWN, _steps(places[own]) + names[own].astype("<u8").tobytes())
        else:
            out.add(here, batch, _BARE, _steps(places[own]))
    for kind, chosen in ((_ASKED, order[first[~many]]), (_KNOWN, order[first[many]])):
        chosen = np.sort(chosen)
        bucket = (names[chosen] >> _U(32)).astype(np.int64)
        deal = np.argsort(bucket, kind="stable")
        chosen, bucket = chosen[deal], bucket[deal]
        low = (names[chosen] & _U(0xFFFFFFFF)).astype("<u4")
        edges = np.flatnonzero(np.diff(bucket, prepend=-1))
        for a, b in zip(edges, np.append(edges[1:], len(bucket))):
            data = low[a:b].tobytes() + (_steps(places[chosen[a:b]]) if kind == _ASKED else b"")
            out.add(int(bucket[a]), batch, kind, data)


def _names(hashes: np.ndarray, bits: int) -> np.ndarray:
    """The bucket's bits and 32 more."""
    return hashes >> _U(64 - bits - 32)


def _first_level(size: int, bits: int, named: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        batch = (TaskContext.get().partitionId() + 1) << 24
        for given in batches:
            for part in slices(given, "text"):
                batch += 1
                out = _Rows()
                w = words(part.column("text"))
                ends = np.cumsum(w.counts)
                used = np.flatnonzero(w.counts >= size)
                if not len(used):
                    continue
                keys = np.stack([np.asarray(part.column(k))[used] for k in ("key1", "key2")] + [(ends - w.counts)[used], ends[used]])
                mixed = int(mix(np.array([batch], np.uint64))[0] % (1 << bits))
                out.add(mixed, batch, _HEAD, keys.astype("<i8").tobytes())
                hashes, at = windows(w, size)
                _ask(out, batch, _names(hashes, bits), at, bits, named)
                yield from out.table().to_batches()

    return run


def _judge(bits: int, named: bool = True):
    def run(table: pa.Table) -> pa.Table:
        """Per batch: what it sent along, and the places of its questions that came more than once."""
        out, low, places, rows = _Rows(), [], [], []
        for bucket, batch, kind, data in zip(*(c.to_pylist() for c in table.columns)):
            if kind in (_HEAD, _OWN, _BARE):
                out.add(bucket, batch, kind, data)
                continue
            raw = np.frombuffer(data, np.uint8)
            n = len(raw) // (8 if kind == _ASKED else 4)
            low.append(raw[: 4 * n].view("<u4"))
            rows.append((bucket, batch, n, kind, raw[4 * n :]))
        if low:
            number = np.concatenate(low)
            weight = np.repeat([2 if r[3] == _KNOWN else 1 for r in rows], [r[2] for r in rows])
            order = np.argsort(number, kind="stable")
            ordered = number[order]
            edge = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
            total = np.add.reduceat(weight[order], edge)
            twice = np.zeros(len(number), bool)
            twice[order] = np.repeat(total > 1, np.diff(np.append(edge, len(order))))
            at = 0
            for bucket, batch, n, kind, steps in rows:
                hit = twice[at : at + n]
                if kind == _ASKED and hit.any():
                    found = _steps(_places(steps, n)[hit])
                    if named:
                        out.add(bucket, batch, _ANSWER, found + number[at : at + n][hit].tobytes())
                    else:
                        out.add(bucket, batch, _BARE, found)
                at += n
        return out.table()

    return run


def _answers(bucket: int, kind: int, data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Places and names in a row of repeats; no names where none were sent."""
    raw = np.frombuffer(data, np.uint8)
    n = len(raw) // {_OWN: 12, _ANSWER: 8, _BARE: 4}[kind]
    if kind == _BARE:
        return _places(raw, n), np.zeros(n, np.uint64)
    if kind == _OWN:
        return _places(raw[: 4 * n], n), np.frombuffer(data, "<u8", offset=4 * n)
    return _places(raw[: 4 * n], n), raw[4 * n :].view("<u4").astype(np.uint64) | _U(bucket << 32)


def _gather(table: pa.Table) -> tuple[int, np.ndarray, bytes, np.ndarray, np.ndarray]:
    """A batch's documents and its repeated windows in order of place."""
    head, places, names, batch, raw_head = np.zeros((4, 0), np.int64), [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)], 0, b""
    for bucket, batch, kind, data in zip(*(c.to_pylist() for c in table.columns)):
        if kind == _HEAD:
            head, raw_head = np.frombuffer(data, "<i8").reshape(4, -1), data
        else:
            found = _answers(bucket, kind, data)
            places.append(found[0])
            names.append(found[1])
    place, name = np.concatenate(places), np.concatenate(names)
    order = np.argsort(place)
    return batch, head, raw_head, place[order], name[order]


def _next_level(size: int, wanted: int, bits: int, named: bool):
    def run(table: pa.Table) -> pa.Table:
        batch, head, raw, place, name = _gather(table)
        out = _Rows()
        if len(place):
            there = np.searchsorted(place, place + wanted - size)
            there[there == len(place)] = 0
            doc = np.searchsorted(head[2], place, side="right") - 1
            fits = (place[there] == place + wanted - size) & (place + wanted <= head[3][doc])
            hashes = mix(mix(name[fits], 5) + name[there[fits]], 6)
            mixed = int(mix(np.array([batch], np.uint64))[0] % (1 << bits))
            if fits.any():
                out.add(mixed, batch, _HEAD, raw)
                _ask(out, batch, _names(hashes, bits), place[fits], bits, named)
        return out.table()

    return run


def _spans(size: int):
    def run(table: pa.Table) -> pa.Table:
        """Runs of covered words per document, from the places of repeated windows."""
        _, head, _, place, _ = _gather(table)
        keys1, keys2, starts, lengths = [], [], [], []
        if len(place):
            doc = np.searchsorted(head[2], place, side="right") - 1
            new = np.append(True, (place[1:] > place[:-1] + size) | (doc[1:] != doc[:-1]))
            first = np.flatnonzero(new)
            last = np.append(first[1:], len(place)) - 1
            begin, stop = place[first] - head[2][doc[first]], place[last] + size - head[2][doc[first]]
            d = doc[first]
            edges = np.flatnonzero(np.diff(d, prepend=-1))
            for a, b in zip(edges, np.append(edges[1:], len(d))):
                keys1.append(int(head[0][d[a]]))
                keys2.append(int(head[1][d[a]]))
                starts.append(begin[a:b])
                lengths.append((stop - begin)[a:b])
        kind = pa.list_(pa.int32())
        return pa.Table.from_arrays(
            [pa.array(keys1, pa.int64()), pa.array(keys2, pa.int64()), pa.array(starts, kind), pa.array(lengths, kind)],
            ["key1", "key2", "starts", "lengths"],
        )

    return run


def repeated_spans(keyed: DataFrame, window: int = WINDOW, first: int = FIRST, bucket_windows: int = BUCKET_WINDOWS) -> DataFrame:
    """key1, key2, starts, lengths: runs of words to remove, for rows (key1, key2, text)."""
    size = keyed.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    bits = int(np.clip(np.ceil(np.log2(max(1, size / 6 / bucket_windows))), 8, 24))
    levels = levels_to(window, first)
    rows = keyed.mapInArrow(_first_level(levels[0], bits, len(levels) > 1), _ROW)
    for here, following in zip(levels, [*levels[1:], None]):
        # names are needed to make longer windows; the last level's places are enough
        judged = rows.groupBy("bucket").applyInArrow(_judge(bits, following is not None), _ROW)
        by_batch = judged.groupBy("batch")
        if following is None:
            return by_batch.applyInArrow(_spans(here), "key1 long, key2 long, starts array<int>, lengths array<int>")
        rows = by_batch.applyInArrow(_next_level(here, following, bits, following != levels[-1]), _ROW)


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        n_words, n_removed, kept = [], [], []
        *given, texts, starts_of, lengths_of = batch.columns
        for text, starts, lengths in zip(texts.to_pylist(), starts_of, lengths_of):
            own = text.encode().split()  # splits bytes at exactly the six blanks
            n_words.append(len(own))
            if starts.is_valid:
                stay = np.ones(len(own), bool)
                for a, n in zip(starts.values.to_numpy(), lengths.values.to_numpy()):
                    stay[a : a + n] = False
                own = list(compress(own, stay))
            n_removed.append(n_words[-1] - len(own))
            kept.append(b" ".join(own).decode())
        found = [pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array(kept, pa.string())]
        yield pa.RecordBatch.from_arrays([*given, *found], [*batch.schema.names[:-3], *FOUND])


def remove_repeats(
    docs: DataFrame, window: int = WINDOW, first: int = FIRST, bucket_windows: int = BUCKET_WINDOWS,
    columns: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The ``columns`` of every row with n_words, n_removed, kept: the words left, joined by one blank."""
    body = text_of()
    keyed = docs.select(*columns, body.alias("_text"), F.xxhash64("doc_id", body).alias("_key1"), F.xxhash64(F.lit(1), body, "doc_id").alias("_key2"))
    named = keyed.select(F.col("_key1").alias("key1"), F.col("_key2").alias("key2"), F.col("_text").alias("text"))
    # rows alike in id and text have the same key and, as copies of each other, the same spans
    spans = repeated_spans(named, window, first, bucket_windows).dropDuplicates(["key1", "key2"])
    both = keyed.join(spans, (F.col("_key1") == F.col("key1")) & (F.col("_key2") == F.col("key2")), "left")
    found = [T.StructField(n, k()) for n, k in zip(FOUND, (T.LongType, T.LongType, T.StringType))]
    schema = T.StructType([*keyed.schema.fields[: len(columns)], *found])
    return both.select(*columns, "_text", "starts", "lengths").mapInArrow(_kept, schema)

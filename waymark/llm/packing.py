"""Packing documents into sequences by best-fit decreasing with certified bounds.

Documents are tokenized once into pieces of at most one sequence; only their lengths are packed.
Pieces are dealt into partitions of about ``GROUP`` by a hash of their place and each is packed best-fit decreasing.
Dual feasible functions give a lower bound on a partition's sequences: where it is met, nothing can
be better and the partition is final. In partitions with a gap the full sequences are final too; the
documents of the others are exchanged, dealt anew among such partitions, and packed again. A round
whose result needs no fewer sequences than what it took apart is not adopted.

Scale: token ids stay in the task that made them; what is kept, counted and exchanged is one small
row per piece. A partition is a bounded number of pieces, whatever the source or length is.

Defined cases: NULL is the empty text, one end token; every row is a document of its own, also
repeated ones; other columns do not matter; a text longer than a sequence is cut, its first piece
the shorter; no rows give no rows.
"""

from __future__ import annotations

import functools
import zlib
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.llm.common import checkpointed, text_of
from waymark.llm.wordhash import slices

SEQUENCE, GROUP, ROUNDS = 2048, 4096, 3
END_ID = 0


@functools.lru_cache(maxsize=2)
def encoder(ranks_path: str, json_path: str | None = None, special: str = "<|endoftext|>", special_id: int = 50256):
    """The byte-level vocabulary; the special token's text is read as that token, as its library does.

    Ranks are the fast way. They find words by a pattern that gives up on very long runs of blanks; such
    a text goes to the library the vocabulary file at ``json_path`` is written for, which has no such limit."""
    import base64

    import public_tokenizers
    import tiktoken

    ranks = {}
    with open(ranks_path, "rb") as lines:
        for line in lines:
            token, rank = line.split()
            ranks[base64.b64decode(token)] = int(rank)
    made = tiktoken.Encoding(
        "bytes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={special: special_id}
    )

    @functools.cache
    def library():
        from tokenizers import Tokenizer

        return Tokenizer.from_file(json_path)

    def encode(text: str) -> list[int]:
        try:
            return made.encode(text, allowed_special="all")
        except ValueError:  # the pattern's stack
            if json_path is None:
                raise
            return library().encode(text, add_special_tokens=False).ids

    return encode


def cut(total: int, size: int = SEQUENCE) -> list[tuple[int, int]]:
    """(start, length) of the pieces of ``total`` tokens; only the first may be short."""
    lead = total % size
    return ([(0, lead)] if lead else []) + [(s, size) for s in range(lead, total, size)]


def pieces(
    docs: DataFrame, ranks_path: str, json_path: str | None = None, size: int = SEQUENCE, with_ids: bool = False,
    columns: Sequence[str] = ("doc_id",),
) -> DataFrame:
    """The ``columns`` of each row with piece, start, length, ids_crc32 and, if asked for, the ids. No shuffle."""
    given = docs.select(*columns, text_of().alias("_text"))
    names = [*columns, "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(ranks_path, json_path)
        for batch in batches:
            for part in slices(batch, "_text"):
                made: list[tuple] = []
                doc: list[int] = []
                for i, text in enumerate(part.column("_text").to_pylist()):
                    ids = np.array(encode(text) + [END_ID], "<u4")
                    for k, (start, length) in enumerate(cut(len(ids), size)):
                        own = ids[start : start + length]
                        made.append((k, start, length, zlib.crc32(own.data), own) if with_ids else (k, start, length, zlib.crc32(own.data)))
                        doc.append(i)
                kinds = [pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32())]
                found = [pa.array(x, t) for x, t in zip(zip(*made), kinds)] if made else []
                if found:
                    kept = [c.take(pa.array(doc)) for c in part.columns[:-1]]
                    yield pa.RecordBatch.from_arrays([*kept, *found], names)

    kinds = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids_crc32": T.LongType(), "ids": T.ArrayType(T.IntegerType())}
    schema = T.StructType([*given.schema.fields[:-1], *[T.StructField(n, kinds[n]) for n in names[len(columns) :]]])
    return given.mapInArrow(run, schema)


def best_fit_decreasing(lengths: np.ndarray, size: int = SEQUENCE) -> tuple[np.ndarray, np.ndarray]:
    """Sequence and offset of each item: longest first, each to the fullest sequence that still holds it."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    free: list[list[int]] = [[] for _ in range(size + 1)]  # open sequences by what is left in them
    some = 0  # bit r: a sequence with r left
    n = 0
    for i in order.tolist():
        length = int(lengths[i])
        fits = some >> length
        if fits:
            left = length + (fits & -fits).bit_length() - 1
            b = free[left].pop()
            if not free[left]:
                some &= ~(1 << left)
        else:
            b, left, n = n, size, n + 1
        bins[i], offsets[i] = b, size - left
        left -= length
        if left:
            free[left].append(b)
            some |= 1 << left
    return bins, offsets


def lower_bound(lengths: np.ndarray, size: int = SEQUENCE, most: int = 40) -> int:
    """No packing needs fewer sequences: the best of two families of dual feasible functions.

    One counts what exceeds size - a as whole, keeps what lies between a and that, and drops what is
    below a; the other rounds (k + 1) x down to multiples of 1 / k unless it is whole.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=size + 1)[: size + 1].astype(np.int64)
    numbers = np.cumsum(count)
    sums = np.cumsum(count * np.arange(size + 1))
    a = np.arange(0, size // 2 + 1)
    whole = numbers[size] - numbers[size - a]
    middle = sums[size - a] - np.where(a > 0, sums[np.maximum(a - 1, 0)], 0)
    # items over half a sequence take one each at least
    half = numbers[size] - numbers[size // 2]
    best = max(int((whole + -(-middle // size)).max()), int(half))
    big = numbers[size - a] - numbers[size // 2]
    small = sums[size // 2] - np.where(a > 0, sums[np.maximum(a - 1, 0)], 0)
    room = big * size - (sums[size - a] - sums[size // 2])
    best = max(best, int((half + np.maximum(0, -(-(small - room) // size))).max()))
    x = np.arange(size + 1, dtype=np.int64)
    for k in range(1, most):
        scaled = (k + 1) * x
        value = np.where(scaled % size == 0, x * k, (scaled // size) * size)  # times size * k
        best = max(best, int(-(-int((value * count).sum()) // (size * k))))
    return best


def _packed(size: int):
    def run(group: pa.Table) -> pa.Table:
        lengths = np.asarray(group.column("length"))
        bins, offsets = best_fit_decreasing(lengths, size)
        n = int(bins.max(initial=-1)) + 1
        filled = np.bincount(bins, weights=lengths, minlength=n)
        final = np.full(n, n == lower_bound(lengths, size)) | (filled == size)
        for name, values in (("bin", bins), ("offset", offsets), ("final", final[bins])):
            group = group.append_column(name, pa.array(values))
        return group

    return run


def pack(made: DataFrame, size: int = SEQUENCE, group: int = GROUP, rounds: int = ROUNDS) -> DataFrame:
    """The pieces with sequence_id and offset. ``made`` is read several times and its rows are told apart by their
    place: keep it first. After ``rounds`` rounds partitions may be left that are not certified."""
    columns = made.columns
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in made.schema)
    rest, done = made, None
    for turn in range(rounds):
        groups = max(1, -(-rest.count() // group))
        # by a number of the row: equal pieces, however many, spread over all groups
        key = F.pmod(F.xxhash64(F.lit(turn), F.monotonically_increasing_id()), F.lit(groups))
        packed = checkpointed(
            rest.select(*columns, *(["_old"] if turn else [])).withColumn("_group", key).groupBy("_group").applyInArrow(
                _packed(size), f"{schema}, {'_old long, ' * bool(turn)}_group long, bin long, offset long, final boolean"
            )
        )
        number = F.lit(turn << 56) + F.col("_group") * (1 << 28) + F.col("bin")
        packed = packed.withColumn("sequence_id", number)
        if turn:
            before, now = rest.select("_old").distinct().count(), packed.select("sequence_id").distinct().count()
            if now >= before:
                break
        done_now = packed.filter("final").select(*columns, "sequence_id", "offset")
        done = done_now if done is None else done.unionByName(done_now)
        rest = packed.filter(~F.col("final")).select(*columns, F.col("sequence_id").alias("_old"), F.col("offset").alias("_at"))
        if rest.isEmpty():
            break
    last = rest.select(*columns, F.col("_old").alias("sequence_id"), F.col("_at").alias("offset")) if "_old" in rest.columns else None
    return done if last is None else done.unionByName(last)

"""Exact repeats, told by a minimal perfect hash over the digests already held.

Rows come in two parts: a history and new rows. The history's distinct digests are dealt into
buckets by their leading bits, and each bucket gets a minimal perfect hash (``perfect_hash``) whose
slots hold the full digest, the locator of its winner (id and row number) and the number of rows. A new
digest is looked up in its bucket and compared with the slot's 32 bytes: equal ones are repeats of the
winner, all others group among themselves. The index is a table that can be written and used again.

How it moves: a row is its digest, id and number; texts stay where they are. Digests are
counted map-side first, so a group of any size reaches a bucket as one entry per task. Buckets are
even, as digests are. At the end each row meets the verdict on its digest: groups above
1 / ``HOT_SHARE`` of all rows (so fewer than that many) by a broadcast, the others by a join.

Defined cases: NULL counts as the empty text, and every run of blanks counts as one blank, leading and
trailing ones too. The least id of a group stays, rows without an id come last, and of repeated rows
with one id the one read first stays. Extra columns do not matter. No rows give no rows, and an
empty history or no new rows leave the other part as it is. Ids are whole numbers.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from waymark.llm import perfect_hash
from waymark.llm.common import checkpointed, text_of

BLANKS = r"[\x20\x09-\x0D]+"
BUCKET_DIGESTS = 4_096  # digests of a bucket, about
HOT_SHARE, HOT_LEAST = 2_000, 100  # groups above rows / HOT_SHARE are hot, and none up to HOT_LEAST rows
INDEX_DDL = (
    "bucket int, sizes array<long>, bits binary, digests binary, keep_id array<long>, keep_row array<long>, "
    "n_rows array<long>"
)
VERDICT_DDL = "digest binary, keep_id long, keep_row long, group_size long"


def normal_text(c="text") -> Column:
    """The text with each run of blanks as one blank."""
    return F.regexp_replace(text_of(c), BLANKS, " ")


def digests(docs: DataFrame) -> DataFrame:
    """row, doc_id, digest of every row, kept once: later steps read these and no texts."""
    rows = docs.select(
        F.monotonically_increasing_id().alias("row"), F.col("doc_id").cast("long").alias("doc_id"),
        F.unhex(F.sha2(normal_text(), 256)).alias("digest"),
    )
    return checkpointed(rows)


def groups(rows: DataFrame) -> DataFrame:
    """digest, keep_id, keep_row, n_rows: one row for each distinct digest, with its winner."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row"))
    return rows.groupBy("digest").agg(first.alias("first"), F.count(F.lit(1)).alias("n_rows")).select(
        "digest", F.col("first.doc_id").alias("keep_id"), F.col("first.row").alias("keep_row"), "n_rows"
    )


def bucket_bits(n: int, wanted: int = BUCKET_DIGESTS) -> int:
    """Leading bits that deal ``n`` digests into buckets of about ``wanted``."""
    return int(np.clip(np.ceil(np.log2(max(1, n / wanted))), 3, 30))


def bucket_of(digest, bits: int) -> Column:
    lead = F.conv(F.hex(F.substring(digest, 1, 4)), 16, 10).cast("long")
    return F.shiftright(lead, 32 - bits).cast("int")


def _index(table: pa.Table) -> pa.Table:
    keys = perfect_hash.as_words(table.column("digest").to_pylist())
    h = perfect_hash.build(keys)
    slot = perfect_hash.slots(h, keys)
    order = np.argsort(slot)
    by_slot = table.take(pa.array(order))
    columns = {
        "bucket": pa.array([table.column("bucket")[0].as_py()], pa.int32()),
        "sizes": pa.array([h.sizes], pa.list_(pa.int64())),
        "bits": pa.array([np.packbits(h.bits).tobytes()], pa.binary()),
        "digests": pa.array([keys[order].tobytes()], pa.binary()),
    }
    for name in ("keep_id", "keep_row", "n_rows"):
        columns[name] = pa.array([by_slot.column(name).to_pylist()], pa.list_(pa.int64()))
    return pa.table(columns)


def build_index(history: DataFrame, bits: int) -> DataFrame:
    """One row per bucket: the perfect hash of its digests and the slots, for :func:`groups` rows."""
    return history.withColumn("bucket", bucket_of("digest", bits)).groupBy("bucket").applyInArrow(_index, INDEX_DDL)


def _look_up(index: pa.Table, asked: pa.Table) -> pa.Table:
    """Verdicts of one bucket: every slot, with the new rows that repeat it, and the nonmembers."""
    new = perfect_hash.as_words(asked.column("digest").to_pylist())
    n_new = np.asarray(asked.column("n_rows")).astype(np.int64)
    out = {"digest": [], "keep_id": [], "keep_row": [], "group_size": []}

    def add(digest, keep_id, keep_row, size) -> None:
        for name, values in zip(out, (digest, keep_id, keep_row, size)):
            out[name].extend(values)

    slot = np.full(len(new), -1, np.int64)
    if len(index):
        line = index.to_pylist()[0]
        sizes = np.array(line["sizes"], np.int64)
        bits = np.unpackbits(np.frombuffer(line["bits"], np.uint8), count=int(sizes.sum())).astype(bool)
        held = np.frombuffer(line["digests"], "<u8").reshape(-1, perfect_hash.BYTES // 8)
        slot = perfect_hash.found(perfect_hash.restored(sizes, bits), held, new)
        size = np.array(line["n_rows"], np.int64)
        np.add.at(size, slot[slot >= 0], n_new[slot >= 0])
        add([k.tobytes() for k in held], line["keep_id"], line["keep_row"], size.tolist())
    rest = asked.take(pa.array(np.flatnonzero(slot < 0)))
    add(*(rest.column(c).to_pylist() for c in ("digest", "keep_id", "keep_row", "n_rows")))
    kinds = (pa.binary(), pa.int64(), pa.int64(), pa.int64())
    return pa.table({name: pa.array(values, kind) for (name, values), kind in zip(out.items(), kinds)})


def verdicts(index: DataFrame, new: DataFrame, bits: int) -> DataFrame:
    """digest, keep_id, keep_row, group_size of all digests held or new, for an index and :func:`groups` of new rows."""
    asked = new.withColumn("bucket", bucket_of("digest", bits))
    return index.groupBy("bucket").cogroup(asked.groupBy("bucket")).applyInArrow(_look_up, VERDICT_DDL)


def judge(rows: DataFrame, said: DataFrame, n: int) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest for each of ``n`` rows."""
    limit = max(HOT_LEAST, n // HOT_SHARE)
    said = said.select(F.col("digest").alias("of"), "keep_id", "keep_row", "group_size")
    # fewer than HOT_SHARE groups, or n / HOT_LEAST where that is less, have more rows than the limit
    few = F.broadcast(said.filter(F.col("group_size") > limit))
    near = rows.join(few, rows["digest"] == F.col("of"), "left")
    hot = near.filter(F.col("of").isNotNull())
    rest = near.filter(F.col("of").isNull()).select(*rows.columns)
    cold = rest.join(said.filter(F.col("group_size") <= limit), rest["digest"] == F.col("of"))
    out = ["doc_id", "keep_id", "group_size", (F.col("row") == F.col("keep_row")).alias("kept"), "digest"]
    return hot.select(*out).unionByName(cold.select(*out))


def drop_repeats(docs: DataFrame, is_history: Column, bucket_digests: int = BUCKET_DIGESTS) -> DataFrame:
    """doc_id, keep_id, group_size, kept, digest of every row.

    Rows for which ``is_history`` (over doc_id; NULL counts as new) holds make the index. Of equal texts
    the winner is the history's least id if it has one, else that of the new rows. Runs jobs when called: digests,
    index and verdicts are kept in the checkpoint folder."""
    rows = digests(docs)
    old = F.coalesce(is_history, F.lit(False))
    n, n_old = rows.agg(F.count(F.lit(1)), F.count_if(old)).first()
    bits = bucket_bits(n_old or n, bucket_digests)
    index = checkpointed(build_index(groups(rows.filter(old)), bits))
    return judge(rows, checkpointed(verdicts(index, groups(rows.filter(~old)), bits)), n)


def earlier_half(docs: DataFrame) -> Column:
    """Rows up to about the middle id, as a history that came before the rest."""
    middle = docs.agg(F.percentile_approx("doc_id", 0.5)).first()[0]
    return F.col("doc_id") <= F.lit(middle) if middle is not None else F.lit(False)

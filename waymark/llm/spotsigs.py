"""SpotSigs: a text as the set of chains of content words that follow common words.

A spot is a run of common words and the content word behind it, chained with the next content
words to ``CHAIN`` in all; a signature is the spot's 64-bit hash. Text around the running prose,
such as tables and lists of links, has few common words and leaves no spots. A text with words
but no full spot has one signature of all its words.

The fingerprint is the sorted set in hex, so equal texts have equal fingerprints. Sets compare by
Jaccard; ``similar`` first splits sets by length: sizes of similar sets differ by no more than the
factor ``tau``, so a set only meets its own length partition and the next one.

Defined cases: NULL is the empty text; a text without words has the empty fingerprint; the
likeness of equal sets is 1, of an empty and another set 0; repeated rows each give a row; extra
columns stay. Whole texts of any length, DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from waymark.llm.common import checkpointed, numbered, text_of
from waymark.llm.neighbours import with_next

#: Common words of English, German, French and Spanish that anchor a spot.
ANCHORS = (
    "the of and to in is that for it as was with be by on are this from at an a "
    "der die und das den von zu mit sich des auf ist im dem nicht ein eine als auch es an er "
    "de la le les et en un une que est pour dans qui par sur pas au plus ne se ce "
    "el los las y del con para por una su al lo como más pero sus"
).split()
CHAIN = 3
_BREAK = r"[^\p{L}\p{N}]+"


def with_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Adds ``out``: the sorted distinct signatures of a text column as an array of longs."""
    words = F.filter(F.split(F.lower(text_of(text)), _BREAK), lambda w: w != "")
    df = df.withColumn("_words", words)
    # "the of foo bar" becomes the units "the of foo" and "bar"
    marked = F.transform("_words", lambda w: F.when(w.isin(ANCHORS), F.concat(w, F.lit(" "))).otherwise(F.concat(w, F.lit("\n"))))
    df = df.withColumn("_units", F.split(F.array_join(marked, ""), "\n"))
    df = df.withColumn("_content", F.transform("_units", lambda u: F.substring_index(u, " ", -1)))
    last = F.size("_units") - chain - 1  # the piece behind the last line break is no unit
    places = F.when(last >= 0, F.sequence(F.lit(0), last)).otherwise(F.expr("CAST(array() AS array<int>)"))
    spots = F.filter(places, lambda i: F.contains(F.get("_units", i), F.lit(" ")))
    chained = F.transform(
        spots,
        lambda i: F.xxhash64(F.get("_units", i), *[F.get("_content", i + F.lit(k)) for k in range(1, chain)]),
    )
    df = df.withColumn("_spots", F.array_sort(F.array_distinct(chained)))
    whole = F.when(F.size("_words") > 0, F.array(F.xxhash64(F.array_join("_words", " ")))).otherwise(
        F.expr("CAST(array() AS array<bigint>)")
    )
    return df.withColumn(out, F.when(F.size("_spots") > 0, F.col("_spots")).otherwise(whole)).drop(
        "_words", "_units", "_content", "_spots"
    )


def as_text(signatures) -> Column:
    """A fingerprint as text: every signature as 16 hex digits, in order."""
    return F.array_join(F.transform(signatures, lambda s: F.lpad(F.hex(s), 16, "0")), "")


def likeness(a: str, b: str) -> Column:
    """Jaccard of two signature arrays."""
    both = F.size(F.array_intersect(a, b))
    return F.when(F.col(a) == F.col(b), F.lit(1.0)).when(
        (F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)
    ).otherwise(both / (F.size(a) + F.size(b) - both))


def beside_next(docs: DataFrame) -> DataFrame:
    """doc_id, n_chars, edited, and the signatures sig, edited_sig, next_sig of every row.

    ``edited`` ends with the beginning of the next text in place of its own second half. Rows follow each other
    by (doc_id, row), ids that are NULL last; every row is a document of its own, whatever its id."""
    rows = numbered(docs.select("doc_id", "text")).withColumn("text", text_of())
    sizes = rows.select("_row", "doc_id", F.floor(F.length("text") / 2).alias("half"))
    order = with_next(sizes, ["doc_id", "_row"], "_row", "next_row")
    # what a document gives to the one before it: its first code points and its fingerprint
    asked = order.select(
        F.col("next_row").alias("_row"), F.col("_row").alias("to"), F.col("doc_id").alias("to_id"), F.col("half").alias("wanted")
    )
    # both readings of the texts take the same columns, so their exchange is one
    texts = rows.select("_row", "text")
    given = with_signatures(texts.join(asked, "_row"), "text", "next_sig").select(
        F.col("to").alias("_row"), F.col("to_id").alias("doc_id"), "next_sig", F.left("text", F.col("wanted").cast("int")).alias("given")
    )
    both = texts.join(given, "_row")
    n = F.length("text")
    both = both.withColumn("edited", F.concat(F.left("text", (n - F.floor(n / 2)).cast("int")), "given"))
    both = with_signatures(with_signatures(both, "text", "sig"), "edited", "edited_sig")
    return both.select("doc_id", n.cast("long").alias("n_chars"), "edited", "sig", "edited_sig", "next_sig")


def length_partition(size, tau: float) -> Column:
    """Partitions whose upper end is 1 / tau times the lower: similar sets are in one or in neighbours."""
    return F.floor(F.log(F.greatest(size, F.lit(1)).cast("double")) / F.log(F.lit(1 / tau))).cast("int")


def similar(docs: DataFrame, tau: float = 0.75) -> tuple[DataFrame, DataFrame]:
    """Classes of equal sets, and the pairs of classes with a Jaccard of ``tau`` or more.

    First result: doc_id, class_id (the least doc_id with that set). Second: a, b, jaccard with
    a < b over class ids. Each set sends its rarest signatures only, as many as a partner cannot
    miss all of, keyed by length partition; a smaller partner is looked for there too. Texts
    without words are in no pair.
    """
    sets = checkpointed(with_signatures(docs.select("doc_id", "text"), "text", "sig").select(
        "doc_id", "sig", F.sha2(as_text("sig"), 256).alias("key")
    ))
    first = sets.groupBy("key").agg(F.min("doc_id").alias("class_id"))
    members = sets.select("doc_id", "key").join(first, "key").select("doc_id", "class_id")
    own = sets.join(first, (sets["key"] == first["key"]) & (sets["doc_id"] == first["class_id"])).select(
        "class_id", "sig", F.size("sig").alias("n")
    ).filter(F.col("n") > 0).dropDuplicates(["class_id"])
    own = checkpointed(own)
    each = own.select("class_id", "n", F.explode("sig").alias("s"))
    number = each.groupBy("s").agg(F.count(F.lit(1)).alias("df"))
    rarest = Window.partitionBy("class_id").orderBy("df", "s")
    prefix = (
        each.join(number, "s").withColumn("_r", F.row_number().over(rarest))
        .filter(F.col("_r") <= F.col("n") - F.ceil(tau * F.col("n")) + 1)
        .select("class_id", "n", "s", length_partition("n", tau).alias("part"))
    )
    up = prefix.select(F.col("class_id").alias("b"), F.col("n").alias("nb"), "s", F.explode(F.array("part", F.col("part") + 1)).alias("part"))
    left = prefix.withColumnRenamed("class_id", "a").withColumnRenamed("n", "na")
    found = left.join(up, ["s", "part"]).filter(
        ((F.col("nb") < F.col("na")) | ((F.col("nb") == F.col("na")) & (F.col("b") < F.col("a")))) & (F.col("nb") >= tau * F.col("na"))
    ).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
    right = own.select(F.col("class_id").alias("b"), F.col("sig").alias("sb"))
    pairs = found.join(own.select(F.col("class_id").alias("a"), F.col("sig").alias("sa")), "a").join(right, "b")
    return members, pairs.select("a", "b", likeness("sa", "sb").alias("jaccard")).filter(F.col("jaccard") >= tau)

"""Quality by compression bands over whole documents and fixed chunks.

The ratio of UTF-8 bytes to zstandard bytes of a clean text lies in a band that rises with its
length: what is far above repeats itself, what is far below is noise. The whole document and each
fixed chunk are judged with the band of their own length, a short tail together with the chunk before it; a document fails with its whole ratio
outside, or with more than ``BAD_CHUNKS`` of its chunks outside.

Defined cases: NULL and empty texts have no words and fail the base rules; repeated rows each give a
row; other columns do not matter; whole texts of any length are read, 4 MB of texts at a time.
No shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from waymark.llm.wordhash import mix, slices, windows, words

#: From this many bytes on: the lowest and the highest ratio let through.
BANDS = ((0, 0.0, 2.0), (64, 0.7, 2.3), (192, 1.0, 2.6), (512, 1.25, 2.9), (1536, 1.5, 3.2), (8192, 1.6, 3.6))
CHUNK, LEAST_CHUNK, BAD_CHUNKS, LEVEL = 4096, 512, 0.25, 3
#: Base rules: fewest words, and the share of words in repeated windows of WINDOW words.
LEAST_WORDS, WINDOW, MOST_REPEATED = 20, 8, 30
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_BLANKS = " \t\n\v\f\r"
FIELDS = {
    "n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long",
    "ratio": "double", "n_chunks": "long", "bad_chunks": "long", "base_failed": "boolean", "kept": "boolean",
}


def inside_band(size: int, ratio: float, bands=BANDS) -> bool:
    _, low, high = max(b for b in bands if b[0] <= size)
    return low <= ratio <= high


def repeated_words(w, size: int = WINDOW) -> np.ndarray:
    """Whether each word lies in a run of ``size`` words that its text holds twice or more."""
    hashes, at = windows(w, size)
    key = hashes ^ mix(w.doc[at].astype(np.uint64), 7)
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(key), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(w.hashes) + 1, np.int32)
    np.add.at(cover, at[twice], 1)
    np.add.at(cover, at[twice] + size, -1)
    return np.cumsum(cover)[:-1] > 0


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(flags, dtype=np.int64)])
    return total[offsets[1:]] - total[offsets[:-1]]


def chunks(raw: bytes, size: int = CHUNK, least: int = LEAST_CHUNK) -> list[bytes]:
    """Pieces of ``size`` bytes of a text longer than that; a last one below ``least`` stays with the one before."""
    if len(raw) <= size:
        return []
    ends = list(range(size, len(raw), size))
    if len(raw) - ends[-1] < least:
        ends.pop()
    return [raw[a:b] for a, b in zip([0, *ends], [*ends, len(raw)])]


def judge(texts: pa.Array, compressor, bands=BANDS, chunk: int = CHUNK, bad_share: float = BAD_CHUNKS) -> dict[str, np.ndarray]:
    w = words(texts)
    n = len(texts)
    head = (w.data & 0xC0) != 0x80
    chars = np.concatenate([[0], np.cumsum(head, dtype=np.int64)])
    bounds = np.concatenate([[0], np.cumsum(w.counts)])
    length = np.concatenate([[0], np.cumsum(chars[w.end] - chars[w.start])])
    out = {k: np.zeros(n, np.float64 if t == "double" else bool if t == "boolean" else np.int64) for k, t in FIELDS.items()}
    out["n_words"] = w.counts.astype(np.int64)
    out["word_chars"] = length[bounds[1:]] - length[bounds[:-1]]
    out["n_symbols"] = _per_text(_SYMBOL[w.data], w.offsets)
    out["n_repeat_words"] = _per_text(repeated_words(w), bounds)
    size = lambda b: len(b) / len(compressor.compress(b)) if b else 0.0
    for i, text in enumerate(texts.to_pylist()):
        if not text:
            continue
        lines = [x for x in text.split("\n") if x.strip(_BLANKS)]
        out["n_dup_lines"][i] = len(lines) - len(set(lines))
        raw = w.data[w.offsets[i] : w.offsets[i + 1]].tobytes()
        out["ratio"][i] = size(raw)
        parts = chunks(raw, chunk)
        out["n_chunks"][i] = len(parts)
        out["bad_chunks"][i] = sum(not inside_band(len(p), size(p), bands) for p in parts)
        out["kept"][i] = inside_band(len(raw), out["ratio"][i], bands) and out["bad_chunks"][i] <= bad_share * len(parts)
    out["base_failed"] = (out["n_words"] < LEAST_WORDS) | (100 * out["n_repeat_words"] > MOST_REPEATED * out["n_words"])
    out["kept"] &= ~out["base_failed"]
    return out


def quality(docs: DataFrame, bands=BANDS, chunk: int = CHUNK, bad_share: float = BAD_CHUNKS, level: int = LEVEL) -> DataFrame:
    """doc_id with the base counts, the whole ratio, chunks outside their band, and the verdict."""
    given = docs.select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        compressor = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            for part in slices(batch, "text"):
                found = judge(part.column("text"), compressor, bands, chunk, bad_share)
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), *(pa.array(found[k]) for k in FIELDS)], ["doc_id", *FIELDS]
                )

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, " + ", ".join(f"{k} {t}" for k, t in FIELDS.items()))

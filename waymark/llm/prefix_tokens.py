"""Exact token counts of every prefix of a text, for a BPE model with byte fallback.

The model reads blanks as one mark that its pieces hold only in front, so no merge crosses the end of
a word: the count up to a word's end is the count up to its start plus the word's own. ``prefix_table``
runs that recurrence over a text and keeps the count at every word end. Inside a word,
``inside_counts``, which ``longest_prefix`` asks for the word where a budget ends, goes on letter by letter: the last token of a prefix is the one vocabulary item
that ends there and may follow the last token of what stands before it, so its count is that
prefix's count plus one. Budgets and cuts are then look-ups; no text is encoded again.

Defined cases: NULL is the empty text with no tokens and empty arrays; repeated rows each give a
row; other columns do not matter; texts of any length, a slice of a batch at a time.
"""

from __future__ import annotations

import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from waymark.llm.common import text_of
from waymark.llm.wordhash import slices

MARK = "▁"  # what the model reads a blank as
_WORD = re.compile(f"{MARK}+[^{MARK}]*")
CACHE = 1 << 18  # words a worker remembers


class Model:
    """A tokenizer file with the counts of the words met so far."""

    def __init__(self, path: str):
        import sentencepiece

        self.library = sentencepiece.SentencePieceProcessor(model_file=path)
        self.known: dict[str, int] = {}
        self.joined: dict[tuple[str, str], bool] = {}

    def split(self, text: str) -> list[str]:
        return _WORD.findall(MARK + text.replace(" ", MARK)) if text else []

    def learn(self, words: list[str]) -> None:
        """Counts of words not met yet, encoded together, each once."""
        new = [w for w in set(words) if w not in self.known]
        if len(self.known) + len(new) > CACHE:
            self.known = {}
            new = list(set(words))
        # the library puts the first mark there itself; a mark alone is one piece
        found = self.library.encode([w[1:] for w in new], num_threads=1)
        self.known.update((w, len(t) if len(w) > 1 else 1) for w, t in zip(new, found))

    @functools.cached_property
    def scores(self) -> dict[str, float]:
        lib = self.library
        return {
            lib.id_to_piece(i): lib.get_score(i) for i in range(lib.get_piece_size())
            if not (lib.is_control(i) or lib.is_unknown(i) or lib.is_byte(i))
        }

    def merged(self, text: str) -> list[str]:
        """Pieces by merging the best scored pair, the leftmost of equals, until none is left."""
        parts = list(text)
        while True:
            best = max(
                ((self.scores.get(a + b, -np.inf), -i) for i, (a, b) in enumerate(zip(parts, parts[1:]))),
                default=(-np.inf, 0),
            )
            if best[0] == -np.inf:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, last: str, piece: str) -> bool:
        key = (last, piece)
        if key not in self.joined:
            self.joined[key] = self.merged(last + piece) == ([last, piece] if last else [piece])
        return self.joined[key]

    def inside_counts(self, word: str) -> list[int]:
        """Token counts of the prefixes of one marked word, by length from 0."""
        longest = max(map(len, self.scores))
        last, counts = [""], [0]
        for end in range(1, len(word) + 1):
            for size in range(min(end, longest), 0, -1):
                piece = word[end - size : end]
                if (size == 1 or piece in self.scores) and self.follows(last[end - size], piece):
                    break
            cost = 1 if piece in self.scores else len(piece.encode())
            last.append(piece)
            counts.append(counts[end - len(piece)] + cost)
        return counts


@functools.lru_cache(maxsize=2)
def model_at(path: str) -> Model:
    return Model(path)


def prefix_table(docs: DataFrame, path: str) -> DataFrame:
    """doc_id, n_bytes, ends: code points before each word end, tokens: exact count up to there.

    No shuffle; a slice of about 4 MB of text is held at a time.
    """
    given = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            for part in slices(batch, "text"):
                split = [model.split(t) for t in part.column("text").to_pylist()]
                words = [w for s in split for w in s]
                model.learn(words)
                bounds = np.concatenate([[0], np.cumsum([len(s) for s in split])]).astype(np.int32)
                counts = np.fromiter(map(model.known.__getitem__, words), np.int64, len(words))
                lengths = np.fromiter(map(len, words), np.int64, len(words))
                first = np.repeat(bounds[:-1], np.diff(bounds))
                sums = [np.concatenate([[0], np.cumsum(x)]) for x in (lengths, counts)]
                ends, tokens = (s[1:] - s[first] for s in sums)
                columns = [
                    part.column("doc_id"),
                    pa.compute.cast(pa.compute.binary_length(part.column("text")), pa.int64()),
                    pa.ListArray.from_arrays(bounds, pa.array(ends - 1, pa.int32())),
                    pa.ListArray.from_arrays(bounds, pa.array(tokens, pa.int32())),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_bytes", "ends", "tokens"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_bytes long, ends array<int>, tokens array<int>")


def token_count(tokens="tokens"):
    """Tokens of the whole text, from its prefix table."""
    return F.coalesce(F.try_element_at(tokens, F.lit(-1)), F.lit(0)).cast("long")


def cut_point(table: DataFrame, budget: int) -> DataFrame:
    """Adds kept (code points) and kept_tokens: the longest prefix ending at a word end within the budget."""
    k = F.size(F.filter("tokens", lambda t: t <= budget))
    at = lambda c: F.coalesce(F.get(c, k - 1), F.lit(0))
    return table.withColumns({"kept": at("ends"), "kept_tokens": at("tokens")})


def longest_prefix(docs: DataFrame, path: str, budget: int) -> DataFrame:
    """doc_id, n_bytes, n_tokens, kept, kept_tokens: code points and tokens of the longest prefix within the budget.

    The prefix may end inside a word. Only where the whole text is over the budget the word in which it ends is
    gone through letter by letter; texts without blanks are one such word. No shuffle."""
    given = docs.select("doc_id", text_of().alias("text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = model_at(path)
        for batch in batches:
            for part in slices(batch, "text"):
                texts = part.column("text").to_pylist()
                split = [model.split(t) for t in texts]
                model.learn([w for s in split for w in s])
                found = []
                for text, own in zip(texts, split):
                    tokens = np.cumsum([model.known[w] for w in own], dtype=np.int64)
                    total = int(tokens[-1]) if len(own) else 0
                    if total <= budget:
                        found.append((total, len(text), total))
                    else:
                        ends = np.cumsum([len(w) for w in own]) - 1
                        found.append((total, *cut_inside(text, ends.tolist(), tokens.tolist(), budget, model)))
                columns = [pa.array([f[k] for f in found], pa.int64()) for k in range(3)]
                n_bytes = pa.compute.cast(pa.compute.binary_length(part.column("text")), pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), n_bytes, *columns], ["doc_id", "n_bytes", "n_tokens", "kept", "kept_tokens"])

    kind = given.schema["doc_id"].dataType.simpleString()
    return given.mapInArrow(run, f"doc_id {kind}, n_bytes long, n_tokens long, kept long, kept_tokens long")


def cut_inside(text: str, ends: list[int], tokens: list[int], budget: int, model: Model) -> tuple[int, int]:
    """Code points and tokens of the longest prefix at all within the budget, found from the table."""
    k = int(np.searchsorted(np.asarray(tokens, dtype=np.int64), budget, side="right"))
    kept, used = (ends[k - 1], tokens[k - 1]) if k else (0, 0)
    if k == len(ends) or budget <= 0:
        return kept, used
    lead = 1 if not k else 0  # the mark before the first word is no code point of the text
    word = MARK * lead + text[kept : ends[k]].replace(" ", MARK)
    inside = [(n - lead, used + c) for n, c in enumerate(model.inside_counts(word)) if used + c <= budget]
    more = max((x for x in inside if x[0] > 0), default=(0, used))
    return (kept + more[0], more[1]) if more[0] else (kept, used)

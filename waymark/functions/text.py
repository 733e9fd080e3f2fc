"""Text columns: hashes, excerpts, fenced code, incomplete answers."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from waymark.functions.columns import as_col

# --- fixed values: patterns that decide what counts as code or a placeholder
FENCE = r"(?is)```(?:python|py)?\s*\n(.*?)```"
PLACEHOLDERS = (
    r"\bpass\b",
    r"TODO",
    r"NotImplementedError",
    r"your code here",
    r"placeholder",
)
PLACEHOLDER_MAX_LINES = 4
# ----------------------------------------------------------------------------

# What Python strips: wider than the engine's trim(), which knows blanks only.
_SPACE = r"[\s\x1c-\x1f\x85\u00a0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]"
_LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def strip(c) -> Column:
    return F.regexp_replace(as_col(c), rf"^{_SPACE}+|{_SPACE}+\z", "")


def sha256_text(c) -> Column:
    return F.sha2(F.coalesce(as_col(c), F.lit("")), 256)


def stable_seed(key, seed) -> Column:
    """First 8 hex digits of SHA-256 over ``key:seed`` as an integer."""
    seed = F.lit(seed) if isinstance(seed, int) else as_col(seed)
    digest = F.sha2(F.concat_ws(":", as_col(key), seed.cast("string")), 256)
    return F.conv(F.substring(digest, 1, 8), 16, 10).cast("long")


def excerpt(c, length: int) -> Column:
    return F.nullif(F.substring(as_col(c), 1, length), F.lit(""))


def extract_code(c) -> Column:
    """Body of the first fence, otherwise the whole answer; outer space removed."""
    answer = F.coalesce(as_col(c), F.lit(""))
    body = F.when(answer.rlike(FENCE), F.regexp_extract(answer, FENCE, 1)).otherwise(answer)
    return strip(body)


def incomplete_reason(code, entry_point) -> Column:
    """Why an answer cannot be run, or NULL when it can be tried."""
    body = strip(F.coalesce(as_col(code), F.lit("")))
    entry = as_col(entry_point)
    lines = F.filter(F.split(body, _LINE_BREAK), lambda x: strip(x) != "")
    out = F.when(body == "", "no code in the answer").when(
        ~F.contains(body, F.concat(F.lit("def "), entry)),
        F.concat(F.lit("function not defined: "), entry),
    )
    short = F.size(lines) <= PLACEHOLDER_MAX_LINES
    for pattern in PLACEHOLDERS:
        out = out.when(short & body.rlike(f"(?i){pattern}"), f"placeholder found: {pattern}")
    return out


def edit_distance(code, previous) -> Column:
    """Levenshtein distance over the longer length; NULL without a previous text."""
    code, previous = as_col(code), as_col(previous)
    longer = F.greatest(F.length(code), F.length(previous))
    return F.when(code == previous, F.lit(0.0)).when(
        code.isNotNull() & previous.isNotNull(), F.levenshtein(code, previous) / longer
    )

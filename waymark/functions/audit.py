"""Static policy audit of candidate code."""

from __future__ import annotations

import ast

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from waymark.functions.columns import as_col

# --- fixed values: names the policy rejects ---------------------------------
BANNED_MODULES = (
    "os",
    "sys",
    "subprocess",
    "socket",
    "pathlib",
    "shutil",
    "glob",
    "requests",
    "urllib",
    "http",
    "ftplib",
    "pip",
    "importlib",
    "site",
    "builtins",
    "ctypes",
    "multiprocessing",
    "threading",
    "asyncio",
)
BANNED_CALLS = (
    "open",
    "input",
    "eval",
    "exec",
    "compile",
    "breakpoint",
    "__import__",
)
BANNED_ATTRIBUTES = (
    "system",
    "popen",
    "remove",
    "unlink",
    "rmdir",
    "mkdir",
    "makedirs",
    "listdir",
    "scandir",
    "walk",
    "chdir",
    "getcwd",
    "getenv",
    "environ",
)
# ----------------------------------------------------------------------------

_WORDS = "|".join(BANNED_MODULES + BANNED_CALLS + BANNED_ATTRIBUTES)


def _finding(node: ast.AST) -> str | None:
    """What the policy has against one syntax node."""
    match node:
        case ast.Import(names=imported):
            bad = [a.name for a in imported if a.name.partition(".")[0] in BANNED_MODULES]
            return f"import {bad[0]}" if bad else None
        case ast.ImportFrom(module=str(module)) if module.partition(".")[0] in BANNED_MODULES:
            return f"from {module} import ..."
        case ast.Call(func=ast.Name(id=name)) if name in BANNED_CALLS:
            return f"call to {name}"
        case ast.Call(func=ast.Attribute(attr=name)) if name in BANNED_ATTRIBUTES:
            return f"attribute call .{name}"
        case ast.Attribute(attr=name) if name in BANNED_ATTRIBUTES:
            return f"attribute access .{name}"
    return None


def blocked_operation_of(code: str | None) -> str | None:
    """First finding in breadth-first order; code that does not parse has none."""
    if not code:
        return None
    try:
        nodes = ast.walk(ast.parse(code))
    except (SyntaxError, ValueError, RecursionError, MemoryError):
        return None
    return next((found for found in map(_finding, nodes) if found), None)


@F.pandas_udf(T.StringType())
def _blocked_operation(code: pd.Series) -> pd.Series:
    return code.map(blocked_operation_of, na_action="ignore").astype(object)


def blocked_operation(code) -> Column:
    """The rejected operation or NULL.

    Code without any of the words is ruled out in the JVM and reaches Python as NULL.
    """
    code = as_col(code)
    suspect = code.rlike(rf"(?<![A-Za-z0-9_])(?:{_WORDS})(?![A-Za-z0-9_])") | code.rlike(r"[^\x00-\x7f]")
    return _blocked_operation(F.when(suspect, code))

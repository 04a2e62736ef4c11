"""Figures derived from two others, and arithmetic expressions."""

from __future__ import annotations

import ast
import operator

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerloom.functions.text import TOLERANCE, UNIT_RATIOS

# Fixed values. Figures that pairs are formed of: the largest ones within these bounds; and how far apart a pair may be.
MOST, LEAST, GREATEST = 150, 0.01, 1e12
COMPARABLE, MARGIN = 25.0, 200.0


def derived_values(numbers: np.ndarray) -> np.ndarray:
    """Differences, sums, changes in percent and ratios of all pairs of the largest numbers."""
    n = np.unique(numbers[(np.abs(numbers) >= LEAST) & (np.abs(numbers) <= GREATEST)])
    n = n[np.lexsort((n, -np.abs(n)))][:MOST]
    i, j = np.triu_indices(len(n), 1)
    a, b = n[i], n[j]
    low, high = np.minimum(np.abs(a), np.abs(b)), np.maximum(np.abs(a), np.abs(b))
    near = high / low <= COMPARABLE
    d, s = np.abs(a - b)[near], (a + b)[near]
    by_low, by_high = d / low[near] * 100, d / high[near] * 100
    share = (low / high)[high / low <= MARGIN]
    rounded = lambda x, *digits: [x, *(np.round(x, k) for k in digits)]
    return np.unique(np.concatenate([d, s, *rounded(by_low, 1, 2), *rounded(by_high, 1, 2), *rounded(share * 100, 1, 2), *rounded(share, 3)]))


def near_any(value: float, sorted_values: np.ndarray) -> bool:
    """Whether a value is within the tolerance, relative to the larger of both, of one of sorted ones."""
    if value == 0:
        return bool(np.any(sorted_values == 0))
    ends = sorted((value * (1 - TOLERANCE), value / (1 - TOLERANCE)))
    lo, hi = np.searchsorted(sorted_values, ends[0], "left"), np.searchsorted(sorted_values, ends[1], "right")
    around = sorted_values[max(lo - 1, 0) : hi + 1]
    return bool(np.any((around != 0) & (np.abs(around - value) <= TOLERANCE * np.maximum(np.abs(around), abs(value)))))


@F.pandas_udf(T.IntegerType())
def derived(claims: pd.Series, known: pd.Series) -> pd.Series:
    """How many of the claims (value, is_pct) follow from two known figures, in one of the usual units unless a percentage."""

    def count(some: list, numbers: np.ndarray) -> int:
        if some is None or len(some) == 0:
            return 0
        values = derived_values(np.asarray(numbers, float))
        return sum(any(near_any(c["value"] / r, values) for r in ((1.0,) if c["is_pct"] else UNIT_RATIOS)) for c in some)

    return pd.Series([count(c, n) for c, n in zip(claims, known, strict=True)])


_BINARY = {ast.Add: operator.add, ast.Sub: operator.sub, ast.Mult: operator.mul, ast.Div: operator.truediv, ast.Pow: operator.pow}
_UNARY = {ast.USub: operator.neg, ast.UAdd: operator.pos}


def evaluate(expression: str | None) -> float | None:
    """The value of an expression of numbers, + - * / **, signs and parentheses; null for any other text and without a value."""

    def value(node: ast.AST) -> float:
        if isinstance(node, ast.Constant) and type(node.value) in (int, float):
            return float(node.value)
        if isinstance(node, ast.BinOp) and type(node.op) in _BINARY:
            return _BINARY[type(node.op)](value(node.left), value(node.right))
        if isinstance(node, ast.UnaryOp) and type(node.op) in _UNARY:
            return _UNARY[type(node.op)](value(node.operand))
        raise ValueError("not arithmetic")

    try:
        result = value(ast.parse(expression or "", mode="eval").body)
    except (ValueError, SyntaxError, ArithmeticError, RecursionError, MemoryError):
        return None
    return None if isinstance(result, complex) or result != result or abs(result) == float("inf") else result


@F.pandas_udf(T.DoubleType())
def evaluated(expressions: pd.Series) -> pd.Series:
    return pd.Series([evaluate(e) for e in expressions], dtype="float64")

"""Sealing: a content stream cut into symbols, symbols into groups, and parity over each group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .order import prefix_sums


def groups(files: DataFrame, symbol: int, k: int) -> DataFrame:
    """files(name, size) as one stream in name order: each file's symbols and groups, first and last of either."""
    placed = prefix_sums(files.where("size > 0").select("name", "size"), "size", [F.col("name").asc()])
    first, last = F.expr(f"(total - size) div {symbol}"), F.expr(f"(total - 1) div {symbol}")
    return placed.select("name", "size", first.alias("first_symbol"), last.alias("last_symbol")).withColumns({"first_group": F.expr(f"first_symbol div {k}"), "last_group": F.expr(f"last_symbol div {k}")})


def plan(size: int, symbol: int, k: int, m: int) -> tuple[int, int]:
    """Groups and parity bytes for a stream of a size."""
    n = -(-size // (symbol * k))
    return n, n * m * symbol


def parity(symbols: DataFrame) -> DataFrame:
    """symbols(grp, value) -> XOR of each group, summed in parts before the shuffle."""
    return symbols.groupBy("grp").agg(F.bit_xor("value").alias("parity"), F.count("*").alias("symbols"))


def scrub(symbols: DataFrame, sealed: DataFrame) -> DataFrame:
    """Each group's parity now against the sealed one: ok, damaged, missing (sealed but gone) or unsealed."""
    now = parity(symbols).select("grp", F.col("parity").alias("now"))
    rows = now.join(sealed.select("grp", "parity"), "grp", "full_outer")
    verdict = F.when(F.col("now").isNull(), "missing").when(F.col("parity").isNull(), "unsealed").when(F.col("now") == F.col("parity"), "ok").otherwise("damaged")
    return rows.select("grp", verdict.alias("verdict"))


def heal(symbols: DataFrame, sealed: DataFrame) -> DataFrame:
    """symbols(grp, idx, value) with one null a group: the value that the parity gives. Groups with more are left."""
    holes = symbols.groupBy("grp").agg(F.count_if(F.col("value").isNull()).alias("holes"), F.bit_xor("value").alias("rest"))
    return symbols.join(holes.join(sealed.select("grp", "parity"), "grp", "left"), "grp").select("grp", "idx", F.coalesce("value", F.when(F.col("holes") == 1, F.coalesce("rest", F.lit(0)).bitwiseXOR(F.col("parity")))).alias("value"))


_POLY = 0x11D
_EXP = np.zeros(512, np.uint8)
_LOG = np.zeros(256, np.int64)
_x = 1
for _i in range(255):
    _EXP[_i], _LOG[_x] = _x, _i
    _x = (_x << 1) ^ (_POLY if _x & 0x80 else 0)
_EXP[255:510] = _EXP[:255]


def _times(a: int, row: np.ndarray) -> np.ndarray:
    """A row of GF(2^8) times a number."""
    if a == 0:
        return np.zeros_like(row)
    out = _EXP[_LOG[row] + _LOG[a]]
    out[row == 0] = 0
    return out


def _inverse(a: int) -> int:
    return int(_EXP[255 - _LOG[a]])


def cauchy(k: int, m: int) -> np.ndarray:
    """m x k coefficients 1 / (x_i + y_j): any k rows of identity and these are independent."""
    return np.array([[_inverse((k + i) ^ j) for j in range(k)] for i in range(m)], np.uint8)


def rs_encode(data: list[bytes], m: int) -> list[bytes]:
    """m parity blocks over equally long data blocks."""
    rows = [np.frombuffer(d, np.uint8) for d in data]
    out = []
    for line in cauchy(len(data), m):
        acc = np.zeros(len(rows[0]), np.uint8)
        for a, r in zip(line.tolist(), rows, strict=True):
            acc ^= _times(a, r)
        out.append(acc.tobytes())
    return out


def rs_decode(data: list[bytes | None], parity_blocks: list[bytes | None]) -> list[bytes]:
    """The data blocks again, if at most as many are lost as parity blocks are left."""
    k = len(data)
    lost = [i for i, d in enumerate(data) if d is None]
    left = [i for i, p in enumerate(parity_blocks) if p is not None][: len(lost)]
    if len(left) < len(lost):
        raise ValueError("too many blocks are lost")
    if not lost:
        return list(data)
    lines = cauchy(k, len(parity_blocks))
    matrix, right = [], []
    for i in left:
        acc = np.frombuffer(parity_blocks[i], np.uint8).copy()
        for j in range(k):
            if data[j] is not None:
                acc ^= _times(int(lines[i][j]), np.frombuffer(data[j], np.uint8))
        matrix.append([int(lines[i][j]) for j in lost])
        right.append(acc)
    n = len(lost)
    for c in range(n):  # Gauss elimination over GF(2^8)
        p = next(r for r in range(c, n) if matrix[r][c])
        matrix[c], matrix[p], right[c], right[p] = matrix[p], matrix[c], right[p], right[c]
        inv = _inverse(matrix[c][c])
        matrix[c] = _times(inv, np.array(matrix[c], np.uint8)).tolist()
        right[c] = _times(inv, right[c])
        for r in range(n):
            if r != c and matrix[r][c]:
                f = matrix[r][c]
                matrix[r] = (np.array(matrix[r], np.uint8) ^ _times(f, np.array(matrix[c], np.uint8))).tolist()
                right[r] = right[r] ^ _times(f, right[c])
    out = list(data)
    for i, j in enumerate(lost):
        out[j] = right[i].tobytes()
    return out


def rs_parity(symbols: DataFrame, m: int) -> DataFrame:
    """symbols(grp, idx, body) -> (grp, idx, body): m Reed-Solomon blocks a group. A group is k blocks by plan, so a
    task holds one group at a time."""

    def encode(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values("idx")
        size = rows.body.map(len).max()
        blocks = rs_encode([b.ljust(size, b"\0") for b in rows.body], m)
        return pd.DataFrame({"grp": rows.grp.iloc[0], "idx": range(m), "body": blocks})

    return symbols.groupBy("grp").applyInPandas(encode, "grp long, idx int, body binary")

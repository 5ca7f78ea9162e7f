"""Pieces of DuckDB SQL shared by the queries of this folder."""

from __future__ import annotations


def crc32(expr: str) -> str:
    """Unsigned CRC-32 of an ASCII string expression (DuckDB has none): the
    reflected polynomial 0xEDB88320, eight shifts a byte."""
    return (f"xor(list_reduce(list_transform(range(1, length({expr}) + 1), lambda i: ord(({expr})[i])::BIGINT), "
            "lambda c, x: list_reduce(range(8), lambda a, i: CASE WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) "
            "ELSE a >> 1 END, xor(c, x)), 4294967295::BIGINT), 4294967295::BIGINT)")

"""Pieces of DuckDB SQL for the oracles of this subpackage."""

from __future__ import annotations


def _crc_table() -> list[int]:
    """The remainders of all bytes by the reversed CRC-32 polynomial."""
    table = []
    for value in range(256):
        for _ in range(8):
            value = value >> 1 ^ (0xEDB88320 if value & 1 else 0)
        table.append(value)
    return table


def crc32(text: str) -> str:
    """The unsigned CRC-32 of the UTF-8 bytes of a text."""
    each = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || substr(hex(encode({text})), CAST(2 * i + 1 AS BIGINT), 2) AS BIGINT))"
    known = f"CAST([{', '.join(map(str, _crc_table()))}] AS BIGINT[])"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {each}), lambda c, b: xor(c >> 8, {known}[(xor(c, b) & 255) + 1])), 4294967295::BIGINT)"

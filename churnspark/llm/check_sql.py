"""Pieces of check SQL: the unsigned crc32 of a string's UTF-8 bytes."""

#: One row: the crc32 remainders ``t`` of the bytes 0 to 255, from the polynomial.
CRC_TABLE = """
crc_steps AS (
    SELECT byte, byte AS r, 0 AS step FROM (SELECT unnest(range(256))::BIGINT AS byte)
    UNION ALL
    SELECT byte, CASE WHEN r & 1 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END, step + 1 FROM crc_steps WHERE step < 8
),
crc_table AS (SELECT list(r ORDER BY byte) AS t FROM crc_steps WHERE step = 8)"""


def crc32(text: str, table: str = "t") -> str:
    """SQL of the checksum of a string expression, in a query that joins crc_table."""
    digits = f"hex(encode({text}))"
    byte = f"list_transform(range(strlen({text})), lambda i: ('0x' || {digits}[2 * i + 1 : 2 * i + 2])::BIGINT)"
    return f"xor(list_reduce(list_prepend(4294967295::BIGINT, {byte}), lambda a, b: xor(a >> 8, {table}[(xor(a, b) & 255) + 1])), 4294967295)"

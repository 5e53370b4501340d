"""Parts of the SQL that queries of this subpackage are held against."""


def crc32(text: str) -> str:
    """Unsigned crc32 of an expression of ASCII text that is not empty, bit by bit; null gives null."""
    bits = "list_reduce(list_prepend(xor(c, b), [0::UBIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, _: xor(x >> 1, 3988292384::UBIGINT * (x & 1)))"
    letters = f"list_transform(string_split({text}, ''), lambda ch: ord(ch)::UBIGINT)"
    return f"CASE WHEN {text} IS NOT NULL THEN xor(list_reduce(list_prepend(4294967295::UBIGINT, {letters}), lambda c, b: {bits}), 4294967295::UBIGINT) END"

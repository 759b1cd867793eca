"""Names as a version control prints them: as they are, or C-quoted between double quotes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The letter after a backslash and the byte that it stands for.
LETTERS = {"a": 7, "b": 8, "t": 9, "n": 10, "v": 11, "f": 12, "r": 13, '"': 34, "\\": 92}

_PIECE = r"\\[0-7]{3}|\\.|[^\\]+"
_PLAIN = r"^[ !#-\[\]-~]*$"


def _table(pairs: list[tuple[str, str]]) -> Column:
    return F.create_map(*[F.lit(v) for pair in pairs for v in pair])


def unquoted(name: Column) -> Column:
    """The name itself; octal escapes are bytes of UTF-8, and bytes that aren't become U+FFFD.

    Names without quotes, and text that only starts with one, are taken as they are. Null stays null.
    """
    letters = _table([("\\" + letter, f"{byte:02X}") for letter, byte in LETTERS.items()])
    pieces = F.regexp_extract_all(F.substring(name, F.lit(2), F.length(name) - 2), F.lit(_PIECE), F.lit(0))

    def bytes_of(piece: Column) -> Column:
        octal = F.lpad(F.conv(F.substring(piece, 2, 3), 8, 16), 2, "0")
        return F.when(F.length(piece) == 1, F.hex(piece)).otherwise(
            F.when(F.regexp_like(piece, F.lit(r"^\\[0-7]{3}$")), octal).otherwise(
                F.coalesce(F.try_element_at(letters, piece), F.hex(piece))
            )
        )

    spelled = F.unhex(F.array_join(F.transform(pieces, bytes_of), "")).cast("string")
    is_quoted = F.startswith(name, F.lit('"')) & F.endswith(name, F.lit('"')) & (F.length(name) > 1)
    return F.make_valid_utf8(F.when(is_quoted, spelled).otherwise(name))


def quoted(name: Column, spaces: bool = False) -> Column:
    """The name as it is printed by default: quoted if it holds quotes, backslashes, control or non-ASCII bytes.

    Status listings quote names with a space too (``spaces``).
    """
    escapes = _table([(f"{byte:02X}", "\\" + letter) for letter, byte in LETTERS.items()])
    printable = F.concat(F.lit("^("), F.lit("[2-6][0-9A-F]|7[0-9A-E]"), F.lit(")$"))

    def shown(byte: Column) -> Column:
        octal = F.concat(F.lit("\\"), F.lpad(F.conv(byte, 16, 8), 3, "0"))
        plain = F.when(F.regexp_like(byte, printable), F.unhex(byte).cast("string")).otherwise(octal)
        return F.coalesce(F.try_element_at(escapes, byte), plain)

    spelled = F.transform(F.regexp_extract_all(F.hex(name), F.lit(".."), F.lit(0)), shown)
    as_is = F.regexp_like(name, F.lit(_PLAIN))
    if spaces:
        as_is = as_is & ~F.contains(name, F.lit(" "))
    return F.when(as_is, name).otherwise(F.concat(F.lit('"'), F.array_join(spelled, ""), F.lit('"')))

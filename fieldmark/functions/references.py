"""Character references of HTML as a column expression: named ones by the whole table, with or without a semicolon, and numeric ones."""

from __future__ import annotations

from functools import cache
from html.entities import html5

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Every name, the longest first, as a pattern: some also count without a semicolon.
NAMED = "^(?:" + "|".join(sorted(html5, key=lambda n: (-len(n), n))) + ")"
DECIMAL, HEX = r"^#([0-9]+);?", r"^#[xX]([0-9a-fA-F]+);?"
REPLACEMENT = "�"


def western() -> dict[int, str]:
    """Numbers from 128 to 159 stand for what the Western code page has there, else for themselves."""
    return {n: bytes([n]).decode("cp1252", "ignore") or chr(n) for n in range(0x80, 0xA0)}


#: Ends of a name and of what it stands for, in the table as one text.
STARTS, IS = "\u0001", "\u0002"


@cache
def table() -> str:
    return "".join(f"{STARTS}{name}{IS}{text}" for name, text in html5.items()) + STARTS


def named(name: Column) -> Column:
    """What one of the names stands for. The table is one text, for a map of so many literals is slow to plan with."""
    after = F.split_part(F.lit(table()), F.concat(F.lit(STARTS), name, F.lit(IS)), F.lit(2))
    return F.split_part(after, F.lit(STARTS), F.lit(1))


def numbered(n: Column) -> Column:
    """The character of a number: none for controls and for what is no character, a sign of replacement beyond Unicode."""
    code_page = F.create_map(*[F.lit(x) for pair in western().items() for x in pair])
    control = n.between(1, 8) | (n == 11) | n.between(14, 31) | n.between(127, 159) | n.between(0xFDD0, 0xFDEF) | (n.bitwiseAND(0xFFFE) == 0xFFFE)
    plain = F.decode(F.unhex(F.concat(F.lit("0000FEFF"), F.lpad(F.hex(n), 8, "0"))), "UTF-32")  # the first mark of byte order, which the decoder drops
    return F.when((n == 0) | n.between(0xD800, 0xDFFF) | (n > 0x10FFFF), REPLACEMENT).when(n.between(0x80, 0x9F), F.try_element_at(code_page, n)).when(control, "").otherwise(plain)


def large(digits: Column, base: int) -> Column:
    """The number that these digits are, those beyond Unicode as one of them."""
    plain = F.regexp_replace(digits, "^0+(?=.)", "")
    return F.when(F.length(plain) > 8, F.lit(0x110000)).otherwise(F.conv(plain, base, 10).cast("long")).cast("int")


def decoded(text: Column) -> Column:
    """The text with its character references decoded once; what is no reference stays as it is."""

    def after_sign(piece: Column) -> Column:
        name = F.regexp_extract(piece, NAMED, 0)
        decimal, hexadecimal = F.regexp_extract(piece, DECIMAL, 0), F.regexp_extract(piece, HEX, 0)
        rest = lambda seen: F.substring(piece, F.length(seen) + 1, F.length(piece))
        return (
            F.when(decimal != "", F.concat(numbered(large(F.regexp_extract(piece, DECIMAL, 1), 10)), rest(decimal)))
            .when(hexadecimal != "", F.concat(numbered(large(F.regexp_extract(piece, HEX, 1), 16)), rest(hexadecimal)))
            .when(name != "", F.concat(named(name), rest(name)))
            .otherwise(F.concat(F.lit("&"), piece))
        )

    def one(t: Column) -> Column:
        pieces = F.split(t, "&")
        return F.when(F.contains(t, F.lit("&")), F.concat(pieces[0], F.array_join(F.transform(F.slice(pieces, 2, F.size(pieces)), after_sign), ""))).otherwise(t)

    return F.transform(F.array(text), one)[0]  # the text, which may be a long expression, is computed once


def decoded_sql(text: str) -> str:
    """The same in SQL."""
    keys, values = zip(*sorted(html5.items()))
    listed = lambda xs: "[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]"
    names = f"map({listed(keys)}, {listed(values)})"
    page = f"map([{', '.join(map(str, western()))}], {listed(western().values())})"
    n = "n"
    char = f"""CASE WHEN {n} = 0 OR {n} BETWEEN 55296 AND 57343 OR {n} > 1114111 THEN '{REPLACEMENT}' WHEN {n} BETWEEN 128 AND 159 THEN {page}[{n}] WHEN {n} BETWEEN 1 AND 8 OR {n} = 11 OR {n} BETWEEN 14 AND 31 OR {n} = 127 OR {n} BETWEEN 64976 AND 65007 OR {n} & 65534 = 65534 THEN '' ELSE chr({n}) END"""
    number = lambda digits: f"list_transform([CASE WHEN length(ltrim({digits}, '0')) > 8 THEN 1114112 ELSE CAST({digits} AS BIGINT) END], lambda n: {char.replace('chr(n)', 'chr(CAST(n AS INT))')})[1]"
    dec, hexa = f"regexp_extract(p, '{DECIMAL}', 1)", f"regexp_extract(p, '{HEX}', 1)"
    piece = f"""CASE WHEN {dec} <> '' THEN {number(dec)} || substr(p, length(regexp_extract(p, '{DECIMAL}', 0)) + 1) WHEN {hexa} <> '' THEN {number("('0x' || " + hexa + ")").replace("ltrim(('0x' || " + hexa + "), '0')", "ltrim(" + hexa + ", '0')")} || substr(p, length(regexp_extract(p, '{HEX}', 0)) + 1)
        WHEN regexp_extract(p, '{NAMED}', 0) <> '' THEN {names}[regexp_extract(p, '{NAMED}', 0)] || substr(p, length(regexp_extract(p, '{NAMED}', 0)) + 1) ELSE '&' || p END"""
    return f"(string_split({text}, '&')[1] || array_to_string(list_transform(string_split({text}, '&')[2:], lambda p: {piece}), ''))"

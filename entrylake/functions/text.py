"""Text and URL expressions, all evaluated inside the JVM."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, functions as F

_EDGE_SPACE = r"(?U)^[\s﻿]+|(?U)[\s﻿]+$"


def trim_space(text: Column) -> Column:
    """Strip every kind of Unicode white space, not only blanks."""
    return F.regexp_replace(text, _EDGE_SPACE, "")


def initials(name: Column) -> Column:
    """First letter of the first and of the last word, upper case; one word gives one letter."""
    words = F.split(trim_space(name), " ")
    first = F.substring(F.element_at(words, 1), 1, 1)
    last = F.substring(F.element_at(words, -1), 1, 1)
    return F.upper(F.when(F.size(words) > 1, F.concat(first, last)).otherwise(first))


def _accent_table() -> tuple[str, str]:
    """Accented Latin letters and their base letters, taken from Unicode decompositions."""
    accented, plain = [], []
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        base = unicodedata.normalize("NFD", chr(code))[0]
        if base != chr(code) and base.isascii():
            accented.append(chr(code))
            plain.append(base)
    return "".join(accented), "".join(plain)


def fold_ascii(text: Column) -> Column:
    """Replace Latin letters with accents by ASCII ones. Other scripts stay as they are."""
    accented, plain = _accent_table()
    folded = F.translate(text, accented + "øØđĐłŁıŋ", plain + "oOdDlLin")
    for letter, pair in (("ß", "ss"), ("æ", "ae"), ("Æ", "AE"), ("œ", "oe"), ("Œ", "OE"), ("þ", "th")):
        folded = F.replace(folded, F.lit(letter), F.lit(pair))
    return folded


def limiter_key(email: Column, ip: Column) -> Column:
    """Login limiter key: folded lower-case e-mail, a bar, the address."""
    return fold_ascii(F.concat(F.lower(email), F.lit("|"), ip))


def url_path(url: Column) -> Column:
    """Path of an absolute URL; other strings as they are; null for a malformed URL."""
    path = F.try_parse_url(url, F.lit("PATH"))
    return F.when(~url.startswith("http"), url).when(path == "", F.lit("/")).otherwise(path)


def tokens(text: Column) -> Column:
    """Maximal runs of letters, lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit(r"(\p{L}+)"), F.lit(1))


def _token_number(token: Column) -> Column:
    """The first 36 bits of the MD5 of a token."""
    return F.conv(F.substring(F.md5(token), 1, 9), 16, 10).cast("long")


def token_code(token: Column, dim: int) -> Column:
    """Bucket and sign of a token in one integer: 2 * bucket, plus 1 for a positive sign.

    The bucket is the first 32 bits of the MD5 modulo ``dim``; the next bit is the sign,
    0 for +1.
    """
    number = _token_number(token)
    bucket = F.pmod(F.shiftright(number, 4), F.lit(dim))
    return (bucket * 2 + 1 - F.shiftright(number, 3).bitwiseAND(1)).cast("int")

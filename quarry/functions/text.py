"""Keys made from names and codes."""

from __future__ import annotations

import unicodedata
from functools import cache

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Words of legal form that do not tell companies apart. Fixed values.
LEGAL_FORMS = ("ab", "aktiebolag", "publ", "plc", "inc", "corp", "corporation", "ltd", "limited", "sa", "se", "nv", "ag", "holding", "holdings", "group")


def normal(c: Column) -> Column:
    """Upper case, every run of other signs one space, trimmed; blank becomes null."""
    out = F.trim(F.regexp_replace(F.upper(c), "[^A-Z0-9ÅÄÖÉÜÆØ]+", " "))
    return F.when(out != "", out)


def squeezed(c: Column) -> Column:
    """Upper case with single spaces; punctuation stays."""
    out = F.upper(F.trim(F.regexp_replace(c, r"\s+", " ")))
    return F.when(out != "", out)


def code(c: Column) -> Column:
    """Upper case without any space."""
    out = F.upper(F.regexp_replace(c, r"\s", ""))
    return F.when(out != "", out)


def company(c: Column) -> Column:
    """A name in lower case without accents, words of legal form and punctuation. Letters are decomposed
    for compatibility, so that ligatures and wide forms are plain letters; signs that no base letter
    has, such as ø, part words."""
    plain = F.lower(plain_letters(c))
    bare = F.regexp_replace(plain, r"(?U)\b(?:" + "|".join(LEGAL_FORMS) + r")\b", " ")
    return F.trim(F.regexp_replace(bare, "[^a-z0-9]+", " "))


@cache
def _bases() -> tuple[dict[str, str], dict[str, str]]:
    """Letters and digits whose compatibility decomposition, without marks, is plain: one sign or more."""
    one, more = {}, {}
    for n in range(0x80, 0x10000):
        c = chr(n)
        base = "".join(x for x in unicodedata.normalize("NFKD", c) if not unicodedata.combining(x))
        if base != c and base.isascii() and base.isalnum():
            if len(base) == 1:
                one[c] = base
            elif unicodedata.category(c)[0] == "L":
                more[c] = base
    return one, more


def plain_letters(c: Column) -> Column:
    """Letters and digits without their accents, wide and ornate forms and ligatures as plain ones."""
    one, more = _bases()
    out = F.translate(F.regexp_replace(c, r"\p{M}+", ""), "".join(one), "".join(one.values()))
    for sign, letters in more.items():
        out = F.replace(out, F.lit(sign), F.lit(letters))
    return F.when(c.rlike(r"[^\x00-\x7F]"), out).otherwise(c)


def security_key(isin: Column, issuer: Column) -> Column:
    """ISIN:x where there is a code, else ISSUER:x."""
    i = normal(isin)
    return F.when(i.isNotNull(), F.concat(F.lit("ISIN:"), i)).otherwise(F.concat(F.lit("ISSUER:"), F.coalesce(normal(issuer), F.lit(""))))

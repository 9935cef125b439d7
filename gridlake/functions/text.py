"""Name normalisation for record linkage."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters whose canonical decomposition is a plain letter and one mark, built from the Unicode tables.
_PAIRS = [
    (chr(c), d[0])
    for c in (*range(0xC0, 0x250), *range(0x1E00, 0x1F00))
    if len(d := unicodedata.normalize("NFD", chr(c))) > 1 and all(unicodedata.category(x) == "Mn" for x in d[1:])
]
ACCENTED = "".join(a for a, _ in _PAIRS)
PLAIN = "".join(b for _, b in _PAIRS)


def normalize_name(text: Column) -> Column:
    """Accents off, upper case, punctuation and runs of white space one space; null is empty."""
    plain = F.regexp_replace(F.translate(F.coalesce(text, F.lit("")), ACCENTED, PLAIN), r"\p{Mn}", "")
    return F.trim(F.regexp_replace(F.regexp_replace(F.upper(plain), r"[.()\-_°]", " "), r"\s+", " "))


def without_voltage(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r"\s+500\s*\d*\s*$", "")


def circuit_number(name: Column) -> Column:
    return F.regexp_extract(name, r"500\s+(\d+)\s*$", 1).try_cast("int")


def resolve_tokens(tokens: list[str], aliases: dict[str, str | None], widest: int = 4) -> list[str]:
    """Greedy longest-first windows, left to right; joined form before spaced form; a null alias discards."""
    used, found = [False] * len(tokens), set()
    for size in range(min(widest, len(tokens)), 0, -1):
        for at in range(len(tokens) - size + 1):
            if any(used[at : at + size]):
                continue
            window = tokens[at : at + size]
            key = next((k for k in ("".join(window), " ".join(window)) if k in aliases), None)
            if key is not None:
                used[at : at + size] = [True] * size
                found.add(aliases[key])
    found |= {t for t, u in zip(tokens, used, strict=True) if not u}
    return sorted(t for t in found if t)


def alias_tokens(name: Column, aliases: dict[str, str | None]) -> Column:
    """Canonical token set of a raw name.  The greedy scan has no built-in form, so names go to Python by Arrow batches."""

    @F.pandas_udf("array<string>")
    def tokens(names: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in names:
            yield part.map(lambda n: resolve_tokens((n or "").split(), aliases))

    return tokens(without_voltage(normalize_name(name)))

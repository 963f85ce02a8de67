"""Similarities and repairs of read text, and small numeric rules of catalogues."""

from __future__ import annotations

from difflib import SequenceMatcher

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


@F.pandas_udf(DoubleType())
def char_similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    """Twice the matched characters over all characters; case and blanks around don't count, nothing equals nothing.

    Order-dependent block matching has no built-in form, so this runs on Arrow
    batches: use it after a blocking join, on candidate pairs only.
    """
    plain = [side.fillna("").str.strip().str.lower() for side in (a, b)]
    return pd.Series([SequenceMatcher(None, x, y).ratio() for x, y in zip(*plain, strict=True)], dtype="float64")


def closed_up(text: Column, least: int = 3) -> Column:
    """Letter-spaced names ('R I V I E R E') closed up, from `least` letters on."""
    run = f"(?<!\\p{{L}})(?:\\p{{L}} ){{{least - 1},}}\\p{{L}}(?!\\p{{L}})"
    found = F.regexp_extract_all(text, F.lit(f"({run})"), F.lit(1))
    return F.aggregate(found, text, lambda t, r: F.replace(t, r, F.replace(r, F.lit(" "), F.lit(""))))


def has_diacritic(text: Column) -> Column:
    """Whether folding changes a letter."""
    from tessera.functions.text import fold

    return fold(text) != F.lower(text)


def token_cost(fresh: Column, cached: Column, output: Column, price: dict[str, Column]) -> Column:
    """Cost of a call at prices per million tokens, six places; null without a price. Negative counts count as none."""
    none = F.lit(0)
    total = F.greatest(fresh, none) * price["input"] + F.greatest(cached, none) * price["cached"] + F.greatest(output, none) * price["output"]
    return F.round(total / 1e6, 6)


def zoom_for_span(span: Column) -> Column:
    """Map zoom for a span in degrees, 4 to 16."""
    return F.greatest(F.lit(4.0), F.least(F.lit(16.0), F.log2(360 / span) + 0.6))


def localised_number(text: Column) -> Column:
    """'15.154' or '15 154' as 15154; null for anything else."""
    return F.regexp_replace(text, "[. \\u00A0](?=\\d{3}(\\D|$))", "").try_cast("long")


def spelling_variants(text: Column, most: int = 8) -> Column:
    """The name as it is, folded, hyphenated, with blanks for hyphens, and their folded forms; distinct ones."""
    from tessera.functions.text import fold

    hyphened, open_ = F.replace(text, F.lit(" "), F.lit("-")), F.replace(text, F.lit("-"), F.lit(" "))
    return F.slice(F.array_distinct(F.array(text, hyphened, open_, fold(text), fold(hyphened), fold(open_))), 1, most)


def period(year: Column, periods: list[tuple[str, int | None, int | None]]) -> Column:
    """The first period (name, from, to; inclusive, open with None) that holds a year."""
    out = F.lit(None).cast("string")
    for name, low, high in reversed(periods):
        inside = year.isNotNull()
        if low is not None:
            inside = inside & (year >= low)
        if high is not None:
            inside = inside & (year <= high)
        out = F.when(inside, F.lit(name)).otherwise(out)
    return out

"""Keys, parses and comparisons of printed labels as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import GENERICS, fold, is_subsequence, label_core, levenshtein_share, tokens

#: Our own short list: what a printed short form stands for.
SHORT_FORMS = {"av": "avenue", "bd": "boulevard", "imp": "impasse", "pl": "place", "r": "rue", "rte": "route", "vge": "village"}
ROMAN = {"i": 1, "v": 5, "x": 10, "l": 50, "c": 100, "d": 500, "m": 1000}


def label_key(text: Column, corrected: Column) -> Column:
    """The folded text as a person corrected it, or as it was read."""
    return fold(F.coalesce(corrected, text))


def name_key(text: Column) -> Column:
    """The folded text without its one generic prefix: what two readings of a name agree on."""
    return F.trim(F.regexp_replace(fold(label_core(text)), "\\s+", " "))


def squashed(text: Column) -> Column:
    """Folded letters and digits only."""
    return F.regexp_replace(fold(text), "[^a-z0-9]+", "")


def generic_only(text: Column, generics: tuple[str, ...] = GENERICS) -> Column:
    """Whether a label has words and all of them are generic."""
    words = tokens(text)
    return (F.size(words) > 0) & F.forall(words, lambda w: w.isin(*generics))


def non_ascii(text: Column) -> Column:
    """Number of characters beyond ASCII."""
    return F.length(F.regexp_replace(text, "[\\x00-\\x7F]", ""))


def _numbered(text: Column) -> Column:
    """With every spelling of 'number' alike."""
    return F.regexp_replace(F.lower(text), "\\bn(?:[°º]|o\\.|o(?= ?[0-9])) ?", "no")


def _expanded(text: Column) -> Column:
    words = tokens(text)
    table = F.create_map(*(F.lit(x) for pair in SHORT_FORMS.items() for x in pair))
    return F.array_join(F.transform(words, lambda w: F.coalesce(F.try_element_at(table, w), w)), " ")


def diff_class(raw: Column, seen: Column, near: float = 0.4) -> Column:
    """How a reading was changed, by the most mechanical rule that explains it.

    `near` is the share of letters, by edit distance, up to which another text
    is a wrong word rather than a rewrite.
    """
    a, b = F.trim(F.coalesce(raw, F.lit(""))), F.trim(F.coalesce(seen, F.lit("")))
    first = lambda t: F.get(tokens(t), 0)
    rules = [
        ("same", a == b),
        ("typed", a == ""),
        ("case", F.lower(a) == F.lower(b)),
        ("accent", fold(a) == fold(b)),
        ("spacing", squashed(a) == squashed(b)),
        ("numeral", _numbered(a) == _numbered(b)),
        ("abbreviation", _expanded(a) == _expanded(b)),
        ("generic", (name_key(a) == name_key(b)) & (first(a) != first(b))),
        ("extended", is_subsequence(tokens(a), tokens(b))),
        ("truncated", is_subsequence(tokens(b), tokens(a))),
        ("wrong word", levenshtein_share(fold(a), fold(b)) <= near),
    ]
    out = F.lit("rewrite")
    for name, test in reversed(rules):
        out = F.when(test, F.lit(name)).otherwise(out)
    return out


def legend_entry(text: Column) -> Column:
    """'3. Name (Alias)' as a struct of n, name and alias; null parts where they are missing."""
    part = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    return F.struct(part("^\\s*(\\d+)[.)]").cast("int").alias("n"), part("^\\s*(?:\\d+[.)])?\\s*([^(]*)").alias("name"), part("\\(([^)]*)\\)").alias("alias"))


def cell_order(text: Column) -> Column:
    """A sheet's place in its series: its number, and half a step more for a 'bis'."""
    number = F.nullif(F.regexp_extract(text, "(\\d+)", 1), F.lit("")).cast("double")
    return number + F.when(text.rlike("(?i)\\d+ ?bis\\b"), 0.5).otherwise(0.0)


def roman(text: Column) -> Column:
    """The value of a Roman numeral; null for anything else."""
    table = F.create_map(*(F.lit(x) for pair in ROMAN.items() for x in pair))
    digits = F.transform(F.split(F.lower(text), ""), lambda c: F.try_element_at(table, c))
    start = F.struct(F.lit(0).alias("sum"), F.lit(0).alias("last"))
    # From the right: a smaller digit before a larger one is taken off.
    total = F.aggregate(F.reverse(digits), start, lambda s, d: F.struct((s["sum"] + F.when(d < s["last"], -d).otherwise(d)).alias("sum"), F.greatest(s["last"], d).alias("last")))
    return F.when(text.rlike("(?i)^[ivxlcdm]+$"), total["sum"])


def packed_date(text: Column) -> Column:
    """The date in an id like 'paper19240131'."""
    return F.try_to_timestamp(F.regexp_extract(text, "[A-Za-z]+(\\d{8})", 1), F.lit("yyyyMMdd")).cast("date")


def expanded_references(text: Column) -> Column:
    """'J5,6' as J5 and J6."""
    letter = F.regexp_extract(text, "^([A-Za-z]+)", 1)
    return F.transform(F.regexp_extract_all(text, F.lit("(\\d+)"), F.lit(1)), lambda n: F.concat(letter, n))


def seeded(seed: str, *parts: Column) -> Column:
    """A digest that puts rows in an order that only the seed decides."""
    return F.sha2(F.concat_ws("|", F.lit(seed), *(p.cast("string") for p in parts)), 256)


def natural_order(text: Column) -> list[Column]:
    """Sort keys: blanks last and alike, then the part before the number, then the number."""
    blank = text.isNull() | (F.trim(text) == "")
    number = F.nullif(F.regexp_extract(text, "(\\d+)", 1), F.lit("")).cast("long")
    return [blank.asc(), F.when(~blank, F.lower(F.regexp_extract(text, "^([^0-9]*)", 1))).asc_nulls_last(), number.asc_nulls_first()]

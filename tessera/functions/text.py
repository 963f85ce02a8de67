"""Text keys, folding and fuzzy matching as Column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def _folding() -> tuple[str, str]:
    """Lower-case Latin letters with marks, and the plain letters under them."""
    pairs = {"đ": "d", "ð": "d", "ø": "o", "ł": "l"}
    for code in [*range(0xDF, 0x180), *range(0x1A0, 0x1B1), *range(0x1E00, 0x1F00)]:
        char = chr(code)
        base = unicodedata.normalize("NFD", char)[0]
        if char.islower() and base != char and "a" <= base <= "z":
            pairs[char] = base
    return "".join(pairs), "".join(pairs.values())


FOLD_FROM, FOLD_TO = _folding()
#: Marks that stand after the letter they belong to.
MARKS = "[\\x{0300}-\\x{036F}]+"
#: Letters that fold to two.
LIGATURES = (("œ", "oe"), ("æ", "ae"), ("ß", "ss"))
#: Generic words before a place's name, articles among them, and the articles after it.
GENERICS = tuple(
    "rue r ruelle boulevard boul bould bd blvd avenue av ave quai quay impasse imp place pl chemin ch route rte passage village vge vlge hameau marche pont canal "
    "arroyo riviere riv fleuve faubourg duong dg pho hem rach song kenh cho ap xom cau ben khu phuong quan xa thon lang de du des d le la les l au aux".split()
)
ARTICLES = ("de", "du", "des", "d", "le", "la", "les", "l")
#: The prefixes of a label, of which exactly one is cut.
PREFIXES = (
    "cong truong", "công trường", "dai lo", "đại lộ", "quoc lo", "quốc lộ", "huong lo", "hương lộ", "duong", "đường", "ben", "bến", "rach", "rạch", "kinh",
    "song", "sông", "cau", "cầu", "hem", "hẻm", "xom", "xóm", "ap", "ấp", "ngo", "ngõ", "rue", "ruelle", "impasse", "passage", "allee", "allée", "avenue",
    "boulevard", "bd", "quai", "chemin", "place", "cour", "hameau", "route", "voie", "pont", "sentier",
)
CORE_LEAST = 4


def fold(text: Column) -> Column:
    """Lower case without accents, composed or not; null stays null."""
    out = F.translate(F.regexp_replace(F.lower(text), MARKS, ""), FOLD_FROM, FOLD_TO)
    for old, new in LIGATURES:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def fold_sql(text: str) -> str:
    """The same expression in SQL, for both engines."""
    out = f"translate(regexp_replace(lower({text}), '{MARKS}', '', 'g'), '{FOLD_FROM}', '{FOLD_TO}')"
    for old, new in LIGATURES:
        out = f"replace({out}, '{old}', '{new}')"
    return out


def place_key(text: Column) -> Column:
    """Folded text with runs of other characters as one blank; null for nothing left."""
    return F.nullif(F.trim(F.regexp_replace(fold(text), "[^a-z0-9]+", " ")), F.lit(""))


def core_key(text: Column, generics: tuple[str, ...] = GENERICS, articles: tuple[str, ...] = ARTICLES, least: int = CORE_LEAST) -> Column:
    """The key without its leading run of generic words and one article at its end; the whole key if too little is left."""
    key = place_key(text)
    core = F.regexp_replace(F.regexp_replace(key, f"^(({'|'.join(generics)}) )+", ""), f" ({'|'.join(articles)})$", "")
    return F.when(F.length(core) >= least, core).otherwise(key)


def label_core(text: Column, prefixes: tuple[str, ...] = PREFIXES) -> Column:
    """The text in lower case without exactly one generic prefix, accents kept; a generic alone leaves ''."""
    plain = F.trim(F.regexp_replace(F.lower(text), "\\s+", " "))
    return F.regexp_replace(plain, f"^({'|'.join(prefixes)})( |$)", "")


def slug(text: Column, most: int = 80) -> Column:
    """Folded words joined by '-', at most `most` characters, no '-' at the ends."""
    return F.regexp_replace(F.substring(F.regexp_replace(F.regexp_replace(fold(text), "[^a-z0-9]+", "-"), "^-+|-+$", ""), 1, most), "-+$", "")


def tokens(text: Column) -> Column:
    """Folded words: runs of letters and digits."""
    return F.filter(F.split(fold(text), "[^a-z0-9]+"), lambda t: t != "")


def query_tokens(query: str) -> list[str]:
    """A query's folded tokens; '1920s' asks for the prefix 192."""
    from re import fullmatch, split

    lowered = unicodedata.normalize("NFC", query.lower()).translate(str.maketrans(FOLD_FROM, FOLD_TO))
    for old, new in LIGATURES:
        lowered = lowered.replace(old, new)
    found = [t for t in split(r"[^a-z0-9]+", lowered) if t]
    return [t[:3] if fullmatch(r"\d{3}0s", t) else t for t in found]


def matches_prefixes(words: Column, query: list[str]) -> Column:
    """Whether every query token starts some word; an empty query matches all."""
    def starts(token: str) -> Column:
        return F.exists(words, lambda w: F.startswith(w, F.lit(token)))

    out = F.lit(True)
    for token in query:
        out = out & starts(token)
    return out


def contains_all(text: Column, query: list[str]) -> Column:
    """Whether the folded text contains every term of the query."""
    out, folded = F.lit(True), fold(text)
    for token in query:
        out = out & F.contains(folded, F.lit(token))
    return out


def trigrams(text: Column) -> Column:
    """Distinct trigrams of each word, padded by two blanks before and one after it."""
    padded = F.transform(tokens(text), lambda w: F.concat(F.lit("  "), w, F.lit(" ")))
    grams = F.flatten(F.transform(padded, lambda w: F.transform(F.sequence(F.lit(1), F.length(w) - 2), lambda k: F.substring(w, k, F.lit(3)))))
    return F.array_distinct(grams)


def trigram_share(query: Column, text: Column) -> Column:
    """Share of the query's trigrams that the text has: an approximation of word similarity."""
    own = trigrams(query)
    return F.try_divide(F.size(F.array_intersect(own, trigrams(text))).cast("double"), F.size(own))


def levenshtein_share(a: Column, b: Column) -> Column:
    """Edit distance divided by the longer length."""
    return F.try_divide(F.levenshtein(a, b).cast("double"), F.greatest(F.length(a), F.length(b)))


def word_bag(text: Column) -> Column:
    """Folded words in sorted order."""
    return F.array_join(F.array_sort(tokens(text)), " ")


def is_subsequence(a: Column, b: Column) -> Column:
    """Whether the words of `a` occur in `b` in the same order."""
    return F.aggregate(b, F.lit(0), lambda k, w: F.when(w == F.get(a, k), k + 1).otherwise(k)) == F.size(a)


def digit_signature(text: Column) -> Column:
    """All digit runs in order: a number is not a misspelt other number."""
    return F.array_join(F.regexp_extract_all(text, F.lit("([0-9]+)"), F.lit(1)), ",")


def year_in(text: Column) -> Column:
    """The first year 1500-2099 in free text, else null."""
    return F.nullif(F.regexp_extract(text, r"\b(1[5-9]\d\d|20\d\d)\b", 1), F.lit("")).cast("int")


def html_text(html: Column) -> Column:
    """Text of markup: no scripts, styles or tags, common entities decoded, blanks collapsed."""
    out = F.regexp_replace(html, r"(?s)<(script|style)[^>]*>.*?</(script|style)>", " ")
    out = F.regexp_replace(out, "<[^>]*>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&amp;", "&")):
        out = F.replace(out, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(out, "[ \\t\\n\\r]+", " "))

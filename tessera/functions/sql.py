"""The text keys as functions for SQL: temporary functions that Catalyst inlines, so no call of a function stays in a plan."""

from __future__ import annotations

from pyspark.sql import SparkSession

from tessera.functions.text import ARTICLES, CORE_LEAST, FOLD_FROM, FOLD_TO, GENERICS, LIGATURES, MARKS, PREFIXES


def _unaccented() -> str:
    out = f"translate(regexp_replace(lower(x), r'{MARKS}', ''), '{FOLD_FROM}', '{FOLD_TO}')"
    for old, new in LIGATURES:
        out = f"replace({out}, '{old}', '{new}')"
    return out


#: Name and body of each function of a string x; later ones may use earlier ones.
FUNCTIONS = {
    "f_unaccent": _unaccented(),
    "place_key": "nullif(trim(regexp_replace(f_unaccent(x), '[^a-z0-9]+', ' ')), '')",
    "place_core_key": (
        f"if(length(regexp_replace(regexp_replace(place_key(x), '^(({'|'.join(GENERICS)}) )+', ''), ' ({'|'.join(ARTICLES)})$', '')) >= {CORE_LEAST}, "
        f"regexp_replace(regexp_replace(place_key(x), '^(({'|'.join(GENERICS)}) )+', ''), ' ({'|'.join(ARTICLES)})$', ''), place_key(x))"
    ),
    "label_core": f"regexp_replace(trim(regexp_replace(lower(x), r'\\s+', ' ')), '^({'|'.join(PREFIXES)})( |$)', '')",
    "map_slug_base": "regexp_replace(substring(regexp_replace(regexp_replace(f_unaccent(x), '[^a-z0-9]+', '-'), '^-+|-+$', ''), 1, 80), '-+$', '')",
}


def register(spark: SparkSession) -> list[str]:
    """Creates the functions in the session, for spark.sql() and F.expr(); returns their names."""
    for name, body in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}(x STRING) RETURNS STRING RETURN {body}")
    return list(FUNCTIONS)

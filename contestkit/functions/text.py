"""Name and label functions over columns (STR-*), and ids made of text (HSH-*, ARR-01)."""

from __future__ import annotations

import json
import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Reviewed aliases, division limits in pounds, decision codes, weight classes with the most specific first.
ALIASES = {"bobby green": "king green", "terrance mickney": "terrance mckinney"}
DIVISION_LIMITS = {
    "atomweight": 105.0, "strawweight": 115.0, "flyweight": 125.0, "bantamweight": 135.0, "featherweight": 145.0, "lightweight": 155.0,
    "welterweight": 170.0, "middleweight": 185.0, "light heavyweight": 205.0, "heavyweight": 265.0, "super heavyweight": 300.0,
}
METHODS = {"U-DEC": "Decision - Unanimous", "S-DEC": "Decision - Split", "M-DEC": "Decision - Majority", "SUB": "Submission"}
WEIGHT_CLASSES = (
    "Super Heavyweight", "Light Heavyweight", "Heavyweight", "Middleweight", "Welterweight", "Lightweight", "Featherweight", "Bantamweight",
    "Flyweight", "Strawweight", "Atomweight", "Open Weight", "Catch Weight", "Catchweight",
)


def _map(values: dict) -> Column:
    return F.create_map(*[F.lit(x) for pair in values.items() for x in pair])


def display_name(c: Column) -> Column:
    """Null is empty; white space runs are one space; trimmed."""
    return F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"\s+", " "))


def name_key(c: Column) -> Column:
    """Lower case of the display name; keeps accents and punctuation."""
    return F.lower(display_name(c))


def _plain(text: str) -> str:
    return "".join(ch for ch in unicodedata.normalize("NFKD", text) if not unicodedata.combining(ch))


def fold_name(text: str | None) -> str:
    """No accents, lower case; dots and quotes go, dashes and slashes are spaces, other punctuation goes."""
    kept = re.sub(r"[-_/]", " ", re.sub(r"[.'`’]", "", _plain(text or "").lower()))
    return " ".join(re.sub(r"[^a-z0-9\s]", "", kept).split())


def card_name(text: str | None) -> str:
    """As ``fold_name`` with case folding, but other punctuation becomes a space."""
    kept = re.sub(r"[-_/]", " ", re.sub(r"[.'`’]", "", _plain(text or "").casefold()))
    return " ".join(re.sub(r"[^a-z0-9\s]", " ", kept).split())


def _vectorized(f: Callable[[str | None], str]) -> Callable[[Column], Column]:
    def of(names: pd.Series) -> pd.Series:
        return names.map(f)

    return lambda c: F.pandas_udf(of, "string")(c)


#: Unicode decomposition has no built-in function, so these two run vectorized in Python.
folded_name = _vectorized(fold_name)
folded_card_name = _vectorized(card_name)


def event_key(c: Column) -> Column:
    """Lower case, without dots and colons; other punctuation is a space."""
    return display_name(F.regexp_replace(F.regexp_replace(F.lower(F.coalesce(c, F.lit(""))), "[.:]", ""), "[^a-z0-9]+", " "))


def without_suffix(c: Column) -> Column:
    """Without a trailing generation mark."""
    return F.trim(F.regexp_replace(c, r"\s+(jr|sr|ii|iii|iv|v)$", ""))


def resolve_alias(c: Column, aliases: dict[str, str] = ALIASES) -> Column:
    return F.coalesce(F.try_element_at(_map(aliases), c), c)


def canonical_column(name: str) -> str:
    return re.sub(r"[\s_]", "", name.strip().lower())


def url_slug(c: Column) -> Column:
    """Last path segment; null for none."""
    return F.nullif(F.element_at(F.split(F.regexp_replace(F.trim(c), r"[?#].*$|/+$", ""), "/"), -1), F.lit(""))


def division_limit(c: Column) -> Column:
    return F.try_element_at(_map(DIVISION_LIMITS), F.regexp_replace(name_key(c), "^women'?s\\s+", ""))


def weight_class(c: Column) -> Column:
    """First of the known classes that the text holds, with its women's mark; else null."""
    low = F.lower(F.coalesce(c, F.lit("")))
    out = F.lit(None).cast("string")
    for name in reversed(WEIGHT_CLASSES):
        shown = {"Catchweight": "Catch Weight"}.get(name, name)
        out = F.when(low.contains(name.lower()), F.concat(F.when(low.contains("women"), "Women's ").otherwise(""), F.lit(shown))).otherwise(out)
    return out


def division_key(c: Column) -> Column:
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def division_column(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(c), "[^a-z0-9]+", "_"), F.lit("_"))


def method_name(c: Column) -> Column:
    return F.coalesce(F.try_element_at(_map(METHODS), F.trim(c)), F.trim(c))


def cells(c: Column) -> Column:
    """Parts between bars, trimmed, without empty ones."""
    return F.filter(F.transform(F.split(c, r"\|"), lambda x: F.trim(x)), lambda x: x != "")


def bout_sides(c: Column) -> Column:
    """Array of the two names, or null if there are not two."""
    sides = F.transform(F.split(c, r"(?i)\s+vs\.?\s+"), lambda x: F.trim(x))
    return F.when(F.size(sides) == 2, sides)


def pair_key(a: Column, b: Column) -> Column:
    """The same for (a, b) and (b, a)."""
    return F.array_sort(F.array(a, b))


def event_slug(name: Column, date: Column, key: Column | None = None) -> Column:
    """slug-date-digest; key is the event's name key, ``folded_card_name`` by default."""
    day = F.coalesce(date.cast("string"), F.lit(""))
    slug = F.nullif(F.trim(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), F.lit("-")), F.lit(""))
    digest = F.substring(F.sha2(F.concat_ws("|", day, folded_card_name(name) if key is None else key), 256), 1, 8)
    return F.concat_ws("-", F.coalesce(slug, F.lit("event")), day, digest)


def prediction_id(date: Column, a: Column, b: Column, model: Column, batch: Column) -> Column:
    """Sixteen digits; the order of the names does not matter."""
    sides = pair_key(name_key(a), name_key(b))
    return F.substring(F.sha1(F.concat_ws("|", date.cast("string"), sides[0], sides[1], model, batch)), 1, 16)


def prefixed_id(prefix: str, digits: int, *parts: Column) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, digits))


def schema_version(columns: list[str], family: str) -> str:
    import hashlib

    return f"{family}-{len(columns)}f-{hashlib.sha1('|'.join(columns).encode()).hexdigest()[:8]}"


def schema_version_of(names: Column, family: str) -> Column:
    """``schema_version`` of an array of names, in their order."""
    return F.concat(F.lit(f"{family}-"), F.size(names).cast("string"), F.lit("f-"), F.substring(F.sha1(F.array_join(names, "|")), 1, 8))


def canonical_json(value: object) -> str:
    """Sorted keys, no spaces; not-a-number is an error."""
    return json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)


def canonical_payload(payload: Column) -> Column:
    """JSON texts in one form, by executors (JSN-01): keys sorted, no spaces, numbers by their value (1.50 is 1.5, 2.0 is 2).

    Null for what is no JSON, repeats a key, or holds a number beyond a double.
    """
    text = F.to_json(F.try_parse_json(payload))
    return F.when(~(F.contains(text, F.lit('"Infinity"')) & ~F.contains(payload, F.lit("Infinity"))), text)

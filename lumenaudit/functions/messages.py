"""Texts by language, filled in as column expressions."""

from __future__ import annotations

import re
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT = "en"
#: Our own wording, by language and key; {name} takes a parameter.
CATALOG = {
    "en": {
        "status.ok": "fine",
        "status.warning": "to be improved",
        "status.critical": "to be mended",
        "status.not_measured": "not measured",
        "status.not_applicable": "does not apply",
        "bucket.high": "first",
        "bucket.medium": "next",
        "bucket.low": "later",
        "issue.line": "{key}: {status}, priority {priority}",
        "coverage.line": "{share} % of the rules' weight was measured",
    },
    "fr": {
        "status.ok": "correct",
        "status.warning": "à améliorer",
        "status.critical": "à corriger",
        "status.not_measured": "non mesuré",
        "status.not_applicable": "sans objet",
        "bucket.high": "d'abord",
        "bucket.medium": "ensuite",
        "bucket.low": "plus tard",
        "issue.line": "{key} : {status}, priorité {priority}",
    },
}


def message(key: Column, locale: Column | str = DEFAULT, catalog: dict[str, dict[str, str]] = CATALOG, /, **params: Column) -> Column:
    """The text of a key in a language, else in English, else the key itself, with its parameters filled in (null: empty)."""
    locale = F.lit(locale) if isinstance(locale, str) else locale
    maps = {n: F.create_map(*(F.lit(x) for kv in t.items() for x in kv)) for n, t in catalog.items()}
    own = reduce(lambda c, n: c.when(locale == n, F.try_element_at(maps[n], key)), list(maps)[1:], F.when(locale == next(iter(maps)), F.try_element_at(next(iter(maps.values())), key)))
    text = F.coalesce(own, F.try_element_at(maps[DEFAULT], key), key)
    # Parameters are filled in one after another; what they hold is text, not a pattern.
    return reduce(lambda c, kv: F.replace(c, F.lit("{" + kv[0] + "}"), F.coalesce(kv[1].cast("string"), F.lit(""))), params.items(), text)


def known(key: str, locale: str = DEFAULT, catalog: dict[str, dict[str, str]] = CATALOG) -> bool:
    return key in catalog.get(locale, {}) or key in catalog[DEFAULT]


def parameters(key: str, locale: str = DEFAULT, catalog: dict[str, dict[str, str]] = CATALOG) -> set[str]:
    return set(re.findall(r"\{(\w+)\}", catalog.get(locale, {}).get(key, catalog[DEFAULT].get(key, ""))))

"""The table of registered queries and their oracle SQL, and SQL that several of them share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


# Classes as corpusmill.functions.text spells them.
S = r"[\s\x1c-\x1f\x{85}\p{Z}]"
W = r"[\p{L}\p{N}_]"


def sql_collapse(x: str) -> str:
    return f"trim(regexp_replace({x}, '{S}+', ' ', 'g'))"


def sql_tokens(x: str) -> str:
    return f"list_filter(string_split({sql_collapse(x)}, ' '), lambda t: t <> '')"


def sql_urls(x: str) -> str:
    return f"regexp_replace({x}, '(?i)\\b(?:https?://|www\\.)[^\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')"


def sql_marks(x: str) -> str:
    """Mentions, hashtags and symbols."""
    x = f"regexp_replace({x}, '@{W}+', ' ', 'g')"
    x = f"regexp_replace({x}, '#{W}+', ' ', 'g')"
    return f"regexp_replace({x}, '[^\\p{{L}}\\p{{N}}_\\s\\x1c-\\x1f\\x{{85}}\\p{{Z}}]+', ' ', 'g')"


def sql_tags(x: str) -> str:
    return f"regexp_replace({x}, '<[^>]+>', ' ', 'g')"


def sql_unescape(x: str) -> str:
    """The entities that the sample pages have; the ampersand last, so nothing is unescaped twice."""
    for entity, char in (("quot", chr(34)), ("copy", "\u00a9"), ("middot", "\u00b7"), ("lt", "<"), ("gt", ">"), ("nbsp", "\u00a0")):
        x = f"replace({x}, '&{entity};', '{char}')"
    return f"regexp_replace({x}, '&amp;?', '&', 'g')"


def sql_clean(x: str) -> str:
    return sql_collapse(sql_marks(sql_tags(sql_urls(f"lower({x})"))))

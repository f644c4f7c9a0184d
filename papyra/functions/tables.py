"""Parsers as SQL table functions, for lateral joins: ``FROM responses, LATERAL parse_triples(text)``.

They are SQL themselves, so Catalyst puts them into the plan and no row leaves the JVM.
(Table functions in Python that take Arrow batches are not allowed in lateral joins.)
"""

from __future__ import annotations

from pyspark.sql import SparkSession

from . import policy as P
from .text import BLANKS

_BLANKS = "".join(f"\\u{ord(c):04x}" for c in BLANKS)


def _strip(x: str) -> str:
    return f"trim(BOTH '{_BLANKS}' FROM {x})"


def _unquote(x: str) -> str:
    return rf"""regexp_replace({x}, r'^(?s)(["\x27])(.*)\1$', '$2')"""


def _triples(response: str) -> str:
    """An array of the three parts of each triple of a response, as ``text.parse_triples``."""
    lines = f"filter(transform(split({response}, '\\n'), s -> {_strip('s')}), s -> length(s) - length(replace(s, '|', '')) = 2)"
    parts = f"transform({lines}, s -> transform(split(s, '[|]'), x -> {_unquote(_strip('x'))}))"
    good = f"filter({parts}, t -> forall(t, x -> x <> '' AND length(x) <= {P.TRIPLE_PART_CHARS}))"
    return f"transform({good}, t -> transform(t, x -> {_strip('x')}))"


FUNCTIONS = {
    "parse_triples": (
        "response STRING",
        "position INT, subject STRING, predicate STRING, object STRING",
        f"SELECT pos, t[0], t[1], t[2] FROM posexplode({_triples('response')}) AS p(pos, t)",
    ),
    "split_sentences": (
        "body STRING",
        "position INT, sentence STRING",
        rf"SELECT pos, s FROM posexplode(filter(transform(split({_strip('body')}, r'(?U)(?<=[.!?])\s+'), x -> {_strip('x')}), x -> x <> '')) AS p(pos, s)",
    ),
}


def register(spark: SparkSession) -> None:
    """Make the functions known to the session's SQL: ``parse_triples(text)``, ``split_sentences(text)``."""
    for name, (takes, returns, body) in FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({takes}) RETURNS TABLE({returns}) RETURN {body}")

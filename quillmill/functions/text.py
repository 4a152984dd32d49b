"""Column expressions on text: the code-aware tokenizer, entity tokens and LaTeX delimiters."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

IDENTIFIER = "[a-zA-Z_][a-zA-Z0-9_]*"


def subwords(token: Column) -> Column:
    """The parts of an identifier between underscores and where a capital follows a small letter or digit."""
    spaced = F.regexp_replace(F.regexp_replace(token, "([a-z0-9])([A-Z])", "$1_$2"), "_+", "_")
    return F.filter(F.split(F.lower(spaced), "_"), lambda w: w != "")


def with_subwords(token: Column) -> Column:
    """The lower-cased identifier, followed by its parts if there are two or more."""
    parts = subwords(token)
    whole = F.array(F.lower(token))
    return F.when(F.size(parts) >= 2, F.concat(whole, parts)).otherwise(whole)


def identifiers(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(IDENTIFIER), F.lit(0))


def tokenize(text: Column) -> Column:
    """All tokens of a text in order, repeats kept; text outside ASCII identifiers gives none."""
    return F.flatten(F.transform(identifiers(text), with_subwords))


def entity_tokens(entity: Column) -> Column:
    """An entity cut where Han characters meet others; white space separates too."""
    return F.regexp_extract_all(entity, F.lit(r"[一-鿿]+|[^\s一-鿿]+"), F.lit(0))


def latex_delimiters(text: Column) -> Column:
    """Display and inline brackets as dollar signs."""
    block = F.regexp_replace(text, r"(?s)\\\[(.*?)\\\]", r"\$\$$1\$\$")
    return F.regexp_replace(block, r"(?s)\\\((.*?)\\\)", r"\$$1\$")


def strip(text: Column) -> Column:
    """Without white space at either end, Unicode spaces included."""
    return F.regexp_replace(text, r"(?U)^\s+|\s+$", "")


def blank(text: Column) -> Column:
    return F.coalesce(strip(text), F.lit("")) == ""

"""Predicates as columns: literal search, null keys, ignored paths, status by role, questions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomstead.functions.text import fold, topic_key

#: Words that mark a question of what is allowed or due, in English and Czech.
QUESTION_WORDS = (
    "does", "can", "is", "should", "will", "could", "would", "may", "might", "must",
    "musí", "může", "lze", "smí", "má", "mají", "je", "jsou",
    "kdo", "kdy", "jak", "jaká", "jaké", "jaký", "který", "která", "které",
    "nutné", "povinné", "zakázáno", "povoleno",
)
ROLES_ALL = ("admin",)
OPEN_STATUSES = ("active", "all")


def contains(column: Column, term: str) -> Column:
    """Literal search: %, _ and \\ are characters like others; case is ignored. An empty term matches every non-null text."""
    return F.contains(F.lower(column), F.lit(term.lower()))


def folded_search(name: Column, description: Column, term: str) -> Column:
    """Name or description has the term, or the folded key of the name has that of the term."""
    key = topic_key(F.lit(term))
    plain = F.coalesce(contains(name, term), F.lit(False)) | F.coalesce(contains(description, term), F.lit(False))
    return plain | ((key != "") & F.coalesce(F.contains(topic_key(name), key), F.lit(False)))


def eq_or_null(column: Column, key: str | None) -> Column:
    """Equality in which the empty key stands for null."""
    return column.eqNullSafe(F.lit(key or None))


def ignored_path(path: Column) -> Column:
    """Some segment between / or \\ starts with an exclamation mark."""
    return F.exists(F.split(path, r"[\\/]"), lambda s: F.startswith(s, F.lit("!")))


def visible_status(column: Column, wanted: str, role: str) -> Column:
    """Rows of a status, or of all; who may not see hidden ones gets the active ones instead."""
    if role not in ROLES_ALL and wanted not in OPEN_STATUSES:
        wanted = "active"
    if wanted == "all":
        return F.lit(True) if role in ROLES_ALL else column == "active"
    return column == wanted


def is_question(text: Column) -> Column:
    """One of QUESTION_WORDS as a whole word, in any case."""
    return F.coalesce(text.rlike(r"(?iu)(?<![\p{L}\p{N}])(" + "|".join(QUESTION_WORDS) + r")(?![\p{L}\p{N}])"), F.lit(False))


def table_search(term: str, kind: str | None, columns: list[str], kind_column: str) -> Column:
    """The term in any of some columns, and a kind if one is asked for."""
    found = F.coalesce(contains(F.concat_ws("\n", *columns), term), F.lit(False))
    return found & (F.col(kind_column) == kind) if kind else found

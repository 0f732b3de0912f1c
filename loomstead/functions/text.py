"""Text as columns: folding, keys, labels, hashes, token estimates."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters that do not decompose, and what they fold to.
PLAIN = {"ß": "ss", "æ": "ae", "œ": "oe", "ø": "o", "đ": "d", "ð": "d", "ł": "l", "þ": "th", "ħ": "h", "ı": "i"}
#: Words that a topic name may end with and its display name leaves out; labels that don't follow the rule.
SUFFIXES = ("Methodology", "Methodologies", "Process", "Processes", "Guideline", "Guidelines", "Policy", "Policies", "Standard", "Standards", "Framework", "Frameworks")
LABELS = {"missionCritical": "Mission critical", "endOfLife": "End of life", "phaseIn": "Phase in", "phaseOut": "Phase out"}
MARKS = (0x0300, 0x036F)


def _letters() -> tuple[dict[str, str], dict[str, str]]:
    """Letters and what is left of them without marks: of one letter, and of more. By canonical decomposition of all
    characters of the first plane (syllable blocks, which bear no such marks, stay), and by PLAIN in both cases."""
    own = {}
    for letter, plain in PLAIN.items():
        own[letter] = plain
        if len(letter.upper()) == 1 and letter != "ı":
            own[letter.upper()] = plain.capitalize()
    own["ẞ"] = PLAIN["ß"].capitalize()
    one, more = {}, {}
    for code in [*range(0x80, 0xAC00), *range(0xF900, 0xFFFE)]:
        letter = chr(code)
        rest = "".join(own.get(c, c) for c in unicodedata.normalize("NFD", letter) if not MARKS[0] <= ord(c) <= MARKS[1])
        if rest and rest != letter and max(rest) <= "\uffff":
            (one if len(rest) == 1 else more)[letter] = rest
    return one, more


SINGLE, SEVERAL = _letters()


def _ranges(letters: dict[str, str], gap: int = 400) -> str:
    """A pattern of few ranges that all letters lie in, and others may: beyond Latin letters, letters less than `gap` apart are in one
    range. A gate for what is costly and right for any letter; patterns of many single letters are tried one after another."""
    codes, parts = sorted(map(ord, letters)), []
    for c in codes:
        if parts and c - parts[-1][1] <= (gap if c >= 0x250 else 1):
            parts[-1][1] = c
        else:
            parts.append([c, c])
    return "[" + "".join(f"\\u{a:04x}-\\u{b:04x}" for a, b in parts) + "]"


SEVERAL_GATE = _ranges(SEVERAL)
REST = {k: v for k, v in SEVERAL.items() if not v.isascii()}
REST_GATE = _ranges(REST)


def fold(text: Column) -> Column:
    """Letters without marks; case stays. Combining marks (U+0300 to U+036F) are dropped. ASCII texts, which have as many bytes as
    characters, are as they are; letters that fold to several are looked for by a coarse pattern, as most texts have none."""
    bare = F.regexp_replace(text, "[\u0300-\u036f]", "")
    out = F.translate(bare, "".join(SINGLE), "".join(SINGLE.values()))
    full = out
    for letter, plain in SEVERAL.items():
        if plain.isascii():
            full = F.replace(full, F.lit(letter), F.lit(plain))
    known = F.create_map(*[F.lit(x) for kv in REST.items() for x in kv])
    each = F.array_join(F.transform(F.split(full, ""), lambda c: F.coalesce(F.element_at(known, c), c)), "")
    full = F.when(text.rlike(REST_GATE), each).otherwise(full)
    return F.when(F.octet_length(text) == F.length(text), text).when(text.rlike(SEVERAL_GATE), full).otherwise(out)


def topic_name(name: Column) -> Column:
    """Dashes are one dash, underscores and spaces one space; one of the closing words of SUFFIXES goes, unless it is all there is."""
    dashed = F.translate(F.regexp_replace(name, "[\u2010-\u2015]", "-"), "_", " ")
    plain = F.trim(F.regexp_replace(dashed, r"(?U)\s+", " "))
    bare = F.regexp_replace(plain, r"(?i)\s+(" + "|".join(SUFFIXES) + ")$", "")
    return F.when(bare == "", F.trim(name)).otherwise(bare)


def topic_key(name: Column) -> Column:
    """The display name lower-cased, without parentheses, folded, letters, digits and single spaces only; if nothing is left,
    the display name lower-cased. Dashes part words as spaces do."""
    low = F.lower(topic_name(name))
    spaced = F.regexp_replace(fold(F.regexp_replace(low, r"\([^)]*\)", " ")), r"(?U)[-\s]+", " ")
    key = F.trim(F.regexp_replace(F.regexp_replace(spaced, "[^a-z0-9 ]", ""), " +", " "))
    return F.when(key != "", key).otherwise(low)


def words_key(text: Column) -> Column:
    """Lower-cased and folded, every run of other characters one space: equal keys mean the same statement or label."""
    return F.trim(F.regexp_replace(F.lower(fold(text)), r"[^\p{L}\p{N}]+", " "))


def label(value: Column) -> Column:
    """camelCase and underscores to words, first letter upper; blank is "Not set"."""
    spaced = F.lower(F.replace(F.regexp_replace(value, "([a-z0-9])([A-Z])", "$1 $2"), F.lit("_"), F.lit(" ")))
    plain = F.concat(F.upper(F.substring(spaced, 1, 1)), F.substring(spaced, 2, 1_000_000))
    known = F.element_at(F.create_map(*[F.lit(x) for kv in LABELS.items() for x in kv]), value)
    return F.when(F.coalesce(F.trim(value), F.lit("")) == "", F.lit("Not set")).otherwise(F.coalesce(known, plain))


def blank_to_null(value: Column) -> Column:
    return F.nullif(F.trim(value), F.lit(""))


def content_hash(text: Column) -> Column:
    return F.sha2(text, 256)


def members_hash(members: Column) -> Column:
    """Of a set of ids, whatever their order."""
    return F.sha2(F.concat(F.array_join(F.transform(F.sort_array(members), lambda x: x.cast("string")), ","), F.lit(":"), F.size(members).cast("string")), 256)


def fingerprint(category: Column, title: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.coalesce(category, F.lit("")), words_key(title)), 256)


def token_estimate(text: Column) -> Column:
    """Tokens of a text at 3.5 characters each, rounded up; 0 for null."""
    return F.ceil(F.coalesce(F.length(text), F.lit(0)) / 3.5).cast("long")


def tokens(text: Column) -> Column:
    """Words of letters and digits with at least 3 characters."""
    return F.filter(F.split(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " "), r"\s+"), lambda w: F.length(w) >= 3)

"""Scalar text functions (survey F1-F20) as Column expressions.

Those that work on arrays or bind a value (``let``) are interpreted; the others keep whole-stage code generation.

Nulls behave as empty strings where a function says so. Regular expressions carry ``(?U)`` so that word characters and
boundaries are those of Unicode, not of ASCII.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: ASCII punctuation, and the subset that the packing normaliser turns into spaces.
PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""
PACK_PUNCTUATION = ".,!?;:'\"()[]{}-_`"
YEAR = r"(?U)\b(1[5-9]\d{2}|20\d{2}|2100)\b"
BACKTICK_ID = "`([a-z0-9][a-z0-9-]*)`"


def col_of(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def _text(value: Column | str) -> Column:
    return F.coalesce(col_of(value), F.lit(""))


def let(value: Column, body) -> Column:
    """Bind a value once for an expression that uses it many times; else each use would compute it again."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def collapse(value: Column | str) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(_text(value), r"(?U)\s+", " "))


def _without_punctuation(value: Column) -> Column:
    return F.translate(value, PUNCTUATION, "")


def _without_articles(value: Column) -> Column:
    return F.regexp_replace(value, r"(?U)\b(a|an|the)\b", " ")


def strip(value: Column | str) -> Column:
    return F.regexp_replace(_text(value), r"(?U)^\s+|\s+$", "")


def normalize_answer_teacher(value: Column | str) -> Column:
    """right quotes unified, punctuation deleted, then articles dropped."""
    plain = F.replace(F.lower(strip(value)), F.lit("’"), F.lit("'"))
    return collapse(_without_articles(_without_punctuation(plain)))


def normalize_answer_eval(value: Column | str) -> Column:
    """F2, the exact-match metric: articles dropped, then punctuation deleted."""
    return collapse(_without_punctuation(_without_articles(strip(F.lower(_text(value))))))


def normalize_answer_pack(value: Column | str) -> Column:
    """some punctuation becomes a space, articles stay."""
    return collapse(F.translate(F.lower(strip(value)), PACK_PUNCTUATION, " " * len(PACK_PUNCTUATION)))


def normalize_question(value: Column | str) -> Column:
    """F4."""
    return F.lower(collapse(value))


def clean_prediction(value: Column | str) -> Column:
    """one quote at each end is taken off."""
    return strip(F.regexp_replace(strip(value), r"^['\"]|['\"]$", ""))


def compact_text(value: Column | str, limit: int) -> Column:
    """collapsed, cut at ``limit`` code points with an ellipsis."""
    whole = collapse(value)
    return F.when(F.length(whole) > limit, F.concat(F.rtrim(F.substring(whole, 1, limit)), F.lit("..."))).otherwise(whole)


def clip_text(value: Column | str, limit: int) -> Column:
    """cut so that the ellipsis still fits into ``limit``."""
    whole = strip(value)
    return F.when(F.length(whole) > limit, F.concat(F.rtrim(F.substring(whole, 1, limit - 3)), F.lit("..."))).otherwise(whole)


def prefix(value: Column | str, limit: int) -> Column:
    """F8: the first ``limit`` code points."""
    return F.substring(_text(value), 1, limit)


def word_count(value: Column | str) -> Column:
    """number of white-space separated words."""
    return F.size(F.filter(F.split(_text(value), r"(?U)\s+"), lambda w: w != "")).cast("bigint")


def any_cue(value: Column, cues: Iterable[str]) -> Column:
    """whether a cue occurs as a substring."""
    found = F.lit(False)
    for cue in cues:
        found = found | F.contains(value, F.lit(cue))
    return found


def starts_with_any(value: Column, prefixes: Iterable[str]) -> Column:
    """F11."""
    found = F.lit(False)
    for p in prefixes:
        found = found | F.startswith(value, F.lit(p))
    return found


def has(value: Column, pattern: str) -> Column:
    """regular expression search with Unicode classes."""
    return value.rlike(pattern if pattern.startswith("(?") else f"(?U){pattern}")


def count_matches(value: Column, pattern: str) -> Column:
    return F.regexp_count(value, F.lit(pattern if pattern.startswith("(?") else f"(?U){pattern}"))


def short_md5(value: Column, digits: int = 16) -> Column:
    """group id of a signature."""
    return F.substring(F.md5(value.cast("binary")), 1, digits)


def packet_id(dataset: Column, signature: Column) -> Column:
    """id of a packet group."""
    return F.concat(dataset, F.lit("_sig_"), F.substring(F.sha1(F.concat(dataset, F.lit("::"), signature).cast("binary")), 1, 12))


def _quoted(value: Column) -> Column:
    """A JSON string; control characters but newline, tab and return do not occur in the texts that are shown so."""
    out = value
    for plain, shown in (("\\", "\\\\"), ('"', '\\"'), ("\n", "\\n"), ("\t", "\\t"), ("\r", "\\r")):
        out = F.replace(out, F.lit(plain), F.lit(shown))
    return F.concat(F.lit('"'), out, F.lit('"'))


def json_pair(name: str, kind: str, value: Column) -> Column:
    """``"name": value``; kinds: text, number, texts (an array)."""
    if kind == "number":
        shown = F.coalesce(value.cast("string"), F.lit("null"))
    elif kind == "texts":
        shown = F.concat(F.lit("["), F.array_join(F.transform(value, _quoted), ", "), F.lit("]"))
    else:
        shown = F.coalesce(_quoted(value), F.lit("null"))
    return F.concat(F.lit(f'"{name}": '), shown)


def canonical_json(fields: dict[str, tuple[str, Column]]) -> Column:
    """sorted keys with ``", "`` and ``": "`` between; kinds: text, number, texts (an array)."""

    return F.concat(F.lit("{"), F.concat_ws(", ", *[json_pair(name, *fields[name]) for name in sorted(fields)]), F.lit("}"))


def target_size(n: Column, types: Column, hops: Column) -> Column:
    """F16: size of a coverage sample: a tenth of the rows plus a part for each type and hop count."""
    wanted = F.bround(n * F.lit(0.10) + types * 1200 + hops * 1000).cast("bigint")
    return F.least(F.greatest(wanted, F.lit(5000).cast("bigint")), n.cast("bigint"))


def rare_threshold(n: Column, least: int, share: float) -> Column:
    """max(least, ceil(share * n)), e.g. (12, 0.002) for flat and (24, 0.003) for pruned samples."""
    return F.greatest(F.lit(least).cast("bigint"), F.ceil(n * F.lit(share)))


def sorted_distinct(values: Column) -> Column:
    """F17."""
    return F.array_sort(F.array_distinct(values))


def distinct_in_order(values: Column) -> Column:
    """Trimmed, without blanks, first occurrences."""
    return F.array_distinct(F.filter(F.transform(F.coalesce(values, F.array().cast("array<string>")), strip), lambda v: v != ""))


def choices(*pairs: tuple[Column, str]) -> Column:
    """The labels whose condition holds, in the order given."""
    return F.array_compact(F.array(*[F.when(when, F.lit(label)) for when, label in pairs]))


def clamp(value: Column, low: int, high: int) -> Column:
    """F20."""
    return F.greatest(F.lit(low), F.least(F.lit(high), value))


def gold_answers(*candidates: Column) -> Column:
    """The first non-empty list, trimmed, without blanks; scalars are given as one-element arrays."""
    none = F.array().cast("array<string>")
    first = F.coalesce(*[F.when(F.size(c) > 0, c) for c in candidates], none)
    return F.filter(F.transform(first, strip), lambda v: v != "")


def exact_match(prediction: Column, gold: Column, teacher: bool = False) -> Column:
    """M6: whether the normalised prediction equals a normalised gold answer.

    The teacher's variant is false for a prediction that normalises to nothing and ignores blank gold answers.
    """
    norm = normalize_answer_teacher if teacher else normalize_answer_eval
    own = norm(prediction)
    found = F.exists(F.coalesce(gold, F.array().cast("array<string>")), lambda g: (norm(g) == own) & ((norm(g) != "") if teacher else F.lit(True)))
    return (own != "") & found if teacher else found

"""Generated text to columns, with a reason for every text that does not parse."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from gradus.functions.text import strip
from gradus.schema import OPTION_ANALYSIS_DDL

# Fixed values
EXTRACTION_KEYS = {
    "predicates": "Predicates",
    "constants": "Constants",
    "logical_expressions": "Logical Expressions",
}
# Of the literal reading only.  A quote before the key is passed over like any other character, and the
# key's first letter is a plain class: both let the search skip through a text much faster.
LIST_PATTERN = r'{first}(?iu:{rest})"?\s*:\s*(\[[^\]]*\])'
ITEM_PATTERN = r'"([^"]+)"'

# The key, and all that follows it from the opening bracket on.
_TAIL_PATTERN = r'(?ius)"?{key}"?\s*:\s*(\[.*)'
_CORRUPT = "_corrupt_record"
_JSON_OPTIONS = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": _CORRUPT}
ANALYSIS_KEY = '"option_analysis"'
EMPTY_COMPLETION = "empty completion"
LISTS_NOT_FOUND = "lists not found"
ANALYSIS_NOT_FOUND = "option_analysis not found"
ANALYSIS_NOT_JSON = "option_analysis is not valid JSON"


def _once(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)`` with ``value`` evaluated a single time per row."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def completion_text(completions: Column, many: bool = True) -> Column:
    """Trimmed ``generated_text`` of a completion, empty when missing.

    ``completions`` is a list, of which the first counts, or with ``many=False`` a
    single struct.
    """
    one = F.get(completions, F.lit(0)) if many else completions
    return strip(F.coalesce(one["generated_text"], F.lit("")))


def _whole_lists(text: Column) -> Column:
    """The three lists as JSON arrays; null where one is missing or does not parse."""

    def read(key: str) -> Column:
        # The parser stops at the end of the array, whatever follows it.
        tail = F.regexp_extract(text, _TAIL_PATTERN.format(key=key), 1)
        return F.from_json(tail, "array<string>")

    return F.struct(*[read(key).alias(name) for name, key in EXTRACTION_KEYS.items()])


def _literal_items(raw: Column) -> Column:
    """What ``ITEM_PATTERN`` finds: every second stretch between quotes, unless two quotes touch.

    Touching quotes hold no item, so the second of them opens the next one; only lists that have
    some are matched item by item.  A stretch that no quote ends is no item.
    """

    def second(pieces: Column) -> Column:
        return F.filter(pieces, lambda _, i: (i.bitwiseAND(1) == 1) & (i < F.size(pieces) - 1))

    return F.when(raw.contains('""'), F.regexp_extract_all(raw, F.lit(ITEM_PATTERN), 1)).otherwise(
        _once(F.split(raw, '"'), second)
    )


def _literal_lists(text: Column) -> Column:
    """The quoted items up to the first closing bracket after each key."""

    def read(key: str) -> Column:
        first = f"[{key[0].upper()}{key[0].lower()}]"
        found = F.regexp_extract(text, LIST_PATTERN.format(first=first, rest=key[1:]), 1)
        return _once(found, lambda raw: F.when(raw != "", _literal_items(raw)))

    return F.struct(*[read(key).alias(name) for name, key in EXTRACTION_KEYS.items()])


def parse_extraction(text: Column, mode: str = "whole") -> Column:
    """Struct of the three lists, ``assistant_content`` and ``reject_reason``.

    ``whole`` reads each list as a JSON array.  ``literal`` ends a list at the first
    closing square bracket, also inside an item.  All three lists must be there;
    otherwise all are empty and the raw text is kept.
    """
    if mode not in ("whole", "literal"):
        raise ValueError("mode must be 'whole' or 'literal'")
    read = _whole_lists if mode == "whole" else _literal_lists

    def columns(row: Column) -> Column:
        raw, lists = row["text"], row["lists"]
        complete = F.lit(True)
        for name in EXTRACTION_KEYS:
            complete = complete & lists[name].isNotNull()
        return F.struct(
            *[
                F.when(complete, lists[name])
                .when(raw != "", F.array().cast("array<string>"))
                .alias(name)
                for name in EXTRACTION_KEYS
            ],
            F.when((raw != "") & ~complete, raw).alias("assistant_content"),
            F.when(F.coalesce(raw, F.lit("")) == "", EMPTY_COMPLETION)
            .when(~complete, LISTS_NOT_FOUND)
            .alias("reject_reason"),
        )

    bound = lambda t: F.struct(t.alias("text"), read(t).alias("lists"))
    return _once(text, lambda t: _once(bound(t), columns))


def parse_option_analysis(text: Column, mode: str = "wrapped") -> Column:
    """Struct of ``option_analysis``, ``assistant_content``, ``reject_reason``.

    ``wrapped`` reads the list that follows the key.  ``literal`` reads the first
    object after the key and looks the key up inside it, which yields an empty
    list for the usual layout.
    """
    if mode not in ("wrapped", "literal"):
        raise ValueError("mode must be 'wrapped' or 'literal'")

    def read(t: Column) -> Column:
        at = F.locate(ANALYSIS_KEY, t)
        tail = F.substr(t, at)
        brace = F.locate("{", tail)
        document = F.concat(F.lit("{"), tail) if mode == "wrapped" else F.substr(tail, brace)
        parsed = F.from_json(
            document, f"option_analysis {OPTION_ANALYSIS_DDL}, {_CORRUPT} string", _JSON_OPTIONS
        )
        return F.struct(
            t.alias("text"), ((at > 0) & (brace > 0)).alias("present"), parsed.alias("parsed")
        )

    def columns(row: Column) -> Column:
        raw, present, parsed = row["text"], row["present"], row["parsed"]
        good = present & parsed[_CORRUPT].isNull()
        reason = (
            F.when(F.coalesce(raw, F.lit("")) == "", EMPTY_COMPLETION)
            .when(~present, ANALYSIS_NOT_FOUND)
            .when(~good, ANALYSIS_NOT_JSON)
        )
        empty = F.array().cast(OPTION_ANALYSIS_DDL)
        return F.struct(
            F.when(good, F.coalesce(parsed["option_analysis"], empty)).alias("option_analysis"),
            F.when((raw != "") & ~good, raw).alias("assistant_content"),
            reason.alias("reject_reason"),
        )

    return _once(text, lambda t: _once(read(t), columns))

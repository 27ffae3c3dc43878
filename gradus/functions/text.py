"""Column expressions that normalise the fields of a raw record."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values -------------------------------------------------------------
# Characters removed by a Unicode-aware strip.
WHITESPACE = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0 "
    "           "
    "    　"
)
ANSWER_INDEX = {"a": "0", "b": "1", "c": "2", "d": "3"}
TRUTH_TEXT = {"True": "yes", "False": "no", "Uncertain": "uncertain"}
OPTION_LETTERS = ("A.", "B.", "C.", "D.")
SPLIT_RULES = {
    "dev": (("train", "train"), ("dev", "dev"), ("test", "test")),
    "val": (("train", "train"), ("val", "dev"), ("test", "test")),
    "validation": (("train", "train"), ("validation", "test")),
}
REASONING_RULES = (
    ("first_order_logic", "FOL"),
    ("nm_logic", "NM"),
    ("propositional_logic", "PL"),
)
MAX_OPTIONS = 4
NO_OPTION_TASKS = ("BQA", "NLI")
# --------------------------------------------------------------------------


def strip(col: Column) -> Column:
    """Trim Unicode whitespace on both sides."""
    return F.btrim(col, F.lit(WHITESPACE))


def text_or_empty(col: Column) -> Column:
    return F.coalesce(col.cast("string"), F.lit(""))


def truncate_options(
    options: Column, task_type: Column, max_options: int | None = MAX_OPTIONS
) -> Column:
    """First ``max_options`` options (None: all); none for yes/no tasks or without a list."""
    kept = F.when(task_type.isin(*NO_OPTION_TASKS), F.array().cast("array<string>")).otherwise(
        options if max_options is None else F.slice(options, 1, max_options)
    )
    return F.coalesce(kept, F.array().cast("array<string>"))


def strip_option_letter(option: Column) -> Column:
    """Trim, then drop one leading ``A.`` ... ``D.``."""
    option = strip(option)
    return F.when(
        F.substring(option, 1, 2).isin(*OPTION_LETTERS),
        strip(F.substr(option, F.lit(3))),
    ).otherwise(option)


def _lookup(col: Column, table: dict[str, str]) -> Column:
    """Value of ``col`` in a small fixed table, empty string when absent."""
    chain = F.lit("")
    for key, value in table.items():
        chain = F.when(col == key, value).otherwise(chain)
    return chain


def letter_to_index(letter: Column) -> Column:
    return _lookup(F.lower(letter), ANSWER_INDEX)


def truth_to_text(label: Column) -> Column:
    return _lookup(label, TRUTH_TEXT)


def join_premises(premises: Column) -> Column:
    return F.coalesce(F.array_join(premises, " "), F.lit(""))


def _first_match(col: Column, rules: Sequence[tuple[str, str]], default: str) -> Column:
    chain = F.lit(default)
    for needle, value in reversed(rules):
        chain = F.when(col.contains(needle), value).otherwise(chain)
    return chain


def split_from_name(
    name: Column, rules: Sequence[tuple[str, str]] = SPLIT_RULES["dev"], default: str = ""
) -> Column:
    """Train / dev / test from the file name, first matching rule wins."""
    return _first_match(F.lower(name), rules, default)


def reasoning_from_path(
    path: Column, rules: Sequence[tuple[str, str]] = REASONING_RULES, default: str = ""
) -> Column:
    """Reasoning type from the directory part of a path."""
    return _first_match(F.regexp_extract(path, "^(.*)/[^/]*$", 1), rules, default)

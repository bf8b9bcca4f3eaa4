"""Expressions on names: run labels, function names, workers, files."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Names under which trace functions are shown, and their kinds.
SHOWN_AS = {"dump": "write", "load": "read"}
KIND_OF = {
    "read_img": "Read",
    "save_results": "Write",
    "save_histogram": "Write",
    "increment": "Compute",
    "calculate_histogram": "Compute",
    "combine_histogram": "Compute",
    "run_participant": "Participant",
    "run_group": "Group",
    "flatten": "Compute",
}


def _lookup(table: dict[str, str], key: Column) -> Column:
    pairs = [F.lit(part) for item in table.items() for part in item]
    return F.try_element_at(F.create_map(*pairs), key)


def basename(path: Column) -> Column:
    """Text after the last slash."""
    return F.substring_index(path, "/", -1)


def parent_name(path: Column) -> Column:
    """Name of the folder that holds ``path``."""
    return F.substring_index(F.substring_index(path, "/", -2), "/", 1)


def capitalized(text: Column) -> Column:
    """First letter upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substr(text, F.lit(2))))


def shown_func(func: Column) -> Column:
    """Name under which a trace function is reported."""
    return capitalized(F.coalesce(_lookup(SHOWN_AS, func), func))


def func_kind(func: Column) -> Column:
    """Kind of a trace function; null when it has none."""
    return _lookup(KIND_OF, func)


def short_worker(worker: Column) -> Column:
    """Host name without its first dash-separated piece, the other dashes and the domain."""
    pieces = F.split(worker, "-")
    rest = F.slice(pieces, F.lit(2), F.greatest(F.size(pieces) - 1, F.lit(0)))
    return F.substring_index(F.array_join(rest, ""), ".", 1)


def effective_thread(framework: Column, thread: Column, process: Column) -> Column:
    """Spark runs one Python process per slot, so there the process stands for the thread."""
    return F.when(framework == "spark", process).otherwise(thread)


def lane_label(worker: Column, number: Column) -> Column:
    """Lane name of a worker's thread."""
    return F.concat(worker, F.lit("::thread"), number.cast("string"))


def clean_label(label: Column) -> Column:
    """Run label without the quotes that string parameters carry."""
    return F.replace(label, F.lit("'"), F.lit(""))


def label_framework(label: Column) -> Column:
    return F.split_part(label, F.lit(":"), F.lit(1))


def label_app(label: Column) -> Column:
    return F.split_part(label, F.lit(":"), F.lit(2))


def label_param(label: Column, name: str) -> Column:
    """One parameter of a run label; null when the label lacks it."""
    found = F.regexp_extract(clean_label(label), f":{re.escape(name)}=([^:]*)", 1)
    return F.nullif(found, F.lit(""))


def label_has(label: Column, name: str, value: object) -> Column:
    """Whether a parameter of a run label has the given text."""
    return F.concat(clean_label(label), F.lit(":")).contains(f":{name}={value}:")


def subject_of(folder: Column) -> Column:
    """Subject id: the text after the last dash of a ``sub-…`` folder."""
    return F.substring_index(folder, "-", -1)


def thousands(value: Column) -> Column:
    """Whole number, halves to even, with thousands separators."""
    return F.format_number(F.bround(value.cast("double"), 0), 0)


def stars(p_value: Column) -> Column:
    """Significance mark of a p-value."""
    return (
        F.when(p_value <= 0.0005, "***")
        .when(p_value <= 0.005, "**")
        .when(p_value <= 0.05, "*")
        .otherwise("")
    )

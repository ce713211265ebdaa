"""Code-to-label recodes used by the dataset builders."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from typing import Any

from pyspark.sql import Column
from pyspark.sql import functions as F


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def recode_map(value: Column | str, mapping: Mapping[Any, Any]) -> Column:
    """Label of a code; codes outside the mapping, and codes mapped to None, become NULL.

    Codes that share a label form one IN test, which stays inside codegen.
    """
    x = _col(value)
    by_label: dict[Any, list[Any]] = {}
    for code, label in mapping.items():
        if label is not None:
            by_label.setdefault(label, []).append(code)
    chain = F
    for label, codes in by_label.items():
        chain = chain.when(x.isin(*codes), F.lit(label))
    return chain if isinstance(chain, Column) else F.lit(None).cast("string")


def recode_binary(value: Column | str, match: Any, yes: Any, no: Any) -> Column:
    """``yes`` when equal to ``match`` (or in it, for a list); anything else, NULL too, is ``no``."""
    x = _col(value)
    options = match if isinstance(match, (list, tuple, set)) else [match]
    return F.when(F.coalesce(x.isin(*options), F.lit(False)), F.lit(yes)).otherwise(F.lit(no))


def recode_rules(rules: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    """The value of the first rule that holds."""
    chain = F
    for condition, value in rules:
        chain = chain.when(condition, F.lit(value))
    return chain.otherwise(F.lit(default))


def recode_last_wins(rules: Sequence[tuple[Column, Any]], default: Any = None) -> Column:
    """The value of the last rule that holds: later assignments overwrite earlier ones."""
    return recode_rules(list(reversed(list(rules))), default)


def coerce_numeric(value: Column | str, strip: str | None = None) -> Column:
    """Number in a text, NULL where it is none; ``strip`` names characters to remove first."""
    x = _col(value)
    if strip:
        x = F.regexp_replace(x.cast("string"), f"[{strip}]", "")
    return F.nanvl(F.trim(x.cast("string")).try_cast("double"), F.lit(None).cast("double"))


def sentinel_to_null(value: Column | str, *sentinels: Any) -> Column:
    """NULL instead of the codes that stand for "no answer"."""
    x = _col(value)
    return F.when(~x.isin(*sentinels), x)


def null_fill(value: Column | str, default: Any) -> Column:
    return F.coalesce(_col(value), F.lit(default))


def ordinal_label(position: Column | str, labels: Sequence[str]) -> Column:
    """Label at a 1-based position; NULL when the position is NULL or out of range."""
    index = _col(position).cast("int")
    inside = index.between(1, len(labels))
    return F.when(inside, F.element_at(F.array(*[F.lit(x) for x in labels]), index))


def name_or_self(value: Column | str, names: Mapping[str, str]) -> Column:
    """Display name, or the value itself where no name is given."""
    return F.coalesce(recode_map(value, names), _col(value))


Recoder = Callable[[Column], Column]


def recode_smoking(x: Column) -> Column:
    return F.when(x == 1, 1).otherwise(0)


def recode_alcohol(x: Column) -> Column:
    return recode_binary(x, [1, 2, 3, 4, 5], 1, 0)


def recode_kidney(x: Column) -> Column:
    return F.when(x.isNotNull(), F.when(x == 1, 1).otherwise(0))


def recode_diabetes(x: Column) -> Column:
    return recode_rules([(x.isin(1, 3), 1), (x == 2, 0)])


def recode_sex(x: Column) -> Column:
    return F.when(x.isNotNull(), F.when(x == 1, "Male").otherwise("Female"))


def recode_ethnicity(x: Column) -> Column:
    return recode_rules([
        (x.isin(1, 2), "Hispanic"), (x == 3, "White"), (x == 4, "Black"),
        (x == 6, "Asian"), (x == 7, "Other"),
    ])


# Named callbacks a concept list may refer to; users add their own with ``register_recoder``.
RECODERS: dict[str, Recoder] = {
    "nhanes_sex": recode_sex,
    "nhanes_smoke": recode_smoking,
    "nhanes_alcohol": recode_alcohol,
    "nhanes_kidney": recode_kidney,
    "nhanes_race": recode_ethnicity,
    "nhanes_diab": recode_diabetes,
}


def register_recoder(name: str, recoder: Recoder) -> None:
    RECODERS[name] = recoder


def apply_recoder(name: str, value: Column | str) -> Column:
    return RECODERS[name](_col(value))

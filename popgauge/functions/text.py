"""Parsing answers and rendering prompts, as column expressions over whole tables."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterable, Mapping, Sequence
from functools import lru_cache
from string import ascii_lowercase, ascii_uppercase

from pyspark.sql import Column
from pyspark.sql import functions as F

from popgauge.functions.hashing import once

WHITESPACE = " \t\n\r\f\x0b"
MAX_OPTIONS = 26

# Wording of the prompts.
ANSWER_RULE = (
    "\nBegin your answer with the capital letter corresponding to your chosen option below, "
    "followed by a dot and a justification."
)
PERSON = "For a person "
FACT_RULES = (
    "You are a data generator. Follow the rules strictly.\n"
    "RULES:\n"
    "1) Write a single narrative enclosed in <story>...</story>.\n"
    "2) Do NOT include headings, lists, analysis, or any text outside the tags.\n"
    "3) Mention ALL facts given below exactly once ({facts}).\n"
    "4) Keep it under 200 words.\n\n"
)
FACT_FORMAT = "OUTPUT FORMAT:\n<story>\n(your narrative here)\n</story>\n"


def _col(value: Column | str) -> Column:
    return F.col(value) if isinstance(value, str) else value


def strip(text: Column | str) -> Column:
    return F.btrim(_col(text), F.lit(WHITESPACE))


# ---------------------------------------------------------------- reading answers

def mentions(text: Column | str, words: Sequence[str]) -> Column:
    """Whether any of the words occurs as a whole word, in any case."""
    options = "|".join(re.escape(w.lower()) for w in sorted(set(words)))
    return _col(text).rlike(rf"(?iuU)\b({options})\b")


def parse_level(text: Column | str, levels: Sequence[Sequence[str]]) -> Column:
    """0-based index of the only level mentioned; 0.5 when several are; NULL when none is."""
    hits = [mentions(text, words) for words in levels]
    total = sum((h.cast("int") for h in hits), F.lit(0))
    chain = F.when(total > 1, F.lit(0.5))
    for index, hit in enumerate(hits):
        chain = chain.when(hit, F.lit(float(index)))
    return chain


def parse_number(text: Column | str) -> Column:
    """First (signed, possibly decimal) number in a text."""
    return F.regexp_extract(_col(text), r"-?\d+(?:\.\d+)?", 0).try_cast("double")


def first_letter(text: Column | str) -> Column:
    return F.substring(strip(text), 1, 1)


def parse_letter(text: Column | str, options: Column | str) -> Column:
    """Level that the leading option letter stands for; ``options`` is the ordered level array.

    NULL when the letter is none of the offered ones.
    """
    letter, levels = first_letter(text), _col(options)
    index = F.when(letter.rlike("^[A-Z]$"), F.ascii(letter) - F.lit(ord("A") - 1))
    return F.when(index <= F.size(levels), F.try_element_at(levels, index))


def probability_bins() -> list[str]:
    """The 22 answers a probability question offers: 0 %, twenty 5-point bins, 100 %."""
    return ["0%", *[f"{lo}% - {lo + 5}%" for lo in range(0, 100, 5)], "100%"]


def parse_prob_bin(answer: Column | str) -> Column:
    """Midpoint of "a% - b%", or the value of "a%", as a fraction."""
    x = _col(answer)
    lo = F.regexp_extract(x, r"^(\d+)%", 1).try_cast("double")
    hi = F.regexp_extract(x, r"^\d+% - (\d+)%$", 1).try_cast("double")
    return F.coalesce((lo + hi) / 200, lo / 100)


def extract_tag(text: Column | str, tag: str = "story") -> Column:
    """Text inside the tag. Without one: drop a leading heading, take the first paragraph."""
    x = _col(text)
    pattern = rf"(?isd)<{tag}>(.*?)</{tag}>"
    bare = F.regexp_replace(x, r"(?isd)^#+.*?$", "")
    bare = strip(F.regexp_replace(bare, r"(?isd)^(analyzing errors|analysis).*?$", ""))
    paragraphs = F.filter(
        F.transform(F.split(bare, r"\n\s*\n"), lambda p: strip(p)), lambda p: p != ""
    )
    fallback = F.coalesce(F.try_element_at(paragraphs, F.lit(1)), F.lit(""))
    return F.when(x.rlike(pattern), strip(F.regexp_extract(x, pattern, 1))).otherwise(fallback)


def strip_markup(text: Column | str) -> Column:
    return F.regexp_replace(_col(text), r"<[^>]+>|\{[^}]+\}", "")


def cap_words(text: Column | str, limit: int = 200) -> Column:
    """At most ``limit`` words; texts within the limit stay exactly as they are."""
    x = _col(text)
    words = F.split(strip(x), r"\s+")
    return F.when(F.size(words) > limit, F.array_join(F.slice(words, 1, limit), " ")).otherwise(x)


def negation_word(answer: Column | str) -> Column:
    return F.when(F.lower(strip(_col(answer).cast("string"))).isin("no", "false", "0"), "not").otherwise("")


def normalise_name(name: Column | str, *, drop: str = r"\d+",
                   renames: Mapping[str, str | None] | None = None) -> Column:
    """Lower-cased, trimmed name without the dropped characters; ``renames`` has the last word
    (a name renamed to None becomes NULL)."""
    plain = F.trim(F.regexp_replace(F.trim(F.lower(_col(name))), drop, ""))
    if not renames:
        return plain

    def renamed(x: Column) -> Column:
        chain = F
        for old, new in renames.items():
            chain = chain.when(x == old, F.lit(new))
        return chain.otherwise(x)

    return once(plain, renamed)  # a filter would cut the name anew for each of the renames


@lru_cache(maxsize=1)
def _ascii_folds() -> tuple[str, str, dict[str, str]]:
    """Compatibility folds of the basic plane: one-to-one as a translate table, longer as a map."""
    singles: dict[str, str] = {}
    longer: dict[str, str] = {}
    for code in range(0x80, 0x10000):
        char = chr(code)
        folded = unicodedata.normalize("NFKD", char).encode("ascii", "ignore").decode()
        if len(folded) == 1:
            singles[char] = folded
        elif folded:
            longer[char] = folded
    return "".join(singles), "".join(singles.values()), longer


def _char_class(chars: Iterable[str]) -> str:
    """Regular expression class of characters that mean nothing in one, neighbours as ranges."""
    ranges: list[list[int]] = []
    for code in sorted(map(ord, chars)):
        if ranges and ranges[-1][1] == code - 1:
            ranges[-1][1] = code
        else:
            ranges.append([code, code])
    return "[" + "".join(f"{chr(low)}-{chr(high)}" for low, high in ranges) + "]"


def ascii_fold(text: Column | str) -> Column:
    """Accents and compatibility forms reduced to ASCII; what has no ASCII form is dropped.

    Only texts that hold a character which folds to several are taken apart, and only at such characters."""
    source, target, longer = _ascii_folds()
    folds = F.create_map(*[F.lit(part) for pair in longer.items() for part in pair])
    known = F.regexp_replace(F.translate(_col(text), source, target), rf"[^\x00-\x7F](?<!{_char_class(longer)})", "")

    def spelled(x: Column) -> Column:
        pieces = F.split(x, r"(?<=[^\x00-\x7F])|(?=[^\x00-\x7F])")
        joined = F.array_join(F.transform(pieces, lambda p: F.coalesce(F.try_element_at(folds, p), p)), "")
        return F.when(x.rlike(r"[^\x00-\x7F]"), joined).otherwise(x)

    return once(known, spelled)


def slugify(text: Column | str) -> Column:
    """ASCII, word characters only, lower case, runs of spaces and hyphens as one underscore."""
    dropped = "".join(c for c in map(chr, range(128)) if not (c.isalnum() or c in "_-" or c in WHITESPACE))
    kept = F.translate(ascii_fold(text), ascii_uppercase + WHITESPACE + dropped, ascii_lowercase + " " * len(WHITESPACE))
    # A mark behind each space: what then stands between two spaces of a run goes, and one space with its mark is left.
    mark, space = F.lit("\x01"), F.lit(" ")
    marked = F.replace(F.replace(F.trim(kept), F.lit("-"), space), space, F.concat(space, mark))
    return F.replace(F.replace(marked, F.concat(mark, space), F.lit("")), F.concat(space, mark), F.lit("_"))


def safe_id(text: Column | str) -> Column:
    return F.regexp_replace(_col(text).cast("string"), "[^a-zA-Z0-9_]", "_")


def file_to_dataset(path: Column | str) -> Column:
    """Base name of a path, up to its first dot."""
    return F.regexp_extract(_col(path), r"([^/.]*)[^/]*$", 1)


# ---------------------------------------------------------------- writing prompts

def fill(template: Column | str, *values: Column) -> Column:
    """Template with its ``{}`` holes filled from left to right."""
    parts = F.split(_col(template), r"\{\}")
    pieces = [F.element_at(parts, 1)]
    for hole, value in enumerate(values, start=2):
        following = F.try_element_at(parts, F.lit(hole))
        pieces.append(F.when(following.isNull(), F.lit("")).otherwise(F.concat(value, following)))
    return F.concat(*pieces)


def possible_levels(variable: Column | str, levels: Column) -> Column:
    return F.concat(F.lit("(possible levels of "), _col(variable), F.lit(" are: "),
                    F.array_join(levels, ", "), F.lit(")"))


def prompt_high_dim(phrases: Column, question: Column) -> Column:
    """"For a person who is .., who is .., do they ..?" from the filled phrases in order."""
    return F.concat(F.lit(PERSON), F.array_join(phrases, ", "), F.lit(", "), question)


def answer_key(levels: Column | str) -> Column:
    """Lettered options, one per line; more options than letters is an error."""
    x = _col(levels)
    lines = F.transform(x, lambda level, i: F.concat(F.char(i + F.lit(ord("A"))), F.lit(". "), level))
    too_many = F.raise_error(F.lit(f"Supports up to {MAX_OPTIONS} items (A-Z)")).cast("string")
    return F.when(F.size(x) > MAX_OPTIONS, too_many).otherwise(F.array_join(lines, "\n"))


def option_prompt(prompt: Column | str, levels: Column | str) -> Column:
    return F.concat(F.lit("Input: "), _col(prompt), F.lit(ANSWER_RULE), answer_key(levels), F.lit("\nOutput: "))


def fact_sheet(facts: Mapping[str, Column | str], labels: Mapping[str, str]) -> Column:
    """Instruction that lists the facts of one respondent, in the order of ``facts``."""
    head = FACT_RULES.format(facts=", ".join(labels[name] for name in facts)) + "FACTS:\n"
    lines = [F.concat(F.lit(f"- {labels[name]}: "), F.coalesce(_col(value).cast("string"), F.lit("None")),
                      F.lit("\n")) for name, value in facts.items()]
    return F.concat(F.lit(head), *lines, F.lit(FACT_FORMAT))


def value_sheet(fact_names: Column, lines: Column) -> Column:
    """Instruction that lists each variable with its possible values."""
    before, after = FACT_RULES.split("{facts}")
    return F.concat(F.lit(before), fact_names, F.lit(after + "FACTS to be mentioned:\n"), lines,
                    F.lit("\n\n" + FACT_FORMAT))


def high_dim_title(dataset: Column, outcome: Column, conditions: Column) -> Column:
    """"DATASET: Outcome by A, B" from display names."""
    return F.concat(dataset, F.lit(": "), outcome, F.lit(" by "), F.array_join(conditions, ", "))

"""String expressions of the corpus jobs. All stay inside whole-stage code generation."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from corvane.vocab import ACTIONS, TEMPLATES, TRIGGERS


def capitalize(text: Column) -> Column:
    """First character upper case, all others lower case."""
    return F.concat(F.upper(F.substring(text, 1, 1)), F.lower(F.substring(text, F.lit(2), F.length(text))))


def rstrip_chars(text: Column, chars: str) -> Column:
    """Drop every trailing character that is in ``chars``."""
    return F.rtrim(text, F.lit(chars))


def lstrip_chars(text: Column, chars: str) -> Column:
    return F.ltrim(text, F.lit(chars))


def words(text: Column) -> Column:
    """Words between runs of whitespace; empty array for blank text."""
    return F.regexp_extract_all(text, F.lit(r"(\S+)"), F.lit(1))


def word_count(text: Column) -> Column:
    return F.size(words(text))


def first_word(text: Column) -> Column:
    return F.try_element_at(words(text), F.lit(1))


def rest_words(text: Column) -> Column:
    """All words but the first, joined by one space."""
    parts = words(text)
    return F.array_join(F.slice(parts, F.lit(2), F.greatest(F.size(parts), F.lit(1))), " ")


def command_part(command: Column, position: int) -> Column:
    """Part of an ``app.object.operation`` path, counted from 1; -1 is the last."""
    return F.try_element_at(F.split(command, r"\."), F.lit(position))


def operation_kind(operation: Column) -> Column:
    """Kind of a known operation name, null for an unknown one."""
    return F.when(operation.isin(ACTIONS), F.lit("actions")).when(operation.isin(TRIGGERS), F.lit("triggers"))


def is_trigger(command: Column) -> Column:
    return command_part(command, -1).isin(TRIGGERS)


def render_template(operation: str, app: str, obj: str, lowered: str = "false", on_unknown: str = "null") -> Column:
    """Utterance of an operation from columns (or SQL expressions) for its name and the names it is filled with.

    ``lowered`` is a condition that puts the names of a row in lower case. Unknown operations give null or, with
    ``on_unknown='raise'``, an error.
    """
    parts = {name: template.partition("{app} {object}") for name, template in TEMPLATES.items()}
    names = f"concat({app}, ' ', {obj})"
    head = " ".join(f"WHEN '{name}' THEN '{part[0]}'" for name, part in parts.items())
    tail = " ".join(f"WHEN '{name}' THEN '{part[2]}'" for name, part in parts.items())
    other = f"ELSE raise_error(concat('no template for operation ', {operation}))" if on_unknown == "raise" else ""
    return F.expr(
        f"concat(CASE {operation} {head} {other} END, CASE WHEN {lowered} THEN lower({names}) ELSE {names} END, "
        f"CASE {operation} {tail} END)"
    )


def _capitalized(x: str) -> str:
    return f"concat(upper(substring({x}, 1, 1)), lower(substring({x}, 2)))"


def trigger_phrase(column: str, compat: bool = False, specifies: bool = False) -> Column:
    """Turn a trigger description into the opening clause of a request.

    ``compat`` strips the leading *characters* of the prefix instead of the prefix itself;
    ``specifies`` adds the branch used by the evaluation sets.
    """

    def after(prefix: str) -> str:
        return f"ltrim('{prefix}', {column})" if compat else f"substring({column}, {len(prefix) + 1})"

    rest = after("Triggers when") if compat else f"ltrim({after('Triggers when')})"
    when = _capitalized(f"concat('When ', rtrim('.', {rest}))")
    extra = ""
    if specifies:
        phrase = _capitalized(f"concat('For', rtrim('.', {after('Specifies')}))")
        extra = f"WHEN startswith({column}, 'Specifies') THEN {phrase} "
    lowered = f"rtrim('.', lower({column}))"
    return F.expr(
        f"CASE WHEN startswith({column}, 'Triggers when') THEN {when} {extra}"
        f"WHEN endswith({column}, 's') THEN concat('For ', {lowered}) ELSE concat('For a ', {lowered}) END"
    )


def first_sentence(text: Column) -> Column:
    """Text up to the first full stop, closed by one."""
    return F.concat(F.substring_index(text, ".", 1), F.lit("."))


def canonical_vars(program: Column) -> Column:
    """Give every loop variable the same name, at its definition."""
    return F.regexp_replace(program, r"for (\w+) in", "for x in")


def clean_generation(text: Column, brackets: bool = True, compat: bool = False) -> Column:
    """Program text of a generation: no escapes or list brackets, no chatter before a colon.

    ``compat`` keeps only the segment between the first and second colon.
    """
    bare = F.translate(text, "\\[]" if brackets else "\\", "")
    program = F.translate(canonical_vars(bare), "\t", " ")
    flat = F.translate(program, "\n", " ")
    head = F.lower(F.substring_index(flat, ":", 1))
    if compat:
        tail = F.try_element_at(F.split(flat, ":"), F.lit(2))
    else:
        tail = F.substring(flat, F.locate(":", flat) + 1, F.length(flat))
    keep = (F.locate(":", flat) == 0) | head.contains("if ") | head.contains("for ")
    return F.when(keep, program).otherwise(F.trim(tail))


def normalise_label(text: Column) -> Column:
    return F.translate(canonical_vars(text), "\t", " ")


def program_tokens(text: Column) -> Column:
    """Token array of a program: identifiers and single punctuation marks, with line breaks kept."""
    return F.regexp_extract_all(text, F.lit(r"(\w+|[^\w ])"), F.lit(1))

"""Utterance keys, paths, languages and prompts as column expressions."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import TASK_PROMPTS
from .text import WS


def _without_suffix(name: Column, size: int = 4) -> Column:
    return F.substr(name, F.lit(1), F.greatest(F.length(name) - size, F.lit(0)))


def utt_id_read_speech(lang: Column, path: Column) -> Column:
    """Language, a dash, and the file name without its extension."""
    return F.concat(lang, F.lit("-"), F.element_at(F.split(_without_suffix(path), "/"), -1))


def utt_id_parliament(speaker: Column, ident: Column) -> Column:
    return F.concat(speaker, F.lit("-"), ident)


def year_of(ident: Column) -> Column:
    return F.substring(ident, 1, 4)


def utt_id_clip(clip: Column) -> Column:
    return _without_suffix(clip)


def lang_of_utt(utt: Column) -> Column:
    """Language code inside an utterance key, counted from the right."""
    return F.when(utt.contains("common_voice"), F.get(F.split(utt, "_"), F.size(F.split(utt, "_")) - 2)).otherwise(
        F.get(F.split(utt, "-"), F.size(F.split(utt, "-")) - 4)
    )


def lang_of_clip(clip: Column) -> Column:
    """Language code inside a clip name, counted from the left."""
    return F.get(F.split(clip, "_"), F.lit(2))


def source_command(template: str, *fields: Column) -> Column:
    """Render a read command; it is data and is never executed here."""
    return F.format_string(template, *fields)


def rewrite_path(path: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """Ordered literal replacements."""
    for old, new in rules:
        path = F.replace(path, F.lit(old), F.lit(new))
    return path


def samples_from_duration(seconds: Column, rate: int) -> Column:
    """Whole samples of a duration, truncated."""
    return (seconds * F.lit(rate)).cast("bigint")


def collapse_fields(text: Column) -> Column:
    """Fields re-joined by single spaces."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def instruction_prompt(prefix: Column, text: Column, postfix: Column) -> Column:
    return F.concat(prefix, text, postfix)


def render_prompt(parts: Sequence[str], fields: Mapping[str, Column]) -> Column:
    """One ``concat`` of literals and %fields."""
    return F.concat(*[fields[p[1:]] if p.startswith("%") else F.lit(p) for p in parts])


def render_task_template(task: Column | str, fields: Mapping[str, Column]) -> Column:
    """Prompt of a task, or of each row's own task; the tasks' fields must be in ``fields``."""
    if isinstance(task, str):
        return render_prompt(TASK_PROMPTS[task], fields)
    prompt = None
    for name, parts in TASK_PROMPTS.items():
        if all(p[1:] in fields for p in parts if p.startswith("%")):
            rendered = render_prompt(parts, fields)
            prompt = F.when(task == name, rendered) if prompt is None else prompt.when(task == name, rendered)
    return prompt.otherwise(F.raise_error(F.concat(F.lit("no template for task "), task)))


def known_reference(answer: Column, choices: Sequence[str]) -> Column:
    """A filter that keeps every row, and raises for an answer outside the choices.

    In a filter the check runs whatever columns are asked for; in a projection it may be pruned.
    """
    lowered = F.array(*[F.lit(c.lower()) for c in choices])
    error = F.raise_error(F.concat(F.lit("unknown reference answer: "), F.coalesce(answer, F.lit("null")))).cast("boolean")
    return F.when(F.array_contains(lowered, F.lower(answer)), F.lit(True)).otherwise(error)


def normalize_choice(answer: Column, choices: Sequence[str], reference: bool) -> Column:
    """Index of an answer in the ordered choices.

    An unknown hypothesis counts as the first choice; an unknown reference is an error
    (filter by ``known_reference`` to have it raised whatever is selected).
    """
    lowered = F.array(*[F.lit(c.lower()) for c in choices])
    at = F.array_position(lowered, F.lower(answer)) - 1
    if reference:
        return F.when(at >= 0, at).otherwise(F.raise_error(F.concat(F.lit("unknown reference answer: "), answer)))
    return F.greatest(at, F.lit(0).cast("bigint"))

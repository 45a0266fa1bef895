"""Text functions: cleaning, tokenizing, quoting.  Column in, Column out."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..fixed_values import SPACE

# All Unicode white space, as a Java character class and as a list.
WS = r"[\s\x1C-\x1F\x85\p{Z}]"
_WS_CHARS = (
    "\t\n\x0b\x0c\r\x1c\x1d\x1e\x1f \x85\xa0\u1680"
    + "".join(map(chr, range(0x2000, 0x200B)))
    + "\u2028\u2029\u202f\u205f\u3000"
)


def strip(text: Column) -> Column:
    return F.btrim(text, F.lit(_WS_CHARS))


def squash(text: Column) -> Column:
    """Strip, and make one space of every run of white space."""
    return F.trim(F.regexp_replace(text, f"{WS}+", " "))


def nfkc(text: Column, raw: Column | None = None) -> Column:
    """Compatibility normalization, in the JVM, by the Unicode library that Spark brings for its collations.

    A text of ASCII is normal already and is left as it is.  That is seen from ``raw``, a
    text that ``text`` is a part of.
    """
    raw = text if raw is None else raw
    is_wide = F.octet_length(raw) != F.length(raw)
    # decomposition, canonical order and composition in one call, which passes over normal text faster than a pattern finds other text
    composed = F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), text, F.lit(True))
    return F.when(is_wide, composed).otherwise(text)


# Everything that is no letter, number or control, and the controls that are white space.
_NO_WORD = r"[\s\x1C-\x1F\x85[^a-z0-9\p{L}\p{N}\p{C}]]+"


def _without(text: Column, raw: Column, opening: str, pattern: str) -> Column:
    """Matches removed; a raw text without an opening bracket is not searched."""
    present = raw.contains(opening[0])
    for bracket in opening[1:]:
        present = present | raw.contains(bracket)
    return F.when(present, F.regexp_replace(text, pattern, "")).otherwise(text)


def clean_basic(text: Column) -> Column:
    """Lower case, no bracketed remarks, only letters and digits, single spaces.

    Marks, symbols and punctuation become spaces, and a run of spaces one space.
    """
    plain = _without(F.lower(text), text, "<[", r"[<\[][^>\]]*[>\]]")
    plain = _without(plain, text, "(", r"\([^)]+\)")
    return F.trim(F.lower(F.regexp_replace(nfkc(plain, text), _NO_WORD, " ")))


CLEANERS: dict[str, Callable[[Column], Column]] = {"whisper_basic": clean_basic}


def register_cleaner(name: str, cleaner: Callable[[Column], Column]) -> None:
    """Make a cleaner of one's own available to ``cleaner_chain``."""
    CLEANERS[name] = cleaner


def cleaner_chain(text: Column, names: Sequence[str] | str | None) -> Column:
    """Apply the named cleaners in order.

    Of several members of the whisper family the last one listed serves for all.
    """
    names = [names] if isinstance(names, str) else list(names or [])
    unknown = [n for n in names if n not in CLEANERS]
    if unknown:
        raise ValueError(f"unknown cleaner: {', '.join(unknown)}")
    family = [n for n in names if n.startswith("whisper")]
    for name in names:
        text = CLEANERS[family[-1] if name in family else name](text)
    return text


def characters(text: Column) -> Column:
    """The code points of a text as ARRAY<STRING>."""
    return F.when(text == "", F.array().cast("array<string>")).otherwise(F.split(text, ""))


def _symbol_pattern(symbols: Sequence[str]) -> str:
    return "|".join(re.escape(s) for s in sorted(symbols, key=len, reverse=True))


def tokenize(
    text: Column,
    level: str,
    symbols: Sequence[str] = (),
    remove_symbols: bool = False,
) -> Column:
    """Tokens of a text as ARRAY<STRING>.

    ``symbols`` are non-linguistic symbols: one token each, or left out.
    """
    if level == "char":
        if symbols and remove_symbols:
            text = F.regexp_replace(text, _symbol_pattern(symbols), "")
        if symbols and not remove_symbols:
            tokens = F.regexp_extract_all(text, F.lit(f"(?s){_symbol_pattern(symbols)}|."), 0)
        else:
            tokens = F.when(text != "", F.split(text, "")).otherwise(F.array().cast("array<string>"))
        return F.transform(tokens, lambda t: F.when(t == " ", F.lit(SPACE)).otherwise(t))
    if level == "word":
        tokens = F.filter(F.split(text, f"{WS}+"), lambda t: t != "")
        if symbols and remove_symbols:
            tokens = F.filter(tokens, lambda t: ~t.isin(list(symbols)))
        return tokens
    raise ValueError(f"unknown token level: {level}")


def tokens_to_text(tokens: Column, level: str) -> Column:
    if level == "char":
        return F.array_join(F.transform(tokens, lambda t: F.when(t == SPACE, F.lit(" ")).otherwise(t)), "")
    return F.array_join(tokens, " ")


def script_runs(text: Column) -> Column:
    """Runs of letters ``A-z`` / ``À-ÿ`` and the rest between them, each with an ASCII flag."""
    runs = F.regexp_extract_all(text, F.lit(r"(?s)[A-zÀ-ÿ]+|[^A-zÀ-ÿ]+"), 0)
    return F.transform(
        runs, lambda r: F.struct(r.alias("run"), (~r.rlike(r"[^\x00-\x7F]")).alias("is_ascii"))
    )


def json_quote(text: Column) -> Column:
    """A text as one JSON string literal, line breaks included."""
    wrapped = F.to_json(F.struct(text.alias("v")))
    return F.when(text.isNotNull(), F.substr(wrapped, F.lit(6), F.length(wrapped) - 6))


def json_unquote(literal: Column) -> Column:
    wrapped = F.concat(F.lit('{"v":'), literal, F.lit("}"))
    return F.from_json(wrapped, "struct<v:string>", {"mode": "FAILFAST"}).getField("v")


def valid_target(prefix: Column, postfix: Column, output: Column) -> Column:
    """An output, and an instruction before or after: all as token arrays."""
    return (F.size(output) > 0) & ((F.size(prefix) > 0) | (F.size(postfix) > 0))


# The substitutions of the public 13a tokenizer, in order.
TOKENIZER_13A = (
    (r"([\{-\~\[-\` -\&\(-\+\:-\@\/])", " $1 "),
    (r"([^0-9])([\.,])", "$1 $2 "),
    (r"([\.,])([^0-9])", " $1 $2"),
    (r"([0-9])(-)", "$1 $2 "),
)
ENTITIES_13A = (("&quot;", '"'), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"))


def tokens_13a(text: Column) -> Column:
    """Words and punctuation of a text as the public 13a tokenizer separates them."""
    text = F.replace(F.replace(F.replace(text, F.lit("<skipped>"), F.lit("")), F.lit("-\n"), F.lit("")), F.lit("\n"), F.lit(" "))
    for name, char in ENTITIES_13A:
        text = F.replace(text, F.lit(name), F.lit(char))
    text = F.concat(F.lit(" "), text, F.lit(" "))
    for pattern, by in TOKENIZER_13A:
        text = F.regexp_replace(text, pattern, by)
    return tokenize(squash(text), "word")

"""Scalar text columns with Python string semantics, all as built-in expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from threadloom.functions import fixed

# Every character Python's str.strip() removes.
WHITESPACE = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
_SPACE = r"[\s\x1c-\x1f]"
_WORD = r"\p{L}\p{N}_"


def py_strip(text: Column) -> Column:
    """``str.strip()``: trims all Unicode white space, not just blanks."""
    return F.btrim(text, F.lit(WHITESPACE))


def is_blank(text: Column) -> Column:
    """True for null, empty and white-space-only text."""
    return F.coalesce(F.length(py_strip(text)) == 0, F.lit(True))


def line(author: Column, text: Column) -> Column:
    """``author: text``, the line used for contexts, histories and documents."""
    return F.concat(F.coalesce(author, F.lit("Unknown")), F.lit(": "), text)


# --- reply clean-up ---------------------------------------------------------

def cut_at_markers(text: Column) -> Column:
    """Keep what precedes the end marker, then the start marker, then the EOF text."""
    for marker in (fixed.IM_END, fixed.IM_START, fixed.EOF_MARK):
        text = py_strip(F.substring_index(text, marker, 1))
    return text


def is_prompt_echo(text: Column, assistant_name: str) -> Column:
    """Does the text begin with a phrase of the system prompt, whatever the case?"""
    lowered = F.lower(text)
    phrases = [p.format(name=assistant_name.lower()) for p in fixed.ECHO_PHRASES]
    return reduce(lambda a, b: a | b, [lowered.startswith(p) for p in phrases])


def fix_mojibake(text: Column) -> Column:
    return reduce(
        lambda col, pair: F.replace(col, F.lit(pair[0]), F.lit(pair[1])), fixed.MOJIBAKE, text
    )


def clean_reply(raw: Column, assistant_name: str) -> Column:
    """Model output to reply text: cut, swap echoes for the fallback, repair encoding."""
    cut = cut_at_markers(raw)
    return F.when(is_prompt_echo(cut, assistant_name), F.lit(fixed.ECHO_FALLBACK)).otherwise(
        fix_mojibake(cut)
    )


def cap_reply(text: Column, limit: int = fixed.MAX_REPLY_CHARS) -> Column:
    """Texts above ``limit`` characters end in an ellipsis at exactly ``limit``."""
    return F.when(
        F.length(text) > limit, F.concat(F.left(text, F.lit(limit - 3)), F.lit("..."))
    ).otherwise(text)


def assistant_turn(full_text: Column, prompt: Column) -> Column:
    """The reply inside a transcript that may still hold the prompt and markers."""
    tail = F.when(
        F.contains(full_text, F.lit(fixed.ASSISTANT_MARK)),
        F.substring_index(full_text, fixed.ASSISTANT_MARK, -1),
    ).otherwise(F.substr(full_text, F.length(prompt) + 1))
    for marker in (fixed.IM_END, fixed.IM_START):
        tail = py_strip(F.replace(py_strip(tail), F.lit(marker), F.lit("")))
    return tail


# --- mentions and commands ----------------------------------------------------

def mention_spellings(bot_id: str) -> list[str]:
    return [f"<@{bot_id}>", f"<@!{bot_id}>"]


def mentions(text: Column, bot_id: str) -> Column:
    plain, nick = (F.contains(text, F.lit(m)) for m in mention_spellings(bot_id))
    return plain | nick


def without_mentions(text: Column, bot_id: str) -> Column:
    """The message less both mention spellings, or the stock prompt when nothing is left."""
    for spelling in mention_spellings(bot_id):
        text = F.replace(text, F.lit(spelling), F.lit(""))
    rest = py_strip(text)
    return F.when(F.length(rest) == 0, F.lit(fixed.BLANK_MENTION_PROMPT)).otherwise(rest)


def command_argument(text: Column, command: str) -> Column:
    """What follows ``command`` and white space; null when absent or without argument."""
    rest = F.substr(text, F.lit(len(command) + 1))
    argument = py_strip(rest)
    separated = F.rlike(rest, F.lit(r"(?Us)^" + _SPACE))
    return F.when(text.startswith(command) & separated & (F.length(argument) > 0), argument)


# --- image commands -----------------------------------------------------------

def image_prompt(text: Column) -> Column:
    """Text after the first image command on its line; null when there is none."""
    found = [
        F.nullif(F.regexp_extract(text, "(?iUd)" + p.replace(r"\s", _SPACE), 1), F.lit(""))
        for p in fixed.IMAGE_COMMAND_PATTERNS
    ]
    return py_strip(F.coalesce(*found))


def clean_image_prompt(prompt: Column) -> Column:
    for word in fixed.IMAGE_COMMAND_WORDS:
        prompt = F.regexp_replace(prompt, "(?iu)" + word, "")
    return F.left(py_strip(prompt), F.lit(fixed.MAX_IMAGE_PROMPT_CHARS))


def image_file_name(prompt: Column) -> Column:
    """A file name from word characters and dashes."""
    kept = F.regexp_replace(prompt, rf"(?U)[^{_WORD}\s\x1c-\x1f-]", "")
    dashed = F.regexp_replace(
        F.left(kept, F.lit(fixed.MAX_SLUG_CHARS)), r"(?U)[-\s\x1c-\x1f]+", "-"
    )
    return F.concat(dashed, F.lit(".png"))

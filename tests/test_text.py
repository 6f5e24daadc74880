"""Scalar text columns against short Python restatements."""

import re

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from threadloom.functions import fixed, text

RELAXED = settings(
    max_examples=15, deadline=None, suppress_health_check=list(HealthCheck)
)
SPACE = st.sampled_from(list(text.WHITESPACE))
CHUNK = st.one_of(st.text(max_size=6), SPACE)
TEXTS = st.lists(
    st.lists(CHUNK, max_size=6).map("".join).filter(lambda s: "\x00" not in s), min_size=20,
    max_size=40,
)


def mixed(*pieces):
    """Lists of texts assembled from the pieces, white space and plain letters."""
    part = st.sampled_from([*pieces, " ", "\n", "a", "B c", "é"])
    return st.lists(st.lists(part, max_size=8).map("".join), min_size=20, max_size=40)


def test_whitespace_is_pythons():
    assert len(text.WHITESPACE) == 29
    assert all(c.isspace() for c in text.WHITESPACE)


@RELAXED
@given(TEXTS)
def test_py_strip(column_of, values):
    assert column_of(text.py_strip, values) == [v.strip() for v in values]


def test_is_blank(column_of):
    values = [None, "", " 　\t\x1c", " a ", "​"]
    assert column_of(text.is_blank, values) == [True, True, True, False, False]


@RELAXED
@given(mixed("<|im_end|>", "<|im_start|>", "> EOF by user", "<|im_"))
def test_cut_at_markers(column_of, values):
    def cut(s):
        for marker in ("<|im_end|>", "<|im_start|>", "> EOF by user"):
            s = s.split(marker)[0].strip()
        return s

    assert column_of(text.cut_at_markers, values) == [cut(v) for v in values]


@pytest.mark.parametrize("phrase", fixed.ECHO_PHRASES)
def test_prompt_echo(column_of, phrase):
    spoken = phrase.format(name="Max")
    values = [spoken, spoken.upper() + "!", "x " + spoken, spoken[:-1]]
    found = column_of(lambda c: text.is_prompt_echo(c, "Max"), values)
    assert found == [True, True, False, False]


def test_mojibake_table():
    assert len(fixed.MOJIBAKE) == 17
    assert len({bad for bad, _ in fixed.MOJIBAKE}) == 17


@RELAXED
@given(mixed(*[bad for bad, _ in fixed.MOJIBAKE], "â", "\u0080"))
def test_fix_mojibake(column_of, values):
    def repair(s):
        for bad, good in fixed.MOJIBAKE:
            s = s.replace(bad, good)
        return s

    assert column_of(text.fix_mojibake, values) == [repair(v) for v in values]


def test_punctuation_is_repaired_before_contractions(column_of):
    assert column_of(text.fix_mojibake, ["donâ\u0080\u0099t", "xdonâty"]) == ["don't", "xdon'ty"]


def test_clean_reply(column_of):
    values = ["  itâs ok <|im_end|> more", "Recent Conversation: a", "<|im_start|>", "You are Max"]
    found = column_of(lambda c: text.clean_reply(c, "max"), values)
    assert found == ["it's ok", "what", "", "what"]


def test_cap_reply(column_of):
    values = ["x" * 2000, "y" * 2001, "é" * 2500, ""]
    found = column_of(text.cap_reply, values)
    assert found == [values[0], "y" * 1997 + "...", "é" * 1997 + "...", ""]


def test_assistant_turn(column_of):
    cases = {
        "PROMPT hello": "hello", "PROMPT<|im_start|>assistant\nhi<|im_end|>\n": "hi",
        "<|im_start|>assistant a<|im_start|>assistant b": "b", "PROMPT": "", "PROMP": "",
        "PROMPT a<|im_end|> b <|im_start|>user": "a b user", "": "",
    }
    found = column_of(lambda c: text.assistant_turn(c, F.lit("PROMPT")), list(cases))
    assert found == list(cases.values())


def test_mentions(column_of):
    values = ["<@7> hi", "hi <@!7>\n", " <@7><@!7> ", "<@77>", "plain"]
    assert column_of(lambda c: text.mentions(c, "7"), values) == [True, True, True, False, False]
    assert column_of(lambda c: text.without_mentions(c, "7"), values) == [
        "hi", "hi", "Hey, what's up?", "<@77>", "plain",
    ]


def test_command_argument(column_of):
    values = ["!go  now ", "!go", "!going on", "x !go y", "!go\nline two\n", "!go  "]
    found = column_of(lambda c: text.command_argument(c, "!go"), values)
    assert found == ["now", None, None, None, "line two", None]


def test_image_prompt(column_of):
    cases = {
        "@Meta AI /imagine a cat": "a cat", "hey @meta\tai  /IMAGINE  two dogs ": "two dogs",
        "/imagine b\nsecond line": "b", "/imagine": None, "/Imagine\n\nfar below": "far below",
        "imagine c": None, "/imagine x @Meta AI /imagine y": "y", "": None,
    }
    assert column_of(text.image_prompt, list(cases)) == list(cases.values())


@RELAXED
@given(mixed("@Meta AI", "@META ai", "/imagine", "/ImAgInE", "long " * 20))
def test_clean_image_prompt(column_of, values):
    """Short, without white space at its start, nothing invented."""
    found = column_of(text.clean_image_prompt, values)
    assert all(len(f) <= 200 and f == f.lstrip() for f in found)
    plain = [v for v in values if "meta" not in v.lower() and "imagine" not in v.lower()]
    assert column_of(text.clean_image_prompt, plain) == [v.strip()[:200] for v in plain]
    assert column_of(text.clean_image_prompt, ["@meta AI a /IMAGINE b", "/imagine"]) == ["a  b", ""]


def test_image_file_name(column_of):
    cases = {
        "A cat, sleeping!": "A-cat-sleeping.png", "a-b -- c": "a-b-c.png", "½ x_y?": "½-x_y.png",
        "日本　の猫": "日本-の猫.png", "x" * 60: "x" * 50 + ".png", "": ".png", "!?": ".png",
    }
    assert column_of(text.image_file_name, list(cases)) == list(cases.values())

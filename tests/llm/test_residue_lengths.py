"""What is residue stays residue however long a name, a frame or a code line is."""

from __future__ import annotations

import time

import pytest

from skein.llm.residue import reasons

REAL = "We offer good work to all of you who come to our shop in the old town before nine in the morning. "
NAME = "a" * 300
FRAMES = ["home | menu | jobs | contact | login | privacy policy | terms of use | ", "menu / jobs / cookies / register / back / "]


@pytest.mark.parametrize("mark", ["{{ %s }}", "${%s}", "#{%s}", "[[ %s ]]", "@@%s@@", "<<%s>>", "{%s}", "{%% if %s %%}", "<%%= %s %%>", "[please insert %s here]"])
def test_long_names(mark):
    assert reasons(REAL + mark % NAME) == ["placeholder"] == reasons(REAL + mark % "abc")


@pytest.mark.parametrize("mark", ["%%%s%%", "__%s__", "*|%s|*"])
def test_long_capital_names(mark):
    assert reasons(REAL + mark % NAME.upper()) == ["placeholder"] == reasons(REAL + mark % "ABC")


@pytest.mark.parametrize("times", [1, 5, 6, 7, 8, 40])
@pytest.mark.parametrize("frame", FRAMES)
def test_notice_after_a_frame_of_any_length(frame, times):
    assert "notice" in reasons(frame * times + "javascript is disabled.")


@pytest.mark.parametrize("length", [10, 290, 310, 5000])
def test_code_of_any_length_is_no_placeholder(length):
    assert reasons(REAL + "`{{ x }}" + "y" * length + "`. " + REAL) == []
    assert reasons(REAL + "<pre class='" + "y" * length + "'>{{ x }}</pre> " + REAL) == []


@pytest.mark.parametrize("text", ["{{" * 100_000, "{{ a " * 100_000, "[ a" * 100_000, "`a" * 100_000 + "{{", "<code " * 100_000 + "{{", "menu " * 100_000 + "{{", "menu" + " " * 500_000 + "script", "__A" * 100_000, "{a." * 100_000, "asdf" * 100_000])
def test_no_text_makes_it_slow(text):
    began = time.time()
    reasons(text)
    assert time.time() - began < 5

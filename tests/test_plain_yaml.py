"""Plain YAML lines are read as the YAML parser reads them."""

from __future__ import annotations

import random

import pytest
import yaml

from doclake.sources import trees as src

KEYS = ["a", "b", "no", "On", "c-d", "_x", "null", "Y"]
VALUES = ["1", "0", "007", "x", "dos tres", "true", "Yes", "tRUE", "null", "n", "1.5", "1e3", "1_000", "2024-01-01", "2024-13-45", "0x1F", "0b1",
          "a - b", "a--b", "12 de mayo", "año", "~", "'q'", "[1]", "1:30", "", " x", "x ", "a: b", "- x", "#c", "é", "190" * 9, "2024-01-01 10:00", "-", "..."]


def random_text(r: random.Random) -> str:
    out, indent = [], 0
    for _ in range(r.randint(1, 7)):
        indent = r.choice([0, 0, indent, indent, indent + 2, max(0, indent - 2), r.randint(0, 5)])
        dash = r.choice(["", "", "- "])
        values = r.choice([VALUES, VALUES[:20]])
        body = r.choice([f"{r.choice(KEYS)}:", f"{r.choice(KEYS)}: {r.choice(values)}", r.choice(values)])
        out.append(" " * indent + dash + body)
    return "\n".join(out) + r.choice(["", "\n", "\n\n"])


def parsed(text: str):
    try:
        return yaml.load(text, Loader=yaml.CSafeLoader)
    except Exception as e:
        return type(e)


def test_plain_yaml_agrees_with_the_parser_wherever_it_is_sure():
    r, sure = random.Random(5), 0
    for _ in range(100_000):
        text = random_text(r)
        got = src.plain_yaml(text)
        if got is not src._UNSURE:
            sure += 1
            want = parsed(text)
            assert repr(got) == repr(want), text
    assert sure > 3_000


@pytest.mark.parametrize("text", ["a: 1\nb:\n  c: x\n  d:\n  - 1\n  - e: f\n    g:\n- h\n"[:-4], "- a: 1\n  b: no\n- dos\n", "a:\nb:\n- 1\nc: 2024-01-01\n"])
def test_settings_are_read_without_the_parser(text, monkeypatch):
    want = parsed(text)
    src._plain_scalar("2024-01-01"), src._plain_scalar("no")
    monkeypatch.setattr(yaml, "load", None)
    assert src.yaml_value(text) == want

"""Replies: broken texts of known objects come back, forms by hand."""

import json
import re

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from pathloom.operators import replies

TEXT = st.text(st.sampled_from("ab ,:é\n\t/\\"), max_size=8)
SCALAR = st.one_of(st.integers(-999, 999), st.booleans(), st.none(), TEXT)
VALUE = st.recursive(SCALAR, lambda v: st.one_of(st.lists(v, max_size=3), st.dictionaries(TEXT, v, max_size=3)), max_leaves=8)
OBJECT = st.dictionaries(TEXT.filter(bool), VALUE, min_size=1, max_size=4)


def damages(text):
    outside = re.sub(r'"(?:[^"\\]|\\.)*"', lambda m: "S" * len(m[0]), text)  # where no string is
    at = lambda chars: [i for i, c in enumerate(outside) if c in chars]
    yield "as it is", text
    yield "fence", f"Here it is:\n```json\n{text}\n```\nDone."
    yield "trailing commas", "".join(("," if i in at("}]") and outside[i - 1] not in "{[" else "") + c for i, c in enumerate(text))
    yield "doubled braces", "".join(c * 2 if i in at("{}") else c for i, c in enumerate(text))
    yield "comments", "".join(c + (" // note\n" if i in at(",") else " /* x */ " if i in at(":") else "") for i, c in enumerate(text))
    yield "words of Python", re.sub(r"true|false|null", lambda m: {"true": "True", "false": "False", "null": "None"}[m[0]] if outside[m.start()] != "S" else m[0], text)
    yield "raw line ends", text.replace("\\n", "\n").replace("\\t", "\t") if "\\\\" not in text else text
    end = len(text)
    while end and text[end - 1] in "}]" and outside[end - 1] != "S":
        end -= 1
    yield "no end", text[:end]
    if outside[end - 1] == "S" and not text[:end].endswith('\\"') and text[end - 2] != '"':
        yield "open string", text[: end - 1]


@settings(max_examples=400, deadline=None)
@given(OBJECT)
def test_known_objects_come_back(known):
    for name, text in damages(json.dumps(known, ensure_ascii=False)):
        assert replies.repaired(text) == known, (name, text)


@settings(max_examples=100, deadline=None)
@given(st.text(st.sampled_from('{}[]",:\\\'ab1 \n/*'), max_size=60))
def test_any_text_ends(text):
    replies.repaired(text)


@settings(max_examples=100, deadline=None)
@given(st.dictionaries(st.text("ab ,:", min_size=1), st.one_of(st.integers(), st.text("ab ,:"), st.lists(st.text("ab ,:"))), min_size=1))
def test_single_quotes(known):
    assert replies.repaired(json.dumps(known).replace('"', "'")) == known


@pytest.mark.parametrize("text, want", [
    ("", None), ("no brace", None), ("{", {}), ('{"a"', {"a": None}), ('{"a":', {"a": None}), ('{"a" 1 "b": 2}', {'a" 1 "b': 2}),
    ('{"a": "he said "no" and left", "b": 1}', {"a": 'he said "no" and left', "b": 1}), ('{"a": "x" "b": [1 2 3}', {"a": "x", "b": [1, 2, 3]}), ('{key: value, other: -1.5e2}', {"key": "value", "other": -150.0}),
    ('{"a": "\\u00e9\\ud83d\\ude00\\q"}', {"a": "é😀\\q"}), ("[[1, {\"a\": 2]]", [[1, {"a": 2}]]), ("{" * 2000, None),
])
def test_odd_texts(text, want):
    assert replies.repaired(text) == want


def test_long_texts_take_little_time():
    for text in ('{"a": "' + "x" * 2_000_000, "[" + "1," * 300_000, '{"a": ' + '"b" ' * 200_000, "{" + " " * 2_000_000, '{"a": "x"' + " " * 500_000 + 'y"}'):
        replies.repaired(text)


ROWS = [
    (1, '{"analysis": "x", "rule_checks": [{"rule_text": "r", "check_result": "ok", "code_references": ["f.c:1", "g"]}, {"rule_text": "s", "findings": "old", "what_checked": "w"}, 5]}'),
    (2, '```json\n{"needed_functions_not_provided": ["b", "a", null], "why": 1}\n```'),
    (3, '{"analysis": "cut off'), (4, 'I need "needed_functions_not_provided": ["f", "g", "f"] please'), (5, "nothing"), (6, None), (7, ""), (8, '{"other": 1}'),
    (9, json.dumps({n: None for n in replies.DETAILED} | {"purpose_rule_checks": [{"rule_text": "p", "check_result": "no", "code_references": []}]})),
    (10, json.dumps({"feasibility": 1, "purpose_rule_checks": [{"rule_text": "p"}]})), (11, json.dumps({"rule_checks": [{"rule_text": 5}]})), (12, "see {\"purpose_rule_checks\": [\"q\"]} there"), (13, '{"analysis": "a", "analysis": "b"}'), (1, "nothing"),
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame([(*r, "direct", "object") for r in ROWS], "site long, content string, way string, kind string")


def test_parse(table):
    got = {(r.site, r.way, r.kind, r.analysis, tuple(r.symbols) if r.symbols is not None else None) for r in replies.parse(table).collect()}
    assert got == {
        (1, "direct", "analysis", "x", None), (2, "direct", "symbols", None, ("b", "a")), (3, "repaired", "analysis", "cut off", None), (4, "listed", "symbols", None, ("f", "g")),
        (5, "none", None, None, None), (6, "none", None, None, None), (7, "none", None, None, None), (8, "none", None, None, None), (9, "none", None, None, None), (10, "none", None, None, None),
        (11, "none", None, None, None), (12, "none", None, None, None), (13, "repaired", "analysis", "b", None), (1, "none", None, None, None)}
    assert replies.parse(table.where("false")).collect() == []


def test_checks(table):
    got = {tuple(r) for r in replies.rule_checks(table).collect()}
    assert got == {(1, "rule_checks", 0, "r", "ok", 2, "f.c:1"), (1, "rule_checks", 1, "s", "old", 1, "w"), (9, "detailed", 0, "p", "no", 0, None), (10, "plain", 0, "p", None, -1, None), (12, "inline", 0, None, None, -1, None)} or got == {
        (1, "rule_checks", 0, "r", "ok", 2, "f.c:1"), (1, "rule_checks", 1, "s", "old", 1, "w"), (9, "detailed", 0, "p", "no", 0, None), (10, "plain", 0, "p", None, None, None), (12, "inline", 0, None, None, None, None)}
    assert {tuple(r) for r in replies.detailed(table).where("site in (8, 9, 10)").collect()} == {(8, 6, False, False), (9, 0, True, True), (10, 4, False, False)}


def test_validity(spark):
    rows = [(1, '{"a": 1}'), (2, "{'a\": [1}"), (3, '{"a": "\\n"'), (4, "  "), (5, None)]
    got = {tuple(r) for r in replies.validity(spark.createDataFrame(rows, "site long, content string")).collect()}
    assert got == {(1, True, False, False, False, False), (2, False, True, False, True, False), (3, False, False, True, False, True), (4, False, False, False, False, False), (5, False, False, False, False, False)}


def test_symbols(table):
    assert {tuple(r) for r in replies.needed_symbols(table).collect()} == {(2, "b"), (2, "a"), (4, "f"), (4, "g")}

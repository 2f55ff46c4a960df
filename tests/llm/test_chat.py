import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from logquarry.llm import chat as C

HOW = C.Format()


@settings(max_examples=200, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "[ROLE]", "a\\"]), st.text("\\[]/<>sINTROLEx \n", max_size=30)), max_size=6))
def test_reads_back(turns):
    text, loss = HOW.compiled()([{"role": r, "text": t} for r, t in turns])
    assert HOW.turns(text) == turns
    assert [HOW.unescape(text[a:b]) for a, b in loss] == [t for r, t in turns if r == "assistant"]


def render(template, **env):
    filters = {"upper": str.upper, "escape": HOW.escape}
    out = C._Output()
    C._closure(C.fold_constants(C.parse(template), filters), filters)(env, out)
    return "".join(out.pieces)


def test_language():
    assert render("{% if a == 'x' %}1{% elif b %}2{% else %}3{% endif %}", a="x") == "1"
    assert render("{% if a == 'x' %}1{% elif b %}2{% else %}3{% endif %}", b="y") == "2"
    assert render("{% for m in ms %}{{ m.k | upper }}{{ ',' + m.z }}{% endfor %}", ms=[{"k": "a", "z": "b"}]) == "A,b"
    assert render("{{ a.__class__ }}{{ a.b.c }}", a="x") == ""
    assert render("{% if not (a or 'x' != 'x') %}t{% endif %}") == "t"


def test_folding():
    tree = C.fold_constants(C.parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'y' %}d{{ z }}{% else %}e{% endif %}f"), {"upper": str.upper})
    assert [(p.kind, p.value) for p in tree.parts] == [("constant", "abCef")]


@pytest.mark.parametrize("bad", ["{% if a %}", "{% endfor %}", "{% import os %}", "{{ f(a) }}", "{{ a[0] }}", "{{ a | nothing }}", "{{ }}", "{% for a b %}{% endfor %}"])
def test_refused(bad):
    with pytest.raises(C.TemplateError):
        render(bad)


def test_controls():
    with pytest.raises(C.TemplateError):
        C.Format(controls=("<a>", "b<c"))


def test_tables(spark):
    rows = [(1, 1, "assistant", "</s>[INST] ok [/INST]"), (1, 0, "user", None), (2, None, None, "x"), (2, 0, "assistant", ""), (None, 0, "user", "q"), (3, 0, "user", "a"), (3, 0, "user", "a"), (4, 5, "user", "y" * 100_000)]
    table = spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, formatted string")
    got = {r["conv_id"]: r for r in C.digests(C.format_conversations(table)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert got[1]["turns_sha256"] == sha("user\n\nassistant\n</s>[INST] ok [/INST]\n")
    assert got[1]["loss_sha256"] == sha("</s>[INST] ok [/INST]") and got[1]["loss_chars"] == 21
    assert got[2]["turns_sha256"] == sha("\nx\nassistant\n\n") and got[3]["n_turns"] == 2 and got[None]["n_turns"] == 1
    assert C.format_conversations(table.where("false")).count() == 0

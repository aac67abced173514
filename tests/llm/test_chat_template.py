import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from caseflow.llm import chat_template as C

TEXT = st.text(alphabet=st.sampled_from(list("\\#</turn> \nax:é")), max_size=40)


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(TEXT, TEXT), max_size=5))
def test_round_trip(turns):
    parts = [p for p in C.compile_template(C.DEFAULT)(turns) if p is not C.TURN_END]
    assert C.read_turns("".join(t for t, _ in parts)) == turns
    assert [C.unescape(t) for t, m in parts if m] == [t for r, t in turns if r == "assistant"]


def test_folding():
    tree = C.fold(C.parse("a{{ 'b' + 'c' | upper }}{% if 'x' == 'x' %}d{% else %}e{% endif %}f"))
    assert tree == (C.Out(C.Const("abCdf")),)
    tree = C.fold(C.parse("{% for t in turns %}{% if t.role == 'u' and not 'a' == 'b' %}x{% endif %}{% endfor %}"))
    assert isinstance(tree[0], C.For) and isinstance(tree[0].body[0], C.If)


def test_statements():
    t = ("{% for m in turns %}{{ m.index }}{% if m.role == 'a' %}A{% elif m.role == 'b' or m.text == 'q' %}B{% else %}"
         "{{ '[' + m.text | trim + ']' }}{% endif %}{% endfor %}.")
    got = "".join(p[0] for p in C.compile_template(t)([("a", ""), ("b", ""), ("c", " z "), ("c", "q")]) if p)
    assert got == "0A1B2[z]3B."


@pytest.mark.parametrize("bad", ["{{ x }}", "{{ __import__('os') }}", "{% for t in turns %}{{ t.__class__ }}{% endfor %}",
                                 "{% if 'a' %}", "{% for t in turns %}", "{% do x %}", "{{ 'a' | nosuch }}", "{{ 1 }}",
                                 "{% for t in turns %}{% for u in turns %}{% endfor %}{% endfor %}", "{{ 'a' 'b' }}"])
def test_refused(bad):
    with pytest.raises(C.TemplateError):
        C.compile_template(bad)


def test_digests_segments_nulls_and_ties(spark, monkeypatch):
    import hashlib
    rows = [(1, 1, "assistant", "b" * 1_100_000, 0), (1, 0, "user", None, 0), (1, 2, "user", "x", 0),
            (1, 3, "assistant", "c" * 700_000, 0), (2, None, None, "q", 0), (2, 0, "assistant", "b", 0),
            (2, 0, "assistant", "a", 0), (None, 0, "assistant", "### </turn>\\", 0), (3, 0, "user", "x", 0),
            (3, 0, "user", "x", 0)]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, segment int")
    f = C.format_conversations(df)
    assert f.where("conv_id = 1").count() == 2
    got = {r.conv_id: r for r in C.digests(f).collect()}
    want = {}
    for conv, turn, role, text, _ in sorted(rows, key=lambda r: (str(r[0]), -1 if r[1] is None else r[1], r[2] or "", r[3] or "")):
        want.setdefault(conv, []).append((role or "", text or ""))
    assert set(got) == set(want)
    for conv, turns in want.items():
        g = got[conv]
        loss = "".join(t for r, t in turns if r == "assistant")
        assert g.n_turns == len(turns) and g.loss_chars == len(loss)
        assert g.turns_sha256 == hashlib.sha256("".join(f"{r}\n{t}\n" for r, t in turns).encode()).hexdigest()
        assert g.loss_sha256 == hashlib.sha256(loss.encode()).hexdigest()
    assert C.format_and_read_back(df.limit(0)).count() == 0

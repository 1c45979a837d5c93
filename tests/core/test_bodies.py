"""Syntax nodes and what bodies are worth."""

import pytest

from glossa.functions import terms as T
from glossa.operators import bodies, flows
from glossa.plans.fixpoint import cut, stored
from glossa.sources import syntax


def kinds(text):
    return [(r[4], r[5]) for r in syntax.rows("f", syntax.tree(text))]


@pytest.mark.parametrize(
    "text, kind, name",
    [
        ("puts 1, :a", "call", "puts"), ("a = b rescue 2", "begin", None), ("x = if a then 1 else 2 end", "if", "if"), ("foo.bar(1)&.baz { |x| x + 1 }", "block", None), ("x = <<~A\n  a #{b}\nA\n", "dstr", None),
        ("def m(a, b = 2, *c, d:, e: 1, **f, &g) = a", "def", "m"), ("a, *b = 1, 2", "masgn", None), ("case x\nin [Integer => a, *] if a > 1 then a\nin {k:, **nil} then k\nend", "array_pattern", None), ("%w[a b]", "array", None),
        ("x / 2 / 3", "call", "/"), ("m /re/", "regex", "re"), ("->(x) { x }", "lambda", "->"), ("while a do b end", "while", "while"), ("class << self\n def a; end\nend", "sclass", "self"), ("a ? b : c", "if", "?"), ("a ||= 1", "or", None),
        ("x[:a] += 1", "call", "[]="), ("A::B.new(k: 1, **o)", "keywords", None), ("return 1, 2 if a", "return", None), ("foo = 1\nfoo [1]", "lvar", "foo"), ("yield(a, *b)", "yield", "yield"), ("!a && b", "and", None),
    ],
)
def test_forms(text, kind, name):
    found = kinds(text)
    assert (kind, name) in found and "error" not in {k for k, _ in found}


def test_intervals_and_errors(spark):
    texts = [("a.rb", "class A\n  def m(x)\n    x.y(z { 1 })\n  end\nend\n"), ("b.rb", "def broken(\n  ) ]]\nend\ndef fine = 1\n"), ("c.rb", None), ("d.rb", ""), ("e.rb", "x = " + "[" * 200 + "1" + "]" * 200)]
    rows = syntax.nodes(spark.createDataFrame(texts, "file string, content string")).collect()
    by = {(r["file"], r["node"]): r for r in rows}
    for r in rows:
        inside = [x for x in rows if x["file"] == r["file"] and r["node"] < x["node"] <= r["last"]]
        assert all(by[x["file"], x["parent"]]["node"] >= r["node"] for x in inside)
    assert any(r["file"] == "b.rb" and r["kind"] == "error" for r in rows) and any(r["file"] == "b.rb" and r["name"] == "fine" for r in rows)
    assert [r["kind"] for r in rows if r["file"] in ("c.rb", "d.rb")] == ["program", "program"]


BODIES = {
    "literal": ("1", "1"), "choice": ("c ? 1 : 'a'", '1 | "a"'), "no_else": (":a if c", ":a?"), "cases": ("case c\nwhen 1 then 1\nwhen 2 then 2.5\nelse nil\nend", "1 | Float | nil"),
    "local": ("x = 1\nx = 'a'\nx", '"a"'), "either": ("x = 1\nx = 'a' if c\nx", '1 | "a"'), "arms": ("if c\n x = 1\nelse\n x = :b\nend\nx", "1 | :b"), "overwritten": ("if c\n x = 1\n x = 2\nend\nx = 3 unless x\nx", "2 | 3"),
    "returned": ("return 'early' if c\n2", '"early" | 2'), "left": ("if c\n x = 1\n return :r\nelse\n x = 2\nend\nx", ":r | 2"), "loop": ("x = 0\nwhile c\n  x += 1\nend\nx", "Integer"), "block": ("x = nil\nc.each { |y| x = 'b' }\nx", '"b"?'),
    "array": ("[1, [c ? :a : :b]]", "[1, [:a | :b]]"), "hash": ("{a: 1, b: [2]}", "{ a: 1, b: [2] }"), "chain": ("'abc'.upcase.length", "Integer"), "sum": ("a = 1\nb = a + 2\nb * 2", "Integer"), "or_": ("(c ? nil : 1) || 'x'", '"x" | 1'),
    "index": ("x = [1, 'a']\nx[1]", '"a"'), "made": ("Foo.new", "Foo"), "rescued": ("begin\n 1\nrescue\n :no\nend", "1 | :no"), "raising": ("c ? 1 : raise('x')", "1"), "empty": ("", "nil"), "other_arm": ("if c\n  x = 1\nelse\n  x\nend", "1 | untyped"),
    "nested": ("if c\n  if c\n    x = 1\n  else\n    x = 2\n  end\nelse\n  x = 3\nend\nx", "1 | 2 | 3"), "shadow": ("x = 1\nc.map { |x| x }\nx", "1"), "call": ("literal", "1"),
}


def arms(text):
    return set(text.replace("?", " | nil").replace("(", "").replace(")", "").split(" | ")) if "[" not in text and "{" not in text else text


def test_bodies_are_worth_what_their_ways_give(spark):
    text = "class K\n" + "".join(f"def {n}(c)\n{body}\nend\n" for n, (body, _) in BODIES.items()) + "end\n"
    nodes = cut(syntax.nodes(spark.createDataFrame([("k.rb", text)], "file string, content string")))
    got = {r["name"]: r["ret"] for r in bodies.method_returns(nodes).collect()}
    assert T.loads(got.pop("call")) == ("method_return", "K", "literal")
    shown = {n: T.render(T.loads(t)) for n, t in got.items()}
    assert {n: arms(t) for n, t in shown.items() if n != "other_arm"} == {n: arms(t) for n, (_, t) in BODIES.items() if n not in ("call", "other_arm")}
    assert {r["class"] for r in bodies.definitions(nodes).collect()} == {"K"}


def test_parameter_flows_come_from_bodies(spark):
    text = """
def same(x) = x
def wrapped(x, y) = [x, {k: y}]
def called(f) = f.call(1)
def given(x) = yield(x)
def tested(x) = x ? x : 1
def used(x)
  x.size
  x
end
def again(x)
  x = 1
  x
end
def hidden(x)
  [1].map { |x| x }
  x
end
def unused(x) = 1
def early(x, c)
  return x if c
  x
end
"""
    nodes = cut(syntax.nodes(spark.createDataFrame([("p.rb", text)], "file string, content string")))
    uses = bodies.parameter_uses(nodes)
    got = {(r["name"], r["idx"]): r["flow"] for r in flows.param_flows(uses).collect()}
    want = {("same", 0): "pass_through", ("wrapped", 0): "pass_through", ("wrapped", 1): "pass_through", ("called", 0): "called", ("given", 0): "pass_through", ("used", 0): "constrained", ("early", 0): "pass_through"}
    assert got == want


def test_lines_that_come_again_are_read_once(monkeypatch):
    """The same tokens with and without the lines known: whatever holds several lines together, or tells its line, is read anew."""
    read, real = [], syntax.Reader.one_line
    monkeypatch.setattr(syntax.Reader, "one_line", lambda self: read.append(1) or real(self))
    monkeypatch.setattr(syntax, "LINES", {})
    for k in range(50):
        text = f"class C{k}\n  def m(x)\n    x = 1 if x\n    x\n  end\nend\n"
        assert len(syntax.rows("f", syntax.tree(text))) == 13
    assert len(read) == 50 + 5
    odd = ["x = <<~A\n", "A\n", "  a \\\n", "'two\n", "lines'\n", '"at #{here}"\n', "=begin\n", "=end\n", "__END__\n", "`\n", "%w(a\n", "b)\n", "y ? :a : b\n", "z\n", "  .then\n", "# c \\\n", "p <<B + <<C\n", "B\n", "C"]
    for k in range(len(odd) ** 2):
        text = "".join(odd[(k + j * j * (k % 7 + 1)) % len(odd)] for j in range(6))
        known = syntax.rows("f", syntax.tree(text))
        monkeypatch.setattr(syntax, "LINES", {})
        assert known == syntax.rows("f", syntax.tree(text)), text


def test_only_the_columns_that_are_asked_for(spark):
    texts = spark.createDataFrame([("a", "x = [1] if y"), ("b", None)], "file string, content string")
    some = syntax.nodes(texts, "file", "last", "up", "arm_last")
    assert some.columns == ["file", "last", "up", "arm_last"]
    assert sorted(some.collect(), key=str) == sorted(syntax.nodes(texts).select(*some.columns).collect(), key=str)


MIXED = """class A
  def a(x, y = 2, *z, k: 1)
    x = 1 if y
    while x
      x = x + 1
      next if z
      w = [x, { q: x, r: (y || :n) }]
    end
    w
  end
  def b(c)
    v = begin
      c ? 'a' : nil
    rescue Oops => e
      e
    else
      u = 3.0
    end
    return v, c if c.nil?
    return unless v
    case c
    in [Integer => d, *f] then d
    in { g: } then g
    in h then h
    end
  end
  def d(*) = [1].map { |i| j = i; j }
  def e
    m, n = 1, :two
    o = p = (n && 'z') || m
    @q = o
    raise 'no' if n
    r = self
    r = new if p
    r&.to_s
  end
  class << self
    def f = self
    def g(h) = h
  end
  def h; end
  def i(x) = x = x
  def j(x)
    case x
    when 1 then y = :a
    when 2 then y = y.to_s
    end
    y += 1
    yield y
  end
end
def k(a) = [*a, b: a, **a]
"""


def test_returns_ask_for_few_nodes(spark):
    """The same returns from the nodes that they ask for as from the values of all, with fewer nodes."""
    nodes = cut(syntax.nodes(spark.createDataFrame([("m.rb", MIXED), ("n.rb", "x = 1\ndef l = x\n")], "file string, content string")))
    want = sorted(map(tuple, bodies.method_returns(nodes, bodies.values(nodes)).collect()), key=str)
    few = stored(bodies.asked(nodes))
    assert sorted(map(tuple, bodies.method_returns(few).collect()), key=str) == want and len(want) == 11
    assert few.count() < nodes.count()
    all_, some = ({(r["file"], r["node"]): r["term"] for r in bodies.values(*given).collect()} for given in ((nodes,), (few, True)))
    ends = [(r["file"], r["node"]) for r in nodes.filter("top = node AND kind <> 'assign'").collect()]
    assert [some.get(e) for e in ends] == [all_.get(e) for e in ends] and len(ends) > 30

import json

import pytest

from glossa.functions import signatures as S
from glossa.functions import terms as T
from glossa.sources import signatures as src


@pytest.mark.parametrize("text", ["String?", "(Integer | String)?", "Array[Integer | String]", "Hash[Symbol, untyped]", "[Integer, String]", "{ a: Integer, ?b: String }", "singleton(User)", "Range[Date]", "(^(Integer) -> String)", '"a"', ":b", "12", "bool", "void", "A::B", "Integer & Comparable"])
def test_types_round_trip(text):
    assert T.render(S.parse_type(text)) == text.replace("Integer & Comparable", "Integer & Comparable")


def test_aliases_and_errors():
    assert T.render(S.parse_type("untyped?")) == "untyped"
    assert T.render(S.parse_type("interned")) == "Symbol | String" or set(T.render(S.parse_type("interned")).split(" | ")) == {"Symbol", "String"}
    with pytest.raises(S.SignatureError):
        S.parse_type("Array[")


def test_method_types():
    (m,) = S.parse_method_type("[T] (Integer a, ?String b, *Symbol rest, key: Integer, ?opt: bool, **untyped) ?{ (T) -> void } -> Array[T]")
    assert [p["kind"] for p in m["params"]] == ["required", "optional", "rest", "keyword_required", "keyword_optional", "double_rest"]
    assert m["type_params"] == ["T"] and not m["block"]["required"]
    assert len(S.parse_method_type("(Integer) -> String | (String) -> Integer")) == 2
    assert S.render_method("x", S.parse_method_type("(Integer a) -> String | () -> nil"), singleton=True) == "def self.x: (Integer a) -> String\n          | () -> nil"


DECL = """
class Foo::Bar[T] < Base[T]
  include Comparable
  attr_accessor name: String?
  @x: Integer
  LIMIT: Integer
  # a comment
  private def self.make: (Integer n) -> instance
                       | (String) -> self
  def ==: (untyped) -> bool
  def x=: (Integer) -> Integer
  alias y x
  module Inner
    def z: () -> void
  end
  type pair = [Integer, Integer]
end
Alias: singleton(Foo)
class Short = Foo::Bar
$g: String
"""


def test_declarations(spark):
    rows = S.parse_declarations(DECL)
    names = [(r["row"], r["owner"], r["name"]) for r in rows]
    assert ("class", "Foo::Bar", "Foo::Bar") in names and ("mixin", "Foo::Bar", "Comparable") in names and ("method", "Foo::Bar", "name=") in names
    assert ("method", "Foo::Bar", "==") in names and ("method", "Foo::Bar", "x=") in names and ("method", "Foo::Bar::Inner", "z") in names
    assert ("constant", "Foo::Bar", "LIMIT") in names and ("alias", "Foo::Bar", "Foo::Bar::pair") in names and ("constant", "Object", "Short") in names
    texts = spark.createDataFrame([("a.rbs", DECL), ("b.rbs", "class X"), ("c.rbs", None)], "file string, content string")
    table = src.declarations(texts).cache()
    assert table.filter("row = 'error'").count() == 1
    assert src.methods(table).filter("name = 'make'").count() == 2
    assert [r["classes"] for r in src.classes_of_files(table).collect()] == [["Foo::Bar", "Foo::Bar::Inner"]]
    assert json.loads(src.methods(table).filter("name = 'z'").first()["signature"])["ret"] == ["void"]


@pytest.mark.parametrize("given,want", [
    ("T.nilable(String)", "String?"), ("T.any(Integer, T::Array[String])", "Integer | Array[String]"), ("T::Hash[Symbol, T.untyped]", "Hash[Symbol, untyped]"),
    ("T.nilable(T.any(A, B))", "(A | B)?"), ("T::Class[Foo]", "singleton(Foo)"), ("T.proc.params(a: Integer).returns(String)", "^(Integer) -> String"), ("T.proc.void", "^() -> void"), ("T::Boolean", "bool"),
])
def test_checked_types(given, want):
    assert S.checked_type(given) == want


def test_checked_signatures():
    assert S.checked_signature("sig { params(a: Integer, b: T.nilable(String)).returns(T::Boolean) }") == "(Integer a, String? b) -> bool"
    assert S.checked_signature("sig { void }") == "-> void"
    assert S.checked_signature("sig { params(x: Integer, blk: T.proc.params(a: String).void).returns(T.any(A, B)) }", 1) == "(Integer x) { (String) -> void } -> (A | B)"
    assert S.checked_signature("def x") is None


def test_comments(spark):
    text = "#: (Integer) -> String\n#: (String) -> nil\ndef a; end\n\n#: () -> void\n\ndef b; end\nx = y #: Integer\n# @rbs x: String\n#: self as Foo\nrequire 'json'"
    lines = src.source_lines(spark.createDataFrame([("f.rb", text)], "file string, content string"))
    found = src.signature_comments(lines)
    assert {(r["line"], r["kind"], r["body"]) for r in found.collect()} >= {(8, "assertion", "Integer"), (9, "rbs", "x: String"), (10, "self_bind", "Foo")}
    assert [tuple(r) for r in src.attach_to_definitions(found, lines).collect()] == [("f.rb", 3, ["(Integer) -> String", "(String) -> nil"])]
    assert src.required_features(lines).first()["feature"] == "json"

import json

from pyspark.sql import functions as F

from glossa.operators import generators
from glossa.plans.analyze import Analysis, analyze
from glossa.sources import ruby

SOURCE = '''
# a comment with class X
module Shop
  LIMIT = 10
  class Item < Base
    include Comparable
    attr_reader :name, :price
    KINDS = [:a, :b]

    def initialize(name, price = 1.5)
      @name = name
      @price = price
    end

    def label
      "item #{@name}"
    end

    def twin
      Item.new(@name)
    end

    def shout; label; end
    def size = 3

    def maybe(flag)
      return nil if flag
      "yes"
    end

    def odd
      if flag
        1
      else
        "x"
      end
    end

    class << self
      def build
        make("toy", price: 2)
      end
    end

    def self.make(name, price: 0)
      name
    end

    private

    def hidden(*rest, key:, **opts, &block)
      [1, "two"]
    end
  end
  Point = Struct.new(:x, :y)
end
'''


def test_reader():
    rows = ruby.read(SOURCE)
    classes = [(r["class"], r["name"], r["kind"]) for r in rows if r["row"] == "class"]
    assert classes == [("Shop", None, "module"), ("Shop::Item", "Base", "class"), ("Shop::Point", "Struct", "class")]
    methods = {r["name"]: (r["singleton"], r["visibility"], json.loads(r["type"])) for r in rows if r["row"] == "method"}
    assert methods["label"] == (False, "public", ["string"]) and methods["size"][2] == ["lit_int", 3] and methods["shout"][2] == ["method_return", "Shop::Item", "label"]
    assert methods["build"][0] and methods["make"][0] and methods["hidden"][1] == "private" and methods["odd"][2] == ["untyped"]
    (hidden,) = [r for r in rows if r["row"] == "method" and r["name"] == "hidden"]
    assert [p["kind"] for p in hidden["params"]] == ["rest", "keyword_required", "double_rest", "block"]
    assert ruby.read(None) == [] and ruby.read("=begin\nclass X\n=end\nx = <<~EOS\n  class Y\nEOS\n") == []


def test_analysis(spark):
    run = Analysis(spark.createDataFrame([("shop.rb", SOURCE), ("app.rb", "class App\n  def go\n    Shop::Item.new('a', 2)\n  end\nend\n")], "file string, content string"))
    text = "".join(r["value"] + "\n" for r in run.text().collect())
    assert "class Shop::Item < Base\n  include Comparable" in text and "KINDS: [Symbol, Symbol]" in text and "LIMIT: Integer" in text
    assert "def label: () -> String" in text and "def shout: () -> String" in text and "def size: () -> Integer" in text
    assert "def maybe: (untyped flag) -> String?" in text and "def twin: () -> Shop::Item" in text and "def self.build: () -> String" in text
    assert "def initialize: (String name, ?Integer | Float price) -> void" in text and "def price: () -> (Integer | Float)" in text
    assert "def self.make: [N] (N name, ?price: Integer) -> N" in text and "private def hidden: (*untyped rest, key: untyped, **untyped opts) ?{ (?) -> untyped } -> [Integer, String]" in text
    assert "def x: () -> untyped" in text and "def x=: (untyped value) -> untyped" in text
    assert "def odd: () -> (Integer | String)" in text and "def go: () -> " in text


def test_scan_and_analyze(spark, tmp_path):
    for name, body in {"app/a.rb": "class A\n  def x\n    1\n  end\nend\n", "spec/a_spec.rb": "class ASpec\nend\n", "vendor/v.rb": "class V\nend\n"}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text(body)
    run = analyze(spark, str(tmp_path))
    assert [r["class"] for r in run.classes.collect()] == ["A"] and [r["value"] for r in run.text().collect()] == ["class A\n  def x: () -> Integer\nend\n"]


def test_routes_from_source(spark):
    text = "Rails.application.routes.draw do\n  root 'home#index'\n  resources :users, only: [:index, :show] do\n    get :preview, on: :member\n  end\n  namespace :admin do\n    resource :profile\n  end\n  get 'about' => 'pages#about'\nend\n"
    calls = ruby.route_calls(text)
    found = {r["name"]: r["arity"] for r in generators.route_helpers(spark.createDataFrame([("r", json.dumps(calls))], "file string, calls string")).collect()}
    assert found["users"] == 0 and found["user"] == 1 and found["preview_user"] == 1 and found["admin_profile"] == 0 and found["about"] == 0 and "new_user" not in found


def test_small_scans(spark):
    texts = spark.createDataFrame([("a.rb", "class A\n  def ===(o)\n    true\n  end\n  module B\n    def h\n      { a: 1, b: 2 }\n    end\n  end\nend")], "file string, content string")
    assert [tuple(r) for r in ruby.case_equality_overrides(texts).collect()] == [("a.rb", 2)]
    rows = ruby.facts(texts)
    assert [r["class"] for r in ruby.namespaces(rows).collect()] == ["A::B"]
    assert [(r["class"], r["keys"]) for r in ruby.literal_hash_methods(rows).collect()] == [("A::B", ["a", "b"])]
    assert rows.filter(F.col("row") == "method").count() == 2


def test_type_parameters_and_blocks(spark):
    source = """
class Names
  def pick(details, data) = [details, data]
  def ids(user_id, user_name)
    [user_id, user_name]
  end
  def with_value(x) = yield(x)
  def lock = yield
  def maybe(flag) = flag ? yield : nil
  def each
    yield 1, 'a' if block_given?
    self
  end
  def plain(x) = x.size
  def either(a)
    a.to_s
    a
  end
  def caller
    either(1)
    either('s')
  end
end
"""
    text = "".join(r["value"] + "\n" for r in Analysis(spark.createDataFrame([("n.rb", source)], "file string, content string")).text().collect())
    for line in ("def pick: [De, Da] (De details, Da data) -> [De, Da]", "def ids: [UI, UN] (UI user_id, UN user_name) -> [UI, UN]", "def with_value: [X, R] (X x) { (X) -> R } -> R", "def lock: [R] { -> R } -> R", "?{ (Integer, String) -> untyped } -> Names", "def plain: (untyped x) -> untyped"):
        assert line in text.replace("{ () -> R }", "{ -> R }"), (line, text)
    assert "def either: [A < Integer | String] (A a) -> A" in text or "def either: [A < String | Integer] (A a) -> A" in text, text

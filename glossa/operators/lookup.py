"""Names and positions: ancestors, dispatch, constants by lexical scope, spans, completion.

Facts: classes (class, superclass, is_module, user_defined), mixins (class, module, kind include | extend | prepend, ord), methods
(class, name, singleton, origin, visibility, ret, file, line, ord), constants (owner, name, type).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions.inflect import join_scope, scopes_outward
from glossa.plans.fixpoint import ranked_reach, reach

INCLUDERS = 32


def lookup_edges(classes: DataFrame, mixins: DataFrame, singleton: bool = False) -> DataFrame:
    """src, dst, ord: where a class's method lookup goes on. Prepended modules come before the class itself (negative ord), then
    included ones, the last applied first, then the superclass. On the class object, extended modules stand for included ones."""
    kind = "extend" if singleton else "include"
    mixed = mixins.filter(F.col("kind").isin(kind) if singleton else F.col("kind").isin(kind, "prepend"))
    rank = F.row_number().over(Window.partitionBy("class", "kind").orderBy(F.desc("ord")))
    steps = mixed.select(F.col("class").alias("src"), F.col("module").alias("dst"), F.when(F.col("kind") == "prepend", rank - 1_000_000).otherwise(rank).alias("ord"))
    up = classes.filter("superclass IS NOT NULL").select(F.col("class").alias("src"), F.col("superclass").alias("dst"), F.lit(1_000_000).alias("ord"))
    return steps.union(up)


def ancestors(classes: DataFrame, mixins: DataFrame, singleton: bool = False) -> DataFrame:
    """class, owner, rank (an array that orders the lookup path): every class's method lookup path."""
    found = ranked_reach(lookup_edges(classes, mixins, singleton), classes)
    # the class itself stands between prepended and other neighbours on each level
    return found.withColumn("rank", F.concat("rank", F.array(F.lit(0))))


def superclass_chain(classes: DataFrame) -> DataFrame:
    """class, owner, depth along superclasses only."""
    edges = classes.select(F.col("class").alias("src"), F.col("superclass").alias("dst"))
    return reach(classes.select(F.col("class").alias("root")), edges).select(F.col("root").alias("class"), F.col("node").alias("owner"), "depth")


def reachable_modules(mixins: DataFrame) -> DataFrame:
    """module, mixed: all modules mixed into a module, directly or not."""
    edges = mixins.select(F.col("class").alias("src"), F.col("module").alias("dst"))
    return reach(mixins.select(F.col("class").alias("root")).distinct(), edges).filter("depth > 0").select(F.col("root").alias("module"), F.col("node").alias("mixed"))


def with_ancestors(names: DataFrame, paths: DataFrame) -> DataFrame:
    """Classes and all that their lookup paths hold."""
    return names.select("class").join(paths, "class").select(F.col("owner").alias("class")).distinct()


def dispatch(calls: DataFrame, paths: DataFrame, methods: DataFrame) -> DataFrame:
    """calls (class, name, singleton, ...) with the owner whose method answers, or null."""
    keys = calls.select("class", "name", "singleton").distinct()
    owned = methods.select(F.col("class").alias("owner"), "name", "singleton").distinct()
    found = keys.join(paths, "class").join(owned, ["owner", "name", "singleton"]).groupBy("class", "name", "singleton").agg(F.min_by("owner", "rank").alias("owner"))
    return calls.join(found, ["class", "name", "singleton"], "left")


def resolve_constants(reads: DataFrame, constants: DataFrame) -> DataFrame:
    """reads (id, name, scope) with path: the innermost scope's constant, outward to the top level; null if there is none.

    constants: path. A name that begins with :: is looked up at the top level only.
    """
    absolute = F.col("name").startswith("::")
    bare = F.regexp_replace("name", "^::", "")
    scopes = F.when(absolute, F.array(F.lit(""))).otherwise(scopes_outward(F.col("scope")))
    tried = reads.select("id", bare.alias("bare"), F.posexplode(scopes).alias("rank", "at")).withColumn("path", join_scope(F.col("at"), F.col("bare")))
    hits = tried.join(constants.select("path").distinct(), "path").groupBy("id").agg(F.min_by("path", "rank").alias("path"))
    return reads.join(hits, "id", "left")


def scoped_paths(namespace: Column, scope: Column) -> Column:
    """Paths that a namespace may mean inside a scope, the innermost first."""
    return F.transform(scopes_outward(scope), lambda s: F.when(s == "", namespace).otherwise(F.concat_ws("::", s, namespace)))


def resolve_class_names(names: DataFrame, classes: DataFrame) -> DataFrame:
    """names (id, owner, name) with class: from the owner's namespace outward, else the name as it is."""
    plain = F.regexp_replace("name", "^::", "")
    found = resolve_constants(names.select("id", "name", F.col("owner").alias("scope")), classes.select(F.col("class").alias("path")))
    return names.join(found.select("id", "path"), "id").select("id", "owner", "name", F.coalesce("path", plain).alias("class"))


def innermost(points: DataFrame, spans: DataFrame) -> DataFrame:
    """points (file, offset) with the smallest half-open span [start, end) around each; of equal ones the first (ord).

    A span is cut into pieces of 2^k offsets that begin at multiples of 2^k, two of a level k at most, and of all spans that share a piece only the
    smallest goes on. A point lies in one piece of each level, so it meets no more spans than there are levels, however many lie around it.
    """
    held = spans.filter("start < end").withColumn("s", F.col("start").cast("long")).withColumn("e", F.col("end").cast("long"))
    bits = F.length(F.bin(F.col("e") - F.col("s")))
    laid = held.select("file", "s", "e", "ord", F.explode(F.sequence(F.lit(0), bits - 1)).alias("level"))
    # the first and the end of the whole pieces of a level; an odd one at either end has no half in a piece of the next level
    laid = laid.withColumn("l", F.expr("-shiftright(-s, level)")).withColumn("r", F.expr("shiftright(e, level)")).filter("l < r")
    odd = lambda c: F.col(c).bitwiseAND(F.lit(1)) == 1
    ends = F.filter(F.array(F.when(odd("l"), F.col("l")), F.when(odd("r"), F.col("r") - 1)), lambda x: x.isNotNull())
    least = F.struct((F.col("e") - F.col("s")).alias("size"), "ord", "s", "e")
    pieces = laid.withColumn("piece", F.explode(ends)).groupBy("file", "level", "piece").agg(F.min(least).alias("least"))
    levels = held.agg(F.max(bits).alias("n")).select(F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("level"))  # 63 at most
    asked = points.select("file", "offset").distinct().join(F.broadcast(levels)).withColumn("piece", F.expr("shiftright(cast(offset AS bigint), level)"))
    best = asked.join(pieces, ["file", "level", "piece"]).groupBy("file", "offset").agg(F.min("least").alias("least")).select("file", "offset", "least.s", "least.e")
    kept = [c for c in spans.columns if c != "file"]
    own = held.groupBy("file", "s", "e").agg(F.min_by(F.struct(*kept), F.struct("ord")).alias("span"))
    return points.join(best.join(own, ["file", "s", "e"]).select("file", "offset", "span"), ["file", "offset"], "left")


def definition_targets(points: DataFrame, spans: DataFrame, definitions: DataFrame) -> DataFrame:
    """points with the definition that the innermost span (or the one just before) names. definitions: symbol, file, line."""
    here = innermost(points, spans)
    back = innermost(points.select("file", (F.col("offset") - 1).alias("offset")), spans).select("file", (F.col("offset") + 1).alias("offset"), F.col("span").alias("before"))
    named = here.join(back, ["file", "offset"], "left").withColumn("symbol", F.coalesce("span.symbol", "before.symbol"))
    where = definitions.select("symbol", F.col("file").alias("def_file"), F.col("line").alias("def_line"))
    return named.join(where, "symbol", "left").select("file", "offset", "symbol", "def_file", "def_line")


def incomplete_classes(paths: DataFrame, classes: DataFrame, methods: DataFrame, runtime: list[str]) -> DataFrame:
    """class, why: classes whose methods can't all be known: an ancestor is missing, answers method_missing, or lives in a runtime namespace."""
    known = classes.select(F.col("class").alias("owner"), "user_defined").distinct()
    roots = F.col("owner").isin("Object", "BasicObject", "Kernel")
    missing = paths.join(known, "owner", "left_anti").filter(~roots).select("class", F.lit("unknown_ancestor").alias("why"))
    answers = methods.filter(F.col("name") == "method_missing").select(F.col("class").alias("owner")).distinct()
    dynamic = paths.filter(~roots).join(answers, "owner").select("class", F.lit("method_missing").alias("why"))
    spaces = F.substring_index("owner", "::", 1).isin(runtime) if runtime else F.lit(False)
    runtime_ = paths.join(known, "owner").filter(spaces & ~F.col("user_defined")).select("class", F.lit("runtime_namespace").alias("why"))
    always = classes.filter(F.col("class").isin("Object", "Class", "Module")).select("class", F.lit("universal").alias("why"))
    return missing.union(dynamic).union(runtime_).union(always).distinct()


def subclass_defines(calls: DataFrame, paths: DataFrame, methods: DataFrame) -> DataFrame:
    """Distinct (class, name) whose method some class below the class defines."""
    below = paths.filter("class <> owner").select(F.col("owner").alias("class"), F.col("class").alias("sub"))
    defined = methods.select(F.col("class").alias("sub"), "name").distinct()
    return calls.select("class", "name").distinct().join(below, "class").join(defined, ["sub", "name"], "left_semi").select("class", "name").distinct()


def resolvable_via_includers(calls: DataFrame, mixins: DataFrame, paths: DataFrame, methods: DataFrame, incomplete: DataFrame) -> DataFrame:
    """calls (module, name) with resolvable: one of the first INCLUDERS includers answers or can't be known; no includers: true."""
    by = mixins.select(F.col("module"), F.col("class").alias("host")).distinct()
    by = by.withColumn("n", F.row_number().over(Window.partitionBy("module").orderBy("host"))).filter(F.col("n") <= INCLUDERS)
    asked = calls.select("module", "name").distinct().join(by, "module", "left")
    answered = asked.join(paths.select(F.col("class").alias("host"), "owner"), "host").join(methods.select(F.col("class").alias("owner"), "name").distinct(), ["owner", "name"], "left_semi").select("module", "name").distinct().withColumn("answers", F.lit(True))
    opaque = asked.join(incomplete.select(F.col("class").alias("host")).distinct(), "host", "left_semi").select("module", "name").distinct().withColumn("opaque", F.lit(True))
    hosts = asked.groupBy("module", "name").agg(F.count("host").alias("hosts"))
    told = hosts.join(answered, ["module", "name"], "left").join(opaque, ["module", "name"], "left")
    return told.select("module", "name", ((F.col("hosts") == 0) | F.coalesce("answers", F.lit(False)) | F.coalesce("opaque", F.lit(False))).alias("resolvable"))


def responds_to_all(classes: DataFrame, required: DataFrame, paths: DataFrame, methods: DataFrame) -> DataFrame:
    """Relational division: class, interface where the class's lookup path defines every required method (interface, name)."""
    wanted = required.groupBy("interface").agg(F.countDistinct("name").alias("wanted"))
    surface = classes.select("class").distinct().join(paths, "class").join(methods.select(F.col("class").alias("owner"), "name").distinct(), "owner").select("class", "name").distinct()
    has = surface.join(required.distinct(), "name").groupBy("class", "interface").agg(F.countDistinct("name").alias("has"))
    return has.join(wanted, "interface").filter("has = wanted").select("class", "interface")


#: Methods that a duck type asks for. Fixed values.
INTERFACES = {
    "_ToC": ["to_c"], "_ToR": ["to_r"], "_ToF": ["to_f"], "_ToI": ["to_i"], "_ToInt": ["to_int"], "_ToS": ["to_s"], "_ToStr": ["to_str"], "_ToSym": ["to_sym"],
    "_ToH": ["to_h"], "_ToHash": ["to_hash"], "_ToA": ["to_a"], "_ToAry": ["to_ary"], "_ToProc": ["to_proc"], "_ToPath": ["to_path"], "_ToIO": ["to_io"],
    "_Inspect": ["inspect"], "_Each": ["each"], "_EachEntry": ["each_entry"], "_Reader": ["read"], "_ReaderPartial": ["readpartial"], "_Writer": ["write"],
    "_Rewindable": ["rewind"], "_Range": ["begin", "end", "exclude_end?"], "_Exception": ["exception"],
}


def builtin_interfaces(spark) -> DataFrame:
    """interface, name."""
    return spark.createDataFrame([(i, m) for i, ms in INTERFACES.items() for m in ms], "interface string, name string")


# completion


def method_completion(receivers: DataFrame, paths: DataFrame, methods: DataFrame, private: bool = False) -> DataFrame:
    """receivers (id, class, singleton) with the methods they answer: of each name the first on the lookup path."""
    visible = methods if private else methods.filter(F.coalesce("visibility", F.lit("public")) != "private")
    found = receivers.join(paths, "class").join(visible.withColumnRenamed("class", "owner"), ["owner", "singleton"])
    first = Window.partitionBy("id", "name").orderBy("rank", F.desc("ord"))
    return found.withColumn("n", F.row_number().over(first)).filter("n = 1").select("id", "name", "owner", "ret")


def constant_completion(asked: DataFrame, constants: DataFrame) -> DataFrame:
    """asked (id, scope, prefix) with constants of the scopes around, the innermost of each name first. constants: owner, name, type."""
    tried = asked.select("id", "prefix", F.posexplode(scopes_outward(F.col("scope"))).alias("rank", "owner"))
    found = tried.join(constants, "owner").filter(F.col("name").startswith(F.col("prefix")))
    return found.withColumn("n", F.row_number().over(Window.partitionBy("id", "name").orderBy("rank"))).filter("n = 1").select("id", "name", "owner", "type", "rank")


KEYWORDS = "alias and begin break case class def do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split()


def identifier_completion(asked: DataFrame, locals_: DataFrame, methods: DataFrame, constants: DataFrame) -> DataFrame:
    """id, name, kind, rank: locals, then methods and constants, then keywords; constants come before all if the prefix is capitalized.

    asked: id, prefix; the others: id, name. A local hides a method of its name.
    """
    spark = asked.sparkSession
    words = spark.createDataFrame([(w,) for w in KEYWORDS], "name string")
    hidden = methods.join(locals_, ["id", "name"], "left_anti")
    every = (
        locals_.select("id", "name", F.lit("local").alias("kind"), F.lit(0).alias("rank"))
        .union(hidden.select("id", "name", F.lit("method").alias("kind"), F.lit(1).alias("rank")))
        .union(constants.select("id", "name", F.lit("constant").alias("kind"), F.lit(1).alias("rank")))
        .union(asked.select("id").crossJoin(F.broadcast(words)).select("id", "name", F.lit("keyword").alias("kind"), F.lit(2).alias("rank")))
    )
    rows = every.join(asked.select("id", "prefix"), "id").filter(F.col("name").startswith(F.col("prefix")))
    capital = F.col("prefix").rlike(r"^\p{Lu}")
    rows = rows.withColumn("rank", F.when(capital & (F.col("kind") == "constant"), -1).otherwise(F.col("rank")))
    return rows.select("id", "name", "kind", F.row_number().over(Window.partitionBy("id").orderBy("rank", "name")).alias("rank"))


def completion_context(before: Column) -> Column:
    """What is completed at the end of a text: struct(kind, receiver, prefix); kind: send, constant, method, identifier or null."""
    send = r"(\w+(?:\.\w+)*)?\.?\b(?:public_)?send\(\s*:(\w*)$"
    constant, method, word = r"((?:::)?[A-Z]\w*(?:::[A-Z]\w*)*)::(\w*)$", r"([\w@$\]\)\}\"'?!]+)\s*&?\.\s*(\w*)$", r"(?<![\w.:@$])([A-Za-z_]\w*)$"

    def part(pattern: str, kind: str, receiver: int | None, prefix: int) -> Column:
        got = F.regexp_extract(before, pattern, receiver) if receiver else F.lit("")
        return F.when(before.rlike(pattern), F.struct(F.lit(kind).alias("kind"), got.alias("receiver"), F.regexp_extract(before, pattern, prefix).alias("prefix")))

    return F.coalesce(part(send, "send", 1, 2), part(constant, "constant", 1, 2), part(method, "method", 1, 2), part(word, "identifier", None, 1))

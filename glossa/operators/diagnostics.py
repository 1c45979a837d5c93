"""Diagnostics: what is wrong for sure. Whatever can't be judged stays silent.

Sites: file, start, end, line, column, end_line, end_column and what each rule asks for. World facts (class, ancestors) stay tables, joined
to the distinct pairs of types that a rule has to judge.
"""

from __future__ import annotations

from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from glossa.functions.udf import arrow
from glossa.functions import binding, compat, terms
from glossa.functions.compat import NO, World
from glossa.plans.fixpoint import dealt, few

POSITION = ["file", "start", "end", "line", "column", "end_line", "end_column"]
DIAGNOSTIC = [
    "path", "line", "column", "end_line", "end_column", "byte_start", "byte_end", "severity", "code", "message", "method_name", "unresolved_method",
    "expected_type", "actual_type", "param_name",
]


@dataclass(frozen=True)
class Facts:
    """What the compatibility rules ask about classes, as tables: paths (class, owner), modules and dynamic (class)."""

    paths: DataFrame
    modules: DataFrame
    dynamic: DataFrame
    rails: bool = True


def world(paths: DataFrame, classes: DataFrame, methods: DataFrame, rails: bool = True) -> Facts:
    """Facts about classes for the compatibility rules. Nothing is gathered: rules join what their pairs of types name."""
    answers = methods.filter("name = 'method_missing'").select(F.col("class").alias("owner")).distinct()
    return Facts(paths.select("class", "owner").distinct(), classes.filter("is_module").select("class").distinct(), paths.join(answers, "owner").select("class").distinct(), rails)


def compatibility(actual: Column, declared: Column, facts: World, rule=compat.fits) -> Column:
    """2 yes, 1 unknown, 0 no, by a small world that is at hand."""

    @arrow("int")
    def judged(a: pd.Series, d: pd.Series) -> pd.Series:
        return pd.Series([rule(terms.loads(x), terms.loads(y), facts) for x, y in zip(a, d)], dtype="int32")

    return judged(actual, declared)


@arrow("array<string>")
def _named(actual: pd.Series, declared: pd.Series) -> pd.Series:
    """The classes that a pair's judgement may ask about."""
    return pd.Series([sorted(compat.classes_of(terms.loads(a)) | compat.classes_of(terms.loads(d))) for a, d in zip(actual, declared)], dtype="object")


def judged(rows: DataFrame, facts: Facts | World, rule=compat.fits) -> DataFrame:
    """rows (actual, expected) with fits: 2 yes, 1 unknown, 0 no.

    Each distinct pair of types is judged once, with the ancestors of the classes that it names only, whatever the size of the world.
    """
    if isinstance(facts, World):
        return rows.withColumn("fits", compatibility(F.col("actual"), F.col("expected"), facts, rule))
    pairs = rows.select("actual", "expected").distinct()
    named = pairs.withColumn("class", F.explode(_named("actual", "expected")))
    asked = named.select("class").distinct()
    above = facts.paths.join(asked, "class", "left_semi").groupBy("class").agg(F.array_sort(F.collect_set("owner")).alias("owners"))
    flags = [(facts.modules, "module"), (facts.dynamic, "dynamic")]
    known = asked.join(above, "class", "left")
    for table, name in flags:
        known = known.join(table.withColumn(name, F.lit(True)), "class", "left")
    known = known.select("class", F.struct("class", "owners", *[F.coalesce(n, F.lit(False)).alias(n) for _, n in flags]).alias("known"))
    given = named.join(known, "class").groupBy("actual", "expected").agg(F.array_sort(F.collect_list("known")).alias("known"))
    rails = facts.rails

    @arrow("int")
    def judge(actual: pd.Series, expected: pd.Series, known: pd.Series) -> pd.Series:
        def one(a, d, ks):
            ks = list(ks if ks is not None else [])
            own = World({k["class"]: frozenset(k["owners"]) for k in ks if k["owners"] is not None}, frozenset(k["class"] for k in ks if k["module"]), frozenset(k["class"] for k in ks if k["dynamic"]), rails)
            return rule(terms.loads(a), terms.loads(d), own)

        return pd.Series([one(*x) for x in zip(actual, expected, known)], dtype="int32")

    told = pairs.join(given, ["actual", "expected"], "left").select("actual", "expected", judge("actual", "expected", "known").alias("fits"))
    # by pairs of types, of which there are few, rows would meet in few tasks
    return rows.join(few(told), ["actual", "expected"])


def diagnostic(rows: DataFrame, code: str, message: Column, severity: str = "warning", **extra: Column) -> DataFrame:
    """Rows with POSITION as diagnostics."""
    none, empty = F.lit(None).cast("string"), F.lit("")
    fields = {"path": F.col("file"), "byte_start": F.col("start"), "byte_end": F.col("end"), "severity": F.lit(severity), "code": F.lit(code), "message": message, "method_name": empty, "unresolved_method": empty, "expected_type": none, "actual_type": none, "param_name": none} | extra
    return rows.select(*[fields.get(c, F.col(c)).alias(c) for c in DIAGNOSTIC])


#: Gates of missing methods: a call is dropped at the first that holds. The order matters for the counts.
GATES = [
    "empty_span", "union_receiver", "guarded", "resolved_elsewhere", "method_exists", "class_body_macro", "unknown_owner", "typed_result",
    "plugin_return", "resolvable_via_includers", "object_receiver", "incomplete_ancestors", "subclass_defines",
]


def gate(calls: DataFrame) -> DataFrame:
    """calls with `gate`: the first of GATES that holds (boolean columns; missing ones never hold), or null."""
    found = F.lit(None).cast("string")
    for name in reversed([g for g in GATES if g in calls.columns]):
        found = F.when(F.coalesce(F.col(name), F.lit(False)), F.lit(name)).otherwise(found)
    return calls.withColumn("gate", found)


def suppression_counts(gated: DataFrame) -> DataFrame:
    """How many calls were dropped for what can't be known."""
    return gated.filter(F.col("gate").isin("object_receiver", "incomplete_ancestors")).groupBy(F.col("gate").alias("reason")).agg(F.count("*").alias("n"))


def missing_methods(gated: DataFrame) -> DataFrame:
    """Calls that no gate dropped, once for each span and name; of several walks the first (ord) is judged."""
    first = gated.groupBy(*POSITION, "name", "unresolved").agg(F.min_by("gate", "ord").alias("gate")).filter("gate IS NULL")
    message = F.concat(F.lit("undefined method `"), "name", F.lit("` for "), "unresolved")
    return diagnostic(first, "missing_method", message, method_name=F.col("name"), unresolved_method=F.col("unresolved"))


def union_missing_methods(calls: DataFrame, surface: DataFrame) -> DataFrame:
    """Calls on unions (arms: array of struct(class, named, complete)) where some arm lacks the method.

    Silent if an arm has no class or an incomplete surface; nil is skipped for safe navigation. surface: class, name.
    """
    arms = calls.withColumn("arm", F.explode("arms")).filter(~(F.col("safe") & (F.col("arm.class") == "NilClass")))
    judged = arms.join(surface.select(F.col("class").alias("c"), F.col("name").alias("m"), F.lit(True).alias("has")).distinct(), (F.col("arm.class") == F.col("c")) & (F.col("name") == F.col("m")), "left")
    by = judged.groupBy(*POSITION, "name").agg(
        F.min(F.col("arm.named") & (F.col("arm.complete") | F.coalesce("has", F.lit(False)))).alias("sure"),
        F.array_sort(F.collect_set(F.when(F.col("has").isNull(), F.col("arm.class")))).alias("lacking"), F.count("has").alias("having"),
    )
    found = by.filter(F.col("sure") & (F.size("lacking") > 0) & (F.col("having") > 0))
    receiver = F.array_join("lacking", " | ")
    return diagnostic(found, "missing_method", F.concat(F.lit("undefined method `"), "name", F.lit("` for "), receiver), method_name=F.col("name"), unresolved_method=receiver)


def argument_mismatches(bound: DataFrame, facts: Facts | World) -> DataFrame:
    """Bound arguments (POSITION, site_id, arm, arms_named, pname, expected, actual) that can't fit; once for each span and member.

    A call whose receiver has an arm without a class is skipped whole.
    """
    bad = judged(bound.filter(F.coalesce("arms_named", F.lit(True))), facts).filter(F.col("fits") == NO).dropDuplicates(["file", "start", "end", "arm"])
    return _mismatch(bad, "argument_type_mismatch", "argument", F.col("pname"))


def overload_mismatches(bound: DataFrame, facts: Facts | World) -> DataFrame:
    """As argument_mismatches with overloads (overload: number; arity_fits): silent if any overload may fit, else the one with the
    fewest findings is reported, the first of equals."""
    found = judged(bound.filter("arity_fits"), facts).withColumn("bad", (F.col("fits") == NO).cast("int"))
    by = found.groupBy("site_id", "overload").agg(F.sum("bad").alias("n"))
    best = by.groupBy("site_id").agg(F.min(F.struct("n", "overload")).alias("b")).filter("b.n > 0").select("site_id", "b.overload")
    return _mismatch(found.filter("bad = 1").join(best, ["site_id", "overload"]), "argument_type_mismatch", "argument", F.col("pname"))


def _mismatch(bad: DataFrame, code: str, what: str, name: Column | None) -> DataFrame:
    from glossa.functions.columns import rendered

    rows = bad.withColumn("expected_text", rendered("expected")).withColumn("actual_text", rendered("actual"))
    label = F.concat(F.lit(f"{what} `"), name, F.lit("`")) if name is not None else F.lit(what)
    message = F.concat(label, F.lit(" expects "), "expected_text", F.lit(", got "), "actual_text")
    extra = {"expected_type": F.col("expected_text"), "actual_type": F.col("actual_text")}
    return diagnostic(rows, code, message, **(extra | ({"param_name": name} if name is not None else {})))


def return_mismatches(sites: DataFrame, declared: DataFrame, facts: Facts | World, universal: list[str] = ("to_s", "inspect", "initialize")) -> DataFrame:
    """Return sites (POSITION, class, name, actual) against declared returns (class, name, rank, expected): the least rank counts.

    Methods that every object has are skipped, and so are declarations that constrain nothing.
    """
    best = declared.groupBy("class", "name").agg(F.min_by("expected", "rank").alias("expected"))
    rows = dealt(sites.filter(~F.col("name").isin(list(universal))), "class", "name").join(best, ["class", "name"])
    bad = dealt(judged(rows, facts, compat.returns).filter(F.col("fits") == NO), "file", "start", "end").dropDuplicates(["file", "start", "end", "expected", "actual"])
    return _mismatch(bad, "return_type_mismatch", "return", None)


def unresolved_constants(sites: DataFrame, paths: DataFrame, runtime: list[str], builtin: list[str], incomplete: DataFrame) -> DataFrame:
    """Constant reads (POSITION, name, scope, path: what they resolved to) that name nothing.

    Silent for builtin names, runtime namespaces, and bare names in scopes whose ancestors aren't all known.
    """
    root = F.substring_index(F.regexp_replace("name", "^::", ""), "::", 1)
    open_ = sites.filter(F.col("path").isNull() & ~F.col("name").isin(builtin or [""]) & ~root.isin(runtime or [""]))
    opaque = incomplete.select(F.col("class").alias("scope")).distinct().withColumn("opaque", F.lit(True))
    rows = open_.join(opaque, "scope", "left").filter(~(F.coalesce("opaque", F.lit(False)) & ~F.col("name").contains("::"))).dropDuplicates(["file", "start", "end"])
    return diagnostic(rows, "unresolved_constant", F.concat(F.lit("uninitialized constant "), "name"))


@arrow("struct<low:int,high:int>")
def _arity(params: pd.Series) -> pd.DataFrame:
    found = [binding.arity([(p["pname"], p["kind"], None) for p in ps]) for ps in params]
    return pd.DataFrame({"low": [a for a, _ in found], "high": pd.array([b for _, b in found], dtype="Int32")})


def arity_mismatches(calls: DataFrame, severity: str = "error") -> DataFrame:
    """Calls (POSITION, name, receiver, params, positional, splat) whose number of arguments can't fit; calls with a splat are skipped."""
    rows = calls.filter(~F.col("splat")).withColumn("a", _arity("params"))
    bad = rows.filter((F.col("positional") < F.col("a.low")) | (F.col("positional") > F.col("a.high")))
    wanted = F.when(F.col("a.high").isNull(), F.concat(F.col("a.low").cast("string"), F.lit("+"))).when(F.col("a.low") == F.col("a.high"), F.col("a.low").cast("string")).otherwise(F.concat_ws("..", F.col("a.low").cast("string"), F.col("a.high").cast("string")))
    message = F.concat(F.lit("wrong number of arguments for "), "receiver", F.lit("."), "name", F.lit(": given "), F.col("positional").cast("string"), F.lit(", expected "), wanted)
    return diagnostic(bad, "arity_mismatch", message, severity, method_name=F.col("name"))


def union_arity_mismatches(calls: DataFrame) -> DataFrame:
    """The same for each arm of a union receiver (arms: array of struct(receiver, params))."""
    arms = calls.withColumn("arm", F.explode("arms")).withColumn("receiver", F.col("arm.receiver")).withColumn("params", F.col("arm.params"))
    return arity_mismatches(arms, "warning").dropDuplicates()


def missing_record_keys(reads: DataFrame) -> DataFrame:
    """Reads (POSITION, key, arms: array of array of keys; null arm: no record) where every candidate is a record with keys but without this one."""
    lacks = F.forall("arms", lambda a: a.isNotNull() & (F.size(a) > 0) & ~F.array_contains(a, F.col("key")))
    by = reads.withColumn("lacks", lacks & (F.size("arms") > 0)).groupBy(*POSITION, "key").agg(F.min("lacks").alias("lacks")).filter("lacks")
    return diagnostic(by, "missing_record_key", F.concat(F.lit("missing key "), "key"))


def coalesce_argument_sites(sites: DataFrame) -> DataFrame:
    """Argument sites of several walks as one: arguments of one place take their stable (known, not bot) types if there are any.

    sites: site key columns (file, start, end, receiver, name, owner, singleton), ord, safe, block, args: array of struct(start, end, keyword, idx, type).
    """
    from glossa.functions.columns import union_type_keeping_untyped

    key = ["file", "start", "end", "receiver", "name", "owner", "singleton"]
    args = sites.select(*key, F.explode("args").alias("a")).select(*key, "a.*", F.col("a.type").alias("t"))
    stable = ~F.col("t").isin('["bot"]', '["untyped"]') & ~F.col("t").rlike('"(param|keyword_param|method_return|receiver_method|ivar)"')
    place = [*key, F.col("a_start"), F.col("a_end"), "keyword", "idx"]
    args = sites.select(*key, F.explode("args").alias("a")).select(*key, F.col("a.start").alias("a_start"), F.col("a.end").alias("a_end"), "a.keyword", "a.idx", F.col("a.type").alias("t"))
    by = args.groupBy(*place).agg(F.array_sort(F.collect_set(F.when(stable, F.col("t")))).alias("good"), F.array_sort(F.collect_set("t")).alias("every"))
    by = by.withColumn("type", union_type_keeping_untyped(F.when(F.size("good") > 0, F.col("good")).otherwise(F.col("every"))))
    joined = by.groupBy(*key).agg(F.array_sort(F.collect_list(F.struct(F.col("a_start").alias("start"), F.col("a_end").alias("end"), "keyword", "idx", "type"))).alias("args"))
    whole = sites.groupBy(*key).agg(F.max("safe").alias("safe"), F.min_by("block", F.when(F.col("block").isNotNull(), F.col("ord"))).alias("block"))
    same = [whole[k].eqNullSafe(joined[k]) for k in key]
    return whole.join(joined, same, "left").select(*[whole[k] for k in key], "safe", "block", "args")


# suppressions, order, output


def suppressions(texts: DataFrame, marker: str = "check: ignore") -> DataFrame:
    """file, line, code of comments `# marker` (code null: all) and `# marker [code, code]`. Codes become snake case."""
    rows = texts.select("file", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    rest = F.regexp_extract("text", rf"#\s*{marker}\s*(.*?)\s*$", 1)
    hit = rows.filter(F.col("text").rlike(rf"#\s*{marker}\b")).select("file", (F.col("pos") + 1).alias("line"), rest.alias("rest"))
    every = hit.filter("rest = ''").select("file", "line", F.lit(None).cast("string").alias("code"))
    codes = F.split(F.regexp_extract("rest", r"^\[(.*)\]$", 1), r"\s*,\s*")
    named = hit.filter(F.col("rest").rlike(r"^\[\s*[^,\s]+(\s*,\s*[^,\s]+)*\s*\]$")).select("file", "line", F.explode(codes).alias("code"))
    plain = F.lower(F.regexp_replace(F.regexp_replace(F.trim("code"), "[-.]", "_"), r"(\p{Lu})", "_$1"))
    return every.union(named.select("file", "line", plain.alias("code")))


def _covers(d: str, s: str) -> Column:
    return (F.col(f"{d}.path") == F.col(f"{s}.file")) & (F.col(f"{d}.line") == F.col(f"{s}.line")) & (F.col(f"{s}.code").isNull() | (F.col(f"{s}.code") == F.col(f"{d}.code")))


def suppress(found: DataFrame, ignored: DataFrame) -> DataFrame:
    """Diagnostics without those that a comment on their line covers."""
    return dealt(found, "path", "line").alias("d").join(ignored.alias("s"), _covers("d", "s"), "left_anti")


def unused_suppressions(found: DataFrame, ignored: DataFrame) -> DataFrame:
    """file, line, code of comments that cover no diagnostic."""
    return ignored.alias("s").join(found.alias("d"), _covers("d", "s"), "left_anti")


def outside_broken(found: DataFrame, broken: DataFrame) -> DataFrame:
    """Diagnostics without those inside methods (file, first_line, last_line) that don't parse."""
    inside = (F.col("d.path") == F.col("b.file")) & F.col("d.line").between(F.col("b.first_line"), F.col("b.last_line"))
    return found.alias("d").join(broken.alias("b"), inside, "left_anti")


def combined(*found: DataFrame) -> DataFrame:
    out = found[0].select(*DIAGNOSTIC)
    for f in found[1:]:
        out = out.unionByName(f.select(*DIAGNOSTIC))
    return out.distinct()


def ordered(found: DataFrame, files: DataFrame) -> DataFrame:
    """In the order of files (path, file_ord), then by position, code and message."""
    return found.join(files, "path").orderBy("file_ord", "line", "column", "end_line", "end_column", "code", "message").drop("file_ord")


def json_lines(found: DataFrame) -> DataFrame:
    """value: one JSON object each; detail that a diagnostic lacks is left out."""
    return found.select(F.to_json(F.struct(*DIAGNOSTIC)).alias("value"))

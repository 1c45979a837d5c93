"""What method bodies are worth, from tables of syntax nodes (`sources.syntax`): joins of intervals, reaching definitions and a closure.

A node's value is that of the nodes it passes on: the last of its statements, either arm of a choice, what is assigned. A read of a local passes on the
writes that reach it. These edges form a graph, and a value is the union of the finished terms it reaches (`recursion.reached`), in rounds that grow with the
logarithm of the longest way. Nodes that make something of the values below them (calls on receivers, arrays, hashes, `or`) wait until these are closed; each pass
evaluates those that are ready. What depends on itself (a counter in a loop) is evaluated once with what else reaches it.

Writes reach reads by their place: a write is over where one behind it surely runs, that is, if the nearest arm around the later one holds the read, or holds
the earlier write; where its own arm is left by return, next, break or raise; and in the other arm of a choice. In loops and blocks, writes reach reads before them.
"""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from glossa.functions import returns, terms
from glossa.functions.columns import union_type_keeping_empty
from glossa.functions.udf import arrow
from glossa.operators.recursion import ON, TYPE, WAIT, reached
from glossa.plans.fixpoint import cut
from glossa.sources.syntax import BELOW, MADE, WRITES

UNTYPED, BOT, BLOCK = terms.dumps(terms.UNTYPED), terms.dumps(terms.BOT), terms.dumps(("block_return",))
#: Kinds that leave a body or a loop.
LEAVES = ["return", "break", "next"]
PARTS = "array<struct<slot:string,ord:int,kind:string,name:string,term:string>>"


def key(node: str = "node") -> Column:
    """A node's name among all files."""
    return F.concat_ws("#", "file", F.col(node).cast("string"))


def containers(nodes: DataFrame) -> DataFrame:
    """file, node (a def or a class body's node), class, singleton: the class that definitions stand in, by the containers around them."""
    inside = nodes.filter(F.col("kind").isin("def", "class", "module")).select("file", F.col("node").alias("n"), F.col("kind").alias("k"))
    around = nodes.filter(F.col("kind").isin("class", "module", "sclass")).select("file", "node", "last", "kind", "name")
    met = inside.join(around, "file", "left").filter((F.col("node") <= F.col("n")) & (F.col("n") <= F.col("last")) | F.col("node").isNull())
    named = F.when(F.col("kind") != "sclass", F.struct("node", "name"))
    by = met.groupBy("file", "n").agg(F.array_sort(F.collect_list(named)).alias("path"), F.max(F.col("kind") == "sclass").alias("opened"))
    every = inside.select("file", "n").join(by, ["file", "n"], "left")
    name = F.array_join(F.transform("path", lambda x: x["name"]), "::")
    return every.select("file", F.col("n").alias("node"), F.when(F.coalesce(name, F.lit("")) == "", "Object").otherwise(name).alias("class"), F.coalesce("opened", F.lit(False)).alias("singleton"))


def definitions(nodes: DataFrame) -> DataFrame:
    """file, node, last, line, class, name, singleton of every method."""
    on_self = nodes.filter("kind = 'on_self'").select("file", F.col("parent").alias("node"), F.lit(True).alias("own"))
    rows = nodes.filter("kind = 'def'").select("file", "node", "last", "line", "name").join(containers(nodes), ["file", "node"]).join(on_self, ["file", "node"], "left")
    return rows.select("file", "node", "last", "line", "class", "name", (F.col("singleton") | F.coalesce("own", F.lit(False))).alias("singleton"))


def parameters(nodes: DataFrame) -> DataFrame:
    """file, node, scope, name, style, spot (its place among positional ones) of every parameter of a method; those of blocks have no spot."""
    style = nodes.filter("slot = 'style'").select("file", F.col("parent").alias("node"), F.col("kind").alias("style"))
    rows = nodes.filter("kind = 'param'").join(style, ["file", "node"])
    placed = rows.filter("up = 'def' AND style IN ('required', 'optional', 'rest')").select("file", "parent", "node", "ord")
    spots = placed.groupBy("file", "parent").agg(F.array_sort(F.collect_list("node")).alias("of"))
    met = rows.join(spots, ["file", "parent"], "left")
    spot = F.when((F.col("up") == "def") & F.col("style").isin("required", "optional", "rest"), F.array_position("of", F.col("node")) - 1)
    return met.select("file", "node", "parent", "up", "scope", "name", "style", spot.alias("spot"))


def reaching(nodes: DataFrame) -> DataFrame:
    """file, node (a read of a local), write, how (the write's kind): the writes that may have given the local its value."""
    writes = nodes.filter(F.col("kind").isin(WRITES) & F.col("name").isNotNull()).withColumn("scope", F.when((F.col("kind") == "param") & (F.col("up") == "def"), F.col("parent")).otherwise(F.col("scope")))
    blocks = nodes.filter("kind IN ('block', 'lambda')").select("file", F.col("node").alias("parent"), F.col("last").alias("end"))
    own = (F.col("kind") == "param") & (F.col("up") != "def")
    writes = writes.filter(own).join(blocks, ["file", "parent"], "left").unionByName(writes.filter(~own), allowMissingColumns=True).withColumn("from", F.when((F.col("kind") == "param") & F.col("end").isNotNull(), F.col("parent")))
    w = writes.select("file", "scope", "name", F.col("node").alias("write"), F.col("last").alias("done"), F.col("arm").alias("w_arm"), F.col("arm_last").alias("w_end"), F.coalesce("arms", F.array().cast("array<struct<arm:long,above:long>>")).alias("w_arms"), F.coalesce("loops", F.array().cast("array<long>")).alias("w_loops"), "from", "end", F.col("kind").alias("how"))
    reads = nodes.filter("kind = 'lvar'").select("file", "scope", "name", "node", "arms", "loops")
    holds = lambda at: F.col("w_arm").isNull() | (F.col("w_arm") <= at) & (at <= F.col("w_end"))
    pairs = reads.join(w, ["file", "scope", "name"]).filter(F.col("from").isNull() | F.col("node").between(F.col("from"), F.col("end")))
    before = F.col("done") < F.col("node")
    again = F.arrays_overlap("loops", "w_loops")
    apart = F.exists("w_arms", lambda x: F.exists("arms", lambda y: (x["above"] == y["above"]) & (x["arm"] != y["arm"]) & ~F.exists(F.array_intersect("loops", "w_loops"), lambda z: z > x["above"])))
    pairs = pairs.filter((before | again) & ~apart).withColumn("before", before)
    # the last write before a read that surely ran, and for each write where it is surely over
    sure = F.max(F.when(F.col("before") & holds(F.col("node")), F.col("write"))).over(Window.partitionBy("file", "node"))
    later = w.filter("from IS NULL").select("file", "scope", "name", F.col("write").alias("other"), "w_arm", "w_end")
    first = w.select("file", "scope", "name", "write", "done").join(later, ["file", "scope", "name"]).filter((F.col("other") > F.col("done")) & holds(F.col("write")))
    leaves = nodes.filter(F.col("kind").isin(LEAVES) | (F.col("kind") == "call") & F.col("arms").isNotNull()).select("file", "scope", F.col("node").alias("other"), F.col("arm").alias("w_arm"), F.col("arm_last").alias("w_end"))
    left = w.select("file", "scope", "name", "write", "done").join(leaves, ["file", "scope"]).filter((F.col("other") > F.col("done")) & holds(F.col("write")))
    over = first.select("file", "write", "other").union(left.select("file", "write", "other")).groupBy("file", "write").agg(F.min("other").alias("over"))
    met = pairs.withColumn("sure", sure).join(over, ["file", "write"], "left")
    alive = F.coalesce(F.col("write") >= F.col("sure"), F.lit(True)) & F.coalesce(F.col("over") > F.col("node"), F.lit(True))
    return met.filter(F.col("before") & alive | ~F.col("before") & (F.col("sure").isNull() | ~holds(F.col("node")))).select("file", "node", "write", "how").distinct()


def passes() -> Column:
    """Whether a node's value is its parent's."""
    up, slot = F.col("up"), F.col("slot")
    return (
        (up == "statements") & F.col("final") | (up == "if") & slot.isin("then", "else") | (up == "case") & slot.isin("when", "else") | up.isin("when", "in") & (slot == "body_of_when")
        | (up == "begin") & slot.isin("body", "rescue", "else") | (up == "rescue_arm") & (slot == "body") | up.isin("assign", "iassign", "gassign", "cassign", "masgn") & (slot == "value") & (F.col("kind") != "part")
    )


def _call(name: str, receiver, owner: str, args: list):
    """What a call on a known receiver is worth."""
    if receiver is None:
        if name in ("raise", "fail", "throw", "exit", "abort"):
            return terms.BOT
        return {"block_given?": terms.BOOL, "puts": terms.NIL, "print": terms.NIL, "lambda": terms.UNTYPED, "proc": terms.UNTYPED}.get(name) or ("method_return", owner, name)
    if name in ("==", "!=", "<", ">", "<=", ">=", "===", "=~", "!~", "is_a?", "nil?", "kind_of?", "respond_to?", "instance_of?", "equal?", "eql?"):
        return terms.BOOL
    if receiver[0] == "union":
        return terms.union_keeping_untyped([_call(name, x, owner, args) for x in receiver[1]])
    base = terms.LITERAL_BASE.get(receiver[0], receiver)
    other = terms.LITERAL_BASE.get(args[0][0], args[0]) if args else None
    if name in ("+", "-", "*", "/", "%", "**") and base in (terms.INTEGER, terms.FLOAT) and other in (terms.INTEGER, terms.FLOAT):
        return terms.INTEGER if base == other == terms.INTEGER else terms.FLOAT
    if name in ("+", "*", "%", "<<") and base == terms.STRING:
        return terms.STRING
    if receiver[0] == "singleton":
        return ("class", receiver[1]) if name == "new" else ("receiver_method", receiver, name)
    if (found := returns.known_return(receiver, name)) is not None:
        return found
    if name in ("to_s", "inspect"):
        return terms.STRING
    if name in ("to_i", "to_a", "to_h", "to_f", "to_sym") and base in (terms.STRING, terms.INTEGER, terms.FLOAT, terms.NIL):
        return {"to_i": terms.INTEGER, "to_f": terms.FLOAT, "to_sym": terms.SYMBOL}.get(name, terms.UNTYPED)
    if receiver[0] == "tuple" and name in ("first", "last") and not args and receiver[1]:
        return receiver[1][0 if name == "first" else -1]
    if receiver[0] == "tuple" and name == "[]" and args and args[0][0] == "lit_int":
        at = args[0][1]
        return receiver[1][at] if -len(receiver[1]) <= at < len(receiver[1]) else terms.NIL
    if receiver[0] == "record" and name == "[]" and args and args[0][0] in ("lit_sym", "lit_str"):
        return next((v for k, v, _ in receiver[1] if k[1] == args[0][1]), terms.NIL)
    if receiver[0] in ("class", "generic") or terms.is_deferred(receiver):
        return ("receiver_method", receiver, name)
    return terms.UNTYPED


def settled(t):
    """t with calls on what has become known carried out; calls on classes stay."""
    return terms.transform(t, lambda x: _call(x[2], x[1], "", []) if x[0] == "receiver_method" and not terms.is_deferred(x[1]) else x)


def _made(kind: str, name: str | None, owner: str, parts: list[dict]):
    of = lambda slot: [terms.loads(p["term"]) for p in sorted(parts, key=lambda p: p["ord"]) if p["slot"] == slot]
    if kind == "call":
        got = of("receiver")
        if any(p["slot"] == "safe" for p in parts) and got:
            inner = terms.project_non_nil(got[0]) or terms.NIL
            return terms.safe_navigation(got[0], _call(name, inner, owner, of("arg")))
        return _call(name, got[0] if got else None, owner, of("arg"))
    if kind == "array":
        rows = sorted(parts, key=lambda p: p["ord"])
        if not rows:
            return terms.array()
        if any(p["kind"] in ("splat", "keywords") for p in rows):
            return terms.array(terms.UNTYPED)
        return ("tuple", tuple(of("item")))
    if kind in ("hash", "keywords"):
        rows = sorted(parts, key=lambda p: p["ord"])
        if not rows:
            return ("hash", None, None)
        if all(p["kind"] == "pair" and p["name"] is not None for p in rows):
            return ("record", tuple((("sym", p["name"]), terms.loads(p["term"]), False) for p in rows))
        return ("hash", None, None)
    if kind in ("or", "and"):
        (left,), (right,) = of("left") or [terms.UNTYPED], of("right") or [terms.UNTYPED]
        some = (terms.project_truthy if kind == "or" else terms.project_falsy)(left)
        return terms.union_keeping_untyped([t for t in (some, right) if t is not None])
    return terms.UNTYPED


@arrow("string")
def made(kind: pd.Series, name: pd.Series, owner: pd.Series, parts: pd.Series) -> pd.Series:
    """The term that a node makes of the terms below it."""
    return pd.Series([terms.dumps(_made(k, n, o, list(p) if p is not None else [])) for k, n, o, p in zip(kind, name, owner, parts)], dtype="object")


def asked(nodes: DataFrame) -> DataFrame:
    """The nodes that what methods give may depend on, and those that tell where they are."""
    places = ["def", "class", "module", "sclass", "on_self", "block", "lambda", *LEAVES, *WRITES]
    return nodes.filter(F.col("top").isNotNull() | F.col("kind").isin(places) | (F.col("slot") == "style") | (F.col("kind") == "call") & F.col("arms").isNotNull())


def values(nodes: DataFrame, direct: bool = False) -> DataFrame:
    """file, node, term of every node that has a value. nodes: NODES, stored. direct: only of those that others ask for (of `asked`): what
    nodes pass on goes straight to the one at the end of its way up."""
    inside = definitions(nodes).select("file", F.col("node").alias("scope"), "class", "singleton")
    # only these ask where they are
    asks = F.col("kind").isin("self", *MADE)
    owned = nodes.filter(asks).join(inside, ["file", "scope"], "left").unionByName(nodes.filter(~asks), allowMissingColumns=True)
    owned = owned.withColumn("class", F.coalesce("class", F.lit("Object"))).withColumn("singleton", F.coalesce("singleton", F.lit(False)))
    params = parameters(nodes)
    spot = F.col("spot").cast("string")
    positional = F.concat(F.lit('["param",'), spot, F.lit("]"))
    of_param = F.when(F.col("style") == "rest", F.concat(F.lit('["array",'), positional, F.lit("]"))).when(F.col("spot").isNotNull(), positional)
    of_param = of_param.when((F.col("up") == "def") & F.col("style").startswith("keyword"), F.concat(F.lit('["keyword_param","'), F.col("name"), F.lit('"]'))).otherwise(UNTYPED)
    quoted = F.concat(F.lit('"'), F.col("name"), F.lit('"]'))
    plain = (
        F.when(F.col("term").isNotNull(), F.col("term")).when(F.col("kind") == "ivar", F.concat(F.lit('["ivar",'), quoted))
        .when(F.col("kind") == "self", F.concat(F.when(F.col("singleton"), '["singleton","').otherwise('["class","'), F.col("class"), F.lit('"]')))
        .when(F.col("kind").isin("const", "colon"), F.when(F.col("name").rlike(r"(^|::)[A-Z][A-Z\d_]*$"), UNTYPED).otherwise(F.concat(F.lit('["singleton",'), quoted)))
        .when(F.col("kind").isin(*LEAVES, "redo", "retry"), BOT).when(F.col("kind") == "yield", BLOCK)
    )
    flowing = ["statements", "if", "case", "when", "in", "begin", "rescue_arm", "assign", "iassign", "gassign", "cassign", "masgn", "lvar", "pair"]
    leaf = (owned.filter("top IS NOT NULL") if direct else owned).select(key("top" if direct else "node").alias("mid"), "kind", plain.alias("term")).filter(~F.col("kind").isin(*MADE, *flowing, "param"))
    leaf = leaf.select("mid", F.coalesce("term", F.lit(UNTYPED)).alias("term")).union(params.select(key().alias("mid"), of_param))
    passed = nodes.filter(passes() | (F.col("up") == "pair") & (F.col("slot") == "value")).select(key("parent").alias("mid"), key().alias("to"))
    if direct:
        passed = nodes.filter((F.col("top") != F.col("node")) & F.col("kind").isin(*MADE, "assign", "lvar")).select(key("top").alias("mid"), key().alias("to"))
    reach = cut(reaching(nodes))
    local = reach.filter("how IN ('assign', 'param')").select(key().alias("mid"), key("write").alias("to"))
    bound = reach.filter("how NOT IN ('assign', 'param')").select(key().alias("mid"), F.lit(UNTYPED))
    lost = nodes.filter("kind = 'lvar'").join(reach.select("file", "node"), ["file", "node"], "left_anti").select(key().alias("mid"), F.lit(UNTYPED).alias("term"))
    wait = (owned.filter("top IS NOT NULL") if direct else owned).filter(F.col("kind").isin(MADE)).select(key().alias("mid"), "kind", "name", "class")
    below = nodes.join(wait.select(F.col("mid").alias("m")).withColumn("w", F.lit(True)), key("parent") == F.col("m"), "left_semi").filter(F.col("slot").isin(BELOW))
    below = cut(below.select(key("parent").alias("mid"), key().alias("child"), "slot", "ord", "kind", "name"))
    none = F.lit(None).cast("string")
    fixed = leaf.union(bound).union(lost).select("mid", F.lit(TYPE).alias("kind"), none.alias("to"), "term")
    fixed = cut(fixed.union(passed.union(local).distinct().select("mid", F.lit(ON), "to", none)))
    wait, done, total = cut(wait), None, nodes.count()
    while True:
        open_ = wait if done is None else wait.join(done.select("mid"), "mid", "left_anti")
        rows = fixed.union(open_.select("mid", F.lit(WAIT), none, none))
        rows = rows if done is None else rows.union(done.select("mid", F.lit(TYPE), none, "term"))
        closed, _ = reached(rows, total)
        terms_ = closed.groupBy("mid").agg(F.array_sort(F.collect_set(F.when(F.col("kind") == TYPE, F.col("term")))).alias("ts"), F.max((F.col("kind") == WAIT).cast("int")).alias("held"))
        terms_ = cut(terms_.select("mid", "held", F.when(F.size("ts") == 0, BOT).otherwise(union_type_keeping_empty("ts")).alias("term")))
        if open_.isEmpty():
            return terms_.select(F.substring_index("mid", "#", -1).cast("long").alias("node"), F.regexp_replace("mid", "#[^#]*$", "").alias("file"), "term").select("file", "node", "term")
        parts = below.join(open_.select("mid"), "mid", "left_semi").join(terms_.select(F.col("mid").alias("child"), "term", "held"), "child", "left")
        by = parts.groupBy("mid").agg(F.collect_list(F.struct("slot", "ord", "kind", "name", F.coalesce("term", F.lit(UNTYPED)).alias("term"))).alias("parts"), F.max(F.coalesce("held", F.lit(0))).alias("held"))
        asked = open_.join(by, "mid", "left").withColumn("held", F.coalesce("held", F.lit(0)))
        ready = asked.filter("held = 0")
        if ready.isEmpty():
            ready = asked
        new = cut(ready.select("mid", made("kind", "name", "class", F.coalesce("parts", F.array().cast(PARTS))).alias("term")))
        done = new if done is None else cut(done.union(new))


def method_returns(nodes: DataFrame, found: DataFrame | None = None) -> DataFrame:
    """file, line, class, name, singleton, ret, form: the union of what each body ends in and of what it returns. In form, what the block gives
    is a term of its own; in ret it is untyped. found: values, if they are known."""
    if found is None:
        nodes = asked(nodes)
        found = values(nodes, direct=True)
    defs = definitions(nodes)
    ends = nodes.filter("up = 'def' AND slot = 'body'").select("file", F.col("parent").alias("def"), "node")
    early = nodes.filter("up = 'return'").select("file", F.col("scope").alias("def"), "node")
    empty = nodes.filter("kind = 'return'").join(early.select("file", F.col("node").alias("c")).join(nodes.select("file", F.col("node").alias("c"), F.col("parent").alias("node")), ["file", "c"]).select("file", "node"), ["file", "node"], "left_anti")
    got = ends.union(early).join(found, ["file", "node"]).select("file", "def", "term").union(empty.select("file", F.col("scope").alias("def"), F.lit('["nil"]')))
    by = got.groupBy("file", "def").agg(F.array_sort(F.collect_set("term")).alias("ts")).select("file", F.col("def").alias("node"), union_type_keeping_empty(F.filter("ts", lambda t: (t != BOT) | (F.size("ts") == 1))).alias("ret"))
    return defs.join(by, ["file", "node"], "left").select("file", "line", "class", "name", "singleton", F.coalesce("ret", F.lit('["nil"]')).alias("form")).withColumn("ret", F.replace("form", F.lit(BLOCK), F.lit(UNTYPED)))


def parameter_uses(nodes: DataFrame) -> DataFrame:
    """class, name, idx, use: the events that `flows.param_flows` reads, derived from bodies; idx is a required parameter's place.

    A read is `called` as the receiver of call, `yielded` as an argument of yield, `returned` if its value is what the method gives (also within an array
    or a hash), else `read`; `narrowed` where a condition tests it, `assigned` and `shadowed` where it gets another value or name.
    """
    defs = definitions(nodes).select("file", F.col("node").alias("scope"), "class", F.col("name").alias("method"))
    mine = parameters(nodes).filter("up = 'def' AND style = 'required'").select("file", F.col("parent").alias("scope"), F.col("name").alias("pname"), F.col("spot").alias("idx"))
    reads = nodes.filter("kind = 'lvar'").join(mine, ["file", "scope"]).filter("name = pname")
    flow = nodes.filter(passes() | F.col("up").isin("array", "pair") & F.col("slot").isin("item", "value") | (F.col("up") == "hash") | (F.col("up") == "def") & (F.col("slot") == "body") | (F.col("up") == "return"))
    # a read is returned if the way up from it passes values on to the method's body or to a return
    up = flow.select(key().alias("mid"), F.when(F.col("up").isin("def", "return"), TYPE).otherwise(ON).alias("kind"), F.when(~F.col("up").isin("def", "return"), key("parent")).alias("to"), F.when(F.col("up").isin("def", "return"), "out").alias("term"))
    asked = reads.select(key().alias("mid"))
    closed, _ = reached(up, nodes.count())
    out = closed.filter(F.col("term") == "out").join(asked, "mid", "left_semi").select("mid").distinct().withColumn("out", F.lit(True))
    parents = nodes.select("file", F.col("node").alias("parent"), F.col("name").alias("called"))
    rows = reads.join(parents, ["file", "parent"]).withColumn("mid", key()).join(out, "mid", "left")
    tested = (F.col("slot") == "cond") | (F.col("slot") == "subject") | (F.col("up") == "call") & (F.col("slot") == "receiver") & F.col("called").isin("is_a?", "kind_of?", "nil?", "instance_of?", "respond_to?") | (F.col("up") == "not")
    use = F.when(tested, "narrowed").when((F.col("up") == "call") & (F.col("slot") == "receiver") & (F.col("called") == "call"), "called").when(F.col("up") == "yield", "yielded").when(F.col("out"), "returned").otherwise("read")
    found = rows.select("file", "scope", "idx", use.alias("use"))
    changed = nodes.filter("kind IN ('assign', 'bind') OR kind = 'param' AND up <> 'def'").join(mine, ["file", "scope"]).filter("name = pname")
    found = found.union(changed.select("file", "scope", "idx", F.when(F.col("kind") == "assign", "assigned").otherwise("shadowed")))
    return found.join(defs, ["file", "scope"]).select("class", F.col("method").alias("name"), "idx", "use")

"""Declarations and simple bodies of Ruby sources, read line by line.

This is no Ruby parser: it follows the nesting of class, module, def and blocks, and understands a body's last expression if that is
a literal, a variable, a constructor or a call on self. Whatever else a body holds is untyped, never guessed.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import terms as T

FACTS = "file string, row string, ord int, line int, class string, name string, singleton boolean, kind string, visibility string, type string, params array<struct<idx:int,pname:string,kind:string,default_type:string>>, names array<string>, options map<string,string>"
OPENERS = re.compile(r"^(?:if|unless|while|until|case|begin|for)\b|=\s*(?:if|unless|case|begin|while)\b")
BLOCK = re.compile(r"\bdo\b\s*(?:\|[^|]*\|)?\s*$")
CONSTANT = r"(?:::)?[A-Z]\w*(?:::[A-Z]\w*)*"
MACRO = re.compile(r"^([a-z_]\w*[?!]?)(?:\s+|\()(.*?)\)?\s*(?:\bdo\b.*)?$")
MIXINS = ("include", "extend", "prepend")


def blank(line: str) -> str:
    """A line without its comment, strings emptied (their quotes stay)."""
    out, quote, k = [], None, 0
    while k < len(line):
        c = line[k]
        if quote:
            if c == "\\":
                k += 1
            elif c == quote:
                quote = None
                out.append(c)
        elif c in "\"'`":
            quote = c
            out.append(c)
        elif c == "#":
            break
        else:
            out.append(c)
        k += 1
    return "".join(out).strip()


def uncommented(line: str) -> str:
    """A line without its comment."""
    quote = None
    for k, c in enumerate(line):
        if quote:
            if c == quote and line[k - 1] != "\\":
                quote = None
        elif c in "\"'`":
            quote = c
        elif c == "#":
            return line[:k].strip()
    return line.strip()


def split_args(text: str) -> list[str]:
    out, depth, quote, now = [], 0, None, ""
    for c in text:
        if quote:
            quote = None if c == quote else quote
        elif c in "\"'":
            quote = c
        elif c in "([{":
            depth += 1
        elif c in ")]}":
            depth -= 1
        if c == "," and not depth and not quote:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out


def expression(text: str, params: dict[str, tuple], owner: str, singleton: bool = False):
    """The type of a simple expression; untyped if it isn't simple."""
    s = text.strip().rstrip(";").removeprefix("return ").strip()
    if not s or s == "nil" or s == "return":
        return T.NIL
    if s in ("true", "false"):
        return (s,)
    if s == "self":
        return ("singleton", owner) if singleton else T.cls(owner)
    if re.fullmatch(r"-?\d[\d_]*", s):
        return ("lit_int", int(s.replace("_", "")))
    if re.fullmatch(r"-?\d[\d_]*\.\d+", s):
        return ("lit_float", s)
    if re.fullmatch(r'"(?:[^"\\]|\\.)*"', s):
        return T.STRING if "#{" in s else ("lit_str", s[1:-1])
    if re.fullmatch(r"'[^']*'", s):
        return ("lit_str", s[1:-1])
    if re.fullmatch(r":[A-Za-z_]\w*[?!=]?", s):
        return ("lit_sym", s[1:])
    if s.startswith("[") and s.endswith("]"):
        return ("tuple", tuple(expression(x, params, owner, singleton) for x in split_args(s[1:-1]))) if s != "[]" else T.array()
    if s.startswith("{") and s.endswith("}"):
        pairs = [re.fullmatch(r"(\w+):\s+(.+)", x, re.S) for x in split_args(s[1:-1])]
        if not pairs:
            return ("hash", None, None)
        return ("record", tuple((("sym", m[1]), expression(m[2], params, owner, singleton), False) for m in pairs)) if all(pairs) else ("hash", None, None)
    if re.fullmatch(r"@\w+", s):
        return ("ivar", s)
    if s in params:
        return params[s]
    m = re.fullmatch(rf"({CONSTANT})\.new(?:\(.*\))?", s, re.S)
    if m:
        return T.cls(m[1].removeprefix("::"))
    m = re.fullmatch(r"(?:self\.)?([a-z_]\w*[?!]?)(?:\([^()]*\))?", s)
    if m and m[1] not in ("raise", "super", "yield", "loop", "puts", "p"):
        return ("method_return", owner, m[1])
    return T.UNTYPED


def parameters(text: str) -> list[tuple[str, str, str | None]]:
    """name, kind and default text of a parameter list."""
    out = []
    for p in split_args(text):
        for pattern, kind in ((r"\*\*(\w*)", "double_rest"), (r"\*(\w*)", "rest"), (r"&(\w*)", "block"), (r"(\w+):", "keyword_required"), (r"(\w+):\s*(.+)", "keyword_optional"), (r"(\w+)\s*=\s*(.+)", "optional"), (r"(\w+)", "required")):
            m = re.fullmatch(pattern, p, re.S)
            if m:
                out.append((m[1], kind, m[2] if kind in ("keyword_optional", "optional") else None))
                break
    return out


def literals(text: str) -> tuple[list[str], dict[str, str]]:
    """Literal names and literal options of a call's arguments."""
    names, options = [], {}
    for a in split_args(text):
        m = re.fullmatch(r"(\w+):\s+(.+)", a, re.S) or re.fullmatch(r":(\w+)\s*=>\s*(.+)", a, re.S)
        if m:
            value = m[2].strip()
            if value.startswith(("[", "%i[", "%w[")) and value.endswith("]"):
                value = json.dumps([x.strip(":\"' ") for x in (value[3:-1].split() if value[0] == "%" else split_args(value[1:-1]))])
            elif value.startswith("{"):
                names += re.findall(r"(\w+):", value) if m[1] not in ("if", "unless") else []
                names.insert(0, m[1]) if m[1] not in options else None
                continue
            options[m[1]] = value.strip(":\"'") if value[:1] in ":\"'" else value
        elif a[:1] in ":\"'":
            names.append(a.strip(":\"'"))
        elif a.startswith(("%i[", "%w[")):
            names += a[3:-1].split()
        elif a.startswith("["):
            names += [x.strip(":\"' ") for x in split_args(a[1:-1])]
        elif re.fullmatch(rf"{CONSTANT}(?:\(:?\w+\))?", a):
            names.append(a.removeprefix("::"))
    return names, options


class Reader:
    """The facts of one file."""

    def __init__(self, text: str):
        self.lines = text.split("\n")
        self.rows: list[dict] = []
        self.stack: list[dict] = []

    def add(self, row: str, line: int, **more) -> None:
        self.rows.append({"row": row, "ord": len(self.rows), "line": line} | more)

    def scope(self) -> str:
        return next((f["name"] for f in reversed(self.stack) if f["kind"] in ("class", "module")), "Object")

    def method(self) -> dict | None:
        return next((f for f in reversed(self.stack) if f["kind"] == "def"), None)

    def read(self) -> list[dict]:
        skipping, heredoc = False, None
        for number, raw in enumerate(self.lines, 1):
            if heredoc:
                heredoc = None if raw.strip() == heredoc else heredoc
                continue
            if raw.startswith("=begin") or skipping:
                skipping = not raw.startswith("=end")
                continue
            if raw.startswith("__END__"):
                break
            m = re.search(r"<<[~-]?['\"]?([A-Z_]+)['\"]?", raw)
            heredoc = m[1] if m else None
            code = blank(raw)
            if code:
                self.statement(code, uncommented(raw), number)
        return self.rows

    def push(self, kind: str, **more) -> None:
        self.stack.append({"kind": kind} | more)

    def statement(self, code: str, text: str, n: int) -> None:
        if re.match(r"end\b", code):
            if self.stack:
                self.close(self.stack.pop(), n)
            return
        m = re.match(rf"(class|module)\s+({CONSTANT})(?:\s*<\s*({CONSTANT}))?", code)
        if m:
            self.open_class(m, n)
            if re.search(r";\s*end\s*$", code):
                self.stack.pop()
            return
        if re.match(r"class\s*<<\s*self", code):
            self.push("sclass", visibility="public")
            return
        m = re.match(r"(?:(private|public|protected)\s+)?def\s+(self\.)?([\w]+[?!=]?|[+\-*/%<>=!~^&|\[\]]+)\s*(\((?:[^()]|\([^()]*\))*\)|[^=;]*)?", code)
        if m and code.lstrip().startswith(("def", "private", "public", "protected")) and " def " in f" {code}":
            self.open_def(code, text, n)
            return
        method = self.method()
        if OPENERS.search(code) or BLOCK.search(code):
            if method:
                method["nested"] += 1
            macro = MACRO.match(text) if not method and BLOCK.search(code) else None
            self.push("block", call=macro[1] if macro else None, in_def=bool(method))
            if macro:
                self.macro(macro, n)
            return
        if method:
            self.body(method, code, text, n)
        else:
            self.class_body(code, text, n)

    def open_class(self, m: re.Match, n: int) -> None:
        outer = self.scope()
        name = m[2].removeprefix("::")
        full = name if outer == "Object" or m[2].startswith("::") else f"{outer}::{name}"
        self.push(m[1], name=full, visibility="public")
        self.add("class", n, **{"class": full}, name=(m[3] or "").removeprefix("::") or None, kind=m[1])

    def open_def(self, code: str, text: str, n: int) -> None:
        m = re.match(r"(?:(private|public|protected)\s+)?def\s+(self\.)?([A-Za-z_]\w*[?!]?=?(?!\w)|[+\-*/%<>=!~^&|\[\]]+)\s*(.*)$", text)
        if not m:
            self.push("block", call=None, in_def=False)
            return
        name, rest, endless = m[3], m[4].strip(), None
        if name.endswith("=") and not rest.startswith("("):
            name, rest = name[:-1], "= " + rest  # def x = expression
        if rest.startswith("("):
            depth = 0
            for k, c in enumerate(rest):
                depth += (c == "(") - (c == ")")
                if not depth:
                    break
            args, rest = rest[1:k], rest[k + 1 :].strip()
        elif rest.startswith("="):
            args = ""
        else:
            args, _, rest = rest.partition(";")
            rest = f";{rest}" if _ else ""
        if rest.startswith("="):
            endless = rest[1:].strip()
        owner, frame = self.scope(), next((f for f in reversed(self.stack) if f["kind"] in ("class", "module", "sclass")), None)
        singleton = bool(m[2]) or bool(frame and frame["kind"] == "sclass")
        ps = parameters(args)
        env, spot = {}, 0
        for p, kind, _ in ps:
            if kind in ("required", "optional", "rest"):
                env[p], spot = ("param", spot) if kind != "rest" else T.array(("param", spot)), spot + 1
            elif kind != "block":
                env[p] = ("keyword_param", p)
        found = {"kind": "def", "name": name, "owner": owner, "singleton": singleton, "line": n, "visibility": m[1] or (frame or {}).get("visibility", "public"), "params": ps, "env": env, "returns": [], "last": None, "nested": 0}
        if endless is not None:
            found["last"] = endless
            self.finish(found)
        elif re.search(r";\s*end\s*$", code):
            found["last"] = re.sub(r";\s*end\s*$", "", rest).lstrip("; ") or "nil"
            self.finish(found)
        else:
            self.stack.append(found)

    def close(self, frame: dict, n: int) -> None:
        if frame["kind"] == "def":
            self.finish(frame)
        elif frame["kind"] == "block":
            method = self.method()
            if method and frame.get("in_def"):
                method["last"] = None if method["nested"] else method["last"]
                method["last"], method["open"] = "", True

    def finish(self, m: dict) -> None:
        last = m["last"]
        kept = [{"idx": k, "pname": p, "kind": kind, "default_type": T.dumps(expression(d, {}, m["owner"])) if d else None} for k, (p, kind, d) in enumerate(m["params"])]
        if last is None:
            t = T.NIL
        elif m.get("open") and last == "":
            t = T.UNTYPED
        else:
            t = expression(last, m["env"], m["owner"], m["singleton"])
        parts = [expression(r, m["env"], m["owner"], m["singleton"]) for r in m["returns"]]
        ret = T.union_keeping_untyped([*parts, t]) if parts else t
        self.add("method", m["line"], **{"class": m["owner"]}, name=m["name"], singleton=m["singleton"], visibility=m["visibility"], type=T.dumps(ret), params=kept)

    def body(self, m: dict, code: str, text: str, n: int) -> None:
        if re.match(r"(else|elsif|when|in|rescue|ensure)\b", code):
            return
        ivar = re.match(r"(@\w+)\s*(?:\|\|)?=\s*(.+)$", text)
        if ivar:
            self.add("ivar", n, **{"class": m["owner"]}, name=ivar[1], kind=m["name"], singleton=m["singleton"], type=T.dumps(expression(ivar[2], m["env"], m["owner"], m["singleton"])))
        local = re.match(r"([a-z_]\w*)\s*=\s*([^=~].*)$", text)
        inner = any(f["kind"] == "block" for f in self.stack[self.stack.index(m) :])
        if local:
            m["env"][local[1]] = T.UNTYPED if inner else expression(local[2], m["env"], m["owner"], m["singleton"])
        plain = re.sub(r"\s+(if|unless)\s+.*$", "", text)
        if re.match(r"return\b", code):
            m["returns"].append(plain)
        self.calls(m, text, n)
        if not inner:
            value = local[2] if local else ivar[2] if ivar else text
            m["last"], m["open"] = (value if plain == text or local else ""), plain != text
            if plain != text:
                m["returns"].append("nil")

    def calls(self, m: dict, text: str, n: int) -> None:
        """Calls on self with plain arguments, and constructor calls."""
        for c in re.finditer(rf"(?:\b({CONSTANT})\.|(?<![\w.@:]))([a-z_]\w*[?!]?)\(([^()]*)\)", text):
            owner, name = (c[1].removeprefix("::"), c[2]) if c[1] else (m["owner"], c[2])
            args = split_args(c[3])
            given = [[re.match(r"(\w+):\s+", a)[1] if re.match(r"\w+:\s+", a) else None, T.dumps(expression(re.sub(r"^\w+:\s+", "", a), m["env"], m["owner"], m["singleton"]))] for a in args if not a.startswith(("*", "&"))]
            self.add("call", n, **{"class": owner}, name="initialize" if c[1] and name == "new" else name, singleton=name != "new" if c[1] else m["singleton"], type=json.dumps(given))

    def class_body(self, code: str, text: str, n: int) -> None:
        frame = next((f for f in reversed(self.stack) if f["kind"] in ("class", "module", "sclass")), None)
        if code in ("private", "public", "protected"):
            if frame:
                frame["visibility"] = code
            return
        owner = self.scope()
        m = re.match(r"([A-Z]\w*)\s*=\s*(.+)$", text)
        if m:
            made = re.match(r"(Struct\.new|Data\.define)\((.*)\)", m[2])
            full = m[1] if owner == "Object" else f"{owner}::{m[1]}"
            if made:
                names, options = literals(made[2])
                self.add("class", n, **{"class": full}, name="Struct" if made[1] == "Struct.new" else "Data", kind="class")
                self.add("macro", n, **{"class": full}, name=made[1], names=names, options=options)
                return
            alias = re.fullmatch(CONSTANT, m[2])
            self.add("constant", n, **{"class": owner}, name=m[1], kind="class" if alias else None, type=T.dumps(("singleton", m[2].removeprefix("::")) if alias else T.widen(expression(m[2], {}, owner))))
            return
        m = re.match(r"alias\s+:?(\S+)\s+:?(\S+)$", text)
        if m:
            self.add("macro", n, **{"class": owner}, name="alias_method", names=[m[1], m[2]], options={})
            return
        m = MACRO.match(text) or re.match(r"^([a-z_]\w*)()$", text)
        if m and not re.match(r"[a-z_]\w*\s*[+\-|&*/]*=", text):
            self.macro(m, n)

    def macro(self, m: re.Match, n: int) -> None:
        names, options = literals(m[2])
        outer = ".".join(f["call"] for f in self.stack[:-1] if f["kind"] == "block" and f.get("call"))
        if self.stack and self.stack[-1]["kind"] == "block" and self.stack[-1].get("call") != m[1]:
            outer = ".".join(x for x in (outer, self.stack[-1].get("call")) if x)
        single = any(f["kind"] == "sclass" for f in self.stack)
        self.add("macro", n, **{"class": self.scope()}, name=f"{outer}.{m[1]}" if outer else m[1], names=names, options=options, singleton=single)


def read(text: str | None) -> list[dict]:
    return Reader(text or "").read()


def facts(texts: DataFrame) -> DataFrame:
    """FACTS of Ruby files (file, content), each file in one go."""
    names = [c.strip().split(" ", 1)[0] for c in re.split(r",\s(?=\w+ \w)", FACTS)]

    def each(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [{**dict.fromkeys(names), **r, "file": f} for f, content in zip(batch["file"], batch["content"]) for r in read(content)]
            frame = pd.DataFrame(rows, columns=names)
            yield frame.astype({"ord": "int32", "line": "int32", "singleton": "boolean"})

    return texts.select("file", "content").mapInPandas(each, FACTS)


def tables(rows: DataFrame) -> dict[str, DataFrame]:
    """The fact tables: classes, mixins, methods, params, constants, ivars, calls (macros), sites and args."""
    classes = rows.filter("row = 'class'").select("file", "class", F.col("name").alias("superclass"), (F.col("kind") == "module").alias("is_module"), "line", "ord")
    macros = rows.filter("row = 'macro'").select("file", "line", "ord", "class", F.col("name").alias("method"), "names", "options", F.coalesce("singleton", F.lit(False)).alias("singleton"))
    mixed = macros.filter(F.col("method").isin(*MIXINS))
    mixins = mixed.select("file", "class", F.when(F.col("singleton"), "extend").otherwise(F.col("method")).alias("kind"), "ord", F.posexplode(F.reverse("names")).alias("i", "module"))
    methods = rows.filter("row = 'method'").select("file", "line", "ord", "class", "name", "singleton", "visibility", F.col("type").alias("ret"), "params")
    params = methods.select("class", "name", "singleton", F.explode("params").alias("p")).select("class", "name", "singleton", "p.*")
    sites = rows.filter("row = 'call'").withColumn("site_id", F.concat_ws(":", "file", F.col("ord").cast("string")))
    given = sites.select("site_id", F.posexplode(F.from_json("type", "array<array<string>>")).alias("pos", "a"))
    return {
        "classes": classes, "macros": macros, "mixins": mixins.select("file", "class", "module", "kind", (F.col("ord") * 1000 + F.col("i")).alias("ord")),
        "methods": methods, "params": params, "constants": rows.filter("row = 'constant'").select("file", "line", "ord", F.col("class").alias("owner"), "name", "type", F.col("kind").alias("alias_kind")),
        "ivars": rows.filter("row = 'ivar'").select("file", "class", F.col("name").alias("ivar"), F.col("kind").alias("name"), "type", "singleton"),
        "sites": sites.select("site_id", "class", F.col("name").alias("method"), "singleton", F.lit(None).cast("int").alias("open_splat")),
        "args": given.select("site_id", "pos", F.col("a")[0].alias("keyword"), F.col("a")[1].alias("type")),
    }


def route_calls(text: str) -> list[dict]:
    """The nested calls of a routes file."""
    root: list[dict] = []
    stack = [root]
    for raw in text.split("\n"):
        code, line = blank(raw), uncommented(raw)
        if re.match(r"end\b", code):
            if len(stack) > 1:
                stack.pop()
            continue
        m = MACRO.match(line) or re.match(r"^([a-z_]\w*)()$", line)
        call = None
        if m and not code.startswith(("if ", "unless ")):
            arrow = re.match(r"""["']([^"']+)["']\s*=>""", m[2])
            names, options = literals(m[2])
            options = {k: json.loads(v) if v.startswith("[") else {"true": True, "false": False, "nil": None}.get(v, v) for k, v in options.items()}
            call = {"method": m[1], "names": [arrow[1]] if arrow else names, "options": options, "calls": []}
            block = re.search(r"\|([^|]*)\|\s*$", line)
            call["arity"] = len([a for a in block[1].split(",") if a.strip()]) if block else 0
            stack[-1].append(call)
        if BLOCK.search(code) or OPENERS.search(code):
            stack.append(call["calls"] if call else stack[-1])
    return root


def case_equality_overrides(texts: DataFrame) -> DataFrame:
    """file, line of definitions of ===, which make narrowing by class unsafe."""
    lines_ = texts.select("file", F.posexplode(F.split("content", "\n")).alias("pos", "text"))
    return lines_.filter(F.col("text").rlike(r"^\s*(def\s+(self\.)?===|define_method\(?\s*:===|alias(_method)?\s*\(?\s*:?===)")).select("file", (F.col("pos") + 1).alias("line"))


def namespaces(rows: DataFrame) -> DataFrame:
    """file, class of nested classes and modules."""
    return rows.filter("row = 'class' AND class LIKE '%::%'").select("file", "class").distinct()


def literal_hash_methods(rows: DataFrame) -> DataFrame:
    """class, name, keys of methods that return a literal hash."""
    keys = F.transform(F.from_json(F.get_json_object("type", "$[1]"), "array<array<string>>"), lambda x: F.get_json_object(x[0], "$[1]"))
    return rows.filter("row = 'method' AND type LIKE '[\"record\"%'").select("class", "name", keys.alias("keys"))

"""Signature text: types, method types and declarations, by a small recursive-descent parser.

A parsed method type is {"type_params", "params": [{"name", "kind", "type"}], "block": None or a method type with "required", "ret"}; types are terms.
"""

from __future__ import annotations

import re

from glossa.functions import terms as T

TOKEN = re.compile(
    r"""\s+|\#[^\n]*|(?P<string>"(?:[^"\\]|\\.)*"|'[^']*')|(?P<symbol>:(?:[A-Za-z_]\w*[?!=]?|"(?:[^"\\]|\\.)*"|[+\-*/<>=!~\[\]]+))(?!:)
    |(?P<number>-?\d[\d_]*(?:\.\d+)?)|(?P<name>(?:::)?[A-Za-z_]\w*(?:::[A-Za-z_]\w*)*[?!]?|[@$]+\w+)|(?P<op>->|=>|\*\*|::|\.\.\.|<=>|===|==|=~|\[\]=?|<<|>>|<=|>=|[()\[\]{}|&?^,:.<=*!+\-/%~`])""",
    re.X,
)
CORE = {"Integer": T.INTEGER, "Float": T.FLOAT, "String": T.STRING, "Symbol": T.SYMBOL, "NilClass": T.NIL, "TrueClass": T.TRUE, "FalseClass": T.FALSE}
#: Builtin aliases without arguments. Fixed values.
ALIASES = {
    "int": T.INTEGER, "float": T.FLOAT, "string": T.STRING, "path": T.STRING, "real": T.union(T.INTEGER, T.FLOAT, T.cls("Rational")), "io": T.cls("IO"),
    "encoding": T.union(T.cls("Encoding"), T.STRING), "interned": T.union(T.SYMBOL, T.STRING), "boolish": ("top",), "array": T.array(), "hash": ("hash", None, None), "range": T.cls("Range"),
}
WORDS = {"bool": T.BOOL, "nil": T.NIL, "void": ("void",), "untyped": T.UNTYPED, "top": ("top",), "bot": T.BOT, "self": ("self",), "instance": ("self",), "class": T.cls("Class"), "true": T.TRUE, "false": T.FALSE}


class SignatureError(ValueError):
    pass


def tokens(text: str) -> list[tuple[str, str]]:
    out, at = [], 0
    while at < len(text):
        m = TOKEN.match(text, at)
        if not m:
            raise SignatureError(f"unexpected {text[at : at + 10]!r}")
        if m.lastgroup:
            out.append((m.lastgroup, m[0]))
        at = m.end()
    return out


class Parser:
    def __init__(self, text: str, variables: set[str] = frozenset(), aliases: dict | None = None):
        self.tokens, self.at, self.variables, self.aliases = tokens(text), 0, set(variables), aliases or {}

    def peek(self, ahead: int = 0) -> str | None:
        return self.tokens[self.at + ahead][1] if self.at + ahead < len(self.tokens) else None

    def next(self) -> str:
        if self.at >= len(self.tokens):
            raise SignatureError("unexpected end")
        self.at += 1
        return self.tokens[self.at - 1][1]

    def take(self, text: str) -> bool:
        if self.peek() == text:
            self.at += 1
            return True
        return False

    def need(self, text: str) -> None:
        if not self.take(text):
            raise SignatureError(f"expected {text!r}, got {self.peek()!r}")

    # types

    def type(self):
        parts = [self.intersection()]
        while self.take("|"):
            parts.append(self.intersection())
        return parts[0] if len(parts) == 1 else T.union_of(parts)

    def intersection(self):
        parts = [self.suffixed()]
        while self.take("&"):
            parts.append(self.suffixed())
        return parts[0] if len(parts) == 1 else ("intersection", tuple(parts))

    def suffixed(self):
        t = self.simple()
        while self.take("?"):
            t = T.UNTYPED if t == T.UNTYPED else T.union_with(t, T.NIL)
        return t

    def list(self, end: str) -> list:
        out = []
        while not self.take(end):
            out.append(self.type())
            if not self.take(","):
                self.need(end)
                break
        return out

    def simple(self):
        if self.at >= len(self.tokens):
            raise SignatureError("a type is missing")
        kind, text = self.tokens[self.at]
        if text == "(":
            self.at += 1
            t = self.type()
            self.need(")")
            return t
        if text in ("[", "[]"):
            self.at += 1
            return ("tuple", tuple(self.list("]")) if text == "[" else ())
        if text == "{":
            return self.record()
        if text == "^":
            self.at += 1
            m = self.method_type()
            exact = all(p["kind"] == "required" for p in m["params"])
            return ("proc", "proc", tuple(p["type"] for p in m["params"]) if exact else (T.UNTYPED,) * bool(m["params"]), m["ret"], exact)
        self.at += 1
        if kind == "string":
            return ("lit_str", text[1:-1])
        if kind == "symbol":
            return ("lit_sym", text[1:].strip('"'))
        if kind == "number":
            return ("lit_float", text) if "." in text else ("lit_int", int(text.replace("_", "")))
        if kind != "name":
            raise SignatureError(f"unexpected {text!r}")
        if text.endswith("?"):  # X? is lexed as one name
            self.at -= 1
            self.tokens[self.at : self.at + 1] = [("name", text[:-1]), ("op", "?")]
            return self.simple()
        return self.named(text)

    def record(self):
        self.need("{")
        fields = []
        while not self.take("}"):
            optional = self.take("?")
            kind, text = self.tokens[self.at]
            self.at += 1
            if kind == "string" or kind == "symbol":
                key = ("str", text[1:-1]) if kind == "string" else ("sym", text[1:])
                self.need("=>")
            else:
                key = ("sym", text)
                if text.endswith("?"):
                    key = ("sym", text)
                self.need(":")
            fields.append((key, self.type(), optional))
            if not self.take(","):
                self.need("}")
                break
        return ("record", tuple(fields))

    def named(self, name: str):
        if name == "singleton" and self.take("("):
            inner = self.next()
            self.need(")")
            return ("singleton", inner.removeprefix("::"))
        args = []
        if self.peek() == "[":
            self.at += 1
            args = self.list("]")
        bare = name.removeprefix("::")
        if not args and name in self.variables:
            return T.UNTYPED
        if not args and name in WORDS:
            return WORDS[name]
        if bare in self.aliases:
            return self.aliases[bare]
        if bare in CORE and not args:
            return CORE[bare]
        if bare == "Array" and len(args) < 2:
            return T.array(args[0] if args else None)
        if bare == "Hash" and len(args) in (0, 2):
            return ("hash", *(args or (None, None)))
        if bare[:1].islower():
            if bare == "array" and len(args) == 1:
                return T.array(args[0])
            if bare == "hash" and len(args) == 2:
                return ("hash", *args)
            if bare == "range" and len(args) == 1:
                return ("generic", "Range", tuple(args))
            if bare in ALIASES and not args:
                return ALIASES[bare]
        return ("generic", bare, tuple(args)) if args else T.cls(bare)

    # method types

    def type_params(self) -> list[str]:
        out = []
        if self.take("["):
            while not self.take("]"):
                while self.peek() in ("unchecked", "in", "out"):
                    self.at += 1
                out.append(self.next())
                if self.take("<"):
                    self.type()
                if self.take("="):
                    self.type()
                self.take(",")
        return out

    def param(self, positional_kind: str) -> dict:
        if self.take("**"):
            kind = "double_rest"
        elif self.take("*"):
            kind = "rest"
        else:
            optional = self.take("?")
            if self.at + 1 < len(self.tokens) and self.tokens[self.at][0] == "name" and self.peek(1) == ":":
                name = self.next()
                self.need(":")
                t, named = self.type(), self.tokens[self.at][1] if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else None
                if named:
                    self.at += 1
                return {"name": name, "kind": "keyword_optional" if optional else "keyword_required", "type": t}
            kind = "optional" if optional else positional_kind
        t = self.type()
        name = self.next() if self.at < len(self.tokens) and self.tokens[self.at][0] == "name" else ""
        return {"name": name, "kind": kind, "type": t}

    def method_type(self) -> dict:
        names = self.type_params()
        saved, self.variables = self.variables, self.variables | set(names)
        params: list[dict] = []
        if self.take("("):
            if self.take("?"):
                params.append({"name": "", "kind": "rest", "type": T.UNTYPED})
                self.need(")")
            else:
                while not self.take(")"):
                    params.append(self.param("required"))
                    if not self.take(","):
                        self.need(")")
                        break
        block = None
        optional = self.peek() == "?" and self.peek(1) == "{"
        if optional:
            self.at += 1
        if self.take("{"):
            block = {**self.method_type(), "required": not optional}
            self.need("}")
        self.need("->")
        ret = self.suffixed_return()
        self.variables = saved
        return {"type_params": names, "params": params, "block": block, "ret": ret}

    def suffixed_return(self):
        return self.intersection()

    def overloads(self) -> list[dict]:
        out = []
        while True:
            if self.take("..."):
                break
            out.append(self.method_type())
            if not self.take("|"):
                break
        return out


def parse_type(text: str, aliases: dict | None = None):
    """The term of a type."""
    p = Parser(text, aliases=aliases)
    t = p.type()
    if p.at < len(p.tokens):
        raise SignatureError(f"unexpected {p.peek()!r}")
    return t


def parse_method_type(text: str, aliases: dict | None = None) -> list[dict]:
    """The overloads of a method type."""
    p = Parser(text, aliases=aliases)
    out = p.overloads()
    if p.at < len(p.tokens):
        raise SignatureError(f"unexpected {p.peek()!r}")
    return out


MEMBER_NAME = {"+", "-", "*", "/", "%", "**", "<", "<=", ">", ">=", "==", "===", "=~", "!", "!=", "<=>", "<<", ">>", "[]", "[]=", "~", "^", "&", "|", "`"}


class Declarations(Parser):
    """Classes, modules, interfaces, constants, globals and aliases of a signature file as flat rows."""

    def __init__(self, text: str, aliases: dict | None = None):
        super().__init__(text, aliases=aliases)
        self.rows: list[dict] = []
        self.ord = 0

    def add(self, **row) -> None:
        self.rows.append(row | {"ord": self.ord})
        self.ord += 1

    def parse(self) -> list[dict]:
        while self.at < len(self.tokens):
            self.declaration("")
        return self.rows

    def declaration(self, scope: str) -> None:
        word = self.next()
        if word in ("class", "module", "interface"):
            name = self.next().removeprefix("::")
            full = f"{scope}::{name}" if scope else name
            if self.take("="):
                self.add(row="constant", owner=scope or "Object", name=name, type=("singleton", self.next().removeprefix("::")), kind=word)
                return
            variables = self.type_params()
            above, self.variables = self.variables, self.variables | set(variables)
            superclass = None
            if word == "class" and self.take("<"):
                superclass = self.type()
            elif word == "module" and self.take(":"):
                self.type()
                while self.take(","):
                    self.type()
            self.add(row="class", owner=full, name=full, type=superclass, kind=word, type_params=variables)
            while not self.take("end"):
                self.member(full)
            self.variables = above
        elif word == "type":
            name = self.next()
            names = self.type_params()
            above, self.variables = self.variables, self.variables | set(names)
            self.need("=")
            self.add(row="alias", owner=scope, name=f"{scope}::{name}" if scope else name, type=self.type(), kind="type")
            self.variables = above
        elif word.startswith("$"):
            self.need(":")
            self.add(row="global", owner="", name=word, type=self.type(), kind="global")
        else:
            self.need(":")
            self.add(row="constant", owner=scope or "Object", name=word.removeprefix("::"), type=self.type(), kind="constant")

    def method_name(self) -> tuple[str, bool]:
        singleton = False
        if self.peek() in ("self", "self?") and self.peek(1) == ".":
            singleton, self.at = True, self.at + 2
        name = self.next()
        if self.peek() == "=" and self.peek(1) == ":" or name in ("[", "!", "=") and self.peek() in ("]", "=", "~"):
            name += self.next()
        return name, singleton

    def member(self, owner: str) -> None:
        word, private = self.next(), False
        if word in ("private", "public"):
            if self.peek() not in ("def", "attr_reader", "attr_writer", "attr_accessor"):
                return
            private, word = word == "private", self.next()
        if word == "def":
            name, singleton = self.method_name()
            self.need(":")
            self.add(row="method", owner=owner, name=name, singleton=singleton, kind="private" if private else "public", overloads=self.overloads())
        elif word in ("include", "extend", "prepend"):
            target = self.type()
            self.add(row="mixin", owner=owner, name=target[1] if len(target) > 1 else T.render(target), kind=word)
        elif word in ("attr_reader", "attr_writer", "attr_accessor"):
            name, singleton = self.method_name()
            if self.take("("):
                while not self.take(")"):
                    self.at += 1
            self.need(":")
            t = self.type()
            if word != "attr_writer":
                self.add(row="method", owner=owner, name=name, singleton=singleton, kind="public", overloads=[{"type_params": [], "params": [], "block": None, "ret": t}])
            if word != "attr_reader":
                self.add(row="method", owner=owner, name=f"{name}=", singleton=singleton, kind="public", overloads=[{"type_params": [], "params": [{"name": name, "kind": "required", "type": t}], "block": None, "ret": t}])
        elif word == "alias":
            new, singleton = self.method_name()
            old, _ = self.method_name()
            self.add(row="method_alias", owner=owner, name=new, singleton=singleton, kind=old)
        elif word.startswith("@"):
            self.need(":")
            self.add(row="ivar", owner=owner, name=word, type=self.type(), kind="ivar")
        elif word in ("class", "module", "interface", "type") or self.peek() == ":":
            self.at -= 1
            self.declaration(owner)
        else:
            raise SignatureError(f"unexpected {word!r} in {owner}")


def parse_declarations(text: str, aliases: dict | None = None) -> list[dict]:
    return Declarations(text, aliases).parse()


# rendering


def render_param(p: dict, widen: bool = False) -> str:
    t = T.render(T.widen(p["type"]) if widen else p["type"])
    name = p.get("name") or ""
    kind = p["kind"]
    if kind.startswith("keyword"):
        return ("?" if kind == "keyword_optional" else "") + f"{name}: {t}"
    mark = {"optional": "?", "rest": "*", "double_rest": "**"}.get(kind, "")
    return f"{mark}{t} {name}".rstrip()


def render_method_type(m: dict, widen: bool = False) -> str:
    out = f"[{', '.join(m['type_params'])}] " if m.get("type_params") else ""
    params = [p for p in m["params"] if p["kind"] != "block"]
    out += f"({', '.join(render_param(p, widen) for p in params)}) " if params else ""
    block = m.get("block")
    if block:
        out += ("" if block.get("required", True) else "?") + "{ " + render_method_type(block) + " } "
    elif len(params) < len(m["params"]):
        out += "?{ (?) -> untyped } "
    ret = T.render(m["ret"], nested=True)
    return f"{out if params or block or out else '() '}-> {ret}"


def render_method(name: str, overloads: list[dict], singleton: bool = False, private: bool = False) -> str:
    """A method's declaration; further overloads stand below, aligned."""
    head = f"{'private ' if private else ''}def {'self.' if singleton else ''}{name}"
    first, *more = [render_method_type(m) for m in overloads]
    return "\n".join([f"{head}: {first}", *(f"{' ' * len(head)}| {m}" for m in more)])


# runtime-checked signatures


def _split(text: str, by: str = ",") -> list[str]:
    out, depth, now = [], 0, ""
    for c in text:
        depth += (c in "([{") - (c in ")]}")
        if c == by and not depth:
            out.append(now.strip())
            now = ""
        else:
            now += c
    return [*out, now.strip()] if now.strip() else out


#: Names of the runtime checker's types. Fixed values.
CHECKED = {"T.untyped": "untyped", "T.noreturn": "bot", "T.self_type": "self", "T.attached_class": "instance", "T.anything": "top", "T::Boolean": "bool", "T::Class": "Class", "T::Module": "Module"}


def checked_type(text: str) -> str:
    """A runtime checker's type (T.nilable(String), T::Array[Integer]) as signature text."""
    s = text.strip()
    if not s:
        return "untyped"
    if s in CHECKED:
        return CHECKED[s]
    call = re.fullmatch(r"(T\.[a-z_!]+)\((.*)\)", s, re.S)
    if call:
        name, inner = call[1], call[2]
        if name == "T.nilable":
            t = checked_type(inner)
            return f"({t})?" if re.search(r"[|&]", t) or t.startswith("^") else f"{t}?"
        if name in ("T.any", "T.all"):
            return (" | " if name == "T.any" else " & ").join(map(checked_type, _split(inner)))
        if name == "T.class_of":
            return f"singleton({checked_type(inner)})"
        if name == "T.type_parameter":
            return inner.strip().removeprefix(":")
        if name in ("T.let", "T.cast", "T.assert_type!"):
            parts = _split(inner)
            return checked_type(parts[1]) if len(parts) > 1 else "untyped"
        if name == "T.must":
            return checked_type(inner)
    if s.startswith("T.proc"):
        chain = dict(re.findall(r"\.(params|returns|bind)\(((?:[^()]|\([^()]*\))*)\)", s))
        params = ", ".join(checked_type(p.split(":", 1)[1]) for p in _split(chain.get("params", "")) if ":" in p)
        back = "void" if s.endswith(".void") else checked_type(chain.get("returns", ""))
        return f"^({params}) -> {back}"
    if s.startswith("T."):
        return "untyped"
    if s.startswith("[") and s.endswith("]"):
        return f"[{', '.join(map(checked_type, _split(s[1:-1])))}]"
    generic = re.fullmatch(r"([\w:]+)\[(.*)\]", s, re.S)
    if generic:
        if generic[1] == "T::Class":
            return f"singleton({generic[2].strip().removeprefix('::')})" if re.fullmatch(r"(::)?[A-Z][\w:]*", generic[2].strip()) else "Class"
        if generic[1] == "T::Module":
            return "Module"
        return f"{generic[1].removeprefix('T::')}[{', '.join(map(checked_type, _split(generic[2])))}]"
    return s.removeprefix("T::")


def checked_signature(text: str, block_index: int | None = None) -> str | None:
    """sig { params(a: Integer).returns(String) } as a method type; the parameter at block_index is the block."""
    body = re.search(r"sig\s*(?:\([^)]*\)\s*)?(?:\{(.*)\}|do(.*)end)\s*$", text.strip(), re.S)
    if not body:
        return None
    body = (body[1] or body[2] or "").strip()
    chain, at = [], 0
    for m in re.finditer(r"([a-z_]+)", body):
        if m.start() < at:
            continue
        name, args, at = m[1], "", m.end()
        if body[at : at + 1] == "(":
            depth = 0
            for k in range(at, len(body)):
                depth += (body[k] in "([{") - (body[k] in ")]}")
                if not depth:
                    args, at = body[at + 1 : k], k + 1
                    break
        chain.append((name, args))
    found = dict(chain)
    if not found:
        return None
    params, block = [], ""
    for k, p in enumerate(_split(found.get("params", ""))):
        name, _, t = p.partition(":")
        t = checked_type(t)
        if k == block_index:
            optional = t.startswith("(^") and t.endswith(")?")
            inner = (t[1:-2] if optional else t).removeprefix("^")
            block = ("?" if optional else "") + "{ " + inner + " } " if "->" in inner else ""
        else:
            params.append(f"{t} {name.strip()}")
    ret = checked_type(found["returns"]) if "returns" in found else "void"
    ret = f"({ret})" if re.search(r"[|&]", ret) and not ret.startswith(("(", "[")) and "[" not in ret.split("|")[0] else ret
    names = [x.strip().removeprefix(":") for x in _split(found.get("type_parameters", ""))]
    head = f"[{', '.join(names)}] " if names else ""
    return head + (f"({', '.join(params)}) " if params or "params" in found and not block else "") + block + f"-> {ret}"

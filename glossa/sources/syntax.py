"""Ruby sources as tables of syntax nodes, one row a node.

A file's tree is numbered in pre-order; `last` is the greatest number below a node, so that b stands inside a exactly if a.node < b.node <= a.last,
and questions about ancestors and siblings are joins of intervals. The reader is a small operator-precedence parser for what bodies are made of; what it can't
read becomes a node of kind error up to the end of the line, and the rest of the file is read on.
"""

from __future__ import annotations

import functools
import re
import sys
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

from glossa.functions import terms

#: up: the parent's kind; final: whether a node is the last of its slot; arm, loop and scope: the nearest nodes around that may not run, run again, or hold locals;
#: arms: of a local's read or write all arms around it in its scope, with the nodes they belong to; loops: all loops; term: what a literal is;
#: top: of a node that something a method gives may depend on, the node that its value goes up to: what a local is given, what a call or the like is made of, a method's body, itself if none.
COLUMNS = {
    "file": pa.string(), "node": pa.int64(), "last": pa.int64(), "parent": pa.int64(), "kind": pa.string(), "name": pa.string(), "slot": pa.string(), "ord": pa.int32(), "line": pa.int32(), "arm": pa.int64(), "arm_last": pa.int64(), "scope": pa.int64(),
    "up": pa.string(), "final": pa.bool_(), "arms": pa.list_(pa.struct([("arm", pa.int64()), ("above", pa.int64())])), "loops": pa.list_(pa.int64()), "term": pa.string(), "top": pa.int64(),
}
NODES = "file string, node long, last long, parent long, kind string, name string, slot string, ord int, line int, arm long, arm_last long, scope long, up string, final boolean, arms array<struct<arm:long,above:long>>, loops array<long>, term string, top long"
#: Words of the language. Fixed values.
KEYWORDS = set("alias and begin break case class def defined? do else elsif end ensure false for if in module next nil not or redo rescue retry return self super then true undef unless until when while yield".split())
#: How tightly binary operators bind. Fixed values.
BINDING = {op: 60 - 2 * k for k, ops in enumerate(["**", "* / %", "+ -", "<< >>", "&", "| ^", "> >= < <=", "<=> == === != =~ !~", "&&", "||", ".. ...", "?", "rescue"]) for op in ops.split()}
ASSIGNING = {"=", "+=", "-=", "*=", "/=", "%=", "**=", "||=", "&&=", "|=", "&=", "^=", "<<=", ">>="}
TOKEN = re.compile(
    r"(?P<space>(?:[ \t\r]|\\\n)+)|(?P<comment>\#[^\n]*)|(?P<nl>\n|;)|(?P<rational>\d[\d_]*(?:\.\d+)?(?:ri?|i)(?!\w))|(?P<float>\d[\d_]*\.\d[\d_]*(?:e[+-]?\d+)?)|(?P<int>0[xXbBoO][\da-fA-F_]+|\d[\d_]*)|(?P<ivar>@@?[A-Za-z_]\w*)|(?P<gvar>\$(?:\w+|[^\s\w]))"
    r"|(?P<id>[^\W\dA-Z]\w*[?!]?(?!=(?!=|~|>))|[^\W\dA-Z]\w*)|(?P<const>[A-Z]\w*[?!]?)|(?P<op>\*\*=|<=>|===|\.\.\.|<<=|>>=|&&=|\|\|=|&\.|\*\*|==|!=|>=|<=|=~|!~|&&|\|\||<<|>>|\+=|-=|\*=|/=|%=|\|=|&=|\^=|=>|->|::|\.\.|[-+*/%&|^~!<>=?:.,()\[\]{}])"
)
CLOSING = {"(": ")", "[": "]", "{": "}", "<": ">"}
#: Slots whose nodes may not run, and kinds that run their body again. Fixed values.
CONDITIONAL = {"then", "else", "rescue", "right", "body_of_when", "body_of_loop", "body_of_block"}
LEAVING = {"raise", "fail", "throw", "exit", "abort"}
SCOPES = {"program", "class", "module", "sclass", "def"}


#: Tokens of lines that were read, how many lines are kept and of how many characters at most.
LINES: dict[str, list[tuple]] = {}
MANY, LONGEST = 1 << 15, 200
#: What a quoted literal may begin with. Fixed values.
QUOTING = frozenset("\"'`:/%<?")


class Node:
    __slots__ = ("kind", "name", "line", "parts")

    def __init__(self, kind: str, line: int, name: str | None = None, **parts):
        self.kind, self.name, self.line = kind, name, line
        self.parts = [(slot, x) for slot, xs in parts.items() for x in (xs if isinstance(xs, list) else [xs]) if x is not None]


class Token:
    __slots__ = ("kind", "text", "line", "space", "parts")

    def __init__(self, kind, text, line, space, parts=None):
        self.kind, self.text, self.line, self.space, self.parts = kind, text, line, space, parts


class Reader:
    """Tokens of a text. Strings are tokens with their parts: texts and the trees of what is interpolated."""

    def __init__(self, text: str, line: int = 1):
        self.text, self.at, self.line, self.tokens, self.heredocs = text, 0, line, [], []

    def read(self) -> list[Token]:
        """The tokens. What a line holds by itself depends on its text only, so lines that come again are not read again."""
        text, n = self.text, len(self.text)
        while self.at < n:
            end = text.find("\n", self.at, self.at + LONGEST) + 1
            line = text[self.at : end] if end else ""
            if line and (known := LINES.get(line)) is not None:
                number = self.line
                self.tokens += [Token(kind, word, number, space, parts) for kind, word, space, parts in known]
                self.line, self.at = number + 1, end
                continue
            begun, number = len(self.tokens), self.line
            if not self.one_line():
                break
            found = self.tokens[begun:]
            if line and self.at == end and self.line == number + 1 and found and found[-1].kind == "nl" and all(t.text != "<<" and all(isinstance(p, str) for p in t.parts or ()) for t in found):
                if len(LINES) >= MANY:
                    LINES.clear()
                LINES[line] = [(t.kind, t.text, t.space, t.parts) for t in found]
        self.add("nl", "\n", False)
        self.add("eof", "", False)
        return self.tokens

    def one_line(self) -> bool:
        """Reads up to the end of a line, or of the last of several that one token holds together; false where the text is over."""
        space, n = False, len(self.text)
        while self.at < n:
            if self.text.startswith("__END__", self.at) and (self.at == 0 or self.text[self.at - 1] == "\n"):
                return False
            if self.text.startswith("=begin", self.at) and (self.at == 0 or self.text[self.at - 1] == "\n"):
                end = self.text.find("\n=end", self.at)
                skipped = self.text[self.at : n if end < 0 else end + 5]
                self.line, self.at = self.line + skipped.count("\n"), self.at + len(skipped)
                continue
            if self.text[self.at] in QUOTING and self.quoted(space):
                space = False
                continue
            m = TOKEN.match(self.text, self.at)
            if not m:
                self.at += 1
                continue
            kind, word = m.lastgroup, m.group()
            self.at = m.end()
            if kind in ("space", "comment"):
                self.line += word.count("\n")
                space = True
                continue
            if kind == "nl":
                self.add("nl", word, space)
                if word == "\n":
                    self.line += 1
                    self.bodies()
                    return True
            elif kind in ("id", "const") and self.text.startswith(":", self.at) and not self.text.startswith("::", self.at) and self.label():
                self.at += 1
                self.add("label", word, space)
            elif kind == "id" and word in KEYWORDS and not (self.tokens and self.tokens[-1].text in (".", "&.", "def")):
                self.add("kw", word, space)
            else:
                self.add(kind, word, space)
            space = False
        return True

    def label(self) -> bool:
        """Whether a colon after a word makes a label: not in the middle of a choice."""
        depth = 0
        for t in reversed(self.tokens):
            if t.kind == "nl" or t.text in (",", "(", "{", "|") and not depth:
                return True
            depth += {")": 1, "]": 1, "}": 1, "(": -1, "[": -1, "{": -1}.get(t.text, 0) if t.kind == "op" else 0
            if t.kind == "op" and t.text == "?" and not depth:
                return False
        return True

    def add(self, kind, text, space, parts=None):
        self.tokens.append(Token(kind, text, self.line, space, parts))

    def value_before(self) -> bool:
        """Whether the last token ends a value, so that an operator follows."""
        t = self.tokens[-1] if self.tokens else None
        return bool(t) and (t.kind in ("id", "const", "ivar", "gvar", "int", "float", "rational", "str", "sym", "words", "regex") or t.text in (")", "]", "}") or t.kind == "kw" and t.text in ("end", "self", "nil", "true", "false"))

    def quoted(self, space: bool) -> bool:
        """Reads a quoted literal here, if there is one."""
        text, at, value = self.text, self.at, self.value_before()
        free = not value or space and self.tokens[-1].kind == "id" and not text[at + 1 : at + 2].isspace()
        c = text[at]
        if c in "\"'`":
            self.at += 1
            parts = self.upto(c, None, c != "'")
            if c != "`" and text.startswith(":", self.at) and not text.startswith("::", self.at) and self.label():
                self.at += 1
                self.add("label", "".join(p for p in parts if isinstance(p, str)), space)
            else:
                self.add("str", c, space, parts)
            return True
        if c == ":" and at + 1 < len(text) and (text[at + 1] == '"' or re.match(r":(?:[@$]|[^\W\d]\w*[?!=]?|\[\]=?|[-+*/%<>=!~&|^]+)", text[at:])) and not text.startswith("::", at) and (not value or space):
            if text[at + 1] == '"':
                self.at += 2
                self.add("sym", "", space, self.upto('"', None, True))
                return True
            m = re.match(r":((?:@{0,2}\$?[^\W\d]\w*(?:[?!]|=(?![=~>]))?)|\[\]=?|\*\*|<=>|===?|=~|![=~]?|<<|>>|<=|>=|[-+*/%<>~&|^])", text[at:])
            if m:
                self.at += m.end()
                self.add("sym", m.group(1), space, [m.group(1)])
                return True
        if c == "/" and free:
            self.at += 1
            self.add("regex", "/", space, self.upto("/", None, True))
            self.at += len(re.match(r"[imxounse]*", text[self.at :]).group())
            return True
        m = re.match(r"%([wWiIqQrsx]?)([(\[{<|!/])", text[at : at + 3]) if c == "%" and free else None
        if m:
            self.at += m.end()
            how, open_ = m.groups()
            parts = self.upto(CLOSING.get(open_, open_), open_ if open_ in CLOSING else None, how not in "wiqs" or not how)
            words = "".join(p for p in parts if isinstance(p, str)).split()
            self.add("words", how, space, words) if how in ("w", "W", "i", "I") else self.add("regex" if how == "r" else "sym" if how == "s" else "str", how, space, parts)
            return True
        m = re.match(r"<<([~-]?)(['\"]?)([A-Za-z_]\w*)\2", text[at:]) if c == "<" and (free or not value) else None
        if m and (m.group(1) or m.group(3)[0].isupper()):
            self.at += m.end()
            token = Token("str", "<<", self.line, space, [])
            self.tokens.append(token)
            self.heredocs.append((token, m.group(3), m.group(2) != "'"))
            return True
        m = re.match(r"\?\\.|\?[^\s\w](?=\W|$)|\?\w(?!\w)", text[at:]) if c == "?" and not value else None
        if m:
            self.at += m.end()
            self.add("str", "?", space, [m.group()[1:]])
            return True
        return False

    def bodies(self) -> None:
        """The bodies of here-documents that were opened on the line before."""
        for token, word, raw in self.heredocs:
            m = re.compile(rf"^[ \t]*{word}[ \t]*$", re.M).search(self.text, self.at)
            end = m.start() if m else len(self.text)
            inner = Reader(self.text[self.at : end] + "\0", self.line)
            token.parts = inner.upto("\0", None, raw)
            self.line += self.text[self.at : m.end() if m else end].count("\n") + bool(m)
            self.at = min(len(self.text), m.end() + 1) if m else end
        self.heredocs = []

    def upto(self, close: str, open_: str | None, escapes: bool) -> list:
        """The parts of a quoted text up to its end: texts, and tokens of what is interpolated."""
        out, depth, text = [""], 0, self.text
        while self.at < len(text):
            c = text[self.at]
            if c == "\\" and self.at + 1 < len(text):
                out[-1] += text[self.at + 1]
                self.line += text[self.at + 1] == "\n"
                self.at += 2
                continue
            if c == close and not depth:
                self.at += 1
                break
            depth += (c == open_) - (c == close) if open_ else 0
            if escapes and text.startswith("#{", self.at):
                begin = self.at = self.at + 2
                level = 1
                while self.at < len(text) and level:
                    level += {"{": 1, "}": -1}.get(text[self.at], 0)
                    self.at += 1
                inner = text[begin : self.at - 1]
                out += [Reader(inner, self.line).read(), ""]
                self.line += inner.count("\n")
                continue
            self.line += c == "\n"
            out[-1] += c
            self.at += 1
        return [p for p in out if p != ""]


class Parser:
    def __init__(self, tokens: list[Token], names: set[str] | None = None):
        self.tokens, self.at, self.names = tokens, 0, names if names is not None else set()

    # tokens

    @property
    def now(self) -> Token:
        return self.tokens[self.at]

    def ahead(self, k: int = 1) -> Token:
        return self.tokens[min(self.at + k, len(self.tokens) - 1)]

    def take(self) -> Token:
        t = self.tokens[self.at]
        if self.at < len(self.tokens) - 1:
            self.at += 1
        return t

    def is_(self, *texts: str) -> bool:
        t = self.tokens[self.at]
        return t.text in texts and t.kind in ("op", "kw", "nl")

    def skip(self, *texts: str) -> bool:
        t = self.tokens[self.at]
        if t.text in texts and t.kind in ("op", "kw", "nl"):
            self.take()
            return True
        return False

    def lines(self) -> None:
        while self.tokens[self.at].kind == "nl":
            self.take()

    # statements

    def program(self) -> Node:
        node = Node("program", 1)
        while self.now.kind != "eof":
            node.parts += self.statements(()).parts
            if self.now.kind != "eof":
                node.parts.append(("item", self.broken()))
        return node

    def broken(self) -> Node:
        """What can't be read, up to the end of the line."""
        node = Node("error", self.now.line, self.now.text)
        self.take()
        while self.now.kind not in ("nl", "eof"):
            self.take()
        return node

    def statements(self, ends: tuple[str, ...]) -> Node:
        node = Node("statements", self.now.line)
        while True:
            self.lines()
            if self.now.kind == "eof" or self.is_(*ends) or self.now.kind == "op" and self.now.text in (")", "}", "]") or self.now.kind == "kw" and self.now.text in ("end", "else", "elsif", "when", "in", "rescue", "ensure"):
                return node
            before = self.at
            node.parts.append(("item", self.statement()))
            if self.at == before or self.now.kind not in ("nl", "eof") and not self.is_(*ends, ")", "}", "end", "else", "elsif", "when", "in", "rescue", "ensure"):
                node.parts.append(("item", self.broken()))

    def statement(self) -> Node:
        node = self.expression()
        while self.now.kind == "kw" and self.now.text in ("if", "unless", "while", "until", "rescue"):
            t = self.take()
            other = self.expression()
            if t.text in ("if", "unless"):
                node = Node("if", t.line, t.text, cond=other, **{"then" if t.text == "if" else "else": node})
            elif t.text == "rescue":
                node = Node("begin", t.line, body=node, rescue=Node("rescue_arm", t.line, body=other))
            else:
                node = Node("while", t.line, t.text, cond=other, body_of_loop=node)
        return node

    def expression(self) -> Node:
        """An expression with and, or and not."""
        if self.is_("not"):
            left = Node("not", self.take().line, value=self.expression())
        else:
            left = self.value()
        while self.is_("and", "or"):
            t = self.take()
            self.lines()
            left = Node(t.text, t.line, left=left, right=Node("not", t.line, value=self.value()) if self.skip("not") else self.value())
        return left

    def value(self) -> Node:
        """A value, or several that are assigned at once."""
        begin, first = self.at, self.binary(0)
        if self.is_("=>", "in") and not self.no_in:
            t = self.take()
            return Node("matches", t.line, t.text, subject=first, pattern=self.pattern())
        if self.is_(",") and (first.kind in ("lvar", "ivar", "gvar", "const", "splat", "call") and self.several(begin)):
            return self.masgn()
        return first

    def several(self, begin: int) -> bool:
        """Whether a list of targets and an assignment stand here."""
        k, depth = begin, 0
        while self.tokens[k].kind not in ("nl", "eof", "kw"):
            t = self.tokens[k]
            if t.kind == "op":
                depth += {"(": 1, "[": 1, "{": 1, ")": -1, "]": -1, "}": -1}.get(t.text, 0)
                if depth < 0:
                    return False
                if t.text == "=" and not depth:
                    self.at = begin
                    return True
            k += 1
        return False

    def masgn(self) -> Node:
        line, targets = self.now.line, []
        while not self.is_("="):
            splat = self.skip("*")
            t = self.take()
            if t.kind in ("id", "ivar", "gvar", "const"):
                if t.kind == "id":
                    self.names.add(t.text)
                targets.append(Node({"id": "assign", "ivar": "iassign"}.get(t.kind, "assign"), t.line, t.text, value=Node("part", t.line, "*" if splat else str(len(targets)))))
            if self.now.kind in ("nl", "eof"):
                break
        self.skip("=")
        values = [self.binary(0)]
        while self.skip(","):
            values.append(self.binary(0))
        return Node("masgn", line, target=targets, value=values[0] if len(values) == 1 else Node("array", line, item=values))

    def binary(self, least: int) -> Node:
        left = self.unary()
        while True:
            t = self.now
            if t.kind == "op" and t.text in ASSIGNING and self.assignable(left):
                left = self.assignment(left)
                continue
            if t.kind != "op" or t.text not in BINDING or BINDING[t.text] < max(least, 1):
                return left
            if t.text == "?":
                self.take()
                self.lines()
                then = self.binary(0)
                self.lines()
                if self.now.kind == "label":  # a ? b : c, read as a label
                    self.take()
                self.skip(":")
                self.lines()
                left = Node("if", t.line, "?", cond=left, then=then, **{"else": self.binary(BINDING["?"])})
                continue
            if t.text in ("..", "...") and self.ahead().kind in ("nl", "eof") or t.text in ("..", "...") and self.ahead().text in (")", "]", "then", ","):
                self.take()
                left = Node("range", t.line, t.text, left=left)
                continue
            self.take()
            self.lines()
            right = self.binary(BINDING[t.text] + (t.text != "**"))
            if t.text in ("&&", "||"):
                left = Node("and" if t.text == "&&" else "or", t.line, left=left, right=right)
            elif t.text in ("..", "..."):
                left = Node("range", t.line, t.text, left=left, upto=right)
            else:
                left = Node("call", t.line, t.text, receiver=left, arg=right)

    @staticmethod
    def assignable(left: Node) -> bool:
        return left.kind in ("lvar", "ivar", "gvar", "const", "colon", "index") or left.kind == "call" and all(s in ("receiver", "arg") for s, _ in left.parts)

    def assignment(self, left: Node) -> Node:
        op = self.take()
        self.lines()
        if left.kind == "call" and not left.parts or left.kind == "lvar":
            self.names.add(left.name)
        right = self.binary(BINDING["rescue"])
        if self.is_(",") and op.text == "=" and left.kind != "call" and self.ahead(-2).text != "(" and self.bare():
            rest = [right]
            while self.skip(","):
                rest.append(self.binary(BINDING["rescue"]))
            right = Node("array", op.line, item=rest)
        if self.is_("rescue"):
            t = self.take()
            right = Node("begin", t.line, body=right, rescue=Node("rescue_arm", t.line, body=self.binary(0)))
        if op.text != "=":
            own = Node(left.kind, left.line, left.name)
            own.parts = list(left.parts)
            right = Node({"||=": "or", "&&=": "and"}[op.text], op.line, left=own, right=right) if op.text in ("||=", "&&=") else Node("call", op.line, op.text[:-1], receiver=own, arg=right)
        if left.kind == "call" and left.parts or left.kind == "index":
            out = Node("call", op.line, (left.name or "[]") + "=")
            out.parts = [*left.parts, ("arg", right)]
            return out
        kind = {"ivar": "iassign", "gvar": "gassign", "const": "cassign", "colon": "cassign"}.get(left.kind, "assign")
        return Node(kind, op.line, left.name, value=right)

    def bare(self) -> bool:
        """Whether no bracket is open on this line before here: a list may follow an assignment."""
        depth = 0
        for t in reversed(self.tokens[: self.at]):
            if t.kind == "nl":
                break
            depth += {")": 1, "]": 1, "}": 1, "(": -1, "[": -1, "{": -1}.get(t.text, 0) if t.kind == "op" else 0
        return depth >= 0

    def unary(self) -> Node:
        t = self.now
        if t.kind == "op":
            if t.text in ("!", "-", "+", "~"):
                self.take()
                inner = self.binary(BINDING["**"] + 1) if t.text != "-" else self.binary(BINDING["**"])
                if t.text == "-" and inner.kind in ("int", "float"):
                    return Node(inner.kind, t.line, f"-{inner.name}")
                return Node("not", t.line, value=inner) if t.text == "!" else Node("call", t.line, f"{t.text}@", receiver=inner)
            if t.text in ("*", "**", "&"):
                self.take()
                kind = {"*": "splat", "**": "dsplat", "&": "blockarg"}[t.text]
                return Node(kind, t.line) if self.is_(")", ",", "|") else Node(kind, t.line, value=self.binary(BINDING["**"] if t.text != "&" else 0))
            if t.text in ("..", "..."):
                self.take()
                if self.is_(")", ","):
                    return Node("forward", t.line)
                return Node("range", t.line, t.text, upto=self.binary(BINDING[".."] + 1))
        if self.is_("defined?"):
            self.take()
            return Node("defined", t.line, value=self.unary())
        return self.postfix(self.primary())

    # calls

    def postfix(self, node: Node) -> Node:
        while True:
            t = self.now
            if t.kind == "nl" and t.text == "\n":
                k = 1
                while self.ahead(k).kind == "nl" and self.ahead(k).text == "\n":
                    k += 1
                if self.ahead(k).kind == "op" and self.ahead(k).text in (".", "&."):
                    self.at += k
                    continue
                return node
            if t.kind == "op" and t.text in (".", "&."):
                self.take()
                self.lines()
                m = self.take()
                if m.text == "(":
                    self.at -= 1
                    name = "call"
                elif m.text == "[" and self.is_("]"):
                    self.take()
                    name = "[]=" if self.skip("=") else "[]"
                else:
                    name = m.text
                call = Node("call", t.line, name, receiver=node)
                if t.text == "&.":
                    call.parts.append(("safe", Node("safe", t.line)))
                node = self.arguments(call, m)
            elif t.kind == "op" and t.text == "::":
                self.take()
                m = self.take()
                if m.kind == "const" and not (self.is_("(") and not self.now.space):
                    node = Node("colon", t.line, f"{node.name}::{m.text}" if node.kind in ("const", "colon") else m.text, scope=node)
                else:
                    node = self.arguments(Node("call", t.line, m.text, receiver=node), m)
            elif t.kind == "op" and t.text == "[" and (not t.space or node.kind == "lvar"):
                self.take()
                node = Node("call", t.line, "[]", receiver=node, arg=self.listed("]"))
            elif t.kind == "op" and t.text == "{" and node.kind in ("call", "super", "lambda") and not any(s == "block" for s, _ in node.parts):
                node.parts.append(("block", self.block("}")))
            elif t.kind == "kw" and t.text == "do" and node.kind in ("call", "super", "lambda") and not self.no_do and not any(s == "block" for s, _ in node.parts):
                node.parts.append(("block", self.block("end")))
            else:
                return node

    no_do = no_in = False

    def arguments(self, call: Node, at: Token) -> Node:
        """A call with what stands behind its name."""
        if self.is_("(") and not self.now.space:
            self.take()
            held, self.no_do = self.no_do, False
            call.parts += [("arg", x) for x in self.listed(")")]
            self.no_do = held
        elif self.command():
            call.parts += [("arg", x) for x in self.commands()]
        return call

    def command(self) -> bool:
        """Whether arguments without parentheses follow."""
        t, after = self.now, self.ahead()
        if not t.space or t.kind in ("nl", "eof"):
            return False
        if t.kind in ("id", "const", "ivar", "gvar", "int", "float", "str", "sym", "words", "label", "regex"):
            return True
        if t.kind == "kw":
            return t.text in ("nil", "true", "false", "self", "not", "defined?", "case", "yield", "super", "def", "begin")
        tight = not after.space and after.kind != "nl"
        return t.text in ("->", "!", "::") or t.text in ("[", "*", "&", "**", "-") and tight

    def commands(self) -> list[Node]:
        out = [self.argument()]
        while self.is_(","):
            self.take()
            self.lines()
            out.append(self.argument())
        return self.gathered(out)

    def listed(self, close: str) -> list[Node]:
        out = []
        self.lines()
        while not self.is_(close) and self.now.kind != "eof":
            before = self.at
            out.append(self.argument())
            self.lines()
            self.skip(",")
            self.lines()
            if self.at == before:
                out.append(self.broken())
        self.skip(close)
        return self.gathered(out)

    def argument(self) -> Node:
        t = self.now
        if t.kind == "label":
            self.take()
            key = Node("sym", t.line, t.text)
            if self.is_(",", ")", "}", "]") or self.now.kind == "nl":
                return Node("pair", t.line, t.text, key=key, value=Node("lvar" if t.text in self.names else "call", t.line, t.text))
            return Node("pair", t.line, t.text, key=key, value=self.expression_without_and())
        value = self.expression_without_and()
        if self.is_("=>"):
            self.take()
            self.lines()
            return Node("pair", t.line, value.name if value.kind in ("sym", "str") else None, key=value, value=self.expression_without_and())
        return value

    def expression_without_and(self) -> Node:
        if self.is_("if", "unless", "while", "until", "not"):
            return self.expression()
        return self.binary(0)

    @staticmethod
    def gathered(items: list[Node]) -> list[Node]:
        """Pairs among arguments are one hash."""
        pairs = [x for x in items if x.kind in ("pair", "dsplat")]
        rest = [x for x in items if x.kind not in ("pair", "dsplat")]
        if not pairs:
            return rest
        block = [x for x in rest if x.kind == "blockarg"]
        return [x for x in rest if x.kind != "blockarg"] + [Node("keywords", pairs[0].line, item=pairs)] + block

    def block(self, close: str) -> Node:
        line = self.take().line
        held, self.no_do, own = self.no_do, False, set(self.names)
        params = self.params("|") if self.skip("|") else []
        self.skip("||")
        body = self.body() if close == "end" else self.statements(("}",))
        self.skip(close)
        self.no_do, self.names = held, own
        return Node("block", line, param=params, body_of_block=body)

    def params(self, close: str) -> list[Node]:
        out = []
        self.lines()
        while not self.is_(close) and self.now.kind not in ("eof",) and not (close == "nl" and self.now.kind == "nl"):
            t = self.take()
            kind = "required"
            if t.kind == "op" and t.text in ("*", "**", "&", "..."):
                kind = {"*": "rest", "**": "double_rest", "&": "block", "...": "forward"}[t.text]
                name = self.take().text if self.now.kind == "id" and not self.now.space else t.text
                out.append(Node("param", t.line, name, style=Node(kind, t.line)))
                self.names.add(name)
            elif t.kind == "label":
                self.names.add(t.text)
                default = None if self.is_(",", close) or self.now.kind == "nl" else self.binary(BINDING["|"] + 1 if close == "|" else 0)
                out.append(Node("param", t.line, t.text, style=Node("keyword" if default is None else "keyword_optional", t.line), default=default))
            elif t.kind == "id":
                self.names.add(t.text)
                default = self.binary(BINDING["|"] + 1 if close == "|" else 0) if self.skip("=") else None
                out.append(Node("param", t.line, t.text, style=Node("required" if default is None else "optional", t.line), default=default))
            elif t.text == "(":
                out += [Node("param", t.line, x.name, style=Node("part", t.line)) for x in self.params(")")]
            self.skip(",", ";")
            if close != "nl":
                self.lines()
        self.skip(close)
        return out

    # primaries

    def primary(self) -> Node:
        t = self.take()
        line = t.line
        if t.kind in ("int", "float", "rational", "ivar", "gvar"):
            return Node(t.kind, line, t.text.replace("_", "") if t.kind in ("int", "float") else t.text)
        if t.kind == "const":
            if self.is_("(") and not self.now.space or self.now.kind == "str" and self.now.space:
                return self.arguments(Node("call", line, t.text), t)
            return Node("const", line, t.text)
        if t.kind in ("str", "sym", "regex"):
            plain = all(isinstance(p, str) for p in t.parts)
            kind = {"str": "str", "sym": "sym", "regex": "regex"}[t.kind] if plain else {"str": "dstr", "sym": "dsym", "regex": "regex"}[t.kind]
            node = Node(kind, line, "".join(t.parts) if plain else None)
            for p in t.parts:
                if not isinstance(p, str):
                    node.parts.append(("part", Parser(p, self.names).statements(())))
            while self.now.kind == "str" and t.kind == "str" and self.now.space and self.now.line == line and self.now.text in "\"'":
                more = self.take()
                node.name = (node.name or "") + "".join(p for p in more.parts if isinstance(p, str))
            return node
        if t.kind == "words":
            return Node("array", line, item=[Node("sym" if t.text in "iI" else "str", line, w) for w in t.parts])
        if t.kind == "id":
            if t.text in self.names and not (self.is_("(") and not self.now.space):
                return Node("lvar", line, t.text)
            if t.text in ("lambda", "proc") and self.is_("{", "do"):
                return Node("lambda", line, t.text)
            return self.arguments(Node("call", line, t.text), t)
        if t.kind == "op":
            if t.text == "(":
                held, self.no_do = self.no_do, False
                inner = self.statements((")",))
                self.skip(")")
                self.no_do = held
                return inner
            if t.text == "[":
                return Node("array", line, item=self.listed("]"))
            if t.text == "{":
                node = Node("hash", line)
                node.parts = [("item", p) for x in self.listed("}") for p in ([q for _, q in x.parts] if x.kind == "keywords" else [x])]
                return node
            if t.text == "->":
                own = set(self.names)
                params = self.params(")") if self.skip("(") else self.params("{") if self.now.kind == "id" and not self.is_("{", "do") else []
                if self.ahead(-1).text == "{" and self.ahead(-1).kind == "op":
                    self.at -= 1
                close = "}" if self.is_("{") else "end"
                node = Node("lambda", line, "->", block=self.block(close))
                node.parts[0][1].parts[:0] = [("param", p) for p in params]
                self.names = own
                return node
            if t.text == "::":
                return Node("const", line, self.take().text)
        if t.kind == "kw":
            return self.keyword(t)
        return Node("error", line, t.text)

    def keyword(self, t: Token) -> Node:
        line, word = t.line, t.text
        if word in ("nil", "true", "false", "self", "redo", "retry"):
            return Node(word, line)
        if word in ("return", "break", "next"):
            more = not (self.now.kind in ("nl", "eof") or self.is_("if", "unless", "}", "end", ")", "while", "until"))
            values = self.commands() if more else []
            return Node(word, line, value=values[0] if len(values) == 1 else Node("array", line, item=values) if values else None)
        if word in ("yield", "super"):
            return self.arguments(Node(word, line, word), t)
        if word in ("if", "unless"):
            return self.choice(line, word)
        if word in ("while", "until"):
            held, self.no_do = self.no_do, True
            cond = self.expression()
            self.no_do = held
            self.skip("do")
            body = self.statements(("end",))
            self.skip("end")
            return Node("while", line, word, cond=cond, body_of_loop=body)
        if word == "for":
            names = [self.take().text]
            while self.skip(","):
                names.append(self.take().text)
            self.names |= set(names)
            self.skip("in")
            held, self.no_do = self.no_do, True
            over = self.expression()
            self.no_do = held
            self.skip("do")
            body = self.statements(("end",))
            self.skip("end")
            return Node("for", line, names[0], over=over, body_of_loop=body)
        if word == "case":
            return self.case(line)
        if word == "begin":
            node = self.body()
            self.skip("end")
            return node
        if word == "def":
            return self.definition(line)
        if word in ("class", "module"):
            return self.container(line, word)
        if word in ("alias", "undef"):
            names = []
            while self.now.kind not in ("nl", "eof"):
                names.append(Node("sym", line, self.take().text))
            return Node(word, line, item=names)
        if word == "defined?":
            return Node("defined", line, value=self.unary())
        if word == "not":
            return Node("not", line, value=self.expression())
        return Node("error", line, word)

    def choice(self, line: int, word: str) -> Node:
        cond = self.expression()
        self.skip("then")
        then = self.statements(("else", "elsif", "end"))
        other = None
        if self.is_("elsif"):
            self.take()
            other = self.choice(line, "if")
            return Node("if", line, "if", cond=cond, then=then, **{"else": other})
        if self.skip("else"):
            other = self.statements(("end",))
        self.skip("end")
        if word == "unless":
            then, other = other, then
        node = Node("if", line, word, cond=cond)
        node.parts += [(s, x) for s, x in (("then", then), ("else", other)) if x is not None]
        return node

    def case(self, line: int) -> Node:
        held, self.no_in = self.no_in, True
        node = Node("case", line, subject=None if self.now.kind == "nl" else self.expression())
        self.no_in = held
        self.lines()
        while self.is_("when", "in"):
            t = self.take()
            own = set(self.names)
            if t.text == "when":
                tests = self.commands()
                self.skip("then")
            else:
                tests = [self.pattern()]
                guard = self.expression() if self.skip("if") else Node("not", line, value=self.expression()) if self.skip("unless") else None
                tests += [Node("guard", line, value=guard)] if guard else []
                self.skip("then")
            node.parts.append(("when", Node(t.text, t.line, test=tests, body_of_when=self.statements(("when", "in", "else", "end")))))
            self.names |= own
        if self.skip("else"):
            node.parts.append(("else", self.statements(("end",))))
        self.skip("end")
        return node

    def pattern(self) -> Node:
        """The pattern of an `in` arm: arrays, finds, hashes, values, alternatives and names that are bound."""
        items = [self.pattern_part()]
        line = items[0].line
        if self.is_(",") or items[0].kind in ("key_pattern", "rest_pattern"):
            while self.skip(","):
                self.lines()
                items.append(self.pattern_part())
            return Node("hash_pattern" if items[0].kind == "key_pattern" else "array_pattern", line, item=items)
        return items[0]

    def pattern_part(self) -> Node:
        t = self.now
        if t.kind == "label":
            self.take()
            bare = self.is_(",", "}", ")", "then", "if", "unless") or self.now.kind == "nl"
            if bare:
                self.names.add(t.text)
            return Node("key_pattern", t.line, t.text, value=Node("bind", t.line, t.text) if bare else self.pattern_part())
        if self.is_("*", "**"):
            self.take()
            name = self.take().text if self.now.kind == "id" or self.is_("nil") else None
            self.names |= {name} if name else set()
            return Node("rest_pattern", t.line, name)
        if self.is_("[", "{", "("):
            close = CLOSING[self.take().text]
            items = []
            self.lines()
            while not self.is_(close) and self.now.kind != "eof":
                before = self.at
                items.append(self.pattern_part())
                self.lines()
                self.skip(",")
                self.lines()
                if before == self.at:
                    items.append(self.broken())
            self.skip(close)
            node = items[0] if t.text == "(" and len(items) == 1 else Node("array_pattern" if t.text == "[" else "hash_pattern", t.line, item=items)
        elif t.kind == "id" and self.ahead().text not in (".", "("):
            self.take()
            self.names.add(t.text)
            node = Node("bind", t.line, t.text)
        elif self.is_("^"):
            self.take()
            node = Node("pin", t.line, value=self.primary())
        else:
            node = Node("value_pattern", t.line, value=self.binary(BINDING["|"] + 1))
        while self.is_("|"):
            self.take()
            node = Node("or_pattern", t.line, item=[node, self.pattern_part()])
        if self.is_("=>"):
            self.take()
            name = self.take().text
            self.names.add(name)
            node = Node("as_pattern", t.line, name, value=node)
        return node

    def body(self) -> Node:
        """Statements with rescue, else and ensure."""
        inner = self.statements(("rescue", "else", "ensure", "end"))
        if not self.is_("rescue", "else", "ensure"):
            return inner
        node = Node("begin", inner.line, body=inner)
        while self.is_("rescue"):
            t = self.take()
            kinds, name = [], None
            while self.now.kind not in ("nl", "eof") and not self.is_("then", "=>"):
                kinds.append(self.unary())
                self.skip(",")
            if self.skip("=>"):
                name = self.take().text
                self.names.add(name)
            self.skip("then")
            node.parts.append(("rescue", Node("rescue_arm", t.line, name, error=kinds, body=self.statements(("rescue", "else", "ensure", "end")))))
        if self.skip("else"):
            node.parts.append(("else", self.statements(("ensure", "end"))))
        if self.skip("ensure"):
            node.parts.append(("ensure", self.statements(("end",))))
        return node

    def definition(self, line: int) -> Node:
        t = self.take()
        on_self = False
        if (t.text == "self" or t.kind == "const") and self.is_("."):
            self.take()
            t, on_self = self.take(), True
        name = t.text
        if t.kind == "op" and name in ("[", "+", "-", "!", "~") and not self.now.space and self.is_("]", "@"):
            name += self.take().text
        if self.is_("=") and not self.now.space and (self.ahead().text == "(" and not self.ahead().space or self.ahead().kind == "id" and not self.ahead().space):
            self.take()
            name += "="
        held, self.names = self.names, set()
        params = self.params(")") if self.skip("(") else [] if self.is_("=") or self.now.kind == "nl" else self.params("nl")
        node = Node("def", line, name, flag=Node("on_self", line) if on_self else None, param=params)
        if self.skip("="):
            self.lines()
            node.parts.append(("body", self.statement()))
        else:
            node.parts.append(("body", self.body()))
            self.skip("end")
        self.names = held
        return node

    def container(self, line: int, word: str) -> Node:
        if word == "class" and self.skip("<<"):
            self.unary()
            node = Node("sclass", line, "self")
        else:
            self.skip("::")
            name = self.take().text
            while self.skip("::"):
                name += "::" + self.take().text
            node = Node(word, line, name, superclass=self.expression() if word == "class" and self.skip("<") else None)
        held, self.names = self.names, set()
        node.parts.append(("body", self.body()))
        self.skip("end")
        self.names = held
        return node


#: What nodes of a kind are, whatever they hold.
KNOWN = {"dstr": terms.STRING, "dsym": terms.SYMBOL, "regex": terms.cls("Regexp"), "rational": terms.cls("Rational"), "nil": terms.NIL, "nothing": terms.NIL, "true": terms.TRUE, "false": terms.FALSE, "not": terms.BOOL, "while": terms.NIL, "matches": terms.BOOL}
LOCAL = {"lvar", "assign", "param", "return", "break", "next", "bind", "rest_pattern", "as_pattern", "for", "rescue_arm"}
#: Kinds whose value is made of the values below them, in these slots, and kinds that write a local. Fixed values.
MADE = ["call", "array", "hash", "or", "and", "part", "keywords", "splat"]
BELOW = ["receiver", "arg", "item", "left", "right", "safe"]
WRITES = ["assign", "param", "bind", "rest_pattern", "as_pattern", "for", "rescue_arm"]
#: Kinds and slots of a parent whose value is that of the node there. Fixed values.
PASSING = {
    "statements": {"item"}, "if": {"then", "else"}, "case": {"when", "else"}, "when": {"body_of_when"}, "in": {"body_of_when"}, "begin": {"body", "rescue", "else"}, "rescue_arm": {"body"}, "pair": {"value"},
    **dict.fromkeys(("assign", "iassign", "gassign", "cassign", "masgn"), {"value"}),
}
#: Nodes of a batch that goes to the JVM, about.
BATCH = 20_000
#: Frames that nested syntax may take; a text nested deeper than that is one node of kind error.
DEEPEST = 20_000


def tree(text: str) -> Node:
    sys.setrecursionlimit(max(sys.getrecursionlimit(), DEEPEST))
    try:
        return Parser(Reader(text).read()).program()
    except RecursionError:
        return Node("program", 1, item=Node("error", 1))


@functools.lru_cache(1 << 16)
def literal(kind: str, name: str | None) -> str | None:
    """The term of a node whose type its form alone gives."""
    if kind == "int":
        return terms.dumps(("lit_int", int(name))) if re.fullmatch(r"-?\d+", name) else terms.dumps(terms.INTEGER)
    if kind in ("float", "sym"):
        return terms.dumps((f"lit_{kind}", name or ""))
    if kind == "str":
        return terms.dumps(("lit_str", name or ""))
    if kind == "def":
        return terms.dumps(("lit_sym", name))
    return terms.dumps(KNOWN[kind]) if kind in KNOWN else None


def complete(node: Node) -> None:
    """Ways through a node that nothing is written for are nil: they get a node of kind nothing."""
    if node.kind == "if":
        slots = {s for s, _ in node.parts}
        node.parts += [(s, Node("nothing", node.line)) for s in ("then", "else") if s not in slots]
    elif node.kind == "case" and all(s != "else" and x.kind != "in" for s, x in node.parts):
        node.parts.append(("else", Node("nothing", node.line)))
    elif node.kind == "statements" and not node.parts:
        node.parts.append(("item", Node("nothing", node.line)))


def tops(parents: list, kinds: list, slots: list, final: list) -> list:
    """top of every node."""
    out, made, below, by_value = [], set(MADE), set(BELOW), {"assign", "iassign", "gassign", "cassign", "masgn"}
    for at, (parent, kind, slot) in enumerate(zip(parents, kinds, slots)):
        top, up = None, kinds[parent] if at else None
        if slot in PASSING.get(up, ()) and (up != "statements" or final[at]) and (up not in by_value or kind != "part"):
            top = parent if up == "assign" else out[parent]
        elif up == "return" or up == "def" and slot == "body" or up in made and slot in below and out[parent] is not None:
            top = at
        out.append(at if top is None and kind == "assign" else top)
    return out


def spread(file: str, root: Node, out: dict[str, list]) -> None:
    """Adds the nodes of a tree, numbered in pre-order, to columns of NODES; those that are not in out are not made."""
    last, parents, kinds, names, slots, ords, lines, arm, scopes, final_, arms_, loops_ = ([] for _ in range(12))
    around, local_ = not out.keys().isdisjoint(("arm", "arm_last", "scope", "arms", "loops")), not out.keys().isdisjoint(("arms", "loops"))
    stack: list[tuple] = [(root, None, "root", 0, True, (), (), 0)]
    while stack:
        node, parent, slot, k, final, arms, loops, scope = stack.pop()
        kind, parts = node.kind, node.parts
        if kind in ("if", "case", "statements"):
            complete(node)
        at = len(kinds)
        parents.append(parent)
        kinds.append(kind)
        names.append(node.name)
        slots.append(slot)
        ords.append(k)
        lines.append(node.line)
        final_.append(final)
        if around:
            if slot in CONDITIONAL:
                arms = (*arms, {"arm": at, "above": parent})
            if slot in ("body_of_loop", "body_of_block"):
                loops = (*loops, at)
            arm.append(arms[-1]["arm"] if arms else None)
            scopes.append(scope)
            if local_:
                local = kind in LOCAL or kind == "call" and node.name in LEAVING
                arms_.append(list(arms) if local else None)
                loops_.append(list(loops) if local else None)
            if kind in SCOPES:
                arms, loops, scope = (), (), at
        if len(parts) == 1:
            s, x = parts[0]
            stack.append((x, at, s, 0, True, arms, loops, scope))
        elif parts:
            ends = {s: j for j, (s, _) in enumerate(parts)}
            for j in range(len(parts) - 1, -1, -1):
                s, x = parts[j]
                stack.append((x, at, s, j, ends[s] == j, arms, loops, scope))
    n = len(kinds)
    if "last" in out or "arm_last" in out:
        last = list(range(n))
        for at in range(n - 1, 0, -1):
            if last[at] > last[parents[at]]:
                last[parents[at]] = last[at]
    made = {
        "file": lambda: [file] * n, "node": lambda: range(n), "last": lambda: last, "parent": lambda: parents, "kind": lambda: kinds, "name": lambda: names, "slot": lambda: slots, "ord": lambda: ords, "line": lambda: lines, "arm": lambda: arm,
        "arm_last": lambda: [None if a is None else last[a] for a in arm], "scope": lambda: scopes, "up": lambda: [None if p is None else kinds[p] for p in parents], "final": lambda: final_, "arms": lambda: arms_, "loops": lambda: loops_, "term": lambda: map(literal, kinds, names),
        "top": lambda: tops(parents, kinds, slots, final_),
    }
    for column, into in out.items():
        into += made[column]()


def rows(file: str, root: Node) -> list[tuple]:
    """The nodes of a tree as rows of NODES."""
    out: dict[str, list] = {column: [] for column in COLUMNS}
    spread(file, root, out)
    return list(zip(*out.values()))


def nodes(texts: DataFrame, *columns: str) -> DataFrame:
    """NODES, or some of its columns, of all texts (file, content); a null text has only its program node. Texts are dealt over all cores, as many lie in a small file; nodes leave in batches."""
    columns = columns or tuple(COLUMNS)
    schema = pa.schema([(c, COLUMNS[c]) for c in columns])
    kinds = dict(f.split(" ", 1) for f in NODES.split(", "))

    def packed(found: dict[str, list]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(found[f.name], f.type) for f in schema], schema=schema)

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list] = {c: [] for c in columns}
        for batch in batches:
            for file, content in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                spread(file, tree(content or ""), found)
                if len(found[columns[0]]) >= BATCH:
                    yield packed(found)
                    found = {c: [] for c in columns}
        if found[columns[0]]:
            yield packed(found)

    spark = texts.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 4 * spark.sparkContext.defaultParallelism)
    return texts.select("file", "content").repartition(parts, "file", "content").mapInArrow(read, ", ".join(f"{c} {kinds[c]}" for c in columns))

"""Binding of call arguments to parameters.

A parameter is (name, kind, default term or None); kinds: required, optional, rest, keyword_required, keyword_optional, double_rest, block.
"""

from __future__ import annotations

from glossa.functions import terms as T

POSITIONAL = ("required", "optional", "rest")
KEYWORD = ("keyword_required", "keyword_optional")


def slots(kinds: list[str], given: int) -> list[int]:
    """How many of the given arguments each positional parameter takes: required ones first, then optional ones, then the rest."""
    spare = max(0, given - kinds.count("required"))
    rest = max(0, spare - kinds.count("optional"))
    out, left = [], given
    for kind in kinds:
        if kind == "optional":
            take, spare = min(1, spare), max(0, spare - 1)
        elif kind == "rest":
            take, rest = rest, 0
        else:
            take = 1
        take = min(take, left)
        left -= take
        out.append(take)
    return out


def bind_positional(kinds: list[str], args: list) -> list[list]:
    """The arguments of each positional parameter."""
    out, at = [], 0
    for take in slots(kinds, len(args)):
        out.append(args[at : at + take])
        at += take
    return out


def bind_open_splat(kinds: list[str], args: list, at: int) -> list[list]:
    """Binding when args[at] stands for any number of its element: the distinct arguments over all counts that fit."""
    if at >= len(args):
        return bind_positional(kinds, args)
    required, optional, rest = kinds.count("required"), kinds.count("optional"), "rest" in kinds
    fixed = len(args) - 1
    merged: list[dict] = [{} for _ in kinds]
    fits = False
    for n in range(max(0, required + optional + rest - fixed) + 1):
        if fixed + n < required or not rest and fixed + n > required + optional:
            continue
        fits = True
        for slot, bound in zip(merged, bind_positional(kinds, [*args[:at], *[args[at]] * n, *args[at + 1 :]])):
            slot.update(dict.fromkeys(bound))
    return [list(s) for s in merged] if fits else bind_positional(kinds, args)


def _spread(kind: str, element, default):
    """A parameter's type from an array of unknown length."""
    if kind == "rest":
        return T.array(element)
    return T.union_with(element, default if kind == "optional" and default else T.NIL)


def bind(params: list[tuple], positional: list, keywords: dict, literal: str | None = None, open_at: int | None = None) -> dict[str, tuple]:
    """The type of each parameter by name. literal: None for methods, else proc or lambda (values stay exact)."""
    finish = T.widen_argument if literal is None else lambda t: t
    spots = [p for p in params if p[1] in POSITIONAL]
    kinds = [p[1] for p in spots]
    own = sum(k != "rest" for k in kinds)
    takes_keywords = any(p[1] in KEYWORD or p[1] == "double_rest" for p in params)
    out: dict[str, tuple] = {}
    lone = positional[0] if literal == "proc" and len(positional) == 1 and not keywords and (own > 1 or "rest" in kinds and own) else None
    if lone and lone[0] == "array" and lone[1]:
        out.update({name: _spread(kind, lone[1], default) for name, kind, default in spots})
    else:
        args = list(lone[1]) if lone and lone[0] == "tuple" else list(positional)
        if keywords and not takes_keywords:
            args.append(T.keyword_hash(list(keywords.items())))
        bound = bind_positional(kinds, args) if open_at is None else bind_open_splat(kinds, args, open_at)
        for (name, kind, default), got in zip(spots, bound):
            if kind == "rest" and literal:
                out[name] = ("tuple", tuple(got))
            elif got:
                out[name] = finish(T.union_keeping_untyped(got))
            elif kind == "optional":
                out[name] = finish(default) if default else T.UNTYPED
            else:
                out[name] = T.NIL if kind == "required" and literal == "proc" else T.UNTYPED
    named = {name: finish(keywords.get(name) or default or T.UNTYPED) for name, kind, default in params if kind in KEYWORD}
    out.update(named)
    rest = next((p[0] for p in params if p[1] == "double_rest"), None)
    if rest is not None:
        left = [(n, t) for n, t in keywords.items() if n not in named]
        if literal:
            out[rest] = T.keyword_hash(left)
        elif left:
            out[rest] = ("hash", T.SYMBOL, T.union_keeping_untyped([finish(t) for _, t in left]))
    return out


def arity(params: list[tuple]) -> tuple[int, int | None]:
    """The least and the greatest number of positional arguments (None: any)."""
    kinds = [p[1] for p in params]
    low = kinds.count("required")
    return low, None if "rest" in kinds else low + kinds.count("optional")


def accepts(params: list[tuple], positional: int, keywords: list[str], block: bool | None = None) -> bool:
    """Whether a signature fits a call by the number of its arguments, its keywords and, if told, its block."""
    low, high = arity(params)
    names = {p[0] for p in params if p[1] in KEYWORD}
    takes = any(p[1] == "double_rest" for p in params)
    if keywords and not names and not takes:
        positional, keywords = positional + 1, []
    if positional < low or high is not None and positional > high:
        return False
    if any(p[0] not in keywords for p in params if p[1] == "keyword_required") or not takes and any(k not in names for k in keywords):
        return False
    return block is None or block or not any(p[1] == "block" and p[2] is not None for p in params)

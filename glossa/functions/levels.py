"""How much is known of a type: 0 unknown, 1 untyped, 2 typed."""

from __future__ import annotations

from glossa.functions import terms as T

UNKNOWN, UNTYPED, TYPED = 0, 1, 2
NAMES = {UNKNOWN: "unknown", UNTYPED: "untyped", TYPED: "typed"}


def _no_name(name: str) -> bool:
    return not name or name == "Unknown" or name.startswith("Unknown::")


def level(t, scope: str = "", method: str | None = None) -> int:
    """The level of a type seen in a class and method."""
    head = t[0]
    if head in ("untyped", "todo", "block_return", "safe_nav") or head in T.PROJECTIONS:
        return UNTYPED
    if head in ("param", "keyword_param"):
        return UNKNOWN if method is None else UNTYPED
    if head in ("ivar", "gvar"):
        return UNTYPED if scope else UNKNOWN
    if head == "method_return":
        return UNKNOWN if _no_name(t[1]) else UNTYPED
    if head in T.PATTERNS or head in ("receiver_method", "splat"):
        return min(UNTYPED, level(t[1], scope, method))
    if head in ("class", "singleton"):
        return UNKNOWN if _no_name(t[1]) else TYPED
    if head == "generic" and _no_name(t[1]):
        return UNKNOWN
    if head == "proc":
        return level(t[3], scope, method)
    parts = {"union": lambda: t[1], "intersection": lambda: t[1], "tuple": lambda: t[1], "array": lambda: t[1:2], "hash": lambda: t[1:], "record": lambda: [v for _, v, _ in t[1]], "generic": lambda: t[2]}.get(head, lambda: ())()
    return min((level(p, scope, method) for p in parts if p is not None), default=TYPED)


def call_level(receiver, result, scope: str = "", method: str | None = None) -> int:
    """A call on a receiver that is not typed is unknown, whatever it gives."""
    return level(result, scope, method) if level(receiver, scope, method) == TYPED else UNKNOWN


#: Which kind a site with several observations of one level keeps. Fixed values.
PRIORITY = {"constant_reference": 3, "method_call": 2, "value": 1}


def fold(observations: list[tuple[str, int, bool]]) -> tuple[str, int]:
    """A site's kind and level from its observations (kind, level, explicitly unknown) in order."""
    kind, now, stuck = observations[0]
    for other, seen, explicit in observations[1:]:
        if explicit:
            kind, now, stuck = "constant_reference", UNKNOWN, True
        elif stuck:
            continue
        elif other == kind:
            now = max(now, seen)
        else:
            if seen < now or seen == now and PRIORITY.get(other, 0) > PRIORITY.get(kind, 0):
                kind = other
            now = min(now, seen)
    return kind, now


def hole_reason(t, annotated: bool = False) -> str:
    """Why a type has a hole."""
    head = t[0]
    if annotated and t == T.UNTYPED:
        return "explicit_untyped"
    if head in ("untyped", "todo"):
        return "unknown"
    if head in ("param", "keyword_param"):
        return "missing_call_site"
    if head in ("method_return", "receiver_method"):
        return "missing_method"
    if head == "ivar":
        return "missing_instance_variable"
    if head in ("union", "intersection", "tuple", "record"):
        parts = [v for _, v, _ in t[1]] if head == "record" else t[1]
        return next((r for r in (hole_reason(p, annotated) for p in parts) if r != "unknown"), "deferred_type")
    if head == "array" and t[1]:
        return hole_reason(t[1], annotated)
    if head == "hash" and (t[1] or t[2]):
        first = hole_reason(t[1], annotated) if t[1] else "unknown"
        return first if first != "unknown" or not t[2] else hole_reason(t[2], annotated)
    return hole_reason(t[3], annotated) if head == "proc" else "deferred_type"


def has_hole(t) -> bool:
    """Whether a declared type has a hole: a part unknown, or a reference that nothing resolved."""
    head = t[0]
    if head in ("untyped", "todo", "param", "keyword_param", "ivar", "method_return", "receiver_method", "safe_nav"):
        return True
    if head in ("union", "intersection", "tuple"):
        return any(map(has_hole, t[1]))
    if head == "array":
        return t[1] is not None and has_hole(t[1])
    if head == "hash":
        return any(p is not None and has_hole(p) for p in t[1:])
    if head == "record":
        return any(has_hole(v) for _, v, _ in t[1])
    return head == "proc" and has_hole(t[3])

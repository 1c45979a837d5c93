"""Return types of well-known methods, as lookup rows: (receiver, method, return), where return may name the receiver's parts.

Returns are terms; ("self",) is the receiver, ("elem",) an array's element, ("key",) and ("value",) a hash's parts, ("model",) a relation's model.
All tables here are fixed values.
"""

from __future__ import annotations

from glossa.functions import terms as T
from glossa.functions.relation_methods import ANSWERS, RELATION_METHODS

SELF, ELEM, KEY, VALUE = ("self",), ("elem",), ("key",), ("value",)
ANY_RECEIVER = ["dup", "clone", "itself", "freeze"]
TABLE = {
    "String": {T.STRING: ["upcase", "downcase", "capitalize", "swapcase", "reverse", "strip", "lstrip", "rstrip", "chomp", "chop", "squeeze", "succ", "next", "b", "scrub", "to_s", "to_str"], T.INTEGER: ["length", "size", "bytesize", "ord", "hash"]},
    "Symbol": {T.SYMBOL: ["upcase", "downcase", "capitalize", "swapcase"], T.STRING: ["to_s", "name"], T.INTEGER: ["length", "size"]},
    "Integer": {T.INTEGER: ["succ", "next", "pred", "abs", "magnitude", "to_int", "bit_length", "hash", "ord"], T.STRING: ["chr"], T.array(T.INTEGER): ["digits"]},
    "Float": {T.FLOAT: ["abs", "magnitude"]},
    "Time": {T.STRING: ["iso8601", "xmlschema", "strftime", "httpdate", "rfc3339", "rfc2822", "to_s", "inspect"], T.INTEGER: ["year", "month", "mon", "day", "mday", "wday", "yday"], T.BOOL: ["<", "<=", ">", ">=", "between?"]},
    "Array": {T.array(ELEM): ["sort", "reverse", "shuffle", "uniq", "rotate", "compact", "to_a"], T.STRING: ["join"], T.INTEGER: ["length", "size", "count", "hash"]},
    "Hash": {T.array(KEY): ["keys"], T.array(VALUE): ["values"], ("hash", VALUE, KEY): ["invert"], T.INTEGER: ["length", "size"]},
    "ActiveSupport::TimeWithZone": {
        T.cls("Time"): ["utc", "getutc", "to_time", "localtime"], T.cls("Date"): ["to_date"], T.cls("DateTime"): ["to_datetime"],
        T.STRING: ["strftime", "iso8601", "xmlschema", "rfc3339", "rfc2822", "to_s", "inspect", "zone", "httpdate", "as_json"],
        T.INTEGER: ["to_i", "tv_sec", "year", "month", "mon", "day", "mday", "hour", "min", "sec", "wday", "yday", "usec", "nsec", "utc_offset"], T.FLOAT: ["to_f"],
        T.BOOL: ["dst?", "utc?", "gmt?", "blank?", "present?", "<", "<=", ">", ">=", "==", "between?", "eql?"], T.UNTYPED: ["time", "period", "comparable_time"], T.union(T.INTEGER, T.NIL): ["<=>"],
    },
    "calendar": {
        SELF: ["beginning_of_day", "end_of_day", "beginning_of_week", "end_of_week", "beginning_of_month", "end_of_month", "beginning_of_quarter", "end_of_quarter", "beginning_of_year", "end_of_year", "beginning_of_hour", "end_of_hour", "beginning_of_minute", "end_of_minute", "midnight", "midday", "noon", "at_midnight", "at_noon", "yesterday", "tomorrow", "next_day", "prev_day", "next_week", "prev_week", "next_month", "prev_month", "next_year", "prev_year", "weeks_ago", "weeks_since", "months_ago", "months_since", "years_ago", "years_since", "days_ago", "days_since", "advance", "change", "ago", "since", "in"],
        T.BOOL: ["future?", "past?", "today?", "tomorrow?", "yesterday?", "on_weekday?", "on_weekend?"], T.cls("ActiveSupport::TimeWithZone"): ["in_time_zone"], T.STRING: ["to_fs", "to_formatted_s"],
        T.FLOAT: ["seconds_since_midnight"], T.UNTYPED: ["all_day", "all_week", "all_month", "all_year"],
    },
    "ActionController::Parameters": {
        SELF: ["require", "permit", "expect", "merge", "merge!", "reverse_merge", "reverse_merge!", "with_defaults", "with_defaults!", "slice", "except", "transform_values", "transform_values!", "transform_keys", "transform_keys!", "select", "reject", "compact", "deep_transform_values", "deep_transform_values!", "permit!"],
        ("hash", T.STRING, T.UNTYPED): ["to_h", "to_unsafe_h", "to_hash"], T.array(T.STRING): ["keys"], T.array(T.UNTYPED): ["values", "values_at"],
        T.BOOL: ["any?", "all?", "empty?", "none?", "has_key?", "include?", "key?", "member?", "present?", "blank?", "permitted?"], T.UNTYPED: ["[]", "fetch", "dig", "delete", "each_value"],
    },
}

#: Methods that a relation hands to its loaded records.
RECORD_METHODS = ["to_xml", "encode_with", "length", "each", "join", "intersect?", "[]", "&", "|", "+", "-", "sample", "reverse", "rotate", "compact", "in_groups", "in_groups_of", "to_sentence", "to_fs", "to_formatted_s", "as_json", "shuffle", "split", "slice", "index", "rindex"]
RELATION_CLASS, PROXY_CLASS = "ActiveRecord::Relation", "ActiveRecord::Associations::CollectionProxy"


def _tables() -> dict[tuple[str, str], tuple]:
    return {(receiver, m): t for receiver, by in TABLE.items() for t, names in by.items() for m in names}


METHODS = _tables()


def known_return(receiver, method: str):
    """What a method of a well-known receiver returns, whatever its arguments; None if that isn't known."""
    head = receiver[0]
    if receiver == T.NIL:
        return None
    if method in ANY_RECEIVER:
        return receiver
    base = T.LITERAL_BASE.get(head, receiver)
    if base in (T.STRING, T.SYMBOL, T.INTEGER, T.FLOAT):
        return METHODS.get((T.render(base), method))
    if head in ("array", "tuple"):
        found = METHODS.get(("Array", method))
        return found and _put_parts(found, {"elem": (receiver[1] or T.UNTYPED) if head == "array" else T.union_of(list(receiver[1]))})
    if head in ("hash", "record"):
        found = METHODS.get(("Hash", method))
        if head == "hash":
            key, value = receiver[1] or T.UNTYPED, receiver[2] or T.UNTYPED
        else:
            key = T.union_of([T.SYMBOL if k[0] == "sym" else T.STRING for k, _, _ in receiver[1]])
            value = T.union_of([v for _, v, _ in receiver[1]])
        return found and _put_parts(found, {"key": key, "value": value})
    if head == "class":
        if receiver[1] in ("Time", "Date", "DateTime"):
            return METHODS.get(("Time", method)) or calendar_return(receiver, method)
        if receiver[1] == "ActiveSupport::TimeWithZone":
            return METHODS.get((receiver[1], method)) or calendar_return(receiver, method)
        found = METHODS.get((receiver[1], method))
        return receiver if found == SELF else found
    return None


def calendar_return(receiver, method: str):
    found = METHODS.get(("calendar", method))
    return receiver if found == SELF else found


def _put_parts(t, parts: dict):
    if t[0] in parts and len(t) == 1:
        return parts[t[0]]
    if t[0] == "array":
        return T.array(t[1] and _put_parts(t[1], parts))
    if t[0] == "hash":
        return ("hash", t[1] and _put_parts(t[1], parts), t[2] and _put_parts(t[2], parts))
    if t[0] == "union":
        return T.union_keeping_untyped([_put_parts(x, parts) for x in t[1]])
    if t[0] == "generic":
        return ("generic", t[1], tuple(_put_parts(x, parts) for x in t[2]))
    return t


_RELATION_METHODS = {(name, receiver): (ANSWERS[answer], block, since) for name, answer, receivers, since, block, _ in RELATION_METHODS for receiver in receivers.split()}


def relation_lookup(method: str, receiver: str, version: tuple[int, int] = (99, 0)):
    """(return, block form) of a relation method on a model, relation or proxy, if that version has it."""
    found = _RELATION_METHODS.get((method, receiver))
    return found[:2] if found and found[2] <= version else None


def relation_return(method: str, receiver: str, model, relation=None, primary_key=T.INTEGER, block: bool = False, version: tuple[int, int] = (99, 0)):
    """The return type of a relation method, or None."""
    found = relation_lookup(method, receiver, version)
    if not found:
        return None
    ret, form = found
    if block and form == "anything":
        return T.UNTYPED
    return _put_parts(ret, {"model": model, "relation": relation or ("generic", RELATION_CLASS, (model,)), "primary_key": primary_key})


def records_receiver(receiver, method: str, block: bool, enumerable: set[str] = frozenset()):
    """The array of records that a relation call runs on, if the relation itself doesn't answer it; else None."""
    if receiver[0] != "generic" or receiver[1] not in (RELATION_CLASS, PROXY_CLASS) or not receiver[2]:
        return None
    found = relation_lookup(method, "relation" if receiver[1] == RELATION_CLASS else "proxy")
    hands = block and found[1] == "records" if found else method in RECORD_METHODS or method in enumerable
    return T.array(receiver[2][0]) if hands else None

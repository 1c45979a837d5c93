"""Names: singular and plural forms, class names of tables, underscores. Column expressions throughout.

A project may add irregular plurals {plural: singular} and acronyms {lower case: as written}.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Inflections:
    irregular: dict[str, str] = field(default_factory=dict)
    acronyms: dict[str, str] = field(default_factory=dict)


NONE = Inflections()
#: Singular rules, the first that fits: (regular expression, characters cut, ending added). Fixed values.
SINGULAR_RULES = [
    (r"^.?$|[^s]$|ss$", 0, ""),
    (r"(movies|databases)$", 1, ""),
    (r"^.+ies$", 3, "y"),
    (r"(vert|ind)ices$", 4, "ex"),
    (r"matrices$", 4, "ix"),
    (r"(wi|kni|li)ves$", 3, "fe"),
    (r"(?<!hi)(l|r|ea)ves$", 3, "f"),
    (r"(analy|ba|diagno|parenthe|progno|synop|the)ses$", 3, "sis"),
    (r"(x|ch|sh|ss|alias|status|bus|o)es$", 2, ""),
    (r"", 1, ""),
]


def _lookup(word: Column, table: dict[str, str]) -> Column | None:
    if not table:
        return None
    return F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[word]


def singularize(word: Column, project: Inflections = NONE) -> Column:
    out = None
    for pattern, cut, ending in reversed(SINGULAR_RULES):
        value = word if not cut else F.concat(F.substring(word, F.lit(1), F.greatest(F.length(word) - cut, F.lit(0))), F.lit(ending))
        out = value if out is None else F.when(word.rlike(pattern), value).otherwise(out)
    found = _lookup(word, project.irregular)
    return out if found is None else F.coalesce(found, out)


def camelize(part: Column, project: Inflections = NONE) -> Column:
    out = F.concat(F.upper(F.substring(part, 1, 1)), F.substring(part, 2, 1 << 30))
    found = _lookup(F.lower(part), project.acronyms)
    return out if found is None else F.coalesce(found, out)


def classify(table: Column, project: Inflections = NONE) -> Column:
    """line_items -> LineItem."""
    return F.array_join(F.transform(F.split(singularize(table, project), "_"), lambda p: camelize(p, project)), "")


def namespaced_class(table: Column, project: Inflections = NONE) -> Column:
    """admin_users -> Admin::User, if all but the last part are singular; else null."""
    parts = F.filter(F.split(singularize(table, project), "_"), lambda p: p != "")
    spaces = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    fits = (F.size(parts) >= 2) & F.forall(spaces, lambda p: singularize(p, project) == p)
    return F.when(fits, F.array_join(F.transform(parts, lambda p: camelize(p, project)), "::"))


def pluralize(word: Column) -> Column:
    y = word.rlike("y$") & ~word.rlike("[aeiou]y$")
    return F.when(y, F.regexp_replace(word, "y$", "ies")).when(word.rlike("(s|sh|ch|x|z)$"), F.concat(word, F.lit("es"))).otherwise(F.concat(word, F.lit("s")))


def underscore(name: Column) -> Column:
    """LineItem -> line_item."""
    return F.lower(F.regexp_replace(name, r"(?<!^)(\p{Lu})", "_$1"))


def model_path(name: Column) -> Column:
    """Admin::LineItem -> admin/line_item.rb."""
    return F.concat(F.array_join(F.transform(F.split(name, "::"), underscore), "/"), F.lit(".rb"))


def join_scope(scope: Column, name: Column) -> Column:
    return F.when(F.coalesce(scope, F.lit("")) == "", name).otherwise(F.concat_ws("::", scope, name))


def scopes_outward(scope: Column) -> Column:
    """A::B -> [A::B, A, ""]; a leading :: is dropped."""
    bare = F.regexp_replace(F.coalesce(scope, F.lit("")), "^::", "")
    parts = F.filter(F.split(bare, "::"), lambda p: p != "")
    return F.transform(F.sequence(F.size(parts), F.lit(0), F.lit(-1)), lambda n: F.when(n == 0, F.lit("")).otherwise(F.array_join(F.slice(parts, F.lit(1), n), "::")))


def project_inflections(lines: list[str]) -> Inflections:
    """From the lines of the project's inflections file: inflect.irregular 'a', 'b' and inflect.acronym 'A'."""
    import re

    irregular, acronyms = {}, {}
    for line in map(str.strip, lines):
        words = [a or b for a, b in re.findall(r"'([^']*)'|\"([^\"]*)\"", line)]
        if line.startswith("inflect.irregular") and "do |inflect|" not in line and len(words) >= 2:
            irregular[words[1]] = words[0]
        elif line.startswith("inflect.acronym") and words:
            acronyms[words[0].lower()] = words[0]
    return Inflections(irregular, acronyms)


def enum_method_name(value: Column, prefix: Column, suffix: Column) -> Column:
    """The name of an enum value's method with its prefix and suffix."""
    blank = lambda c: F.when(F.coalesce(c, F.lit("")) != "", c)
    return F.concat_ws("_", blank(prefix), value, blank(suffix))

"""The dependency graph of files: who defines and who refers to a symbol, and what a change invalidates.

defs: file, symbol; refs: file, symbol; edges: file, symbol, kind (typed references).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Kinds of typed edges. Fixed values.
KINDS = ["inheritance", "mixin", "method_call", "constant", "parameter", "return", "instance_variable"]


def modulus() -> F.Column:
    """2^64, as sums of hashes overflow a long."""
    return F.lit(str(1 << 64)).cast("decimal(38,0)")


def referencing_files(refs: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files that refer to any of the symbols."""
    return refs.join(symbols.select("symbol").distinct(), "symbol", "left_semi").select("file").distinct()


def defining_files(defs: DataFrame, symbols: DataFrame) -> DataFrame:
    return referencing_files(defs, symbols)


def referencing_files_by_kind(refs: DataFrame, edges: DataFrame, symbols: DataFrame, kinds: list[str], fallback: bool) -> DataFrame:
    """Files with a typed edge of these kinds; with fallback also files without any typed edge that refer to a symbol."""
    typed = referencing_files(edges.filter(F.col("kind").isin(kinds)), symbols)
    if not fallback:
        return typed
    untyped = refs.join(edges.select("file").distinct(), "file", "left_anti")
    return typed.union(referencing_files(untyped, symbols)).distinct()


def dependent_files(refs: DataFrame, edges: DataFrame, symbols: DataFrame, kinds: list[str]) -> DataFrame:
    """Only typed edges of these kinds."""
    return referencing_files_by_kind(refs, edges, symbols, kinds, fallback=False)


def external_references(refs: DataFrame, defs: DataFrame) -> DataFrame:
    """References to symbols that their file doesn't define; inheritance counts in any case. refs may have a kind."""
    own = defs.select("file", "symbol").distinct()
    if "kind" not in refs.columns:
        return refs.join(own, ["file", "symbol"], "left_anti").distinct()
    inherits = refs.filter(F.col("kind") == "inheritance")
    return refs.filter(F.col("kind") != "inheritance").join(own, ["file", "symbol"], "left_anti").unionByName(inherits).distinct()


def replace_files(rows: DataFrame, new: DataFrame, files: DataFrame) -> DataFrame:
    """rows with all rows of some files replaced by new ones, as sets."""
    return rows.join(files.select("file").distinct(), "file", "left_anti").unionByName(new).distinct()


def bag_fingerprint(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """count, sum and xor of row hashes in each group: equal for equal bags, whatever their order.

    All three can be taken back, so rows can be added and removed (`combine`, `remove`).
    """
    h = F.xxhash64(*columns)
    return rows.groupBy(*by).agg(F.count("*").alias("n"), F.pmod(F.sum(h.cast("decimal(38,0)")), modulus()).alias("h_sum"), F.bit_xor(h).alias("h_xor"))


def _merge(a: DataFrame, b: DataFrame, by: list[str], sign: int) -> DataFrame:
    signed = b.select(*by, (F.col("n") * sign).alias("n"), (F.col("h_sum") * sign).alias("h_sum"), "h_xor")
    both = a.select(*by, "n", "h_sum", "h_xor").unionByName(signed)
    return both.groupBy(*by).agg(F.sum("n").alias("n"), F.sum("h_sum").alias("s"), F.bit_xor("h_xor").alias("h_xor")).filter("n > 0").select(*by, "n", F.pmod("s", modulus()).alias("h_sum"), "h_xor")


def combine(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The fingerprints of both bags together."""
    return _merge(a, b, by, 1)


def remove(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """The fingerprint of a without the rows of b."""
    return _merge(a, b, by, -1)


def changed(old: DataFrame, new: DataFrame, by: list[str]) -> DataFrame:
    """Groups whose fingerprint differs, appeared or went."""
    left, right = (x.select(*by, F.struct("n", "h_sum", "h_xor").alias(name)) for x, name in ((old, "was"), (new, "now")))
    return left.join(right, by, "full").filter(~F.col("was").eqNullSafe(F.col("now"))).select(*by)


def dirty_files(defs_before: DataFrame, defs_after: DataFrame, refs: DataFrame) -> DataFrame:
    """One hop: files that refer to a symbol whose definition changed. defs: file, symbol, signature."""
    was, now = (bag_fingerprint(d, ["symbol"], ["file", "signature"]) for d in (defs_before, defs_after))
    return referencing_files(refs, changed(was, now, ["symbol"]))


def edges_of_types(types: DataFrame, references) -> DataFrame:
    """file, symbol, kind of the classes that types name. types: file, kind, type (JSON term); references: a column function."""
    return types.select("file", "kind", F.explode(references("type")).alias("symbol")).distinct()

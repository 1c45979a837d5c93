"""Database structure from DDL text: tables, columns and foreign keys, as DataFrames.

Everything is line based and runs in the JVM: lines keep their position, and the table that a line belongs to is a running state over
the lines of its file.
"""

from __future__ import annotations


from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from glossa.functions import terms

#: Canonical keywords by the first prefix of the definition that fits. The order matters. Fixed values.
PREFIXES = [
    ("boolean", ["boolean", "bool", "tinyint(1)"]),
    ("interval", ["interval"]),
    ("inet", ["inet", "cidr"]),
    ("money", ["money"]),
    ("integer", ["bigint", "integer", "int", "smallint", "tinyint", "mediumint", "serial", "bigserial"]),
    ("decimal", ["numeric", "decimal"]),
    ("float", ["double", "real", "float"]),
    ("string", ["character varying", "varchar", "char", "text", "tinytext", "mediumtext", "longtext", "citext", "uuid", "bytea", "macaddr", "xml", "tsvector", "ltree", "bit", "enum", "set("]),
    ("datetime", ["timestamp", "datetime"]),
    ("date", ["date"]),
    ("time", ["time"]),
    ("json", ["json"]),
    ("hstore", ["hstore"]),
]
#: Types of column keywords; all others are untyped. Fixed values.
KEYWORDS = {
    terms.STRING: "string text citext uuid binary immutable_string blob tinyblob mediumblob longblob tinytext mediumtext longtext macaddr xml tsvector ltree bit bit_varying enum line lseg box path polygon circle",
    terms.INTEGER: "integer bigint smallint big_integer primary_key serial bigserial oid unsigned_integer unsigned_bigint",
    terms.FLOAT: "float unsigned_float",
    ("class", "BigDecimal"): "decimal numeric money unsigned_decimal",
    terms.BOOL: "boolean",
    ("class", "Date"): "date",
    ("class", "ActiveSupport::TimeWithZone"): "datetime timestamp timestamptz",
    ("class", "Time"): "time",
    ("class", "ActiveSupport::Duration"): "interval",
    ("class", "IPAddr"): "inet cidr",
    ("generic", "Range", (terms.INTEGER,)): "int4range int8range",
    ("generic", "Range", (("class", "BigDecimal"),)): "numrange",
    ("generic", "Range", (("class", "Date"),)): "daterange",
    ("generic", "Range", (("class", "ActiveSupport::TimeWithZone"),)): "tsrange tstzrange",
    terms.UNTYPED: "json jsonb hstore",
}
#: Lines inside a table that define no column, by their beginnings.
NO_COLUMN = ["constraint ", "primary key", "unique ", "check ", "exclude ", "like ", "key(", "index ", "fulltext", "spatial", "foreign key"]
#: Folders of a project that hold no sources to scan, and those that hold no production code.
SKIPPED, NOT_PRODUCTION = ["vendor", "node_modules", "tmp", "log", "coverage"], ["test", "tests", "spec", "specs", "features", "migrate", "migrations"]


def files(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """file, content: whole texts below a path."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", glob).text(path, wholetext=True).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("content"))


def in_scope(path: Column, production: bool) -> Column:
    """Whether a source file is to be scanned: not below hidden or skipped folders, nor, for production, tests."""
    skipped = SKIPPED + (NOT_PRODUCTION if production else [])
    folders = F.split(path, "/")
    return ~F.exists(F.slice(folders, F.lit(1), F.size(folders) - 1), lambda d: d.startswith(".") | d.isin(skipped))


def scan(spark: SparkSession, path: str, glob: str = "*.rb", production: bool = False) -> DataFrame:
    """Source files below a path, in order: ord, file, content."""
    found = files(spark, path, glob)
    inside = F.regexp_replace("file", "^.*?" + path.rstrip("/").rsplit("/", 1)[-1] + "/", "")
    return found.filter(in_scope(inside, production)).withColumn("ord", F.xxhash64("file")).select("ord", "file", "content")


def lines(texts: DataFrame) -> DataFrame:
    """file, pos, line (trimmed) of files' texts."""
    return texts.select("file", F.posexplode(F.split("content", "\r?\n")).alias("pos", "line")).withColumn("line", F.trim("line"))


def unquoted(name: Column) -> Column:
    return F.regexp_replace(F.trim(name), r'^(?:`(.*)`|"(.*)"|\[(.*)\])$', "$1$2$3")


def last_part(name: Column) -> Column:
    """The table of schema.table."""
    return unquoted(F.trim(F.element_at(F.split(name, r"\."), -1)))


def table_start(line: Column) -> Column:
    """The table that a CREATE TABLE line opens, else null."""
    rest = F.regexp_replace(F.trim(F.substring(line, 14, 1 << 30)), "^ONLY ", "")
    rest = F.trim(F.regexp_replace(F.trim(rest), "^IF NOT EXISTS ", ""))
    name = last_part(F.trim(F.element_at(F.split(rest, r"\("), 1)))
    return F.when(F.lower(line).startswith("create table ") & (name != ""), name)


def canonical_keyword(definition: Column) -> Column:
    """The canonical keyword of a column definition, null if unknown."""
    text, out = F.trim(F.lower(definition)), None
    for keyword, prefixes in PREFIXES:
        fits = None
        for p in prefixes:
            fits = text.startswith(p) if fits is None else fits | text.startswith(p)
        out = F.when(fits, keyword) if out is None else out.when(fits, keyword)
    return out


def is_array(definition: Column) -> Column:
    text = F.lower(definition)
    for cut in (" default ", " not null", " collate "):
        text = F.substring_index(text, cut, 1)
    return F.regexp_replace(F.trim(text), ",+$", "").endswith("[]")


def keyword_type(keyword: Column, time_zones: bool = True) -> Column:
    """The type of a column keyword as a JSON term. time_zones: datetimes are zone aware."""
    table = {}
    for term, words in KEYWORDS.items():
        text = terms.dumps(term)
        table.update(dict.fromkeys(words.split(), text if time_zones else text.replace("ActiveSupport::TimeWithZone", "Time")))
    return F.coalesce(F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[keyword], F.lit(terms.dumps(terms.UNTYPED)))


def definition_type(definition: Column) -> Column:
    keyword = canonical_keyword(definition)
    base = keyword_type(keyword)
    return F.when(keyword.isNotNull() & is_array(definition), F.concat(F.lit('["array",'), base, F.lit("]"))).otherwise(base)


def column_line(line: Column) -> Column:
    """struct(column, definition) of a line that defines a column, else null."""
    lower = F.lower(line)
    none = line == ""
    for p in NO_COLUMN:
        none = none | lower.startswith(p)
    none = none | lower.startswith("key ") & canonical_keyword(F.substring(lower, 5, 1 << 30)).isNull()
    text = F.regexp_replace(line, ",+$", "")
    quoted = r'^(?:"([^"]*)"|`([^`]*)`|\[([^\]]*)\])\s*(.*)$'
    name = F.when(text.rlike(r'^["`\[]'), F.concat(*[F.regexp_extract(text, quoted, i) for i in (1, 2, 3)])).otherwise(F.regexp_extract(text, r"^(\S+)\s", 1))
    rest = F.when(text.rlike(r'^["`\[]'), F.regexp_extract(text, quoted, 4)).otherwise(F.regexp_extract(text, r"^\S+\s+(.*)$", 1))
    return F.when(~none & (name != ""), F.struct(name.alias("column"), rest.alias("definition")))


def structure_columns(texts: DataFrame) -> DataFrame:
    """file, table, pos, column, type, nullable of CREATE TABLE statements that are closed."""
    rows = lines(texts)
    before = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("closed", F.coalesce(F.sum(F.col("line").startswith(")").cast("int")).over(before), F.lit(0))).withColumn("opens", table_start(F.col("line")))
    part = Window.partitionBy("file", "closed")
    at = F.min(F.when(F.col("opens").isNotNull(), F.struct("pos", "opens"))).over(part)
    rows = rows.withColumn("at", at).withColumn("ends", F.max(F.col("line").startswith(")")).over(part))
    inside = rows.filter(F.col("ends") & (F.col("pos") > F.col("at.pos")) & ~F.col("line").startswith(")"))
    found = inside.withColumn("c", column_line(F.col("line"))).filter("c IS NOT NULL")
    return found.select("file", F.col("at.opens").alias("table"), "pos", "c.column", definition_type(F.col("c.definition")).alias("type"), (~F.lower("c.definition").contains("not null")).alias("nullable"))


def structure_foreign_keys(texts: DataFrame) -> DataFrame:
    """file, table, pos, column, references: the first foreign key over a *_id column after each ALTER TABLE."""
    rows = lines(texts)
    altered = F.when(F.lower("line").startswith("alter table "), last_part(F.regexp_replace(F.trim(F.substring("line", 13, 1 << 30)), "^ONLY ", "")))
    rows = rows.withColumn("altered", altered)
    upto = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    rows = rows.withColumn("table", F.last("altered", ignorenulls=True).over(upto)).withColumn("part", F.count("altered").over(upto))
    line = F.col("line")
    column = unquoted(F.regexp_extract(line, r"FOREIGN KEY \(([^)]*)\)", 1))
    to = last_part(F.trim(F.regexp_extract(line, r"REFERENCES ([^(]*)", 1)))
    keys = rows.filter(line.startswith("ADD CONSTRAINT ") & F.col("table").isNotNull()).select("file", "table", "pos", "part", column.alias("column"), to.alias("references"))
    keys = keys.filter(F.col("column").endswith("_id") & (F.col("references") != ""))
    return keys.withColumn("rank", F.row_number().over(Window.partitionBy("file", "part").orderBy("pos"))).filter("rank = 1").drop("rank", "part")


def checked_not_null(expression: Column) -> Column:
    """The column of a check constraint `x IS NOT NULL`, else null."""
    text = F.regexp_replace(F.trim(expression), r"^[()]+|[()]+$", "")
    name = unquoted(F.element_at(F.split(F.regexp_extract(text, r"(?i)^\s*(\S+)\s+IS\s+NOT\s+NULL\s*$", 1), r"\."), -1))
    return F.when(name.rlike("^[A-Za-z_][A-Za-z0-9_]*$"), name)


def ruby_schema_columns(texts: DataFrame) -> DataFrame:
    """Columns of `create_table` blocks of a Ruby schema, as far as plain lines tell: file, table, pos, column, type, nullable.

    A column is not null with null: false or any default. Every table has an id unless id: false; id: and primary_key: change it.
    """
    rows = lines(texts)
    upto = Window.partitionBy("file").orderBy("pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    opens = F.regexp_extract("line", r"""^create_table\s*\(?\s*["':]([\w.]+)""", 1)
    rows = rows.withColumn("opens", F.when(opens != "", F.struct("pos", opens.alias("table"), F.col("line").alias("text"))))
    rows = rows.withColumn("at", F.last("opens", ignorenulls=True).over(upto)).withColumn("done", F.max(F.when(F.col("line") == "end", F.col("pos"))).over(upto))
    keyed = rows.filter("opens IS NOT NULL")
    text = F.col("at.text")
    id_type = F.regexp_extract(text, r"\bid:\s*:(\w+)", 1)
    ids = keyed.filter(~text.rlike(r"\bid:\s*false")).select(
        "file", F.col("at.table").alias("table"), "pos", F.coalesce(F.nullif(F.regexp_extract(text, r"""primary_key:\s*["':](\w+)""", 1), F.lit("")), F.lit("id")).alias("column"),
        F.when(id_type == "", F.lit(terms.dumps(terms.INTEGER))).otherwise(keyword_type(id_type)).alias("type"), F.lit(False).alias("nullable"),
    )
    inside = rows.filter("opens IS NULL AND at IS NOT NULL AND (done IS NULL OR done < at.pos)")
    kind, name = F.regexp_extract("line", r"^t\.(\w+)", 1), F.regexp_extract("line", r"""^t\.\w+\s*\(?\s*["':](\w+)""", 1)
    plain = inside.filter((kind != "") & (name != "") & ~kind.isin("index", "check_constraint", "references", "belongs_to", "timestamps", "column"))
    nullable = ~F.col("line").rlike(r"\bnull:\s*false") & ~F.col("line").rlike(r"\bdefault:")
    base = keyword_type(kind)
    typed = F.when(F.col("line").rlike(r"\barray:\s*true"), F.concat(F.lit('["array",'), base, F.lit("]"))).otherwise(base)
    columns = plain.select("file", F.col("at.table").alias("table"), "pos", name.alias("column"), typed.alias("type"), nullable.alias("nullable"))
    checks = inside.select("file", F.col("at.table").alias("table"), checked_not_null(F.regexp_extract("line", r"""^t\.check_constraint\s*\(?\s*"([^"]*)""", 1)).alias("column")).filter("column IS NOT NULL").distinct().withColumn("checked", F.lit(True))
    columns = columns.union(ids).join(checks, ["file", "table", "column"], "left")
    return columns.select("file", "table", "pos", "column", "type", (F.col("nullable") & F.col("checked").isNull()).alias("nullable"))


def schema_columns(spark: SparkSession, root: str) -> tuple[DataFrame, DataFrame | None]:
    """Columns and foreign keys of a project: its schema.rb alone if there is one, else its structure.sql."""
    jvm = spark._jvm.org.apache.hadoop.fs
    for name in ("schema.rb", "structure.sql"):
        path = jvm.Path(f"{root}/db/{name}")
        if path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path):
            texts = files(spark, f"{root}/db", name)
            return (ruby_schema_columns(texts), None) if name == "schema.rb" else (structure_columns(texts), structure_foreign_keys(texts))
    raise FileNotFoundError(f"{root}/db has no schema")



"""Library extensions as a rule table: class-level calls, mixins and receivers of known libraries, and the methods they give.

A rule is on a call (its literal names fill {n}), on a mixin, or on a receiver; it is active if one of its marker gems is locked, or if it has none.
The table is joined to facts as a broadcast relation of fixed size; of several rules for one method the first stays.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from glossa.functions import inflect
from glossa.functions import terms as T
from glossa.functions.returns import RELATION_CLASS

MAYBE = lambda t: T.union(t, T.NIL)
JID = MAYBE(T.STRING)
SELF = ("self",)

#: library, marker gems, where (call, block, mixin), trigger, the methods given: (name, return, on the class, parameter). Fixed values.
RULES = [
    ("aasm", ["aasm"], "block", "aasm.state", [("{n}?", T.BOOL, False, None)]),
    ("aasm", ["aasm"], "block", "aasm.event", [("may_{n}?", T.BOOL, False, None), ("{n}", T.BOOL, False, None), ("{n}!", T.BOOL, False, None)]),
    ("state_machines", ["state_machines", "state_machines-activerecord", "state_machines-activemodel"], "call", "state_machine", [("state_machine", T.UNTYPED, True, None), ("{n}_name", T.STRING, False, None)]),
    ("state_machines", ["state_machines", "state_machines-activerecord", "state_machines-activemodel"], "block", "state_machine.state", [("{n}?", T.BOOL, False, None)]),
    ("state_machines", ["state_machines", "state_machines-activerecord", "state_machines-activemodel"], "block", "state_machine.event", [("may_{n}?", T.BOOL, False, None), ("{n}", T.BOOL, False, None), ("{n}!", T.BOOL, False, None)]),
    ("discard", ["discard"], "mixin", "Discard::Model", [(m, T.BOOL, False, None) for m in ("discard", "discard!", "undiscard", "undiscard!", "discarded?", "kept?", "undiscarded?")] + [(m, ("generic", RELATION_CLASS, (SELF,)), True, None) for m in ("kept", "undiscarded", "discarded", "with_discarded")]),
    ("paperclip", ["paperclip"], "call", "has_attached_file", [("{n}", T.UNTYPED, False, None)]),
    ("protobuf", ["google-protobuf", "protobuf"], "call", "optional", [("{n}", T.UNTYPED, False, None), ("{n}=", T.UNTYPED, False, T.UNTYPED)]),
    ("protobuf", ["google-protobuf", "protobuf"], "call", "required", [("{n}", T.UNTYPED, False, None), ("{n}=", T.UNTYPED, False, T.UNTYPED)]),
    ("protobuf", ["google-protobuf", "protobuf"], "call", "repeated", [("{n}", T.array(T.UNTYPED), False, None), ("{n}=", T.array(T.UNTYPED), False, T.array(T.UNTYPED))]),
    *[("identity_cache", ["identity_cache"], "call", c, [("fetch_by_{n}", MAYBE(SELF), True, T.UNTYPED), ("fetch_multi_by_{n}", T.array(SELF), True, T.array(T.UNTYPED))]) for c in ("cache_index", "cache_has_many", "cache_belongs_to")],
    ("active_storage", [], "call", "has_one_attached", [("{n}", T.cls("ActiveStorage::Attached::One"), False, None), ("{n}=", T.cls("ActiveStorage::Attached::One"), False, T.UNTYPED)]),
    ("active_storage", [], "call", "has_many_attached", [("{n}", T.cls("ActiveStorage::Attached::Many"), False, None), ("{n}=", T.cls("ActiveStorage::Attached::Many"), False, T.UNTYPED)]),
    ("action_text", [], "call", "has_rich_text", [("{n}", MAYBE(T.cls("ActionText::RichText")), False, None), ("{n}=", MAYBE(T.cls("ActionText::RichText")), False, T.UNTYPED)]),
    ("action_text", [], "call", "has_many_rich_texts", [("{n}", T.array(T.cls("ActionText::RichText")), False, None), ("{n}=", T.array(T.cls("ActionText::RichText")), False, T.UNTYPED)]),
    *[("active_resource", ["activeresource"], "block", f"schema.{k}", [("{n}", T.UNTYPED, False, None), ("{n}=", T.UNTYPED, False, T.UNTYPED)]) for k in ("string", "integer", "float", "decimal", "boolean", "date", "datetime", "time")],
    *[("sidekiq", ["sidekiq"], "mixin", m, [("perform_async", JID, True, None), ("perform_in", JID, True, None), ("perform_at", JID, True, None), ("perform_bulk", T.array(JID), True, None), ("perform_inline", MAYBE(T.TRUE), True, None), ("perform_sync", MAYBE(T.TRUE), True, None)]) for m in ("Sidekiq::Worker", "Sidekiq::Job")],
    *[("properties", ["config", "json_api_client", "jsonapi-client", "smart_properties"], "call", c, [("{n}", T.UNTYPED, False, None), ("{n}=", T.UNTYPED, False, T.UNTYPED)]) for c in ("setting", "property")],
    ("shrine", ["shrine"], "mixin_argument", "Attachment", [("{n}", MAYBE(T.cls("Shrine::UploadedFile")), False, None), ("{n}=", T.UNTYPED, False, T.union(T.cls("IO"), T.STRING, ("hash", T.UNTYPED, T.UNTYPED))), ("{n}_attacher", T.cls("Shrine::Attacher"), False, None), ("{n}_changed", T.BOOL, False, None), ("{n}_url", T.STRING, False, None)]),
    ("draper", ["draper"], "mixin", "Draper::Decoratable", [("decorate", T.cls("{class}Decorator"), False, None)]),
    *[("graphql", ["graphql", "graphql-ruby"], "call", c, [("{n}", T.UNTYPED, False, None)]) for c in ("field", "argument")],
    ("grape_entity", ["grape-entity", "grape_entity"], "call", "expose", [("{n}", T.UNTYPED, False, None)]),
]
#: Methods that receivers of a library answer: library, gems, receiver (a class, or a pattern with %), on the class, methods by return. Fixed values.
RECEIVERS = [
    ("shellwords", [], "String", False, {T.STRING: ["shellescape"], T.array(T.STRING): ["shellsplit"]}),
    ("rake", ["rake"], "String", False, {T.STRING: ["ext", "pathmap"]}),
    ("gettext", ["fast_gettext", "gettext", "gettext_i18n_rails"], "%", False, {T.STRING: ["_", "s_", "n_", "N_", "Nn_", "ns_", "np_", "np", "p_", "pgettext", "sgettext", "ngettext", "gettext"]}),
    *[("exception", [], f"%{s}", False, {T.STRING: ["message", "to_s", "full_message", "detailed_message", "inspect"], MAYBE(T.array(T.STRING)): ["backtrace"], T.UNTYPED: ["backtrace_locations", "cause", "exception", "record"]}) for s in ("Error", "Exception", "Invalid", "NotFound", "NotUnique", "Timeout")],
    ("sidekiq", ["sidekiq"], "Sidekiq", True, {T.cls("Logger"): ["logger"], T.UNTYPED: ["configure_server", "configure_client", "redis", "redis_pool", "options", "strict_args!", "default_job_options", "default_configuration", "server_middleware", "client_middleware", "schedule", "set_schedule"]}),
    *[("sidekiq", ["sidekiq"], f"%{s}", False, {T.cls("Logger"): ["logger"], JID: ["jid"], T.UNTYPED: ["bid"]}) for s in ("Worker", "Job")],
    *[("devise", ["devise"], f"%{s}", False, {T.UNTYPED: ["sign_in", "sign_out", "bypass_sign_in", "sign_in_and_redirect", "sign_out_and_redirect", "stored_location_for", "after_sign_in_path_for", "after_sign_out_path_for"]}) for s in ("Controller", "Helper", "Mailer")],
    ("doorkeeper", ["doorkeeper"], "%Controller", False, {T.UNTYPED: ["doorkeeper_authorize!", "doorkeeper_render_error", "doorkeeper_token"], T.BOOL: ["valid_doorkeeper_token?"]}),
    ("rack_attack", ["rack-attack"], "Rack::Attack::Request", False, {T.UNTYPED: ["params"]}),
    ("oj", ["oj"], "Oj", True, {T.STRING: ["dump", "generate"], T.UNTYPED: ["load", "safe_load", "compat_load", "strict_load"]}),
    *[("ams", ["active_model_serializers"], f"%{s}", False, {T.UNTYPED: ["object", "scope", "current_user", "instance_options", "serialization_options", "root", "read_attribute_for_serialization"]}) for s in ("Serializer",)],
    *[("declarative_policy", ["declarative_policy"], f"%{s}", own, {T.cls("DeclarativePolicy::RuleDsl"): ["rule"], T.BOOL: ["can?", "cannot?"], T.UNTYPED: ["condition", "desc", "with_options", "with_scope", "with_score", "enable", "prevent", "prevent_all", "policy", "overrides", "include_subject"]}) for s in ("Policy",) for own in (False, True)],
    *[("grape", ["grape"], f"%{s}", own, {T.UNTYPED: ["params", "current_user", "status", "header", "headers", "body", "declared", "present", "redirect", "route", "request", "env", "version", "cookies", "content_type", "sendfile", "stream", "return_no_content", "configuration", "get", "post", "put", "patch", "delete", "head", "mount"]}) for s in ("API",) for own in (False, True)],
    *[("rails_configure", [], c, False, {T.UNTYPED: ["configure", "credentials", "secrets", "config_for", "routes", "reload_routes!", "eager_load!", "initialize!"], T.cls("Rails::Application::Configuration"): ["config"]}) for c in ("Rails::Application", "Application")],
    *[("migration", [], c, False, {T.UNTYPED: ["create_table", "create_join_table", "drop_table", "drop_join_table", "change_table", "rename_table", "add_column", "remove_column", "remove_columns", "change_column", "change_column_default", "change_column_null", "rename_column", "add_index", "remove_index", "rename_index", "add_reference", "remove_reference", "add_belongs_to", "remove_belongs_to", "add_foreign_key", "remove_foreign_key", "add_check_constraint", "remove_check_constraint", "add_timestamps", "remove_timestamps", "enable_extension", "disable_extension", "execute", "reversible", "revert", "up_only", "say", "say_with_time", "suppress_messages"]}) for c in ("ActiveRecord::Migration", "%Migration")],
    ("settingslogic", ["settingslogic"], "Settingslogic", True, {T.UNTYPED: ["source", "namespace", "load!", "reload!", "get"]}),
]


def markers(spark) -> DataFrame:
    """library, gem."""
    return spark.createDataFrame(sorted({(lib, g) for lib, gems, *_ in [*RULES, *RECEIVERS] for g in gems}), "library string, gem string")


def _rules(spark, where: list[str], active: DataFrame | None) -> DataFrame:
    rows = [(k, lib, bool(gems), at, trigger, name, T.dumps(t), own, T.dumps(p) if p else None) for k, (lib, gems, at, trigger, made) in enumerate(RULES) if at in where for name, t, own, p in made]
    table = spark.createDataFrame(rows, "priority int, library string, needs boolean, at string, trigger string, name string, ret string, singleton boolean, param string")
    if active is None:
        return table
    return table.filter("NOT needs").unionByName(table.filter("needs").join(active.select("library").distinct(), "library", "left_semi").select(*table.columns))


def _first(rows: DataFrame) -> DataFrame:
    key = ["class", "name", "singleton"]
    kept = [c for c in rows.columns if c not in key]
    return rows.groupBy(*key).agg(F.min_by(F.struct(*kept), "priority").alias("m")).select(*key, "m.param", "m.ret", F.lit("synthetic_dsl").alias("origin"), "m.file", "m.line")


def extension_methods(calls: DataFrame, mixins: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """METHODS that extensions give. calls: class, method (inside a block: outer.inner), names, file, line; mixins: class, module, file, line.

    active: libraries whose rules hold (null: all). Where a type says self, it is the class. A mixin may come with an argument, as Uploader::Attachment(:image)
    does: its module is then Uploader::Attachment, and the call's names are the argument.
    """
    spark = calls.sparkSession
    named = calls.select("class", "method", "names", "file", "line").withColumn("n", F.explode_outer("names")).join(F.broadcast(_rules(spark, ["call", "block"], active)), F.col("method") == F.col("trigger"))
    named = named.filter(F.col("n").isNotNull()).withColumn("name", F.replace("name", F.lit("{n}"), F.col("n")))
    mixed = mixins.select("class", "module", "file", "line").join(F.broadcast(_rules(spark, ["mixin"], active)), F.col("module") == F.col("trigger"))
    given = calls.filter("method = 'include'").select("class", "names", "file", "line", F.explode("names").alias("module")).filter(F.col("module").rlike(r"::[A-Z]\w*\("))
    given = given.withColumn("trigger", F.regexp_extract("module", r"::([A-Z]\w*)\(", 1)).withColumn("n", F.regexp_extract("module", r"\(:?[\"']?(\w+)", 1)).select("class", "trigger", "n", "file", "line")
    argued = given.join(F.broadcast(_rules(spark, ["mixin_argument"], active)), "trigger").withColumn("name", F.replace("name", F.lit("{n}"), F.col("n")))
    columns = ["class", "name", "singleton", "param", "ret", "priority", "file", "line"]
    rows = named.select(*columns).unionByName(mixed.select(*columns)).unionByName(argued.select(*columns))
    rows = rows.withColumn("ret", F.replace("ret", F.lit("{class}"), F.col("class")))
    own = F.concat(F.lit('["class","'), "class", F.lit('"]'))
    return _first(rows.withColumn("ret", F.replace("ret", F.lit('["self"]'), own)))


def typed_lists(calls: DataFrame, active: bool = True) -> DataFrame:
    """kredis_list :names and the like: accessors of Kredis::Types::List."""
    rows = calls.filter(F.col("method").startswith("kredis_") & F.lit(active)).withColumn("n", F.explode("names"))
    kind = F.array_join(F.transform(F.split(F.regexp_replace("method", "^kredis_", ""), "_"), lambda p: inflect.camelize(p)), "")
    t = F.concat(F.lit('["class","Kredis::Types::'), kind, F.lit('"]'))
    made = rows.withColumn("m", F.explode(F.array(F.struct(F.col("n").alias("name"), F.lit(None).cast("string").alias("param")), F.struct(F.concat("n", F.lit("=")).alias("name"), t.alias("param")))))
    return made.select("class", "m.name", F.lit(False).alias("singleton"), "m.param", t.alias("ret"), F.lit("synthetic_dsl").alias("origin"), "file", "line")


def scope_helpers(scopes: DataFrame, controllers: DataFrame) -> DataFrame:
    """current_x, x_signed_in?, authenticate_x!, x_session on controllers for every scope (scope) that logs in."""
    s = F.col("scope")
    model = F.concat(F.lit('["union",[["class","'), F.array_join(F.transform(F.split(s, "_"), lambda p: inflect.camelize(p)), ""), F.lit('"],["nil"]]]'))
    untyped = F.lit('["untyped"]')
    made = F.array(*[F.struct(n.alias("name"), t.alias("ret")) for n, t in [(F.concat(F.lit("current_"), s), model), (F.concat(s, F.lit("_signed_in?")), F.lit('["bool"]')), (F.concat(F.lit("authenticate_"), s, F.lit("!")), untyped), (F.concat(s, F.lit("_session")), untyped)]])
    rows = controllers.select("class").distinct().crossJoin(scopes.select("scope").distinct()).withColumn("m", F.explode(made))
    return rows.select("class", "m.name", F.lit(False).alias("singleton"), F.lit(None).cast("string").alias("param"), "m.ret", F.lit("synthetic_dsl").alias("origin"), F.lit(None).cast("string").alias("file"), F.lit(None).cast("int").alias("line"))


def receiver_returns(calls: DataFrame, active: DataFrame | None = None) -> DataFrame:
    """calls (site_id, class, name, singleton) with ret, where a library's rule answers them."""
    rows = [(k, lib, bool(gems), receiver, own, m, T.dumps(t)) for k, (lib, gems, receiver, own, by) in enumerate(RECEIVERS) for t, ms in by.items() for m in ms]
    table = calls.sparkSession.createDataFrame(rows, "priority int, library string, needs boolean, receiver string, own boolean, member string, ret string")
    if active is not None:
        table = table.filter("NOT needs").unionByName(table.filter("needs").join(active.select("library").distinct(), "library", "left_semi").select(*table.columns))
    met = calls.join(F.broadcast(table), (F.col("name") == F.col("member")) & (F.col("singleton") == F.col("own")))
    fits = (F.col("class") == F.col("receiver")) | F.col("receiver").startswith("%") & F.endswith("class", F.substring("receiver", 2, 200))
    return met.filter(fits).groupBy("site_id").agg(F.min_by("ret", "priority").alias("ret"))



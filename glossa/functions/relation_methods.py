"""What Active Record's query methods return, by method and kind of receiver.

An answer is named for what it is in terms of the receiver's model; ANSWERS has its term, with ("model",), ("relation",) and ("primary_key",) to be put in.
"""

from __future__ import annotations

from glossa.functions import terms as T

RELATION, MODEL, KEY = ("relation",), ("model",), ("primary_key",)
ANSWERS = {
    "batches": T.cls("ActiveRecord::Batches::BatchEnumerator"),
    "bool": T.BOOL,
    "each batch": ("generic", "Enumerator", (T.array(MODEL),)),
    "each model": ("generic", "Enumerator", (MODEL,)),
    "integer": T.INTEGER,
    "keys": T.array(KEY),
    "model": MODEL,
    "model or nil": T.union(MODEL, T.NIL),
    "models": T.array(MODEL),
    "promise": ("generic", "ActiveRecord::Promise", (T.UNTYPED,)),
    "promise of integer": ("generic", "ActiveRecord::Promise", (T.INTEGER,)),
    "promise of keys": ("generic", "ActiveRecord::Promise", (T.array(KEY),)),
    "relation": RELATION,
    "untyped": T.UNTYPED,
    "value or nil": T.UNTYPED,
    "values": T.array(T.UNTYPED),
}
#: One row for each method of the public API, by name: its answer, the receivers that have it, the first version, what a block makes of it (the same; the records are
#: searched instead; anything), and what its arguments or its chain refine. Fixed values.
RELATION_METHODS = [
    ("<<", "relation", "proxy", (0, 0), "same", ""),
    ("all", "relation", "model relation proxy", (0, 0), "same", ""),
    ("and", "relation", "model relation proxy", (6, 1), "same", ""),
    ("annotate", "relation", "model relation proxy", (6, 0), "same", ""),
    ("any?", "bool", "model relation proxy", (0, 0), "records", ""),
    ("append", "relation", "proxy", (0, 0), "same", ""),
    ("associated", "relation", "relation proxy", (7, 0), "same", ""),
    ("async_average", "promise", "model relation proxy", (7, 1), "same", ""),
    ("async_count", "promise of integer", "model relation proxy", (7, 1), "same", ""),
    ("async_ids", "promise of keys", "model relation proxy", (7, 1), "same", ""),
    ("async_maximum", "promise", "model relation proxy", (7, 1), "same", ""),
    ("async_minimum", "promise", "model relation proxy", (7, 1), "same", ""),
    ("async_pick", "promise", "model relation proxy", (7, 1), "same", ""),
    ("async_pluck", "promise", "model relation proxy", (7, 1), "same", ""),
    ("async_sum", "promise", "model relation proxy", (7, 1), "same", ""),
    ("average", "untyped", "model relation proxy", (0, 0), "same", "groups"),
    ("build", "model", "model relation proxy", (0, 0), "same", ""),
    ("calculate", "untyped", "model relation proxy", (0, 0), "same", "groups"),
    ("concat", "relation", "proxy", (0, 0), "same", ""),
    ("count", "integer", "model relation proxy", (0, 0), "records", "groups"),
    ("create", "model", "model relation proxy", (0, 0), "same", ""),
    ("create!", "model", "model relation proxy", (0, 0), "same", ""),
    ("create_or_find_by", "model", "model relation proxy", (6, 0), "same", ""),
    ("create_or_find_by!", "model", "model relation proxy", (6, 0), "same", ""),
    ("create_with", "relation", "model relation proxy", (0, 0), "same", ""),
    ("delete", "models", "proxy", (0, 0), "same", ""),
    ("delete", "integer", "relation", (0, 0), "same", ""),
    ("delete_all", "integer", "model relation proxy", (0, 0), "same", ""),
    ("delete_by", "integer", "model relation proxy", (6, 0), "same", ""),
    ("destroy", "models", "proxy", (0, 0), "same", ""),
    ("destroy", "model", "relation", (0, 0), "same", ""),
    ("destroy_all", "models", "model relation proxy", (0, 0), "same", ""),
    ("destroy_by", "models", "model relation proxy", (6, 0), "same", ""),
    ("distinct", "relation", "model relation proxy", (0, 0), "same", ""),
    ("distinct!", "relation", "relation proxy", (0, 0), "same", ""),
    ("each_batch", "untyped", "relation proxy", (0, 0), "same", ""),
    ("eager_load", "relation", "model relation proxy", (0, 0), "same", ""),
    ("empty?", "bool", "relation proxy", (0, 0), "same", ""),
    ("except", "relation", "model relation proxy", (0, 0), "same", ""),
    ("excluding", "relation", "model relation proxy", (7, 0), "same", ""),
    ("exists?", "bool", "model relation proxy", (0, 0), "same", ""),
    ("explain", "untyped", "relation proxy", (0, 0), "same", ""),
    ("extending", "relation", "model relation proxy", (0, 0), "same", ""),
    ("fifth", "model or nil", "model relation proxy", (0, 0), "same", ""),
    ("fifth!", "model", "model relation proxy", (0, 0), "same", ""),
    ("find", "model", "model relation proxy", (0, 0), "records", "ids"),
    ("find_by", "model or nil", "model relation proxy", (0, 0), "same", ""),
    ("find_by!", "model", "model relation proxy", (0, 0), "same", ""),
    ("find_each", "each model", "model relation proxy", (0, 0), "anything", ""),
    ("find_in_batches", "each batch", "model relation proxy", (0, 0), "anything", ""),
    ("find_or_create_by", "model", "model relation proxy", (0, 0), "same", ""),
    ("find_or_create_by!", "model", "model relation proxy", (0, 0), "same", ""),
    ("find_or_initialize_by", "model", "model relation proxy", (0, 0), "same", ""),
    ("find_sole_by", "model", "model relation proxy", (6, 1), "same", ""),
    ("first", "model or nil", "model relation proxy", (0, 0), "same", "limit"),
    ("first!", "model", "model relation proxy", (0, 0), "same", ""),
    ("first_or_create", "model", "model relation proxy", (0, 0), "same", ""),
    ("first_or_create!", "model", "model relation proxy", (0, 0), "same", ""),
    ("first_or_initialize", "model", "model relation proxy", (0, 0), "same", ""),
    ("forty_two", "model or nil", "model relation proxy", (0, 0), "same", ""),
    ("forty_two!", "model", "model relation proxy", (0, 0), "same", ""),
    ("fourth", "model or nil", "model relation proxy", (0, 0), "same", ""),
    ("fourth!", "model", "model relation proxy", (0, 0), "same", ""),
    ("from", "relation", "model relation proxy", (0, 0), "same", ""),
    ("group", "relation", "model relation proxy", (0, 0), "same", ""),
    ("having", "relation", "model relation proxy", (0, 0), "same", ""),
    ("ids", "keys", "model relation proxy", (0, 0), "same", ""),
    ("in_batches", "batches", "model relation proxy", (0, 0), "anything", ""),
    ("in_order_of", "relation", "model relation proxy", (7, 0), "same", ""),
    ("in_order_of_count", "integer", "relation proxy", (0, 0), "same", ""),
    ("include?", "bool", "model relation proxy", (0, 0), "same", ""),
    ("includes", "relation", "model relation proxy", (0, 0), "same", ""),
    ("insert", "untyped", "relation proxy", (6, 0), "same", ""),
    ("insert!", "untyped", "relation proxy", (6, 0), "same", ""),
    ("insert_all", "untyped", "relation proxy", (6, 0), "same", ""),
    ("insert_all!", "untyped", "relation proxy", (6, 0), "same", ""),
    ("invert_where", "relation", "model relation proxy", (7, 0), "same", ""),
    ("joins", "relation", "model relation proxy", (0, 0), "same", ""),
    ("last", "model or nil", "model relation proxy", (0, 0), "same", "limit"),
    ("last!", "model", "model relation proxy", (0, 0), "same", ""),
    ("left_joins", "relation", "model relation proxy", (0, 0), "same", ""),
    ("left_outer_joins", "relation", "model relation proxy", (0, 0), "same", ""),
    ("limit", "relation", "model relation proxy", (0, 0), "same", ""),
    ("load", "relation", "relation proxy", (0, 0), "same", ""),
    ("load_async", "relation", "relation proxy", (7, 0), "same", ""),
    ("loaded?", "bool", "relation proxy", (0, 0), "same", ""),
    ("lock", "relation", "model relation proxy", (0, 0), "same", ""),
    ("many?", "bool", "model relation proxy", (0, 0), "records", ""),
    ("maximum", "value or nil", "model relation proxy", (0, 0), "same", "column, groups"),
    ("member?", "bool", "model relation proxy", (0, 0), "same", ""),
    ("merge", "relation", "model relation proxy", (0, 0), "same", ""),
    ("merge!", "relation", "relation proxy", (0, 0), "same", ""),
    ("minimum", "value or nil", "model relation proxy", (0, 0), "same", "column, groups"),
    ("missing", "relation", "relation proxy", (6, 1), "same", ""),
    ("new", "model", "model relation proxy", (0, 0), "same", ""),
    ("none", "relation", "model relation proxy", (0, 0), "same", ""),
    ("none?", "bool", "model relation proxy", (0, 0), "records", ""),
    ("not", "relation", "relation proxy", (0, 0), "same", ""),
    ("offset", "relation", "model relation proxy", (0, 0), "same", ""),
    ("one?", "bool", "model relation proxy", (0, 0), "records", ""),
    ("only", "relation", "model relation proxy", (0, 0), "same", ""),
    ("optimizer_hints", "relation", "model relation proxy", (6, 0), "same", ""),
    ("or", "relation", "model relation proxy", (0, 0), "same", ""),
    ("order", "relation", "model relation proxy", (0, 0), "same", ""),
    ("pick", "value or nil", "model relation proxy", (6, 0), "same", "column"),
    ("pluck", "values", "model relation proxy", (0, 0), "same", "columns"),
    ("preload", "relation", "model relation proxy", (0, 0), "same", ""),
    ("push", "relation", "proxy", (0, 0), "same", ""),
    ("readonly", "relation", "model relation proxy", (0, 0), "same", ""),
    ("records", "models", "relation proxy", (0, 0), "same", ""),
    ("references", "relation", "model relation proxy", (0, 0), "same", ""),
    ("regroup", "relation", "model relation proxy", (7, 1), "same", ""),
    ("reload", "relation", "relation proxy", (0, 0), "same", ""),
    ("reorder", "relation", "model relation proxy", (0, 0), "same", ""),
    ("replace", "untyped", "proxy", (0, 0), "same", ""),
    ("reselect", "relation", "model relation proxy", (6, 0), "same", ""),
    ("reset", "relation", "relation proxy", (0, 0), "same", ""),
    ("reverse_order", "relation", "model relation proxy", (0, 0), "same", ""),
    ("rewhere", "relation", "model relation proxy", (0, 0), "same", ""),
    ("scoping", "untyped", "relation proxy", (0, 0), "same", ""),
    ("second", "model or nil", "model relation proxy", (0, 0), "same", ""),
    ("second!", "model", "model relation proxy", (0, 0), "same", ""),
    ("second_to_last", "model or nil", "model relation proxy", (0, 0), "same", ""),
    ("second_to_last!", "model", "model relation proxy", (0, 0), "same", ""),
    ("select", "relation", "model relation proxy", (0, 0), "records", ""),
    ("size", "integer", "relation proxy", (0, 0), "same", ""),
    ("skip_query_cache", "relation", "relation proxy", (0, 0), "same", ""),
    ("sole", "model", "model relation proxy", (6, 1), "same", ""),
    ("strict_loading", "relation", "model relation proxy", (6, 1), "same", ""),
    ("sum", "untyped", "model relation proxy", (0, 0), "records", "groups"),
    ("take", "model or nil", "model relation proxy", (0, 0), "same", "limit"),
    ("take!", "model", "model relation proxy", (0, 0), "same", ""),
    ("third", "model or nil", "model relation proxy", (0, 0), "same", ""),
    ("third!", "model", "model relation proxy", (0, 0), "same", ""),
    ("third_to_last", "model or nil", "model relation proxy", (0, 0), "same", ""),
    ("third_to_last!", "model", "model relation proxy", (0, 0), "same", ""),
    ("to_a", "models", "relation proxy", (0, 0), "same", ""),
    ("to_ary", "models", "relation proxy", (0, 0), "same", ""),
    ("touch_all", "integer", "model relation proxy", (6, 0), "same", ""),
    ("unscope", "relation", "model relation proxy", (0, 0), "same", ""),
    ("unscoped", "relation", "model relation proxy", (0, 0), "anything", ""),
    ("update_all", "integer", "model relation proxy", (0, 0), "same", ""),
    ("upsert", "untyped", "relation proxy", (6, 0), "same", ""),
    ("upsert_all", "untyped", "relation proxy", (6, 0), "same", ""),
    ("where", "relation", "model relation proxy", (0, 0), "same", ""),
    ("with", "relation", "model relation proxy", (7, 1), "same", ""),
    ("with_recursive", "relation", "model relation proxy", (7, 2), "same", ""),
    ("without", "relation", "model relation proxy", (7, 0), "same", ""),
]

"""What class-body macros of Ruby and its libraries declare, and which names are not a project's own.

Each framework is plain rows.  A macro's ``makes`` are patterns of the methods it declares for an operand:
``#`` an instance's, ``.`` the class's, ``{}`` the operand, ``{one}`` the operand in the singular; a pattern
without braces is made once, whatever the operands.  ``operands`` says which arguments count: all leading
symbols (None), the first, those after the first, or the literal name.  ``links`` says what else the macro
refers to.  A framework with ``gems`` counts only in projects that declare one of them.
"""

from __future__ import annotations


def _macro(category: str, *makes: str, operands: str | None = None, links: str | None = None) -> dict:
    return {"category": category, "makes": list(makes), "operands": operands, "links": links}


_PAIR = ("#{}", "#{}=")
_CLASS_PAIR = (".{}", ".{}=")
_MANY = ("#{}", "#{}=", "#{one}_ids", "#{one}_ids=")
_ONE = ("#{}", "#{}=", "#build_{}", "#create_{}")
_UPLOADER = ("#{}", "#{}=", "#{}?", "#remove_{}", "#remove_{}=", "#remove_{}?", "#{}_cache", "#{}_cache=")
_CALLBACK = _macro("callback", links="own-method")
_VALIDATION = _macro("validation")
_ROUTE, _SCOPING = _macro("other", links="route"), _macro("other")
_CHECK, _RULE = _macro("other", links="ability"), _macro("other", links="ability-subject")

KERNEL = [
    "puts", "print", "p", "pp", "warn", "printf", "sprintf", "format", "gets", "raise", "fail", "throw", "catch", "loop", "exit", "exit!", "abort", "at_exit", "proc", "lambda", "block_given?", "caller", "binding", "__method__", "__callee__",
    "require", "require_relative", "load", "autoload", "sleep", "rand", "srand", "system", "exec", "Integer", "Float", "String", "Array", "Hash", "Rational", "Complex", "freeze", "frozen?", "dup", "clone", "tap", "then", "itself", "object_id", "hash",
    "inspect", "to_s", "to_proc", "send", "public_send", "__send__", "respond_to?", "instance_variable_get", "instance_variable_set", "instance_variables", "instance_of?", "is_a?", "kind_of?", "nil?", "methods", "class", "singleton_class",
    "define_singleton_method", "extend", "display",
]
COLLECTIONS = [
    "each", "each_with_index", "each_with_object", "each_entry", "each_slice", "each_cons", "each_pair", "each_key", "each_value", "each_index", "each_char", "each_line", "each_byte", "times", "upto", "downto", "step", "cycle", "lazy", "map", "map!",
    "collect", "collect_concat", "flat_map", "select", "select!", "filter", "filter_map", "reject", "reject!", "detect", "find", "find_all", "find_index", "reduce", "inject", "sum", "min", "max", "min_by", "max_by", "minmax", "sort", "sort!", "sort_by",
    "group_by", "partition", "chunk_while", "slice_when", "zip", "take", "take_while", "drop", "drop_while", "tally", "to_a", "to_h", "any?", "all?", "none?", "one?", "empty?", "include?", "member?", "cover?", "between?", "clamp", "first", "last", "push",
    "pop", "shift", "unshift", "append", "concat", "insert", "fill", "index", "at", "dig", "fetch", "store", "slice", "slice!", "values_at", "keys", "values", "key", "key?", "has_key?", "has_value?", "value?", "invert", "merge", "merge!", "delete_if",
    "keep_if", "except", "transform_keys", "transform_values", "clear", "count", "size", "length", "flatten", "flatten!", "compact", "compact!", "uniq", "uniq!", "reverse", "reverse!", "rotate", "sample", "shuffle", "transpose", "assoc", "join", "split",
    "strip", "strip!", "chomp", "chop", "upcase", "downcase", "capitalize", "swapcase", "gsub", "gsub!", "sub", "sub!", "tr", "squeeze", "scan", "match", "match?", "start_with?", "end_with?", "ljust", "rjust", "center", "chars", "bytes", "lines",
    "bytesize", "casecmp", "casecmp?", "encode", "force_encoding", "unpack", "unpack1", "intern", "succ", "ord", "hex", "oct", "to_i", "to_f", "to_r", "to_c", "to_sym", "to_str", "round", "ceil", "floor", "truncate", "abs", "divmod", "modulo", "pow",
    "coerce", "zero?", "positive?", "negative?", "even?", "odd?", "finite?", "infinite?", "nan?",
]
RAILS_RUNTIME = [
    "params", "render", "redirect_to", "redirect_back", "head", "respond_to", "respond_with", "flash", "session", "cookies", "request", "response", "url_for", "polymorphic_url", "send_data", "send_file", "expires_in", "expires_now", "fresh_when", "stale?",
    "http_cache_forever", "helper_method", "layout", "rescue_from", "t", "l", "logger",
]
RECORD_MEMBERS = [
    "id", "to_param", "persisted?", "new_record?", "destroyed?", "attributes", "attribute_names", "errors", "update", "update!", "update_attribute", "update_attributes", "update_column", "update_columns", "destroy", "destroy!", "delete", "touch",
    "increment!", "decrement!", "reload", "becomes", "to_json", "to_xml",
]
COLUMN_TYPES = {
    "string": "String", "text": "String", "citext": "String", "uuid": "String", "inet": "String", "integer": "Integer", "bigint": "Integer", "serial": "Integer", "float": "Float", "decimal": "BigDecimal", "datetime": "Time", "timestamp": "Time",
    "timestamptz": "Time", "date": "Date", "json": "Hash", "jsonb": "Hash", "hstore": "Hash",
}
#: Methods that a database column gives its model.
COLUMN_MAKES = ("#{}", "#{}=", "#{}?")

FRAMEWORKS: list[dict] = [
    {
        "framework": "ruby-core", "builtins": KERNEL, "ambiguous": KERNEL + COLLECTIONS, "instances": ["new"],
        "macros": {
            "attr_accessor": _macro("accessor", *_PAIR), "attr_reader": _macro("accessor", "#{}"), "attr_writer": _macro("accessor", "#{}="), "define_method": _macro("dynamic-method", "#{}", operands="name"),
            "alias_method": _macro("alias", "#{}", operands="first", links="second-symbol"), "alias": _macro("alias", "#{}", operands="first", links="second-symbol"), "include": _macro("include"), "extend": _macro("include"), "prepend": _macro("include"),
        },
    },
    {
        "framework": "activesupport",
        "macros": {
            "cattr_accessor": _macro("accessor", *_CLASS_PAIR), "cattr_reader": _macro("accessor", ".{}"), "cattr_writer": _macro("accessor", ".{}="), "mattr_accessor": _macro("accessor", *_CLASS_PAIR), "mattr_reader": _macro("accessor", ".{}"),
            "mattr_writer": _macro("accessor", ".{}="), "delegate": _macro("delegation", "#{}", links="delegate"), "delegate_missing_to": _macro("delegation"), "class_attribute": _macro("accessor", *_PAIR, "#{}?"), "included": _macro("concern-hook"),
            "extended": _macro("concern-hook"), "class_methods": _macro("concern-hook"),
        },
    },
    {
        "framework": "rails", "builtins": RAILS_RUNTIME,
        "macros": {
            "has_many": _macro("association", *_MANY, links="model"), "has_one": _macro("association", *_ONE, links="model"), "has_and_belongs_to_many": _macro("association", *_MANY, links="model"),
            "belongs_to": _macro("association", *_ONE, "#{}_id", "#{}_id=", links="model"), "attribute": _macro("accessor", *_PAIR, operands="first"), "has_one_attached": _macro("accessor", *_PAIR), "has_many_attached": _macro("accessor", *_PAIR),
            "validates": _VALIDATION, "validates_with": _VALIDATION, "validate": _VALIDATION, "validates_each": _VALIDATION, "validates_associated": _VALIDATION, "validates_acceptance_of": _VALIDATION, "validates_confirmation_of": _VALIDATION,
            "validates_exclusion_of": _VALIDATION, "validates_format_of": _VALIDATION, "validates_inclusion_of": _VALIDATION, "validates_length_of": _VALIDATION, "validates_numericality_of": _VALIDATION, "validates_presence_of": _VALIDATION,
            "validates_uniqueness_of": _VALIDATION, "scope": _macro("scope", ".{}", operands="first"), "before_validation": _CALLBACK, "after_validation": _CALLBACK, "before_save": _CALLBACK, "after_save": _CALLBACK, "around_save": _CALLBACK,
            "before_create": _CALLBACK, "after_create": _CALLBACK, "around_create": _CALLBACK, "before_update": _CALLBACK, "after_update": _CALLBACK, "around_update": _CALLBACK, "before_destroy": _CALLBACK, "after_destroy": _CALLBACK,
            "around_destroy": _CALLBACK, "after_commit": _CALLBACK, "after_rollback": _CALLBACK, "after_initialize": _CALLBACK, "after_find": _CALLBACK, "after_touch": _CALLBACK, "before_action": _CALLBACK, "after_action": _CALLBACK,
            "around_action": _CALLBACK, "before_filter": _CALLBACK, "after_filter": _CALLBACK, "around_filter": _CALLBACK, "skip_before_action": _CALLBACK, "skip_after_action": _CALLBACK, "skip_around_action": _CALLBACK,
            "accepts_nested_attributes_for": _macro("nested-attrs", "#{}_attributes="), "enum": _macro("enum"), "serialize": _macro("other"), "store_accessor": _macro("accessor", *_PAIR, operands="rest"),
        },
    },
    {"framework": "sidekiq", "macros": {}, "enqueue": {"perform_async": "perform", "perform_in": "perform", "perform_at": "perform", "perform_bulk": "perform", "push_bulk": "perform"}},
    {"framework": "pundit", "macros": {"authorize": _macro("other", links="policy")}},
    {
        "framework": "routing",
        "macros": {
            "get": _ROUTE, "post": _ROUTE, "put": _ROUTE, "patch": _ROUTE, "delete": _ROUTE, "match": _ROUTE, "root": _ROUTE, "namespace": _SCOPING, "resources": _SCOPING, "resource": _SCOPING, "collection": _SCOPING, "member": _SCOPING,
            "constraints": _SCOPING, "mount": _SCOPING, "direct": _SCOPING, "resolve": _SCOPING, "draw": _SCOPING, "concern": _SCOPING, "devise_for": _SCOPING, "devise_scope": _SCOPING, "authenticated": _SCOPING, "unauthenticated": _SCOPING,
            "redirect": _SCOPING,
        },
    },
    {"framework": "dry", "gems": ["dry-validation", "dry-schema", "dry-struct", "dry-initializer"], "builtins": ["filled", "maybe", "rule"], "macros": {"param": _macro("accessor", "#{}", operands="first"), "option": _macro("accessor", "#{}", operands="first")}},
    {"framework": "chewy", "gems": ["chewy"], "builtins": ["crutch", "template", "agg", "update_index"], "macros": {}},
    {"framework": "active_model_serializers", "gems": ["active_model_serializers"], "macros": {"attributes": _macro("accessor", links="serialized")}},
    {"framework": "carrierwave", "gems": ["carrierwave"], "macros": {"mount_uploader": _macro("accessor", *_UPLOADER, operands="first"), "mount_uploaders": _macro("accessor", *_UPLOADER, operands="first")}},
    {"framework": "aasm", "gems": ["aasm"], "macros": {"aasm": _macro("state-machine")}, "structured": ["aasm"]},
    {"framework": "paper_trail", "gems": ["paper_trail"], "macros": {"has_paper_trail": _macro("dynamic-method", "#versions", "#version_at", "#paper_trail")}},
    {"framework": "geocoder", "gems": ["geocoder"], "macros": {"geocoded_by": _macro("dynamic-method", "#geocode"), "reverse_geocoded_by": _macro("dynamic-method", "#reverse_geocode")}},
    {"framework": "state_machines", "gems": ["state_machines", "state_machine"], "macros": {"state_machine": _macro("state-machine")}, "structured": ["state_machine"]},
    {
        "framework": "cancancan", "gems": ["cancancan", "cancan"],
        "macros": {"authorize!": _CHECK, "can?": _CHECK, "cannot?": _CHECK, "authorize_resource": _CHECK, "load_and_authorize_resource": _CHECK, "can": _RULE, "cannot": _RULE, "skip_authorization_check": _macro("other")},
    },
    {"framework": "devise", "gems": ["devise"], "macros": {"devise": _macro("other")}, "receiver_prefixes": ["current_"]},
    {
        "framework": "draper", "gems": ["draper"],
        "macros": {"delegate_all": _macro("delegation"), "decorates": _macro("other", operands="first"), "decorates_association": _macro("association", "#{}", operands="first"), "decorates_associations": _macro("association", "#{}")},
    },
    {"framework": "kaminari", "gems": ["kaminari", "kaminari-activerecord"], "macros": {"paginates_per": _macro("other"), "max_paginates_per": _macro("other")}, "relations": ["page", "per", "padding", "without_count"]},
    {"framework": "ransack", "gems": ["ransack"], "macros": {"ransacker": _macro("other")}, "relations": ["ransack", "result"]},
    {"framework": "will_paginate", "gems": ["will_paginate"], "macros": {}, "relations": ["paginate", "page", "per_page"]},
]


def active(gems: set[str] | None = None) -> list[dict]:
    """The frameworks of a project that declares these gems; None means all.  A macro belongs to one framework."""
    out = [f for f in FRAMEWORKS if gems is None or "gems" not in f or gems & set(f["gems"])]
    names = [m for f in out for m in f["macros"]]
    if len(names) != len(set(names)):
        raise ValueError("a macro is declared by two frameworks")
    return out

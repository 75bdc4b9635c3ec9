"""Class-body macros: what they declare, what they refer to, and which frameworks count."""

import pytest
from pyspark.sql import functions as F

from skarn.operators import dispatch, macros
from skarn.plans import ruby_vocabulary as V


def calls(spark, *rows):
    return spark.createDataFrame([(k, "a.rb", scope, macro, args) for k, (scope, macro, args) in enumerate(rows)], f"call_id bigint, rel_path string, scope string, macro string, args {macros.ARGS}")


def sym(*names):
    return [("symbol", n) for n in names]


def test_declared_methods(spark):
    c = calls(
        spark, ("User", "attr_accessor", sym("name", "age")), ("User", "has_many", sym("companies")), ("User", "belongs_to", sym("firm")), ("User", "scope", [*sym("recent"), ("constant", "X"), *sym("no")]), ("User", "store_accessor", sym("settings", "color")),
        ("User", "delegate", [*sym("title"), ("to:", "owner"), *sym("never")]), ("User", "has_paper_trail", []), ("User", "define_method", [("string", "made")]), (None, "attr_reader", sym("top")), ("User", "cattr_reader", sym("count")), ("User", "unknown", sym("x")),
    )
    got = {}
    for r in macros.declared(c, macros.rules(spark)).collect():
        got.setdefault(r.call_id, set()).add(r.symbol_id)
    assert got == {
        0: {"User#name", "User#name=", "User#age", "User#age="}, 1: {"User#companies", "User#companies=", "User#company_ids", "User#company_ids="}, 2: {"User#firm", "User#firm=", "User#build_firm", "User#create_firm", "User#firm_id", "User#firm_id="},
        3: {"User.recent"}, 4: {"User#color", "User#color="}, 5: {"User#title"}, 6: {"User#versions", "User#version_at", "User#paper_trail"}, 7: {"User#made"}, 9: {"User.count"},
    }


def test_links(spark):
    c = calls(
        spark, ("User", "before_save", sym("check", "clean")), ("User", "has_many", sym("companies")), ("User", "has_one", [*sym("boss"), ("class_name:", "Person")]), ("User", "alias_method", sym("full", "name")), ("User", "delegate", [*sym("title"), ("to:", "owner")]),
        (None, "get", [("string", "admin/line_items#show")]), (None, "post", [("string", "/things"), ("to:", "things#create")]), ("PostsController", "authorize", [("constant", "Post")]), ("UserSerializer", "attributes", sym("id", "name")), ("Ability", "can", [*sym("read"), ("constant", "Post")]),
        ("User", "validates", sym("name")),
    )
    got = {}
    for r in macros.linked(c, macros.rules(spark)).collect():
        got.setdefault(r.call_id, set()).add(r.target)
    assert got == {
        0: {"User#check", "User#clean"}, 1: {"Company"}, 2: {"Person"}, 3: {"User#name"}, 4: {"Owner#title"}, 5: {"Admin::LineItemsController#show"}, 6: {"ThingsController#create"}, 7: {"PostPolicy"}, 8: {"User#id", "User#name"}, 9: {"Post"},
    }


@pytest.mark.parametrize(("word", "want"), [("companies", "company"), ("boxes", "box"), ("dishes", "dish"), ("users", "user"), ("glass", "glass"), ("fish", "fish"), ("buses", "bus"), ("", "")])
def test_singular(spark, word, want):
    assert spark.createDataFrame([(word,)], "w string").select(macros.singular(F.col("w"))).first()[0] == want


def test_frameworks_by_gems(spark):
    names = lambda gems: {r.framework for r in macros.rules(spark, gems).collect()}
    assert "carrierwave" in names(None) and names([]) == {"ruby-core", "activesupport", "rails", "pundit", "routing"} and "cancancan" in names(["cancan"]) and "aasm" not in names(["cancan"])
    assert {r.name for r in macros.words(spark, "relations", ["kaminari"]).collect()} == {"page", "per", "padding", "without_count"}
    assert {r.name: r.runs for r in macros.words(spark, "enqueue").collect()}["push_bulk"] == "perform"
    known = macros.external(spark, [])
    c = spark.createDataFrame([(1, None, "puts"), (2, None, "has_many"), (3, None, "my_own"), (4, None, "mount_uploader"), (5, None, "render")], "call_id int, receiver string, member string")
    assert {r.call_id: r.external for r in dispatch.external_calls(c, known).collect()} == {1: True, 2: True, 3: False, 4: False, 5: True}
    assert len(V.KERNEL) == len(set(V.KERNEL)) and {"each", "puts"} <= {r.name for r in macros.words(spark, "ambiguous").collect()}


def test_extended_symbols_and_columns(spark):
    written_out = spark.createDataFrame([("ruby", "a.rb", "User#name", "name", "User")], "language string, rel_path string, symbol_id string, short_name string, scope string")
    c = calls(spark, ("User", "attr_accessor", sym("name")), ("User", "attr_reader", sym("name")))
    assert sorted(r.symbol_id for r in macros.extended(written_out, c, macros.rules(spark)).collect()) == ["User#name", "User#name="]
    assert macros.declared(c.limit(0), macros.rules(spark)).count() == macros.linked(c.limit(0), macros.rules(spark)).count() == 0
    schema = spark.createDataFrame([("users", "age", "integer"), ("users", "where", "point")], "table string, column string, type string")
    assert {r.column: r.ruby_type for r in macros.column_types(schema).collect()} == {"age": "Integer", "where": None}

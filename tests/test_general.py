"""Nested records, intervals and packed cells against brute force and stated cases."""

import json
import random
from datetime import date, timedelta

from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from weftline.operators.intervals import OPEN, IntervalMap, merge_intervals
from weftline.operators.nested import ShapeAutomaton, DEBATES, entity_table, route, shred, variant_table, variants
from weftline.operators.packed import ESC, MARK, SEP, explode_values, split_values


# -- intervals --------------------------------------------------------------------------------------------------------


@given(st.lists(st.tuples(st.integers(0, 60), st.integers(0, 12)), max_size=30))
def test_interval_map_is_the_union_of_days(raw):
    held = IntervalMap()
    days = set()
    for start, size in raw:
        held.insert(start, start + size)
        days |= set(range(start, start + size + 1))
    assert {d for s, e in held.periods() for d in range(s, e + 1)} == days
    assert all(s - e > 1 for e, s in zip(held.ends, held.starts[1:]))
    assert all(e >= s for s, e in held.gaps())


def test_open_intervals_swallow_what_follows():
    held = IntervalMap()
    for s, e in ((50, 60), (10, OPEN), (5, 7)):
        held.insert(s, e)
    assert held.periods() == [(5, 7), (10, OPEN)]
    assert held.gaps() == [(8, 9)]


def _days(spark, rows):
    return spark.createDataFrame(rows, "who string, a date, b date, entity string, s int")


def test_merge_intervals_cases(spark):
    d = date
    rows = [
        ("x", d(2020, 1, 1), d(2020, 1, 10), "clash", 1), ("x", d(2020, 1, 11), d(2020, 1, 20), None, None), ("x", d(2020, 2, 1), None, None, 0), ("x", d(2020, 1, 5), d(2020, 1, 6), "", 2),
        ("y", d(2020, 1, 1), d(9999, 12, 31), None, None), ("y", None, d(2020, 1, 1), None, None), ("z", d(2020, 5, 1), d(2020, 4, 1), None, None), (None, d(2020, 1, 1), d(2020, 1, 2), None, None), ("x", d(2020, 1, 1), d(2020, 1, 10), "clash", 1),
    ]
    got = {tuple(r) for r in merge_intervals(_days(spark, rows), "who", "a", "b").collect()}
    assert got == {("x", "period", "2020-01-01", "2020-01-20"), ("x", "gap", "2020-01-21", "2020-01-31"), ("x", "period", "2020-02-01", "open"), ("y", "period", "2020-01-01", "open")}
    assert merge_intervals(_days(spark, []), "who", "a", "b").count() == 0


def test_merge_intervals_hot_key_against_days(spark):
    rng = random.Random(3)
    rows = [("hot" if i % 3 else f"k{i % 7}", date(2000, 1, 1) + timedelta(rng.randrange(3000)), None, None, None) for i in range(900)]
    rows = [(k, a, a + timedelta(rng.randrange(5)), e, s) for k, a, _, e, s in rows]
    got = merge_intervals(_days(spark, rows).repartition(5), "who", "a", "b").collect()
    for key in {r[0] for r in rows}:
        days = {a + timedelta(i) for k, a, b, *_ in rows if k == key for i in range((b - a).days + 1)}
        mine = {date.fromisoformat(r.start_date) + timedelta(i) for r in got if r.entity == key and r.kind == "period" for i in range((date.fromisoformat(r.end_date) - date.fromisoformat(r.start_date)).days + 1)}
        assert mine == days


# -- packed cells -----------------------------------------------------------------------------------------------------


def _split(spark, cells):
    return [r[0] for r in spark.createDataFrame([(c,) for c in cells], "v string").select(split_values(F.col("v"), ("Shared/Split Screen",))).collect()]


def test_any_white_space_around_quotes_and_suffixes(spark):
    b = " " * 25
    cells = [f'a,{b}"x, y"{b},b', f"Foo, Inc.{b},Bar", "Foo, Ltd.\nBar", '"q, Inc.", Foo, Ltd, z', "AC/DC"]
    assert _split(spark, cells) == [["a", "x, y", "b"], ["Foo, Inc.", "Bar"], ["Foo, Ltd.", "Bar"], ["q, Inc.", "Foo, Ltd", "z"], ["AC", "DC"]]
    got = spark.createDataFrame([("AC/DC",)], "v string").select(split_values(F.col("v"), ("AC/DC",))).first()[0]
    assert got == ["AC/DC"]


def test_rows_are_routed_to_typed_variant_tables(spark):
    records = [(1, '{"contributions": [{"text": "a"}, null, {"text": "b", "num": 2}]}'), (2, '"{\\"text\\": \\"encoded\\"}"'), (3, "nonsense"), (4, None)]
    routed = route(shred(spark.createDataFrame(records, "Id bigint, RawJSON string"), "Id", "RawJSON"))
    assert {(r.id, r.entity, r.path, r.parent_path) for r in routed.common().collect()} == {(1, "section", "", ""), (1, "contribution", "contributions/0", ""), (1, "contribution", "contributions/2", ""), (2, "section", "", "")}
    typed = routed.table("contribution", "struct<`num`:bigint,`text`:string>")
    assert [(r.id, r.path, r.own.num, r.own.text) for r in typed.collect()] == [(1, "contributions/2", 2, "b")]
    plan = typed._jdf.queryExecution().executedPlan().toString()
    assert "variant_id" in plan.partition("PartitionFilters:")[2].partition("]")[0]


def test_split_values_cases(spark):
    cases = {
        '"a, b" , c': ["a, b", "c"], "['x', \"y'z\"]": ["x", "y'z"], 'Slate "Tiny" Arts, Inc., "Q ""N"" W"': ['Slate "Tiny" Arts, Inc.', 'Q "N" W'], " , ;": [], "": [],
        "Shared/Split Screen/LAN/a": ["Shared/Split Screen", "LAN", "a"], "x, Co., Ltd.;y": ["x, Co., Ltd.", "y"], '"open, b': ['"open', "b"], '["Slate \\"Tiny\\" Arts","b"]': ['Slate "Tiny" Arts', "b"],
        "a||b|c": ["a", "b", "c"], "a\r\n- b\n- c": ["a", "b", "c"], "a<br/>b": ["a", "b"], "a，b；c、d · e • f": ["a", "b", "c", "d", "e", "f"], '{A,"Tower, Defense"}': ["A", "Tower, Defense"], "Zelroley's Forge, O'Dal's": ["Zelroley's Forge", "O'Dal's"],
        "Co-op, Incredible": ["Co-op", "Incredible"], " a , b": ["a", "b"], '""': [],
    }
    assert dict(zip(cases, _split(spark, list(cases)))) == cases
    assert _split(spark, [None]) == [None]


@settings(max_examples=12, deadline=None)
@given(st.lists(st.lists(st.text(st.sampled_from(["a", "b", ",", ";", "|", '"', " ", MARK, SEP, ESC, "0", "1", "/"]), min_size=1, max_size=8).map(str.strip).filter(bool), max_size=6), min_size=1, max_size=8))
def test_quoted_values_come_back(spark, lists):
    """CSV quoting of any values, split and unquoted, gives the values."""
    cells = [",".join('"' + v.replace('"', '""') + '"' for v in values) for values in lists]
    # a value of quotes only at its ends is ambiguous once trimmed; the rest is exact
    got = _split(spark, cells)
    for cell, values, mine in zip(cells, lists, got):
        assert mine == values, cell


def test_explode_positions(spark):
    df = spark.createDataFrame([(1, "a,,b", None), (2, None, "x;y"), (2, None, "x;y"), (3, " ", "")], "id bigint, A string, B string").withColumn("value", F.lit("clash")).withColumn("pos", F.lit(9))
    got = sorted(tuple(r) for r in explode_values(df, "id", ["A", "B"], ()).collect())
    assert got == [(1, "A", 1, "a"), (1, "A", 2, "b"), (2, "B", 1, "x"), (2, "B", 1, "x"), (2, "B", 2, "y"), (2, "B", 2, "y")]


def test_long_cells(spark):
    values = [f"v{i}" for i in range(20_000)]
    assert _split(spark, ['"' + "q" * 200_000 + '",' + ",".join(values)])[0] == ["q" * 200_000, *values]


# -- nested records ---------------------------------------------------------------------------------------------------


def _nodes(spark, texts, **how):
    return shred(spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "k bigint, body string").withColumn("path", F.lit("clash")), "k", "body", **how)


def test_shred_cases(spark):
    texts = [
        json.dumps({"showAs": "t", "contributions": [None, {"contribution": {"text": "a", "paragraphs": {"paragraph": [{"text": "p"}, None, {"references": {"uri": "u"}}]}}}]}),
        json.dumps({"debateSection": {"debateSections": {"debateSectionId": "x", "divisions": json.dumps([{"votes": [{"vote": {"side": "for"}}]}])}}}),
        json.dumps(json.dumps({"contributions": None, "debateSections": []})), "not json", None, "", "[1]", "{}", "\t {\"contributions\": [\"words\"]}",
    ]
    got = {(r.id, r.entity, r.path, r.parent_path) for r in _nodes(spark, texts).collect()}
    assert got == {
        (0, "section", "", None), (0, "contribution", "contributions/1", ""), (0, "paragraph", "contributions/1/paragraphs/0", "contributions/1"), (0, "paragraph", "contributions/1/paragraphs/2", "contributions/1"), (0, "reference", "contributions/1/paragraphs/2/references/0", "contributions/1/paragraphs/2"),
        (1, "section", "", None), (1, "subsection", "debateSections/0", ""), (1, "division", "debateSections/0/divisions/0", "debateSections/0"), (1, "vote", "debateSections/0/divisions/0/votes/0", "debateSections/0/divisions/0"),
        (2, "section", "", None), (7, "section", "", None), (8, "section", "", None), (8, "contribution", "contributions/0", ""),
    }
    assert _nodes(spark, []).count() == 0


def test_every_parent_exists_and_variants_are_typed(spark):
    texts = [json.dumps({"contributions": [{"speaker": {"showAs": "s", "role": r}, "text": "x", "n": 3, "ok": True} for r in ("chair", {"roleCode": "c"})]}) for _ in range(3)]
    nodes = _nodes(spark, texts).cache()
    children = nodes.where("parent_path is not null").alias("c")
    assert children.join(nodes.alias("p"), (F.col("c.id") == F.col("p.id")) & (F.col("c.parent_path") == F.col("p.path")), "left_anti").count() == 0
    found = {r.variant: r.n for r in variants(nodes).where("entity = 'contribution'").collect()}
    assert sorted(found.values()) == [3, 3]
    for variant in found:
        own = variant_table(nodes, "contribution", variant).select("own.*").first()
        assert own.n == 3 and own.ok is True and own.speaker.showAs == "s"
    assert {r.role for r in entity_table(nodes, "contribution", {"role": "$.speaker.role"}).collect()} == {"chair", '{"roleCode":"c"}'}


def test_deep_records_and_states():
    a = ShapeAutomaton(DEBATES)
    assert a.state({"text": "x", "paragraphs": [1, 2, 3]}) == a.state({"paragraphs": None, "text": "y"}) == "struct<`paragraphs`:[],`text`:string>"
    assert a.state([1, None, 2]) == "array<bigint>" and a.state([1, "x"]) == "array<string>"


def test_depth_is_bounded_by_the_record_only(spark):
    deep: dict = {}
    for _ in range(300):
        deep = {"debateSections": [deep]}
    assert _nodes(spark, [json.dumps(deep)]).count() == 301


def test_deep_fields_do_not_break_a_record(spark):
    deep = '{"a":' * 900 + "1" + "}" * 900
    rows = _nodes(spark, ['{"contributions": [{"text": "x", "speaker": ' + deep + "}]}"]).collect()
    assert [(r.entity, r.text) for r in rows] == [("section", None), ("contribution", "x")]

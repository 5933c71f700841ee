from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from inkweave.operators import charts, render
from inkweave.schemas import CHART, RAW_CHART
from inkweave.sources import builder as B
from inkweave.sources.packages import raw_chart
from inkweave.sources.xmltree import parse

C = B._SPACES


def chart_of(spark, *xmls):
    df = spark.createDataFrame([(k, raw_chart(parse(x.encode()))) for k, x in enumerate(xmls)], f"k int, raw {RAW_CHART}")
    return [r.chart for r in charts.parse(df).orderBy("k").collect()]


def space(plot: str, title: str = "") -> str:
    return f"<c:chartSpace {C}>" + B.nest("c:chart", title + B.nest("c:plotArea", plot)) + "</c:chartSpace>"


def ser(values: str = "", cats: str = "", name: str = "") -> str:
    return B.nest("c:ser", name + (B.nest("c:cat", cats) if cats else "") + B.nest("c:val c:numRef c:numCache", values))


def pts(*rows) -> str:
    return "".join(f'<c:pt{"" if i is None else f" idx={chr(34)}{i}{chr(34)}"}>{"" if v is None else f"<c:v>{v}</c:v>"}</c:pt>' for i, v in rows)


def test_golden_example(spark):
    xml = B.chart("barChart", "Shares", ["Oslo", "Lima"], [("old", [0.311, 0.74]), ("new", [0.5, 0.66])], "0.0%", "Part")
    chart = chart_of(spark, xml)[0]
    assert (chart.chart_type, chart.title, chart.value_axis_title, chart.value_format, chart.stacked, chart.categories) == ("column", "Shares", "Part", "0.0%", False, ["Oslo", "Lima"])
    lines = ["Shares — Part", "", *["```mermaid", "xychart-beta"], 'x-axis ["Oslo", "Lima"]', 'y-axis "Part" 0 --> 0.74', "bar [0.311, 0.74]", "bar [0.5, 0.66]", "```", "", "| Category | old | new |", "| --- | --- | --- |", "| Oslo | 31.1% | 50.0% |", "| Lima | 74.0% | 66.0% |"]
    assert render.with_markdown(spark.createDataFrame([(chart,)], f"chart {CHART}")).first().markdown == "\n".join(lines)


def test_sparse_and_broken_caches(spark):
    def values(inner):
        return space(f"<c:lineChart>{ser(inner)}</c:lineChart>")

    got = chart_of(
        spark,
        values('<c:ptCount val="3"/>' + pts((0, 1), (2, 3))), values(pts((0, 1), (1, "#N/A"))), values('<c:ptCount val="x"/>' + pts((0, 1), (2, 4))), values('<c:ptCount val="2"/>' + pts((0, 7), ("junk", 9))),
        values('<c:ptCount val="1"/>' + pts((None, 9), (0, 1))), values('<c:ptCount val="2"/>' + pts((0, None), (1, 5))), values('<c:ptCount val="2"/>' + pts((0, 1), (0, 2), (5, 9), (-1, 3))), values(""), values('<c:ptCount val="2000000000"/>' + pts((1, 3))),
    )
    assert [c.series[0]["values"] for c in got] == [[1.0, None, 3.0], [1.0, None], [1.0, None, 4.0], [7.0, None], [1.0], [None, 5.0], [2.0, None], [], [None, 3.0]]


def test_categories_and_names(spark):
    num = f"<c:numRef><c:numCache>{pts((0, 2020.0), (1, 1.5))}</c:numCache></c:numRef>"
    lit = f"<c:strLit>{pts((0, 'x'), (2, 'z'))}</c:strLit>"
    got = chart_of(
        spark,
        space(f"<c:lineChart>{ser(pts((0, 1)))}{ser(pts((0, 1)), num)}</c:lineChart>"), space(f"<c:lineChart>{ser(pts((0, 1)), lit, '<c:tx><c:v>Lit</c:v></c:tx>')}</c:lineChart>"),
        space(f"<c:lineChart>{ser(pts((0, 1)), '<c:strRef/>' + lit, '<c:tx><c:strRef/></c:tx>')}</c:lineChart>"),
        space(f"<c:scatterChart><c:ser><c:xVal>{num}</c:xVal><c:yVal><c:numLit>{pts((0, 4))}</c:numLit></c:yVal></c:ser></c:scatterChart>"),
    )
    assert [c.categories for c in got] == [["2020", "1.5"], ["x", "", "z"], [], ["2020", "1.5"]]
    assert [c.series[0].name for c in got] == [None, "Lit", None, None]
    assert (got[3].chart_type, got[3].series[0].kind, got[3].series[0]["values"]) == ("scatter", "scatter", [4.0])


def test_types_and_stacking(spark):
    bar, line = f"<c:barChart>{{}}{ser(pts((0, 1)))}</c:barChart>", f"<c:lineChart>{ser(pts((0, 1)))}</c:lineChart>"
    got = chart_of(
        spark,
        space(bar.format('<c:barDir val="bar"/><c:grouping val="stacked"/>')), space(bar.format("") + line), space(bar.format("") * 2), space("<c:bubbleChart/>"), f"<c:chartSpace {C}><c:chart/></c:chartSpace>", f"<c:chartSpace {C}/>",
        space(bar.format('<c:grouping val="percentStacked"/>')), space(bar.format('<c:grouping val="clustered"/>')),
    )
    assert [(c.chart_type, c.stacked) for c in got] == [("bar", True), ("combo", False), ("combo", False), ("other", False), ("other", False), ("other", False), ("column", True), ("column", False)]
    assert [s.kind for s in got[1].series] == ["column", "line"]


def test_shapes_without_diagram(spark):
    rows = [
        (("pie", "T", None, None, False, ["a", "b"], [("s", [1.0, -2.0], "pie")]),), (("pie", None, None, "0", False, ["a"], [("s", [1.0], "pie"), ("t", [1.0], "pie")]),), (("column", None, None, None, True, ["a"], [("s", [1.0], "column")]),),
        (("line", None, None, None, False, ["a", "b"], [("s", [1.0, None], "line")]),), (("scatter", None, None, None, False, ["a"], [("s", [1234.5], "scatter")]),), (("line", None, None, None, False, ["a"], [("s", [None], "line")]),), (("line", None, None, None, False, [], []),),
    ]
    got = render.with_markdown(spark.createDataFrame(rows, f"chart {CHART}")).collect()
    assert [r.diagram for r in got] == [None] * 7
    assert [r.markdown is None for r in got] == [False] * 5 + [True] * 2
    assert got[4].markdown.endswith("| a | 1234 |")  # half to even


text = st.text("AaB []{}()\"'0-9|", max_size=8)
value = st.none() | st.floats(-1e6, 1e6)
random_chart = st.tuples(st.sampled_from(["radar", "pie", "combo", "bar", "other", "line", "scatter", "area", "column", "doughnut"]), st.none() | text, st.none() | text, st.sampled_from(["0", None, "General", "0.0%", "#,##0.000"]), st.booleans(), st.lists(text, max_size=4), st.lists(st.tuples(st.none() | text, st.lists(value, max_size=4), st.sampled_from(["column", "line"])), max_size=3))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(random_chart, min_size=40, max_size=60))
def test_any_chart_renders(spark, rows):
    for r in render.with_markdown(spark.createDataFrame([(r,) for r in rows], f"chart {CHART}")).collect():
        full = any(v is not None for s in r.chart.series for v in s["values"])
        assert (r.markdown is not None) == full
        if full:
            table = r.markdown.rsplit("\n\n", 1)[-1].split("\n")
            assert table[1].count("---") == len(r.chart.series) + 1
            labels = len(r.chart.categories) or max(len(s["values"]) for s in r.chart.series)
            assert len(table) == labels + 2

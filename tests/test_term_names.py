"""Terms under another spelling than their node's, rows without a name, formulas that are not there."""

import pytest

from tests.test_lists import ROWS, tables
from trellis.operators import terminology as T
from trellis.sources.readers import BadInput


def test_spelling_of_the_node(spark):
    d1 = [*ROWS["D1"], ("4", "TCMT00004", "治法", "", " 解表　", "", "", "", "", "")]
    d3 = [*ROWS["D3"], ("3", "CPM00002", "TCMT00004", "治法", "", " 解表　", "", "", "")]
    edges = T.clean(tables(spark, D1=d1, D3=d3))[1].collect()
    assert [(e.node_name, e.type, e.evidence) for e in edges if e.target == "解表"] == [("桂枝丸Ａ", "采用治法", "D3:record:3")]
    assert len(edges) == 5


def test_rows_without_a_name_are_no_nodes(spark):
    d2 = [*ROWS["D2"], ("3", "CPM00003", None, "")]
    d6 = [*ROWS["D6"], ("2", "CHP00002", None, "", "", "")]
    d4 = [*ROWS["D4"], ("3", "CPM00003", "CHP00001", "0.5"), ("4", "CPM00001", "CHP00002", "0.5")]
    nodes, edges, _ = T.clean(tables(spark, D2=d2, D4=d4, D6=d6))
    assert nodes.count() == 5 and sorted(e.evidence for e in edges.collect() if e.type == "组成药材") == ["D4:record:1", "D4:record:2"]


@pytest.mark.parametrize(("table", "row"), [
    ("D3", ("9", "CPM00009", "TCMT00001", "传统医学疾病", "", "感冒", "", "", "")), ("D3", ("9", "CPM00009", "TCMT00003", "其他", "", "无", "", "", "")), ("D3", ("9", "CPM00001", "TCMT00009", "治法", "", "x", "", "", "")),
    ("D4", ("9", "CPM00009", "CHP00001", "")), ("D4", ("9", "CPM00001", "CHP00009", "")), ("D5", ("9", "CPM00009", "1A00")), ("D7", ("9", "CHP00009", "Pungent", "Medicinal flavor")),
])
def test_missing_ends(spark, table, row):
    with pytest.raises(BadInput, match="missing endpoint"):
        T.clean(tables(spark, **{table: [*ROWS[table], row]}))

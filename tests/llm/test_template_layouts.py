"""Templates of hosts made of several layouts."""

import pytest

from colonnade.llm import templates


@pytest.mark.parametrize("broadcast_rows", [500_000, -1])
def test_each_layouts_boilerplate_goes(spark, broadcast_rows):
    """Three layouts, each on a third of the pages; and on a large host each of many on 20 pages."""
    page = lambda n, i, name: (i, f"http://{name}.org/{i}", f"<body><div><p>Boilerplate {i % n}</p><p>Own <b>same</b> text {i}</p></div><p>End {i % n}</p></body>")
    rows = [page(3, i, "three") for i in range(36)] + [page(9, 1000 + i, "many") for i in range(180)]
    got = templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string"), broadcast_rows=broadcast_rows).collect()
    assert {r["page_id"]: r["text"] for r in got} == {i: "Own text " + str(i) for i, _, _ in rows}


def test_words_in_a_line_and_rare_blocks_stay(spark):
    """A recurring <b> or table cell on less than half of a host's pages is no template, nor is a block on few."""
    rows = [(i, f"http://h.org/{i}", f"<body><p>Own {i} {'<b>note</b>' if i % 3 == 0 else ''}</p>{'<p>few</p>' if i < 19 else ''}<table><tr><td>{i}<td>{'yes' if i % 3 else 'no'}</table></body>") for i in range(90)]
    got = {r["page_id"]: r["text"] for r in templates.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[0] == "Own 0 note\n\nfew\n\n0 no" and got[33] == "Own 33 note\n\n33 no"

import time

import pytest

from contestkit.sources import pages
from contestkit.sources.scanner import scan

PIECES = ["<a ", "<a href='x/event-details/1'>", "<tr data-link='x/fight-details/1'>", "<td>", "<p>", "<td><p>|</td>", "<li>Date:", "<span class=date>", '<i class="b-flag__text">', "<", "<a b=\"", "&lt;", "</a", "<tr data-link=\"", "event-details/", '<b class="b-content__title-highlight">']


@pytest.mark.parametrize("piece", PIECES)
def test_linear_time_on_long_pages(piece):
    page = "".join(p * (1_000_000 // len(piece)) for p in piece.split("|"))
    began = time.process_time()
    for f in (pages.events_list, pages.event_bouts, pages.event_details, pages.event_header, pages.classify):
        f(page)
        f('<table><tr data-link="http://x/fight-details/9"><td>' + page)
    assert time.process_time() - began < 45


def test_unclosed_and_odd_markup():
    page = """<H2 CLASS=b-content__title-highlight>A &amp; B</h2><LI>Date: <i>May</i> 1<li>Where: x<li>Location:Y</ul>
<table><tbody><TR class=r DATA-LINK=http://x/fight-details/f1?q=1><td>1 < 2<td><a href='http://x/fighter-details/a'>One<br>Two</a><a href=http://x/fighter-details/b>B</a><td><p>3<p>4</td>
<tr data-link="http://x/fight-details/f2"><td></td></tr></table><a href="/event-details/e1">E1</a> <span class="b-date">May 2</span><span class=date>no</span><a href="/event-details/e2">E2</a>"""
    s = scan(page)
    assert s.title == "A & B" and s.items == {"Date": "May 1", "Location": "Y"}
    assert [(e.text, e.href, e.dated) for e in s.events] == [("E1", "/event-details/e1", "May 2"), ("E2", "/event-details/e2", None)]
    one, two = s.rows
    assert (one.link, [x.text for x in one.sides], one.cells[2].parts, one.cells[0].text) == ("http://x/fight-details/f1?q=1", ["One Two", "B"], ["3", "4"], "1 < 2") and not two.sides
    assert [(r["fight_id"], r["blocked"]) for r in pages.event_details(page)] == [("f1", False), ("f2", True)]
    assert scan(None) == scan("") and pages.event_header(None) == {"title": None, "date_text": None, "location": None}


def test_table_functions(spark):
    pages.register_table_functions(spark)
    row = '<tr data-link="http://x/fight-details/{0}"><td><i class="b-flag__text">win</i></td><td><a href="http://x/fighter-details/a{0}">A</a><a href="http://x/fighter-details/b">B</a></td></tr>'
    listing = '<a href="/event-details/1">E1</a><span class="date">May</span>'
    df = spark.createDataFrame([(1, row.format(1) + row.format(2)), (2, listing), (3, None), (4, "")], "id int, html string")
    got = spark.sql("select p.id, b.fighter_a, b.winner from {df} p, lateral event_bouts(p.html) b", df=df).collect()
    assert [tuple(r) for r in got] == [(1, "A", "A")] * 2
    assert [tuple(r) for r in spark.sql("select p.id, e.name, e.date_text from {df} p, lateral listed_events(p.html) e", df=df).collect()] == [(2, "E1", "May")]
    assert [r["k"] for r in spark.sql("select b.a.fighter_id as k from {df} p, lateral event_details(p.html) b order by k", df=df).collect()] == ["a1", "a2"]

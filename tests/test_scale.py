"""Findings on larger tables, each on a small table of the same kind."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from contestkit.operators import identity, metrics, rating
from contestkit.plans import modelling
from contestkit.sources import pages, scanner, tables, versioned


def anew():
    """A number that is another one whenever it is worked out."""
    return F.udf(lambda: random.SystemRandom().random(), "double").asNondeterministic()()


def test_ages_are_counted_by_name_and_day(spark):
    rng = random.Random(7)
    born = lambda: date(1940, 1, 1) + timedelta(days=rng.randrange(25_000))
    ids = [(f"s{k}", f"n{k % 9}", None, born() if k % 11 else None) for k in range(60)]
    first, last = date(1985, 1, 1), date(1985, 1, 1) + timedelta(days=6575)
    ids += [("edge", "e", None, first), ("old", "e", None, date(1900, 1, 1))]
    bouts = [(k, f"n{k % 9}", born() + timedelta(days=12_000) if k % 13 else None, None) for k in range(300)]
    bouts += [(1000, "e", last, None), (1001, "e", last - timedelta(days=1), None), (1002, "e", first + timedelta(days=16_436), None), (1003, "e", first + timedelta(days=16_437), None)]
    want = {}
    for ref, name, day, _ in bouts:
        fits = [s for s, of, _, b in ids if of == name and day and b and 18 <= (day - b).days / 365.25 <= 45]
        want[ref] = fits[0] if len(fits) == 1 else None
    rows = spark.createDataFrame(bouts, "ref long, name_key string, date date, weight_class string")
    people = spark.createDataFrame(ids, "slug string, name_key string, weight_lbs double, dob date")
    assert {r["ref"]: r["slug"] for r in identity.assign(rows, people).collect()} == want and sum(v is not None for v in want.values()) > 20
    ages = identity.of_age(rows, people)
    assert ages.count() == len({(n, d) for _, n, d, _ in bouts if d})  # a row a name and day, whatever the number of candidates


def test_promoted_rows_are_judged_as_they_were_written(spark, tmp_path):
    # rows that differ whenever they are worked out, as sums of doubles may in their last bits
    rows = spark.range(20).select("id", anew().alias("x"))
    path = tables.promote(rows, f"file://{tmp_path}/p", {"some": F.col("id") >= 0})
    assert tables.current(spark, f"file://{tmp_path}/p") == path and spark.read.parquet(path).count() == 20
    with pytest.raises(ValueError, match="not promoted"):
        tables.promote(rows, f"file://{tmp_path}/p", {"none": F.col("id") < 0})
    store = versioned.begin(spark, f"file://{tmp_path}/v", rows)
    assert store.read().count() == 20 and store.sound()
    empty = versioned.begin(spark, f"file://{tmp_path}/e", rows.filter("id < 0"))
    assert empty.read().count() == 0


def test_files_that_differ_from_what_was_written_are_not_promoted(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(tables, "digest", lambda rows: (0, "0"))
    with pytest.raises(ValueError, match="differs from what was to be written"):
        tables.promote(spark.range(5).toDF("id"), f"file://{tmp_path}/p", {})
    assert tables.current(spark, f"file://{tmp_path}/p") is None


def test_the_anchor_never_differs_from_itself(spark):
    rows = spark.range(40).select(F.concat(F.lit("m"), F.col("id") % 4).alias("name"), F.expr("id div 4").alias("fold"), anew().alias("log_loss"))
    for _ in range(2):
        own = metrics.fold_summary(rows, "m1").filter("name = 'm1'").first()
        assert (own["n_folds"], own["gain"], own["folds_won"]) == (10, 0.0, 0)


def test_a_page_is_scanned_once_for_type_and_bouts(monkeypatch):
    sides = '<td><p><a href="http://x/fighter-details/a">A <b>1</b></a></p><p><a href="http://x/fighter-details/b">B</a></p></td>'
    page = f'<h2 class="b-content__title-highlight">T</h2><table class="b-fight-details__table"><tr data-link="http://x/fight-details/1"><td><i class="b-flag__text">win</i></td>{sides}<td><p>3</p>\n<p>4 &amp; 5</p></td></tr></table>'
    found = pages.scan(page)
    assert [c.parts for c in found.rows[0].cells] == [["win"], ["A 1", "B"], ["3", "4 & 5"]] and found.rows[0].cells[2].text == "3 4 & 5"
    monkeypatch.setattr(pages, "scan", lambda page: pytest.fail("scanned again"))
    assert (pages.classify(page, found=found), pages.listed(found)) == ("event_detail", 1)


CELLS = (
    "<td></td>", '<td><i class="b-flag__text">win</i></td>', '<td>{0}</td>', "<td><p> 1{0}</p>\n<p>--</p></td>", "<td><b>x</b> &amp; y</td>", '<td><a href="http://x/fighter-details/z"> Z</a></td>', "<td class='c'>4</td>", "<td>a</i></td>", "<td><p>3</td>",
    '<td><p><a class="l" href="http://x/fighter-details/a{0}">A <b>{0}</b></a></p><p><a href="http://x/fighter-details/b">B</a></p></td>', '<td><a class="b-flag__text" href="http://x/fighter-details/q">Q</a></td>', '<td><a href="http://x/event-details/e">E</a></td>',
)


def test_rows_that_are_written_out_are_read_as_tag_by_tag(monkeypatch):
    rng = random.Random(5)
    cells = lambda: "".join(rng.choice(CELLS).format(rng.randrange(9)) for _ in range(rng.randrange(12)))
    made = ["".join(f'<tr data-link="http://x/fight-details/{k}">{cells()}{rng.choice(["</tr>", "</tr>", ""])}' for k in range(3)) for _ in range(400)]
    read = lambda p: (pages.event_bouts(p), pages.event_details(p), pages.events_list(p), pages.classify(p))
    whole = [read(p) for p in made]
    row, taken = scanner._row, []
    monkeypatch.setattr(scanner, "_row", lambda *a: taken.append(row(*a) is not None))
    assert whole == [read(p) for p in made] and 0 < sum(taken) < len(taken)


def test_a_row_that_is_written_out_is_not_met_tag_by_tag(monkeypatch):
    row = '<tr data-link="http://x/fight-details/{0}"><td><i class="b-flag__text">win</i></td><td><p><a href="http://x/fighter-details/a{0}">A <b>{0}</b></a></p><p><a href="http://x/fighter-details/b">B</a></p></td><td><p>1</p>\n<p>2</p></td></tr>'
    met = []
    start = scanner._Scanner.start
    monkeypatch.setattr(scanner._Scanner, "start", lambda self, *a: (met.append(a), start(self, *a)))
    found = pages.event_details("<table><tbody>" + "".join(row.format(k) for k in range(50)) + "</tbody></table>")
    assert len(met) < 10 and [(r["a"]["name"], r["b"]["knockdowns"], r["winner"]) for r in found] == [(f"A {k}", 2, f"A {k}") for k in range(50)]


def test_bouts_of_pages_come_in_batches(spark, sf_dir, capsys):
    modelling.event_page_bouts(spark, sf_dir).explain()
    plan = capsys.readouterr().out
    assert "ArrowEvalPython" in plan and "UDTF" not in plan


def test_leagues_are_rated_apart_with_the_same_snapshots(spark):
    rng = random.Random(3)
    bouts = spark.createDataFrame([(k, date(2020, 1, 1) + timedelta(days=k // 3), 100 * (k % 8) + a, 100 * (k % 8) + b, rng.randrange(2)) for k in range(240) for a, b in [rng.sample(range(6), 2)]], "fight_id long, date date, a_id long, b_id long, a_won int")
    apart = rating.elo_by_league(bouts)
    assert sorted(apart.collect()) == sorted(rating.elo(bouts).collect())
    assert rating.standings(apart).count() == 48


def test_documents_are_files_of_one_folder(spark, tmp_path):
    tables.write_documents(spark.range(50).select(F.to_json(F.struct("id")).alias("value")), f"file://{tmp_path}/d")
    assert len(list((tmp_path / "d").glob("*.txt"))) == 50
    assert sorted(r["document"]["id"] for r in tables.load_json(spark, f"file://{tmp_path}/d", "id long").collect()) == list(range(50))

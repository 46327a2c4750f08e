"""Time safety: no row sees its own or a later outcome."""

import random
from datetime import date, timedelta

import pytest
from pyspark.sql import functions as F

from contestkit.operators import history, rating
from contestkit.plans.bindings import STATS

SCHEMA = "fight_id long, date date, side string, entity long, opponent long, won int, has_stats boolean, opp_has_stats boolean, " + ", ".join(f"{p}{c} double" for p in ("", "opp_") for c in STATS)


def bouts(n, seed=0, entities=6):
    rng = random.Random(seed)
    out, day = [], date(2020, 1, 1)
    for k in range(n):
        day += timedelta(days=rng.choice([0, 0, 30, 400]))
        a, b = rng.sample(range(entities), 2)
        line = lambda: [None if rng.random() < 0.1 else float(rng.randint(0, 20)) for _ in STATS]
        out.append((k, day, a, b, rng.randint(0, 1), line() if rng.random() > 0.2 else None, line() if rng.random() > 0.2 else None))
    return out


def long_table(spark, rows):
    none = [None] * len(STATS)
    data = []
    for k, day, a, b, won, sa, sb in rows:
        data.append((k, day, "a", a, b, won, sa is not None, sb is not None, *(sa or none), *(sb or none)))
        data.append((k, day, "b", b, a, 1 - won, sb is not None, sa is not None, *(sb or none), *(sa or none)))
    return spark.createDataFrame(data, SCHEMA)


def by_fight(df):
    return {r["fight_id"]: r.asDict() for r in df.collect()}


def test_against_replay(spark):
    rows = bouts(60)
    got = by_fight(history.features(long_table(spark, rows)))
    state = {}
    for k, day, a, b, won, sa, sb in rows:
        for s, me in (("a", a), ("b", b)):
            past = state.get(me, [])
            wins = sum(w for _, w, *_ in past)
            r = got[k]
            assert (r[f"prior_fights_{s}"], r[f"prior_wins_{s}"], r[f"prior_losses_{s}"]) == (len(past), wins, len(past) - wins)
            assert r[f"prior_win_pct_{s}"] == (pytest.approx(wins / len(past)) if past else None)
            for n in (3, 5):
                last = [w for _, w, *_ in past[-n:]]
                assert r[f"wins_last_{n}_{s}"] == sum(last) and r[f"win_pct_last_{n}_{s}"] == (pytest.approx(sum(last) / len(last)) if last else None)
            assert r[f"days_since_last_fight_{s}"] == ((day - past[-1][0]).days if past else None)
            earlier = [d for d, *_ in past if d < day]
            assert r[f"layoff_days_{s}"] == ((day - max(earlier)).days if earlier else None)
            use = [(own, opp, own[0] or opp[0] or 0.0) for _, _, own, opp in past if own and opp and (own[0] or opp[0] or 0) > 0]
            minutes = sum(m for *_, m in use)
            landed, tried = sum(o[2] or 0 for o, *_ in use), sum(o[3] or 0 for o, *_ in use)
            assert r[f"no_prior_stats_{s}"] == int(not use)
            assert r[f"sig_strikes_landed_per_min_{s}"] == (pytest.approx(landed / minutes) if use else None)
            assert r[f"striking_accuracy_{s}"] == (pytest.approx(landed / tried) if use and tried else None)
            assert r[f"knockdowns_absorbed_per_15_{s}"] == (pytest.approx(sum(p[1] or 0 for _, p, _ in use) / minutes * 15) if use else None)
        state.setdefault(a, []).append((day, won, sa, sb))
        state.setdefault(b, []).append((day, 1 - won, sb, sa))


def test_own_and_later_bouts_change_nothing(spark):
    rows = bouts(40, seed=2)
    base = by_fight(history.features(long_table(spark, rows)))
    poisoned = [(*r[:4], 1 - r[4], [999.0] * len(STATS), [999.0] * len(STATS)) if r[0] >= 25 else r for r in rows]
    later = by_fight(history.features(long_table(spark, poisoned)))
    known = [c for c in base[0] if c != "a_won"]
    assert all(base[k][c] == later[k][c] for k in range(26) for c in known)


def test_order_of_input_and_sides(spark):
    rows = bouts(40, seed=3)
    base = by_fight(history.features(long_table(spark, rows)))
    mixed = rows[:]
    random.Random(1).shuffle(mixed)
    assert by_fight(history.features(long_table(spark, mixed))) == base
    swapped = by_fight(history.features(long_table(spark, [(k, d, b, a, 1 - w, sb, sa) for k, d, a, b, w, sa, sb in rows])))
    for k in base:
        for c in history.RECORD:
            assert base[k][f"{c}_a"] == swapped[k][f"{c}_b"]


def elo_rows(spark, rows):
    return spark.createDataFrame([(k, d, a, b, w) for k, d, a, b, w, *_ in rows], "fight_id long, date date, a_id long, b_id long, a_won int")


def test_elo_against_replay(spark):
    rows = bouts(50, seed=4)
    got = by_fight(rating.elo(elo_rows(spark, rows)))
    now = {}
    for k, _, a, b, won, *_ in rows:
        ra, rb = now.get(a, 1500.0), now.get(b, 1500.0)
        e = 1 / (1 + 10 ** ((rb - ra) / 400))
        assert got[k]["a_pre"] == pytest.approx(ra) and got[k]["a_expected"] == pytest.approx(e)
        now[a], now[b] = ra + 32 * (won - e), rb + 32 * ((1 - won) - (1 - e))
        assert got[k]["a_post"] + got[k]["b_post"] == pytest.approx(ra + rb)


def test_elo_by_component(spark):
    rows = bouts(40, seed=5)
    two = [(k, d, a + (10 if k % 2 else 0), b + (10 if k % 2 else 0), w) for k, d, a, b, w, *_ in rows]
    frame = spark.createDataFrame(two, "fight_id long, date date, a_id long, b_id long, a_won int").withColumn("league", F.col("fight_id") % 2)
    assert by_fight(rating.elo(frame, component="league")) == by_fight(rating.elo(frame))

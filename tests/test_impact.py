"""Live coverage, event series, simultaneous losses, attribution, activity tracks and incidents on hand-made rows."""

import random
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from routeweave.operators import concurrency, coverage, evidence, incidents


def rows_of(df, *columns):
    return sorted(map(tuple, (df.select(*columns) if columns else df).collect()), key=repr)


CHANGES = "k string, network bigint, length int, slot bigint, d bigint"


def net(a, b, c, d):
    return a << 24 | b << 16 | c << 8 | d


def test_a_withdrawal_uncovers_what_no_other_prefix_holds(spark):
    rows = [
        ("k", net(10, 0, 0, 0), 23, 1, 1), ("k", net(10, 0, 0, 0), 24, 2, 1), ("k", net(10, 0, 1, 128), 25, 3, 1), ("k", net(10, 0, 0, 0), 23, 4, -1),
        ("k", net(10, 0, 0, 0), 24, 5, -1), ("k", net(10, 0, 0, 0), 23, 6, 1), ("k", net(10, 0, 1, 128), 25, 7, -1), ("k", net(10, 0, 0, 0), 23, 8, -1),
    ]
    got = rows_of(coverage.live_coverage(spark.createDataFrame(rows, CHANGES), ["k"]), "slot", "covered")
    assert got == [(1, 512), (4, 384), (5, 128), (6, 512), (8, 0)]


def test_coverage_counts_members_and_ends_at_the_family(spark):
    rows = [("k", 1 << 40, 48, 1, 1), ("k", 1 << 40, 48, 1, 1), ("k", 1 << 40, 64, 2, 1), ("k", 1 << 40, 48, 3, -2), ("k", 1 << 40, 64, 4, -1), ("k", 0, 0, 5, 1)]
    got = rows_of(coverage.live_coverage(spark.createDataFrame(rows, CHANGES), ["k"], 48), "slot", "covered")
    assert got == [(1, 1), (4, 0), (5, 1 << 48)]
    assert coverage.live_coverage(spark.createDataFrame([], CHANGES), ["k"]).count() == 0


def test_coverage_against_unions(spark):
    draw, rows, held, want = random.Random(4), [], defaultdict(int), {}
    for slot in range(120):
        for _ in range(draw.randrange(3)):
            length = draw.choice([24, 25, 26, 28, 30])
            network = net(10, 0, draw.randrange(3), draw.randrange(256) & (256 - (1 << (32 - length))))
            d = 1 if draw.random() < 0.6 or not held[network, length] else -1
            held[network, length] += d
            rows.append(("k", network, length, slot, d))
        covered = {a for (n, length), count in held.items() if count > 0 for a in range(n, n + (1 << (32 - length)))}
        want[slot] = len(covered)
    got = dict(rows_of(coverage.live_coverage(spark.createDataFrame(rows, CHANGES).repartition(3), ["k"]), "slot", "covered"))
    now = 0
    for slot in range(120):
        now = got.get(slot, now)
        assert now == want[slot]


STATES = "event string, prefix string, afi int, network bigint, length int, direction int, slot bigint, up int, d int"


def population(spark):
    """Two prefixes of AS 1, one of AS 2 inside the first, a later one; two directions; the population is that of slot 1."""
    a, b, c, new = ("a", 4, net(10, 0, 0, 0), 23), ("b", 4, net(10, 9, 0, 0), 24), ("c", 4, net(10, 0, 1, 0), 24), ("n", 4, net(10, 0, 0, 0), 22)
    moves = [(a, 1, 0, 1), (a, 2, 1, 1), (b, 1, 1, 1), (c, 1, 1, 1), (c, 2, 2, 1), (a, 1, 2, 0), (a, 2, 3, 0), (b, 1, 3, 0), (new, 1, 4, 1), (a, 1, 5, 1), (new, 1, 6, 0), (c, 1, 6, 0), (new, 2, 7, 1)]
    last, rows = {}, []
    for p, direction, slot, up in sorted(moves, key=lambda m: m[2]):
        rows.append(("e", *p, direction, slot, up, up - last.get((p, direction), 0)))
        last[p, direction] = up
    states = spark.createDataFrame(rows, STATES)
    cohorts = spark.createDataFrame([("e", 1, 8)], "event string, cohort_slot bigint, last_slot bigint")
    origins = spark.createDataFrame([("e", "a", 1), ("e", "b", 1), ("e", "c", 2)], "event string, prefix string, asn int")
    return states, cohorts, origins


def test_event_series(spark):
    got = {r["slot"]: r for r in coverage.event_series(*population(spark)).collect()}
    assert sorted(got) == list(range(1, 9))

    def column(name):
        return [got[s][name] for s in range(1, 9)]

    assert column("prefix_expected_directions") == [4] * 8
    assert column("prefix_visible_directions") == [4, 3, 1, 1, 2, 1, 1, 1]
    assert column("prefix_normal") == [3, 2, 1, 1, 1, 0, 0, 0]
    assert column("prefix_partial") == [0, 1, 0, 0, 1, 1, 1, 1]
    assert column("prefix_complete") == [0, 0, 2, 2, 1, 2, 2, 2]
    assert column("asn_affected") == [0, 1, 0, 0, 1, 1, 1, 1] and column("asn_interrupted") == [0, 0, 1, 1, 0, 1, 1, 1]
    assert column("fixed_addresses") == [768, 768, 256, 256, 512, 512, 512, 512]
    assert column("new_v4_prefixes") == [0, 0, 0, 1, 1, 0, 1, 1] and column("ever_v4_prefixes") == [0, 0, 0, 1, 1, 1, 1, 1]
    assert column("new_addresses") == [0, 0, 0, 1024, 1024, 0, 1024, 1024] and column("ever_addresses") == [0, 0, 0, 1024, 1024, 1024, 1024, 1024]


def test_simultaneous_losses(spark):
    states, cohorts, origins = population(spark)
    members, _ = coverage.cohort(states, cohorts)
    classed = coverage.prefix_classes(members)
    related = spark.createDataFrame([("e", 1, 2, "c"), ("e", 2, 1, "a"), ("e", 2, 1, "b"), ("e", 2, 1, "b"), ("e", 9, 1, "a")], "event string, affected int, downstream int, prefix string")
    got = rows_of(concurrency.concurrent_losses(classed, related, origins, cohorts), "affected", "downstream", "pair_prefixes", "slots", "first_slot", "last_slot", "peak_prefixes", "peak_addresses", "peak_blocks_48")
    assert got == [(1, 2, 1, 3, 6, 8, 1, 256, 0), (2, 1, 2, 3, 6, 8, 2, 768, 0), (9, 1, 1, 0, None, None, 0, 0, 0)]
    assert rows_of(concurrency.affected_ases(classed, origins), "asn", "event_class", "peak_partial", "peak_complete", "peak_invisible") == [(1, "route_interrupted", 1, 2, 3), (2, "route_interrupted", 0, 1, 1)]


@pytest.mark.parametrize(("first", "last"), [(0, 0), (31, 31), (0, 31), (5, 70), (31, 32), (64, 200)])
def test_slot_words(spark, first, last):
    df = spark.createDataFrame([("k", first, last)], "k string, first bigint, last bigint")
    bits = {32 * r["word"] + b for r in concurrency.slot_words(df, ["k"]).collect() for b in range(32) if r["bits"] >> b & 1}
    assert bits == set(range(first, last + 1))


def test_attribution_conserves_rows(spark):
    schema = "route_event_id string, at bigint, family string, action string, prefix string, origin_state string, origins array<bigint>"
    v4 = "ipv4_unicast"
    changes = [
        ("hit", 100, v4, "announce", "p", "resolved", [1]), ("foreign", 100, v4, "announce", "p", "resolved", [5]), ("two", 100, v4, "announce", "p", "resolved", [1, 2]), ("gone", 199, v4, "withdraw", "p", None, []),
        ("torn", 100, v4, "announce", "p", "conflict", [1, 2]), ("blank", 100, v4, "announce", "p", "unknown", []), ("early", 99, v4, "announce", "p", "resolved", [1]), ("end", 200, v4, "announce", "p", "resolved", [1]),
        ("other", 100, v4, "announce", "x", "resolved", [1]), ("rib", 100, v4, "rib_snapshot", "p", "resolved", [1]), ("multi", 100, "ipv4_multicast", "announce", "p", "resolved", [1]), ("both", 150, v4, "announce", "q", "resolved", [3]), ("null", 100, None, None, None, None, None),
    ]
    members = spark.createDataFrame([("A", v4, "p", 1), ("A", v4, "p", 2), ("A", v4, "q", 3), ("B", v4, "q", 3)], "cohort string, family string, prefix string, asn bigint")
    episodes = spark.createDataFrame([("A1", "A", 100, 200), ("A2", "A", 150, None), ("B1", "B", 0, 1000)], "episode string, cohort string, onset_at bigint, end_at bigint")
    df = spark.createDataFrame(changes, schema)
    got = rows_of(evidence.attribute_changes(df, episodes, members, bucket=60), "route_event_id", "episode", "outcome", "asn", "candidates")
    assert got == sorted([
        ("hit", "A1", "attributed", 1, 1), ("foreign", "A1", "resolved_origin_not_in_cohort", None, 1), ("two", "A1", "resolved_origin_not_in_cohort", None, 1), ("gone", "A1", "withdraw_origin_unavailable", None, 2), ("gone", "A2", "withdraw_origin_unavailable", None, 2),
        ("torn", "A1", "origin_conflict", None, 2), ("blank", "A1", "origin_unknown", None, 2), ("early", None, "outside_episodes", None, 0), ("end", "A2", "attributed", 1, 1), ("other", None, "prefix_not_in_cohort", None, 0), ("rib", None, "other_action", None, 0),
        ("multi", None, "other_family", None, 0), ("both", "A1", "attributed", 3, 1), ("both", "A2", "attributed", 3, 1), ("both", "B1", "attributed", 3, 1), ("null", None, "other_action", None, 0),
    ], key=repr)
    assert {r[0] for r in got} == {c[0] for c in changes}


def test_tracks_beside_states(spark):
    states = spark.createDataFrame([("s", k, "x") for k in range(6)], "subject string, slot bigint, state string")
    tracks = spark.createDataFrame([("s", "t", 1, 5.0), ("s", "t", 1, 7.0), ("s", "t", 2, None), ("s", "t", 4, 7.0), ("s", "u", 0, None)], "subject string, track string, slot bigint, value double")
    got = rows_of(evidence.align_tracks(states, tracks), "track", "slot", "before_value", "before_offset", "before_class", "after_value", "after_offset", "after_class")
    assert got[:6] == [
        ("t", 0, None, None, "unavailable", 7.0, 1, "adjacent_slot"), ("t", 1, 7.0, 0, "same_slot", 7.0, 0, "same_slot"), ("t", 2, 7.0, -1, "adjacent_slot", 7.0, 2, "lagged_slot"),
        ("t", 3, 7.0, -2, "lagged_slot", 7.0, 1, "adjacent_slot"), ("t", 4, 7.0, 0, "same_slot", 7.0, 0, "same_slot"), ("t", 5, 7.0, -1, "adjacent_slot", None, None, "unavailable"),
    ]
    assert all(r[4] == r[7] == "unavailable" for r in got[6:])
    points = spark.createDataFrame([("s", "low", 1), ("s", "drop", 0), ("s", "rise", 4)], "subject string, kind string, slot bigint")
    relations = rows_of(evidence.peak_relations(points, tracks), "track", "kind", "peak_slot", "peak_value", "offset", "relation", "direction")
    assert relations == [
        ("t", "drop", 1, 7.0, 1, "adjacent_slot", "activity_after"), ("t", "low", 1, 7.0, 0, "same_slot", "same_slot"), ("t", "rise", 1, 7.0, -3, "lagged_slot", "activity_before"),
        ("u", "drop", None, None, None, "unavailable", "unknown"), ("u", "low", None, None, None, "unavailable", "unknown"), ("u", "rise", None, None, None, "unavailable", "unknown"),
    ]


def derive(spark, slots, band=None):
    """Slots of 300 seconds: (affected of 100 ASes, visible of 1000 routes), or None after a gap."""
    rows = [("s", 300 * k, "continuous", x[0] / 100, 1 - x[0] / 100, x[1] / 1000) if x else ("s", 300 * k, "unknown_after_gap", None, None, None) for k, x in enumerate(slots)]
    schema = "subject string, observed_at bigint, continuity_state string, affected_asn_ratio double, visible_origin_asn_ratio double, visible_prefix_vp_ratio double"
    df = spark.createDataFrame(rows, schema)
    episodes = incidents.incident_episodes(df, incidents.Rules(asn_band=band, prefix_band=band))
    return episodes.orderBy("ordinal").collect(), incidents.incidents(df, episodes).first()


BAND = (0.999, 1.0)
WHOLE = (0, 1000)


def test_two_slots_confirm_an_onset(spark):
    (e,), incident = derive(spark, [WHOLE, (4, 950), (5, 930), (8, 940), (7, 900)])
    assert (e["onset_at"], e["peak_at"], e["trough_at"], e["duration_state"], e["duration_seconds"]) == (300, 900, 1200, "lower_bound", 900)
    assert (incident["episodes"], incident["peak_at"], incident["observation_end_at"], incident["duration_state"]) == (1, 900, 1200, "lower_bound")
    assert derive(spark, [WHOLE, (4, 950), WHOLE])[0] == [] and derive(spark, [WHOLE, (3, 950), (3, 950)])[0] == []


def test_one_good_slot_closes_nothing(spark):
    (e,), _ = derive(spark, [WHOLE, (5, 940), (5, 940), WHOLE, (6, 930), (6, 930)], BAND)
    assert e["full_recovery_at"] is None and e["recovery_state"] == "ongoing"


def test_full_recovery_then_a_second_episode(spark):
    (one, two), incident = derive(spark, [WHOLE, (5, 940), (5, 940), *[WHOLE] * 6, (6, 930), (6, 930)], BAND)
    assert (one["partial_recovery_at"], one["full_recovery_at"], one["duration_state"], one["duration_seconds"], one["observation_end_at"]) == (900, 900, "exact", 600, 2400)
    assert (two["onset_at"], two["duration_state"], incident["recovery_state"], incident["duration_state"], incident["onset_at"], incident["peak_at"]) == (2700, "lower_bound", "ongoing", "lower_bound", 300, 2700)


def test_damage_from_the_start_is_an_interval(spark):
    (e,), incident = derive(spark, [(5, 940), (5, 940)])
    assert (e["duration_state"], e["onset_precision"], incident["duration_state"]) == ("interval", "left_censored_at_window_start", "interval")


def test_recovery_states(spark):
    assert derive(spark, [WHOLE, (5, 940), (6, 900), (4, 950)])[0][0]["recovery_state"] == "recovering"
    assert derive(spark, [WHOLE, (5, 940), (6, 900), None])[0][0]["recovery_state"] == "unknown"
    (e,), _ = derive(spark, [WHOLE, (5, 940), (6, 900), *[(1, 995)] * 6], BAND)
    assert (e["recovery_state"], e["partial_recovery_at"], e["full_recovery_at"]) == ("partially_recovered", 900, None)
    (e,), _ = derive(spark, [WHOLE, (5, 940), (6, 900), WHOLE, WHOLE, None, *[WHOLE] * 5], BAND)
    assert e["full_recovery_at"] is None and e["recovery_state"] == "unknown"
    (e,), _ = derive(spark, [WHOLE, (50, 0), (60, 0)])
    assert (e["trough_at"], e["trough_value"]) == (300, 0.0)
    none, incident = derive(spark, [WHOLE, WHOLE])
    assert none == [] and (incident["episodes"], incident["duration_state"], incident["recovery_state"]) == (0, "unknown", "unknown")


def test_slot_ends(spark):
    rows = [("k", 0, 1, "announce", "x"), ("k", 0, 2, "withdraw", "x"), ("k", 1, 3, "announce", "x"), ("k", 3, 4, "announce", "x"), ("k", 4, 5, "withdraw", "x")]
    df = spark.createDataFrame(rows, "k string, slot bigint, o int, action string, x string")
    assert rows_of(coverage.slot_ends(df, ["k"], ["o"]).withColumn("d", F.col("d").cast("int")), "slot", "up", "d") == [(0, 0, 0), (1, 1, 1), (3, 1, 0), (4, 0, -1)]

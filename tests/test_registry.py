"""Registry ingest, lives and motion against plain Python; batch against stream; spans of any length."""

from __future__ import annotations

import math
import random
from collections import defaultdict

import pytest

from tests.conftest import SF, rows_of
from witnesslake import catalog
from witnesslake.operators import automaton, motion
from witnesslake.streaming import lifecycle, registry, stateful

S = 10**9
COLUMNS = [c.split()[0] for c in registry.FACTS.split(", ")]


def plain_ingest(rows: list[tuple], sweep: int, most: int = 512) -> list[tuple]:
    """All cameras frame by frame, with objects as dictionaries; (camera, t, fact, object, track, was, now, cause, score)."""
    out = []
    for cam in sorted({r[0] for r in rows}):
        frames, objs, time, epoch, made = defaultdict(list), {}, None, None, 0
        for r in rows:
            if r[0] == cam:
                frames[r[1]].append(r)

        def say(*x):
            out.append((cam, time, *x))  # noqa: B023

        def turn(o, state, cause):
            if state != o["state"]:
                say("lifecycle", o["id"], None, o["state"], state, cause, None)
                o["state"] = state

        def missing(state, since, edge=False):
            if state == "provisional":
                return ("expired", "never_confirmed") if since >= 3 * S else (state, "")
            if state == "active":
                return ("dormant", "left_field_of_view") if edge else ("occluded", "measurement_lost")
            if state == "occluded":
                return ("dormant", "occlusion_exceeded_horizon") if since >= 10 * S else (state, "")
            if state == "dormant":
                return ("departed", "departure_horizon_exceeded") if since >= 120 * S else (state, "")
            return ("expired", "retention_horizon") if since >= 600 * S else (state, "")

        for t in sorted(frames):
            while sweep and time is not None and objs and (time // sweep + 1) * sweep < t:
                time = (time // sweep + 1) * sweep
                for k in sorted(objs):
                    o = objs[k]
                    begun, state, why = o["state"], o["state"], None
                    while state != "expired" and (x := missing(state, time - o["at"]))[0] != state:
                        state, why = x
                    if why:
                        say("lifecycle", k, None, begun, state, why, None)
                        o["state"] = state
                        if state in ("occluded", "dormant", "departed", "expired"):
                            o["track"] = None
                    if state == "expired":
                        del objs[k]
            time, here = t, sorted(frames[t], key=lambda r: r[2])
            new_epoch = max(r[3] for r in here)
            cross, epoch, seen = epoch is not None and epoch != new_epoch, new_epoch, set()
            for _, _, track, _, _, _, _, *_, bind in here:
                if bind is not None:
                    if bind not in objs or objs[bind]["state"] == "expired":
                        say("bind_refused", bind, track, None, None, "terminal" if bind in objs else "unknown_object", None)
                    else:
                        for o in objs.values():
                            o["track"] = None if o["track"] == track else o["track"]
                        objs[bind]["track"] = track
                        say("bound", bind, track, None, None, "manual", 1.0)
            for _, _, track, _, pred, cls, conf, x1, y1, x2, y2, _ in here:
                mine = [o for k, o in sorted(objs.items()) if o["track"] == track and o["state"] != "expired"]
                reason, others, score, o = None, None, 1.0, None
                if mine and mine[0]["state"] == "departed" and not pred:
                    mine[0]["track"] = None
                    reason, others = "after_departure", mine[0]["id"]
                elif mine:
                    o = mine[0]
                else:
                    scored = []
                    for k, c in objs.items():
                        a, b = c["class"], cls
                        if c["state"] in ("occluded", "dormant") and c["track"] is None and (a == b or (a + ".").startswith(b + ".") or (b + ".").startswith(a + ".")):
                            bx = c["box"]
                            d = min(1, math.dist(((x1 + x2) / 2, (y1 + y2) / 2), ((bx[0] + bx[2]) / 2, (bx[1] + bx[3]) / 2)) / math.sqrt(2))
                            gap = max(0, t - c["at"])
                            if d <= 0.25 and gap <= 30 * S:
                                s = (1 - d / 0.25) * (1 - gap / (30 * S)) * (0.5 if cross else 1.0)
                                if s >= 0.3:
                                    scored.append((s, k))
                    scored.sort(key=lambda x: (-x[0], x[1]))
                    if not scored:
                        reason = "first_sight"
                    elif len(scored) > 1 and scored[0][0] - scored[1][0] < 0.15:
                        reason, others, score = "ambiguous", ",".join(k for _, k in scored), scored[0][0]
                    else:
                        o = objs[scored[0][1]]
                        o["track"] = track
                        say("reentered", o["id"], track, o["state"], None, "epoch_rebind" if cross else "spatio_temporal", scored[0][0])
                if reason:
                    if len(objs) >= most:
                        unsure = sorted((c["first"], k) for k, c in objs.items() if c["state"] == "provisional")
                        if not unsure:
                            say("refused", None, track, None, None, "population_capped", None)
                            continue
                        del objs[unsure[0][1]]
                        say("lifecycle", unsure[0][1], None, "provisional", "expired", "population_shed", None)
                    made += 1
                    o = objs[f"{cam}/{made:09d}"] = {"id": f"{cam}/{made:09d}", "state": "provisional", "class": cls, "box": (x1, y1, x2, y2), "at": t, "first": t, "n": 1, "track": track, "w": {cls: max(0, conf)}}
                    say("created", o["id"], track, others, "provisional", reason, score)
                else:
                    o["n"] += 1
                    if not pred:
                        o["at"], o["box"] = t, (x1, y1, x2, y2)
                        o["w"][cls] = o["w"].get(cls, 0) + max(0, conf)
                        top = sorted(o["w"], key=lambda c: (-o["w"][c], c))[0]
                        if sum(o["w"].values()) > 0 and top != o["class"]:
                            o["class"] = top
                            say("reclassified", o["id"], track, None, top, None, None)
                seen.add(o["id"])
                say("updated", o["id"], track, None, o["class"], None, None)
                if pred:
                    turn(o, *missing(o["state"], t - o["at"]))
                elif o["state"] == "provisional":
                    turn(o, "active" if o["n"] >= 3 else "provisional", "confirmation_threshold_met")
                else:
                    turn(o, "active", {"occluded": "re_association_succeeded", "dormant": "re_entry_matched"}.get(o["state"]))
            for k in sorted(objs):
                o = objs[k]
                if k not in seen and o["state"] != "expired":
                    o["track"] = None
                    b = o["box"]
                    turn(o, *missing(o["state"], t - o["at"], min(b[0], b[1]) <= 0.02 or max(b[2], b[3]) >= 0.98))
                    o["n"] += 1
    return out


def drawn_tracks(seed: int, n: int = 500) -> list[tuple]:
    draw, out, t, there = random.Random(seed), [], 0, list(range(5))
    for i in range(n):
        t += draw.choice([1] * 20 + [4, 16, 30] + [250, 1500] * (i % 10 == 0)) * S // 2
        if draw.random() < 0.2:
            there = draw.sample(range(5), draw.randint(1, 5))
        for track in there:
            x, y = (0.0, 0.2, 0.24, 0.5, 0.9)[track] + draw.choice([0, 0.005]), draw.choice([0.1, 0.12])
            bind = draw.choice(["c1/000000001", "c0/000000003", "nothing"]) if draw.random() < 0.01 else None
            out.append((f"c{i % 2}", t, f"t{track}-{(i + 9 * track) // 60}", i // 200, draw.random() < 0.3, draw.choice(["person"] * 6 + ["person.child"] * 2 + ["vehicle"]), draw.choice([0.2, 0.5, 0.9]), x, y, x + 0.1, y + 0.1, bind))
    return out


def by_camera(facts) -> list[tuple]:
    """Facts in each camera's order, without the count."""
    return [(f[0], f[1], *f[3:]) for f in sorted(facts, key=lambda f: (f[0], f[2]))]


@pytest.mark.parametrize(("seed", "sweep", "most"), [(1, 0, 512), (2, S, 512), (3, 7 * S, 4)])
def test_ingest_is_the_plain_fold(spark, seed, sweep, most):
    rows = drawn_tracks(seed)
    shuffled = spark.createDataFrame(random.Random(9).sample(rows, len(rows)) + [(None, 1, "t", 0, False, "a", 1.0, 0.0, 0.0, 1.0, 1.0, None)], registry.TRACKS)
    got = by_camera(registry.ingest(shuffled, registry.Policy(sweep_ns=sweep, most_objects=most)).collect())
    want = plain_ingest(rows, sweep, most)
    assert got == want
    said = {(f[2], f[7]) for f in want}
    assert {("reentered", "spatio_temporal"), ("lifecycle", "left_field_of_view"), ("bind_refused", "unknown_object")} <= said
    assert ("created", "ambiguous") in said if most == 512 else {("lifecycle", "population_shed"), ("refused", "population_capped")} <= said
    assert registry.ingest(shuffled.limit(0)).collect() == []


@pytest.fixture
def rocks(spark):
    name, held = "spark.sql.streaming.stateStore.providerClass", spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    yield
    spark.conf.set(name, held)


def drained(spark, frame, tmp_path, make, files):
    """What a stream over `files` small files gives."""
    for i, part in enumerate(files):
        frame(part).coalesce(1).write.parquet(f"{tmp_path}/in/f{i:03d}")
    source = spark.readStream.schema(frame(files[0]).schema).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in/*")
    make(source).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/c").outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{tmp_path}/out").collect()


def test_ingest_stream_equals_batch(spark, rocks, tmp_path):
    rows = [r for r in drawn_tracks(4, 60) if r[-1] is None]
    end = max(r[1] for r in rows)
    draw = random.Random(2)
    # arrival out of order within the watermark's delay, then rows far ahead that let all others pass
    late = sorted(rows, key=lambda r: r[1] + draw.randint(0, 3 * S))
    files = [late[: len(late) // 2], late[len(late) // 2 :], [("z", end + 5000 * S, "t", 0, False, "a", 1.0, 0.1, 0.1, 0.2, 0.2, None)], [("z", end + 9000 * S, "t", 0, False, "a", 1.0, 0.1, 0.1, 0.2, 0.2, None)]]
    policy = registry.Policy(sweep_ns=S)
    frame = lambda x: spark.createDataFrame(x, registry.TRACKS)
    got = [f for f in drained(spark, frame, tmp_path, lambda s: registry.ingest_stream(s, policy, "6 seconds"), files) if f.camera_id != "z" and f.t_ns <= end]
    # a frame of the other camera may be the last: sweeps go on after a camera's own last frame
    last = {c: max(r[1] for r in rows if r[0] == c) for c in ("c0", "c1")}
    assert by_camera(f for f in got if f.t_ns <= last[f.camera_id]) == by_camera(registry.ingest(frame(rows), policy).collect())


def plain_lives(sightings: dict[str, list[int]], until: int) -> set[tuple]:
    out = set()
    for o, times in sightings.items():
        lives = []
        for t in sorted(times):
            if lives and t - lives[-1][-1] <= (120 * S if len(lives[-1]) >= 3 else 3 * S):
                lives[-1].append(t)
            else:
                lives.append([t])
        for life in lives:
            for i, t in enumerate(life):
                since = t - life[i - 1] if i else None
                if i == 0:
                    out.add((o, life[0], t, None, "provisional", "first_detections"))
                elif i == 2:
                    out.add((o, life[0], t, "provisional", "active", "confirmation_threshold_met"))
                elif i > 2 and since > S:
                    out.add((o, life[0], t, "dormant" if since > 10 * S else "occluded", "active", "re_entry_matched" if since > 10 * S else "re_association_succeeded"))
                end = life[i + 1] if i + 1 < len(life) else until + 1
                steps = [(1, "active", "occluded", "measurement_lost"), (10, "occluded", "dormant", "occlusion_exceeded_horizon"), (120, "dormant", "departed", "departure_horizon_exceeded"), (600, "departed", "expired", "retention_horizon")] if i >= 2 else [(3, "provisional", "expired", "never_confirmed")]
                out |= {(o, life[0], t + s * S, *x) for s, *x in steps if t + s * S < end}
    return {x for x in out if x[2] <= until}


def drawn_sightings(seed: int) -> dict[str, list[int]]:
    draw, out = random.Random(seed), {}
    for o in ("a", "b", "c"):
        t, times = 0, []
        for _ in range(60):
            t += draw.choice([S // 2, S, S, S, 2 * S, 3 * S, 4 * S, 10 * S, 11 * S, 120 * S, 121 * S, 700 * S])
            times.append(t)
        out[o] = times
    return out


@pytest.mark.parametrize("span", [1, 60 * S, None])
def test_lives_are_the_plain_ones_in_any_spans(spark, span):
    sightings = drawn_sightings(3)
    until = max(map(max, sightings.values())) + 300 * S
    frame = spark.createDataFrame([(o, t, i) for o, ts in sightings.items() for i, t in enumerate(ts)] + [(None, 5, 0), ("a", None, 1)], "object_id string, t_ns long, event_id long")
    got = lifecycle.changes(frame, until, span_ns=span).collect()
    assert len(got) == len({tuple(r) for r in got}) and {tuple(r) for r in got} == plain_lives(sightings, until)
    assert lifecycle.changes(frame.limit(0), until).collect() == []


def test_lives_stream_equals_batch(spark, rocks, tmp_path):
    sightings = {o: ts[:25] for o, ts in drawn_sightings(5).items()}
    rows = sorted((t, o, i) for o, ts in sightings.items() for i, t in enumerate(ts))
    end = rows[-1][0]
    draw = random.Random(1)
    late = sorted(rows, key=lambda r: r[0] + draw.randint(0, 4 * S))
    frame = lambda x: spark.createDataFrame([(o, t, i) for t, o, i in x], "object_id string, t_ns long, event_id long")
    files = [late[: len(late) // 2], late[len(late) // 2 :], [(end + 3000 * S, "z", 0)], [(end + 6000 * S, "z", 0)]]
    got = [tuple(r) for r in drained(spark, frame, tmp_path, lambda s: lifecycle.changes_stream(s, late="6 seconds"), files) if r.object_id != "z"]
    # with no further sighting, every life goes on to its end
    assert len(got) == len(set(got)) and set(got) == plain_lives(sightings, end + 2000 * S)
    assert {x[4] for x in got} == {"provisional", "active", "occluded", "dormant", "departed", "expired"}


def test_timed_suppression_equals_batch(spark, rocks, tmp_path):
    draw = random.Random(8)
    rows = [(f"s{i % 4}", draw.randint(1, 90) * S // 2, i, draw.choice("aab"), draw.random() < 0.1) for i in range(160)]
    schema = "subject string, t_ns long, ordinal long, digest string, always boolean"
    frame = lambda x: spark.createDataFrame(x, schema)
    late = sorted(rows, key=lambda r: r[1] + draw.randint(0, 4 * S))
    files = [late[:80], late[80:], [("z", 5000 * S, 0, "a", False)], [("z", 9000 * S, 1, "a", False)]]
    got = [tuple(r) for r in drained(spark, frame, tmp_path, lambda s: stateful.timed_suppression(s, 5 * S, "6 seconds"), files) if r.subject != "z"]
    last, want = {}, []
    for sub, t, n, d, always in sorted(rows, key=lambda r: (r[1], r[2])):
        if always or sub not in last or last[sub][1] != d or t - last[sub][0] >= 5 * S:
            last[sub] = (t, d)
            want.append((sub, t, n))
    assert sorted(got) == sorted(want) and len(want) < len(rows)
    assert sorted(map(tuple, stateful.suppress(frame(rows), 5 * S).collect())) == sorted(want)


def test_automaton_in_any_spans(spark):
    draw = random.Random(7)
    rows = [(g, t * S, i, draw.choice([0, 1, None])) for g in ("hot", "hot", "hot", "cold", None) for i, t in enumerate(range(200))]
    rows = [(g, t, n, s) for n, (g, t, _, s) in enumerate(rows)]
    frame = spark.createDataFrame(rows, "g string, t_ns long, n long, symbol int")
    step = [[1, 2, 0, 3], [0, 3, 1, 3]]
    want = {}
    at = defaultdict(int)
    for g, _, n, s in sorted(rows, key=lambda r: (r[1], r[2])):
        before, at[g] = at[g], at[g] if s is None else step[s][at[g]]
        want[n] = (before, at[g])
    for span in (1, 10 * S, 10**6 * S, None):
        assert {r.n: (r.state_before, r.state) for r in automaton.scan(frame, "g", ["n"], "symbol", step, 0, span).collect()} == want


def test_motion_states_in_any_spans(spark):
    draw, rows, x = random.Random(3), [], 0.0
    for t in range(150):
        x += draw.choice([0.0, 0.0, 0.001, 0.05, 0.05, -0.05 if t > 90 else 0.05])
        rows.append(("o", t * S, t, x, 0.1))
    frame = motion.kinematics(spark.createDataFrame(rows, "object_id string, t_ns long, event_id long, x double, y double"))
    still = moving = turns = 0
    heading, said, want = None, "unknown", {}
    for i, (_, _, n, x, _) in enumerate(rows):
        v = x - rows[i - 1][3] if i else None
        h = None if v is None or abs(v) < 1e-3 else (0.0 if v > 0 else 180.0)
        turns += h is not None and heading is not None and h != heading
        heading = h if h is not None else heading
        still, moving = (still + 1, 0) if v is None or abs(v) < 0.01 else (0, moving + 1)
        said = "erratic" if turns >= 3 else "stationary" if still >= 3 else "moving" if moving >= 3 else said
        want[n] = said
    assert set(want.values()) == {"unknown", "stationary", "moving", "erratic"}
    for span in (1, None):
        assert {r.event_id: r.motion for r in motion.motion_states(frame, span).collect()} == want


@pytest.mark.parametrize("name", ["lifecycle_changes", "lifecycle_causes", "object_kinematics", "motion_states", "class_winners"])
def test_matches_sql(spark, duck, name):
    got, want = catalog.QUERIES[name](spark, SF), duck.sql(catalog.ORACLES[name])
    cols = sorted(got.columns)
    assert rows_of(got, cols) == sorted(map(str, want.select(", ".join(cols)).fetchall()))


def test_query_is_the_plain_fold(spark):
    from witnesslake.queries import registry as queries

    rows = [(*(r[c.split()[0]] for c in registry.TRACKS.split(", ")[:-1]), None) for r in queries._tracks(spark, SF).collect()]  # noqa: SLF001
    assert by_camera(queries.registry_ingest(spark, SF).collect()) == plain_ingest(rows, S)

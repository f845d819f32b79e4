"""Keyed vector state and batches over several tables: batch twins, restarts, killed and repeated batches."""

from __future__ import annotations

import json
import random
from datetime import datetime, timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from calltally.operators import matching
from calltally.plans import catalog
from calltally.schema import DERIVED
from calltally.sources import dims
from calltally.streaming import commits, jobs, vectors

SIGNAL = "actor string, event_id string, ts timestamp, embedding array<double>, org string, residency string, client string, objective_id string, label string, is_solved boolean"
MEMORY = "seq long, tenant_id string, actor string, language string, request_model string, embedding array<double>, cost_usd double"


def _vectors(n, seed=1, kinds=12, width=8, noise=0.35):
    r = np.random.default_rng(seed)
    base = r.normal(size=(kinds, width))
    return (base[r.integers(0, kinds, n)] + noise * r.normal(size=(n, width))).tolist()


def _signals(n=90, people=14):
    r, start = random.Random(4), datetime(2024, 1, 1)
    return [
        (f"p{r.randrange(people)}", f"e{i:03d}", start + timedelta(seconds=i), v, "o1" if i % 6 else "o2", "eu", r.choice([None, None, "c1"]), r.choice([None, "x", "y"]), r.choice([None, "L1", "L2"]), r.random() < 0.3)
        for i, v in enumerate(_vectors(n, kinds=4))
    ]


def _plain_matches(rows, same_bar, cross_bar, mutual=()):
    latest, told, out = {}, set(), []
    for actor, event, _, v, org, _, client, objective, label, solved in rows:
        for other, (w, its_client, its_objective, its_label, its_solved) in latest.get(org, {}).items():
            if other == actor or its_client != client:
                continue
            sim = round(float(np.dot(v, w) / np.linalg.norm(v) / np.linalg.norm(w)), 6)
            same = objective == its_objective if objective and its_objective else bool(label and label == its_label)
            pair = (org, *sorted((actor, other)))
            if sim >= (same_bar if same or solved or its_solved else cross_bar) and pair not in told:
                told.add(pair)
                if pair[1:] not in mutual:
                    out.append((*pair[1:], sim, same, "solved_reuse" if solved or its_solved else "live_duplication", its_label, event))
        latest.setdefault(org, {})[actor] = (v, client, objective, label, solved)
    return sorted(out, key=repr)


def _land(spark, rows, schema, path, files):
    """``rows`` in so many files, read in order one a batch."""
    step = -(-len(rows) // files)
    for i in range(0, len(rows), step):
        spark.createDataFrame(rows[i : i + step], schema).coalesce(1).write.mode("append").parquet(str(path))
    return spark.readStream.schema(spark.createDataFrame([], schema).schema).option("maxFilesPerTrigger", 1).parquet(str(path))


@pytest.mark.parametrize("groups", [1, 3])
def test_arrivals_meet_the_latest_of_others_and_restart(spark, tmp_path, groups):
    rows, mutual = _signals(), spark.createDataFrame([("p1", "p2"), ("p1", "p2"), ("p10", "p3")], "a string, b string")
    for part in (rows[:40], rows[40:]):  # the second half comes after a restart
        s = _land(spark, part, SIGNAL, tmp_path / "s", 2)
        jobs.match_stream(s, str(tmp_path / "o"), str(tmp_path / "ck"), same_bar=0.6, cross_bar=0.8, groups=groups, mutual=mutual).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "o")).drop("ts").collect()
    want = _plain_matches(rows, 0.6, 0.8, {("p1", "p2"), ("p10", "p3")})
    assert sorted(map(tuple, got), key=repr) == want and len(want) > 20


def _memory(n=300, tenants=3):
    r = random.Random(9)
    return [(i, r.choice(["t0", "t1", None][:tenants]), r.choice([None, "a", "b", "c", "d"]), r.choice([None, "py", "go"]), r.choice(["m", "n"]), v, float(r.randrange(90))) for i, v in enumerate(_vectors(n, 3))]


@pytest.mark.parametrize("shards", [1, 5])
def test_memory_stream_gives_what_the_batch_gives(spark, tmp_path, monkeypatch, shards):
    monkeypatch.setattr(vectors, "BLOCK", 16)
    rows = [(s, t or "t9", *x) for s, t, *x in _memory()]
    for part in (rows[:140], rows[140:]):
        s = _land(spark, part, MEMORY, tmp_path / "s", 2)
        jobs.memory_stream(s, str(tmp_path / "o"), str(tmp_path / "ck"), serve=0.9, warm=0.7, shards=shards).awaitTermination()
    got = sorted(map(tuple, jobs.memory_view(spark, str(tmp_path / "o")).collect()))
    want = sorted(map(tuple, matching.team_memory(spark.createDataFrame(rows, MEMORY), 0.9, 0.7).collect()))
    assert got == want and len(want) > 150


def test_memory_keeps_so_many_a_cell(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(vectors, "BLOCK", 4)
    rows = [(i, "t", f"p{i}", "py", "m", [1.0, 0.001 * i], 1.0) for i in range(40)]
    s = _land(spark, rows, MEMORY, tmp_path / "s", 8)
    jobs.memory_stream(s, str(tmp_path / "o"), str(tmp_path / "ck"), shards=1, most=6).awaitTermination()
    got = {r.seq: r.tm_solver for r in jobs.memory_view(spark, str(tmp_path / "o")).collect()}
    assert len(got) == 39 and all(int(got[i][1:]) >= i // 5 * 5 - 6 for i in got)


def test_buckets_find_near_vectors(spark, tmp_path):
    """Recall of the hyperplane index against the exact way: matches, memory, candidates and the memory stream."""
    rows = [(s, "t", a, *x) for s, _, a, *x in _memory(500, 1)]
    df = spark.createDataFrame(rows, MEMORY)
    exact = {r.seq: r for r in matching.team_memory(df).collect()}
    found = {r.seq: r for r in matching.team_memory(df, index=matching.INDEX).collect()}
    assert len(exact) > 300 and set(found) <= set(exact) and sum(found.get(k) == v for k, v in exact.items()) >= 0.9 * len(exact)
    s = _land(spark, rows, MEMORY, tmp_path / "s", 3)
    jobs.memory_stream(s, str(tmp_path / "o"), str(tmp_path / "ck"), index=matching.INDEX).awaitTermination()
    assert {r.seq: tuple(r) for r in jobs.memory_view(spark, str(tmp_path / "o")).collect()} == {k: tuple(v) for k, v in found.items()}
    people = spark.createDataFrame([(f"p{i}", str(i), datetime(2024, 1, 1), v, "o", "eu", None, "x", "L", False) for i, v in enumerate(_vectors(300, 5))], SIGNAL)
    every, near = ({(r.a, r.b) for r in matching.broker_matches(people, same_bar=0.8, index=i).collect()} for i in (None, matching.INDEX))
    assert near <= every and len(near) >= 0.9 * len(every) > 1000
    pairs = {(r.a, r.b) for r in matching.lsh_candidates(people, "actor").collect()}
    assert len(pairs & every) >= 0.9 * len(every)
    assert matching.INDEX.chance(0.8) > 0.9 and matching.INDEX.chance(0.95) > 0.999


def test_groups_and_shards_change_nothing(spark):
    people = spark.createDataFrame(_signals(), SIGNAL)
    one, many = (sorted(map(tuple, matching.broker_matches(people, groups=g).collect())) for g in (1, 5))
    assert one == many and one
    rows = spark.createDataFrame([(s, "t", *x) for s, _, *x in _memory(80)], MEMORY)
    one, many = (sorted(map(tuple, matching.team_memory(rows, 0.9, 0.7, shards=n).collect())) for n in (1, 6))
    assert one == many and one


def test_stream_queries_match_their_batch_twins(spark):
    folder = "/root/testdata/sf0.001"
    twin = {r.seq: tuple(r) for r in catalog.QUERIES["team_memory"](spark, folder).collect()}
    assert {r.seq: tuple(r) for r in catalog.QUERIES["stream_team_memory"](spark, folder).collect()} == twin and twin


# ---- commits --------------------------------------------------------------------------------------------------------


def test_a_killed_batch_shows_in_no_table(spark, tmp_path):
    log, schema = commits.BatchLog(str(tmp_path)), spark.range(1).schema
    log.write(0, {"x": spark.range(3), "y": spark.range(5)})
    spark.range(7).write.parquet(f"{tmp_path}/x/batch=1/attempt=try-dead")  # killed before y and the manifest
    (tmp_path / "y/batch=1/attempt=try-dead/_temporary/0").mkdir(parents=True)
    assert [log.read(spark, t, schema).count() for t in "xy"] == [3, 5]
    log.write(1, {"x": spark.range(2), "y": spark.range(4)})
    assert [log.read(spark, t, schema).count() for t in "xy"] == [5, 9]
    log.write(1, {"x": spark.range(1), "y": spark.range(1)})  # runs again
    assert [log.read(spark, t, schema).count() for t in "xy"] == [4, 6]
    assert log.read(spark, "never", schema).count() == 0 and commits.BatchLog(f"{tmp_path}/none").read(spark, "x", schema).count() == 0


def test_a_first_write_that_was_killed_can_run_again(spark, tmp_path):
    (tmp_path / "x/batch=0/attempt=try-dead/_temporary").mkdir(parents=True)
    log = commits.BatchLog(str(tmp_path))
    assert log.read(spark, "x", spark.range(1).schema).count() == 0
    log.write(0, {"x": spark.range(2)})
    assert log.read(spark, "x", spark.range(1).schema).count() == 2


def test_clusters_have_to_name_a_shared_folder(spark, monkeypatch):
    class Elsewhere:
        conf = spark.conf
        sparkContext = type("C", (), {"master": "spark://host:7077"})()

    if spark.conf.get("spark.checkpoint.dir", None) is None:
        with pytest.raises(ValueError, match="spark.checkpoint.dir"):
            commits.shared_folder(Elsewhere())
    assert commits.shared_folder(spark)


def _record(i, who, tokens=100, ts="2024-01-01T00:00:00Z", **more):
    return json.dumps({"event_id": i, "ts": ts, "actor_pseudonym": who, "request_model": "claude-opus-4", "input_tokens": tokens, "output_tokens": 1, "objective_id": "obj1", "objective_label": "One", "work_type": "fix", "embedding": [1.0, 0.1]} | more)


class Killed(Exception):
    pass


def test_ingest_matches_and_books_in_one_commit(spark, tmp_path, monkeypatch):
    land, out, ck = tmp_path / "land", str(tmp_path / "out"), str(tmp_path / "ck")
    land.mkdir()
    people = spark.createDataFrame([("px_1", "t1"), ("px_2", "t1"), ("px_3", "t2")], "pseudonym string, tenant_id string")
    objectives = spark.createDataFrame([("obj1", None)], "objective_id string, client string")

    def run():
        s = jobs.json_stream(spark, str(land), DERIVED).select("*")
        return jobs.ingest(s, people, dims.prices(spark), out, ck, objectives=objectives)

    def state():
        rows = {r.event_id: r.input_tokens for r in jobs.latest_view(spark, out).collect()}
        matches = sorted((r.a, r.b, r["mode"]) for r in jobs.committed(spark, out, "matches").collect())
        booked = sorted((r.dedup_key, r.tenant_id, r["mode"]) for r in jobs.ledger_view(spark, out).collect())
        return rows, matches, booked

    (land / "a.json").write_text("\n".join([_record("e1", "px_1"), _record("e2", "px_2", objective_id="obj9"), _record("e3", "px_x"), "{broken"]))
    run().awaitTermination()
    first = state()
    assert first[0] == {"e1": 100, "e2": 100} and first[1] == [("px_1", "px_2", "solved_reuse")] and first[2] == []  # obj9 isn't known, so nothing is booked
    (land / "b.json").write_text("\n".join([_record("e4", "px_2", ts="2024-01-02T00:00:00Z"), _record("e5", "px_1", ts="2024-01-02T00:00:01Z"), _record("e1", "px_1", 7, "2024-01-03T00:00:00Z"), _record("e6", "px_3")]))
    (land / "c.json").write_text(_record("e7", "px_3", tokens=-1, ts="2024-01-04T00:00:00Z"))
    written = commits.BatchLog._name

    def dies(self, *a):
        raise Killed("between the tables and the manifest")

    monkeypatch.setattr(commits.BatchLog, "_name", dies)
    with pytest.raises(Exception, match="Killed|between"):
        run().awaitTermination()
    assert state() == first  # its files are there, but no reader sees them
    monkeypatch.setattr(commits.BatchLog, "_name", written)
    run().awaitTermination()
    rows, matches, booked = state()
    assert rows == {"e1": 7, "e2": 100, "e4": 100, "e5": 100, "e6": 100, "e7": 0}
    assert matches == [("px_1", "px_2", "solved_reuse")]  # told once; t2 is another organisation
    run().awaitTermination()
    assert state() == (rows, matches, booked)


def test_ingest_books_what_it_matches(spark, tmp_path):
    land, out = tmp_path / "land", str(tmp_path / "out")
    land.mkdir()
    people = spark.createDataFrame([(f"px_{i}", "t1") for i in range(4)], "pseudonym string, tenant_id string")
    (land / "a.json").write_text("\n".join(_record(f"e{i}", f"px_{i}", ts=f"2024-01-01T00:00:0{i}Z", is_retry_loop=True) for i in range(4)))
    jobs.ingest(jobs.json_stream(spark, str(land), DERIVED), people, dims.prices(spark), out, str(tmp_path / "ck")).awaitTermination()
    booked = jobs.ledger_view(spark, out).collect()
    assert {r.dedup_key for r in booked} == {f"px_{i}|px_{j}|obj1|fix" for i in range(4) for j in range(i + 1, 4)}
    assert {(r.tenant_id, r["mode"], r.cluster_label) for r in booked} == {("t1", "live_duplication", "One")}
    assert jobs.committed(spark, out, "matches").count() == 6


def test_groups_grow_with_a_wall_and_cells_of_many_steps_find_every_pair(spark):
    """A cell's size doesn't grow with its wall, and 700 people of one wall (several steps a cell) are all compared."""
    v = _vectors(700, 8, kinds=40)
    rows = [(f"p{i}", f"e{i}", datetime(2024, 1, 1), x, "o", "eu", None if i % 2 else "c", "x" if i % 3 else None, f"L{i % 2}" if i % 5 else None, i % 7 == 0) for i, x in enumerate(v)]
    people = spark.createDataFrame(rows, SIGNAL)
    assert [matching.groups_of(people, ["org"], most) for most in (70, 350, 700)] == [10, 4, 4]
    got = {(r.a, r.b): (r.sim, r.same_objective, r.mode) for r in matching.broker_matches(people, same_bar=0.8, cross_bar=0.9, groups=2).collect()}
    want = {(a, b): (sim, same, mode) for a, b, sim, same, mode, *_ in _plain_matches(rows[0::2], 0.8, 0.9) + _plain_matches(rows[1::2], 0.8, 0.9)}
    assert got == want and len(want) > 1000


def test_memory_shards_grow_with_a_tenant_and_give_the_earliest_of_equals(spark):
    rows = [(s, "t" if s % 9 else "u", a, la, m, v[:4], c) for (s, _, a, la, m, v, c) in _memory(900)]
    rows += [(s + 900, *x) for s, *x in rows[:300]]  # the same vectors again: ties
    df = spark.createDataFrame(rows, MEMORY)
    assert matching.groups_of(df, ["tenant_id"], 100) > 10
    best = {r.seq_a: (r.sim, -r.o) for r in matching.best_earlier(df, 2).groupBy("seq_a").agg(F.max(F.struct("sim", "o")).alias("m")).select("seq_a", "m.*").collect()}
    u = np.array([r[5] for r in rows]) / np.linalg.norm([r[5] for r in rows], axis=1)[:, None]
    want = {}
    for i, (s, t, a, *_) in enumerate(rows):
        past = [(round(float(u[i] @ u[j]), 6), -rows[j][0]) for j in range(i) if rows[j][1] == t and (a is None or rows[j][2] != a)]
        if past:
            want[s] = (max(past)[0], -max(past)[1])
    assert best == want


class _State(dict):
    """Keyed state in memory that counts what is written."""

    written = 0

    def exists(self):
        return bool(self)

    def containsKey(self, k):
        return k in self

    def getValue(self, k):
        return self[k]

    def updateValue(self, k, v):
        self.written += 1
        self[k] = v

    def iterator(self):
        return iter(list(self.items()))


class _Clock:
    now = 0

    def getCurrentProcessingTimeInMs(self):
        return self.now


def _cell(ttl_ms=None):
    b = vectors._Broker(0.6, 0.8, ttl_ms)
    b.latest, b.told = _State(), _State()
    return b


def _batch(rows, groups=1):
    r = pd.DataFrame(rows, columns=[c.split()[0] for c in SIGNAL.split(", ")])
    return r.assign(grp=[int(a[1:]) % groups for a in r.actor], embedding=[np.array(v) for v in r.embedding])


@pytest.mark.parametrize("cell", [0, 1])
def test_a_cell_of_many_steps_writes_once_a_person_and_batch(cell):
    rows = [(*r[:4], "o", *r[5:]) for r in _signals(1500, 200)]
    b, got, pairs = _cell(), [], 0
    for part in (rows[:900], rows[900:910], rows[910:]):
        b.told.written = b.latest.written = 0
        found = pd.concat([pd.DataFrame(), *b.handleInputRows(("w", 8, cell), iter([_batch(part, cell + 1)]), _Clock())])
        assert b.told.written <= 200 and b.latest.written == len({r[0] for r in part})
        got += [tuple(x) for x in found.drop(columns="ts").itertuples(index=False)] if len(found) else []
    want = [x for x in _plain_matches(rows, 0.6, 0.8) if not cell or int(x[0][1:]) % 2 != int(x[1][1:]) % 2]
    assert sorted(got, key=repr) == want and len(want) > 2000
    assert sum(len(others) for others, _ in b.told.values()) == len(want)


def test_a_pair_is_told_again_when_its_time_is_over():
    row = lambda who, second: (who, f"e{second}", datetime(2024, 1, 1) + timedelta(seconds=second), [1.0, 0.1], "o", "eu", None, "x", "L", False)
    b, clock = _cell(ttl_ms=100), _Clock()

    def told(at, *rows):
        clock.now = at
        return sorted((a, c) for x in b.handleInputRows(("w", 2, 0), iter([_batch(rows)]), clock) for a, c in zip(x.a, x.b, strict=True))

    assert told(0, row("p1", 1), row("p2", 2)) == [("p1", "p2")]
    assert told(60, row("p1", 3), row("p3", 4)) == [("p1", "p3"), ("p2", "p3")]  # that p1 and p3 met keeps p1 and p2 no longer
    assert told(99, row("p2", 5)) == [] and told(100, row("p2", 6)) == [("p1", "p2")] and told(159, row("p3", 7)) == []

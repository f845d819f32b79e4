"""Similar prompts and exact repeats against plain versions."""

from __future__ import annotations

import difflib
import random
import re
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from calltally.operators import waste


def _plain_similar(rows, back, bar, ratio, only_answered):
    past, out = {}, {}
    words = lambda x: set(re.findall("[a-z0-9_]+", x.lower()))
    for actor, _, event, prompt, answered in sorted(rows, key=lambda r: (r[0], r[1], r[2])):
        own, best = past.setdefault(actor, []), 0.0
        for old in own[-back:]:
            a, b = words(prompt), words(old)
            j = len(a & b) / len(a | b) if a | b else 0.0
            if j >= 2 * bar - 1:
                best = max(best, (j + ratio(prompt.lower(), old.lower())) / 2)
        if best >= bar:
            out[actor, event] = round(best, 4)
        if answered or not only_answered:
            own.append(prompt)
    return out


def _prompts(n=400):
    r = random.Random(2)
    pool = [[r.choice("the a fix bug login test retry queue hook token cache parse json file line".split()) + str(r.randrange(3)) for _ in range(r.randrange(3, 16))] for _ in range(12)]
    rows = []
    for i in range(n):
        w = list(r.choice(pool))
        for _ in range(r.choice((0, 0, 1, 1, 2))):
            w[r.randrange(len(w))] = f"new{r.randrange(40)}"
        rows.append((r.randrange(3) if i % 3 else 0, i // 2, f"e{i:04d}", " ".join(w), r.random() < 0.5))
    return rows + [(0, 900, "x1", "", True), (0, 901, "x2", "...", True), (0, 902, "x3", "ONE", True), (0, 903, "x4", "one", False)]


@pytest.mark.parametrize(("back", "bar", "only"), [(4, 0.92, False), (100, 0.85, True), (7, 0.8, True), (1, 0.6, False)])
def test_similar_before(spark, back, bar, only):
    rows = _prompts()
    df = spark.createDataFrame(rows, "actor long, ts long, event_id string, prompt string, answered boolean").repartition(3)
    got = waste.similar_before(df, back, bar, answered=F.col("answered") if only else None, bucket=F.floor(F.col("ts") / 40)).collect()
    want = _plain_similar(rows, back, bar, lambda a, b: difflib.SequenceMatcher(None, a, b).ratio(), only)
    assert {(r.actor, r.event_id): r.similarity for r in got} == want and len(want) > 20
    assert len(got) == len(want) and waste.similar_before(df.limit(0), back, bar).count() == 0


def _plain_repeats(rows, ttl):
    stored, out = {}, {}
    for event, ts, tenant, model, body, n in sorted(rows, key=lambda r: (r[1], r[0])):
        key = (tenant, model, body)
        hit = key in stored and (ts - stored[key]).total_seconds() <= ttl
        if not hit:
            stored[key] = ts
        out[event] = (hit, n if hit else 0)
    return out


@pytest.mark.parametrize(("step", "ttl"), [(3, 60), (40, 60), (500, 60), (25, 1), (9, 300)])
def test_exact_repeats(spark, step, ttl):
    """Dense and sparse keys over many blocks of time, calls at one time, blocks of hits only, one key with most rows."""
    r, start, rows = random.Random(step), datetime(2024, 1, 1), []
    for k, n in (("hot", 900), ("b", 60), ("c", 3), ("d", 1)):
        t = 0.0
        for i in range(n):
            t += r.choice((0, r.random() * step, r.expovariate(1 / step), step * 20 if r.random() < 0.03 else 0))
            rows.append((f"{k}{i:04d}", start + timedelta(seconds=round(t)), "t", "m", k, i + 1))
    df = spark.createDataFrame(rows, "event_id string, ts timestamp, tenant_id string, request_model string, body string, input_tokens long").repartition(3)
    got = {x.event_id: (x.hit, x.saved_input_tokens) for x in waste.exact_repeats(df, ttl).collect()}
    assert got == _plain_repeats(rows, ttl)
    assert waste.exact_repeats(df.limit(0), ttl).count() == 0


def test_a_pair_right_at_the_bar_is_summed_as_in_sql(spark):
    """14 words and 68 characters, then "please": 14/15 + 1 - 7/75 is 1.84, but 14/15 + (1 - 7/75) is a bit less."""
    words = [f"w{i:02d}" for i in range(13)]
    text = " ".join([*words, "x" * (68 - 13 * 4)])
    assert len(text) == 68 and (14 / 15 + 1 - 7 / 75) / 2 >= 0.92 > (14 / 15 + (1 - 7 / 75)) / 2
    df = spark.createDataFrame([(1, 1, "a", text, True), (1, 2, "b", text + " please", True)], "actor long, ts long, event_id string, prompt string, answered boolean")
    assert [(r.event_id, r.similarity) for r in waste.similar_before(df, 4, 0.92, apart=waste.edit_share).collect()] == [("b", 0.92)]
    assert waste.similar_before(df, 4, 0.92, waste.edit_ratio).count() == 0

"""Queries over whole tables against plain versions."""

from __future__ import annotations

from collections import defaultdict

from talkframe.plans import QUERIES


def test_segment_plan_of_all_users(spark, small, duck):
    plans, want = defaultdict(list), []
    for user, s, e in duck.execute("SELECT user_id, hour(ts) * 60 + minute(ts), hour(ts) * 60 + minute(ts) + (event_id % 7) / 4.0 FROM events").fetchall():
        plans[user].append((float(s), min(float(e), 1440.0)))
    for user, own in plans.items():
        before = 0.0
        for s, e in sorted(own):
            want += [(user, before, s, False)] * (s > before + 0.3) + [(user, s, e, True)] * (e > s + 0.3)
            before = e
        want += [(user, before, 1440.0, False)] * (before + 0.3 < 1440)
    got = [tuple(r) for r in QUERIES["segment_plan"](spark, small).collect()]
    assert sorted(got) == sorted(want)


def distance(a, b) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_rates_of_all_items(spark, small, duck):
    items = duck.execute("SELECT item_id, text FROM benchmark").fetchall()
    said = {i: (t, "".join(c for c in t if c not in ".,!?;:").lower()) for i, t in items}
    want = {i: distance(t.strip(), p.strip()) / len(t.strip()) for i, (t, p) in said.items()}
    got = {r["item_id"]: r["cer"] for r in QUERIES["cer_rows"](spark, small).collect()}
    assert got.keys() == want.keys() and all(abs(got[i] - want[i]) < 1e-6 for i in want)
    assert any(not t.isascii() for _, t in items)
    row = QUERIES["eval_report"](spark, small).first()
    wer = sum(distance(t.split(), p.split()) for t, p in said.values()) / sum(len(t.split()) for t, _ in said.values())
    assert row["samples"] == len(items) and abs(row["wer"] - wer) < 1e-4 and abs(row["cer"] - sum(want.values()) / len(want)) < 1e-4
    assert abs(row["exact_match"] - 100 * sum(t.strip().lower() == p.strip() for t, p in said.values()) / len(said)) < 0.01


def test_recognition_pairs_keep_rows_with_fillers(spark, tmp_path):
    spark.createDataFrame([(1, "well um that is it"), (2, "nothing of the kind")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = {r["input"]: r["output"] for r in QUERIES["recognition_pairs"](spark, str(tmp_path)).collect()}
    assert got == {"well um that is it": "Well that is it.", "nothing of the kind": "Nothing of the kind."}

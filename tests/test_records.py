"""Run records and ledgers in files: good lines, bad lines, fields inside fields."""

import json

from pairscope.operators import reports
from pairscope.sources import records


def test_runs(spark, tmp_path):
    good = {"stage": "s", "model": "m", "status": "success", "wall_s": 2.0, "pairs": {"total": 10, "pos": 4, "neg": 6}, "other": [1]}
    lines = [json.dumps(good), json.dumps({"stage": "s", "model": "n", "status": "error", "reason": "x"}), "{not json", json.dumps(good | {"wall_s": "long"})]
    (tmp_path / "a").mkdir()
    (tmp_path / "a" / "runs.json").write_text("\n".join(lines))
    rows, bad = records.runs(spark, str(tmp_path / "a"))
    assert sorted((r["model"], r["success"], r["wall_s"], r["pairs"], r["n_neg"]) for r in rows.collect()) == [("m", True, 2.0, 10, 6), ("n", False, None, None, None)]
    assert sorted(r[0] for r in bad.collect()) == sorted(lines[2:])
    (tmp_path / "b").mkdir()
    for k in range(2):
        (tmp_path / "b" / f"{k}.json").write_text(json.dumps(good | {"model": f"m{k}"}, indent=2))
    rows, bad = records.runs(spark, str(tmp_path / "b"), one_per_file=True)
    assert sorted(r["model"] for r in rows.collect()) == ["m0", "m1"] and bad.count() == 0


def test_ledger(spark, tmp_path):
    usage = json.dumps({"input_tokens": 5, "output_tokens": 2, "note": 'a "b"'}).replace('"', '""')
    text = "request_id,app,provider,model,created_at,cost_usd,usage\n" + f'1,x,"p, q",m,86399,0.25,"{usage}"\n2,x,"p, q",m,86400,0.5,\n3,y,p,m,soon,1,\n4,y,p,m,86400,1.5,not json\n'
    (tmp_path / "ledger.csv").write_text(text)
    rows, bad = records.ledger(spark, str(tmp_path))
    got = sorted((r["request_id"], r["provider"], r["day"], r["input_tokens"], r["cache_read_tokens"]) for r in rows.collect())
    assert got == [("1", "p, q", "1970-01-01", 5, None), ("2", "p, q", "1970-01-02", None, None), ("4", "p", "1970-01-02", None, None)]
    assert [r[0] for r in bad.collect()] == ["3,y,p,m,soon,1,"]
    by_day = {r["day"]: (r["requests"], r["input_tokens"], r["cost_usd"]) for r in reports.usage_rollup(rows, ["day"]).collect()}
    assert by_day == {"1970-01-01": (1, 5, 0.25), "1970-01-02": (2, 0, 2.0)}

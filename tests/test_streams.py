"""Events appended by a stream that is stopped and started again."""

import json

from reelspan.streaming import usage as us


def lines(folder, name, numbers):
    folder.mkdir(exist_ok=True)
    made = [{"timestamp": f"2024-05-01T00:00:{k % 60:02d}.{k:06d}Z", "client_ip": f" 10.0.0.{k}, 1.1.1.1", "channel": f"c{k % 3}", "user": str(k), "action": "open"} for k in numbers]
    (folder / name).write_text("\n".join(map(json.dumps, made)))


def test_every_event_once_over_restarts(spark, tmp_path):
    into, out, state = tmp_path / "in", str(tmp_path / "out"), str(tmp_path / "state")
    start = lambda: us.append_events(us.stream_events(spark, str(into), 1), out, state)
    lines(into, "a.json", range(20))
    lines(into, "b.json", range(20, 40))
    start().awaitTermination()
    start().awaitTermination()  # nothing new: nothing is written again
    lines(into, "c.json", range(40, 60))
    lines(into, "d.json", range(60, 80))
    query = start()
    query.stop()  # whatever it has done by now
    start().awaitTermination()
    # a batch that was written but not told is of no account
    (tmp_path / "out" / "channel=c0" / "part-99999-crashed.json").write_text('{"user":"lost","action":"open"}')
    got = us.read_appended(spark, out).collect()
    assert sorted(int(r.user) for r in got) == list(range(80))
    assert {(r.user, r.channel, r.ts.microsecond) for r in got} == {(str(k), f"c{k % 3}", k) for k in range(80)}
    assert sorted(p.name for p in (tmp_path / "out").glob("channel=*")) == ["channel=c0", "channel=c1", "channel=c2"]

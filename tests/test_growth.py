"""What a larger table must not make dearer, told by plans and counts."""

from unittest import mock

from pyspark.sql import Row

from bondsight.operators import validate as v
from bondsight.streaming import jobs


def test_segments_are_compared_by_words_cut_before_the_join(spark):
    rows = spark.createDataFrame([(i, "I", "Capex", q) for i, q in enumerate(["Capex for the building fell", "building's ratio fell", "Group capex, not building, fell", None] * 8)], "id long, issuer_id string, label string, quote string")
    segments = spark.createDataFrame([("I", "building"), ("I", "build"), ("J", "group")], "issuer_id string, segment string")
    found = v.segment_named(rows, segments)
    joins = [x for x in found._jdf.queryExecution().optimizedPlan().toString().split("\n") if "Join" in x]
    assert joins and not any("regexp" in x for x in joins)
    assert {r.id: r.segment for r in found.collect()} == {i: "building" if i % 4 < 2 else None for i in range(32)}


def test_trailing_state_is_asked_once_a_batch():
    """An issuer's hundred days cost one read, one write and one timer; a timer drops all days that are done."""
    calls, kept, timers = [], {}, []
    state = mock.Mock(get=lambda: calls.append("get") or kept.get(0), update=lambda x: calls.append("update") or kept.update({0: x}), clear=lambda: calls.append("clear") or kept.clear())
    handle = mock.Mock(getValueState=lambda *_: state, registerTimer=lambda ms: calls.append("timer") or timers.append(ms))
    trailing = jobs.Trailing(30, 2)
    trailing.init(handle)
    rows = [Row(event_key=d, family="rating", raises=0, day=d) for d in range(100)]
    out = list(trailing.handleInputRows(("I",), iter([*rows, rows[0]]), None))
    assert calls == ["get", "update", "timer"] and timers == [31 * jobs.DAY_MS]
    assert {r.event_key: (r.recent, r.mod02) for r in out} == {d: (min(d + 1, 31), d > 0) for d in range(100)}
    late = list(trailing.handleInputRows(("I",), iter([Row(event_key=900, family="rating", raises=1, day=50)]), None))
    assert sorted(r.event_key for r in late) == [*range(50, 81), 900] and timers == [31 * jobs.DAY_MS]
    watermark = mock.Mock(getCurrentWatermarkInMs=lambda: 40 * jobs.DAY_MS)
    assert not list(trailing.handleExpiredTimer(("I",), watermark, mock.Mock(getExpiryTimeInMs=lambda: timers[0])))
    assert min(kept[0][0]) == 10 and len(kept[0][0]) == 91 and timers[1:] == [41 * jobs.DAY_MS]
    watermark = mock.Mock(getCurrentWatermarkInMs=lambda: 400 * jobs.DAY_MS)
    assert not list(trailing.handleExpiredTimer(("I",), watermark, mock.Mock(getExpiryTimeInMs=lambda: timers[1]))) and not kept


def test_windows_that_cannot_win_are_not_compared(monkeypatch):
    """Around its place a quote has a hundred windows that may pass; few are compared, and the best is found."""
    compared = []
    common_length = v.common_length
    monkeypatch.setattr(v, "common_length", lambda *a: compared.append(a) or common_length(*a))
    told = "The company was in compliance with all covenants. The lenders waived the leverage covenant of the notes due in May."
    quote = "".join("#" if i % 12 == 0 else x for i, x in enumerate(told))
    text = "It rained in the town. " * 200 + told + " It rained in the town." * 200
    windows = list(v.candidate_windows(quote, text))
    best = max((200.0 * n / (len(quote) + e - s), -s, e) for s, e in windows if 20 * (n := common_length(v.places_of(quote), len(quote), text[s:e])) >= v.COMMON * (len(quote) + e - s))
    assert v.best_window(quote, text) == (best[0], -best[1], best[2])
    assert len(windows) > 50 and len(compared) < len(windows) / 3

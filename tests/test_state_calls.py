"""Stateful operators call their store per micro-batch, not per event."""

import random
from collections import Counter

import pandas as pd

from docweir.streaming import jobs, tokens

CALLS = Counter()


class State:
    def __init__(self):
        self.value, self.rows = None, []

    def __getattribute__(self, name):
        if name in ("get", "update", "clear", "appendValue", "exists"):
            CALLS[name] += 1
        return object.__getattribute__(self, name)


class Value(State):
    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Rows(State):
    def get(self):
        return iter(list(self.rows))

    def appendValue(self, row):
        self.rows.append(row)

    def clear(self):
        self.rows = []


class Handle:
    getValueState = staticmethod(lambda *a: Value())
    getListState = staticmethod(lambda *a: Rows())
    listTimers = staticmethod(lambda: iter(()))
    deleteTimer = registerTimer = staticmethod(lambda t: None)


def test_tokens_in_any_order():
    answer = tokens._Answer(["k"], 600)
    answer.init(Handle)
    events = [(i, "token", f"{i} ", None) for i in range(500)] + [(500, "done", "", 7)]
    random.Random(3).shuffle(events)
    # every fifth event comes twice
    batches = [events[i::4] + events[::5] for i in range(4)]
    CALLS.clear()
    out = []
    for batch in batches:
        frame = pd.DataFrame(batch, columns=["seq", "type", "content", "total_tokens"]).assign(at=pd.Timestamp("2024-01-01"))
        out += answer.handleInputRows((1,), iter([frame]), None)
    assert sum(CALLS.values()) <= 8 * len(batches)
    assert len(out) == 1 and out[0].content[0] == "".join(f"{i} " for i in range(500)) and out[0].total_tokens[0] == 7


def test_records_that_end_make_one_frame(monkeypatch):
    record = jobs._Record()
    record.init(Handle)
    rows = pd.DataFrame({"at": pd.date_range("2024-01-01", periods=50, freq="2h").as_unit("ns"), "status": "in_progress"})
    built, frame = [], pd.DataFrame
    monkeypatch.setattr(jobs.pd, "DataFrame", lambda *a, **k: built.append(1) or frame(*a, **k))
    out = list(record.handleInputRows((1,), iter([rows]), None))
    assert len(built) == len(out) == 1 and len(out[0]) == 49
    assert (out[0].forgotten_at - rows["at"][:49]).nunique() == 1

"""How often a debounced key goes to its states: that doesn't follow its rows."""

import pandas as pd

from inkwell.streaming import observing as O


class State:
    def __init__(self, calls):
        self.calls, self.held = calls, None

    def exists(self):
        self.calls.append("exists")
        return self.held is not None

    def get(self):
        self.calls.append("get")
        return self.held

    def update(self, new):
        self.calls.append("update")
        self.held = new

    def clear(self):
        self.calls.append("clear")
        self.held = None


class Handle:
    def __init__(self):
        self.calls, self.at = [], set()

    def getValueState(self, *_):
        return State(self.calls)

    def listTimers(self):
        self.calls.append("list")
        return iter(sorted(self.at))

    def registerTimer(self, at):
        self.calls.append("register")
        self.at.add(at)

    def deleteTimer(self, at):
        self.calls.append("delete")
        self.at.discard(at)


def run(n):
    handle, quiet = Handle(), O.Quiet(1_500, False, 1_000_000)
    quiet.init(handle)
    rows = pd.DataFrame({"key": "a", "id": range(n), "value": [None if i % 3 == 0 else f"v{i % 2}" for i in range(n)], "ms": [i * 2_000 for i in range(n)]})
    out = pd.concat(quiet.handleInputRows(("a",), iter([rows[: n // 2], rows[n // 2 :]]), None))
    assert list(out.id) == [i for i in range(n - 1) if i == 0 or out_value(i) != out_value(i - 1)]
    assert handle.at == {(n - 1) * 2_000 + 1_500, (n - 2) * 2_000 + 1_000_000}
    return len(handle.calls)


def out_value(i):
    return None if i % 3 == 0 else f"v{i % 2}"


def test_states_are_read_and_written_once_a_key():
    assert run(10) == run(400) <= 8

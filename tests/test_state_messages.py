"""Each look at typed state is a message to the store: a key asks for no more than its events need."""

import random

import pandas as pd

from quarrylens.streaming import episode
from quarrylens.streaming.actions import Episodes


class _Handle:
    """State in memory that counts the messages."""

    def __init__(self):
        self.held, self.timers, self.n = {}, [], 0

    def _variable(self, name, *_):
        def call(kind):
            def run(*args):
                self.n += 1
                v = self.held.get(name)
                if kind in ("update", "put"):
                    self.held[name] = args[0]
                elif kind == "updateValue":
                    self.held[name] = {**(v or {}), args[0]: args[1]}
                elif kind == "clear":
                    self.held.pop(name, None)
                return {"get": v if name in ("episode", "context") else iter(v or ()), "exists": v is not None, "iterator": iter((v or {}).items() if isinstance(v, dict) else ())}.get(kind)

            return run

        return type("Variable", (), {k: staticmethod(call(k)) for k in ("get", "exists", "update", "put", "updateValue", "clear", "iterator")})()

    getValueState = getMapState = getListState = _variable

    def listTimers(self):
        self.n += 1
        return iter(list(self.timers))

    def registerTimer(self, at):
        self.n += 1
        self.timers.append(at)

    def deleteTimer(self, at):
        self.n += 1
        self.timers.remove(at)


def test_few_messages_a_key():
    h, p = _Handle(), Episodes(10_000)
    p.init(h)

    def batch(*events):
        h.n = 0
        rows = [(seq, pd.Timestamp(seq, unit="s"), kind, f"f{seq}", [f"g{seq}"], "q", None, None) for seq, kind in events]
        frame = pd.DataFrame(rows, columns=["seq", "at", "action_type", "path", "paths", "query", "line_start", "line_end"])
        out = [r for f in p.handleInputRows(("a",), iter([frame]), None) for r in f[["seq", "run", "step", "action_type", "shows", "files_edited", "recent"]].itertuples(index=False, name=None)]
        return out, h.n

    assert batch((1, "view_file")) == ([], 2)  # asked for the episode, and told
    assert batch((2, "git_diff")) == ([], 1)
    out, n = batch((3, "reset"), (4, "edit_file"))
    assert out == [(3, 1, 0, "reset", "file:f3", 0, ""), (4, 1, 1, "edit_file", "file:f4", 1, "edit_file")] and n == 6 and h.timers == [14_000]
    out, n = batch((5, "edit_files"), (6, "submit"))
    assert out == [(5, 1, 1 + 1, "edit_files", "file:g5", 2, "edit_file,edit_files"), (6, 1, 3, "submit", "file:g5", 2, "edit_file,edit_files,submit")] and n <= 9 and h.timers == []
    assert batch((7, "view_file"), (8, "run_shell")) == ([], 1)  # the run is over
    out, n = batch((9, "reset"))
    assert out == [(9, 2, 0, "reset", "file:f9", 0, "")] and n == 6 and h.timers == [19_000]
    out, _ = batch((30, "view_file"))
    assert [r[3] for r in out] == ["idle"] and h.timers == []


class _State:
    exists = False

    def update(self, x):
        self.get, self.exists = x, True


def test_episodes_of_a_group_at_once():
    """One call for all episodes of a group, in several micro-batches and frames, against a plain walk along the events of each; null ids and kinds too."""
    rnd = random.Random(7)
    state, plain = _State(), {}
    for _ in range(12):
        rows = [(rnd.choice(["a", "b", "c", None]), rnd.randrange(40), rnd.choice(["reset", "submit", "edit_file", "edit_files", "view_file", None])) for _ in range(rnd.choice([1, 9, 50]))]
        frame, at, want = pd.DataFrame(rows, columns=["episode_id", "seq", "action_type"]), rnd.randrange(len(rows)), set()
        for key in {r[0] for r in rows}:
            own = sorted((r for r in rows if r[0] == key), key=lambda r: (r[1], r[2] is None, r[2] or ""))
            step, edits, done, begun = plain.get(key, (0, 0, False, False))
            for _, _, kind in own:
                if kind == "reset":
                    step, edits, done, begun = 0, 0, False, True
                elif begun and not done:
                    step, edits, done = step + 1, edits + (kind in ("edit_file", "edit_files")), kind == "submit"
            plain[key] = step, edits, done, begun
            want.add((key, len(own), step, edits, done))
        (got,) = episode._update((0,), iter([frame[:at], frame[at:]]), state)
        assert {tuple(r) for r in got.itertuples(index=False, name=None)} == want


def test_values_carried_in_a_group():
    """A null takes the value of its own episode's step before, from an earlier micro-batch too."""
    state, frame = _State(), lambda rows: pd.DataFrame(rows, columns=["episode_id", "step", "value"]).astype({"value": "float64"})
    told = lambda *frames: [tuple(None if pd.isna(v) else v for v in r) for f in episode._carry((0,), iter(frames), state) for r in f.itertuples(index=False, name=None)]
    assert told(frame([("b", 2, None), ("a", 1, 5.0)]), frame([("a", 2, None), ("b", 1, None), (None, 1, 7.0)])) == [("a", 1, 5.0), ("a", 2, 5.0), ("b", 1, None), ("b", 2, None), (None, 1, 7.0)]
    assert told(frame([("b", 4, None), ("b", 3, 1.0), (None, 2, None), ("a", 3, None), ("c", 1, None)])) == [("a", 3, 5.0), ("b", 3, 1.0), ("b", 4, 1.0), ("c", 1, None), (None, 2, 7.0)]

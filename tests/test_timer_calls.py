"""What the timers ask of the state store: as little as the stored row leaves open."""

from types import SimpleNamespace

import pytest

from jobtide.schemas import RUNNING
from jobtide.streaming.timers import DueRetries, StuckRuns


class Store:
    """State and timers of one task, as a handle and as its value; ``calls`` counts the searches for timers."""

    def __init__(self):
        self.value, self.timers, self.calls = None, set(), 0

    def getValueState(self, *_):
        return self

    def get(self):
        return self.value

    def exists(self):
        return self.value is not None

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None

    def listTimers(self):
        self.calls += 1
        return list(self.timers)

    def deleteTimer(self, at):
        self.timers.discard(at)

    def registerTimer(self, at):
        self.timers.add(at)


def expire(processor, store, watermark_ms):
    """As the engine does: every timer up to the watermark fires and goes."""
    out = []
    for at in sorted(t for t in store.timers if t <= watermark_ms):
        out += processor.handleExpiredTimer(("t",), SimpleNamespace(getCurrentWatermarkInMs=lambda: watermark_ms), None)
        store.timers.discard(at)
    return out


def failed(second, due):
    return SimpleNamespace(failed_us=second * 10**6, retry_count=1, due_us=due * 10**6)


def ran(status, second, seq):
    return SimpleNamespace(status=status, at_us=second * 10**6, seq=seq, id="h", retry_count=0, max_retries=3, timeout_seconds=30)


CASES = [
    (DueRetries, [failed(0, 5)], [failed(1, 20)], 20_000),
    (StuckRuns, [ran("queued", 0, 1)], [ran(RUNNING, 1, 2)], 91_001),
]


@pytest.mark.parametrize("kind,first,second,last", CASES)
def test_a_newer_row_moves_the_only_timer_without_a_search(kind, first, second, last):
    store, processor = Store(), kind(60_000_000)
    processor.init(store)
    for rows in (first, second, first):
        processor.handleInputRows(("t",), iter(rows), None)
    assert store.timers == {last} and store.calls == 0
    assert len(expire(processor, store, last)) == 1 and len(store.timers) == 1 and store.calls == 0
    assert expire(processor, store, 10**9) == [] and not store.timers and store.value is None


def test_news_of_a_task_that_was_given_out_has_one_timer():
    for kind, rows, newer in ((DueRetries, [failed(0, 5)], [failed(9, 500)]), (StuckRuns, [ran(RUNNING, 0, 1)], [ran(RUNNING, 50, 2)])):
        store, processor = Store(), kind(400_000_000)
        processor.init(store)
        processor.handleInputRows(("t",), iter(rows), None)
        assert len(expire(processor, store, 450_000)) == 1
        processor.handleInputRows(("t",), iter(newer), None)
        assert len(store.timers) == 1
        assert len(expire(processor, store, 10**9)) == 1

"""Cycles of an archive: late messages, edits, a crash, and a rerun that changes nothing."""

from datetime import datetime, timedelta

import pytest

from threadmill.storage import scratch
from threadmill.streaming import cycle as Y

T0 = datetime(2024, 1, 1)
US0 = 1_704_067_200_000_000
MIN = 60_000_000
SOURCE = "id long, channel_id long, thread_id long, author_id long, author_is_bot boolean, is_system boolean, content string, created_at timestamp_ntz, edited_at timestamp_ntz, reply_to_id long"


def row(i, minute, content, reply=None, author=1, edited=None, system=False, channel=7):
    return (i, channel, None, author, False, system, content, T0 + timedelta(minutes=minute), edited, reply)


class Fails(Exception):
    pass


@pytest.mark.parametrize("crash", ["exchanges"])
def test_cycles(spark, monkeypatch, crash):
    rows = [row(1, 0, "is the kernel slow?"), row(2, 5, "the kernel was slow here too, rebuild it with the patch", author=2), row(3, 100, "lol"), row(4, 101, "", system=True), row(9, 200, "open still")]
    channels = spark.createDataFrame([(7, None)], "id long, last_backfilled_message_id long")
    a = Y.Archive(spark, scratch(spark, "archive"), {"code": ("`", 0.15)}, r"\bkernel\b", overlap=1)
    go = lambda minute: a.run_once(spark.createDataFrame(rows, SOURCE), channels, US0 + minute * MIN)
    if crash:
        write = a._write
        monkeypatch.setattr(a, "_write", lambda n, c, df: (_ for _ in ()).throw(Fails()) if n == crash else write(n, c, df))
        with pytest.raises(Fails):
            go(205)
        monkeypatch.setattr(a, "_write", write)
        assert a.ended() == 0 and a.messages().count() == 0
    # The last exchange is open; the small one at 100 has no neighbour near enough that is closed but the first.
    r = go(205)
    assert (r.cycle, r.messages, r.exchanges, r.scored) == (1, 4, 3, 1)
    assert sorted((x.xid, x.id) for x in a.read("exchanges", Y.EXCHANGES).collect()) == [(1, 1), (1, 2), (1, 3)]
    state = lambda: (sorted(map(str, a.messages().collect())), *(sorted(map(str, a.read(n, s).collect())) for n, s in (("exchanges", Y.EXCHANGES), ("parents", Y.PARENTS), ("scores", Y.SCORES))))
    before = state()
    r = go(205)  # nothing new: nothing changes
    assert (r.messages, r.exchanges, r.scored) == (0, 0, 0) and state() == before
    # A late reply to a closed exchange, an edit, and time passes.
    rows += [row(10, 210, "same kernel here", reply=2, author=3), row(2, 5, "edited", author=2, edited=T0 + timedelta(minutes=220))]
    r = go(400)
    assert (r.messages, r.exchanges, r.scored) == (2, 2, 1)
    assert {x.id: x.content for x in a.messages().collect()}[2] == "edited"
    assert sorted((x.xid, x.id) for x in a.read("exchanges", Y.EXCHANGES).collect()) == [(1, 1), (1, 2), (1, 3), (9, 9), (9, 10)]
    rows += [row(11, 500, "and again", reply=10, author=3)]
    r = go(900)
    assert (r.messages, r.exchanges, r.scored) == (1, 1, 1)
    assert [(x.xid, x.parent) for x in a.read("parents", Y.PARENTS).collect()] == [(11, 9)]
    after = state()
    go(900)
    assert state() == after

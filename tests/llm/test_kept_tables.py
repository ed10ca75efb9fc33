"""What a worker keeps between tasks: one table, dropped when another operator asks."""

import weakref

from sightline.llm.common import drop_kept, kept_table


class Table:
    pass


def test_one_table_at_a_time():
    first = kept_table(("a", 1), Table)
    assert kept_table(("a", 1), Table) is first
    seen = weakref.ref(first)
    del first
    kept_table(("a", 2), Table)
    assert seen() is None
    other = weakref.ref(kept_table(("b", 2), Table))
    drop_kept()
    assert other() is None

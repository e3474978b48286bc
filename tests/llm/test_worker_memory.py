"""A worker keeps one operator's things at a time."""

import os

from ticketloom.llm import worker_memory


def test_kept_until_another_operator_begins():
    made = []

    def make(name):
        made.append(name)
        return [name]

    first = worker_memory.remembered("a", lambda: make("a"))
    assert worker_memory.remembered("a", lambda: make("again")) is first
    assert worker_memory.remembered("b", lambda: make("b")) == ["b"]
    assert worker_memory.remembered("a", lambda: make("a")) is not first
    assert made == ["a", "b", "a"]
    worker_memory.let_go()
    worker_memory.let_go()
    assert worker_memory.remembered("a", lambda: make("a")) == ["a"]
    assert made == ["a", "b", "a", "a"]


def test_a_group_s_memory_goes_back_to_the_system():
    def resident():
        with open("/proc/self/statm") as sizes:
            return int(sizes.read().split()[1]) * os.sysconf("SC_PAGE_SIZE")

    def group(n):
        small = [bytes(1_000) for _ in range(n)]  # too small to be mapped each
        return small[-1:]

    before = resident()
    last = worker_memory.freed(group, 200_000)
    assert len(last) == 1 and resident() - before < 50_000_000

"""What a task has freed goes back to the system before the worker's next task."""

import re
from pathlib import Path

from lavra.llm.common import released


def _held() -> int:
    return sum(map(int, re.findall(r"\nPss_Anon:\s+(\d+)", Path("/proc/self/smaps_rollup").read_text()))) // 1024


def test_freed_memory_is_given_back():
    kept = []

    def run(batches):
        for b in batches:
            lines = [bytes(50_000) for _ in range(2_000)]
            kept.extend(lines[::100])  # what lives on keeps the rest of the heap from shrinking by itself
            yield b

    before = _held()
    rows = released(run)(iter(range(3)))
    assert [next(rows) for _ in range(3)] == [0, 1, 2]
    assert list(rows) == []
    assert _held() - before < 30

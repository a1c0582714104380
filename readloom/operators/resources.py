"""How many tasks a scan gets: CPU lists, cores, and the split between files and threads of a file."""

from __future__ import annotations

import os


def cpu_list_size(text: str) -> int:
    """How many CPUs a list such as "0-3,8" names; 0 if it is malformed."""
    total = 0
    for part in filter(None, (p.strip() for p in text.split(","))):
        first, _, last = part.partition("-")
        if not first.isdigit() or (last and not last.isdigit()) or (last and int(last) < int(first)):
            return 0
        total += int(last or first) - int(first) + 1
    return total


def detect_cores() -> int:
    for find in (lambda: len(os.sched_getaffinity(0)), os.cpu_count, lambda: int(os.environ["SLURM_CPUS_PER_TASK"])):
        try:
            if (n := find()) and n > 0:
                return n
        except (AttributeError, KeyError, ValueError, OSError):
            continue
    return 1


def thread_count(threads: object, most: int | None = None) -> int:
    """threads between 1 and the most there are; anything that is no such number is 1."""
    if not isinstance(threads, int) or isinstance(threads, bool) or threads <= 1:
        return 1
    return min(threads, most or detect_cores())


def worker_count(workers: object) -> int:
    """How many files at once; anything but a number of 1 or more is 1."""
    return workers if isinstance(workers, int) and not isinstance(workers, bool) and workers >= 1 else 1


def parallel_plan(threads: int, workers: int | None = None, auto_threads: bool = False, n_files: int = 1, cores: int | None = None) -> tuple[int, int]:
    """(threads of a file, files at once). With auto_threads the product stays within the cores."""
    if not isinstance(threads, int) or isinstance(threads, bool) or threads < 1:
        raise ValueError("threads must be a positive integer")
    if not isinstance(auto_threads, bool):
        raise ValueError("auto_threads must be True or False")
    if workers is None:
        return threads, 1
    at_once = min(worker_count(workers), max(1, n_files))
    if not auto_threads or at_once == 1:
        return threads, at_once
    have = cores or detect_cores()
    wanted = min(threads, have)
    at_once = max(1, min(at_once, have // wanted))
    return max(1, min(wanted, have // at_once)), at_once


def compression_level(level: int) -> int:
    """-1 or 1 to 9; anything else is -1."""
    return level if 1 <= level <= 9 else -1

"""Bounds of path enumeration."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Limits:
    """Blocks of a path, paths of a function, and visits of a loop header in one path, at most."""

    max_length: int = 1000
    max_paths: int = 10000
    loop_unroll: int = 3


QUICK, DEFAULT, THOROUGH = Limits(100, 1000, 2), Limits(), Limits(10000, 100000, 5)

"""State that a Python worker keeps between tasks."""

from __future__ import annotations

import sys
import types
from collections.abc import Callable
from typing import Any


def once(name: str, make: Callable[[], Any]) -> Any:
    """The worker's object of this name, made at its first use.  Functions are shipped by value, so their own globals last one task only."""
    home = sys.modules.setdefault("_spanloom_worker", types.ModuleType("_spanloom_worker"))
    if not hasattr(home, name):
        setattr(home, name, make())
    return getattr(home, name)

"""Operators by name, with their one-line description."""

from __future__ import annotations

import inspect
from collections.abc import Callable

from tracesift.operators import firewall, flows, graph, hunts, intel, logs, netops, ot, posture

_FAMILIES = (logs, firewall, flows, hunts, ot, netops, intel, graph, posture)


def operators() -> dict[str, Callable]:
    """``family.name`` -> function, for every public operator."""
    return {
        f"{module.__name__.rsplit('.', 1)[-1]}.{name}": fn
        for module in _FAMILIES
        for name, fn in vars(module).items()
        if inspect.isfunction(fn) and fn.__module__ == module.__name__ and not name.startswith("_")
    }


def describe() -> dict[str, str]:
    """``family.name`` -> first line of its documentation."""
    return {name: (inspect.getdoc(fn) or "").split("\n")[0] for name, fn in operators().items()}

"""Plug-ins by name."""

from __future__ import annotations

from typing import Generic, TypeVar

T = TypeVar("T")


class Registry(Generic[T]):
    """What is registered under a name; a second registration replaces the first."""

    def __init__(self, what: str):
        self.what, self.known = what, {}

    def register(self, name: str, item: T) -> T:
        self.known[name] = item
        return item

    def __getitem__(self, name: str) -> T:
        if name not in self.known:
            raise KeyError(f"no {self.what} {name!r}; there are {sorted(self.known)}")
        return self.known[name]

    def names(self) -> list[str]:
        return sorted(self.known)

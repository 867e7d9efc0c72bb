"""A small dependency container: lifetimes, scopes, cycles named by their path."""

from __future__ import annotations

import functools
import inspect
import typing
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from typing import Any

from codeloom.runtime.errors import DependencyError


class Container:
    def __init__(self):
        self.makers: dict[Any, tuple[Callable, str]] = {}
        self.single: dict[Any, Any] = {}
        self.scoped: dict[Any, Any] | None = None

    def register(self, kind: Any, maker: Callable | None = None, lifetime: str = "singleton") -> bool:
        """The first registration of a kind stays; a later one is ignored (False)."""
        if kind in self.makers or kind in self.single:
            return False
        self.makers[kind] = (maker or kind, lifetime)
        return True

    def instance(self, kind: Any, value: Any) -> None:
        if isinstance(kind, type) and not isinstance(value, kind):
            raise DependencyError(f"not a {kind.__name__}")
        self.single[kind] = value

    @contextmanager
    def scope(self) -> Iterator[Container]:
        before, self.scoped = self.scoped, {}
        try:
            yield self
        finally:
            self.scoped = before

    def resolve(self, kind: Any, path: tuple = ()) -> Any:
        if kind in self.single:
            return self.single[kind]
        if self.scoped is not None and kind in self.scoped:
            return self.scoped[kind]
        if kind in path:
            raise DependencyError("circular: " + " -> ".join(k.__name__ for k in (*path[path.index(kind) :], kind)))
        maker, lifetime = self.makers.get(kind, (kind if isinstance(kind, type) else None, "transient"))
        if maker is None:
            raise DependencyError(f"nothing registered for {kind}")
        value = maker(**{n: self.resolve(k, (*path, kind)) for n, k in needs(maker).items()})
        if lifetime == "singleton":
            self.single[kind] = value
        elif lifetime == "scoped":
            if self.scoped is None:
                raise DependencyError("a scoped kind needs a scope")
            self.scoped[kind] = value
        return value

    def edges(self) -> list[tuple[str, str]]:
        """(node, depends_on) of all registered kinds, as data."""
        return [(k.__name__, d.__name__) for k, (m, _) in self.makers.items() for d in needs(m).values()]


def singleton(container: Container) -> Callable[[type], type]:
    """A class decorator: registers the class as one that is made once."""

    def mark(kind: type) -> type:
        container.register(kind)
        return kind

    return mark


def inject(container: Container) -> Callable[[Callable], Callable]:
    """A function decorator: parameters that the caller leaves out are resolved by their classes."""

    def wrap(f: Callable) -> Callable:
        wanted = needs(f)

        @functools.wraps(f)
        def call(*args, **given):
            bound = inspect.signature(f).bind_partial(*args, **given).arguments
            return f(*args, **given, **{n: container.resolve(k) for n, k in wanted.items() if n not in bound})

        return call

    return wrap


def needs(maker: Callable) -> dict[str, Any]:
    """Parameters without defaults and their classes, from type hints."""
    target = maker.__init__ if inspect.isclass(maker) else maker
    try:
        hints = typing.get_type_hints(target)
        params = inspect.signature(target).parameters
    except (TypeError, ValueError, NameError):
        return {}
    return {n: hints[n] for n, p in params.items() if n != "self" and p.default is p.empty and isinstance(hints.get(n), type)}

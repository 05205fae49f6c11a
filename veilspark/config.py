"""Switches for features that are not settled."""

from __future__ import annotations

from contextlib import contextmanager


class Flag:
    def __init__(self, name: str, default: bool):
        self.name, self.default, self._state = name, default, default

    def enabled(self) -> bool:
        return self._state

    def enable(self) -> None:
        self._state = True

    def disable(self) -> None:
        self._state = False

    def reset(self) -> None:
        self._state = self.default

    @contextmanager
    def _held(self, state: bool):
        before, self._state = self._state, state
        try:
            yield self
        finally:
            self._state = before

    def on(self):
        """Enabled within a with block."""
        return self._held(True)

    def off(self):
        return self._held(False)

    def require(self) -> None:
        if not self._state:
            raise RuntimeError(f"{self.name} is off; turn it on with config.features.{self.name}.enable()")


class Features:
    def __init__(self):
        self.auto_partition_selection = Flag("auto_partition_selection", False)

    def __iter__(self):
        return iter(vars(self).values())


class Config:
    def __init__(self):
        self.features = Features()


config = Config()

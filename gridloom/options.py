"""Options of command-line programs: --name=value, with defaults, and a list of what wasn't used."""

from __future__ import annotations


class Options:
    def __init__(self, args: list[str]):
        self.values, self.used = {}, set()
        for a in args:
            if not a.startswith("--"):
                raise ValueError(f"{a!r} isn't an option: --name=value is needed")
            name, sep, value = a[2:].partition("=")
            self.values[name] = value if sep else "1"

    def has(self, name: str) -> bool:
        return name in self.values

    def get(self, name: str, default=None):
        """The value, as the default's type; without a default it must be there."""
        self.used.add(name)
        if name not in self.values:
            if default is None:
                raise ValueError(f"--{name} is needed")
            return default
        text = self.values[name]
        if isinstance(default, bool):
            return text not in ("", "0", "false")
        return type(default)(text) if default is not None else text

    def files(self, name: str) -> list[str]:
        """A comma list; patterns are left to spark.read, which expands them."""
        return [p for p in self.get(name, "").split(",") if p]

    def unused(self) -> list[str]:
        return sorted(set(self.values) - self.used)

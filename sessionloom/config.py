"""The collector's configuration: a TOML file, checked as a whole before anything is done."""

from __future__ import annotations

import tomllib
from dataclasses import dataclass, field
from pathlib import Path
from urllib.parse import urlsplit

from .operators.policy import Policy, need, only
from .sources.normalize import ADAPTERS

DEFAULT = "~/.sessionloom"


@dataclass(frozen=True)
class Source:
    harness: str
    path: str


@dataclass(frozen=True)
class Store:
    """A remote that is a folder any of Spark's file systems knows (``s3a://bucket/prefix``, ``hdfs://``, ``file://``)."""

    name: str
    uri: str

    def checked(self) -> Store:
        need(bool(urlsplit(self.uri).scheme), f"remote {self.name!r} needs a URI with a scheme")
        return self


@dataclass(frozen=True)
class Service:
    """A remote that is a service over HTTP."""

    name: str
    url: str
    archive: str
    token_env: str

    def checked(self) -> Service:
        url = urlsplit(self.url)
        local = url.hostname in ("localhost", "127.0.0.1", "::1")
        need(url.scheme == "https" or (url.scheme == "http" and local), f"remote {self.name!r} must use https unless it is on this machine")
        need(bool(self.archive) and bool(self.token_env), f"remote {self.name!r} needs an archive and the variable that holds its token")
        return self


KINDS = {"store": Store, "service": Service}


@dataclass(frozen=True)
class Config:
    state_dir: str = ""
    flush_seconds: int = 5
    max_records: int = 1000
    max_bytes: int = 8 << 20
    rescan_seconds: int = 30
    compact_seconds: int = 600
    compact_max_bytes: int = 128 << 20
    sources: tuple[Source, ...] = ()
    remotes: tuple[Store | Service, ...] = ()
    policy: Policy = field(default_factory=Policy)

    def checked(self) -> Config:
        numbers = ("flush_seconds", "max_records", "max_bytes", "rescan_seconds", "compact_seconds", "compact_max_bytes")
        wrong = [n for n in numbers if type(getattr(self, n)) is not int or getattr(self, n) < 1]
        need(not wrong, f"these must be whole numbers from 1 on: {', '.join(wrong)}")
        unknown = sorted({s.harness for s in self.sources} - set(ADAPTERS))
        need(not unknown, f"no harness is called {', '.join(unknown)}")
        names = [r.name for r in self.remotes]
        need(all(isinstance(n, str) and n for n in names) and len(set(names)) == len(names), "remotes need names that differ")
        for r in self.remotes:
            r.checked()
        self.policy.checked()
        return self

    @property
    def archive(self) -> str:
        return f"{self.state_dir}/batches"

    def remote(self, name: str) -> Store | Service:
        found = [r for r in self.remotes if r.name == name]
        need(bool(found), f"no remote is called {name!r}")
        return found[0]


def parse(value: dict) -> Config:
    only(value, Config.__dataclass_fields__, "the configuration")
    own = dict(value)
    own["sources"] = tuple(Source(**only(x, ("harness", "path"), "a source")) for x in own.get("sources", ()))
    remotes = []
    for x in own.get("remotes", ()):
        kind = KINDS.get(x.get("kind"))
        need(kind is not None, f"a remote's kind is one of {', '.join(KINDS)}")
        remotes.append(kind(**only({k: v for k, v in x.items() if k != "kind"}, kind.__dataclass_fields__, "a remote")))
    own["remotes"] = tuple(remotes)
    own["policy"] = Policy.read(own.get("policy", {}))
    return Config(**own)


def load(path: str | None = None, state_dir: str | None = None, home: str | None = None) -> Config:
    """The configuration of a file, or of the state folder's ``config.toml`` if it is there; fields left out have their defaults."""
    base = Path(home) / ".sessionloom" if home else Path(DEFAULT).expanduser()
    at = Path(path) if path else base / "config.toml"
    need(path is None or at.exists(), f"there is no configuration at {at}")
    value = {}
    if at.exists():
        try:
            value = tomllib.loads(at.read_text())
        except tomllib.TOMLDecodeError as e:
            raise ValueError(f"{at} is no TOML: {e}") from None
    config = parse(value | ({"state_dir": state_dir} if state_dir else {}))
    if not config.state_dir:
        config = Config(**{n: getattr(config, n) for n in Config.__dataclass_fields__ if n != "state_dir"}, state_dir=str(base))
    return config.checked()

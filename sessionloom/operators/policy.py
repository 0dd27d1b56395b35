"""What a comparison of runs is judged by: matching, criteria and thresholds, all checked before any work."""

from __future__ import annotations

import math
import os
from dataclasses import asdict, dataclass, field
from urllib.parse import urlsplit

from ..functions.payloads import dumps

MATCHING = ("bm25", "strict", "unordered", "required")
#: What each dimension asks of a step, and the kinds of events that may head one.
DIMENSIONS = {
    "tool_correctness": "Look at the use of the tool alone: was it a fitting one, with fitting arguments, and was what it gave back taken up correctly? A tool that failed may still have been the right one.",
    "progress": "Look at progress alone: does the step bring the task nearer to its end, or confirm with evidence that it is there? Repetition, side tracks and claims without evidence do not.",
}
TOOL_KINDS = ("tool_call", "tool_result")
CHECK_FIELDS = {"final_equals": ("expected",), "final_contains": ("text",), "tool_result_contains": ("tool", "text"), "artifact_sha256": ("path", "sha256")}
#: Wire formats of models: two that answer in words, one that only chooses.
PROTOCOLS = ("chat_completions", "messages", "choice")


def need(ok: bool, what: str) -> None:
    if not ok:
        raise ValueError(what)


def only(value: dict, allowed, where: str) -> dict:
    """A JSON object without fields that nobody knows."""
    need(isinstance(value, dict), f"{where} must be an object")
    unknown = sorted(set(value) - set(allowed))
    need(not unknown, f"{where} has unknown fields: {', '.join(unknown)}")
    return value


def _words(x) -> bool:
    return isinstance(x, str) and bool(x.strip())


@dataclass(frozen=True)
class Milestone:
    id: str
    description: str
    oracle_steps: tuple[int, ...] = ()


@dataclass(frozen=True)
class Check:
    """A declared outcome; ``values`` as the fields of its kind."""

    kind: str
    id: str
    values: tuple[tuple[str, str], ...]

    def __getitem__(self, name: str) -> str:
        return dict(self.values)[name]

    def checked(self) -> Check:
        need(self.kind in CHECK_FIELDS, f"no outcome check is called {self.kind!r}")
        need(_words(self.id), "an outcome check needs an id")
        need({k for k, _ in self.values} == set(CHECK_FIELDS[self.kind]), f"{self.kind} has the fields {', '.join(CHECK_FIELDS[self.kind])}")
        need(all(isinstance(v, str) and v for _, v in self.values), f"outcome check {self.id!r} has an empty field")
        if self.kind == "tool_result_contains":
            need(_words(self["tool"]), f"outcome check {self.id!r} names no tool")
        if self.kind == "artifact_sha256":
            digest = self["sha256"]
            need(os.path.isabs(self["path"]) and len(digest) == 64 and set(digest) <= set("0123456789abcdefABCDEF"), f"outcome check {self.id!r} needs an absolute path and 64 hex digits")
        return self


@dataclass(frozen=True)
class Criteria:
    """Steps of the reference are numbered from 1."""

    required_steps: tuple[int, ...] = ()
    milestones: tuple[Milestone, ...] = ()
    outcome_checks: tuple[Check, ...] = ()

    @staticmethod
    def read(value: dict) -> Criteria:
        only(value, ("required_steps", "milestones", "outcome_checks"), "criteria")
        milestones = []
        for m in value.get("milestones", []):
            only(m, ("id", "description", "oracle_steps"), "a milestone")
            milestones.append(Milestone(m["id"], m["description"], tuple(m.get("oracle_steps", ()))))
        checks = []
        for c in value.get("outcome_checks", []):
            kind = c.get("kind") if isinstance(c, dict) else None
            only(c, ("kind", "id", *CHECK_FIELDS.get(kind, ())), "an outcome check")
            checks.append(Check(kind, c.get("id", ""), tuple(sorted((k, v) for k, v in c.items() if k not in ("kind", "id")))))
        return Criteria(tuple(value.get("required_steps", ())), tuple(milestones), tuple(checks))

    def checked(self, steps: int | None = None) -> Criteria:
        """Complain about what is wrong by itself or, with ``steps``, for a reference of that many."""

        def is_step(n) -> bool:
            return type(n) is int and n >= 1 and (steps is None or n <= steps)

        need(all(is_step(n) for n in self.required_steps) and len(set(self.required_steps)) == len(self.required_steps), "required steps must be different steps of the reference")
        need(all(_words(m.id) and _words(m.description) for m in self.milestones), "a milestone needs an id and a description")
        need(len({m.id for m in self.milestones}) == len(self.milestones), "two milestones have one id")
        need(all(is_step(n) for m in self.milestones for n in m.oracle_steps), "a milestone names a step that the reference doesn't have")
        for c in self.outcome_checks:
            c.checked()
        need(len({c.id for c in self.outcome_checks}) == len(self.outcome_checks), "two outcome checks have one id")
        return self


@dataclass(frozen=True)
class Model:
    """Where a model is asked."""

    protocol: str
    endpoint: str
    model: str
    token_env: str | None = None
    max_tokens: int = 4096

    @staticmethod
    def read(value: dict) -> Model:
        return Model(**only(value, ("protocol", "endpoint", "model", "token_env", "max_tokens"), "a model"))

    def checked(self) -> Model:
        need(self.protocol in PROTOCOLS, f"a model's protocol is one of {', '.join(PROTOCOLS)}")
        url = urlsplit(self.endpoint)
        need(not (url.username or url.password or url.query or url.fragment), "a model's endpoint holds no credentials or parameters; name a variable in token_env")
        need(bool(url.hostname) and (url.scheme == "https" or (url.scheme == "http" and url.hostname in ("localhost", "127.0.0.1", "::1"))), "a model's endpoint must use https unless it is on this machine")
        need(_words(self.model) and type(self.max_tokens) is int and self.max_tokens > 0, "a model needs a name and a positive max_tokens")
        return self


@dataclass(frozen=True)
class Policy:
    """How runs are compared; ``checked`` before use."""

    matching: str = "bm25"
    min_similarity: float = 0.1
    max_steps: int = 2000
    max_input_bytes: int = 1 << 20
    rubric: str = "Is the step right, does it help with what the user asked for, and does it agree with what the tools returned? Another way to the same end is as good."
    dimensions: tuple[str, ...] = ("tool_correctness", "progress")
    criteria: Criteria = field(default_factory=Criteria)
    judge: Model | None = None
    reporter: Model | None = None

    @staticmethod
    def read(value: dict) -> Policy:
        only(value, Policy.__dataclass_fields__, "the comparison's policy")
        own = dict(value)
        own["dimensions"] = tuple(own.get("dimensions", Policy.dimensions))
        own["criteria"] = Criteria.read(own.get("criteria", {}))
        for name in ("judge", "reporter"):
            own[name] = Model.read(own[name]) if own.get(name) else None
        return Policy(**own)

    def checked(self, steps: int | None = None) -> Policy:
        need(self.matching in MATCHING, f"matching is one of {', '.join(MATCHING)}")
        need(math.isfinite(self.min_similarity) and self.min_similarity >= 0, "min_similarity must be a number from 0 on")
        need(1 <= self.max_steps <= 4000 and self.max_input_bytes > 0, "max_steps must be 1..4000 and max_input_bytes positive")
        need(set(self.dimensions) <= set(DIMENSIONS) and len(set(self.dimensions)) == len(self.dimensions), f"dimensions are different ones of {', '.join(DIMENSIONS)}")
        need(self.reporter is None or self.reporter.protocol != "choice", "a model that only makes choices can't write reports")
        for model in (self.judge, self.reporter):
            if model:
                model.checked()
        need(self.matching != "required" or bool(self.criteria.required_steps), "matching by required steps needs some")
        self.criteria.checked(steps)
        return self

    def text(self) -> str:
        """Canonical JSON, for equality and ids."""
        return dumps(asdict(self))


def eligible(dimension: str, head_kind):
    """Which steps a dimension applies to, as a column of the head's kind."""
    return head_kind.isin(*TOOL_KINDS) if dimension == "tool_correctness" else head_kind.isNotNull()


@dataclass(frozen=True)
class Gates:
    """Thresholds of a check; None asks for nothing."""

    max_missing_steps: int = 0
    max_extra_steps: int = 0
    max_changed_steps: int = 0
    min_quality: float | None = None
    min_required_coverage: float | None = None
    min_tool_correctness: float | None = None
    min_progress: float | None = None
    max_repetition_ratio: float | None = None
    require_outcome: bool = False

    def checked(self) -> Gates:
        shares = (self.min_quality, self.min_required_coverage, self.min_tool_correctness, self.min_progress, self.max_repetition_ratio)
        need(all(x is None or (math.isfinite(x) and 0 <= x <= 1) for x in shares), "thresholds must be from 0 to 1")
        need(min(self.max_missing_steps, self.max_extra_steps, self.max_changed_steps) >= 0, "numbers of steps can't be negative")
        return self

    def needs_judge(self) -> bool:
        return any(x is not None for x in (self.min_quality, self.min_tool_correctness, self.min_progress))


@dataclass(frozen=True)
class HumanGates:
    require_human_label: bool = False
    min_human_quality: float | None = None
    min_human_coverage: float | None = None
    allow_synthetic: bool = False

    def checked(self) -> HumanGates:
        need(all(x is None or (math.isfinite(x) and 0 <= x <= 1) for x in (self.min_human_quality, self.min_human_coverage)), "human thresholds must be from 0 to 1")
        return self

"""A line-oriented browser of archived sessions; nothing in it calls a model."""

from __future__ import annotations

import json
import os
from typing import TextIO

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .functions.columns import terminal_safe
from .functions.files import save
from .operators import query as Q
from .operators import runs as R
from .operators.plan import plan
from .operators.policy import Policy, need

PAGE = 15
HELP = "list [text] | next | prev | show N | oracle N | candidate N | save | preview | quit"


class Browser:
    """One page of sessions at a time is on the driver."""

    def __init__(self, events: DataFrame, pair_path: str, source: dict | None = None):
        self.events, self.pair_path, self.source = events, pair_path, source or {}
        self.chosen: dict[str, tuple[str, str]] = {}
        self.find("")

    def find(self, text: str) -> None:
        self.found, self.offset = Q.search_sessions(self.events, text).orderBy(*Q.SESSION), 0
        self.total = self.found.count()

    def page(self) -> list:
        return self.found.offset(self.offset).limit(PAGE).select(*Q.SESSION, "events", terminal_safe(F.coalesce("preview", F.lit(""))).alias("preview")).collect()

    def at(self, word: str) -> tuple[str, str]:
        need(word.isdigit() and 1 <= int(word) <= self.total, "give the number of a session in the list")
        r = self.found.offset(int(word) - 1).limit(1).collect()[0]
        return r["harness"], r["session_id"]

    def show(self, key: tuple[str, str], out: TextIO) -> None:
        own = self.events.where((F.col("harness") == key[0]) & (F.col("session_id") == key[1])).orderBy(*Q.ORDER)
        text = terminal_safe(F.coalesce("text", "payload_json"))
        for r in own.select(terminal_safe("id").alias("id"), "kind", F.coalesce("role", F.lit("")).alias("role"), text.alias("text")).toLocalIterator():
            out.write(f"{r['id']} {r['kind']} {r['role']}\n{r['text']}\n")

    def pair(self) -> dict:
        need(len(self.chosen) == 2, "choose an oracle and a candidate first")
        out = dict(self.source)
        for side, (harness, session) in self.chosen.items():
            out |= {f"{side}_harness": harness, f"{side}_session": session}
        return out

    def preview(self) -> dict:
        """The alignment of the chosen two, without any judging."""
        p = self.pair()
        keys = [(p[f"{s}_harness"], p[f"{s}_session"]) for s in ("oracle", "candidate")]
        own = self.events.join(self.events.sparkSession.createDataFrame(keys, "harness string, session_id string").distinct(), list(Q.SESSION), "left_semi")
        runs = R.trajectories(own)
        ids = {(r["harness"], r["session_id"]): r["run"] for r in runs.runs.collect()}
        made = plan(self.events.sparkSession.createDataFrame([("p", ids[keys[0]], ids[keys[1]])], "pair string, oracle string, candidate string"), runs, Policy())
        rows = made.alignment.orderBy("candidate_step").collect()  # the steps of one run
        return {"alignment": [{k: r[k] for k in ("candidate_step", "oracle_step", "similarity")} for r in rows], "diagnostics": made.diagnostics.drop("pair").first().asDict(), "steps": "numbered from 0 in the alignment"}

    def do(self, line: str, out: TextIO) -> bool:
        """One command; false to end.  What goes wrong is told and changes nothing."""
        word, _, rest = line.strip().partition(" ")
        if word in ("quit", "q"):
            return False
        try:
            if word == "list":
                self.find(rest)
            elif word == "next":
                self.offset += PAGE if self.offset + PAGE < self.total else 0
            elif word == "prev":
                self.offset = max(0, self.offset - PAGE)
            elif word == "show":
                self.show(self.at(rest), out)
            elif word in ("oracle", "candidate"):
                self.chosen[word] = self.at(rest)
            elif word == "save":
                value = self.pair()
                need(not os.path.exists(self.pair_path), "the pair's file is there already; name another")
                save(self.pair_path, json.dumps(value, indent=2).encode())
                out.write(f"saved {self.pair_path}\n")
            elif word == "preview":
                out.write(json.dumps(self.preview(), indent=2) + "\n")
            else:
                need(False, f"commands: {HELP}")
        except ValueError as e:
            out.write(f"error: {e}\n")
        return True

    def run(self, lines: TextIO, out: TextIO) -> None:
        out.write(f"{HELP}\n")
        while True:
            for k, r in enumerate(self.page(), self.offset + 1):
                flat = r["preview"].replace("\n", " ")
                out.write(f"{k}. {r['harness']} {r['session_id']} ({r['events']} events) {flat}\n")
            named = {side: self.chosen.get(side, ("", "none"))[1] for side in ("oracle", "candidate")}
            out.write(f"{self.total} sessions; oracle {named['oracle']}, candidate {named['candidate']} > ")
            out.flush()
            line = lines.readline()
            if not line or not self.do(line, out):
                return

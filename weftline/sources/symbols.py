"""The symbol table and clock file of a trace directory: small, read on the driver."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession

from weftline.sources.schemas import SCHEMAS

VERSION = "11.0"


@dataclass
class Symbols:
    processors: int = 0
    papi_total: int = 0
    papi_names: dict[int, str] = field(default_factory=dict)
    collections: list[tuple[int, str, int]] = field(default_factory=list)  # id, name, ndims
    methods: list[tuple[int, str, int, int]] = field(default_factory=list)  # id, name, collection, message
    messages: list[tuple[int, int]] = field(default_factory=list)  # id, size
    events: dict[int, str] = field(default_factory=dict)
    stats: dict[int, str] = field(default_factory=dict)

    def event_id(self, name: str) -> int:
        """Id of a user event by its exact name, else -1."""
        return next((k for k, v in self.events.items() if v == name), -1)

    @property
    def first_collection(self) -> int:
        return self.methods[0][2] if self.methods else 0

    def layout(self) -> list[tuple[int, int, int]]:
        """(ep_id, collection_id, ndims) of each method; the last registration of an id holds."""
        dims = {c: n for c, _, n in self.collections}
        return sorted({ep: (ep, c, dims.get(c, 0)) for ep, _, c, _ in self.methods}.values())

    def tables(self, spark: SparkSession) -> dict[str, DataFrame]:
        rows = {"chare_collection": self.collections, "entry_method": self.methods, "message_type": self.messages}
        return {n: spark.createDataFrame(r, SCHEMAS[n]) for n, r in rows.items()}


def _ints(words: list[str]) -> list[int]:
    return [int(w) for w in words]


def parse_symbols(text: str) -> Symbols:
    """Symbol table of format version 11.0; another or no version is an error.

    Names of events and statistics are the rest of their line, and the first
    registration of an id holds.
    """
    s, version = Symbols(), None
    quoted = re.compile(r'^(ENTRY\s+)?CHARE\s+(-?\d+)\s+"(.*)"\s+(-?\d+)(?:\s+(-?\d+))?')
    for line in text.splitlines():
        words = line.split()
        if not words:
            continue
        key = words[0]
        if key == "VERSION":
            version = words[1].strip('"') if len(words) > 1 else ""
            if version != VERSION:
                raise ValueError(f"trace format {version}: only {VERSION} can be read")
        elif key in ("CHARE", "ENTRY") and (m := quoted.match(line.strip())):
            if m[1]:
                s.methods.append((int(m[2]), m[3], int(m[4]), int(m[5] or 0)))
            else:
                s.collections.append((int(m[2]), m[3], int(m[4])))
        elif key == "MESSAGE":
            s.messages.append((int(words[1]), int(words[2])))
        elif key == "PROCESSORS":
            s.processors = int(words[1])
        elif key == "TOTAL_PAPI_EVENTS":
            s.papi_total = int(words[1])
        elif key == "PAPI_EVENT":
            s.papi_names[int(words[1])] = words[2] if len(words) > 2 else ""
        elif key in ("EVENT", "STAT"):
            named = line.strip().split(None, 2)
            (s.events if key == "EVENT" else s.stats).setdefault(int(named[1]), named[2].strip() if len(named) > 2 else "")
    if version is None:
        raise ValueError("the symbol table names no format version")
    return s


def parse_clock(text: str) -> tuple[int, int]:
    """(global start, global end) in us; 0 where missing."""
    found = {m[1]: int(m[2]) for m in re.finditer(r"^RC_GLOBAL_(START|END)_TIME\s+(-?\d+)", text, re.MULTILINE)}
    return found.get("START", 0), found.get("END", 0)

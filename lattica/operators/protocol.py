"""Policy search, freezing, one-shot evaluation and configuration checks: control tables and documents on the driver."""

from __future__ import annotations

import itertools
import json
import os
import time
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.metrics import best_per_group
from lattica.sources import shared_files as sf
from lattica.sources.io import document_hash


def search(df: DataFrame, by: list[str], value: str, policy_hash: str, policy_id: str, minimise: bool = True) -> DataFrame:
    """O1: best policy of each group; ties by hash, then id."""
    v = F.col(value).asc_nulls_last() if minimise else F.col(value).desc_nulls_last()
    return best_per_group(df, by, [v, F.col(policy_hash), F.col(policy_id)])


def grid(options: dict[str, list], prune=None) -> list[dict]:
    """All combinations, in order, that the rule keeps."""
    keys = list(options)
    rows = (dict(zip(keys, v, strict=True)) for v in itertools.product(*options.values()))
    return [r for r in rows if prune is None or prune(r)]


def multiplier_rule(r: dict) -> bool:
    """Three times and more needs a similarity of .85, twice .80."""
    m, s = r["multiplier"], r["similarity"]
    return s >= 0.85 if m >= 3 else s >= 0.80 if m >= 2 else True


def freeze(policy: dict) -> dict:
    """O2: the policy with its hash."""
    return {"policy": policy, "policy_hash": document_hash(policy)}


def verify(envelope: dict) -> dict:
    if document_hash(envelope["policy"]) != envelope["policy_hash"]:
        raise ValueError("the frozen policy was changed")
    return envelope["policy"]


@dataclass
class Registry:
    """Each unit is evaluated once: reserved, prediction_complete, metrics_complete, or failed_or_uncertain.

    A state is a file that is created exclusively, so of two claims one fails.
    ``root`` is a folder of the driver.
    """

    root: str
    NEXT = {None: ("reserved",), "reserved": ("prediction_complete", "failed_or_uncertain"), "prediction_complete": ("metrics_complete", "failed_or_uncertain")}

    def _path(self, unit: str, state: str) -> str:
        return os.path.join(self.root, f"{document_hash(unit)[:24]}.{state}.json")

    def state(self, unit: str) -> str | None:
        for s in ("failed_or_uncertain", "metrics_complete", "prediction_complete", "reserved"):
            if os.path.exists(self._path(unit, s)):
                return s
        return None

    def move(self, unit: str, state: str, payload: dict | None = None) -> None:
        now = self.state(unit)
        if state not in self.NEXT.get(now, ()):
            raise ValueError(f"{unit}: {now} can't become {state}")
        os.makedirs(self.root, exist_ok=True)
        with open(self._path(unit, state), "x") as f:
            json.dump({"unit": unit, "state": state, "payload": payload or {}}, f, sort_keys=True)

    def stale(self, units: list[str]) -> list[str]:
        """Units that were begun and not ended."""
        return [u for u in units if self.state(u) in ("reserved", "prediction_complete")]


class ClaimError(ValueError):
    """A unit that is claimed already, or a step that isn't the next one."""


@dataclass
class SharedRegistry:
    """O3, O4 for several drivers: the same states in a folder that all of them reach, with times, so that stale claims end.

    Step k of a unit is one file that can be created once, whatever state it holds: of two drivers that move a unit, or of
    one that completes it and another that gives it up, one wins.  A unit that was given up is never evaluated again.
    """

    spark: SparkSession
    root: str

    def _file(self, unit: dict | str, step: int) -> str:
        key = document_hash(unit)
        return f"{self.root}/{key[:2]}/{key}.{step}.json"

    def records(self, unit: dict | str) -> list[dict]:
        """What is known of a unit, step by step."""
        out = []
        while (text := sf.read(self.spark, self._file(unit, len(out)))) is not None:
            r = json.loads(text)
            if document_hash({k: v for k, v in r.items() if k != "hash"}) != r["hash"] or r["unit"] != unit:
                raise ClaimError(f"the record of {unit} was changed")
            out.append(r)
        return out

    def state(self, unit: dict | str) -> str | None:
        r = self.records(unit)
        return r[-1]["state"] if r else None

    def move(self, unit: dict | str, state: str, payload: dict | None = None, now: float | None = None) -> dict:
        """Take a unit to its next state; an error if it can't go there, or another driver was first."""
        seen = self.records(unit)
        last = seen[-1]["state"] if seen else None
        if state not in Registry.NEXT.get(last, ()):
            raise ClaimError(f"{unit}: {last} can't become {state}")
        body = {"unit": unit, "state": state, "at": time.time() if now is None else now, "payload": payload or {}}
        body["hash"] = document_hash(body)
        if not sf.create_once(self.spark, self._file(unit, len(seen)), json.dumps(body, sort_keys=True)):
            raise ClaimError(f"{unit}: another driver was first")
        return body

    def inspect(self, unit: dict | str, stale_after: float, now: float | None = None) -> str | None:
        """The state, after a claim without a sign for ``stale_after`` seconds has been given up for good."""
        seen, now = self.records(unit), time.time() if now is None else now
        if seen and seen[-1]["state"] in ("reserved", "prediction_complete") and now - seen[-1]["at"] >= stale_after:
            try:
                self.move(unit, "failed_or_uncertain", {"reason": f"{seen[-1]['state']} for {stale_after:g} seconds"}, now)
            except ClaimError:  # another driver moved it meanwhile
                return self.state(unit)
        return self.state(unit)


class ConfigError(ValueError):
    pass


def check_config(config: dict, schema: dict[str, tuple], where: str = "config") -> dict:
    """``schema`` maps names to (type, required, check or None); unknown names are errors."""
    unknown = sorted(set(config) - set(schema))
    if unknown:
        raise ConfigError(f"{where}: unknown {', '.join(unknown)}")
    for name, (kind, required, test) in schema.items():
        if name not in config:
            if required:
                raise ConfigError(f"{where}.{name} is missing")
            continue
        v = config[name]
        if not isinstance(v, kind) or (isinstance(v, bool) and kind is not bool):
            raise ConfigError(f"{where}.{name} must be {kind}")
        if test is not None and not test(v):
            raise ConfigError(f"{where}.{name}: {v!r} is not allowed")
    return config

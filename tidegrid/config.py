"""Settings of a study: frozen, strict about unknown names, with dotted overrides."""

from __future__ import annotations

import dataclasses
import json
from dataclasses import dataclass, field
from typing import Any, get_type_hints

from tidegrid.operators.counter_grid import Grid

S = 10**9
MS = 10**6


@dataclass(frozen=True)
class GridSettings:
    step_ms: int = 1000
    start_s: int = -1800
    end_s: int = 3600

    def grid(self, name: str) -> Grid:
        return Grid(name, self.start_s * S, self.end_s * S, self.step_ms * MS, 1 << 62)


@dataclass(frozen=True)
class Study:
    """Defaults are those of a release study on one-second data; TAPE scales them to the sparse demonstration tape."""

    fine: GridSettings = field(default_factory=lambda: GridSettings(100, -60, 120))
    coarse: GridSettings = field(default_factory=GridSettings)
    baseline_s: tuple = (-1800, -600)
    moves_s: tuple = (-60, 120)
    curve_s: tuple = (-300, 900)
    around_s: tuple = (-10, 10)
    first_minute_s: tuple = (0, 60)
    smooth: int = 5
    hold: int = 10
    recovery_levels: tuple = (0.5, 0.9)
    search_s: tuple = (-180, 0)
    least_drop_pct: float = 15.0
    segment: int = 5
    first_move_quantile: float = 0.99
    horizons_s: tuple = (1, 10, 60, 300, 1800, 7200)
    lag_steps: int = 10
    lag_window_s: int = 60
    surprise_window_s: tuple = (-600, 1200)
    pre_s: int = -1
    continuation_s: tuple = (60, 1800, 3600)
    order_sizes: tuple = (1, 5, 10, 25)
    fee_usd: float = 2.5
    normal_multiple: float = 1.25
    early_s: int = 5
    delays_s: tuple = (1, 5, 30, 60)
    exits_s: tuple = (300, 1800, 7200)
    least_training: int = 8
    thresholds: tuple = (0.0, 0.5, 1.0)
    quiet_s: tuple = (-600, -60)
    spike_s: tuple = (0, 60)
    least_spike_ratio: float = 3.0
    reps: int = 2000
    seed: int = 20241001
    fdr_alpha: float = 0.05
    reference: str = "ZN"
    surprise_instrument: str = "ZT"
    references: tuple = ("ZN", "ES")
    tick_usd: float = 15.625
    robust_events: int = 15


#: The same study on a tape of a few ticks an hour.
TAPE = Study(
    fine=GridSettings(60_000, -3600, 7200), coarse=GridSettings(300_000, -21_600, 14_400), baseline_s=(-21_600, -7_200), moves_s=(-3600, 7200),
    curve_s=(-7200, 14_400), around_s=(-900, 900), first_minute_s=(0, 3600), hold=3, search_s=(-21_600, 0), horizons_s=(300, 600, 3600, 7200, 14_400),
    lag_steps=3, lag_window_s=7200, surprise_window_s=(-7200, 7200), pre_s=-300, continuation_s=(300, 7200, 14_400), early_s=900,
    delays_s=(300, 900), exits_s=(3600, 14_400), least_training=3, quiet_s=(-21_600, -3600), spike_s=(0, 3600), least_spike_ratio=1.0, reps=200,
    reference="click", surprise_instrument="purchase", references=("click", "view"), robust_events=5,
)


def with_overrides(study: Study, overrides: dict[str, Any]) -> Study:
    """A copy with dotted names set, such as {"coarse.step_ms": 500}; an unknown name is an error."""
    for name, value in overrides.items():
        head, _, rest = name.partition(".")
        if head not in {f.name for f in dataclasses.fields(study)}:
            raise KeyError(f"unknown setting {name}")
        if rest:
            inner = getattr(study, head)
            if not dataclasses.is_dataclass(inner) or rest not in {f.name for f in dataclasses.fields(inner)}:
                raise KeyError(f"unknown setting {name}")
            value = dataclasses.replace(inner, **{rest: value})
        elif isinstance(getattr(study, head), tuple):
            value = tuple(value)
        study = dataclasses.replace(study, **{head: value})
    return study


def load(path: str | None = None, overrides: list[str] | None = None, base: Study = Study()) -> Study:
    """Settings from a JSON (or, if PyYAML is there, YAML) file and "name=value" overrides; values are read as JSON."""
    values: dict[str, Any] = {}
    if path:
        with open(path) as f:
            text = f.read()
        if path.endswith((".yaml", ".yml")):
            import yaml

            tree = yaml.safe_load(text) or {}
        else:
            tree = json.loads(text)
        for k, v in tree.items():
            values |= {f"{k}.{i}": x for i, x in v.items()} if isinstance(v, dict) else {k: v}
    for o in overrides or []:
        name, _, raw = o.partition("=")
        try:
            values[name] = json.loads(raw)
        except ValueError:
            values[name] = raw
    types = get_type_hints(Study)
    study = with_overrides(base, values)
    for f in dataclasses.fields(study):
        want, have = types[f.name], getattr(study, f.name)
        if want in (int, float) and (isinstance(have, bool) or not isinstance(have, (int, float))):
            raise TypeError(f"{f.name} must be a number, not {have!r}")
    return study

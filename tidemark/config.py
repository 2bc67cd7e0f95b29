"""Settings of the stages, from a file of sections and from arguments; arguments come first."""

from __future__ import annotations

import re
import warnings
from dataclasses import dataclass, fields, replace
from pathlib import Path


@dataclass(frozen=True)
class Settings:
    T: int = 12
    #: Lengths of routes, where there is more than one; each has tables of its own.
    slices: tuple[int, ...] = ()
    trim: int = 12
    min_track_len: int = 36
    n_bins: int = 5
    percentages: tuple[int, ...] = (10, 5, 3, 1)
    #: Samples of which datasets are made, if not of all.
    grid_percentages: tuple[int, ...] = ()
    modes: tuple[str, ...] = ("a1", "a2", "a3")
    seeds: tuple[int, ...] = (2, 12, 32, 42, 52)
    seed: int = 0
    theta_g: float = 3.0
    theta_v: float = 2.0
    train: float = 0.7
    valid: float = 0.15
    #: What is left of train and valid; checked if it is given.
    test: float | None = None
    max_retries: int = 3
    input_csv: str | None = None
    verbose: bool = False

    def merged(self, **given) -> Settings:
        """A copy with every value of ``given`` that is not None."""
        known = {f.name for f in fields(self)}
        unknown = set(given) - known
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **{k: tuple(v) if isinstance(v, list) else v for k, v in given.items() if v is not None})

    def check(self) -> Settings:
        """Raises ValueError where a value is out of range."""
        if self.T <= 0 or self.trim < 0 or self.min_track_len < 0:
            raise ValueError("T must be positive, trim and min_track_len not negative")
        if not all(0 < p <= 100 for p in self.percentages):
            raise ValueError("percentages lie in 1 to 100")
        if set(self.modes) - {"a1", "a2", "a3"}:
            raise ValueError("modes are a1, a2 and a3")
        if self.train < 0 or self.valid < 0 or self.train + self.valid > 1:
            raise ValueError("train and valid are shares that sum to 1 at most")
        if self.test is not None and abs(self.train + self.valid + self.test - 1) > 1e-6:
            raise ValueError("train, valid and test must sum to 1")
        if any(t <= 0 for t in self.slices):
            raise ValueError("slices are positive")
        if set(self.grid_percentages) - set(self.percentages):
            raise ValueError("datasets can be made of the samples that are drawn only")
        return self


#: Names in files, with their section, that differ from the field's.
NAMES = {"preprocess.ratios": "percentages", "prepare-dataset.ratios": "grid_percentages", "ratios": "percentages"}


def load(path: str | None = None) -> Settings:
    """Settings from the file given, or from config.yaml here or in the home folder if there is one."""
    places = [Path(path)] if path else [Path("config.yaml"), Path.home() / "tidemark.yaml"]
    for place in places:
        if place.exists():
            return from_sections(parse(place.read_text()))
    if path:
        raise FileNotFoundError(path)
    return Settings()


def from_sections(found: dict[str, object]) -> Settings:
    """What a scorer of one's own is set up with stands in the section score and is none of ours: a warning, no error."""
    ours = {f.name for f in fields(Settings)}
    others = [k for k in found if k.startswith("score.") and k.rpartition(".")[2].replace("-", "_") not in ours]
    if others:
        warnings.warn(f"not used here: {', '.join(others)}", stacklevel=2)
    found = {k: v for k, v in found.items() if k not in others}
    given = {NAMES.get(key, key.rpartition(".")[2].replace("-", "_")): value for key, value in found.items()}
    slices = given.get("slices")
    if slices:
        given["T"] = slices[0] if isinstance(slices, list) else slices
        given["slices"] = slices if isinstance(slices, list) else [slices]
    return Settings().merged(**given).check()


def one_value(text: str) -> object:
    text = text.strip()
    if text[:1] in ("'", '"'):
        return text[1:-1]
    if text.lower() in ("true", "false", "null", "~", ""):
        return {"true": True, "false": False}.get(text.lower())
    for kind in (int, float):
        try:
            return kind(text)
        except ValueError:
            pass
    return text


def parse(text: str) -> dict[str, object]:
    """``name`` or ``section.name`` -> value, of ``name: value`` lines; indented lines belong to the section above them.

    A value in brackets is a list, and so are lines of ``- value`` below a name without one. A comment
    starts at a line's start or after a blank. ValueError for a line that is none of these.
    """
    out: dict[str, object] = {}
    section, bare = "", ""
    for line in text.splitlines():
        line = re.sub(r"(^|\s)#.*", "", line).rstrip()
        if not line.strip():
            continue
        item = re.fullmatch(r"\s*-\s+(\S.*)", line)
        if item and bare:
            section = section if "." in bare else ""
            held = out.setdefault(bare, [])
            held.append(one_value(item[1]))
            continue
        found = re.fullmatch(r"(\s*)([\w-]+)\s*:(?:\s+(\S.*))?", line)
        if not found or item:
            raise ValueError(f"not understood: {line}")
        inside, name, value = found.groups()
        section = section if inside else ""
        key = f"{section}.{name}" if section else name
        bare = "" if value else key
        if not value:
            section = section or name
            continue
        out[key] = [one_value(v) for v in value[1:-1].split(",") if v.strip()] if value.startswith("[") else one_value(value)
    return out


def as_text(s: Settings) -> str:
    """The settings as a file that ``load`` reads."""
    show = lambda v: f"[{', '.join(map(str, v))}]" if isinstance(v, tuple) else str(v).lower() if isinstance(v, bool) else str(v)
    sections = {
        "": {"slices": s.slices or (s.T,), "seed": s.seed, "verbose": s.verbose},
        "preprocess": {"input_csv": s.input_csv, "trim": s.trim, "min_track_len": s.min_track_len, "n_bins": s.n_bins, "ratios": s.percentages},
        "score": {"max_retries": s.max_retries},
        "inject": {"theta_g": s.theta_g, "theta_v": s.theta_v},
        "prepare-dataset": {
            "ratios": s.grid_percentages or s.percentages, "modes": s.modes, "seeds": s.seeds,
            "train": s.train, "valid": s.valid, "test": round(1 - s.train - s.valid, 6) if s.test is None else s.test,
        },
    }
    lines = []
    for name, values in sections.items():
        lines += [f"{name}:"] if name else []
        lines += [f"{'  ' if name else ''}{k}: {show(v)}" for k, v in values.items() if v is not None]
    return "\n".join(lines) + "\n"

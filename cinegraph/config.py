"""Options of a run, with their checks."""

from __future__ import annotations

from dataclasses import dataclass, field

from cinegraph.operators.conversion import CRF, PRESET
from cinegraph.operators.similarity import GOOD_RATIO, THRESHOLD, TOLERANCE
from cinegraph.operators.tags import MIN_SAMPLES, TAG_THRESHOLD
from cinegraph.sources.frames import FRAMES

#: What a run does: all steps, or one kind of them.
MODES = ("all", "standardize", "combine", "tags")


@dataclass(frozen=True)
class Encoding:
    crf: int = CRF
    preset: str = PRESET
    budget_mb: float = 0.0


@dataclass(frozen=True)
class Tagging:
    suggest: bool = False
    apply: bool = False
    min_samples: int = MIN_SAMPLES
    threshold: float = TAG_THRESHOLD


@dataclass(frozen=True)
class RunConfig:
    """root: the library. dry_run: plan, commit nothing. rebuild: start from an empty index. combine: join split parts too."""

    root: str
    mode: str = "all"
    dry_run: bool = False
    rebuild: bool = False
    keep_originals: bool = False
    combine: bool = True
    threshold: float = THRESHOLD
    tolerance: float = TOLERANCE
    good_ratio: float = GOOD_RATIO
    frames: int = FRAMES
    encoding: Encoding = field(default_factory=Encoding)
    tagging: Tagging = field(default_factory=Tagging)

    @property
    def trash(self) -> str:
        return f"{self.root.rstrip('/')}/.cinegraph_trash"

    def phases(self) -> list[str]:
        """The steps of the run, in order. A run of standardizing only joins parts as well, unless that is left out."""
        suggest = ["tags"] if self.tagging.suggest or self.mode == "tags" else []
        merge = ["merge"] if self.combine else []
        return {"all": ["exact", "perceptual", "standardize", *merge, *suggest], "standardize": ["standardize", *merge, *suggest], "combine": ["merge", *suggest], "tags": suggest}[self.mode]

    def problems(self) -> list[str]:
        """What is wrong with the options; empty if nothing is."""
        found = []
        if self.mode not in MODES:
            found.append(f"mode must be one of {', '.join(MODES)}")
        if not 1 <= self.encoding.crf <= 51:
            found.append("crf must be between 1 and 51")
        if self.encoding.budget_mb < 0:
            found.append("the size budget must be 0 or greater")
        return found

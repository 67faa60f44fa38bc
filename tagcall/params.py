"""Run options, validated once."""

from __future__ import annotations

from dataclasses import dataclass

TAG_SLOTS = ("F1", "F2", "R1", "R2")
ORIENTATIONS = ("FR", "RF", "FF", "RR")


@dataclass(frozen=True)
class Params:
    mapq: int = 0
    phred: int = 0
    threshold: float = 0.7
    coverage: int = 5
    distance: int = 2
    cluster: str = "dbscan"
    regions: tuple[str, ...] = ("all",)
    tags: tuple[str, ...] = ("F1",)
    orientations: tuple[str, ...] = ORIENTATIONS
    forward: bool = True
    reverse: bool = True
    extended_cigar: bool = False

    def __post_init__(self) -> None:
        def need(ok: bool, what: str) -> None:
            if not ok:
                raise ValueError(what)

        need(0 <= self.mapq <= 60, "mapq must be 0 to 60")
        need(self.phred >= 0, "phred must not be negative")
        need(0.5 < self.threshold <= 1, "threshold must be above 0.5 and at most 1")
        need(self.coverage >= 1, "coverage must be 1 or more")
        need(0 <= self.distance <= 127, "distance must be 0 to 127")
        need(self.cluster in ("none", "dbscan"), "cluster must be none or dbscan")
        need(bool(self.tags) and set(self.tags) <= set(TAG_SLOTS), "unknown tag slot")
        need(bool(self.orientations) and set(self.orientations) <= set(ORIENTATIONS), "unknown orientation")
        need(self.forward or self.reverse, "forward and reverse exclude each other")
        need(self.forward or set(self.orientations) != {"FF"}, "FF reads are forward")
        need(self.reverse or set(self.orientations) != {"RR"}, "RR reads are reverse")

    @property
    def all_regions(self) -> bool:
        return "all" in self.regions

    def lines(self) -> list[str]:
        """The options as text, one a line."""
        return [f"{k}\t{','.join(v) if isinstance(v, tuple) else v}" for k, v in vars(self).items()]

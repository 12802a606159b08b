"""Slab systems: sizes, positions, and category indices of slabs."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass(frozen=True)
class SlabSystem:
    slabs: int
    sipms: int
    slabs_per_sipm: int
    rings: int
    modules: int | None
    width: float

    @property
    def total_slabs(self) -> int:
        if self.modules is None:
            raise ValueError("this system needs an explicit number of modules")
        return self.slabs * self.modules

    def slab_position(self, index: Column) -> Column:
        size = self.width / self.slabs
        return F.lit(size / 2) + index * F.lit(size)

    def sipm_position(self, index: Column) -> Column:
        size = self.width / self.sipms
        return F.lit(size / 2) + index * F.lit(size)


# Fixed values of the known systems: slabs, SiPMs, slabs per SiPM, rings, minimodules, crystal width in mm.
# Two of them leave the number of minimodules open.
SYSTEMS = {
    "IMAS": SlabSystem(8, 8, 1, 5, 1920, 26.0),
    "IMAS-1ring": SlabSystem(8, 8, 1, 1, 384, 26.0),
    "EBRAIN": SlabSystem(16, 8, 2, 8, None, 26.0),
    "ERC": SlabSystem(24, 8, 3, 4, None, 26.0),
    "DEV-IM": SlabSystem(8, 8, 1, 0, 16, 26.0),
    "DEV-EB": SlabSystem(16, 8, 2, 0, 16, 26.0),
}


def slab_category(slab: Column | str, system: SlabSystem, grouping: str = "none") -> Column:
    """Category of a slab index: its own, by shared SiPM, by minimodule, or by position in the minimodule."""
    s = F.col(slab) if isinstance(slab, str) else slab
    return {
        "none": s,
        "sipm": F.floor(s / system.slabs_per_sipm),
        "module": F.floor(s / system.slabs),
        "position": s % system.slabs,
    }[grouping].cast("int")


def supermodule_position(local_y: Column | str, slab_x: Column | str, slab_y: Column | str, translate: bool = True):
    """Position in the supermodule from a module-local y and the slab's own position: columns ``sm_x, sm_y``."""
    y, sx, sy = (F.col(c) if isinstance(c, str) else c for c in (local_y, slab_x, slab_y))
    return [sx.alias("sm_x"), (y + sy if translate else y).alias("sm_y")]

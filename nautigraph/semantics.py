"""Constants and choices of the navigation engine, in one place."""

from __future__ import annotations

from dataclasses import dataclass

# Grid, tolerances in km or degrees, limits.
EARTH_KM = 6371.0
KM_PER_DEGREE = 111.0
RASTER_CELL = 0.02
ISLAND_SPAN = 3.0
ISLAND_FEATURE_SPAN = 1.0
SAMPLE_SPACING = 0.25
DEFAULT_DEPTH = 16
COARSEN_EPS = 0.1
EDGE_BAND = 0.0135
EDGE_SHORTEST, EDGE_SAMPLES, EDGE_SHORT_KM, EDGE_STEP_SHORT_KM, EDGE_STEP_KM = 1e-10, 3, 3.0, 0.05, 0.5
SEAM_EPS = 1e-6
BRIDGE_NEIGHBOURS, BRIDGE_KM, BRIDGE_SHORE_KM, BRIDGE_STEP_KM = 6, 3000.0, 0.3, 2.0
CANAL_NEIGHBOURS, CANAL_KM, CANAL_DEPTH = 5, 100.0, 1
SNAP_NEIGHBOURS, SNAP_SHORE_KM, SNAP_STEP_KM = 16, 0.6, 1.0
PENALTY, PENALTY_FROM = 5.0, 0.2
ASTAR_LIMIT = 5_000_000
SIMPLIFY_DEGREES = 0.01
SIGHT_BAND, SIGHT_STEP_KM, SIGHT_LONG_KM, SIGHT_CHUNK_KM = 0.027, 1.0, 200.0, 100.0
SMOOTH_RATIOS = (0.25, 0.10, 0.05)
COLOURS = {"raw": "#ff6600", "los": "#00ccff", "final": "#ff4444"}


@dataclass(frozen=True)
class Semantics:
    """Where established results follow an odd rule, a flag says whether it's kept (the default) or mended.

    literal_projection: in path simplification, the second product alone is divided by the squared length.
    holes_are_islands: a small hole of a large polygon counts as an island ring in the precise land test.
    far_rows: a cell also neighbours a much coarser one of lower id that lies one fine row away.
    """

    literal_projection: bool = True
    holes_are_islands: bool = True
    far_rows: bool = True


DEFAULT = Semantics()


def raster_shape(cell: float = RASTER_CELL) -> tuple[int, int]:
    """(rows, columns) of a world raster."""
    return round(180 / cell), round(360 / cell)

"""A job's settings, checked all at once before any data are read."""

from __future__ import annotations

from dataclasses import dataclass, field


@dataclass(frozen=True)
class JobConfig:
    """What to read, how to mesh and what to compute for one map."""

    map_path: str
    phase_paths: tuple[str, ...]
    euler_column: int = 1
    xy_column: int = 4
    phase_column: int = 6
    frame_angle_deg: float = 0.0
    min_grain_pixels: int = 0
    mesh_type: int = 3
    target_elements: int = 2000
    element_method: str = "nearest"
    thermoelastic: bool = True
    conduction: bool = True
    strain_or_stress: tuple[float, ...] = field(default=(0.0,) * 6)
    temperature_change: float = 0.0
    heat_load: tuple[float, ...] = field(default=(0.0,) * 3)
    wave_grid: int = 0

    def problems(self) -> list[str]:
        """Everything that is wrong with the settings."""
        rules = (
            (bool(self.map_path), "map_path is empty"),
            (1 <= len(self.phase_paths) <= 8, "phase_paths must name 1 to 8 files"),
            (min(self.euler_column, self.xy_column, self.phase_column) >= 1, "columns count from 1"),
            (len({*range(self.euler_column, self.euler_column + 3), self.xy_column, self.xy_column + 1, self.phase_column}) == 6, "columns overlap"),
            (self.min_grain_pixels >= 0, "min_grain_pixels is negative"),
            (self.mesh_type in (1, 2, 3), "mesh_type must be 1 (conforming), 2 (hexagonal grid) or 3 (rectangular grid)"),
            (self.target_elements >= 2, "target_elements must be 2 at least"),
            (self.element_method in ("nearest", "voigt", "reuss", "hill", "geometric"), "element_method is unknown"),
            (len(self.strain_or_stress) == 6, "strain_or_stress needs 6 components"),
            (len(self.heat_load) == 3, "heat_load needs 3 components"),
            (self.wave_grid >= 0 and self.wave_grid % 2 == 0, "wave_grid must be even"),
            (self.thermoelastic or self.conduction, "nothing to compute"),
        )
        return [text for ok, text in rules if not ok]

    def validate(self) -> JobConfig:
        if found := self.problems():
            raise ValueError("; ".join(found))
        return self

"""A whole job: from a map's file to effective properties, wave speeds and fields, as named lazy tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from grainflow.operators import clean, conforming, elements, fem, grains, homogenize, mesh, waves
from grainflow.plans.config import JobConfig
from grainflow.sources import maps, properties

READERS = {"ang": lambda s, c: maps.read_ang(s, c.map_path, c.euler_column, c.xy_column, c.phase_column), "ctf": lambda s, c: maps.read_ctf(s, c.map_path), "txt": lambda s, c: maps.read_plain(s, c.map_path, c.euler_column, c.xy_column, c.phase_column), "csv": lambda s, c: maps.read_plain(s, c.map_path, c.euler_column, c.xy_column, c.phase_column)}


def load(spark: SparkSession, config: JobConfig) -> tuple[DataFrame, DataFrame]:
    """(points, phases) of a checked configuration; points are on the unit grid, numbered, without stray pixels."""
    config.validate()
    kind = config.map_path.rsplit(".", 1)[-1].lower()
    if kind not in READERS:
        raise ValueError(f"no reader for .{kind} maps")
    phases = properties.read_properties(spark, list(config.phase_paths))
    raw = clean.unit_grid(clean.renumber_phases(READERS[kind](spark, config)))
    tidy = clean.remove_strays(raw, ["phase", *homogenize.ANGLES]) if kind != "txt" else raw
    return tidy, phases


def run(spark: SparkSession, config: JobConfig) -> dict[str, DataFrame]:
    """The job's tables. Nothing that isn't asked for is computed when they are written, as all are lazy."""
    points, phases = load(spark, config)
    points = points.withColumn("point_id", F.col("y") * 1_000_000 + F.col("x")).cache()
    grained = grains.grains(points)
    if config.min_grain_pixels:
        grained = grains.merge_small(grained, config.min_grain_pixels)
        points = grained.drop("grain_id")
    out = {"points": points, "phases": phases, "grains": grained, "summary": grains.summary(points), "fractions": homogenize.volume_fractions(points), "density": homogenize.homogenised_density(points, phases)}
    size = points.agg(F.max("x"), F.max("y")).first()
    width, height = int(size[0]) + 1, int(size[1]) + 1
    centred = points.withColumn("x", F.col("x") + 0.5).withColumn("y", F.col("y") + 0.5)
    if config.mesh_type == 1:
        nodes, flat = conforming.conforming_mesh(spark, grained, width, height)
    else:
        nodes, flat = (mesh.hexagonal_grid if config.mesh_type == 2 else mesh.rectangular_grid)(spark, 0.0, float(width), 0.0, float(height), config.target_elements)
    wide, six = mesh.quadratic(flat, nodes)
    material = elements.material(centred, phases, flat, nodes, config.element_method, config.frame_angle_deg)
    placed = fem.place_elements(six, wide, mesh.periodic_pairs(wide), material).withColumn("map_id", F.lit(config.map_path))
    out |= {"nodes": nodes, "elements": flat, "mesh_checks": mesh.checks(flat, nodes), "mesh_statistics": mesh.statistics(mesh.corners(flat, nodes))}
    estimates = homogenize.property_estimates(points, phases, frame_deg=config.frame_angle_deg)
    if config.conduction:
        local = fem.solve_conduction(placed)
        out |= {"conductivity": homogenize.conductivity_estimates(points, phases, frame_deg=config.frame_angle_deg), "conductivity_geometric": estimates.where("method = 'geometric'").select("method", "kappa_geometric"), "conductivity_aeh": fem.effective_conductivity(local)}
        if any(config.heat_load):
            out["heat_flux"] = fem.heat_flux(local, config.heat_load)
    if config.thermoelastic:
        local = fem.solve_thermoelastic(placed)
        effective = fem.effective_thermoelastic(local).select(F.lit("aeh").alias("method"), "stiffness", "alpha", "beta")
        every = estimates.select("method", "stiffness", "alpha", "beta").unionByName(effective)
        out |= {"thermoelastic": every, "engineering": homogenize.engineering_properties(every)}
        if any(config.strain_or_stress) or config.temperature_change:
            out["stress_strain"] = fem.stress_strain(local, config.strain_or_stress, config.temperature_change)
        if config.wave_grid:
            out["waves"] = waves.wave_speeds(every.join(out["density"]), "method", config.wave_grid)
            out["phase_waves"] = waves.wave_speeds(phases, "phase", config.wave_grid)
            out["wave_anisotropy"] = waves.anisotropy(out["waves"], "method")
    return out

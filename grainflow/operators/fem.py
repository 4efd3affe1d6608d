"""Periodic cell problems on straight-sided quadratic triangles, and what follows from them.

An element row is (map_id, elem_id, dofs array[6], xy array[6], ...): its nodes, with periodic ones replaced by their masters, its
corners, and its material: kappa array[9], or stiffness array[36] and alpha array[6]. The cell problem of one map is
solved by one task, without assembling a matrix, by preconditioned conjugate gradients; maps run side by side. Everything
before and after it is distributed by element.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from grainflow.functions import kernels as K
from grainflow.functions import tensors as T
from grainflow.operators.components import checkpointed

# Barycentric places and weights of the four-point rule; the weight of the centre is negative.
PLACES = np.array([[1 / 3, 1 / 3, 1 / 3], [0.2, 0.6, 0.2], [0.2, 0.2, 0.6], [0.6, 0.2, 0.2]])
WEIGHTS = np.array([-27 / 48, 25 / 48, 25 / 48, 25 / 48])
SIDES = ((0, 1), (1, 2), (0, 2))
TOLERANCE = 1e-9
#: Elements of a map whose matrix is summed in one task, at most.
ASSEMBLED = 20_000


def shape_values(l: np.ndarray) -> np.ndarray:
    """(places, 6): the quadratic shape functions at barycentric places: corners, then sides 12, 23, 13."""
    return np.concatenate([l * (2 * l - 1), np.stack([4 * l[:, i] * l[:, j] for i, j in SIDES], 1)], 1)


def gradients(xy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(area (e,), gradients (e, 4, 6, 3) at the quadrature places) of elements with corners xy (e, 3, 2)."""
    x, y = xy[:, :, 0], xy[:, :, 1]
    area = ((x[:, 1] - x[:, 0]) * (y[:, 2] - y[:, 0]) - (x[:, 2] - x[:, 0]) * (y[:, 1] - y[:, 0])) / 2
    nxt, prv = [1, 2, 0], [2, 0, 1]
    slope = np.stack([y[:, nxt] - y[:, prv], x[:, prv] - x[:, nxt], np.zeros_like(x)], 2) / (2 * area[:, None, None])
    corner = (4 * PLACES - 1)[None, :, :, None] * slope[:, None]
    side = np.stack([4 * (PLACES[None, :, i, None] * slope[:, None, j] + PLACES[None, :, j, None] * slope[:, None, i]) for i, j in SIDES], 2)
    return area, np.concatenate([corner, side], 2)


def strain_matrix(g: np.ndarray) -> np.ndarray:
    """(e, 4, 6, 18): engineering strain from the displacements of the nodes; nothing changes along axis 3."""
    b = np.zeros((*g.shape[:2], 6, 18))
    for row, pairs in enumerate((((0, 0),), ((1, 1),), ((2, 2),), ((1, 2), (2, 1)), ((0, 2), (2, 0)), ((0, 1), (1, 0)))):
        for axis, along in pairs:
            b[:, :, row, axis::3] += g[:, :, :, along]
    return b


def pixel_shape(dofs: np.ndarray, xy: np.ndarray) -> tuple[int, int] | None:
    """(w, h) if the elements are the halves of w by h pixels, numbered as `pixel_cells` does it, in any order; else None."""
    low = np.floor(xy.min(1) - xy.min((0, 1)) + 0.5).astype(np.int64)
    w, h = low.max(0) + 1
    if len(dofs) != 2 * w * h or dofs.max() != 4 * w * h - 1 or not np.array_equal(np.bincount((low[:, 1] * w + low[:, 0]), minlength=w * h), np.full(w * h, 2)):
        return None
    place = lambda u, v: (2 * low[:, 1] + v) % (2 * h) * (2 * w) + (2 * low[:, 0] + u) % (2 * w)
    fits = []
    for corners in _HALVES:
        steps = [(2 * u, 2 * v) for u, v in corners] + [(corners[i][0] + corners[j][0], corners[i][1] + corners[j][1]) for i, j in SIDES]
        fits.append((np.stack([place(u, v) for u, v in steps], 1) == dofs).all(1) & (np.abs(xy - xy.min((0, 1)) - low[:, None] - np.array(corners)) < 1e-9).all((1, 2)))
    return (int(w), int(h)) if (fits[0] | fits[1]).all() and fits[0].sum() == w * h else None


def uniform_inverse(stiff: np.ndarray, dofs: np.ndarray, xy: np.ndarray, width: int, shape: tuple[int, int]):
    """A function that applies the inverse of the same cell with one material everywhere, the mean of `stiff`; translations are left out.

    A uniform cell looks alike from every pixel, so its matrix falls into small ones, 4 `width` squared, for each wave of a Fourier
    transform over the pixels.
    """
    w, h = shape
    own = np.floor(xy.min(1) - xy.min((0, 1)) + 0.5).astype(np.int64)
    lower = xy[:, 1, 1] - xy[:, 0, 1] < 0.5  # the half with its second corner beside the first
    # Degrees of freedom as (pixel's row, pixel's column, kind): four nodes of a pixel.
    row, column = dofs // width // (2 * w), dofs // width % (2 * w)
    kind = ((row % 2) * 2 + column % 2) * width + dofs % width
    size = 4 * width
    cells = np.zeros((h, w, size, size))
    for half in (lower, ~lower):
        mean = stiff[half].mean(0)
        at = np.flatnonzero(half)[0]
        dy, dx = (row[at] // 2 - own[at, 1]) % h, (column[at] // 2 - own[at, 0]) % w
        shift = ((dy[:, None] - dy[None, :]) % h, (dx[:, None] - dx[None, :]) % w)
        np.add.at(cells, (*shift, np.broadcast_to(kind[at][:, None], mean.shape), np.broadcast_to(kind[at][None, :], mean.shape)), mean)
    waves = np.fft.rfft2(cells, axes=(0, 1))
    inverse = np.empty_like(waves)
    flat = waves.reshape(-1, size, size)
    inverse.reshape(-1, size, size)[1:] = np.linalg.inv(flat[1:])
    inverse[0, 0] = np.linalg.pinv(flat[0], rcond=1e-10, hermitian=True)
    every = np.arange(4 * w * h * width)
    i, j = every // width // (2 * w), every // width % (2 * w)
    order = ((i // 2) * w + j // 2) * size + ((i % 2) * 2 + j % 2) * width + every % width

    def apply(residual: np.ndarray) -> np.ndarray:
        r = residual.shape[1]
        grid = np.empty_like(residual)
        grid[order] = residual
        there = np.fft.rfft2(grid.reshape(h, w, size, r), axes=(0, 1))
        return np.fft.irfft2(inverse @ there, (h, w), axes=(0, 1)).reshape(-1, r)[order]

    return apply


def conjugate_gradients(stiff: np.ndarray, dofs: np.ndarray, right: np.ndarray, goal: np.ndarray, most: int = 20_000, near: Callable[[np.ndarray], np.ndarray] | None = None) -> np.ndarray:
    """x (dofs, r) of the sum of element matrices (e, n, n) for right sides (dofs, r), by the preconditioner `near`, or else a diagonal one,
    to residuals of the sizes `goal` (r,).

    The matrix may be singular (rigid translations) as long as the right sides are in its range.
    """
    n, r = right.shape
    flat = dofs.ravel()
    diagonal = np.bincount(flat, np.einsum("eii->ei", stiff).ravel(), n)
    scale = np.where(diagonal > 0, 1 / np.where(diagonal > 0, diagonal, 1), 0)[:, None]

    def times(x: np.ndarray) -> np.ndarray:
        y = stiff @ x[dofs]
        return np.stack([np.bincount(flat, y[:, :, k].ravel(), n) for k in range(r)], 1)

    near = near or (lambda v: scale * v)
    x = np.zeros_like(right)
    residual = right.copy()
    z = near(residual)
    p, rz = z.copy(), (residual * z).sum(0)
    for _ in range(most):
        live = np.sqrt((residual * residual).sum(0)) > goal
        if not live.any():
            break
        q = times(p)
        pq = (p * q).sum(0)
        step = np.where(live & (pq > 0), rz / np.where(pq > 0, pq, 1), 0)
        x += step * p
        residual -= step * q
        z = near(residual)
        new = (residual * z).sum(0)
        p = z + np.where(live, new / np.where(rz > 0, rz, 1), 0) * p
        rz = new
    return x


def solve_cell(xy: np.ndarray, dofs: np.ndarray, material: np.ndarray, extra: np.ndarray | None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(weights (e, 4), localised material, localised extra, degrees of freedom, characteristic functions) of one periodic cell.

    `material` is (e, 3, 3) conductivity or (e, 6, 6) stiffness; `extra` (e, 6), stress per degree, comes with the latter.
    Localised means what a uniform macroscopic gradient or strain turns into locally: D - D B chi.
    """
    area, g = gradients(xy)
    weight = WEIGHTS * area[:, None]
    if material.shape[-1] == 3:
        b, width = np.swapaxes(g, 2, 3), 1
    else:
        b, width = strain_matrix(g), 3
    all_dofs = (dofs[:, :, None] * width + np.arange(width)).reshape(len(dofs), -1)
    used, local = np.unique(all_dofs, return_inverse=True)
    local = local.reshape(all_dofs.shape)
    load = material if extra is None else np.concatenate([material, extra[:, :, None]], 2)
    wb = weight[:, :, None, None] * np.swapaxes(b, 2, 3)
    stiff = np.einsum("eqni,eij,eqjm->enm", wb, material, b, optimize=True)
    force = np.einsum("eqni,eij->enj", wb, load)
    total = lambda f: np.stack([np.bincount(local.ravel(), f[:, :, k].ravel(), len(used)) for k in range(load.shape[2])], 1)
    # Forces that cancel leave rounding errors behind; the goal is set by what was added up.
    shape = pixel_shape(dofs, xy)
    near = uniform_inverse(stiff, all_dofs, xy, width, shape) if shape else None
    chi = conjugate_gradients(stiff, local, total(force), TOLERANCE * np.linalg.norm(total(np.abs(force)), axis=0) + 1e-300, near=near)
    strain = np.einsum("eqin,enk->eqik", b, chi[local])
    hat = load[:, None] - np.einsum("eij,eqjk->eqik", material, strain)
    return weight, hat[..., : material.shape[-1]], hat[..., material.shape[-1] :], used, chi


def assembled(elements: DataFrame, kind: str = "conduction") -> tuple[DataFrame, DataFrame]:
    """(map_id, row, col, value) and (map_id, row, k, value): the matrix of a cell problem and the forces of its right-hand sides, from element
    rows as for the solvers, which never build them. Rows are degrees of freedom: a node's number, or three times that and
    0 to 2. There are three right-hand sides for conduction; for `thermoelastic` six of strain and one of temperature. A map of at most ASSEMBLED elements is summed
    by one task; the elements of larger ones are shuffled by their entries."""
    thermal = kind == "conduction"
    columns = ["kappa"] if thermal else ["stiffness", "alpha"]
    rows = elements.select("map_id", "dofs", "xy", *columns)
    large = checkpointed(rows.groupBy("map_id").count().where(F.col("count") > ASSEMBLED).select("map_id"))
    whole = large.isEmpty()

    def values(pdf: pd.DataFrame, force: bool) -> tuple[np.ndarray, np.ndarray]:
        area, g = gradients(_stack(pdf["xy"], 3, 2))
        b = np.swapaxes(g, 2, 3) if thermal else strain_matrix(g)
        d = _stack(pdf["kappa"], 3, 3) if thermal else _stack(pdf["stiffness"], 6, 6)
        width = 1 if thermal else 3
        dofs = (np.array(pdf["dofs"].tolist())[:, :, None] * width + np.arange(width)).reshape(len(pdf), -1)
        wb = (WEIGHTS * area[:, None])[:, :, None, None] * np.swapaxes(b, 2, 3)
        if not force:
            return dofs, np.einsum("eqni,eij,eqjm->enm", wb, d, b, optimize=True)
        load = d if thermal else np.concatenate([d, np.einsum("eij,ej->ei", d, _stack(pdf["alpha"], 6))[:, :, None]], 2)
        return dofs, np.einsum("eqni,eij->enj", wb, load)

    def pairs(dofs: np.ndarray, found: np.ndarray, force: bool) -> tuple[np.ndarray, np.ndarray]:
        right = np.broadcast_to(np.arange(found.shape[2]), found.shape) if force else np.broadcast_to(dofs[:, None, :], found.shape)
        return np.repeat(dofs, found.shape[2], axis=1).ravel(), right.ravel()

    def form(force: bool) -> DataFrame:
        name, shape = ("k", "map_id string, row long, k int, value double") if force else ("col", "map_id string, row long, col long, value double")
        kind_ = pa.int32() if force else pa.int64()

        def run(table: pa.Table) -> pa.Table:
            """The sums of a whole map."""
            dofs, found = values(table.to_pandas(), force)
            used, local = np.unique(dofs, return_inverse=True)
            row, col = pairs(local.reshape(dofs.shape), found, force)
            place, at = np.unique(row * (found.shape[2] if force else len(used)) + col, return_inverse=True)
            row, col = np.divmod(place, found.shape[2] if force else len(used))
            sums = np.bincount(at.ravel(), found.ravel())
            return pa.table({"map_id": pa.repeat(table.column("map_id")[0], len(place)), "row": used[row], name: pa.array(col if force else used[col], kind_), "value": sums})

        def part(batches):
            for pdf in batches:
                if len(pdf):
                    dofs, found = values(pdf, force)
                    row, col = pairs(dofs, found, force)
                    yield pd.DataFrame({"map_id": np.repeat(pdf["map_id"].to_numpy(), found[0].size), "row": row, name: col.astype(np.int32) if force else col, "value": found.ravel()})

        out = (rows if whole else rows.join(large, "map_id", "left_anti")).groupBy("map_id").applyInArrow(run, shape)
        if whole:
            return out
        far = rows.join(large, "map_id", "left_semi").mapInPandas(part, shape)
        return out.unionByName(far.groupBy("map_id", "row", name).agg(F.sum("value").alias("value")))

    return form(False), form(True)


def place_elements(elements: DataFrame, nodes: DataFrame, periodic: DataFrame, material: DataFrame) -> DataFrame:
    """Element rows from quadratic elements (elem_id, n1 ... n6), nodes, periodic pairs and material by elem_id."""
    each = elements.select("elem_id", F.posexplode(F.array(*(f"n{i}" for i in range(1, 7)))).alias("c", "node_id"))
    at = each.join(nodes, "node_id").join(periodic, "node_id", "left")
    sorted_ = F.array_sort(F.collect_list(F.struct("c", F.coalesce("master_id", "node_id").alias("dof"), "x", "y")))
    rows = at.groupBy("elem_id").agg(sorted_.alias("n"))  # six for each element
    xy = F.flatten(F.transform(F.slice("n", 1, 3), lambda s: F.array(s["x"], s["y"])))
    return rows.select("elem_id", F.transform("n", lambda s: s["dof"]).alias("dofs"), xy.alias("xy")).join(material, "elem_id")


def tiles(points: DataFrame, size: int, width: int, height: int) -> DataFrame:
    """Points of one map, whole x and y from 0, with the tile that they lie in: map_id, its lower left place x0, y0 and its size w, h.

    Tiles have at most `size` points along a side and differ by one at most, so that none is narrow.
    """

    def along(c: str, whole: int) -> tuple[Column, Column, Column]:
        n = -(-whole // size)
        i = F.floor(F.col(c) * n / whole).cast("long")
        start = F.floor((i * whole + (n - 1)) / n).cast("long")
        return i, start, F.floor(((i + 1) * whole + (n - 1)) / n).cast("long") - start

    (i, x0, w), (j, y0, h) = along("x", width), along("y", height)
    return points.select(F.concat_ws(":", j, i).alias("map_id"), x0.alias("x0"), y0.alias("y0"), w.alias("w"), h.alias("h"), *points.columns)


#: Corners of a pixel's two triangles, in steps of a pixel.
_HALVES = (((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))


def pixel_cells(tiled: DataFrame, material: tuple[str, ...], number: Column) -> DataFrame:
    """Element rows (map_id, elem_id, dofs, xy, material...) of maps that are periodic cells of pixels: two quadratic triangles for each
    point of (map_id, x0, y0, w, h, x, y, material...), see `tiles`; the pixel's `number` doubled, and one more, are their ids.

    Corners and mid-sides lie on a grid of half pixels, so that numbers, places and periodic partners follow from a point
    alone: nothing is joined or shuffled. Maps are solved side by side.
    """
    lx, ly = F.col("x") - F.col("x0"), F.col("y") - F.col("y0")
    out = []
    for corners in _HALVES:
        (a, b, c) = corners
        middles = [(p[0] + q[0], p[1] + q[1]) for p, q in ((a, b), (b, c), (a, c))]
        steps = [(2 * u, 2 * v) for u, v in corners] + middles
        dofs = F.array(*(((2 * ly + v) % (2 * F.col("h")) * (2 * F.col("w")) + (2 * lx + u) % (2 * F.col("w"))).cast("long") for u, v in steps))
        xy = F.array(*((F.col(k) + d).cast("double") for u, v in corners for k, d in (("x", u), ("y", v))))
        out.append(F.struct(dofs.alias("dofs"), xy.alias("xy")))
    each = tiled.select("map_id", number.alias("__number"), *material, F.posexplode(F.array(*out)).alias("half", "e"))
    return each.select("map_id", (2 * F.col("__number") + F.col("half")).cast("long").alias("elem_id"), "e.dofs", "e.xy", *material)


_POINT = "map_id string, elem_id long, qp int, x double, y double, weight double, "


def _points(pdf: pd.DataFrame, xy: np.ndarray, weight: np.ndarray) -> dict:
    place = np.einsum("qi,eid->eqd", PLACES, xy)
    return {"map_id": np.repeat(pdf["map_id"].to_numpy(), 4), "elem_id": np.repeat(pdf["elem_id"].to_numpy(), 4), "qp": np.tile(np.arange(4, dtype=np.int32), len(pdf)), "x": place[..., 0].ravel(), "y": place[..., 1].ravel(), "weight": weight.ravel()}


def _stack(column: pd.Series, *shape: int) -> np.ndarray:
    return np.array(column.tolist(), float).reshape(len(column), *shape)


def solve_conduction(elements: DataFrame) -> DataFrame:
    """(map_id, elem_id, qp, x, y, weight, kappa, hat): conductivity and localised conductivity, arrays of 9, at each quadrature point."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("elem_id", ignore_index=True)
        xy, kappa = _stack(pdf["xy"], 3, 2), _stack(pdf["kappa"], 3, 3)
        weight, hat, _, _, _ = solve_cell(xy, np.array(pdf["dofs"].tolist()), kappa, None)
        return pd.DataFrame(_points(pdf, xy, weight) | {"kappa": list(np.repeat(kappa.reshape(-1, 9), 4, 0)), "hat": list(hat.reshape(-1, 9))})

    return elements.select("map_id", "elem_id", "dofs", "xy", "kappa").groupBy("map_id").applyInPandas(run, _POINT + "kappa array<double>, hat array<double>")


def solve_thermoelastic(elements: DataFrame) -> DataFrame:
    """(..., stiffness, alpha, hat array[36], beta_hat array[6]) at each quadrature point."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("elem_id", ignore_index=True)
        xy, c, alpha = _stack(pdf["xy"], 3, 2), _stack(pdf["stiffness"], 6, 6), _stack(pdf["alpha"], 6)
        scale = np.abs(c).max()
        weight, hat, beta, _, _ = solve_cell(xy, np.array(pdf["dofs"].tolist()), c / scale, np.einsum("eij,ej->ei", c, alpha) / scale)
        rows = lambda m, n: list(np.repeat(m.reshape(-1, n), 4, 0))
        return pd.DataFrame(_points(pdf, xy, weight) | {"stiffness": rows(c, 36), "alpha": rows(alpha, 6), "hat": list(scale * hat.reshape(-1, 36)), "beta_hat": list(scale * beta.reshape(-1, 6))})

    return elements.select("map_id", "elem_id", "dofs", "xy", "stiffness", "alpha").groupBy("map_id").applyInPandas(run, _POINT + "stiffness array<double>, alpha array<double>, hat array<double>, beta_hat array<double>")


def characteristic_functions(elements: DataFrame, kind: str = "conduction") -> DataFrame:
    """(map_id, node_id, dof, k, value): the k-th characteristic function (three for conduction; for `thermoelastic` six of strain and one
    of temperature) at every node that is its own master. The mean of each over the nodes is zero."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("elem_id", ignore_index=True)
        xy, dofs, width = _stack(pdf["xy"], 3, 2), np.array(pdf["dofs"].tolist()), 1
        if kind == "conduction":
            *_, used, chi = solve_cell(xy, dofs, _stack(pdf["kappa"], 3, 3), None)
        else:
            c, width = _stack(pdf["stiffness"], 6, 6), 3
            scale = np.abs(c).max()
            *_, used, chi = solve_cell(xy, dofs, c / scale, np.einsum("eij,ej->ei", c, _stack(pdf["alpha"], 6)) / scale)
        chi = chi - chi.reshape(-1, width, chi.shape[1]).mean(0)[used % width]
        n = chi.shape[1]
        return pd.DataFrame({"map_id": pdf["map_id"].iloc[0], "node_id": np.repeat(used // width, n), "dof": np.repeat(used % width, n).astype(np.int32), "k": np.tile(np.arange(n, dtype=np.int32), len(used)), "value": chi.ravel()})

    columns = ["kappa"] if kind == "conduction" else ["stiffness", "alpha"]
    return elements.select("map_id", "elem_id", "dofs", "xy", *columns).groupBy("map_id").applyInPandas(run, "map_id string, node_id long, dof int, k int, value double")


def _mean(column: str, size: int) -> Column:
    return F.array(*(F.sum(F.col(column)[i] * F.col("weight")) / F.sum("weight") for i in range(size))).alias(column)


def effective_conductivity(localised: DataFrame) -> DataFrame:
    """(map_id, kappa array[9])."""
    return localised.groupBy("map_id").agg(_mean("hat", 9)).withColumnRenamed("hat", "kappa")


def effective_thermoelastic(localised: DataFrame) -> DataFrame:
    """(map_id, stiffness array[36], beta array[6], alpha array[6])."""
    means = localised.groupBy("map_id").agg(_mean("hat", 36), _mean("beta_hat", 6))

    def solve(batches):
        for pdf in batches:
            c, beta = _stack(pdf["hat"], 6, 6), _stack(pdf["beta_hat"], 6)
            c = (c + c.transpose(0, 2, 1)) / 2
            yield pd.DataFrame({"map_id": pdf["map_id"], "stiffness": list(c.reshape(-1, 36)), "beta": list(beta), "alpha": list(np.linalg.solve(c, beta[:, :, None])[:, :, 0])})

    return means.mapInPandas(solve, "map_id string, stiffness array<double>, beta array<double>, alpha array<double>")


def heat_flux(localised: DataFrame, flux: tuple[float, float, float]) -> DataFrame:
    """(map_id, elem_id, qp, x, y, weight, q1..q3, q, t1..t3, t): local flux and temperature gradient under a mean flux, and their sizes."""
    overall = effective_conductivity(localised).withColumnRenamed("kappa", "overall")
    inv = T.inverse(T.of_array("overall"))
    macro = overall.select("map_id", *((-T.add([inv[i][j] * F.lit(float(flux[j])) for j in range(3)])).alias(f"m{i}") for i in range(3)))
    both = localised.join(F.broadcast(macro), "map_id")  # a row for each map
    q = [-T.add([F.col("hat")[3 * i + j] * F.col(f"m{j}") for j in range(3)]) for i in range(3)]
    rows = both.select("map_id", "elem_id", "qp", "x", "y", "weight", "kappa", *(c.alias(f"q{i + 1}") for i, c in enumerate(q)))
    local = T.inverse(T.of_array("kappa"))
    t = [-T.add([local[i][j] * F.col(f"q{j + 1}") for j in range(3)]) for i in range(3)]
    out = rows.select("*", *(c.alias(f"t{i + 1}") for i, c in enumerate(t))).drop("kappa")
    size = lambda p: T.magnitude(*(F.col(f"{p}{i}") for i in (1, 2, 3))).alias(p)
    return out.select("*", size("q"), size("t"))


STRESS = ("s11", "s22", "s33", "s23", "s13", "s12")
STRAIN = ("e11", "e22", "e33", "e23", "e13", "e12")
_FIELDS = (*STRESS, "sp1", "sp2", "sp3", "s_max_shear", "s_plane_shear", *STRAIN, "ep1", "ep2", "ep3", *(f"m{e}" for e in STRAIN))


def _local_fields(sigma: np.ndarray, c: np.ndarray, alpha: np.ndarray, temperature: float, tensor_shear: bool) -> np.ndarray:
    """The columns _FIELDS of places with stress `sigma` (n, 6)."""
    strain = np.linalg.solve(c, (sigma + temperature * np.einsum("nij,nj->ni", c, alpha))[:, :, None])[:, :, 0]
    sp = np.linalg.eigvalsh(K.to_tensor(sigma))[:, ::-1]
    ep = np.linalg.eigvalsh(K.to_tensor(strain, 2.0 if tensor_shear else 1.0))[:, ::-1]
    plane = np.hypot((sigma[:, 0] - sigma[:, 1]) / 2, sigma[:, 5])
    return np.column_stack([sigma, sp, (sp[:, 0] - sp[:, 2]) / 2, plane, strain, ep, strain - temperature * alpha])


def stress_strain(localised: DataFrame, stress: tuple[float, ...], temperature: float = 0.0, tensor_shear: bool = False) -> DataFrame:
    """Local stress and strain under a mean stress and a temperature change: the columns STRESS, STRAIN, their principal values, the
    greatest shear stress in space and in the plane, and the mechanical strains (m...), which leave thermal expansion out.

    Principal strains are of the matrix that holds engineering shear, unless `tensor_shear` halves it.
    """
    overall = effective_thermoelastic(localised).select("map_id", F.col("stiffness").alias("overall"), F.col("beta").alias("overall_beta"))
    both = localised.join(F.broadcast(overall), "map_id")

    def run(batches):
        for pdf in batches:
            if not len(pdf):
                continue
            c, alpha, hat, beta_hat = _stack(pdf["stiffness"], 6, 6), _stack(pdf["alpha"], 6), _stack(pdf["hat"], 6, 6), _stack(pdf["beta_hat"], 6)
            macro = np.linalg.solve(_stack(pdf["overall"], 6, 6), (np.array(stress) + temperature * _stack(pdf["overall_beta"], 6))[:, :, None])
            sigma = (hat @ macro)[:, :, 0] - temperature * beta_hat
            values = _local_fields(sigma, c, alpha, temperature, tensor_shear)
            yield pd.concat([pdf[["map_id", "elem_id", "qp", "x", "y", "weight"]].reset_index(drop=True), pd.DataFrame(values, columns=list(_FIELDS))], axis=1)

    return both.mapInPandas(run, _POINT + ", ".join(f"{f} double" for f in _FIELDS))


def _overall(weight: np.ndarray, local: np.ndarray) -> np.ndarray:
    return np.tensordot(weight, local, 2) / weight.sum()


def _conducting(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, kappa, weight, localised conductivity) of one map, in the order of its elements."""
    pdf = pdf.sort_values("elem_id", ignore_index=True)
    xy, kappa = _stack(pdf["xy"], 3, 2), _stack(pdf["kappa"], 3, 3)
    weight, hat, *_ = solve_cell(xy, np.array(pdf["dofs"].tolist()), kappa, None)
    return pdf, xy, kappa, weight, hat


def _elastic(pdf: pd.DataFrame) -> tuple[pd.DataFrame, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(rows, places, stiffness, alpha, weight, localised stiffness, localised stress per degree) of one map, in the order of its elements."""
    pdf = pdf.sort_values("elem_id", ignore_index=True)
    xy, c, alpha = _stack(pdf["xy"], 3, 2), _stack(pdf["stiffness"], 6, 6), _stack(pdf["alpha"], 6)
    scale = np.abs(c).max()
    weight, hat, beta, _, _ = solve_cell(xy, np.array(pdf["dofs"].tolist()), c / scale, np.einsum("eij,ej->ei", c, alpha) / scale)
    return pdf, xy, c, alpha, weight, scale * hat, scale * beta[..., 0]


def cell_conductivity(elements: DataFrame) -> DataFrame:
    """`effective_conductivity` of element rows: a map is solved and averaged in its task, and one row of it comes out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        *_, weight, hat = _conducting(pdf)
        return pd.DataFrame({"map_id": pdf["map_id"].iloc[:1].tolist(), "kappa": [_overall(weight, hat).ravel()]})

    return elements.select("map_id", "elem_id", "dofs", "xy", "kappa").groupBy("map_id").applyInPandas(run, "map_id string, kappa array<double>")


def cell_heat_flux(elements: DataFrame, flux: tuple[float, float, float]) -> DataFrame:
    """`heat_flux` of element rows: a map is solved once, in one task, and no tensors leave it."""
    names = ["q1", "q2", "q3", "t1", "t2", "t3", "q", "t"]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, xy, kappa, weight, hat = _conducting(pdf)
        macro = -np.linalg.solve(_overall(weight, hat), np.array(flux, float))
        q = -hat @ macro
        t = -np.linalg.solve(kappa, np.swapaxes(q, 1, 2)).swapaxes(1, 2)
        values = np.concatenate([q, t, np.linalg.norm(q, axis=2, keepdims=True), np.linalg.norm(t, axis=2, keepdims=True)], 2).reshape(-1, 8)
        return pd.DataFrame(_points(pdf, xy, weight) | dict(zip(names, values.T, strict=True)))

    return elements.select("map_id", "elem_id", "dofs", "xy", "kappa").groupBy("map_id").applyInPandas(run, _POINT + ", ".join(f"{n} double" for n in names))


def cell_thermoelastic(elements: DataFrame) -> DataFrame:
    """`effective_thermoelastic` of element rows: a map is solved and averaged in its task, and one row of it comes out."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        *_, weight, hat, beta_hat = _elastic(pdf)
        c, beta = _overall(weight, hat), _overall(weight, beta_hat)
        c = (c + c.T) / 2
        return pd.DataFrame({"map_id": pdf["map_id"].iloc[:1].tolist(), "stiffness": [c.ravel()], "beta": [beta], "alpha": [np.linalg.solve(c, beta)]})

    shape = "map_id string, stiffness array<double>, beta array<double>, alpha array<double>"
    return elements.select("map_id", "elem_id", "dofs", "xy", "stiffness", "alpha").groupBy("map_id").applyInPandas(run, shape)


def cell_stress_strain(elements: DataFrame, stress: tuple[float, ...], temperature: float = 0.0, tensor_shear: bool = False) -> DataFrame:
    """`stress_strain` of element rows: a map is solved once, in one task, and no tensors leave it."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf, xy, c, alpha, weight, hat, beta_hat = _elastic(pdf)
        overall, beta = _overall(weight, hat), _overall(weight, beta_hat)
        macro = np.linalg.solve((overall + overall.T) / 2, np.array(stress) + temperature * beta)
        four = lambda m: np.repeat(m, 4, 0)
        values = _local_fields((hat @ macro - temperature * beta_hat).reshape(-1, 6), four(c), four(alpha), temperature, tensor_shear)
        return pd.DataFrame(_points(pdf, xy, weight) | dict(zip(_FIELDS, values.T, strict=True)))

    shape = _POINT + ", ".join(f"{f} double" for f in _FIELDS)
    return elements.select("map_id", "elem_id", "dofs", "xy", "stiffness", "alpha").groupBy("map_id").applyInPandas(run, shape)


def jacobian() -> Column:
    """Twice the area of an element with columns x1, y1, ..., x3, y3; the same at all its points."""
    x, y = [F.col(f"x{i}") for i in (1, 2, 3)], [F.col(f"y{i}") for i in (1, 2, 3)]
    return (x[1] - x[0]) * (y[2] - y[0]) - (x[2] - x[0]) * (y[1] - y[0])


def quadrature_points(placed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(elem_id, qp, x, y, weight): places of the rule in each element (x1, y1, ..., x3, y3) and their shares of its area; `keep` are further columns of the element."""
    at = [F.struct(F.lit(q).alias("qp"), T.add([F.lit(float(p[i])) * F.col(f"x{i + 1}") for i in range(3)]).alias("x"), T.add([F.lit(float(p[i])) * F.col(f"y{i + 1}") for i in range(3)]).alias("y"), (F.lit(float(w)) * jacobian() / 2).alias("weight")) for q, (p, w) in enumerate(zip(PLACES, WEIGHTS, strict=True))]
    return placed.select("elem_id", *keep, F.explode(F.array(*at)).alias("p")).select("elem_id", "p.*", *keep)


def conduction_matrix(placed: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """(elem_id, i, j, value): the linear triangle's conductivity matrix for plane conductivity k11, k12, k22, from its corners; `keep` are further columns of the element."""
    x, y = [F.col(f"x{i}") for i in (1, 2, 3)], [F.col(f"y{i}") for i in (1, 2, 3)]
    b = [y[(i + 1) % 3] - y[(i + 2) % 3] for i in range(3)]
    c = [x[(i + 2) % 3] - x[(i + 1) % 3] for i in range(3)]
    k11, k12, k22 = F.col("k11"), F.col("k12"), F.col("k22")
    entry = lambda i, j: (b[i] * k11 * b[j] + (b[i] * c[j] + c[i] * b[j]) * k12 + c[i] * k22 * c[j]) / (2 * jacobian())
    each = [F.struct(F.lit(i + 1).alias("i"), F.lit(j + 1).alias("j"), entry(i, j).alias("value")) for i in range(3) for j in range(3)]
    return placed.select("elem_id", *keep, F.explode(F.array(*each)).alias("e")).select("elem_id", "e.*", *keep)


#: Entries of element matrices that a task sums before they are shuffled, and slaves that are sent to all tasks, at most.
ENTRIES, SLAVES = 2_000_000, 1_000_000


def with_masters(elements: DataFrame, periodic: DataFrame) -> DataFrame:
    """Linear elements with their slaves replaced by the masters."""
    few = periodic.limit(SLAVES + 1).count() <= SLAVES
    pairs = checkpointed(periodic.select("node_id", "master_id"))
    for c in ("n1", "n2", "n3"):
        own = pairs.withColumnsRenamed({"node_id": c, "master_id": "__master"})
        elements = elements.join(F.broadcast(own) if few else own, c, "left").withColumn(c, F.coalesce("__master", c)).drop("__master")
    return elements


def assemble(matrix: DataFrame, elements: DataFrame, periodic: DataFrame | None = None) -> DataFrame:
    """(row, col, value): element matrices (elem_id, i, j, value) summed over the nodes of linear elements, slaves standing for their masters.

    A matrix that has its elements' nodes n1, n2, n3 needs no join with them.
    """
    corner = lambda c: F.element_at(F.array("n1", "n2", "n3"), F.col(c))
    if not {"n1", "n2", "n3"} <= set(matrix.columns):
        nodes = elements.select("elem_id", "n1", "n2", "n3")
        matrix = matrix.join(nodes if periodic is None else with_masters(nodes, periodic), "elem_id")
    elif periodic is not None:
        matrix = with_masters(matrix, periodic)
    return matrix.select(corner("i").alias("row"), corner("j").alias("col"), "value").groupBy("row", "col").agg(F.sum("value").alias("value"))

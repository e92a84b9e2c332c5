"""Which candidates a run asks for next, from its own few numbers: the small part of a refinement that isn't a table.

A run probes about its parameters and then leaps; every candidate lies within the level's bounds, but for the offsets of
a difference quotient. Two rules: "Powell" throws along a set of directions, which its own moves renew; the others fit a
quadratic to differences and take damped Newton steps in the parameters that bounds leave free.
"""

import numpy as np

# The widths of the bounds by mode: factor on h00 and h11, width on h01 and h10, width on h02 and h12, and
# absolute limits of h20 and h21.
WIDTHS = {"strict": (0.1, 0.1, 50.0, 0.001), "adaptive": (0.3, 0.3, 150.0, 0.01)}
METHODS, MODES = ["Powell", "BFGS", "L-BFGS-B", "TNC"], ["none", *WIDTHS]

FLOORS = np.array([1e-2, 1e-2, 1, 1e-2, 1e-2, 1, 1e-5, 1e-5])  # the least size of each parameter that counts as its scale
PAIRS = np.array([(i, j) for i in range(8) for j in range(i + 1, 8)]).T
THROWS = np.array([s * 10.0**-k for k in (0, 0.5, 1, 1.5, 2) for s in (1, -1)])
SHARES, SOME = np.array([3, 2, 0.7, 0.5, 0.35, 0.25, 0.15, 0.1, 0.05]), np.array([0.5, 0.25])  # of all moves at once, of the best few
DAMPS, LENGTHS = (1e-9, 1e-6, 1e-4, 1e-2, 1), np.array([2, 1, 0.5, 0.2, 0.05])  # of Newton steps
DIRECTIONS = 16  # the eight parameters' and the last moves


def bounds_of(params: np.ndarray, mode) -> np.ndarray | None:
    """Low and high of the eight parameters about params; ends are ordered where a negative entry would swap them."""
    if mode == "none":
        return None
    if not isinstance(mode, str) or mode not in WIDTHS:
        raise ValueError(f"bounds must be none, strict or adaptive, not {mode!r}")
    factor, turn, shift, tilt = WIDTHS[mode]
    reach = np.array([abs(params[0]) * factor, turn, shift, turn, abs(params[4]) * factor, shift])
    low, high = np.append(params[:6] - reach, [-tilt, -tilt]), np.append(params[:6] + reach, [tilt, tilt])
    return np.stack([low, high], axis=1)


def _within(candidates: np.ndarray, bounds) -> np.ndarray:
    return candidates if bounds is None else np.minimum(np.maximum(candidates, bounds[:, 0]), bounds[:, 1])


def probe(powell: bool, x: np.ndarray, basis: np.ndarray, bounds) -> np.ndarray:
    """x, then throws along each direction, or the points of first and second differences."""
    if powell:
        return np.concatenate([x[None], _within((x + THROWS[None, :, None] * basis[:, None]).reshape(-1, 8), bounds)])
    e = np.diag(basis[0])
    return np.concatenate([x[None], x + e, x - e, x + e[PAIRS[0]] + e[PAIRS[1]]])


def _newton_steps(values: np.ndarray, x: np.ndarray, unit: np.ndarray, bounds) -> list:
    f, up, down, both = values[0], values[1:9], values[9:17], values[17:]
    g, curve = (up - down) / 2, np.diag(up + down - 2 * f)
    curve[PAIRS[0], PAIRS[1]] = curve[PAIRS[1], PAIRS[0]] = both - up[PAIRS[0]] - up[PAIRS[1]] + f
    free = np.ones(8, bool) if bounds is None else ~(((x <= bounds[:, 0]) & (g > 0)) | ((x >= bounds[:, 1]) & (g < 0)))
    if not free.any():
        return []
    w, q = np.linalg.eigh(curve if free.all() else curve[free][:, free])
    turned, w, back = q.T @ g[free], np.abs(w), -q
    steps = np.zeros((len(DAMPS), 8))
    for i, damp in enumerate(DAMPS):
        steps[i, free] = back @ (turned / (w + damp * max(w.max(), 1e-300)))
    return list((x + LENGTHS[None, :, None] * unit * steps[:, None]).reshape(-1, 8))


def leap(powell: bool, x: np.ndarray, basis: np.ndarray, bounds, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Candidates that the probe's values speak for, and the basis as it goes on: lengths follow what throws were best."""
    if not powell:
        smooth = np.isfinite(values).all()
        return _within(np.array([*(_newton_steps(values, x, basis[0], bounds) if smooth else []), *probe(False, x, basis, None)]), bounds), basis
    thrown = values[1:].reshape(len(basis), -1)
    best, each = thrown.argmin(axis=1), np.arange(len(basis))
    drop = values[0] - thrown[each, best]
    t = np.where(drop > 0, THROWS[best], 0.0)[:, None]
    moves = t * basis
    sums = np.cumsum(moves[np.argsort(-np.where(np.isfinite(drop), drop, 0))], axis=0)
    parts = (SOME[:, None, None] * sums[None, 1:4]).reshape(-1, 8)
    return _within(x + np.concatenate([sums, moves, SHARES[:, None] * sums[-1], parts]), bounds), basis * np.where(t != 0, np.clip(3 * np.abs(t), 0.05, 3), 1 / 30)


def begun(x: np.ndarray, level: int, stages: list) -> dict:
    """The state in which a run begins a level."""
    powell, bounds = stages[level]["method"] == "Powell", bounds_of(x, stages[level]["bounds"])
    x = _within(x, bounds)
    scale = np.maximum(np.abs(x), FLOORS)
    basis = np.diag(0.1 * scale) if powell else 1e-3 * scale[None]
    return {"level": level, "turn": 0, "leaps": False, "x": x, "value": float("inf"), "basis": basis, "bounds": bounds, "candidates": probe(powell, x, basis, bounds)}


def advanced(state: dict, stages: list, values: np.ndarray, turns: int) -> dict:
    """The state after the values of its candidates are known; a run that is through has no candidates."""
    x, basis, bounds = state["x"], state["basis"], state["bounds"]
    powell = stages[state["level"]]["method"] == "Powell"
    if not state["leaps"]:
        candidates, basis = leap(powell, x, basis, bounds, values)
        return state | {"leaps": True, "value": float(values[0]), "basis": basis, "candidates": candidates}
    k, value = int(values.argmin()), state["value"]
    if values[k] < value:
        move, gain = state["candidates"][k] - x, value - values[k]
        x, value = state["candidates"][k], float(values[k])
        basis = np.concatenate([basis[:8], basis[8:][-(DIRECTIONS - 9) :], move[None]]) if powell else basis / (4 if gain <= 1e-4 * abs(value) else 1)
    elif not powell:
        basis = basis / 10
    turn, level = state["turn"] + 1, state["level"]
    if turn < turns:
        return state | {"turn": turn, "leaps": False, "x": x, "value": value, "basis": basis, "candidates": probe(powell, x, basis, bounds)}
    if level + 1 < len(stages):
        return begun(x, level + 1, stages)
    return state | {"turn": turn, "x": x, "value": value, "basis": basis, "candidates": np.zeros((0, 8))}

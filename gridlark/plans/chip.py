"""Port names and nets of the full grid, by rule."""

from __future__ import annotations

LANES, STEPS = 8, {"S": 1, "D": 2, "Q": 4, "L": (10, 12)}


def families() -> list[str]:
    """Wire, compass and, for the shortest wires, variant."""
    return [w + c + v for w in STEPS for c in "ENSW" for v in ("AB" if w == "S" else [""])]


def port_names() -> list[str]:
    """Exits (Z) and entries (I) of each wire, then the pins of the logic of both kinds."""
    out = []
    for w in STEPS:
        for side in "ZI":
            out += [f"{side}{f}[{i}]" for f in families() if f[0] == w for i in range(LANES)]
    pins = [*map(str, range(6)), "D", "M", "Q0", "Q1", "Y"]
    return out + [f"{kind}_{bank}{pin}" for kind in "AS" for bank in "ABCDEFGH" for pin in pins]


def nets() -> list[tuple[int, int, int, int]]:
    """(from port, to port, dx, dy): each exit leads to the entry of its name, some cells along its compass."""
    at = {n: i for i, n in enumerate(port_names())}
    out = []
    for lane in range(LANES):
        for f in families():
            step = STEPS[f[0]]
            x, y = step if isinstance(step, tuple) else (step, step)
            dx, dy = {"E": (x, 0), "W": (-x, 0), "N": (0, y), "S": (0, -y)}[f[1]]
            out.append((at[f"Z{f}[{lane}]"], at[f"I{f}[{lane}]"], dx, dy))
    return out

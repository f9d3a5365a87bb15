"""Values that results depend on. They are facts of the routing grid and its file formats, kept in natural order."""

from __future__ import annotations

# Cells of the grid.
WIDTH, HEIGHT = 120, 550

# Fixed values: (site, delay) of the lines across x and across y. A step from site to site + 1 crosses the line.
VERTICAL_LINES = [
    (9, 78), (19, 78), (33, 9), (39, 78), (45, 78), (51, 78), (57, 98),
    (63, 9), (69, 78), (95, 98), (99, 177), (105, 9), (111, 78), (117, 9),
]
HORIZONTAL_LINES = [(49, 8), (149, 8), (249, 8), (349, 8), (449, 8)]

# Blocks without sites: lower, upper, left, right, crossable along y, its delay, crossable along x, its delay.
BLOCKS = [
    (0, 99, 0, 15, False, 0, False, 0),
    (0, 49, 76, 89, False, 0, True, 292),
    (100, 149, 76, 89, False, 0, True, 292),
    (200, 249, 76, 89, False, 0, True, 292),
    (300, 349, 76, 89, False, 0, True, 292),
    (400, 449, 76, 89, False, 0, True, 292),
    (500, 549, 76, 89, False, 0, True, 292),
]

# Directions of the potentials, in the order of the feature columns.
DIRECTIONS = [(1, 0), (-1, 0), (0, 1), (0, -1), (1, 1), (1, -1), (-1, 1), (-1, -1)]
#: Potentials count in 1 / SCALE of a delay unit.
SCALE = 256

# Letters of port names, in the order of their codes.
DOMAINS, WIRES, COMPASS, VARIANTS, BANKS = "ZIAS", "SDQL-", "ENSW-", "AB-", "ABCDEFGH-"

# The linear start of the calibrated estimate, and the fixed-point format of its factors.
NUMERATOR, DENOMINATOR, INTERCEPT, Q_SHIFT = 1306, 1000, 170, 14

# Search features, in the order of their file.
SEARCH_COLUMNS = ["raw", *[f"d{i}" for i in range(8)], "best", "second", "direct", "candidates", "min_initial", "max_initial", "best_initial", "best_x", "best_y", "best_internal"]
